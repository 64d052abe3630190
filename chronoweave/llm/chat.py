"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the assistant and the
others as named users. ``mask`` lists the character spans to learn from: what the speaker
says, with its end marker. Long dialogues are rendered in parts of so many turn numbers, each
after the last turns of the part before: they are context, and no mask covers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS, CARRY_TURNS = 64, 8
ASSISTANT, USER_HEAD, USER_TAIL, END = "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"
NOBODY = "unknown"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, carry_turns: int = CARRY_TURNS) -> DataFrame:
    """One row per dialogue part and participant of the dialogue.

    ``turns``: conv_id, turn, role, text. Returns conv_id, perspective, part, turns, text, mask.
    A null role is ``unknown``, a null text empty, a null turn number 0; rows without conv_id
    form one dialogue. Repeated rows are one turn; equal turn numbers go by role, then text.
    A participant silent in a part still gets it, with an empty mask. ``turns`` counts the part's
    own turns, not the last ``carry_turns`` numbers of the part before. Every turn is in exactly
    one part's own turns, however long the dialogue. Other columns are ignored; an empty table
    gives no rows.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    rows = turns.select("conv_id", turn.alias("turn"), F.coalesce("role", F.lit(NOBODY)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    part = F.floor(F.col("turn") / part_turns).cast("long")
    speakers = rows.select("conv_id", F.col("role").alias("perspective")).distinct()
    here = F.struct(part.alias("part"), F.lit(False).alias("carried"))
    after = F.struct((part + 1).alias("part"), F.lit(True).alias("carried"))
    copies = F.when(F.pmod("turn", F.lit(part_turns)) >= part_turns - carry_turns, F.array(here, after)).otherwise(F.array(here))
    placed = rows.withColumn("p", F.explode(copies)).select("conv_id", "p.part", "p.carried", "turn", "role", "text")
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "carried"))).alias("said"), F.count_if(~F.col("carried")).alias("own")).where("own > 0")
    each = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.conv_id", "perspective", "part", "own", "said")
    mine = lambda m: m["role"] == F.col("perspective")
    head = lambda m: F.when(mine(m), ASSISTANT).otherwise(F.concat(F.lit(USER_HEAD), m["role"], F.lit(USER_TAIL)))
    lines = each.withColumn("lines", F.transform("said", lambda m: F.struct((mine(m) & ~m["carried"]).alias("mine"), F.length(head(m)).alias("skip"), F.concat(head(m), m["text"], F.lit(END)).alias("line"))))

    def step(acc, x):
        size = F.length(x["line"])
        span = F.concat((acc["at"] + x["skip"]).cast("string"), F.lit("-"), (acc["at"] + size).cast("string"))
        return F.struct((acc["at"] + size).alias("at"), F.when(x["mine"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    mask = F.aggregate("lines", start, step, lambda acc: F.array_join(acc["spans"], ","))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return lines.select("conv_id", "perspective", "part", F.col("own").cast("long").alias("turns"), text.alias("text"), mask.alias("mask"))


ROTATE_SQL = f"""
    WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '{NOBODY}') AS role, coalesce(text, '') AS text FROM conversations),
    s AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
    c AS (SELECT *, turn // {PART_TURNS} AS part, false AS carried FROM t UNION ALL SELECT *, turn // {PART_TURNS} + 1, true FROM t WHERE turn % {PART_TURNS} >= {PART_TURNS - CARRY_TURNS}),
    l AS (SELECT c.*, s.perspective, c.role = s.perspective AND NOT carried AS mine,
            CASE WHEN c.role = s.perspective THEN '<|assistant|>' || chr(10) ELSE '{USER_HEAD}' || c.role || '|>' || chr(10) END AS head
          FROM c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
    m AS (SELECT *, head || text || '<|end|>' || chr(10) AS line FROM l),
    o AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM m)
    SELECT conv_id, perspective, part, count(*) FILTER (NOT carried) AS turns, string_agg(line, '' ORDER BY turn, role, text) AS text,
           coalesce(string_agg((pos + length(head)) || '-' || (pos + length(line)), ',' ORDER BY turn, role, text) FILTER (mine), '') AS mask
    FROM o GROUP BY conv_id, perspective, part HAVING count(*) FILTER (NOT carried) > 0"""
