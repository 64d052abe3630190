"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked to target marginals; the ratio
of a cell's raked weight to its tokens calibrates the probability with which its documents
are sampled. No cell can weigh more than its tokens over the sampling rate, since no document
is taken twice: every step of the raking scales a margin's cells to the margin's target under
that bound, so what a full cell cannot take goes to the others. Targets that a margin's tokens
cannot reach are cut to what they can, and the others raised. Cells are aggregated before any
shuffle of documents; the fitting runs on the cells alone: on the driver while their counted
number is within ``CELL_BOUND``, as window sums beyond it, with the same steps.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import small, written

#: Exponents that temper the observed token shares of each margin into its target.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.7}
ROUNDS = 12
RATE = 0.5
CELL_BOUND = 100_000
#: A coarse topic of a text by what it contains, first match first (fixed values).
TOPICS = (("contact", ("@",)), ("table", ("|",)), ("symbols", ("###", "***")), ("legal", ("Licen", "License", "rights reserved")))


def topic_of(text: Column) -> Column:
    """Topic of a text by ``TOPICS``; ``prose`` otherwise."""
    out = None
    for name, marks in TOPICS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("prose")


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) fixed by the document id."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def feasible(values: DataFrame, margin: str, alpha: float, rate: float) -> DataFrame:
    """(margin, target): targets proportional to ``tokens ** alpha``, at most ``tokens / rate`` each.

    The common factor solves ``sum(least(factor * size, bound)) = all tokens``; it grows in each
    step until no further value reaches its bound.
    """
    sized = values.select(margin, F.pow(F.col("tokens").cast("double"), F.lit(alpha)).alias("size"), (F.col("tokens") / F.lit(rate)).alias("bound"), "tokens")
    sums = sized.agg(F.sum("tokens").alias("all"), F.sum("size").alias("size"), F.sum("bound").alias("bound")).first()
    factor, full = (sums["all"] or 0) / (sums["size"] or 1.0), -1
    while True:
        over = F.lit(factor) * F.col("size") >= F.col("bound")
        got = sized.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("bound"))).alias("taken"), F.sum(F.when(~over, F.col("size"))).alias("free")).first()
        if got.n == full or not got.free:
            break
        factor, full = (sums["all"] - (got.taken or 0.0)) / got.free, got.n
    return sized.select(margin, F.least(F.lit(factor) * F.col("size"), F.col("bound")).alias(f"_{margin}"))


def feasible_held(size: np.ndarray, bound: np.ndarray, total: float) -> np.ndarray:
    """The targets of ``feasible`` for values that are at hand."""
    factor, full = total / size.sum(), -1
    while True:
        over = factor * size >= bound
        if over.sum() == full or over.all():
            return np.minimum(factor * size, bound)
        factor, full = (total - bound[over].sum()) / size[~over].sum(), over.sum()


def rake_held(cells: pd.DataFrame, temper: dict[str, float], rounds: int, rate: float) -> pd.DataFrame:
    """``rake`` of cells that are at hand."""
    out = cells.reset_index(drop=True)
    tokens = out["tokens"].to_numpy(np.float64)
    bound, weight, codes, targets = tokens / rate, tokens.copy(), {}, {}
    for m, alpha in temper.items():
        codes[m] = pd.factorize(out[m])[0]
        sums = np.bincount(codes[m], tokens)
        targets[m] = feasible_held(sums**alpha, sums / rate, tokens.sum())
        out[f"_{m}"] = targets[m][codes[m]]
    for _ in range(rounds):
        for m in temper:
            order = np.lexsort((bound / weight, codes[m]))
            code = codes[m][order]
            before = pd.Series(bound[order]).groupby(code).cumsum().to_numpy() - bound[order]
            onward = pd.Series(weight[order][::-1]).groupby(code[::-1]).cumsum().to_numpy()[::-1]
            factor = np.maximum.reduceat((targets[m][code] - before) / onward, np.searchsorted(code, np.arange(len(targets[m]))))
            weight = np.minimum(weight * factor[codes[m]], bound)
    return out.assign(weight=weight)[[*temper, "tokens", "weight", *(f"_{m}" for m in temper)]]


def rake(cells: DataFrame, temper: dict[str, float], rounds: int = ROUNDS, rate: float = RATE, held: int = CELL_BOUND) -> DataFrame:
    """``cells`` (the margins and ``tokens`` > 0) with ``weight`` after so many rounds, and each margin's target ``_margin``.

    A step scales the cells of one margin value by the one factor that meets its target when no
    cell may exceed its bound: with the cells by bound over weight, that is the largest of (target -
    bounds before) / (weights from here on). Up to ``held`` cells are raked on the driver.
    """
    cells = written(cells, "cells")
    known = cells.select(*temper, "tokens").where(" AND ".join(f"`{m}` IS NOT NULL" for m in temper))
    if 0 < known.count() <= held:
        kinds = [*(f"{m} {known.schema[m].dataType.simpleString()}" for m in temper), "tokens long", "weight double", *(f"_{m} double" for m in temper)]
        return cells.sparkSession.createDataFrame(rake_held(known.toPandas(), temper, rounds, rate), ", ".join(kinds))
    for margin, alpha in temper.items():
        targets = feasible(cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")), margin, alpha, rate)
        cells = cells.join(targets, margin)
    out = written(cells.withColumn("bound", F.col("tokens") / F.lit(rate)).withColumn("weight", F.col("tokens").cast("double")), "cells")
    ties = list(temper)
    for k in range(rounds):
        for margin in temper:
            part, ratio = Window.partitionBy(margin), F.col("bound") / F.col("weight")
            before = F.coalesce(F.sum("bound").over(part.orderBy(ratio, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            onward = F.sum("weight").over(part.orderBy(ratio.desc(), *(F.col(t).desc() for t in ties)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            out = out.withColumn("_factor", (F.col(f"_{margin}") - before) / onward)
            out = out.withColumn("weight", F.least(F.col("weight") * F.max("_factor").over(part), F.col("bound"))).drop("_factor")
        if k % 4 == 3:
            out = written(out, "raked")
    return out.select(*temper, "tokens", "weight", *(f"_{m}" for m in temper))


def margin_errors(raked: DataFrame, temper: dict[str, float] | None = None, rate: float = RATE) -> DataFrame:
    """(margin, value, target, expected): tokens that the sample should have of each margin value, and will have on average."""
    parts = []
    for m in temper or TEMPER:
        sums = raked.groupBy(m).agg((F.first(f"_{m}") * F.lit(rate)).alias("target"), F.sum(F.col("weight") * F.lit(rate)).alias("expected"))
        parts.append(sums.select(F.lit(m).alias("margin"), F.col(m).alias("value"), "target", "expected"))
    return reduce(DataFrame.union, parts)


def cells_of(base: DataFrame, temper: dict[str, float]) -> DataFrame:
    """Token totals of the cells that have tokens; the margins without their prefix."""
    return base.groupBy(*(F.col(f"m_{m}").alias(m) for m in temper)).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def margins_of(docs: DataFrame, text_col: str, temper: dict[str, float]) -> DataFrame:
    """``docs`` with ``tokens`` (words) and the margins, prefixed by ``m_``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("tokens", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    for m in temper:
        base = base.withColumn(f"m_{m}", topic_of(text) if m == "topic" and "topic" not in docs.columns else F.coalesce(F.col(m).cast("string"), F.lit("")))
    return base


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: dict[str, float] | None = None, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with their margins, ``tokens`` (words), ``probability`` and ``kept``.

    ``temper`` names the margins; ``topic`` is derived from the text. Null margins count as
    empty strings and null texts as empty. Documents without words have probability 0. Rows
    with the same id are kept or dropped together. Columns of ``docs`` named like the new
    ones (but for margins that it has) are replaced. Long texts count whole; no
    rows give no rows.
    """
    temper = temper or TEMPER
    own = f"p_{uuid.uuid4().hex}"
    margins, base = [f"m_{m}" for m in temper], margins_of(docs, text_col, temper)
    raked = rake(cells_of(base, temper), temper, rounds, rate)
    share = raked.select(*(F.col(m).alias(f"m_{m}") for m in temper), F.least(F.lit(1.0), F.lit(rate) * F.col("weight") / F.col("tokens")).alias(own))
    out = base.join(small(written(share, "shares"), CELL_BOUND), margins, "left")
    p = F.when(F.col("tokens") > 0, F.coalesce(own, F.lit(0.0))).otherwise(0.0)
    return out.withColumn("probability", p).withColumn("kept", chance(F.col(id_col)) < F.col("probability")).drop(own)


def mix_sql(temper: dict[str, float], rate: float, rounds: int) -> str:
    """DuckDB SQL of the query: doc_id, margins, tokens, probability to 6 places, kept."""
    case = " ".join("WHEN " + " OR ".join(f"contains(t, '{x}')" for x in marks) + f" THEN '{name}'" for name, marks in TOPICS)
    parts = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {case} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "c AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for m, a in temper.items():  # the same solution as one of the steps below, over the values of a margin
        parts += [
            f"v_{m} AS (SELECT {m}, pow(sum(tokens), {a}) AS size, sum(tokens) / {rate} AS bound FROM c GROUP BY {m})",
            f"f_{m} AS (SELECT *, ((SELECT sum(tokens) FROM c) - coalesce(sum(bound) OVER (ORDER BY bound / size, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(size) OVER (ORDER BY bound / size DESC, {m} DESC ROWS UNBOUNDED PRECEDING) AS f FROM v_{m})",
            f"t_{m} AS MATERIALIZED (SELECT {m}, least(size * max(f) OVER (), bound) AS t_{m} FROM f_{m})",
        ]
    parts.append(f"s0 AS (SELECT *, tokens / {rate} AS bound, tokens::DOUBLE AS w FROM c " + " ".join(f"JOIN t_{m} USING ({m})" for m in temper) + ")")
    k, up, down = 0, ", ".join(temper), ", ".join(f"{m} DESC" for m in temper)
    for _ in range(rounds):
        for m in temper:
            before = f"coalesce(sum(bound) OVER (PARTITION BY {m} ORDER BY bound / w, {up} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
            onward = f"sum(w) OVER (PARTITION BY {m} ORDER BY bound / w DESC, {down} ROWS UNBOUNDED PRECEDING)"
            parts.append(f"s{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (least(w * max(f) OVER (PARTITION BY {m}), bound) AS w) FROM (SELECT *, (t_{m} - {before}) / {onward} AS f FROM s{k}))")
            k += 1
    parts.append(f"r AS (SELECT d.*, CASE WHEN d.tokens > 0 THEN least(1.0, {rate} * w / s{k}.tokens) ELSE 0 END AS p FROM d LEFT JOIN s{k} USING (source, lang, topic))")
    return "WITH " + ", ".join(parts) + " SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0 < p AS kept FROM r"
