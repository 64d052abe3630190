"""Deterministic text search, classification and scanning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores of an exact, a prefix and a substring match (fixed values).
EXACT, PREFIX, SUBSTRING = 1.0, 0.8, 0.5
SNIPPET = 240
#: Byte sizes that part the size classes (fixed values).
SIZE_CLASSES = ((4_096, "tiny"), (64_000, "small"), (512_000, "medium"), (5_000_000, "large"))
#: Longest page name or link text, link address, tag and block id, and the shortest block id (fixed values).
NAME_MAX, ADDRESS_MAX, TAG_MAX, BLOCK_MIN, BLOCK_MAX = 256, 512, 80, 3, 128
#: The four kinds of reference by the syntax of notes: (pattern, group of the target).
REFERENCE_PATTERNS = {
    "wikilink": (rf"\[\[([^\]\n]{{1,{NAME_MAX}}})\]\]", 1),  # [[name]] or [[name|shown]]
    "markdown-link": (rf"\[[^\]\n]{{1,{NAME_MAX}}}\]\(([^) \t\n]{{1,{ADDRESS_MAX}}})", 1),  # [text](address ...
    "hash-tag": (rf"(^|[ \t\n(\[{{])#([A-Za-z0-9_/-]{{1,{TAG_MAX}}})", 2),  # #tag at the start of a word
    "block-ref": (rf"\(\(([A-Za-z0-9_-]{{{BLOCK_MIN},{BLOCK_MAX}}})\)\)", 1),  # ((id))
}
#: Needles for one pass over the texts.
NEEDLES_A_PASS = 50_000


def name_score(name: Column, text: str) -> Column:
    low = F.lower(name)
    return F.when(low == text, EXACT).when(F.startswith(low, F.lit(text)), PREFIX).when(F.contains(low, F.lit(text)), SUBSTRING).otherwise(0.0)


def text_search(entities: DataFrame, text: str, limit: int, types: tuple[str, ...] = ()) -> DataFrame:
    """Top entities by the better of display name and alias; the display name wins ties."""
    text = text.strip().lower()
    if types:
        entities = entities.where(F.col("type").isin(*types))
    out = entities.withColumn("by_name", name_score(F.col("display_name"), text)).withColumn("by_alias", name_score(F.col("alias"), text))
    out = out.withColumn("score", F.greatest("by_name", "by_alias")).where("score > 0")
    return out.withColumn("basis", F.when(F.col("by_name") >= F.col("by_alias"), "display-name").otherwise("alias")).orderBy(F.desc("score"), "entity_id").limit(limit)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def term_search(docs: DataFrame, query: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The older search: the sum of the terms' occurrences, the matched terms and a snippet."""
    terms = list(dict.fromkeys(x for x in query.lower().split() if x))
    low = F.lower(F.col(text))
    counts = [occurrences(low, t) for t in terms]
    score = sum(counts[1:], counts[0])
    matched = F.concat_ws(",", *(F.when(c > 0, t) for t, c in zip(terms, counts)))
    out = docs.select(key, score.alias("score"), matched.alias("matched"), F.substring(F.col(text), 1, SNIPPET).alias("snippet"))
    return out.where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def tier_of(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str = "open") -> Column:
    """First rule of which a keyword stands between Unicode word boundaries, with an English ending allowed."""
    out = None
    for tier, words in rules:
        hit = text.rlike(r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(words) + r")(s|es|ed|ing)?(?![\p{L}\p{N}])")
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise(default)


def bait_scan(docs: DataFrame, needles: DataFrame, key: str = "doc_id", text: str = "text", a_pass: int = NEEDLES_A_PASS) -> DataFrame:
    """First offset (in characters) of each needle in each text that has it as a substring.

    ``needles``: item_id, text. All needles of a pass are looked for at once by an automaton, so
    the work is linear in the texts; more needles than ``a_pass`` take more passes. Null and empty
    needles are none; needles with equal texts are all reported.
    """
    import ahocorasick

    spark = docs.sparkSession
    wanted = needles.where("text IS NOT NULL AND text <> ''").select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = wanted.withColumn("pass", F.pmod(F.xxhash64("text"), F.lit(max(1, -(-wanted.count() // a_pass))))).select("pass", "item_id", "text")
    n_passes = [r["pass"] for r in passes.select("pass").distinct().orderBy("pass").collect()]
    rows, schema = docs.select(key, text).where(F.col(text).isNotNull()), docs.select(key).schema.add("item_id", "long").add("offset", "long")

    def scan(shared):
        def body(frames):
            finder, ids = ahocorasick.Automaton(), {}
            for item, needle in shared.value:
                ids.setdefault(needle, []).append(item)
            for needle in ids:
                finder.add_word(needle, needle)
            finder.make_automaton()
            for frame in frames:
                out = []
                for k, whole in zip(frame[key], frame[text]):
                    first: dict[str, int] = {}
                    for end, needle in finder.iter(whole):
                        first.setdefault(needle, end - len(needle) + 1)
                    out += [(k, item, at) for needle, at in first.items() for item in ids[needle]]
                yield pd.DataFrame(out, columns=[key, "item_id", "offset"])

        return body

    found = None
    for p in n_passes:
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in passes.where(F.col("pass") == p).collect()])  # about a_pass of them
        part = rows.mapInPandas(scan(shared), schema)
        found = part if found is None else found.union(part)
    return rows.select(key, F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("offset")).where("false") if found is None else found


def size_class(n: Column) -> Column:
    out = None
    for limit, name in SIZE_CLASSES:
        out = F.when(n <= limit, name) if out is None else out.when(n <= limit, name)
    return out.otherwise("huge")


def markdown_summary(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Counts of a page's structure."""
    t = F.col(text)
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return docs.select(
        "path", count(r"(?m)^#{1,6}\s+\S").alias("headings"), count(REFERENCE_PATTERNS["wikilink"][0]).alias("wikilinks"), count(REFERENCE_PATTERNS["markdown-link"][0]).alias("links"),
        count(REFERENCE_PATTERNS["hash-tag"][0]).alias("hash_tags"), count(REFERENCE_PATTERNS["block-ref"][0]).alias("block_refs"), count(r"(?m)^[ \t]*[A-Za-z0-9_-]+::").alias("properties"), size_class(F.octet_length(t)).alias("size_class"),
    )


def references(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Each reference of each page: path, kind, normalised target."""
    out = None
    for kind, (pattern, group) in REFERENCE_PATTERNS.items():
        found = docs.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("raw"))
        out = found if out is None else out.union(found)
    target = F.when(F.col("kind") == "wikilink", F.split_part("raw", F.lit("|"), F.lit(1))).otherwise(F.col("raw"))
    return out.select("path", "kind", F.lower(F.trim(target)).alias("target")).where("target <> ''")


def reference_digests(docs: DataFrame, secret: str, text: str = "markdown") -> DataFrame:
    """Occurrences of each (kind, keyed hash) a page."""
    key = F.sha2(F.concat(F.lit(f"reference:{secret}:"), "kind", F.lit(":"), "target"), 256)
    return references(docs, text).groupBy("path", "kind", key.alias("ref_hash")).agg(F.count("*").alias("occurrences"))


def chunks(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Consecutive chunks of ``size`` characters: key, ordinal, chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1))
    return docs.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(starts).alias("ordinal")).select(key, "ordinal", F.substring(F.col("_t"), F.col("ordinal") * size + 1, F.lit(size)).alias("chunk"))


def outline(docs: DataFrame, key: str = "path", text: str = "markdown") -> DataFrame:
    """Lines with their depth by indentation and whether they are in the page's property prefix."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    bullet, heading = F.col("line").rlike(r"^\s*- "), F.col("line").rlike(r"^#{1,6}\s")
    first = F.min(F.when(bullet, F.col("pos"))).over(Window.partitionBy(key))
    depth = F.floor(F.length(F.regexp_extract("line", r"^(\s*)", 1)) / 2).cast("long")
    return lines.select(key, "pos", F.when(bullet, depth).otherwise(-1).alias("depth"), heading.alias("heading"), (F.col("line").rlike(r"^[A-Za-z0-9_-]+:: ") & (F.col("pos") < F.coalesce(first, F.lit(1 << 30)))).alias("page_property"))
