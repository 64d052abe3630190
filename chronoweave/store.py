"""The graph store: its tables, and the tools that a caller can ask.

Reads return DataFrames with the scalars of the answer beside them. Writes append to Parquet
tables; there is one writer a store, and numbering and times are made in its commit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import access
from chronoweave.functions.digest import json_digest
from chronoweave.operators import assertions as asr
from chronoweave.operators import graph, search
from chronoweave.operators.assertions import AssertionQuery, QueryRefused
from chronoweave.streaming.feed import read_changes

ASSERTIONS = """seq long, assertion_id string, kind string, lineage_action string, subject long, predicate string, target long, value string, recorded_at string,
    superseded_at string, superseded_by long, from_kind string, from_value string, to_kind string, to_value string, client_id string, tier string, tier_rank int, withheld boolean"""
ENTITIES = "entity_id string, type string, display_name string, alias string, updated_at string, tier string, tier_rank int, withheld boolean"
RECEIPTS = "client_id string, idempotency_key string, request_digest string, submission_id string, committed_at string"
ALIASES = "old_id string, new_id string, disposition string"
BATCH_MAX = 100


@dataclass
class Answer:
    """Rows of an answer, or the reason of its refusal."""

    rows: DataFrame | None = None
    refusal: str | None = None
    facts: dict = field(default_factory=dict)


class GraphStore:
    """Tables of one store under a path, read for one grant."""

    def __init__(self, spark: SparkSession, path: str, grant: access.Grant, epoch: str = "e1", floor: str = ""):
        self.spark, self.path, self.grant, self.epoch, self.floor = spark, path, grant, epoch, floor

    @classmethod
    def create(cls, spark: SparkSession, path: str, grant: access.Grant, **more) -> GraphStore:
        for name, schema in (("assertions", ASSERTIONS), ("entities", ENTITIES), ("receipts", RECEIPTS), ("aliases", ALIASES), ("stamps", "seq long, superseded_at string, superseded_by long")):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
        return cls(spark, path, grant, **more)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        """Assertions with their first supersession stamp folded in."""
        stamps = self.table("stamps").groupBy("seq").agg(F.min(F.struct("superseded_at", "superseded_by")).alias("s"))
        rows = self.table("assertions").drop("superseded_at", "superseded_by").join(stamps, "seq", "left")
        return rows.withColumns({"superseded_at": F.col("s.superseded_at"), "superseded_by": F.col("s.superseded_by")}).drop("s")

    def entities(self) -> DataFrame:
        """The last image of each entity."""
        # of equal times the image that comes last by its own fields, so that every run gives the same
        return self.table("entities").groupBy("entity_id").agg(F.max_by(F.struct("*"), F.struct("updated_at", "display_name", "alias")).alias("e")).select("e.*")

    # reads

    def contract_describe(self) -> Answer:
        return Answer(asr.registry(self.table("assertions")), facts={"page_default": asr.PAGE_DEFAULT, "page_max": asr.PAGE_MAX, "batch_max": BATCH_MAX, "max_depth": graph.MAX_DEPTH})

    def scope_describe(self) -> Answer:
        return Answer(facts={"client_id": self.grant.client_id, "tiers": self.grant.tiers, "ceiling": self.grant.ceiling, "supersession_scope": self.grant.supersession_scope})

    def _ids(self, ids: list[str]) -> DataFrame:
        if not 1 <= len(ids) <= BATCH_MAX:
            raise ValueError("1 to 100 ids")
        return self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")

    def entity_resolve(self, ids: list[str]) -> Answer:
        live = self.entities().select(F.col("entity_id").alias("id"))
        return Answer(graph.resolve(self.table("aliases"), self._ids(ids).select("id").distinct(), live))

    def entity_read(self, ids: list[str]) -> Answer:
        return Answer(asr.read_many(self._with_id(self.entities(), "entity_id", ("type", "display_name", "alias")), self._ids(ids), "id", ("allowed", "stub_id", "type", "display_name", "alias")))

    def _with_id(self, rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
        shown = access.allowed(self.grant, F.col("tier"), F.col("withheld"))
        stub = F.when(~shown, access.stub_id(self.grant, F.col(key)))
        return rows.select(F.col(key).alias("id"), shown.alias("allowed"), stub.alias("stub_id"), *(F.when(shown, F.col(c)).alias(c) for c in columns))

    def assertion_query(self, q: AssertionQuery, page_size: int = asr.PAGE_DEFAULT, after: int | None = None, watermark: int | None = None) -> Answer:
        try:
            hits = asr.query(self.log(), q, self.floor)
        except QueryRefused as e:
            return Answer(refusal=str(e))
        page = asr.page(hits, after, page_size, self.grant.max_page, watermark)
        rows = asr.with_access(page, self.grant, ("assertion_id", "subject", "predicate", "value", "target", "match"))
        counts = asr.coverage(self.log(), q, self.grant).first().asDict()
        return Answer(rows, facts=counts | {"contested": asr.contested(page.where("superseded_at IS NULL"), F.col("value")).count()})

    def assertion_read(self, ids: list[str], include_lineage: bool = False) -> Answer:
        columns = ("subject", "predicate", "value") + (("lineage_action", "superseded_by") if include_lineage else ())
        return Answer(asr.read_many(self._with_id(self.log(), "assertion_id", columns), self._ids(ids), "id", ("allowed", "stub_id", *columns)))

    def graph_neighbors(self, entity_id: int, direction: str = "outbound", predicates: tuple[str, ...] = (), max_depth: int = 1, page_size: int = asr.PAGE_DEFAULT, q: AssertionQuery | None = None) -> Answer:
        """Edges by breadth-first search; one that the reader may not see is a stub, and the walk goes on past it.

        ``facts``: ``withheld`` edges, and ``truncated_by``: the page, the policy or the depth, the first that applies.
        """
        rows = asr.query(self.log(), q or AssertionQuery(), self.floor).where("target IS NOT NULL")
        edges = rows.select("seq", F.col("subject").alias("src"), "predicate", F.col("target").alias("dst"), "lineage_action")
        start = self.spark.createDataFrame([(entity_id, entity_id)], "origin long, node long")
        size = min(page_size, self.grant.max_page)
        ranked = graph.neighbors(edges, start, direction, predicates, max_depth, size + 1)
        rank = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "seq"))
        ranked = ranked.withColumn("rank", rank)
        access_of = self.log().select("seq", "assertion_id", "tier", "withheld")
        shown = access.allowed(self.grant, F.col("tier"), F.col("withheld"))
        page = ranked.where(F.col("rank") <= size).join(access_of, "seq").withColumn("allowed", shown).withColumn("stub_id", F.when(~shown, access.stub_id(self.grant, F.col("assertion_id"))))
        hidden = lambda c: F.when(F.col("allowed"), F.col(c)).alias(c)
        more = ranked.agg(F.max("rank").alias("n"), F.max("depth").alias("deepest")).first()
        withheld = page.where("NOT allowed").count()
        truncated = "page_size" if (more.n or 0) > size else "policy" if withheld else "max_depth" if more.deepest == max_depth else None
        return Answer(page.select("depth", "allowed", "stub_id", hidden("seq"), hidden("here"), hidden("predicate") if "predicate" in page.columns else F.lit(None).cast("string").alias("predicate"), hidden("there")), facts={"withheld": withheld, "truncated_by": truncated, "deepest": more.deepest or 0})

    def text_search(self, text: str, limit: int = asr.PAGE_DEFAULT, types: tuple[str, ...] = ()) -> Answer:
        found = search.text_search(self.entities(), text, limit, types)
        return Answer(self._with_id(found, "entity_id", ("type", "display_name", "score", "basis")))

    def changes_read(self, cursor: int, limit: int = asr.PAGE_DEFAULT, epoch: str | None = None, include_records: bool = False) -> Answer:
        """Changes after ``cursor``; with records, one that the reader may not see is a stub, so that ``seq`` has no gaps."""
        try:
            page = read_changes(self.table("assertions"), cursor, limit, self.epoch, epoch)
        except ValueError as e:
            return Answer(refusal=str(e))
        if not include_records:
            return Answer(page)
        shown = self._with_id(self.log(), "assertion_id", ("subject", "predicate", "value", "target")).withColumnRenamed("id", "assertion_id")
        rows = page.join(shown, "assertion_id", "left")
        return Answer(rows, facts={"withheld": rows.where("NOT allowed").count()})

    def submission_read(self, idempotency_key: str) -> Answer:
        own = self.table("receipts").where((F.col("client_id") == self.grant.client_id) & (F.col("idempotency_key") == idempotency_key))
        return Answer(own.withColumn("expires_on", F.date_add(F.col("committed_at").cast("date"), 30)))

    def sensitive_reveal(self, stub_id: str, reason: str) -> Answer:
        """The withheld record behind a stub of this reader, once an owner's grant reaches it."""
        if not reason:
            return Answer(refusal="reason-required")
        rows = self.log().where(access.stub_id(access.Grant(self.grant.client_id), F.col("assertion_id")) == stub_id)
        return Answer(rows.select("seq", "tier", "tier_rank"), facts={"decision": "owner-pending"})

    # writes

    def assertion_propose(self, key: str, proposals: list[dict], now: str) -> Answer:
        """Commit drafts once for a key: a replay returns its receipt, another request is a conflict."""
        import json

        if not 1 <= len(proposals) <= BATCH_MAX:
            raise ValueError("1 to 100 proposals")
        text = self.spark.createDataFrame([(json.dumps(proposals),)], "t string")
        digest = text.select(json_digest("t")).first()[0]
        mine = self.table("receipts").where((F.col("client_id") == self.grant.client_id) & (F.col("idempotency_key") == key)).first()
        if mine:
            return Answer(refusal=None if mine.request_digest == digest else "idempotency-conflict", facts={"outcome": "replay" if mine.request_digest == digest else "conflict", "submission_id": mine.submission_id})
        last = self.table("assertions").agg(F.max("seq").alias("seq"), F.max("recorded_at").alias("at")).first()
        seq, at = last.seq or 0, max(now, last.at or "")
        over = [p["supersedes"] for p in proposals if p.get("supersedes") is not None]
        targets = {r.seq: r for r in self.table("assertions").where(F.col("seq").isin(over)).collect()} if over else {}  # at most 100 ids
        if set(over) - targets.keys():
            return Answer(refusal="unknown-superseded-id")
        if self.grant.supersession_scope != "any" and any(t.client_id != self.grant.client_id for t in targets.values()):
            return Answer(refusal="supersession-not-permitted")
        names = [c.split()[0] for c in ASSERTIONS.split(",")]
        rows, stamps = [], []
        for n, p in enumerate(proposals, 1):
            full = dict.fromkeys(names) | {"kind": "fact", "lineage_action": "assert", "tier": "open", "tier_rank": 10, "withheld": False} | {k: v for k, v in p.items() if k in names}
            full |= {"seq": seq + n, "assertion_id": f"as{seq + n}", "recorded_at": at, "client_id": self.grant.client_id}
            rows.append(tuple(full[c] for c in names))
            if p.get("supersedes") is not None:
                stamps.append((p["supersedes"], at, seq + n))
        self.spark.createDataFrame(rows, ASSERTIONS).write.mode("append").parquet(f"{self.path}/assertions")
        if stamps:
            self.spark.createDataFrame(stamps, "seq long, superseded_at string, superseded_by long").write.mode("append").parquet(f"{self.path}/stamps")
        submission = f"sub{seq + 1}"
        self.spark.createDataFrame([(self.grant.client_id, key, digest, submission, at)], RECEIPTS).write.mode("append").parquet(f"{self.path}/receipts")
        return Answer(facts={"outcome": "fresh", "submission_id": submission, "seqs": [r[0] for r in rows]})

    def entity_create(self, entity_id: str, type_: str, display_name: str, alias: str | None, now: str) -> Answer:
        self.spark.createDataFrame([(entity_id, type_, display_name, alias, now, "open", 10, False)], ENTITIES).write.mode("append").parquet(f"{self.path}/entities")
        return Answer(facts={"outcome": "created"})

    def entity_rename(self, entity_id: str, display_name: str, now: str) -> Answer:
        """Append a newer image; an unchanged name is a success that writes nothing."""
        have = self.entities().where(F.col("entity_id") == entity_id).first()
        if have is None:
            return Answer(refusal="unknown-entity")
        if have.display_name == display_name:
            return Answer(facts={"outcome": "unchanged"})
        return Answer(facts=self.entity_create(entity_id, have.type, display_name, have.alias, now).facts | {"outcome": "renamed"})
