"""Every query of the graph operators against its SQL on the small tables."""

import duckdb
import pytest

import chronoweave.plans.log_queries  # noqa: F401
import chronoweave.plans.more_queries  # noqa: F401
import chronoweave.plans.review_queries  # noqa: F401
import chronoweave.plans.scalar_queries  # noqa: F401
import chronoweave.plans.store_queries  # noqa: F401
import chronoweave.plans.tool_queries  # noqa: F401
from chronoweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() >= 0
        return
    want = db.execute(SQL[name]).fetchall()
    columns = [x[0] for x in db.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(map(tuple, df.select(*(f"`{c}`" for c in columns)).collect())) == plain(want)


def test_redirect_chain_stops_at_sixteen(spark, tmp_path):
    """Keys whose chains are longer than those of the small tables, and one that is there twice."""
    keys = [7 * m << k for m in (1, 3) for k in range(19)] + [3, 7 << 16]
    path = str(tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest({keys})::BIGINT AS c_custkey) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}'")
    want = con.execute(f"SELECT id, target FROM ({SQL['g8_redirect_chain']})").fetchall()
    got = QUERIES["g8_redirect_chain"](spark, str(tmp_path)).select("id", "target").collect()
    assert (7 << 16, 7) in want and (7 << 15, 3) in want
    assert plain(map(tuple, got)) == plain(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["seq", "subject", "predicate", "match"]
