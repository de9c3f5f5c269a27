"""Every named query with SQL against DuckDB on the smallest tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from logloom.functions import align
from logloom.operators import mine
from logloom.plans import queries, registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()

    def norm(rows):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in map(lambda r: tuple((x is None, x) for x in r), rows))

    assert norm(tuple(r) for r in got.select(cols).collect()) == norm(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["merge_templates", "quick_judgment"])
def test_pair_query_equals_the_kernel_on_all_pairs(spark, name):
    words = {t: set(re.findall(r"[^\W\d_]+", t)) for t in (r["template"] for r in queries._part_templates(spark, DATA).collect())}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    rarest = {t: min((df[w], w) for w in x)[1] for t, x in words.items() if x}
    met = {tuple(sorted((a, b))) for a in rarest for b in words if a != b and rarest[a] in words[b]}
    got = {(r["a"], r["b"]): r for r in registry.QUERIES[name](spark, DATA).collect()}
    assert got.keys() == met
    for (a, b), r in got.items():
        if name == "merge_templates":
            m = align.merge(a, b)
            assert (r["merged"], r["diffs"], r["rate"]) == (m.template, ",".join(f"{x}|{y}" for x, y in m.diffs), m.rate)
        else:
            ok, m = align.judge(a, b)
            assert (r["mergeable"], r["merged"]) == (ok, m.template)


def test_merge_clusters_of_statements(spark):
    """Expected by hand: variants of a statement join it, other statements stay apart."""
    groups = [
        ["connection from <*> closed", "connection from <*> <*> closed", "connection from <*>:<*> closed"],
        ["instance <*> terminated with code <*>"],
        ["cannot open file <*>", "cannot open file <*> <*>"],
        ["disk <*> is full"],
    ]
    df = spark.createDataFrame([(t,) for g in groups for t in g], "template string")
    got = {r["template"]: r["root"] for r in mine.merge_clusters(df).collect()}
    assert got == {t: min(g) for g in groups for t in g}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_event_messages_are_matched_once(spark):
    """All lines were kept, mined and joined, where the different messages are few."""
    said, _ = queries._event_entries(spark, DATA)
    lines = queries._event_content(spark, DATA)
    assert said.count() == lines.select("content").distinct().count() < lines.count() == said.agg({"rows": "sum"}).first()[0]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize(
    ("name", "table", "early", "said"),
    [("stream_mine", "documents", "doc_id % 2 = 0", "CASE WHEN doc_id < 2 THEN '4' || doc_id || chr(10) || 'at 1' ELSE text END AS text"), ("stream_mine_events", "events", "event_type = 'click'", "props AS props")],
)
def test_stream_of_several_files_equals_sql(spark, tmp_path, name, table, early, said):
    """Each file was a batch: first_batch told the file, and lines of one file went to wider templates of another."""
    where = tmp_path / f"{table}.parquet"
    where.mkdir()
    c = duckdb.connect()
    for k, rows in enumerate((early, f"NOT ({early})")):
        c.execute(f"COPY (SELECT * REPLACE ({said}) FROM read_parquet('{DATA}/{table}.parquet') WHERE {rows}) TO '{where}/{k}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{where}/*.parquet')")
    want = c.execute(f"SELECT template, first_batch, lines FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = registry.QUERIES[name](spark, str(tmp_path)).select("template", "first_batch", "lines").collect()
    assert len(got) > 3 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
