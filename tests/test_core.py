"""Columns, sources, matching, scoring, mining and streaming on small tables."""

import pytest
from pyspark.sql import functions as F

from logloom.functions import normalise, text
from logloom.operators import evaluate, index, match, mine, oracle, output
from logloom.sources import formats, logs, tables


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (text.content, "  a   b \t", "a  b"),
        (text.mask, "a1 b  2 c", "<*> b  <*> c"),
        (text.chars, "c<*", ["c", "<*>"]),
        (text.words, "ab_1<*>", ["ab", "_", "1", "<*>"]),
        (text.index_tokens, "*> a-b.c <*>x", ["*", ">", " ", "a-b.c", " ", "<*>", "x"]),
        (text.char_classes, "a1:b", [":", "alpha", "digit"]),
        (text.collapse_wildcards, "<*> <*> <*> a <*>", "<*> a <*>"),
        (text.is_degenerate, "<*> *", True),
        (text.is_number_like, "-12", True),
        (text.is_number_like, "beef", False),
        (text.is_number_like, "bee1", True),
        (text.is_word_like, "True", False),
        (text.is_word_like, "abc", True),
        (text.says_yes, "yes and no. Answer: no", False),
        (text.says_constant, "not a constant", False),
        (text.final_answer, "x Final Answer: y ", "y"),
    ],
)
def test_columns(spark, column, value, want):
    assert one(spark, value, column) == want


@pytest.mark.parametrize(("value", "want"), [("a/<*>:<*> b", "a<*> b"), ("((<*>)) x", "<*> x"), ("<*> ms.", "<*>"), ("port #<*>#", "port <*>"), ('say "<*>"', "say <*>"), ("[[[[<*>]]]] x", "<*> x"), ("<*> x", "<*> x"), ("<<<<<*>>>>> x", "<*> x"), ("#" * 9 + "<*>" + "#" * 9, "<*>"), ("[" * 40 + "<*>" + "]" * 40, "<*>")])
def test_normaliser(spark, value, want):
    assert one(spark, value, normalise.comparable) == want


def test_format_with_optional_group(spark):
    lines = spark.createDataFrame([("Jan 1 10:00:00 combo kernel: hello 2",), ("Jan 1 10:00:00 combo su[12]: hi",), ("bad",)], "value string")
    got = {r["Content"]: (r["Component"], r["PID"]) for r in logs.parse_lines(lines, formats.FORMATS["Linux"]).collect()}
    assert got == {"hello 2": ("kernel", None), "hi": ("su", "12")}


def test_all_formats_compile():
    counts = {k: len(formats.compile_format(v).fields) for k, v in formats.FORMATS.items()}
    assert counts["Thunderbird"] == 11 and counts["HealthApp"] == 4 and len(counts) == 16


def test_read_log_numbers_matching_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("[t1] p - x\nbad\n[t2] q - y 1\n")
    (tmp_path / "b.log").write_text("[t3] p - z\n")
    got = [tuple(r) for r in logs.read_log(spark, str(tmp_path), formats.FORMATS["Proxifier"]).orderBy("LineId").collect()]
    assert got == [(1, "t1", "p", "x"), (2, "t2", "q", "y 1"), (3, "t3", "p", "z")]


def test_csv_round_trip(spark, tmp_path):
    rows = [(0, 'say "<*>", null', 3), (1, "NA", 4), (2, "", 1)]
    df = spark.createDataFrame(rows, tables.MINED)
    tables.write_templates(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), tables.MINED).collect())) == rows


def test_scores_transposed(spark, tmp_path):
    s = spark.createDataFrame([("A", 1.0, 0.5), ("B", 0.9, 0.8)], "Dataset string, GA double, PA double")
    assert {r["metric"]: (r["A"], r["B"]) for r in tables.transpose_scores(s, ["A", "B"]).collect()} == {"GA": (1.0, 0.9), "PA": (0.5, 0.8)}


def test_index_threshold_and_ties(spark):
    t = spark.createDataFrame([(1, "open file <*>"), (2, "open file now please"), (3, "close"), (4, "open file")], "tid int, template string")
    q = spark.createDataFrame([(9, "open file x")], "qid int, template string")
    assert [(r["tid"], r["score"]) for r in index.candidates(q, t).orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (2, 0.5)]


def test_match_prefers_literals(spark):
    lines = spark.createDataFrame([("get a 1",), ("get b 2",), ("x",), ("a.b",), (None,)], "content string")
    t = spark.createDataFrame([("get <*> <*>",), ("get a <*>",), ("a.b",), ("<*>.b",)], "template string")
    got = dict(map(tuple, match.match_join(lines, t).collect()))
    assert got == {"get a 1": "get a <*>", "get b 2": "get <*> <*>", "a.b": "a.b"}


def test_catalog_classes():
    c = match.Catalog([match.Entry(0, "id <*>", [{"digit"}]), match.Entry(1, "id <*>", [{"alpha"}]), match.Entry(2, "<*>-<*> end", [{"digit"}, {"digit", "."}])])
    assert [c.match(m) for m in ("id 12", "id ab", "id a1", "id ", "1-2.3 end", "-2 end")] == [0, 1, -1, -1, 2, 2]
    assert match.stops("ab,c;", 0, {"alpha", ","}, {","}) == [2, 4]
    assert match.stops("abc", 0, {"alpha"}, {","}) == [3]
    assert match.fits("a1", {"alpha", "digit"}) and not match.fits("a-", {"alpha"})


def test_scores(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "y"), ("b", "z"), ("c", "w")]
    p = spark.createDataFrame(rows, "g string, p string")
    r = evaluate.scores(p).first()
    assert (r["accurate"], r["parsed"], r["real"], r["correct"], r["rows"]) == (1, 1, 2, 3, 5)
    assert (r["precision"], r["recall"], r["ga"]) == (1.0, 0.5, 0.6)


def test_scores_without_pairs_are_null(spark):
    r = evaluate.scores(spark.createDataFrame([("a", "x"), ("b", "y")], "g string, p string")).first()
    assert r["precision"] is None and r["f1"] is None and r["ga"] == 1.0


def test_scores_by_dataset(spark):
    p = spark.createDataFrame([("d", "a", "x"), ("e", "a", "x"), ("e", "b", "x")], "d string, g string, p string")
    assert {r["d"]: r["ga"] for r in evaluate.scores(p, ["d"]).collect()} == {"d": 1.0, "e": 0.0}


def test_evaluate(spark):
    truth = spark.createDataFrame([(1, "E1"), (2, "E1"), (3, "E2"), (4, None)], "LineId long, EventId string")
    parsed = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "LineId long, EventId int")
    tt = spark.createDataFrame([("E1", "took <*> ms"), ("E2", "done")], tables.TRUTH)
    pt = spark.createDataFrame([(0, "took <*>", 2), (1, "do", 2)], tables.MINED)
    r = evaluate.evaluate(truth, parsed, tt, pt).first()
    assert (r["ga"], round(r["pa"], 4)) == (1.0, 0.6667)


def test_exact_mining(spark):
    rows = [(1, "took 12 ms"), (2, "took 7 ms"), (3, "user bob left"), (4, "took 12 ms"), (5, "user bob left")]
    lines = spark.createDataFrame(rows, "LineId long, content string")
    structured, catalog = mine.mine_exact(lines)
    assert sorted(map(tuple, catalog.collect())) == [(0, "took <*> ms", 3), (1, "user bob left", 2)]
    assert {r["LineId"]: r["EventId"] for r in structured.collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}
    counts = {r["EventId"]: r["Occurrences"] for r in output.occurrences(structured).collect()}
    assert counts == {0: 3, 1: 2}


def test_exact_mining_is_bounded(spark):
    lines = spark.createDataFrame([(k, f"w{'x' * k} y") for k in range(5)], "LineId long, content string")
    with pytest.raises(ValueError, match="more than 2 masks"):
        mine.mine_exact(lines.withColumn("content", F.concat(F.lit("a"), F.repeat(F.lit("z"), F.col("LineId").cast("int")))), most=2)


def test_recorded_oracle_merges():
    o = oracle.Recorded(merges={("send one two three <*>", "send one two four <*>"): True})
    m = mine.Miner(o)
    a = m.feed("send one two four 1", 1)
    b = m.feed("send one two three 2", 2)
    assert (a == b) is (len(m.clusters) == 1)
    assert m.calls == 2


def test_refinement():
    o = oracle.Heuristic()
    assert mine.restore_constants("user <*> left", "user bob left", o).template == "user bob left"
    assert mine.mask_variables("user 77 left 7", "user 77 left 7", o).template == "user <*> left <*>"
    assert oracle.connect("") is None and oracle.says_yes("maybe\nAnswer: YES")


def test_scalable_mining(spark):
    rows = [(1, "took 12 ms"), (2, "took 7 ms"), (3, "user bob left"), (4, "user bob left 9")]
    structured, catalog = mine.mine_scalable(spark.createDataFrame(rows, "LineId long, content string"))
    assert {r["EventTemplate"]: r["Occurrences"] for r in catalog.collect()}["took <*> ms"] == 2
    assert structured.count() == 4


def test_attach_defaults(spark):
    lines = spark.createDataFrame([("a",), ("b",)], "content string")
    ids = spark.createDataFrame([("a", 0)], "content string, EventId int")
    cat = spark.createDataFrame([(0, "a")], "EventId int, EventTemplate string")
    assert sorted(map(tuple, output.attach(lines, ids, cat).select("content", "EventId", "EventTemplate").collect())) == [("a", 0, "a"), ("b", -1, "")]


def test_stream(spark, tmp_path):
    from logloom.streaming.mine import mine_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("took 1 ms\nhello\n")
    (src / "2.txt").write_text("took 2 ms\ntook 3 ms\n")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src))
    q, miner = mine_stream(lines, str(tmp_path / "cat"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r["template"]: r["lines"] for r in miner.catalog().collect()}
    assert got == {"took <*> ms": 3, "hello": 1}
    batch = spark.createDataFrame([("hello",)], "value string")
    miner(batch, 1)
    miner(batch, 1)  # the same batch again writes the same version
    assert len(miner._versions()) == 2


def test_stream_version_holds_its_batch(spark, tmp_path):
    """Each version was a whole catalog, written anew for each batch."""
    from logloom.streaming.mine import StreamMiner

    miner = StreamMiner(spark, str(tmp_path / "cat"))
    for k, said in enumerate((["took 1 ms", "hello"], ["took 2 ms", "bye"], ["hello", "hello"])):
        miner(spark.createDataFrame([(x,) for x in said], "value string"), k)
    assert [spark.read.parquet(f"{miner.path}/v={k}").count() for k in range(3)] == [2, 2, 1]
    assert sorted(map(tuple, miner.catalog().collect())) == [("bye", 1, 1), ("hello", 0, 3), ("took <*> ms", 0, 2)]
    assert sorted(map(tuple, miner.catalog(before=1).collect())) == [("hello", 0, 1), ("took <*> ms", 0, 1)]


def test_first_stream_batch_meets_no_catalog(spark, tmp_path, monkeypatch):
    """Its lines were counted, checkpointed and matched against nothing."""
    from logloom.streaming import mine as stream

    met, join = [], stream.match_join
    monkeypatch.setattr(stream, "match_join", lambda *of: met.append(of) or join(*of))
    miner = stream.StreamMiner(spark, str(tmp_path / "cat"), merge=False)
    for k, said in enumerate((["took 1 ms", "took 2 ms", " "], ["took 3 ms", "bye"])):
        miner(spark.createDataFrame([(x,) for x in said], "value string"), k)
        assert len(met) == k
    assert sorted(map(tuple, miner.catalog(before=1).collect())) == [("took <*> ms", 0, 2)]
    assert sorted(map(tuple, miner.catalog().collect())) == [("bye", 1, 1), ("took <*> ms", 0, 3)]


def test_entry_has_sql_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "mask_template_counts" in e.oracle_sql()


def test_read_log_over_many_splits(spark, tmp_path):
    rows = [f"[t{k}] p - {'bad' if k % 7 == 0 else 'm'} {k}" if k % 5 else "no header" for k in range(2000)]
    (tmp_path / "a.log").write_text("\n".join(rows[:1500]) + "\n")
    (tmp_path / "b.log").write_text("\n".join(rows[1500:]) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = [(r["LineId"], r["Time"]) for r in logs.read_log(spark, str(tmp_path), formats.FORMATS["Proxifier"]).orderBy("LineId").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == list(enumerate((f"t{k}" for k in range(2000) if k % 5), 1))


def test_match_join_of_templates_without_literal_ends(spark):
    lines = spark.createDataFrame([("a open x",), ("b open",), ("1-2",), ("1:2",), ("zzz",), ("a open x - y",)], "content string")
    templates = spark.createDataFrame([("<*> open <*>",), ("<*>-<*>",), ("<*>open",)], "template string")
    hits = match.match_join(lines, templates)
    got = {r["content"]: r["template"] for r in hits.collect()}
    assert got == {"a open x": "<*> open <*>", "b open": "<*>open", "1-2": "<*>-<*>", "a open x - y": "<*> open <*>"}
    every = spark.createDataFrame([("<*>",)], "template string")
    assert match.match_join(lines, every).count() == 6
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_read_their_rows_once(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 p", "id % 14 g").write.parquet(str(tmp_path / "t"))
    pairs = spark.read.parquet(str(tmp_path / "t"))
    plan = evaluate.scores(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower() and "Join" not in plan  # only the counts, from a checkpoint
