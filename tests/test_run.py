"""Whole runs on small files."""

from logloom.plans import run
from logloom.sources import tables


def test_parse_writes_both_tables(spark, tmp_path):
    (tmp_path / "p.log").write_text("[t1] chrome - open 12 times\nbroken\n[t2] chrome - open 3 times\n[t3] edge - closed\n")
    structured, catalog = run.parse(spark, "Proxifier", str(tmp_path / "p.log"), str(tmp_path / "out"))
    assert [r["EventTemplate"] for r in structured.orderBy("LineId").collect()] == ["open <*> times", "open <*> times", "closed"]
    back = tables.read_csv(spark, str(tmp_path / "out/Proxifier_templates.csv"), tables.MINED).orderBy("EventId").collect()
    assert [tuple(r) for r in back] == [(0, "open <*> times", 2), (1, "closed", 1)]
    assert run.parse(spark, "Proxifier", str(tmp_path / "p.log"), scalable=True)[1].count() == 2


def test_score_all_datasets(spark, tmp_path):
    for side, ids, templates in (("truth", "1,E1\n2,E1\n3,E2\n4,\n", 'E1,"took <*> ms"\nE2,"say ""<*>"""\n'), ("mined", "1,0\n2,0\n3,1\n4,1\n", "0,took <*>\n1,say <*>\n")):
        (tmp_path / side).mkdir()
        for d in ("A", "B"):
            (tmp_path / side / f"{d}_ids.csv").write_text("LineId,EventId\n" + (ids if d == "A" else ids.replace("2,0", "2,1")))
            (tmp_path / side / f"{d}_templates.csv").write_text("EventId,EventTemplate\n" + templates)
    got = run.score(spark, str(tmp_path / "truth"), str(tmp_path / "mined"), ["A", "B"])
    assert {r["Dataset"]: (r["GA"], r["PA"]) for r in got.collect()} == {"A": (1.0, 1.0), "B": (0.0, 0.0)}
    tables.write_scores(got, ["A", "B"], str(tmp_path / "scores"))


def test_progress_listener(spark):
    spark.streams.addListener(p := run.Progress())
    spark.streams.removeListener(p)
