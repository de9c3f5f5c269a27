"""Numbers over a stream of log files against reading all files at once."""

import random

from logloom.sources.logs import read_log
from logloom.streaming import lines

FORMAT = "<Level>: <Content>"


def test_numbers_go_on_over_batches(spark, tmp_path):
    rnd = random.Random(1)
    folder = tmp_path / "in"
    for name in ("a", "b"):
        (folder / f"source={name}").mkdir(parents=True)
    for batch in range(3):
        for name in ("a", "b"):
            for k in range(rnd.choice([0, 1, 3]) if batch else 2):
                said = [rnd.choice([f"INFO: {batch} {k} {n}", "no match", "", f"  WARN: {n}  "]) for n in range(rnd.randint(0, 40))]
                (folder / f"source={name}" / f"{batch}-{k}.log").write_text("\n".join(said))
        files = spark.readStream.schema("value string, source string").text(str(folder))
        running, state = lines.number_stream(files, str(tmp_path / "out"), str(tmp_path / "checkpoint"), FORMAT)
        running.awaitTermination()
    got = [tuple(r) for r in state.lines().select("source", "LineId", "Level", "Content").collect()]
    want = [(name, *r) for name in ("a", "b") for r in read_log(spark, f"{folder}/source={name}", FORMAT).select("LineId", "Level", "Content").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    # a batch that runs again writes the same
    again = spark.createDataFrame([("INFO: x", "a", "f", 0), ("INFO: y", "c", "f", 0)], "value string, source string, __file string, __at long")
    before = {r["source"]: r["lines"] for r in state.counts(3).collect()}
    state(again, 3)
    state(again, 3)
    assert {r["source"]: r["lines"] for r in state.counts(4).collect()} == before | {"a": before["a"] + 1, "c": 1}
    assert {(r["source"], r["LineId"]) for r in state.lines().filter("Content in ('x', 'y')").collect()} == {("a", before["a"] + 1), ("c", 1)}
