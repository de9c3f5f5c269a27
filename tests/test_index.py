"""Index candidates, by both ways, against the miner's own index."""

import random

import pytest

from logloom.operators import index
from logloom.operators.mine import Index


def brute(queries, templates, k, least):
    own = Index()
    for tid, t in templates:
        if t is not None and tid is not None:
            own.put(tid, t)
    return sorted((q, tid, score, rank) for q, t in queries if t is not None and q is not None for rank, (tid, score) in enumerate([x for x in own.query(t, 10**6) if x[1] >= least][:k], 1))


@pytest.mark.parametrize("most_sent", [index.MAX_SENT, 0])
@pytest.mark.parametrize("k, least", [(3, 0.5), (50, 0.2)])
def test_candidates_equal_the_plain_index(spark, most_sent, k, least):
    rnd = random.Random(k)
    words = ["open", "file", "error", "disk", "Übung", "a.b", "7", "<*>", "user", "x", "the", "the"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    templates = [(i, say(rnd.randint(0, 9))) for i in range(200)] + [(200, None), (201, ""), (202, "7 <*>")]
    queries = [(i, say(rnd.randint(0, 9))) for i in range(30)] + [(30, None), (31, "<*>"), (None, "open file")]
    t = spark.createDataFrame([(*r, "q") for r in templates], "tid long, template string, qid string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in queries], "qid long, template string, token int")
    got = [tuple(r) for r in index.candidates(q, t, k=k, least=least, most_sent=most_sent).collect()]
    assert sorted(got) == brute(queries, templates, k, least)


def test_postings_are_counted_without_a_shuffle_of_ids(spark):
    """Ids may be whole texts; shuffled for each token they filled the disk."""
    rnd = random.Random(3)
    words = ["open", "Übung", "a.b", "7", "x1", "<*>", "<*", "of", "the", "the", "日本", "n_m", "y-z", "½", "a/", ","]
    texts = {rnd.choice(["", " ", "\n", "("]).join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(300)}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "template string")
    got = index.postings(df, "template", "template")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((t, x, n) for x in texts for t, n in Index.split(x).items())


def test_empty(spark):
    t = spark.createDataFrame([(1, "open file")], "tid int, template string")
    q = t.withColumnRenamed("tid", "qid")
    assert index.candidates(q.limit(0), t).count() == 0 and index.candidates(q, t.limit(0)).count() == 0


@pytest.mark.parametrize("compacted", [(), (1,), (0, 2, 3)])
def test_versions_equal_an_index_built_anew(spark, tmp_path, compacted):
    """Deltas with changed, removed and returning ids; reads of older versions too."""
    rnd = random.Random(len(compacted))
    words = ["open", "file", "error", "a.b", "<*>", "x"]
    store, now, states = index.IndexStore(spark, str(tmp_path / "i")), {}, []
    assert store.postings().count() == 0
    for v in range(4):
        changes = {str(rnd.randrange(30)): rnd.choice([None, "", " ".join(rnd.choices(words, k=4))]) for _ in range(15)}
        now |= changes
        states.append(dict(now))
        df = spark.createDataFrame([*changes.items()], "tid string, template string")
        store.add(v, df)
        store.add(v, df)  # a version that runs again replaces itself
        if v in compacted:
            store.compact()
            store.compact()
    for v, state in enumerate(states):
        want = {(t, tid, n) for tid, x in state.items() if x is not None for t, n in Index.split(x).items()}
        assert {(r["token"], r["tid"], r["tf"]) for r in store.postings(v).collect()} == want
    assert store.postings().count() == len(want)
