"""The prefix tree: expected ids by hand, and against regular expressions where the two agree."""

import pickle
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.operators.match import Catalog, Entry, match_catalog
from logloom.operators.trie import Trie

D, A = {"digit"}, {"alpha"}


def trie(*templates):
    return Trie([Entry(k, t, c) for k, (t, c) in enumerate(templates)])


def test_literals_come_before_wildcards():
    t = trie(("job <*> done", [D | A]), ("job 7 done", []), ("job <*>", [D | A]))
    assert [t.match(m) for m in ("job 7 done", "job 8 done", "job 8", "job 8 failed", "job ", "jo")] == [1, 0, 2, -1, -1, -1]


def test_edges_are_cut_and_equal_templates_overwritten():
    t = trie(("abcd", []), ("abce", []), ("ab", []), ("abcd", []), ("x", []))
    assert [t.match(m) for m in ("abcd", "abce", "ab", "abc", "a", "", "x", "xy")] == [3, 1, 2, -1, -1, -1, 4, -1]
    assert list(t.root.after) == ["a", "x"] and t.root.after["a"].label == list("ab")


def test_wildcards_of_a_common_beginning_share_their_classes():
    alone, both = trie(("id <*> up", [D])), trie(("id <*> up", [D]), ("id <*> down", [A]))
    assert [alone.match(m) for m in ("id 1 up", "id a up")] == [0, -1]
    assert [both.match(m) for m in ("id 1 up", "id a up", "id 1 down", "id . up")] == [0, 0, 1, -1]


def test_inner_wildcards_may_be_empty_and_last_ones_not():
    t = trie(("n=<*>;", [D]), ("m=<*>", [D]))
    assert [t.match(m) for m in ("n=;", "n=12;", "m=", "m=1", "m=1;")] == [0, 0, -1, 1, -1]


def test_a_wildcard_inside_an_edge_keeps_its_first_fit():
    """"p <*> q" is one edge: its wildcard ends at the first " q" and is not asked again, though
    the rest, " r", stands after the second. At the beginning of an edge all ends are asked."""
    classes = [A | {" "}]
    inside = trie(("p <*> q r", classes), ("p <*> q s", classes))
    assert [inside.match(m) for m in ("p x q r", "p x q s", "p x q y q r")] == [0, 1, -1]
    begins = trie(("<*> q r", classes), ("<*> q s", classes), ("<*> t", classes))
    assert begins.match("x q y q r") == 0
    assert trie(("p <*> q r", classes)).match("p x q y q r") == 0


def test_a_wildcard_that_ends_a_template_takes_the_whole_rest_first():
    t = trie(("p <*>", [A | {" "}]), ("p x", []), ("p <*> <*>", [A, D]))
    assert [t.match(m) for m in ("p a b", "p a 1", "p x")] == [0, 2, 1]
    # only where it begins an edge: "job 7" cuts the edge there
    either = [("job <*> done", [A]), ("job <*>", [A | {" "}])]
    assert [trie(*either).match("job x done"), trie(*either, ("job 7", [])).match("job x done")] == [0, 1]


def test_templates_without_literal_text_stand_for_their_message():
    t = Trie()
    t.learn(Entry(0, "<*> <*>", [A, A]), "some text")
    t.learn(Entry(1, "<*>", [A]))
    assert [t.match(m) for m in ("some text", "other text", "other")] == [0, -1, -1]


def test_many_wildcards_do_not_multiply():
    t = trie(("<*>" + " a<*>" * 12 + " b", [A | {" "}] * 13))
    begin = time.perf_counter()
    assert t.match(" a" * 300) == -1
    assert time.perf_counter() - begin < 5


def test_long_tries_are_sent_as_entries():
    t = Trie([Entry(k, "x" * k + "y", []) for k in range(3000)])
    back = pickle.loads(pickle.dumps(t))
    assert [back.match("x" * k + "y") for k in (0, 17, 2999, 3000)] == [0, 17, 2999, -1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab1 *", min_size=1, max_size=7), min_size=1, max_size=4, unique=True), st.lists(st.text("ab1 ", max_size=9), max_size=8))
def test_what_it_finds_fits_by_regular_expression(shapes, messages):
    """With the same classes everywhere a found template fits, and one template alone is found where it fits."""
    classes = {"digit", "alpha", " "}
    templates = [s.replace("*", "<*>") for s in dict.fromkeys(shapes) if s.strip("* ") and "**" not in s]
    entries = [Entry(k, t, [classes] * t.count("<*>")) for k, t in enumerate(templates)]
    t, rules = Trie(entries), {e.tid: Catalog([e]) for e in entries}
    for m in messages:
        tid = t.match(m)
        assert tid == -1 or rules[tid].match(m) == tid
        for e in entries:
            alone = Trie([e]).match(m)
            assert alone in (-1, e.tid)
            if alone == e.tid:
                assert rules[e.tid].match(m) == e.tid


def test_on_spark(spark):
    lines = spark.createDataFrame([("id 1 up",), ("id a down",), (None,), ("other",)], "content string")
    got = match_catalog(lines, trie(("id <*> up", [D]), ("id <*> down", [A])))
    assert {r["content"]: r["tid"] for r in got.collect()} == {"id 1 up": 0, "id a down": 1, None: -1, "other": -1}
