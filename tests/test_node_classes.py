"""Classes shared along beginnings of templates, against the prefix tree itself."""

import random

from logloom.functions.align import WILD, chars
from logloom.operators import match
from logloom.operators.match import Entry
from logloom.operators.trie import Trie


def held(trie, template):
    """The classes of a template's wildcards along its way through the tree."""
    edge, symbols, out = trie.root, chars(template), []
    while symbols:
        edge = edge.after[symbols[0]]
        assert edge.label == symbols[: len(edge.label)]
        symbols = symbols[len(edge.label) :]
        out += edge.classes
    return [sorted(c) for c in out]


def test_equal_to_the_tree(spark):
    rnd = random.Random(2)
    kinds = ["digit", "alpha", " ", "-", "."]
    entries = []
    for k in range(150):
        t = "".join(rnd.choice(["a", "ab", " ", WILD, "b", WILD, "-"]) for _ in range(rnd.randint(1, 6)))
        entries.append(Entry(k, t, [set(rnd.sample(kinds, rnd.randint(1, 2))) for c in chars(t) if c == WILD]))
    entries += [Entry(150, "<*> <*>", [{"digit"}, {"digit"}]), Entry(151, "a", [])]
    trie = Trie(entries)
    df = spark.createDataFrame([(e.template, [sorted(c) for c in e.classes]) for e in entries], "template string, classes array<array<string>>")
    got = {(r["template"], r["slot"]): r["classes"] for r in match.node_class_union(df).collect()}
    want = {(e.template, k): c for e in entries if e.template.strip("<>* ") for k, c in enumerate(held(trie, e.template))}
    assert got == want and len(want) > 100
