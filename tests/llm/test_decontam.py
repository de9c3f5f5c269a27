import random
import time

import pytest

from logloom.llm import decontam

ITEM = "Alice bought 12 apples for 5 dollars and gave Bob 3 apples. Then Alice sold 12 pears to Bob for 5 dollars."


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"Some words before. {ITEM} And after.", True),
        (f"some words before {ITEM.upper()}", True),
        ("So. Carol bought 17 apples for 9 euros and gave Dan 4 apples. Then Carol sold 17 pears to Dan for 9 euros. Good", True),  # all slots exchanged alike
        ("So. Carol bought 17 apples for 9 euros and gave Dan 4 apples. Then Paula sold 33 pears to Fred for 2 cents. Good", False),  # slots disagree
        ("Alice bought 12 apples for 5 dollars and left.", False),  # a part only
        ("Then Bob went home with pears, for apples he gave Alice.", False),
        ("", False),
        ("12 5 3 12 5", False),
    ],
)
def test_template_hits(text, found):
    b = decontam.Benchmark.of([7], [ITEM], decontam.WIDTH)
    assert bool(b.hits(text, decontam.COVER, 0.9)) is found


def test_short_items():
    b = decontam.Benchmark.of([1, 2, 3], ["red green", ITEM, "..."], decontam.WIDTH)
    assert [k for k, *_ in b.hits("a red green thing", 0.8, 0.8)] == [0]
    assert b.hits("green red", 0.8, 0.8) == []


def test_flag_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(3, 60)))) for k in range(40)]
    docs, truth = [], {}
    for k in range(200):
        text = rng.choices(words, k=rng.randrange(1, 200))
        put = rng.sample(items, rng.choice([0, 0, 0, 1, 2]))
        for _, t in put:
            text = text + t.split() if rng.random() < 0.5 else t.split() + text  # whole passages: none splits another
        docs.append((k, " ".join(text)))
        truth[k] = {i for i, t in items if f" {t} " in f" {' '.join(text)} "}
    docs += [(500, None), (501, ""), (500, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 Bench_Items", "'x' item_id", "2 contaminated")
    b = spark.createDataFrame([*items, (90, None), (None, "")], "item_id long, text string")
    for block in (decontam.BLOCK_WINDOWS, 600):
        got = [(r["doc_id"], set(r["bench_items"]), r["contaminated"]) for r in decontam.flag(d, b, block_windows=block).collect()]
        assert len(got) == len(docs)
        assert all(found == truth.get(k, set()) for k, found, _ in got)
        assert all(bool(found) == hit for _, found, hit in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontam.flag(d, b).collect()] == [False]
    assert decontam.flag(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).count() == 0


SERIES = "What is the next number in the series 2, 4, 6, 8, 10, 12, 14, 16?"


@pytest.mark.parametrize(
    ("item", "text", "found"),
    [
        (SERIES, f"Some text. {SERIES} More text.", True),
        (SERIES, f"Some text with 1 3 5 7 in it. {SERIES} And 7 8 9 10.", True),
        (SERIES, "So what is the next number in the series 3, 5, 7, 9, 11, 13, 15, 17?", True),  # all exchanged
        ("Find the mean and median of these values: 3 5 7 9 11 13 15 17 19 21", "First find the mean and median of these values: 3 5 7 9 11 13 15 17 19 21 now", True),
        ("Who Wrote The Old Book About Green Rivers And Long Summer Nights", "Asked: Who Wrote The Old Book About Green Rivers And Long Summer Nights", True),
        ("Who Wrote The Old Book About Green Rivers And Long Summer Nights", "we ask who wrote the old book about green rivers and long summer nights", True),
        ("alice bought apples in paris and gave bob pears from london", "Then Alice bought apples in Paris and gave Bob pears from London.", True),
        ("2 4 6 8 10 12 14 16", "numbers 2 4 6 8 10 12 14 16 here", True),
        ("2 4 6 8 10 12 14 16", "numbers 3 5 7 9 11 13 15 17 here", False),  # no word, other numbers
        (f"{ITEM} Now tell how many pears she has left in the end.", f"Now. {ITEM.replace('sold', 'quickly sold')} Now tell how many pears she has left in the end.", True),  # a word put in
    ],
)
def test_runs_of_placeholders_and_capitals(item, text, found):
    b = decontam.Benchmark.of([7], [item], decontam.WIDTH)
    assert bool(b.hits(text, decontam.COVER, decontam.AGREE)) is found


SHORT = "Which green river runs past the old stone mill before it meets the grey northern sea"


@pytest.mark.parametrize(
    ("item", "text", "found"),
    [
        (SHORT, f"Well. {SHORT.replace('stone', 'wooden')} now", True),  # one word exchanged inside
        (SHORT, f"Well. {SHORT.replace('stone ', '')} now", True),  # one left out
        (SHORT, f"Well. {SHORT.replace('stone', 'wooden').replace('grey', 'cold')} now", True),
        (SHORT, "Well. Which green river runs past the new town and then the grey hills of the northern sea", False),
        (SHORT, " ".join(reversed(SHORT.split())), False),
        # every slot stands once: words and shape decide
        ("What is the distance in km between Paris and Rome?", "Tell me what is the distance in km between Oslo and Bergen?", True),
    ],
)
def test_edits_of_short_items(item, text, found):
    b = decontam.Benchmark.of([7], [item], decontam.WIDTH)
    assert bool(b.hits(text, decontam.COVER, decontam.AGREE)) is found


@pytest.mark.parametrize("kind", ["other", "same", "within", "zeros", "bits", "words"])
def test_tables_of_numbers_take_no_time(kind):
    rng = random.Random(7)
    item = [str(rng.randrange(10**6)) for _ in range(10_000)]
    text = {"other": [str(rng.randrange(10**6)) for _ in range(10_000)], "same": item, "within": [*map(str, range(9_000)), *item, *map(str, range(9_000))], "zeros": ["0"] * 20_000, "bits": [str(rng.randrange(2)) for _ in range(20_000)], "words": ["to", "be"] * 10_000}[kind]
    if kind == "zeros":
        item = ["0"] * 10_000
    if kind == "words":
        item = ["to", "be"] * 5_000
    b = decontam.Benchmark.of([7], [" ".join(item)], decontam.WIDTH)
    began = time.perf_counter()
    found = b.hits(" ".join(text), decontam.COVER, decontam.AGREE)
    assert time.perf_counter() - began < 4  # seconds; pairs of windows would be 100 million
    assert bool(found) is (kind not in ("other", "bits"))
