import random

import duckdb
import pytest

from logloom.llm import licenses


def brute(text):
    words, w = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    places = [(k, n) for p, n in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def spans(text):
    """(labels, score) by going through the votes of each template by hand."""
    words = brute_words(text)
    labels, best = set(), 0.0
    for phrase, label, base in [(p, n, True) for p, n in licenses.BASE] + [(p, n, False) for p, n in licenses.SENTENCES]:
        t = phrase.split(" ")
        hits = sorted((i - k, k) for k in range(len(t) - 1) for i in range(len(words) - 1) if words[i : i + 2] == t[k : k + 2])
        runs = []
        for diag, k in hits:
            if not runs or diag - runs[-1][-1][0] > (0 if base else licenses.SLACK):
                runs.append([])
            runs[-1].append((diag, k))
        for run in runs:
            votes = {d: sum(x == d for x, _ in run) for d, _ in run}
            main = min(votes, key=lambda d: (-votes[d], d))
            at = {}
            for d, k in sorted(run, key=lambda x: (abs(x[0] - main), x[0])):
                at.setdefault(k, d + k)
            held = [pos for k, pos in sorted(at.items()) if all(pos > p for j, p in at.items() if j < k)]
            n, pairs = len(held), len(t) - 1
            if n == pairs if base else n >= licenses.COVER * pairs and held[-1] - held[0] + 1 <= pairs + 2 * licenses.SLACK:
                labels.add(label)
                best = max(best, n / pairs)
    return ",".join(sorted(labels)), best


def brute_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join("\x01" if c.isascii() and not c.isalnum() else c for c in lower).split("\x01") if w]


def test_scan_against_brute_force_and_sql(spark):
    rng = random.Random(1)
    parts = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "é", "CC-BY", "x1", "licensed under the", "licensed", "under", "nc", "4 0", "Apache License, Version 2.0", "MIT", "cc by nc 4 0", "\n", "released under the"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(150)] + [None, "", "...", "all rights reserved", "cc by " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'q' t", "1 rid", "2 words", "3 label")
    got = {r["id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute(t)
        assert set(filter(None, got[k]["base_labels"].split(","))) <= set(got[k]["labels"].split(","))
        assert (got[k]["labels"], got[k]["score"]) == spans(t)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = {r[0]: r for r in c.execute(f"SELECT {', '.join(cols)} FROM ({licenses.oracle_sql()})").fetchall()}
    for k, r in got.items():
        assert (k, *(r[c] for c in cols[1:])) == want[k]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("released under (the) MIT license", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("licensed under the quite new apache license version 2.0", "apache-2.0"),
        ("nothing under the sun", ""),
        # a phrase that is repeated is no other phrase
        ("cc by cc by cc by cc by cc by", "cc-by"),
        ("licensed under licensed under licensed under licensed under", ""),
        ("under the licensed under the licensed under the license apache apache license", ""),
        ("cc by cc by licensed under cc by nc 4 0", "cc-by,cc-by-nc"),
        ("Copyright (c) X\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "isc"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "gpl"),
    ],
)
def test_sentences(spark, text, labels):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(docs).first()["labels"] == labels


def test_equal_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "all rights reserved"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_base"] for r in licenses.scan(docs).collect()) == [0, 1, 1, 1]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
