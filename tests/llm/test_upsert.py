"""Copy-on-write upsert against plain Python over lists, file by file."""

import hashlib
import math
import random
import zlib
from bisect import bisect_right
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest

from logloom.llm import queries, upsert

COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
SETS = ["source", "segment", "city", "balance"]
SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def cut(rows, m):
    k = -(-len(rows) // m)
    q, more = divmod(len(rows), k) if k else (0, 0)
    out, at = [], 0
    for i in range(k):
        out.append(rows[at : at + q + (i < more)])
        at += len(out[-1])
    return out


def expected(clients, changes):
    """[(rows, rewritten)]: the contract, on dicts."""
    m = 1 + len(clients) // 1000
    start = sorted((c for c in clients if crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [start[k : k + m] for k in range(0, len(start), m)]
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    for c in changes:
        if c["client_id"] is not None and (c["client_id"] not in best or (low(c["seq"]), low(c["change_id"])) > (low(best[c["client_id"]]["seq"]), low(best[c["client_id"]]["change_id"]))):
            best[c["client_id"]] = c
    logs = {}
    for i, c in best.items():
        logs.setdefault(max(bisect_right(firsts, i) - 1, 0), {})[i] = c
    pieces = []
    for k, rows in enumerate(files):
        h = crc(firsts[k]) % 16
        new = {r["client_id"]: dict(r) for r in rows}
        for i, c in (logs.get(k, {}) if h <= 7 else {}).items():
            if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
                new.pop(i, None)
            else:
                new.setdefault(i, dict.fromkeys(COLUMNS) | {"client_id": i}).update({s: c[s] for s in SETS})
        done = [new[i] for i in sorted(new)]
        pieces += [(p, True) for p in cut(done, m)] if done != rows else [(rows, False)]
    out = []
    for rows, rewritten in pieces:
        if out and rewritten and out[-1][1] and len(out[-1][0]) + len(rows) <= m:
            out[-1] = (out[-1][0] + rows, True)
        else:
            out.append((rows, rewritten))
    return out


def check(spark, folder, clients, changes):
    spark.createDataFrame([tuple(c[x] for x in COLUMNS) for c in clients], SCHEMA).repartition(3).write.parquet(f"{folder}/clients.parquet")
    names = [f.split()[0] for f in CHANGES.split(", ")]
    spark.createDataFrame([tuple(c[x] for x in names) for c in changes], CHANGES).repartition(3).write.parquet(f"{folder}/client_changes.parquet")
    got = sorted(queries.op12_upsert(spark, str(folder)).collect(), key=lambda r: r["first_id"])
    want = expected(clients, changes)
    text = lambda x: x or ""
    assert [(r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["columns"], r["rewritten"]) for r in got] == [
        (
            rows[0]["client_id"],
            len(rows),
            sum(math.floor(100 * r["balance"] + 0.5) if r["balance"] is not None else 0 for r in rows),
            sum(crc(f"{text(r['source'])}|{text(r['segment'])}|{text(r['city'])}") for r in rows),
            hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest(),
            ",".join(COLUMNS),
            rewritten,
        )
        for rows, rewritten in want
    ]
    if got:
        paths = [urlparse(r["path"]).path for r in got]
        from pathlib import Path

        assert {str(p) for p in Path(paths[0]).parent.glob("*.parquet")} == set(paths)
        for p, (rows, _) in zip(paths, want, strict=True):
            assert pq.read_table(p).to_pylist() == rows
    return want


def made(n, rnd, ids=None):
    ids = list(range(n)) if ids is None else ids
    clients = [dict.fromkeys(COLUMNS) | {"client_id": i, "source": rnd.choice(["web", None, "crm"]), "city": rnd.choice("ABC"), "segment": "s", "balance": rnd.choice([None, 1.005, -2.5, i / 7]), "name": f"n{i}"} for i in ids]
    return clients


def change(k, i, seq, rnd, **more):
    return {"change_id": k, "client_id": i, "seq": seq, "op": rnd.choice(["U", "U", "I", "D", None]), "valid_at": None, "source": rnd.choice(["web", None]), "segment": "t", "city": rnd.choice(["Ü", "B", None]), "balance": rnd.choice([None, 3.25])} | more


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_plain_lists(spark, tmp_path, seed):
    rnd = random.Random(seed)
    clients = made(2500, rnd)
    changes = [change(k, rnd.randint(-20, 2600), rnd.choice([None, 1, 2, 3]), rnd) for k in range(1500)]
    changes += [dict(c) for c in changes[:50]] + [change(None, 5, 9, rnd), change(5000, None, 9, rnd)] + [change(6000 + k, 77, k, rnd) for k in range(800)]
    want = check(spark, tmp_path, clients, changes)
    assert any(r for _, r in want) and any(not r for _, r in want)


def test_deleted_files_and_crowded_homes(spark, tmp_path):
    rnd = random.Random(3)
    clients = made(0, rnd, range(0, 4000, 4))
    changes = [change(k, i, 1, rnd, op="D") for k, i in enumerate(range(0, 2000, 4))] + [change(9000 + i, i, 1, rnd, op="I") for i in range(2000, 2600)]
    check(spark, tmp_path, clients, changes)


def test_empty_tables(spark, tmp_path):
    rnd = random.Random(4)
    check(spark, tmp_path / "a", made(300, rnd), [])
    check(spark, tmp_path / "b", [], [change(1, 1, 1, rnd)])


def test_together():
    assert upsert.together([], 5) == []
    assert upsert.together([(True, 2), (True, 2), (True, 2), (False, 1), (True, 1), (True, 4), (True, 1)], 5) == [0, 0, 1, 2, 3, 3, 4]


def test_other_keys_columns_and_no_changes(spark, tmp_path):
    """A text key, columns named like helpers, and a log that changes nothing."""
    rows = spark.createDataFrame([(f"k{i:03}", i, "x") for i in range(100)], "`the key` string, __n long, __slot string")
    path = str(tmp_path / "t")
    upsert.create(rows, path, "the key", 30)
    same = spark.createDataFrame([("k050", 50, 1)], "`the key` string, __n long, seq long")
    assert upsert.upsert(spark, path, same, "the key", ["seq"], ["__n"], 30)[0] == []
    more = spark.createDataFrame([("k0505", -1, 1), ("k099", None, 2)], "`the key` string, __n long, seq long")
    gone, kept = upsert.upsert(spark, path, more, "the key", ["seq"], ["__n"], 30)
    assert (len(gone), len(kept)) == (2, 2)
    got = {r[0]: (r[1], r[2]) for r in spark.read.parquet(path).collect()}
    assert len(got) == 101 and got["k0505"] == (-1, None) and got["k099"] == (None, "x") and got["k050"] == (50, "x")
