import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from logloom.llm import vectors
from logloom.llm.common import checkpoint, local_components


def brute(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    lab = local_components(len(ids), i, j)
    return {a: (int(n), ids[c]) for a, n, c in zip(ids, hit.sum(axis=1), lab, strict=True)}


def data(seed, groups, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for m, noise in groups:
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        rows += [base + rng.standard_normal(dim) * noise / np.sqrt(dim) for _ in range(m)]
    return np.array(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    x = data(seed, [(1, 0.0)] * 150 + [(3, 0.2)] * 20 + [(60, 0.15)] + [(40, 0.28)])
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    want = brute(ids, x, 0.95)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.97 * there
    assert sum(got[i] == want[i] for i in ids) >= 0.97 * len(ids)


def members(spark, x, root, w=None):
    rows = [(k, 1 if w is None else w[k], bytearray(np.asarray(v, dtype="<f8").tobytes()), r) for k, (v, r) in enumerate(zip(x, root, strict=True))]
    return spark.createDataFrame(rows, "id long, w long, v binary, root long")


def test_blocks_count_exactly(spark):
    x = data(5, [(90, 0.12), (70, 0.3), (2, 0.01)])
    ids = list(range(len(x)))
    root = [0] * 90 + [90] * 70 + [160] * 2
    w = [1 + k % 3 for k in ids]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: sum(w[j] for j in ids if root[j] == root[i] and (i == j or u[i] @ u[j] >= 0.95)) for i in ids}
    for block in (16, 1024):
        assert {r["id"]: r["n"] for r in vectors.exact_links(members(spark, x, root, w), 0.95, "<f8", block).collect()} == want


def test_edge_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (10, [1e-300, 1e-301]), (11, [1e300, 1e299])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 id", "2 component_id", "'v' v")
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False)
    assert by[10] == (3, 1, False) and by[11] == (3, 1, False)
    assert all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9))
    assert by[None] == (0, None, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_component_without_a_centre(spark):
    t = np.linspace(0, 2 * np.pi, 41)[:-1]  # a ring: neighbours link, the sum is zero
    x = np.stack([np.cos(t), np.sin(t)], axis=1)
    got = {r["id"]: r["n"] for r in vectors.exact_links(members(spark, x, [0] * 40), 0.95, "<f8", 8).collect()}
    assert got == {k: 5 for k in range(40)}
    exact = members(spark, [[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]], [0] * 4)
    assert {r["id"]: r["n"] for r in vectors.exact_links(exact, 0.95, "<f8", 2).collect()} == dict.fromkeys(range(4), 2)


@pytest.mark.parametrize("parts", [1, 4, 25])
def test_windows_reach_over_partitions(spark, parts):
    x = data(9, [(60, 0.05)])  # every two link
    keyed = checkpoint(vectors.with_keys(members(spark, x, [0] * 60), [7], "<f8"))
    for window in (1, 7):  # with a window of one, only neighbours
        links = vectors.one_pass(keyed, 0, 0.95, window, "<f8", parts).collect()
        label = local_components(60, np.array([r["u"] for r in links]), np.array([r["v"] for r in links]))
        assert (label == 0).all()


def test_near_pairs():
    x = vectors.unit(data(2, [(30, 0.2), (40, 0.3), (1, 0.0)]).astype(np.float32))
    hit = np.triu(x @ x.T >= 0.95, 1)
    i, j = vectors.near_pairs(x, 0.95, len(x), span=16)
    assert (np.sort(i * 1000 + j) == np.sort(np.nonzero(hit)[0] * 1000 + np.nonzero(hit)[1])).all()


def planted(n, pairs, hot, dim=64):
    """Unit vectors, a third around one centre if hot; vector k and k + pairs have a cosine of 0.955."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((pairs, dim))
    z -= (z * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    share, c = (0.85, np.sqrt(0.7)) if hot else (0.955, 0.0)
    x[pairs : 2 * pairs] = share * x[:pairs] + np.sqrt(1 - share**2) * z
    if hot:
        centre = rng.standard_normal(dim)
        m = max(n // 3, 2 * pairs)
        x[:m] = c * centre / np.linalg.norm(centre) + np.sqrt(1 - c * c) * x[:m]
    return x


@pytest.mark.parametrize("hot", [False, True])
def test_recall_of_isolated_pairs(spark, tmp_path, hot):
    n, pairs = 12_000, 1_000
    x = planted(n, pairs, hot).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    got = {r["id"]: r for r in vectors.near_duplicates(df).collect()}
    u = vectors.unit(x)
    near = np.flatnonzero(np.einsum("ij,ij->i", u[:pairs], u[pairs : 2 * pairs]) >= 0.95).tolist()
    found = sum(got[k]["component_id"] == got[k + pairs]["component_id"] for k in near)
    assert len(near) > pairs / 2 and found >= 0.95 * len(near)


def test_many_equal_vectors_count_as_one(spark):
    x = data(4, [(1, 0.0)] * 20 + [(12, 0.2)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[20].tolist()) for k in range(700)] + [(2000 + k, x[3].tolist()) for k in range(5)]
    ids, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert got == brute(ids, y, 0.95)
