from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from larder.llm import shallot, spectrum, whitening
from larder.llm.queries import STATEMENTS
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, x string, number string"


@pytest.fixture(scope="module")
def make(spark):
    return lambda pairs: spark.createDataFrame([(i, v, 1, "x", "y") for i, v in pairs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors(make):
    """64 entries each, with null and non-finite entries, other lengths, repeated rows and null ids."""
    rng = np.random.default_rng(5)
    pairs = [(k, [float(v) for v in rng.normal(scale=0.2, size=64).astype(np.float32)]) for k in range(150)]
    pairs += [(1000, None), (1001, [None] * 64), (1002, [math.nan] * 64), (1003, [math.inf] + [0.0] * 63), (7, pairs[7][1]), (7, pairs[7][1]), (None, pairs[3][1])]
    return pairs, make(pairs)


@pytest.mark.parametrize("size,count,kind", [(1, 4, "plain"), (8, 60, "plain"), (24, 200, "equal"), (6, 3, "plain"), (16, 100, "signs")])
def test_updates_and_merges_give_the_scatter(size, count, kind):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(count, size)) * np.geomspace(1, 50, size)
    if kind == "equal":
        x = np.round(x)
        x[:, 3:9], x[:, 10] = 0, x[:, 11]
    elif kind == "signs":
        x = np.sign(x)
    parts = []
    for rows in (x[:count // 3], x[count // 3:], x[:0]):
        s = spectrum.empty(size)
        for row in rows:
            s = spectrum.with_vector(s, row)
        parts.append(s)
    both = spectrum.merged(spectrum.merged(parts[2], parts[0]), parts[1])
    want = (x - x.mean(0)).T @ (x - x.mean(0))
    for weight, mean, values, turned in (both, spectrum.merged(both, parts[2])):
        assert weight == count and np.allclose(mean, x.mean(0))
        assert np.allclose(turned @ np.diag(values) @ turned.T, want, atol=1e-11 * np.abs(want).max())
        assert np.allclose(turned.T @ turned, np.eye(size), atol=1e-12) and (np.diff(values) >= 0).all()


def whitened_by_brute_force(pairs):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in pairs if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), [int(v) for v in fit.sum(0)]
    centred = np.array([[(n * int(v) - s) / n for v, s in zip(row, sums)] for row in fit])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    out = {}
    for i, x in kept:
        y = np.array([(n * v - s) / n for v, s in zip(x, sums)])
        out[i] = sum((n * v - s) ** 2 for v, s in zip(x, sums)), (y @ turn[:, order]) / np.sqrt(values[order])
    return n, out, values[order] / values.sum(), len(kept)


@pytest.mark.parametrize("table", ["odd", "whole"])
def test_whitening_matches_brute_force(spark, vectors, table, monkeypatch):
    monkeypatch.setattr(whitening, "VECTORS_PER_TASK", 13)  # many spectra, merged in more than one round
    pairs, df = vectors
    if table == "whole":
        df = spark.read.parquet(f"{SF}/embeddings.parquet")
        pairs = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    n, want, explained, rows = whitened_by_brute_force(pairs)
    got = whitening.whiten(df).collect()
    assert len(got) == rows * 16 and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    ours = defaultdict(dict)
    for r in got:
        ours[r["vec_id"]][r["component"]] = r["whitened"]
        assert r["deviation"] == want[r["vec_id"]][0] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    ids = list(want)
    one, other = np.array([[ours[i][c] for c in range(1, 17)] for i in ids]), np.array([want[i][1] for i in ids])
    signs = np.sign((one * other).sum(0))
    assert np.allclose(one * signs, other, atol=1e-8)


def test_few_short_and_equal_vectors(make):
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [math.nan])])).count() == 0
    assert whitening.whiten(make([(1, []), (2, [])])).count() == 0
    assert whitening.whiten(make([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0  # no variance
    got = whitening.whiten(make([(1, [1.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])])).collect()  # one direction
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == [(1, 1, 3, 192**2), (2, 1, 3, 0), (3, 1, 3, 192**2)]
    assert {round(abs(r["whitened"]), 6) for r in got} == {0.0, round(math.sqrt(1.5), 6)} and got[0]["explained"] == 1
    wide = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert {r["deviation"] for r in wide} == {None}


def clustered_by_brute_force(pairs, size=64, centroids=40, rounds=5):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in pairs if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted(kept, key=lambda p: (p[0] is None, "" if p[0] is None else hashlib.sha256(f"2:{p[0]}".encode()).hexdigest(), p[1]))
    at = [x for _, x in named[:centroids]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for k in range(rounds + 1):
        number = [min(range(len(at)), key=lambda c: (far(x, at[c]), c)) for _, x in kept]
        if k < rounds:
            for c in range(len(at)):
                mine = [x for (_, x), m in zip(kept, number) if m == c]
                if mine:
                    at[c] = [sum(v) // len(mine) for v in zip(*mine)]
    d = [far(x, at[c]) for (_, x), c in zip(kept, number)]
    return sorted([
        (i, c, v, sum(w for w, m in zip(d, number) if m == c), sum(d), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest())
        for (i, _), c, v in zip(kept, number, d)
    ], key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clusters_match_brute_force(vectors, make):
    pairs, df = vectors
    assert rows(shallot.cluster(df)) == clustered_by_brute_force(pairs)
    few = [(k, [float(k % 3), 0.25 * (k % 2)]) for k in range(30)]  # ties and equal centroids
    for centroids in (1, 2, 7, 40):
        assert rows(shallot.cluster(make(few), centroids, 3, size=2)) == clustered_by_brute_force(few, 2, centroids, 3)


def test_search_equals_a_look_at_all_centroids():
    rng = np.random.default_rng(2)
    for k in (1, 2, 9, 40):
        c = shallot.Centroids(rng.integers(-9, 9, (k, 3)).tolist())
        x = rng.integers(-12, 12, (500, 3))
        first, second = rng.integers(0, k, 500), rng.integers(0, k, 500)
        second = np.where(second == first, (first + 1) % k, second)
        best, _, d1, d2 = shallot.search(x, first, second, c)
        far = ((x[:, None] - c.at[None]) ** 2).sum(2)
        assert (best == far.argmin(1)).all() and (d1 == far.min(1)).all()
        if k > 1:
            assert (d2 == np.sort(far, 1)[:, 1]).all()


def test_no_vectors_and_other_sizes(make):
    assert shallot.cluster(make([])).count() == 0
    assert shallot.cluster(make([(1, [1.0] * 63), (2, None)])).count() == 0
    assert rows(shallot.cluster(make([(1, [3e38] * 64), (2, [-3e38] * 64)])))[0][2] == 0


def test_clusters_match_the_statement(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(STATEMENTS["op12_centroid_clustering"]).fetchall(), key=str)
    assert rows(shallot.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"))) == want
