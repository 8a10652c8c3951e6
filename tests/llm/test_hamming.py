from __future__ import annotations

import itertools

import numpy as np

from larder.llm import hamming
from tests.llm.test_jaccard import brute, rows


def test_all_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    for errors in (0, 1, 2):
        most = hamming.CHUNKS * (errors + 1) - 1
        one = rng.integers(0, 256, (300, hamming.PLACES), np.uint8)
        other = one.copy()
        for row in other:
            at = rng.permutation(hamming.PLACES)[:most]
            row[at] ^= rng.integers(1, 256, most, np.uint8)
        shared = hamming.keys(one, errors) == hamming.keys(other, errors)
        assert shared.any(1).all()
        different = [len(set(row)) for row in hamming.keys(one, errors)]
        assert set(different) == {hamming.CHUNKS * len(hamming.left_out(errors))}
    assert hamming.allowed_errors(80) == 2 and hamming.allowed_errors(100) == 0


def test_signatures_agree_as_often_as_sets_do(rng):
    x = np.unique(np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64))
    agree = [(hamming.signatures([np.sort(x[k:k + 900])])[0] == hamming.signatures([np.sort(x[k + 45:k + 945])])[0]).mean() for k in range(0, 55, 5)]
    assert abs(np.mean(agree) - 855 / 945) < 0.05


def test_components_match_brute_force(documents, odd_docs):
    df, pairs = documents
    assert rows(hamming.join(df)) == brute(pairs, 2, 80)
    got = hamming.near_copies(odd_docs)
    assert rows(got.drop("kept")) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_a_large_group_in_blocks(make_docs, no_docs, rng, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 7)
    pairs = []
    for base in range(3):
        words = [f"w{base}_{rng.randint(0, 400)}" for _ in range(60)]
        for _ in range(60):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6))):
                copy[rng.randint(0, len(copy) - 1)] = f"x{rng.randint(0, 40)}"
            pairs.append((len(pairs) * 3 + 1, " ".join(copy)))
    pairs += [(1000 + k, "The line that they all share. " + " ".join(f"u{k}_{j}" for j in range(4))) for k in range(30)]
    assert rows(hamming.join(make_docs(pairs))) == brute(pairs, 2, 80)
    assert hamming.join(no_docs).count() == 0


def test_each_pair_of_a_key_comes_once(spark, rng):
    base = np.frombuffer(bytes(range(hamming.PLACES)), np.uint8)
    nodes = []
    for k in range(40):
        row = base.copy()
        row[rng.sample(range(hamming.PLACES), 6)] += np.uint8(1 + k)
        nodes.append((k, 100, bytes(row), bytes(hamming.PARITIES // 8), k))
    table = spark.createDataFrame(nodes, "a long, n int, signature binary, parities binary, root long")
    placed = hamming._postings(table, 2).join(table.select("a", "root"), "a")
    got = [(r["a"], r["b"]) for r in hamming._compared(hamming._blocks(placed, table), 2, 80).collect()]
    assert sorted(got) == list(itertools.combinations(range(40), 2))
