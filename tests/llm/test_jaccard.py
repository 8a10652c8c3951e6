from __future__ import annotations

import re

import pytest

from larder.llm import jaccard


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[k:k + words]) for k in range(len(w) - words + 1)}


def brute(pairs, words, percent):
    sets = [shingles(t, words) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < k}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(pairs)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(documents, odd_docs, words, percent):
    df, pairs = documents
    assert rows(jaccard.join(df, words, percent)) == brute(pairs, words, percent)
    assert rows(jaccard.join(odd_docs, words, percent)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], words, percent)


def test_many_near_copies_of_few_texts(make_docs, rng):
    pairs = []
    for base in range(4):
        words = [f"w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randint(0, len(copy) - 1)] = f"x{rng.randint(0, 9999)}"
            pairs.append((len(pairs) * 3 + 1, " ".join(copy)))
    pairs += [(1000 + k, "License line that all share word for word today. " + " ".join(f"u{k}_{j}" for j in range(12))) for k in range(40)]
    df = make_docs(pairs)
    for words, percent in ((3, 90), (5, 80), (3, 70)):
        assert rows(jaccard.join(df, words, percent)) == brute(pairs, words, percent)


def test_one_row_of_each_component_stays(documents, odd_docs, no_docs):
    df, pairs = documents
    left = jaccard.without_near_copies(df, 5, 80)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, n, c in brute(pairs, 5, 80) if i == c or n == 0)
    assert jaccard.without_near_copies(odd_docs, 5, 80).columns == odd_docs.columns
    assert jaccard.join(no_docs).count() == 0 and jaccard.without_near_copies(no_docs).count() == 0


def test_many_near_copies_below_the_limit_ship_few_pairs(make_docs, rng, monkeypatch):
    words = [f"w{rng.randint(0, 10_000)}" for _ in range(300)]
    pairs = []
    for k in range(400):
        copy = list(words)
        for at in rng.sample(range(300), 3):
            copy[at] = f"x{k}_{at}"
        pairs.append((k + 1, " ".join(copy)))
    shipped = []
    whole = jaccard.written

    def counted(df, name):
        out = whole(df, name)
        if name == "near":
            shipped.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    assert rows(jaccard.join(make_docs(pairs))) == brute(pairs, 3, 90)
    assert sum(shipped) < 10 * len(pairs)


def test_sets_of_any_sizes(make_docs, rng):
    pairs = []
    for base in range(60):
        text = [f"t{base}_{k}" for k in range(rng.randint(1, 14))]
        for _ in range(4):
            copy = [w for w in text if rng.random() > 0.08] + [f"u{rng.randint(0, 3)}"] * rng.randint(0, 1)
            pairs.append((len(pairs), " ".join(copy)))
    for words, percent in ((2, 80), (1, 50), (1, 100)):
        assert rows(jaccard.join(make_docs(pairs), words, percent)) == brute(pairs, words, percent)


def test_paths_become_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 103), (103, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 103: 100}
