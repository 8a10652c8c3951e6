from __future__ import annotations

import hashlib

import pytest

from larder.llm import suffix
from larder.llm.grouping import suffix_arrays


def brute(pairs, length):
    seen, out = set(), []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        data = (t or "").encode()
        spans = []
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                spans.append((s, s + length))
            seen.add(w)
        runs = suffix.merged(spans)
        gone = {k for a, b in runs for k in range(a, b)}
        left = bytes(c for k, c in enumerate(data) if k not in gone)
        out.append((i, len(data), len(gone), len(runs), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_suffix_arrays_sort_suffixes(rng):
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 6)):
            base = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30)))
            texts.append([
                bytes(rng.choice(b"abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 25))) if rng.random() < 0.5
                else base[rng.randint(0, len(base) - 1):] + base for _ in range(rng.randint(1, 4))
            ])
        symbols, first, order = suffix_arrays(texts)
        for k, parts in enumerate(texts):
            a, b = first[k], first[k + 1] if k + 1 < len(first) else len(symbols)
            text = list(symbols[a:b])
            assert [x - a for x in order[a:b]] == sorted(range(len(text)), key=lambda i: text[i:])


def test_documents_match_brute_force(documents, odd_docs):
    df, pairs = documents
    assert rows(suffix.deduplicated(df, digests=True)) == brute(pairs, suffix.LENGTH)
    assert rows(suffix.deduplicated(odd_docs, digests=True)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], suffix.LENGTH)


@pytest.mark.parametrize("most", [2, 12])
def test_short_windows_common_lines_and_periods(make_docs, rng, most):
    line = "a line that very many texts hold"
    pairs = [(k, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 30))) + line + "".join(rng.choice("xy") for _ in range(rng.randint(0, 40)))) for k in range(60)]
    pairs += [(100, "ab" * 40), (101, "ab" * 41 + "c"), (102, "a" * 15), (103, "a" * 60), (104, line[3:] * 3), (105, "x" * 12 + line[:14])]
    assert rows(suffix.deduplicated(make_docs(pairs), 12, 5, most, digests=True)) == brute(pairs, 12)


def test_what_is_left(make_docs, no_docs, rng):
    text = "".join(rng.choice("abcdefgh ") for _ in range(150))
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix.deduplicated(make_docs([(1, text), (2, "head " + text + " tail")])).collect()}
    assert kept == {1: text.encode(), 2: b"head  tail"}
    assert suffix.deduplicated(no_docs).count() == 0


def test_parts_without_a_shared_half_do_not_reach_the_suffix_arrays(rng):
    grams = "one anchor of 24 bytes.."
    random = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    left, right = random(40), random(40)
    texts = [random(76) + grams + random(76) for _ in range(5)]
    texts += [random(36) + left + grams + random(76), random(36) + left + grams + random(76)]  # one half alike, no window
    texts += [random(76 - 40) + left + grams + right + random(20), random(10) + left + grams + right]  # windows alike
    texts += [grams + random(30), grams + right[:20]]  # too short for a window
    parts = [(7, k, k, 0, t.encode(), t.index(grams), -76, 0) for k, t in enumerate(texts)]
    kept = suffix.sharing(parts)
    assert [p[1] for p in kept] == [5, 6, 7, 8]
    found = suffix.repeated_windows([p[:5] for p in parts if len(p[4]) >= suffix.LENGTH])
    assert suffix.repeated_windows([p[:5] for p in kept]) == found and [f[0] for f in found] == [8]
