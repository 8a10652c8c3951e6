from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import packing


def check(rows, pairs, capacity):
    ids = defaultdict(list)
    for i, t in pairs:
        ids[i].append(np.array([*packing._tokenizer().encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    cut, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        cut[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for i, xs in ids.items():
        want = sorted((s, len(p), zlib.crc32(p.tobytes()), len(x)) for x in xs for s in range(0, len(x), capacity) for p in [x[s:s + capacity]])
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in cut[i]) == want
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_each_id_lies_in_one_piece_of_one_sequence(documents, odd_docs):
    df, pairs = documents
    check(packing.pack(df).collect(), pairs, packing.CAPACITY)
    check(packing.pack(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()], packing.CAPACITY)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=5), st.integers(20, 30))
def test_a_window_is_as_full_as_any_subset_allows(counts, capacity):
    seed = max(counts)
    rest = [k for k, n in counts.items() for _ in range(n - (k == seed))]
    best = max(sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if seed + sum(c) <= capacity)
    taken = packing.fullest(counts, seed, capacity)
    assert sum(k * n for k, n in taken.items()) == seed + best
    assert taken[seed] >= 1 and all(n <= counts[k] for k, n in taken.items())


def least_sequences(counts):
    """No plan needs fewer: pieces over half a sequence can't share one, and what is beside them is too little."""
    best = -(-sum(k * n for k, n in counts.items()) // 1024)
    for small in range(1, 513):
        alone = sum(n for k, n in counts.items() if k > 1024 - small)
        large = {k: n for k, n in counts.items() if 512 < k <= 1024 - small}
        rest = sum(k * n for k, n in counts.items() if small <= k <= 512) - sum((1024 - k) * n for k, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-rest // 1024)))
    return best


@pytest.mark.parametrize("seed,kind", [(3, "even"), (4, "even"), (5, "short"), (6, "long"), (7, "few")])
def test_the_plan_uses_all_counts_and_few_sequences(seed, kind):
    rng = np.random.default_rng(seed)
    lengths = {
        "even": lambda: rng.integers(1, 1024, 200_000), "short": lambda: 1 + rng.geometric(0.01, 200_000) % 1023,
        "long": lambda: 1024 - rng.geometric(0.01, 200_000) % 1000, "few": lambda: rng.choice([128, 256, 384, 512, 640], 50_000),
    }[kind]()
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    windows = packing.plan(counts)
    used = defaultdict(int)
    for times, taken in windows:
        assert sum(k * n for k, n in taken.items()) <= 1024
        for k, n in taken.items():
            used[k] += n * times
    assert used == counts
    least = least_sequences(counts)
    assert least <= sum(t for t, _ in windows) <= least * 1.001 + 1 and len(windows) < 5000


@pytest.mark.parametrize("text", ["<|endoftext|> a", "日本 語", "x y", "ɐ", "a\x1cb", "é ü", "‘q’ “r” €"])
def test_ids_are_those_of_the_tokenizers_library(text):
    assert packing.token_ids(text) == packing._tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_the_faster_encoder_agrees_on_latin_text(text):
    assert packing.token_ids(text) == packing._tokenizer().encode(text, add_special_tokens=False).ids
