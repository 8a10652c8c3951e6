from __future__ import annotations

import hashlib

import pytest

from larder.llm import bpe

TRICKY = [
    "", " ", "\n\n\nx", "a  b   c\t\t d\n", "it's they'll we've I'd 're 've" * 9, "x" * 400, "'" * 90 + "ll" * 40,
    "   " * 60 + "end", "日本語" * 60 + "  　 " + "é" * 70, "a\x1cb \x1c c", "1234567890" * 30, "\U0001F600" * 50 + "! ?",
    "word " * 100 + "\n\n" + "tail  ",
]


@pytest.mark.parametrize("chunk,overlap", [(16, 6), (40, 16), (64, 64)])
def test_overlapping_chunks_give_the_ids_of_the_whole_text(make_docs, chunk, overlap):
    whole = bpe._encodings()[0]
    df = make_docs(list(enumerate(TRICKY)))
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {k: whole.encode_ordinary(t) for k, t in enumerate(TRICKY)}


def test_random_texts_are_stitched_where_boundaries_meet(rng):
    whole = bpe._encodings()[0]
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "'", "l", "7", "!", "é", "語"]) for _ in range(rng.randint(20, 160)))
        chunk, overlap = rng.randint(5, 30), rng.randint(3, 20)
        if len(text) <= chunk:
            continue
        chunks = [text[k:k + chunk + overlap] for k in range(0, len(text), chunk)]
        ends = [bpe.boundaries(c) for c in chunks]
        heads = [[p for p in e if p <= overlap] for e in ends]
        tails = [[p - chunk for p in e if chunk < p <= len(c) - bpe.UNSURE] for c, e in zip(chunks, ends)]
        pieces = bpe.stitch(chunks, heads, tails, chunk, overlap)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in bpe.encode_text(p)] == whole.encode_ordinary(text)


def test_decoding_is_an_exact_round_trip(odd_docs):
    decoded = sorted((r["doc_id"] or 0, bytes(r["text"])) for r in bpe.decode(bpe.encode(odd_docs)).collect())
    assert decoded == sorted((r["doc_id"] or 0, (r["text"] or "").encode()) for r in odd_docs.collect())


def test_digests(documents):
    df, pairs = documents
    whole = bpe._encodings()[0]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(
        (i, len(ids := whole.encode_ordinary(t)), digest(" ".join(map(str, ids)).encode()), digest(t.encode())) for i, t in pairs
    )
    assert sorted(map(tuple, bpe.encode(df, digests=True).collect())) == want


def test_empty_table(no_docs):
    assert bpe.encode(no_docs).count() == 0
