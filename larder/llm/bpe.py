"""Byte-level BPE over overlapping chunks: encode whole texts of any length, and decode ids to bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import arrow_schema, keyed_texts, per_batch

CHUNK = 32_768  #: characters of a chunk
OVERLAP = 512  #: characters that a chunk reads beyond its end
#: The longest alternative of the pattern that starts with an apostrophe has this many characters.
UNSURE = 3
#: White space before the last white space of a run: only there the pattern's look-ahead decides.
_LOOKS_AHEAD = re.compile(r"\s\s(?:\S|[\x1c-\x1f])")


@functools.lru_cache(maxsize=2)
def ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def _encodings(path: str | None = None):
    """The encoding, and one without the look-ahead for texts in which it decides nothing."""
    import tiktoken

    pattern = public_tokenizers.PATTERN
    plain = pattern.replace(r"|\s+(?!\S)", "")
    return tuple(
        tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks(path), special_tokens={})
        for name, p in (("whole", pattern), ("plain", plain))
    )


def encode_text(text: str, path: str | None = None) -> list[int]:
    whole, plain = _encodings(path)
    return (whole if _LOOKS_AHEAD.search(text) else plain).encode_ordinary(text)


def decode_ids(ids: list[int], path: str | None = None) -> bytes:
    return _encodings(path)[0].decode_bytes(ids)


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str) -> list[int]:
    """Where the pre-tokens of a text end."""
    return [m.end() for m in _pattern().finditer(text)]


def stitch(chunks: list[str], heads: list[list[int]], tails: list[list[int]], chunk: int, overlap: int) -> list[str]:
    """Pieces of the text whose pre-tokens, one piece after the other, are those of the whole text.

    Two neighbours are cut where both have a boundary behind a character that is no white space: from
    there on the pattern sees the same characters in both, and no look-ahead reaches over the cut. Where
    the overlap holds no such place they stay one piece, whose boundaries are found anew.
    """
    text = "".join(c[:chunk] for c in chunks[:-1]) + chunks[-1]
    cuts, tail = [0], tails[0]
    for k in range(1, len(chunks)):
        start = k * chunk
        head = {start + p for p in heads[k]}
        cut = next((p for p in (start + q for q in tail) if p in head and not text[p - 1].isspace()), None)
        if cut is not None:
            cuts.append(cut)
            tail = tails[k]
        elif k + 1 < len(chunks):
            end, goal = min(len(text), start + chunk + overlap), start + chunk
            ends = [cuts[-1] + p for p in boundaries(text[cuts[-1]:end])]
            tail = [p - goal for p in ends if goal < p <= (end - UNSURE if end < len(text) else end)]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _digest(ids: list[int], path: str | None) -> tuple[int, str, str]:
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(decode_ids(ids, path)).hexdigest(),
    )


def _long_pieces(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, place, piece list) of texts with more than one chunk: chunks are split in parallel, then stitched."""
    count = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    chunks = texts.select(
        "row", "doc_id",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda k: F.substring("text", k * F.lit(chunk) + F.lit(1), F.lit(chunk + overlap)),
        )).alias("place", "chunk"),
    )

    def split(batch):
        heads, tails = [], []
        for text in batch["chunk"].to_pylist():
            ends = boundaries(text)
            heads.append([p for p in ends if p <= overlap])
            tails.append([p - chunk for p in ends if chunk < p <= len(text) - UNSURE])
        return {
            "row": batch["row"], "doc_id": batch["doc_id"], "place": batch["place"], "chunk": batch["chunk"],
            "heads": heads, "tails": tails,
        }

    schema = "row long, doc_id long, place int, chunk string, heads array<int>, tails array<int>"
    return per_batch(split, schema)(chunks.repartition("row", "place"))


def encode(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP,
           digests: bool = False) -> DataFrame:
    """(doc_id, ids) per row of `docs`: the ids of its whole text, as the tiktoken library gives them.

    A text of more than `chunk` characters becomes overlapping chunks that are split into pre-tokens in
    parallel, stitched per document and encoded piece by piece; a shorter one is a single piece. With
    `digests`, n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded again) stand in place of the
    ids, so that they need not leave the task.

    Null and empty texts have no ids. Repeated rows and repeated or null ids give a row each; other
    columns are ignored.
    """
    schema = "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    arrow = arrow_schema(schema)

    def result(doc_ids, all_ids):
        if not digests:
            return {"doc_id": doc_ids, "ids": all_ids}
        rows = [_digest(ids, vocabulary) for ids in all_ids]
        return {
            "doc_id": doc_ids, "n_tokens": [r[0] for r in rows],
            "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows],
        }

    def whole(batch):
        return result(batch["doc_id"], [encode_text(t, vocabulary) for t in batch["text"].to_pylist()])

    def joined(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        pieces = stitch([r["chunk"] for r in rows], [r["heads"] for r in rows], [r["tails"] for r in rows], chunk, overlap)
        ids = [i for piece in pieces for i in encode_text(piece, vocabulary)]
        columns = result([rows[0]["doc_id"]], [ids])
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    texts = keyed_texts(docs)
    short = per_batch(whole, schema)(texts.where(F.length("text") <= chunk).select("doc_id", "text"))
    long = _long_pieces(texts.where(F.length("text") > chunk), chunk, overlap).groupBy("row").applyInArrow(joined, schema)
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text as binary) from (doc_id, ids): the bytes of the ids, one after the other; null ids give no bytes."""

    def run(batch):
        return {"doc_id": batch["doc_id"], "text": [decode_ids(i or [], vocabulary) for i in batch["ids"].to_pylist()]}

    return per_batch(run, "doc_id long, text binary")(encoded.select("doc_id", "ids"))
