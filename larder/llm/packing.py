"""Pack token pieces into sequences by minimum bin slack over the multiset of remaining lengths."""

from __future__ import annotations

import functools
import re
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.bpe import encode_text
from larder.llm.common import per_batch, whole_text, written

CAPACITY = 1024
END = 0  #: the id behind each document
SALTS = 256  #: parts in which pieces of one length are numbered
#: Texts of other characters, or with the special token's string, go to the tokenizers library itself.
_COMMON = re.compile(r"[\x00-ɏ‐-‧€]*")
_SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=1)
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_ids(text: str) -> list[int]:
    """The ids that the tokenizers library gives for byte_bpe_50k.json, without special tokens added.

    The rank file holds the same vocabulary; its encoder is several times faster and gives the same ids
    where both libraries agree on the classes of the characters, which holds for Latin letters.
    """
    if _SPECIAL not in text and _COMMON.fullmatch(text):
        return encode_text(text)
    return _tokenizer().encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at multiples of `capacity`."""

    def cut(batch):
        import numpy as np

        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            ids = np.array([*token_ids(text), END], "<u4")
            for start in range(0, len(ids), capacity):
                part = ids[start:start + capacity]
                for k, v in zip(out, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))):
                    out[k].append(v)
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return per_batch(cut, schema)(docs.select("doc_id", whole_text().alias("text")))


def fullest(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """How many pieces of each length fill a window that holds `seed` closest to its capacity.

    Bit s of `reach` is set if some lengths sum to s; the bits after each length are kept, and the
    counts are found by walking back through them.
    """
    room = capacity - seed
    reach, layers, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = counts[length] - (length == seed)
        if length > room or left <= 0:
            continue
        layers.append((length, left, reach))
        step = reach
        for _ in range(min(left, room // length)):
            step = (step << length) & full
            if not step:
                break
            reach |= step
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken = {seed: 1}
    for length, left, before in reversed(layers):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            taken[length] = taken.get(length, 0) + used
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, pieces of each length) of windows until all counts are used.

    The largest length that is left seeds a window; the window is repeated as often as the counts allow.
    The list depends on at most `capacity` counts, however many rows they stand for.
    """
    counts, windows = {k: v for k, v in counts.items() if v}, []
    while counts:
        taken = fullest(counts, max(counts), capacity)
        times = min(counts[k] // n for k, n in taken.items())
        windows.append((times, taken))
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return windows


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Only the counts of the at most `capacity` lengths come to the driver, where the windows are planned.
    A piece's number among those of its length, from salted counts and their running sums, tells its
    window, so no task sees all pieces of a length. Pieces are computed once and read from shared files.

    A null or empty text is the end id alone. Repeated rows are packed each; equal pieces take equal
    places in any order. An empty table gives no pieces. Sequences stay unpadded only at a power of two
    or `capacity`; the plan leaves slack when no lengths that are left fill the window.
    """
    parts = written(pieces(docs, capacity), "pieces").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))
    )
    groups = parts.groupBy("length", "salt").count()
    lengths = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}

    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first number, first sequence, per sequence, offset)
    used, sequence = dict.fromkeys(lengths, 0), 0
    for times, taken in plan(lengths, capacity):
        offset = 0
        for length in sorted(taken, reverse=True):
            slots.setdefault(length, []).append((used[length], sequence, taken[length], offset))
            used[length] += taken[length] * times
            offset += length * taken[length]
        sequence += times

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = parts.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn(
        "nth", F.col("nth") + F.col("before")
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batch):
        import numpy as np

        length, nth = batch["length"].to_numpy(), batch["nth"].to_numpy()
        sequence_id, offset = np.empty_like(nth), np.empty_like(nth)
        for size in np.unique(length):
            here = length == size
            first, base, per, start = np.array(slots[int(size)], np.int64).T
            k = np.searchsorted(first, nth[here], "right") - 1
            turn = nth[here] - first[k]
            sequence_id[here] = base[k] + turn // per[k]
            offset[here] = start[k] + turn % per[k] * size
        return {n: batch[n] for n in names} | {"sequence_id": sequence_id, "offset": offset}

    schema = ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"])
    return per_batch(place, schema)(numbered.select(*names, "nth"))
