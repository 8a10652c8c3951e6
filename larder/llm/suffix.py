"""Repeated byte strings across a corpus, by suffix arrays over the neighbourhoods of shared anchors.

A window of LENGTH bytes holds an anchor: the places in it whose GRAM bytes have the least hash. Equal
windows have equal anchors at equal offsets, so a window can repeat only where its anchor does. An
anchor's neighbourhood is all windows that hold it, LENGTH - GRAM bytes to the left and LENGTH to the
right. Of equal neighbourhoods the first is looked at further; the windows of the others all repeat.
Different neighbourhoods of one anchor go to a suffix array by linear grouping (grouping.py), in which
equal windows stand side by side.

An anchor with many different neighbourhoods, such as one beside a common line, is split: its windows in
two halves, each keyed by the bytes that all windows of the half share. Neighbourhoods alone in their
key drop out, equal ones fold, and halves that are still large are split again, down to single windows,
which are their own key. No key ever brings more than MOST different neighbourhoods to a suffix array.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import arrow_schema, keyed_texts, per_batch, settled, written
from larder.llm.hashing import mixed, powers

LENGTH = 100
GRAM = 24
MOST = 12  #: different neighbourhoods that one suffix array takes
BATCH_BYTES = 1 << 20  #: bytes of neighbourhoods that are sorted side by side


def _slide(pick, values, width: int):
    """pick() over each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data, length: int = LENGTH, gram: int = GRAM):
    """(places, anchor hashes, neighbourhood hashes) of one text's bytes; none for a text shorter than a window."""
    import numpy as np

    n, width = len(data), length - gram + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    power, inverse = powers(max(1 << 17, 1 << n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mixed((total[gram:] - total[:-gram]) * inverse[:n - gram + 1])
    least = _slide(np.minimum, hashes, width)
    around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    around[width - 1:width - 1 + len(least)] = least
    place = np.flatnonzero(_slide(np.maximum, around, width) == hashes)
    start, stop = np.maximum(place - width + 1, 0), np.minimum(place + length, n)
    shape = ((stop - start) * (length + 1) + place - start).astype(np.uint64)
    near = mixed(mixed((total[stop] - total[start]) * inverse[start], 2) + shape, 1)
    return place, hashes[place], near


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, near, doc, row, place, again): anchors of all texts. `again`: an equal neighbourhood stands earlier in
    the same batch; such a row is keyed by its place, so copies of one text don't meet in one task."""
    schema = "anchor long, near long, doc long, row long, place int, again boolean"
    arrow = arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            doc, row = batch["doc"].to_numpy(), batch["row"].to_numpy()
            order = np.lexsort((row, doc))
            texts_ = batch["text"].to_pylist()
            found = [anchors(np.frombuffer(texts_[k].encode(), np.uint8), length, gram) for k in order]
            sizes = [len(f[0]) for f in found]
            place, anchor, near = (np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3))
            docs, rows = np.repeat(doc[order], sizes), np.repeat(row[order], sizes)
            by = np.argsort(mixed(anchor ^ near * np.uint64(3)), kind="stable")
            same = (anchor[by][1:] == anchor[by][:-1]) & (near[by][1:] == near[by][:-1])
            again = np.zeros(len(by), bool)
            again[by[1:][same]] = True
            own = mixed(rows.astype(np.uint64) * np.uint64(1 << 20) + place.astype(np.uint64), 3)
            anchor = np.where(again, own, anchor)
            columns = (anchor.view(np.int64), near.view(np.int64), docs, rows, place, again)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return texts.mapInArrow(run, schema)


def _neighbourhoods(texts: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, doc, row, at, place, part): the bytes around each of `places` (row, anchor, place), from byte `at` on."""
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("place", "anchor")).alias("wanted"))
    both = texts.join(wanted, "row").select("doc", "row", "text", "wanted")

    def cut(batch):
        out = {k: [] for k in ("key", "doc", "row", "at", "place", "part")}
        for doc, row, text, wanted in zip(*(batch[c].to_pylist() for c in ("doc", "row", "text", "wanted"))):
            data = text.encode()
            for w in wanted:
                at = max(0, w["place"] - (length - gram))
                for k, v in zip(out, (w["anchor"], doc, row, at, w["place"], data[at:w["place"] + length])):
                    out[k].append(v)
        return out

    return per_batch(cut, "key long, doc long, row long, at int, place int, part binary")(both)


def _sifted(level: DataFrame) -> DataFrame:
    """`level` with `again` (an equal part of the key stands earlier) and `kinds` (different parts of the key)."""
    order = Window.partitionBy("key").orderBy("part", "doc", "row", "at")
    # one place of a text may stand in a key by two anchors: that is no second occurrence
    same_place = (F.lag("row").over(order) == F.col("row")) & (F.lag("at").over(order) == F.col("at"))
    again = F.coalesce((F.lag("part").over(order) == F.col("part")) & ~same_place, F.lit(False))
    kinds = F.sum((~F.col("again")).cast("int")).over(Window.partitionBy("key"))
    return level.withColumn("again", again).withColumn("kinds", kinds).where("kinds > 1 or again")


def _halves(level: DataFrame, low: int, high: int, length: int) -> DataFrame:
    """Each part's windows whose start lies low..middle or middle+1..high from the anchor, keyed by what they share."""
    middle = (low + high) // 2
    sides = []
    for side, (l, h) in enumerate(((low, middle), (middle + 1, high))):
        first = F.greatest(F.col("at"), F.col("place") + l)
        last = F.least(F.col("at") + F.octet_length("part") - length, F.col("place") + h)
        core = F.substring(F.col("part"), F.col("place") + h - F.col("at") + 1, F.lit(length - (h - l)))
        sides.append(F.when(first <= last, F.struct(
            F.xxhash64("key", F.lit(side), core).alias("key"), first.alias("at"),
            F.substring(F.col("part"), first - F.col("at") + 1, last - first + length).alias("part"),
            F.lit(l).alias("low"), F.lit(h).alias("high"),
        )))
    return level.select("doc", "row", "place", F.explode(F.array_compact(F.array(*sides))).alias("half")).select(
        "half.key", "doc", "row", "half.at", "place", "half.part", "half.low", "half.high"
    )


def repeated_windows(parts: list[tuple[int, int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(row, start, stop) of bytes under windows with an earlier equal one. Parts are (key, doc, row, at, bytes), a key's side by side."""
    import numpy as np

    from larder.llm.grouping import suffix_arrays

    texts, owners, key = [], [], object()
    for k, p in enumerate(parts):
        if p[0] != key:
            key = p[0]
            texts.append([])
            owners.append([])
        texts[-1].append(p[4])
        owners[-1].append(k)
    by = sorted(range(len(texts)), key=lambda t: sum(map(len, texts[t])))
    symbols, _, sorted_ = suffix_arrays([texts[t] for t in by])
    owner = np.array([k for t in by for k in owners[t]])
    sizes = np.array([len(parts[k][4]) for k in owner])
    begin = np.flatnonzero(symbols < 0)
    begin = begin[np.append(symbols[begin[1:] - 1] >= 0, False)] + 1  # a part follows its mark
    part = np.repeat(np.arange(len(owner)), sizes)
    where = np.full(len(symbols), -1)
    inside = np.flatnonzero(symbols >= 0)
    where[inside] = part
    left = np.zeros(len(symbols), np.int64)
    left[inside] = np.repeat(begin + sizes, sizes) - inside
    order = sorted_[left[sorted_] >= length]
    if len(order) < 2:
        return []
    keys = np.array([parts[k][0] for k in owner])[where[order]]
    equal = keys[1:] == keys[:-1]
    steps = np.arange(length)
    candidates = np.flatnonzero(equal)
    for at in range(0, len(candidates), 1 << 16):
        some = candidates[at:at + (1 << 16)]
        some_equal = (symbols[order[some]] == symbols[order[some + 1]]) & (
            symbols[order[some] + length - 1] == symbols[order[some + 1] + length - 1]
        )
        equal[some[~some_equal]] = False
        some = some[some_equal]
        equal[some] = (symbols[order[some][:, None] + steps] == symbols[order[some + 1][:, None] + steps]).all(axis=1)
    info = np.array([parts[k][1:4] for k in owner], np.int64)[where[order]]
    start = info[:, 2] + order - begin[where[order]]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((start, info[:, 1], info[:, 0]))] = np.arange(len(order))
    fresh = np.append(True, ~equal)
    # the same window of a text may stand in two parts: it is one occurrence
    run = np.cumsum(fresh) - 1
    least = np.minimum.reduceat(rank, np.flatnonzero(fresh))
    first = np.empty(len(order), np.int64)
    first[rank] = np.arange(len(order))
    lead = first[least[run]]
    repeated = (info[:, 1] != info[lead, 1]) | (start != start[lead])
    hit = np.sort(order[repeated])
    if not len(hit):
        return []
    gap = (np.diff(hit, prepend=-length - 1) > length) | (np.diff(where[hit], prepend=-1) != 0)
    head = np.flatnonzero(gap)
    tail = np.append(head[1:], len(hit)) - 1
    out = []
    for a, b in zip(hit[head], hit[tail]):
        _, _, row, at, _ = parts[owner[where[a]]]
        offset = at - begin[where[a]]
        out.append((row, int(a + offset), int(b + offset + length)))
    return out


def sharing(parts: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The parts of one key that may share a window with another; the others hold no repeat.

    Parts are (key, doc, row, at, bytes, place, low, high): their windows start low..high from the anchor at `place`. Equal
    windows start equally far from it, so in the same half of that range, and hold what all windows of the half share.
    """
    cores: dict[tuple[int, bytes], list[int]] = {}
    for k, (_, _, _, at, part, place, low, high) in enumerate(parts):
        middle, last, base = (low + high) // 2, at + len(part) - length, place - at
        if max(at, place + low) <= min(place + middle, last):
            cores.setdefault((0, part[base + middle:base + low + length]), []).append(k)
        if max(at, place + middle + 1) <= min(place + high, last):
            cores.setdefault((1, part[base + high:base + middle + 1 + length]), []).append(k)
    return [parts[k] for k in sorted({k for held in cores.values() if len(held) > 1 for k in held})]


def _solved(sifted: DataFrame, length: int) -> DataFrame:
    """(row, start, stop) from the suffix arrays of all keys, keys side by side in each partition."""
    schema = "row long, start int, stop int"
    arrow = arrow_schema(schema)
    columns = ("key", "doc", "row", "at", "part", "place", "low", "high")

    def run(batches):
        import pyarrow as pa

        def solved(parts):
            spans = repeated_windows(parts, length)
            return pa.RecordBatch.from_arrays(
                [pa.array([s[k] for s in spans], f.type) for k, f in enumerate(arrow)], schema=arrow
            )

        waiting, size, own = [], 0, []

        def settle():
            nonlocal size
            some = sharing(own, length)
            waiting.extend(p[:5] for p in some)
            size += sum(len(p[4]) for p in some)
            own.clear()

        for batch in batches:
            for p in zip(*(batch[c].to_pylist() for c in columns)):
                if own and p[0] != own[-1][0]:
                    settle()
                    if size > BATCH_BYTES:
                        yield solved(waiting)
                        waiting, size = [], 0
                own.append(p)
        settle()
        if waiting:
            yield solved(waiting)

    return sifted.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(row, start, stop) byte spans, overlapping and unsorted, that cover what repeats an earlier string of `length` bytes.

    `texts` are (row, doc, text); earlier is a smaller doc, then a smaller row, then an earlier start.
    """
    width = length - gram
    by_anchor = Window.partitionBy("anchor")
    ordered = by_anchor.orderBy("near", "doc", "row", "place")
    shared = (
        _occurrences(texts, length, gram)
        .withColumn("again", F.col("again") | F.coalesce(F.lag("near").over(ordered) == F.col("near"), F.lit(False)))
        .withColumn("several", F.min("near").over(by_anchor) != F.max("near").over(by_anchor))
        .where("again or several")
    )
    shared = written(shared, "shared")
    spans = [shared.where("again").select(
        "row", F.greatest(F.col("place") - width, F.lit(0)).alias("start"), (F.col("place") + length).alias("stop")
    )]
    level = _neighbourhoods(texts, shared.where("not again"), length, gram).withColumns(
        {"low": F.lit(-width), "high": F.lit(0)}
    )
    ranges = [(-width, 0)]
    while True:
        sifted = written(_sifted(level), "sifted")
        spans.append(sifted.where("again").select("row", F.col("at").alias("start"), (F.col("at") + F.octet_length("part")).alias("stop")))
        spans.append(written(_solved(sifted.where(f"not again and kinds <= {most}"), length), "solved"))
        large = sifted.where(f"not again and kinds > {most}")
        ranges = [(l, h) for l, h in ranges if h > l]
        if not ranges or large.isEmpty():
            return reduce(DataFrame.unionByName, spans)
        # the halves of a level differ by one window in width at most; each is split at its own middle
        level = reduce(DataFrame.unionByName, [
            _halves(large.where(f"low = {l} and high = {h}"), l, h, length) for l, h in ranges
        ])
        ranges = [x for l, h in ranges for x in ((l, (l + h) // 2), ((l + h) // 2 + 1, h))]


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, digests: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans and kept (the bytes left), or kept_sha256 with `digests`.

    Removed is each byte under a string of `length` bytes that starts earlier as well: in a smaller doc_id,
    or in the same document before. Null text counts as empty; a text shorter than `length` stays whole.
    A null id comes first; of rows that repeat an id the one that the scan meets first comes first. An empty
    table gives an empty result. Bytes that are left need not be valid UTF-8.
    """
    texts = keyed_texts(settled(docs)).select("row", "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text")
    spans = repeats(texts.select("row", "doc", "text"), length, gram, most)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batch):
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept")
        out = {k: [] for k in names}
        for doc_id, text, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans"))):
            data = text.encode()
            kept, removed, count, at = [], 0, 0, 0
            for start, stop in merged([(s["start"], min(s["stop"], len(data))) for s in spans or ()]):
                kept.append(data[at:start])
                removed, count, at = removed + stop - start, count + 1, stop
            left = b"".join([*kept, data[at:]])
            for k, v in zip(names, (doc_id, len(data), removed, count, hashlib.sha256(left).hexdigest() if digests else left)):
                out[k].append(v)
        return out

    last = "kept_sha256 string" if digests else "kept binary"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}"
    return per_batch(run, schema)(texts.join(spans, "row", "left").select("doc_id", "text", "spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out
