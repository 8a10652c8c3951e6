"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has CHUNKS chunks of PLACES_PER_CHUNK bytes, each byte of one minimum hash of the set. Signatures that
differ in fewer than CHUNKS * (errors + 1) places have a chunk with at most `errors` differences, so leaving out
every choice of that many places of every chunk gives keys of which each such pair shares one: no pair within
the distance is missed. How far apart similar sets' signatures can be is a matter of chance; `allowed_errors`
takes the distance so that a link at the very limit is beyond it once in 50,000 at most.

The links' components are found, not all pairs: each node first meets the one node it shares most keys with,
then only nodes of different components are compared, inside the tasks that hold a key, in blocks. Every link
is confirmed on whole sets.
"""

from __future__ import annotations

import itertools
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import arrow_schema, per_batch, whole_text, written
from larder.llm.hashing import MIXES, mixed
from larder.llm.jaccard import TEXTS, components, named, needed, shingle_sets, whole_sets

WORDS = 2
PERCENT = 80
CHUNKS = 10
PLACES_PER_CHUNK = 7
PLACES = CHUNKS * PLACES_PER_CHUNK
MISSED = 2e-5  #: the chance that a link at the limit lies beyond the signature distance
PARITIES = 1024  #: bits that say whether an odd number of a set's tokens falls there
BLOCK = 1024  #: nodes of a key that one task compares with as many others


def allowed_errors(percent: int) -> int:
    """The fewest errors a chunk may have so that similar sets are within the distance, but for MISSED."""
    p = 1 - percent / 100
    for errors in range(PLACES_PER_CHUNK):
        beyond = sum(comb(PLACES, k) * p**k * (1 - p) ** (PLACES - k) for k in range(CHUNKS * (errors + 1), PLACES + 1))
        if beyond <= MISSED:
            return errors
    return PLACES_PER_CHUNK


def signatures(sets: list):
    """A row of PLACES bytes per set, none of them empty: one byte of each minimum hash."""
    import numpy as np

    out = np.empty((len(sets), PLACES), np.uint8)
    rng = np.random.default_rng(MIXES[0])
    salts = rng.integers(0, 1 << 63, PLACES, np.uint64)
    factors = rng.integers(0, 1 << 63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
    done = 0
    while done < len(sets):
        more, size = done, 0
        while more < len(sets) and (more == done or size + len(sets[more]) <= 1 << 16):
            size += len(sets[more])
            more += 1
        tokens = np.concatenate(sets[done:more])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[done:more]])[:-1]))
        for k in range(PLACES):
            least = np.minimum.reduceat((tokens ^ salts[k]) * factors[k], starts)
            out[done:more, k] = (mixed(least, 1) & np.uint64(255)).astype(np.uint8)
        done = more
    return out


def left_out(errors: int) -> list[tuple[int, ...]]:
    """The choices of places that a key leaves out of its chunk."""
    return list(itertools.combinations(range(PLACES_PER_CHUNK), errors))


def keys(signature, errors: int):
    """Per signature the keys of all chunks and choices: which it is, and the bytes that are not left out."""
    import numpy as np

    choices = left_out(errors)
    out = np.empty((len(signature), CHUNKS * len(choices)), np.uint64)
    for c in range(CHUNKS):
        chunk = signature[:, c * PLACES_PER_CHUNK:(c + 1) * PLACES_PER_CHUNK].astype(np.uint64)
        for v, choice in enumerate(choices):
            which = c * len(choices) + v
            value = np.full(len(signature), which, np.uint64)
            for p in range(PLACES_PER_CHUNK):
                if p not in choice:
                    value = value << np.uint64(8) | chunk[:, p]
            out[:, which] = value
    return out.view(np.int64)


def _described(texts: DataFrame, words: int) -> DataFrame:
    """Per text (doc_id, n, a, b, signature, parities); the last two are null for a text without words."""

    def run(batch):
        import numpy as np

        sets = shingle_sets(batch["text"].to_pylist(), words)
        some = [k for k, s in enumerate(sets) if len(s)]
        out = {"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "signature": [None] * len(sets), "parities": [None] * len(sets)}
        for name, turn in (("a", 2), ("b", 3)):
            out[name] = [int(mixed(s, turn).sum().astype(np.int64)) if len(s) else 0 for s in sets]
        for k, row in zip(some, signatures([sets[k] for k in some])):
            out["signature"][k] = row.tobytes()
            counts = np.bincount((sets[k] % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
            out["parities"][k] = np.packbits(counts & 1).tobytes()
        return out

    schema = "doc_id long, n int, a long, b long, signature binary, parities binary"
    return per_batch(run, schema, TEXTS)(texts.select("doc_id", "text"))


def _postings(nodes: DataFrame, errors: int) -> DataFrame:
    """(key, a) for all keys of all nodes."""

    def run(batch):
        import numpy as np

        signature = _bytes(batch["signature"], PLACES)
        return {"a": batch["a"], "keys": list(keys(signature, errors))} if len(signature) else {"a": [], "keys": np.empty((0, 0))}

    spread = per_batch(run, "a long, keys array<long>", TEXTS)(nodes.select("a", "signature"))
    return spread.select(F.explode("keys").alias("key"), "a")


def _bytes(column, size: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def near(one: dict, other: dict, errors: int, percent: int):
    """Which of the pairs are within the signature distance and may be similar by sizes and parities."""
    import numpy as np

    n, m = one["n"].astype(np.int64), other["n"].astype(np.int64)
    least = -(-(n + m) * percent // (100 + percent))
    able = np.minimum(n, m) >= least
    differ = (one["signature"] != other["signature"]).sum(1) < CHUNKS * (errors + 1)
    # a token that only one of the sets holds turns one bit
    apart = np.bitwise_count(one["parities"] ^ other["parities"]).sum(1, dtype=np.int64)
    return able & differ & (apart <= n + m - 2 * least)


def _tried(pairs: DataFrame, nodes: DataFrame, errors: int, percent: int) -> DataFrame:
    """The pairs (a, b) that pass `near`."""

    def run(batch):
        sides = [
            {"n": batch[f"{s}_n"].to_numpy(), "signature": _bytes(batch[f"{s}_signature"], PLACES), "parities": _bytes(batch[f"{s}_parities"], PARITIES // 8)}
            for s in "ab"
        ]
        keep = near(*sides, errors, percent)
        return {s: batch[s].to_numpy()[keep] for s in "ab"}

    both = pairs
    for s in "ab":
        both = both.join(nodes.select(F.col("a").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "signature", "parities")]), s)
    return per_batch(run, "a long, b long")(both)


def _compared(rows: DataFrame, errors: int, percent: int) -> DataFrame:
    """(a, b) between nodes of different components that share a key and pass `near`, each pair once.

    The rows of a key come in blocks of about BLOCK nodes; two blocks meet in one group. A pair that shares
    several keys comes out with the first of them.
    """
    schema = "a long, b long"
    arrow = arrow_schema(schema)
    choices = left_out(errors)
    count = len(choices)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        first_choice = np.full(1 << PLACES_PER_CHUNK, -1)
        for v, choice in reversed(list(enumerate(choices))):
            for few in range(errors + 1):
                for some in itertools.combinations(choice, few):
                    first_choice[sum(1 << p for p in some)] = v
        weights = 1 << np.arange(PLACES_PER_CHUNK)

        def pairs(t):
            group = np.cumsum(t["new"])
            which = (t["key"] >> (8 * (PLACES_PER_CHUNK - errors))).astype(np.int64)
            at = np.arange(len(group))
            for lag in itertools.count(1):
                at = at[at + lag < len(group)]
                at = at[group[at] == group[at + lag]]
                if not len(at):
                    return
                apart = (t["root"][at] != t["root"][at + lag]) & ((t["lo"][at] == t["hi"][at]) | (t["block"][at] != t["block"][at + lag]))
                some = at[apart]
                for k in range(0, len(some), 50_000):
                    i = some[k:k + 50_000]
                    j = i + lag
                    differ = (t["signature"][i] != t["signature"][j]).reshape(-1, CHUNKS, PLACES_PER_CHUNK)
                    few = differ.sum(2) <= errors
                    chunk = few.argmax(1)
                    mask = (differ[np.arange(len(i)), chunk] * weights).sum(1)
                    once = few[np.arange(len(i)), chunk] & (which[i] == chunk * count + first_choice[mask])
                    i, j = i[once], j[once]
                    keep = near(*[{c: t[c][x] for c in ("n", "signature", "parities")} for x in (i, j)], errors, percent)
                    if keep.any():
                        a, b = t["a"][i[keep]], t["a"][j[keep]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=arrow)

        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                t = {c: batch[c].to_numpy() for c in ("key", "lo", "hi", "block", "a", "root", "n")}
                t |= {"signature": _bytes(batch["signature"], PLACES), "parities": _bytes(batch["parities"], PARITIES // 8)}
                if held is not None:
                    t = {c: np.concatenate((held[c], t[c])) for c in t}
                    held = None
            elif held is not None:
                t = held
            else:
                return
            new = np.ones(len(t["key"]), bool)
            new[1:] = (t["key"][1:] != t["key"][:-1]) | (t["lo"][1:] != t["lo"][:-1]) | (t["hi"][1:] != t["hi"][:-1])
            if batch is not None:  # the last group may go on in the next batch
                cut = int(np.flatnonzero(new)[-1])
                held = {c: v[cut:] for c, v in t.items()}
                t, new = {c: v[:cut] for c, v in t.items()}, new[:cut]
            yield from pairs(t | {"new": new})

    return rows.mapInArrow(run, schema)


def _blocks(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each key that is held by several components, once for each pair of blocks they are in."""
    held = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    held = held.where("low <> high").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    rows = placed.join(held, "key").select("key", "a", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "a", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = rows.join(nodes.select("a", "n", "signature", "parities"), "a")
    order = ("key", "lo", "hi")
    return rows.repartition(*order).sortWithinPartitions(*order).select("key", "lo", "hi", "block", "a", "root", "n", "signature", "parities")


def _confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar."""
    ends = written(pairs.select("a").union(pairs.select("b")).distinct(), "ends")
    sets = written(whole_sets(texts, ends, words).select("a", "tokens").join(nodes.select("a", "n"), "a"), "sets")
    both = pairs
    for s in "ab":
        both = both.join(sets.select(F.col("a").alias(s), F.col("n").alias(f"{s}_n"), F.col("tokens").alias(f"{s}_tokens")), s)
    return both.where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= needed(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null or empty texts and texts without words have no shingles and are linked with nothing. Equal sets fold
    to one node before, so rows that repeat, however many, have one component; a null id takes part but never
    names a component unless all its ids are null. An empty table gives an empty result. Sets are named and
    compared by 64-bit hashes of their shingles. Other columns are ignored.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    errors = allowed_errors(percent)
    rows = written(_described(texts, words), "described")
    nodes = rows.where("n > 0").groupBy("n", "a", "b").agg(
        F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.first("parities").alias("parities")
    )
    nodes = written(nodes, "nodes")

    postings = _postings(nodes, errors)
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    alive = written(postings.join(shared, "key", "left_semi"), "postings")

    degree = alive.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    leaders = alive.join(degree, "a").groupBy("key").agg(F.max(F.struct("degree", "a")).alias("leader"))
    offers = alive.join(leaders.select("key", F.col("leader.a").alias("b")), "key").where("a <> b")
    best = offers.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best"))
    tried = written(_tried(best.select("a", F.col("best.b").alias("b")), nodes, errors, percent), "tried")
    first = written(_confirmed(tried, texts, nodes, words, percent), "links")

    roots = components(first)
    placed = alive.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rest = written(_compared(_blocks(written(placed, "placed"), nodes), errors, percent), "rest")
    second = written(_confirmed(rest, texts, nodes, words, percent), "links")
    return named(rows.select("doc_id", "n", "a", "b"), nodes.select("n", "a", "b", "least"), first.union(second))


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `join` with `kept`: whether the row's id names its component."""
    return join(docs, words, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
