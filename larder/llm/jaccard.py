"""N-gram Jaccard join: candidates share prefix tokens under several global orders and are then verified.

The links' components are found, not all pairs. Every step is exact: a bound drops only what cannot be linked.

* Equal sets fold to one node.
* A token that no other set holds is *lost*: a set with more lost tokens than a similar one may miss has no
  partner. Most sets go this way, by the lost tokens among a fixed share of all tokens, then among all.
* The global orders put lost tokens first and then rare ones. Two similar sets share a token that comes early
  in both, by their sizes; such tokens make the candidates.
* A node first tries the leader it shares most of those tokens with, the one with the fewest lost tokens.
  Pairs are then formed only between different components of what is linked.
* Candidates must share enough prefix tokens under each order, and their counts in hashed buckets must be as
  near as the sets would be, before whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import PLACES, among, arrow_schema, bitmap, per_batch, whole_text, without, written
from larder.llm.hashing import BASE, mixed, powers

WORDS = 3
PERCENT = 90  #: two sets are linked when 100 * intersection >= PERCENT * union
ORDERS = 3
SHARE = 3  #: lost tokens are counted among one in so many tokens at first
TEXTS = 512  #: so many texts' sets are held by a task at a time
BUCKETS = 256  #: of a set's token counts; the sum of the counts' differences is at most what the sets differ by


def shingle_sets(texts: list[str], words: int = WORDS) -> list:
    """Per text the sorted distinct 64-bit hashes of its shingles.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer words than a
    shingle has one shingle, all its words; one without words has none.
    """
    import numpy as np

    encoded = [t.encode() for t in texts]
    out, block, size = [], [], 0
    for item in [*encoded, None]:
        if item is None or size + len(item) + 1 > 1 << 19 and block:
            out += _block_sets(block, words)
            block, size = [], 0
        if item is not None:
            block.append(item)
            size += len(item) + 1
    return out


def _block_sets(block: list[bytes], words: int) -> list:
    import numpy as np

    if not block:
        return []
    data = np.frombuffer(b" ".join(block) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
    start, stop = edge[::2], edge[1::2]
    power, inverse = powers(max(1 << 20, 1 << len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    word = mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(b) + 1 for b in block])
    last = np.searchsorted(start, ends)
    first = np.concatenate(([0], last[:-1]))
    n = len(word) - words + 1
    if n > 0:
        run = word[:n]
        for k in range(1, words):
            run = mixed(run * np.uint64(BASE) + word[k:k + n], k)
    sets = []
    for a, b in zip(first, last):
        if b - a >= words:
            sets.append(np.unique(run[a:b - words + 1]))
        elif b > a:
            h = word[a:a + 1]
            for k in range(a + 1, b):
                h = mixed(h * np.uint64(BASE) + word[k:k + 1], 1)
            sets.append(mixed(h + np.uint64(b - a), 2))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _described(texts: DataFrame, words: int) -> DataFrame:
    """Per text (doc_id, n, a, b): the size of its set and two sums that name it."""

    def run(batch):
        sets = shingle_sets(batch["text"].to_pylist(), words)
        names = [[int(mixed(s, k).sum().astype("int64")) if len(s) else 0 for s in sets] for k in (2, 3)]
        return {"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "a": names[0], "b": names[1]}

    return per_batch(run, "doc_id long, n int, a long, b long", TEXTS)(texts.select("doc_id", "text"))


def _some_tokens(texts: DataFrame, words: int) -> DataFrame:
    """(token, a) for one in SHARE tokens, the same ones everywhere, of all sets."""
    arrow = arrow_schema("token long, a long")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = (batch["text"].slice(k, TEXTS) for batch in batches for k in range(0, batch.num_rows, TEXTS))
        for part in parts:
            for s in shingle_sets(part.to_pylist(), words):
                if len(s):
                    some = s[mixed(s, 4) % np.uint64(SHARE) == 0].view(np.int64)
                    name = np.full(len(some), mixed(s, 2).sum().astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(name)], schema=arrow)

    def merged(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return texts.select("text").mapInArrow(merged, "token long, a long")


def whole_sets(texts: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """(a, tokens, buckets) of the sets named in `names` (a), once each.

    Texts are read where they lie; a bitmap of a fixed size tells which sets to send on, and an exact join
    drops the few others.
    """
    marks = bitmap(names.select((F.col("a").bitwiseAND(F.lit(PLACES - 1)) + 1).alias("place"))).collect()  # at most 8 MB
    held = bytearray(PLACES // 8)
    for r in marks:
        held[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = r["bits"]
    there = texts.sparkSession.sparkContext.broadcast(bytes(held))
    schema = "a long, tokens array<long>, buckets array<short>"

    def run(batch):
        import numpy as np

        bits = there.value
        out = {"a": [], "tokens": [], "buckets": []}
        for s in shingle_sets(batch["text"].to_pylist(), words):
            if len(s):
                name = int(mixed(s, 2).sum().astype(np.int64))
                place = name & (PLACES - 1)
                if bits[place >> 3] >> (place & 7) & 1:
                    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
                    for k, v in zip(out, (name, s.view(np.int64), np.minimum(counts, 32767))):
                        out[k].append(v)
        return out

    found = per_batch(run, schema, TEXTS)(texts.select("text")).join(names.select("a").hint("merge"), "a", "left_semi")
    return found.groupBy("a").agg(F.first("tokens").alias("tokens"), F.first("buckets").alias("buckets"))


def needed(n: Column, other: Column, percent: int) -> Column:
    """The least intersection of two similar sets of these sizes."""
    return F.floor(((n.cast("long") + other) * percent + 99 + percent) / (100 + percent)).cast("int")


def own_part(n: Column, percent: int) -> Column:
    """The least number of a set's tokens that a similar set holds."""
    return F.floor((n.cast("long") * percent + 99) / 100).cast("int")


def _lost(texts: DataFrame, words: int) -> DataFrame:
    """(a, lost): how many of a set's sampled tokens no other set holds. Tokens combine map-side."""
    holders = _some_tokens(texts, words).groupBy("token").agg(F.min("a").alias("a"), F.max("a").alias("z"))
    return holders.where("a = z").groupBy("a").agg(F.count(F.lit(1)).cast("int").alias("lost"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(a, n, lost, prefix_0, prefix_1, ..., buckets) of the sets that may have a partner.

    Each order has the lost tokens first. The first order goes on by the number of sets that hold a token,
    the others by its order of magnitude and then by a hash of their own. A prefix lists the tokens after the
    lost ones, up to the last that can be the first one shared with a similar set.
    """
    tokens = sets.select("a", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ranked = F.struct("sets", "token", *[
        F.struct(F.floor(F.log2("sets")).alias("c"), F.xxhash64("token", F.lit(k)).alias("h"), "token").alias(f"order_{k}")
        for k in range(1, ORDERS)
    ])
    rest = tokens.join(held, "token").groupBy("a", "n").agg(F.collect_list(ranked).alias("r")).withColumn("lost", F.col("n") - F.size("r"))
    size = F.col("n") - own_part(F.col("n"), percent) + 1 - F.col("lost")
    ways = [F.array_sort("r"), *[F.array_sort(F.col(f"r.order_{k}")) for k in range(1, ORDERS)]]
    firsts = [F.transform(F.slice(way, F.lit(1), F.col("size")), lambda t: t["token"]) for way in ways]
    kept = rest.withColumn("size", size).where("size > 0")
    kept = kept.select("a", "n", "lost", *[f.alias(f"prefix_{k}") for k, f in enumerate(firsts)])
    return kept.join(sets.select("a", "buckets"), "a")


def _postings(prefixes: DataFrame) -> DataFrame:
    """(token, a, n, lost, place): each prefix token and its place in the set under the first order."""
    spread = prefixes.select("a", "n", "lost", F.posexplode("prefix_0").alias("at", "token"))
    return spread.select("token", "a", "n", "lost", (F.col("at") + F.col("lost")).alias("place"))


def _possible(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether a shared token can be the first one that two similar sets share.

    As many as are needed of each set come at that token or after it, and the lost ones are not shared.
    """
    least = needed(x("n"), y("n"), percent)
    return (
        (x("place") <= x("n") - least) & (y("place") <= y("n") - least)
        & (x("n") - x("lost") >= least) & (y("n") - y("lost") >= least)
    )


def verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar.

    First by narrow rows: under each order the shared prefix tokens and all that may follow the prefix that
    ends first must be enough, and the bucket counts must not differ by more than similar sets do. Whole sets
    are compared for the pairs that are left.
    """
    def side(of: DataFrame, name: str, *columns: str) -> DataFrame:
        return of.select(F.col("a").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    narrow = ("n", "buckets", *[f"prefix_{k}" for k in range(ORDERS)])
    near = pairs.join(side(prefixes, "a", *narrow), "a").join(side(prefixes, "b", *narrow), "b")
    least = needed(F.col("a_n"), F.col("b_n"), percent)
    after = F.greatest(own_part(F.col("a_n"), percent), own_part(F.col("b_n"), percent)) - 1
    for k in range(ORDERS):
        near = near.where(F.size(F.array_intersect(f"a_prefix_{k}", f"b_prefix_{k}")) + after >= least)
    apart = F.aggregate(F.zip_with("a_buckets", "b_buckets", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda t, v: t + v)
    near = near.where(apart <= F.col("a_n") + F.col("b_n") - 2 * least).select("a", "b", least.alias("least"))
    near = written(near, "near")
    whole = near.join(side(sets, "a", "tokens"), "a").join(side(sets, "b", "tokens"), "b")
    return whole.where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.col("least")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each end of an edge reaches.

    Each round every node points at the smallest of its neighbours and then at what that one points at;
    the rounds are written, so their number does not lengthen the lineage. It grows with the logarithm
    of the longest path.
    """
    links = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    links = written(links, "links")
    roots = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    while True:
        # the smallest root among the neighbours, given to the node and to the root it had
        seen = links.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("near")
        )
        offers = roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("best"))
        hooked = offers.groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook"))
        moved = offers.join(hooked, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("best", F.coalesce("hook", "best")).alias("next")
        )
        jumped = moved.join(moved.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left").select(
            "node", "old", F.least("next", F.coalesce("far", "next")).alias("root")
        )
        step = written(jumped, "roots")
        roots = step.select("node", "root")
        if step.where("old <> root").isEmpty():
            return roots


def _linked(texts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between sets, enough of them to connect each component."""
    alone = F.col("n") - own_part(F.col("n"), percent)  # so many tokens of a set a similar one may miss
    able = nodes.join(_lost(texts, words), "a", "left").where(F.coalesce("lost", F.lit(0)) <= alone).select("a")
    sets = written(whole_sets(texts, written(able, "able"), words), "sets")
    prefixes = written(_prefixes(sets, percent), "prefixes")
    postings = written(_postings(prefixes), "postings")

    # similar sets lie in one band of sizes or in neighbouring ones; those in neighbouring ones meet later
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / min(percent, 99)))).cast("int")
    by_band = postings.withColumn("band", band)
    best = F.struct((-F.col("lost") / F.col("n")).alias("whole"), "a", "n", "lost", "place")
    leaders = by_band.groupBy("token", "band").agg(F.max(best).alias("leader"))
    offers = by_band.join(leaders, ["token", "band"]).where(
        (F.col("a") != F.col("leader.a")) & _possible(lambda c: F.col(c), lambda c: F.col(f"leader.{c}"), percent)
    )
    shared = offers.groupBy("a", F.col("leader.a").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    tried = shared.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    first = written(verified(written(tried, "tried"), prefixes, sets, percent), "links")

    roots = components(first)
    placed = postings.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    mixed_tokens = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    placed = written(placed.join(mixed_tokens.select("token"), "token", "left_semi"), "placed")
    left, right = (placed.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("a", "n", "lost", "place", "root")]) for s in "xy")
    rest = (
        left.join(right, "token")
        .where((F.col("x_a") < F.col("y_a")) & (F.col("x_root") != F.col("y_root")))
        .where(_possible(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"), percent))
        .select(F.col("x_a").alias("a"), F.col("y_a").alias("b")).distinct()
    )
    second = verified(written(rest, "rest"), prefixes, sets, percent)
    return first.union(written(second, "links"))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null or empty texts and texts without words have no shingles and are linked with nothing. Repeated
    rows have equal sets and one component; a null id takes part but never names a component unless all
    its ids are null. An empty table gives an empty result. Sets are named and compared by 64-bit hashes of
    their shingles. Other columns are ignored.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    rows = written(_described(texts, words), "described")
    nodes = rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "nodes")
    return named(rows, nodes, _linked(texts, nodes, words, percent))


def named(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the smallest id of their set's component."""
    ends = components(links)
    placed = nodes.join(ends.withColumnRenamed("node", "a"), "a", "left").select("n", "a", "b", "least", F.coalesce("root", "a").alias("root"))
    least_of = placed.groupBy("root").agg(F.min("least").alias("component"))
    by_set = placed.join(least_of, "root").select("n", "a", "b", "component")
    return rows.join(by_set, ["n", "a", "b"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def without_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each component of similar texts, that with the smallest id; all columns are kept.

    Rows without words are all kept. Of rows that repeat the smallest id, and of equal texts without words
    under one id, one stays.
    """
    ids = written(join(docs, words, percent), "decided")
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = ids.where(~stays).select("doc_id")
    twice = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    twice = written(twice, "twice")
    if twice.isEmpty():  # each id names one row
        return without(docs, gone)
    packed = among(docs, twice).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    keep = ids.where(stays).select(F.col("doc_id").alias("keep")).distinct()
    kept = packed.join(keep, F.col("id").eqNullSafe(F.col("keep")), "left_semi")
    once = Window.partitionBy("id", F.sha2(F.coalesce("row.text", F.lit("")), 256)).orderBy(F.xxhash64("row"))
    kept = kept.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")
    return without(docs, gone.union(twice)).union(kept)
