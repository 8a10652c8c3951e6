"""Centroid clustering by Shallot search: exact rounds of k-means that look at few centroids per vector.

Each vector carries its centroid, the second-nearest one of its last search, an upper bound of the distance to
the first and a lower bound of the distance to all others. While the bounds tell that nothing nearer can be
there, no distance is worked out. Else the search starts from the closer of the two remembered centroids, goes
through that one's neighbours by rising distance, and ends where the ball that can hold a nearer one, which
shrinks as nearer ones are found, is left. Bounds are doubles with a margin; all that is in the ball is compared
in exact integers, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import arrow_schema, written
from larder.llm.whitening import finite

SCALE = 256
SIZE = 64
CENTROIDS = 40
ROUNDS = 5
LIMIT = float(1 << 27)  #: scaled entries beyond it count as it, so that a squared distance fits a long
MARGIN = 1e-9


def _integers(vector: str) -> Column:
    return F.transform(
        vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT)))
    )


class Centroids:
    """The centroids of a round, their distances, and each one's neighbours by rising distance."""

    def __init__(self, rows: list[list[int]]):
        import numpy as np

        self.at = np.array(rows, np.int64)
        k = len(rows)
        between = np.sqrt(((self.at[:, None, :] - self.at[None, :, :]).astype(float) ** 2).sum(2))
        self.between = between
        ranked = between.copy()
        ranked[np.arange(k), np.arange(k)] = -1  # itself first
        self.near = np.argsort(ranked, axis=1, kind="stable")
        self.half = between[np.arange(k), self.near[:, 1]] / 2 if k > 1 else np.full(k, np.inf)

    def squared(self, x, number):
        """Exact squared distances of rows to the centroid of each."""
        d = x - self.at[number]
        return (d * d).sum(1)

    def moved(self, later: Centroids):
        import numpy as np

        return np.sqrt(((self.at - later.at).astype(float) ** 2).sum(1)) * (1 + MARGIN)


def search(x, first, second, c: Centroids):
    """Nearest and second-nearest centroid of each row and the squared distances, from two remembered ones."""
    import numpy as np

    k = len(c.at)
    d1 = c.squared(x, first)
    if k == 1:
        return first, second, d1, np.full(len(x), np.iinfo(np.int64).max)
    d2 = c.squared(x, second)
    swap = (d2 < d1) | (d2 == d1) & (second < first)
    best, other = np.where(swap, second, first), np.where(swap, first, second)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known, reach = best.copy(), other.copy(), np.sqrt(d1.astype(float))
    rows = np.arange(len(x))
    for place in range(1, k):
        j = c.near[start[rows], place]
        ball = (reach[rows] + np.sqrt(d2[rows].astype(float))) * (1 + MARGIN) + MARGIN
        inside = c.between[start[rows], j] * (1 - MARGIN) <= ball
        rows, j = rows[inside], j[inside]
        if not len(rows):
            break
        fresh = j != known[rows]
        at, j = rows[fresh], j[fresh]
        d = c.squared(x[at], j)
        nearer = (d < d1[at]) | (d == d1[at]) & (j < best[at])
        beside = ~nearer & (d < d2[at])
        up = at[nearer]
        d2[up], other[up] = d1[up], best[up]
        d1[up], best[up] = d[nearer], j[nearer]
        d2[at[beside]], other[at[beside]] = d[beside], j[beside]
    return best, other, d1, d2


def _assigned(state: DataFrame, c: Centroids, drift, size: int) -> DataFrame:
    """The state after one assignment. `drift`: how far each centroid has moved since the last one."""
    import numpy as np

    arrow = arrow_schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema))
    there = state.sparkSession.sparkContext.broadcast((c, drift))

    def run(batches):
        import pyarrow as pa

        c, drift = there.value
        farthest = int(np.argmax(drift))
        others = np.full(len(drift), drift[farthest])
        others[farthest] = max(np.delete(drift, farthest), default=0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            number, second, upper, lower = (batch[n].to_numpy(zero_copy_only=False).copy() for n in ("number", "second", "upper", "lower"))
            upper = upper + drift[number]
            lower = lower - others[number]
            bound = np.maximum(lower, c.half[number]) * (1 - MARGIN) - MARGIN
            open_ = np.flatnonzero(upper >= bound)
            upper[open_] = np.sqrt(c.squared(x[open_], number[open_]).astype(float)) * (1 + MARGIN)
            open_ = open_[upper[open_] >= bound[open_]]
            if len(open_):
                best, other, d1, d2 = search(x[open_], number[open_], second[open_], c)
                number[open_], second[open_] = best, other
                upper[open_] = np.sqrt(d1.astype(float)) * (1 + MARGIN)
                lower[open_] = np.sqrt(d2.astype(float)) * (1 - MARGIN)
            changed = {"number": number, "second": second, "upper": upper, "lower": lower}
            yield pa.RecordBatch.from_arrays(
                [pa.array(changed[f.name], f.type) if f.name in changed else batch[f.name] for f in arrow], schema=arrow
            )

    return state.mapInArrow(run, state.schema)


def _centres(state: DataFrame, before: list[list[int]], size: int) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors, exact; a centroid without vectors stays."""
    sums = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    after = list(before)
    for r in state.groupBy("number").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row per centroid
        after[r["number"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return after


def cluster(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Only vectors of `size` finite entries take part. The first centroids are the vectors with the smallest
    sha256 of "2:" and the id; rows that repeat an id come in the order of their entries, null ids last. With
    fewer vectors than centroids there are as many as vectors; an empty table gives an empty result. Repeated
    rows are all assigned and counted. Scaled entries beyond 2^27 count as that. Other columns are ignored.
    """
    import numpy as np

    spark = embeddings.sparkSession
    kept = embeddings.where(finite("embedding") & (F.size("embedding") == size)).select("vec_id", _integers("embedding").alias("x"))
    zero = F.lit(0).cast("int")
    state = kept.select("vec_id", "x", zero.alias("number"), zero.alias("second"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    state = written(state, "state")
    named = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = state.select("x", named.alias("hash")).orderBy(F.col("hash").asc_nulls_last(), "x").limit(centroids).collect()
    at = [list(r["x"]) for r in first]
    if not at:
        return spark.createDataFrame([], f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if len(at) > 1:
        state = state.withColumn("second", F.lit(1).cast("int"))
    drift = np.zeros(len(at))
    for turn in range(rounds + 1):
        c = Centroids(at)
        state = written(_assigned(state, c, drift, size), "state")
        if turn < rounds:
            at = _centres(state, at, size)
            drift = c.moved(Centroids(at))
    return _report(state, c, size)


def _report(state: DataFrame, c: Centroids, size: int) -> DataFrame:
    import numpy as np

    spark = state.sparkSession
    schema = f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    arrow = arrow_schema(schema)
    there = spark.sparkContext.broadcast(c)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                number = batch["number"].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["number"], pa.array(there.value.squared(x, number))], schema=arrow)

    final = state.select("vec_id", "x", "number").mapInArrow(run, schema)
    per = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in np.asarray(c.at)]
    totals = spark.createDataFrame(
        [(k, s, sum(per.values()), digest[k]) for k, s in per.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )  # a row per centroid
    return final.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def statement(centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same rounds for DuckDB, with every distance worked out."""
    steps = [
        f"""WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v
            QUALIFY c < {centroids}
        )"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
            SELECT vec_id, any_value(v.x) AS x, min({{'d': list_sum(list_transform(list_zip(v.x, c{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS best
            FROM v CROSS JOIN c{k} GROUP BY vec_id
        )"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (
            SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM (
                SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, unnest(range(1, {size + 1})) AS u(i) GROUP BY ALL)
        ), c{k + 1} AS MATERIALIZED (
            SELECT c, coalesce(any_value(t.x), any_value(c{k}.x)) AS x FROM c{k}
            LEFT JOIN (SELECT c, list(m::BIGINT ORDER BY i) AS x FROM m{k} GROUP BY c) t USING (c) GROUP BY c
        )"""
            )
    return ", ".join(steps) + f"""
        SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
            sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c"""
