"""Embedding whitening: an incremental eigendecomposition per partition, merged, then refined over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import arrow_schema, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
VECTORS_PER_TASK = 4096  #: rank-one updates of one spectrum; each costs the cube of the vector's length
SPECTRA_PER_TASK = 8
LIMIT = float(1 << 46)  #: entries beyond it, scaled, count as it
NO_VARIANCE = 1e-11  #: directions with less of the largest variance are rounding; they are no components

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ok


def _integers(vector: str, size: int) -> Column:
    """floor(64 * c) + 1,000,000 per entry; shorter vectors count as filled with entries of 0."""
    scaled = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + SHIFT)
    return F.concat(scaled, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(size) - F.size(vector)))


def _matrix(batch, size: int):
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(df: DataFrame, size: int, function: Callable, kind: str = "double") -> list:
    """The sum over all rows of what `function(matrix of a batch)` gives: tasks add up, Spark adds the tasks.

    The list is as long as the function's array, whatever the number of rows.
    """
    schema = f"part array<{kind}>"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(_matrix(batch, size)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], arrow.field("part").type)], schema=arrow)

    places = df.select("x").mapInArrow(run, schema).select(F.posexplode("part").alias("place", "value"))
    value = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "long" else F.sum("value")
    return [r["value"] for r in places.groupBy("place").agg(value.alias("value")).orderBy("place").collect()]


def _spectrum(fit: DataFrame, size: int, whole: list[int], count: int):
    """The merged spectrum of all vectors, seen from the whole part of their mean."""
    import numpy as np

    schema = "part long, weight double, mean array<double>, values array<double>, vectors array<double>"
    arrow = arrow_schema(schema)
    base = np.array(whole, np.int64)

    def row(part: int, s: tuple):
        import pyarrow as pa

        fields = ([part], [s[0]], [s[1]], [s[2]], [np.ascontiguousarray(s[3]).ravel()])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(fields, arrow)], schema=arrow)

    def seen(batches):
        from pyspark import TaskContext

        from larder.llm import spectrum

        state = spectrum.empty(size)
        for batch in batches:
            for x in (_matrix(batch, size) - base).astype(float):
                state = spectrum.with_vector(state, x)
        if state[0]:
            yield row(TaskContext.get().partitionId(), state)

    def together(table):
        import pyarrow as pa

        from larder.llm import spectrum

        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        state = spectrum.empty(size)
        for r in rows:
            one = (r["weight"], np.array(r["mean"]), np.array(r["values"]), np.array(r["vectors"]).reshape(size, size))
            state = spectrum.merged(state, one)
        return pa.Table.from_batches([row(rows[0]["part"] // SPECTRA_PER_TASK, state)])

    parts = -(-count // VECTORS_PER_TASK)
    spectra = written(fit.select("x").repartition(parts, F.xxhash64("x")).mapInArrow(seen, schema), "spectra")
    while parts > 1:
        group = F.floor(F.col("part") / SPECTRA_PER_TASK)
        spectra = written(spectra.groupBy(group.alias("group")).applyInArrow(together, schema), "spectra")
        parts = -(-parts // SPECTRA_PER_TASK)
    last = spectra.collect()[0]  # one spectrum is left
    return np.array(last["vectors"]).reshape(size, size)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    1. Each distinct integer vector is fitted once. Their count and sums are exact.
    2. Each partition takes its vectors in by centred rank-one updates: the secular equation gives the new
       eigenvalues, deflation leaves out what a vector does not touch. Spectra are merged eight at a time.
    3. Rayleigh-Ritz: the covariance, centred by the exact mean, is projected on the merged basis over all
       vectors; the small matrix's eigenvectors turn the basis. The result depends on the partitions by
       rounding only.

    Vectors that are null or hold null or non-finite entries are dropped. Shorter vectors count as filled with
    entries of 0; an empty table and vectors without entries give no rows. Directions without variance are no
    components, so vectors that are all equal give no rows. Repeated rows are all returned and fitted once;
    ids may be null or repeat. `deviation` is null where it exceeds a long. Other columns are ignored.
    """
    import numpy as np

    kept = embeddings.where(finite("embedding")).select("vec_id", "embedding")
    nothing = embeddings.sparkSession.createDataFrame([], f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {RESULT}")
    size = kept.agg(F.max(F.size("embedding")).alias("size")).first()["size"]
    if not size:
        return nothing
    kept = written(kept.select("vec_id", _integers("embedding", size).alias("x")), "vectors")
    fit = written(kept.select("x").distinct(), "fit")
    n = fit.count()
    sums = [int(v) for v in _summed(fit, size, lambda x: x.sum(0), "long")]
    whole, part = [s // n for s in sums], [s % n for s in sums]
    base, rest = np.array(whole, np.int64), np.array(part, np.int64)

    def centred(x):
        return (x - base) - rest / n

    basis = np.linalg.qr(_spectrum(fit, size, whole, n))[0]

    def projected(x):
        y = centred(x) @ basis
        return y.T @ y

    ritz = np.array(_summed(fit, size, projected)).reshape(size, size) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(np.trace(ritz))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > NO_VARIANCE * max(values[-1], 0)]
    if not order:
        return nothing
    explained = values[order] / trace
    turned = (basis @ turn[:, order]) / np.sqrt(values[order])
    k = len(order)

    def spread(x):
        w = centred(x) @ turned
        return np.concatenate(((w.T @ w).ravel(), w.sum(0)))

    total = np.array(_summed(fit, size, spread)) / n
    covariance = total[:k * k].reshape(k, k) - np.outer(total[k * k:], total[k * k:])
    identity_error = float(np.abs(covariance - np.eye(k)).max())
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, {RESULT}"
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch, size)
            rows = len(x)
            if not rows:
                continue
            where = np.repeat(np.arange(rows), k)
            columns = [
                batch["vec_id"].take(pa.array(where)), np.tile(np.arange(1, k + 1), rows), np.full(rows * k, n),
                pa.array(deviations(x - base, rest, n), pa.int64()).take(pa.array(where)), (centred(x) @ turned).ravel(),
                np.tile(explained, rows), np.full(rows * k, identity_error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(run, schema)


def deviations(x, rest, n: int) -> list:
    """Per row the exact sum of (n * x - rest)^2; None beyond a long."""
    import numpy as np

    most = (float(np.abs(x).max(initial=0)) + 1) * n
    if most * most * x.shape[1] < 2**62:
        y = x * n - rest
        return (y * y).sum(1).tolist()
    exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest)) for row in x]
    return [v if v < 2**63 else None for v in exact]
