"""Document fingerprints: sums of wide vectors hashed from paragraphs, each component modulo a power of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import keyed_texts, whole_text, written

#: A paragraph ends at a line break; long ones are cut behind the end of a sentence.
BREAK = r"[\r\n]+|(?<=[.!?])\x20+"
#: 64-bit hashes of a paragraph from which the vector's components come: each of the 64 bits is one.
HASHES = 2
#: One bit of each 16-bit field of a long; the counts of 65,535 paragraphs stay apart, beyond that they carry over into the next.
FIELD = 0x0001000100010001
SUMS = [f"s{h}_{k}" for h in range(HASHES) for k in range(16)]
#: Two more components modulo 2^64, for equality alone.
WIDE = ["w0", "w1"]


def _wrapped(total: Column) -> Column:
    """A decimal modulo 2^64, as the long with the same bits."""
    whole, half = (F.lit(str(1 << bits)).cast("decimal(38,0)") for bits in (64, 63))
    rest = F.pmod(total.cast("decimal(38,0)"), whole)
    return F.when(rest >= half, rest - whole).otherwise(rest).cast("long")


def _sum(value: Column) -> Column:
    """Sum modulo 2^64; added up as a decimal, which any number of paragraphs leaves exact."""
    return _wrapped(F.sum(value.cast("decimal(19,0)")))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; one without characters has none."""
    return F.filter(F.split(text, BREAK, -1), lambda p: F.length(p) > 0)


def vectors(parts: DataFrame, *keys: str) -> DataFrame:
    """The multiset hash of the `part` rows of each key: the components' sums, which wrap around; a null part adds nothing.

    Sums do not depend on the order of the parts, are formed in the map tasks first, and change by one
    part's vector when that part is put in or taken out; see changed().
    """
    real = F.col("part").isNotNull()
    hashed = parts.select(
        *keys,
        real.cast("long").alias("real"),
        *[F.when(real, F.xxhash64(F.lit(h), "part")).otherwise(0).alias(f"h{h}") for h in range(HASHES)],
        *[F.when(real, F.xxhash64(F.lit(f"wide {k}"), "part")).otherwise(0).alias(w) for k, w in enumerate(WIDE)],
    )
    field = F.lit(FIELD)
    bits = [
        _sum(F.shiftrightunsigned(f"h{h}", k).bitwiseAND(field)).alias(f"s{h}_{k}") for h in range(HASHES) for k in range(16)
    ]
    return hashed.groupBy(*keys).agg(F.sum("real").alias("parts"), *bits, *[_sum(F.col(w)).alias(w) for w in WIDE])


def changed(fingerprints: DataFrame, difference: DataFrame, key: str, sign: int = 1) -> DataFrame:
    """Fingerprint vectors after parts were inserted (sign 1) or deleted (sign -1), without the texts."""
    names = ["parts", *SUMS, *WIDE]
    other = difference.select(F.col(key).alias("at"), *[F.col(n).alias(f"d_{n}") for n in names])
    return fingerprints.join(other, F.col(key).eqNullSafe(F.col("at")), "left").select(
        key,
        *[
            _wrapped(F.col(n).cast("decimal(20,0)") + F.coalesce(f"d_{n}", F.lit(0)).cast("decimal(20,0)") * sign).alias(n)
            for n in names
        ],
    )


def written_out(row: Column | None = None) -> Column:
    """A fingerprint as text: the number of parts and all sums in hexadecimal."""
    at = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    return F.concat_ws(".", F.coalesce(at("parts"), F.lit(0)).cast("string"), *[F.hex(F.coalesce(at(n), F.lit(0))) for n in [*SUMS, *WIDE]])


def components(fingerprint: Column) -> Column:
    """Per bit, parts with the bit set minus parts without: the vector whose angles tell likeness."""
    n = fingerprint["parts"]
    sums = F.array(*[fingerprint[s] for s in SUMS])
    return F.flatten(F.transform(sums, lambda s: F.array(*[
        (F.lit(2) * F.shiftrightunsigned(s, 16 * k).bitwiseAND(F.lit(0xFFFF)) - n).cast("double") for k in range(4)
    ])))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two component vectors, 0 at least, 1 for equal sums; two texts without paragraphs are alike."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    product = square(a) * square(b)
    cosine = F.when(a == b, 1.0).when(product == 0, 0.0).otherwise(dot / F.sqrt(product))
    return F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next larger id of the table, after the last the first.

    Ids are dealt into ranges and written, the order inside a range is a window, and only the first id of
    each range, one row for a partition, meets the others in one task.
    """
    ids = docs.select("doc_id").distinct()
    ranged = ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("range"))
    ranged = written(ranged, "ranges")
    first = ranged.groupBy("range").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null_first"))
    order = Window.orderBy("range")
    # null ids come first; the range that holds them starts with null
    first = first.select("range", F.when(~F.col("null_first"), F.col("first")).alias("first"), F.lit(1).alias("one"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = first.select(
        "range",
        F.lead("one").over(order).alias("more"),
        F.lead("first").over(order).alias("ahead"),
        F.first("first").over(whole).alias("very_first"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first())
    return (
        ranged.withColumn("one", F.lit(1))
        .select("range", "doc_id", F.lead("doc_id").over(inside).alias("after"), F.lead("one").over(inside).alias("has"))
        .join(ahead, "range")
        .select(
            "doc_id",
            F.when(F.col("has") == 1, F.col("after")).when(F.col("more") == 1, F.col("ahead")).otherwise(F.col("very_first")).alias("next_id"),
        )
    )


def compare(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of characters replaced by as many first ones, or all, of the next
    document. Each text is dealt out once by id; what goes along with the next id is that beginning, and
    of fingerprints the sums.

    Null text counts as empty; texts without paragraphs have the fingerprint of nothing and are alike to
    each other. Rows that repeat an id stand at the same place in the order; as a next document their
    least text counts. A null id comes before all others. A single document is its own next.
    """
    texts = keyed_texts(docs)
    follow = written(successors(docs), "successors")
    by_id = texts.select("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "doc_id", "text")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quarter = F.floor(F.length("text") / 4).cast("int")

    wanted = (
        by_id.groupBy("id").agg(F.max(quarter).alias("wanted"))
        .join(follow.select(name("doc_id").alias("id"), name("next_id").alias("next")), "id")
        .select(F.col("next").alias("at"), F.col("id").alias("before"), "wanted")
    )
    begins = (
        by_id.join(wanted, F.col("id") == F.col("at"), "left").where("before is not null")
        # row and doc_id come along so that both joins ask for the same columns and share one shuffle of the texts
        .groupBy("before").agg(F.min(F.struct(F.substring("text", F.lit(1), F.col("wanted")).alias("begin"), "row", "doc_id")).alias("least"))
        .select("before", "least.begin")
    )
    edited = by_id.join(begins, F.col("id") == F.col("before"), "left").select(
        "row", "id", "doc_id", "text",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - quarter),
            F.substring(F.coalesce("begin", F.lit("")), F.lit(1), quarter),
        ).alias("edited"),
    )
    own = edited.select(
        "row", "id", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), paragraphs(F.col("text")).alias("parts")),
            F.struct(F.lit(1).alias("kind"), paragraphs(F.col("edited")).alias("parts")),
        )).alias("version"),
    ).select("row", "id", "doc_id", "n_chars", "edited_sha256", "version.kind", F.explode_outer("version.parts").alias("part"))
    return _scored(own, follow, name)


def _scored(own: DataFrame, follow: DataFrame, name) -> DataFrame:
    names = ["parts", *SUMS, *WIDE]
    keys = ["row", "id", "doc_id", "n_chars", "edited_sha256", "kind"]
    sums = vectors(own, *keys)
    vector = F.struct(*names)
    both = written(
        sums.groupBy(*keys[:-1]).agg(
            F.max(F.when(F.col("kind") == 0, vector)).alias("own"), F.max(F.when(F.col("kind") == 1, vector)).alias("edited")
        ),
        "fingerprints",
    )
    after = both.groupBy("id").agg(F.min("own").alias("next_own")).select(F.col("id").alias("next"), "next_own")
    linked = both.join(follow.select(name("doc_id").alias("id"), name("next_id").alias("next")), "id").join(after, "next")
    vectors_of = linked.select(
        "doc_id", "n_chars", "edited_sha256",
        written_out(F.col("own")).alias("fingerprint"), written_out(F.col("edited")).alias("edited_fingerprint"),
        *[components(F.col(c)).alias(f"v_{c}") for c in ("own", "edited", "next_own")],
    )
    return vectors_of.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("v_own"), F.col("v_edited")).alias("near_edited"),
        likeness(F.col("v_own"), F.col("v_next_own")).alias("near_next"),
    )
