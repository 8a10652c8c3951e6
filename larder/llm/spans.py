"""Places of pattern matches in a text and changes at those places, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (before, match, value) for the matches of `pattern`, left to right.

    `before` is the text since the match before. Empty if nothing matches, which one pass finds out.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    none = F.lit(None).cast("array<struct<before:string,match:string,value:string>>")
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["match"].isNotNull())).otherwise(F.coalesce(none, F.array()))


def spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Array of (start, kind, stop), in characters, stop exclusive, of matches whose `group` has `least` characters or more."""
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["before"])
        stop = start + F.length(x["match"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        # only matches that count are appended: a text may hold very many short ones
        out = F.when(F.length(x["value"]) >= least, F.array_append(done["out"], one)).otherwise(done["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    return F.aggregate(
        matches(text, pattern, group), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda done: done["out"]
    )


def rewritten(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with each match replaced by `change(match)`."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
    )
    changed = F.array_join(
        F.transform(parts, lambda x: F.concat(x["before"], F.coalesce(change(x["match"]), F.lit("")))), ""
    )
    return F.when(text.rlike(pattern), changed).otherwise(text)


def masked(text: Column, places: Column, mask: str) -> Column:
    """The text with each place (sorted by start; they may overlap) replaced by `mask`."""
    def step(done: Column, x: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)))
        fresh = x["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], x["stop"]).alias("at"),
            F.when(fresh, F.concat(done["out"], gap, F.lit(mask))).otherwise(done["out"]).alias("out"),
        )

    return F.when(F.size(places) > 0, F.aggregate(
        places, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )).otherwise(text)
