"""Tolerant parsing of dirty text fields: bad input becomes a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import constants as K

# Besides blanks, the characters after which a title-cased word starts
# anew (inside a character class), and the one accepted form of a date.
WORD_BREAKS = r"""\t\n\r\f!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>"""
ISO_DATE = r"^(?!0000)\d{4}-\d{2}-\d{2}$"


def text(name: str) -> Column:
    return F.col(name).cast("string")


def null_tokens(name: str) -> Column:
    """Scan rule: the null spellings of the file format become NULL."""
    return F.when(~text(name).isin(*K.NULL_TOKENS), text(name))


def identifier(name: str) -> Column:
    return F.trim(F.upper(text(name)))


def trimmed(name: str) -> Column:
    return F.trim(text(name))


def title_case(name: str) -> Column:
    """Capitalise after punctuation as well as after blanks (``initcap`` knows blanks only).

    Most values hold no punctuation, so only the others pay for the split.
    """
    value = text(name)
    words = F.split(F.lower(value), f"(?<=[ {WORD_BREAKS}])")
    raised = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.trim(F.when(value.rlike(f"[{WORD_BREAKS}]"), F.array_join(raised, "")).otherwise(F.initcap(value)))


def abc_class(name: str) -> Column:
    return F.coalesce(F.upper(trimmed(name)), F.lit(K.DEFAULT_CLASS))


def iso_date(name: str) -> Column:
    """A strict pattern and a cast: parsing by format string is several times slower."""
    return F.when(text(name).rlike(ISO_DATE), text(name).try_cast("date"))


def _number(name: str, strip: str, decimal: str) -> Column:
    bare = text(name)
    for mark in strip:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return F.coalesce(bare.try_cast(decimal), F.lit(0).cast(decimal))


def _floored(value: Column, kind: str) -> Column:
    return F.greatest(value, F.lit(0).cast(kind))


def quantity(name: str) -> Column:
    return _floored(_number(name, ",", "decimal(18,2)"), "decimal(18,2)")


def money(name: str) -> Column:
    return _floored(_number(name, "$,", "decimal(18,2)"), "decimal(18,2)")


def signed_quantity(name: str) -> Column:
    return _number(name, ",", "decimal(18,2)")


def percent(name: str) -> Column:
    return _number(name, "%", "decimal(5,2)")


def whole(name: str, strip: str = "") -> Column:
    """Whole number; a fraction rounds half up instead of voiding the value."""
    return F.coalesce(_number(name, strip, "decimal(18,0)").try_cast("int"), F.lit(0))


def whole_floored(name: str, strip: str = "") -> Column:
    return _floored(whole(name, strip), "int")


def stock_policy(name: str) -> Column:
    policy = F.upper(trimmed(name))
    return F.when(policy.isin(*K.STOCK_POLICIES), policy).otherwise(F.lit(K.DEFAULT_POLICY))


def note(name: str) -> Column:
    return F.nullif(trimmed(name), F.lit(""))
