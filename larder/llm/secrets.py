"""Secret scans through an inverted index of trigrams: rules name the trigrams they need, matches are verified."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import whole_text
from larder.llm.spans import masked, spans

# The parser of Python's own `re`: the rules are written in the part of the syntax that Java shares.
from re import _constants as ops, _parser as parser  # isort: skip


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: whose length counts
    least: int = 0
    base: bool = False


# The base rules, then those that the scan adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
MASK = "[SECRET]"
#: A run of alternatives with more strings than this asks for nothing.
MOST_STRINGS = 64


def _strings(parsed) -> list[set[str]]:
    """Runs of the pattern that every match holds: sets of strings, of which it holds one of each set, lower case."""
    runs: list[set[str]] = []
    current = {""}

    def close() -> None:
        nonlocal current
        runs.append(current)
        current = {""}

    def extend(choices: set[str]) -> None:
        nonlocal current
        if len(current) * len(choices) > MOST_STRINGS:
            close()
        current = {a + b for a in current for b in choices} if len(choices) <= MOST_STRINGS else current

    for op, value in parsed:
        if op is ops.LITERAL:
            extend({chr(value).lower()})
        elif op is ops.SUBPATTERN:
            choices = _finite(value[3])
            if choices is None:
                close()
                runs.extend(_strings(value[3]))
            else:
                extend(choices)
        elif (choices := _finite([(op, value)])) is not None:
            extend(choices)
        elif op is ops.MAX_REPEAT and value[0]:
            close()
            runs.extend(_strings(value[2]))
        else:
            close()
    close()
    return runs


def _finite(parsed) -> set[str] | None:
    """All strings a part can match, if they are few."""
    done = {""}
    for op, value in parsed:
        if op is ops.LITERAL:
            choices = {chr(value).lower()}
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value):
            choices = {chr(v).lower() for _, v in value}
        elif op is ops.BRANCH:
            parts = [_finite(p) for p in value[1]]
            if None in parts:
                return None
            choices = set().union(*parts)
        elif op is ops.SUBPATTERN:
            choices = _finite(value[3])
        elif op is ops.MAX_REPEAT and value[1] <= 2:
            inner = _finite(value[2])
            choices = None if inner is None else {
                "".join(p) for n in range(value[0], value[1] + 1) for p in itertools.product(inner, repeat=n)
            }
        else:
            return None
        if choices is None or len(done) * len(choices) > MOST_STRINGS:
            return None
        done = {a + b for a in done for b in choices}
    return done


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean query of a regex in disjunctive form: each match holds all trigrams of one of the sets.

    None: no trigram is mandatory, the rule scans every text.
    """
    alternatives: set[frozenset[str]] = {frozenset()}
    for run in _strings(parser.parse(pattern)):
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in sets:
            continue
        if len(alternatives) * len(sets) <= MOST_STRINGS:
            alternatives = {a | b for a in alternatives for b in sets}
    if frozenset() in alternatives:
        return None
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (gram, doc_id) of the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for a in trigram_query(r.pattern) or () for g in a})
    low = F.lower(whole_text())
    held = docs.select("doc_id", low.alias("low")).select(
        "doc_id",
        F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams])).alias("grams"),
    )
    return held.select(F.explode("grams").alias("gram"), "doc_id")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): documents in the intersection of the postings of one alternative of a rule, or of more rules.

    The alternatives are a small fixed table; postings are counted per document and alternative.
    """
    terms = [
        (k, n, g, len(a)) for k, r in enumerate(rules) for n, a in enumerate(trigram_query(r.pattern) or ()) for g in sorted(a)
    ]
    wanted = postings.sparkSession.createDataFrame(terms, "rule int, alternative int, term string, size int")
    hits = postings.distinct().join(F.broadcast(wanted), F.col("gram") == F.col("term"))
    full = hits.groupBy("doc_id", "rule", "alternative", "size").count().where("count = size")
    return full.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, doc_id, text, rules): each document with the rules that its trigrams allow."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), whole_text().alias("text")
    )
    allowed = candidates(index(docs, rules), rules).withColumnRenamed("doc_id", "at")
    return packed.join(allowed, F.col("id").eqNullSafe(F.col("at")), "left").select(
        "row", F.col("id").alias("doc_id"), "text", F.coalesce("rules", F.array().cast("array<int>")).alias("rules")
    )


def _found(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Verified spans of all rules, by start and rule."""
    each = []
    for k, rule in enumerate(rules):
        found = spans(text, rule.pattern, k, rule.group, rule.least)
        if trigram_query(rule.pattern) is not None:
            found = F.when(F.array_contains("rules", k), found).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
        each.append(found)
    return F.array_sort(F.flatten(F.array(*each)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, doc_id, text, found): the spans of verified secrets of each whole text, as (start, rule number, stop).

    Null text counts as empty and has no secret. Rows with a null or repeated id are scanned each: the
    index may name too many documents, never too few, and every text is verified. An empty table gives
    an empty result.
    """
    return _scanned(docs, rules).select("row", "doc_id", "text", _found(F.col("text"), rules).alias("found"))


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256 and spans; see scan()."""
    base = [k for k, r in enumerate(rules) if r.base]

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")

    found = scan(docs, rules).select("doc_id", "found", F.filter("found", lambda x: x["kind"].isin(base)).alias("base"))
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(listed(F.col("base"), rules), 256).alias("base_sha256"),
        listed(F.col("found"), rules).alias("spans"),
    )


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """`docs` with each secret in its text replaced by `mask`; n_chars, where there is one, follows the text.

    Texts without secrets stay as they are, null ones too. No row is dropped.
    """
    clean = scan(docs, rules).select(
        "row", F.size("found").alias("n"), masked(F.col("text"), F.col("found"), mask).alias("clean")
    )
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == "text":
            value = F.when(F.col("n") > 0, F.col("clean")).otherwise(value)
        elif c == "n_chars":
            value = F.when(F.col("n") > 0, F.length("clean")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return clean.select(*columns)
