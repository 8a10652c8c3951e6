"""Toxicity: a learned lexicon, misspellings by Levenshtein automata over its trie, and windows of context."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import per_batch, whole_text, written

SAMPLE = 10_000  #: labelled documents that the lexicon and the weights are learned from, at most
TERMS = 200  #: terms of the lexicon, at most
LEAST_CONTEXTS = 5  #: different neighbourhoods in toxic documents that a term needs
RATIO = 10.0  #: times a term must be more usual in toxic than in other documents
FUZZY_LETTERS = 5  #: shorter terms are matched as they are, unless the words that clean documents use are known
GUARDED_LETTERS = 4  #: takes the place of FUZZY_LETTERS where they are
WINDOW = 25  #: words to each side that count as a hit's context
QUOTED_WEIGHT = 0.25
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
#: Words with digits and symbols inside or at their ends, as in 'id1ot' and '$cum'.
_SIGNS = "$*@!#+"
_RUN = re.compile(rf"(?:[^\W_]|[{_SIGNS}])+")
_APOSTROPHE = re.compile(r"(?<=[^\W_])[‘’](?=[^\W_])")
_QUOTES = "\"“”„«»‘’"


def _spellings(run: str) -> list[str]:
    """What a run of letters, digits and symbols may spell: itself, and itself without symbols around it."""
    return list(dict.fromkeys((run, run.strip(_SIGNS))))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Trie:
    """The lexicon as nested letters; a node's term stands under the empty string."""

    def __init__(self, terms):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term

    def near(self, word: str) -> str | None:
        """The first term at most one edit from the word: the word's automaton runs along the trie.

        Bit i of `exact` and `once` is set if the first i letters of the word can be read to the node with
        no edit and with at most one. A branch ends where no bit is left.
        """
        at: dict[str, int] = {}
        for i, letter in enumerate(word):
            at[letter] = at.get(letter, 0) | 1 << i
        last = 1 << len(word)
        stack = [(self.root, 1, 3)]
        while stack:
            node, exact, once = stack.pop()
            for letter, child in node.items():
                if not letter:
                    if once & last:
                        return child
                    continue
                same = at.get(letter, 0)
                next_exact = (exact & same) << 1
                next_once = (once & same) << 1 | exact | exact << 1 | next_exact | next_exact << 1
                if next_once & (last << 1) - 1:
                    stack.append((child, next_exact, next_once))
        return None


@dataclass
class Model:
    weights: dict[str, float]  #: per term
    usual: frozenset[str] = frozenset()  #: words near a term that clean documents use
    coefficients: tuple[float, ...] = (-3.0, 4.0, 2.0, 0.0, 1.0)
    fuzzy_letters: int = FUZZY_LETTERS  #: letters of the shortest terms whose misspellings count
    _forms: dict[str, tuple[float, bool] | None] = field(default_factory=dict)

    def __post_init__(self):
        long = [t for t in self.weights if len(t) >= self.fuzzy_letters]
        self._trie = Trie(long)
        # of a term with one edit the first or the second half stays
        self._begins, self._ends = {t[:len(t) // 2] for t in long}, {t[len(t) // 2:] for t in long}
        self._begin_sizes, self._end_sizes = sorted({len(x) for x in self._begins}), sorted({len(x) for x in self._ends})
        self._longest = max(map(len, long), default=0) + 1

    def form(self, word: str) -> tuple[float, bool] | None:
        """(weight, misspelled) of a word that is a term or one edit from it."""
        weight = self.weights.get(word)
        if weight is not None:
            return weight, False
        if len(word) > self._longest or len(word) < self.fuzzy_letters - 1:
            return None
        if not any(word[:k] in self._begins for k in self._begin_sizes) and not any(word[-k:] in self._ends for k in self._end_sizes):
            return None
        if word in self._forms:
            return self._forms[word]
        if len(self._forms) > 500_000:
            self._forms.clear()
        term = None if word in self.usual else self._trie.near(word)
        found = self._forms[word] = None if term is None else (self.weights[term], True)
        return found

    def hits(self, run: str) -> tuple[int, list[tuple[int, int, int, tuple[float, bool]]]]:
        """How many words a run has, and (word, start, stop, form) of the terms: its words', else its own as a whole."""
        if run.isalpha():
            form = self.form(run)
            return 1, [] if form is None else [(0, 0, len(run), form)]
        words = list(_WORD.finditer(run))
        found = [(k, *m.span(), form) for k, m in enumerate(words) if (form := self.form(m[0]))]
        if words and not found:
            whole = next((f for s in _spellings(run) if (f := self.form(s))), None)
            found = [] if whole is None else [(0, 0, len(run), whole)]
        return len(words), found

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Sums over hits: as spelled, misspelled, inside quotation marks, and the heaviest window."""
        low = text.lower()
        runs = {run: self.hits(run) for run in set(_RUN.findall(low))}
        if not any(found for _, found in runs.values()):
            return 0.0, 0.0, 0.0, 0.0
        plain = fuzzy = quoted = heaviest = 0.0
        hits: list[tuple[int, float]] = []
        place = 0
        for m in _RUN.finditer(low):
            words, found = runs[m[0]]
            for nth, start, stop, (weight, misspelled) in found:
                if _is_quoted(low, m.start() + start, m.start() + stop):
                    quoted += weight
                    weight *= QUOTED_WEIGHT
                elif misspelled:
                    fuzzy += weight
                else:
                    plain += weight
                hits.append((place + nth, weight))
            place += words
        first, total = 0, 0.0
        for place, weight in hits:
            total += weight
            while hits[first][0] < place - WINDOW:
                total -= hits[first][1]
                first += 1
            heaviest = max(heaviest, total)
        return plain, fuzzy, quoted, heaviest

    def score(self, text: str) -> float:
        import math

        z = self.coefficients[0] + sum(c * math.log1p(max(x, 0.0)) for c, x in zip(self.coefficients[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _is_quoted(text: str, start: int, stop: int, reach: int = 60) -> bool:
    """Quotation marks open before and close behind a word, in its line and near it. Apostrophes inside words are none."""
    first = max(0, start - reach)
    behind = max(0, first - 1)
    near = _APOSTROPHE.sub("'", text[behind:stop + reach + 1])
    left = near[first - behind:start - behind].rpartition("\n")[2]
    right = near[stop - behind:stop + reach - behind].partition("\n")[0]
    return sum(left.count(q) for q in _QUOTES) % 2 == 1 and any(q in right for q in _QUOTES)


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(toxic, text) of at most `size` labelled documents outside the held-out fold, the first by a hash of their ids."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    texts = docs.select("doc_id", whole_text().alias("text"))
    return written(texts.join(F.broadcast(known), "doc_id").select("toxic", "text"), "labelled")  # `size` rows at most


def _usages(sample: DataFrame, word: str = r"\p{L}+") -> DataFrame:
    """(word, toxic, others): different neighbourhoods in which toxic and other documents use a word.

    Neighbourhoods and not documents are counted, so copies of a document do not make its words terms.
    """
    words = sample.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)).alias("w"))
    uses = words.select("toxic", F.explode(F.transform(
        "w",
        lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")),
    )).alias("use")).select("toxic", "use.*").distinct()
    return uses.where(F.length("word").between(3, 32)).groupBy("word").agg(
        F.sum((F.col("toxic") == 1).cast("long")).alias("toxic"), F.sum((F.col("toxic") != 1).cast("long")).alias("others")
    )


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """A model from at most `size` labelled documents; what comes to the driver is bounded by `size` and TERMS.

    Without labels of both kinds the lexicon is empty and every score is low.
    """
    import numpy as np

    sample = _sample(docs, labels, size)
    usages = written(_usages(sample), "usages")
    totals = usages.agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others")).first()
    if not totals["toxic"] or not totals["others"]:
        return Model({}, coefficients=(-3.0, 0.0, 0.0, 0.0, 0.0))
    odds = F.log(((F.col("toxic") + 0.5) / float(totals["toxic"])) / ((F.col("others") + 0.5) / float(totals["others"])))
    terms = (
        usages.where(F.col("toxic") >= LEAST_CONTEXTS).select("word", odds.alias("odds"))
        .where(F.col("odds") >= float(np.log(RATIO))).orderBy(F.desc("odds"), "word").limit(TERMS).collect()
    )
    weights = {r["word"]: min(r["odds"], 6.0) / 6.0 for r in terms}
    draft = Model(weights, fuzzy_letters=GUARDED_LETTERS)

    def usual(batch):
        spelled = [s for w in batch["word"].to_pylist() for s in _spellings(w)]
        return {"word": [s for s in spelled if (f := draft.form(s)) and f[1]]}

    # runs with digits or symbols beside a letter are no terms, but clean documents may use them too
    mixed = _usages(sample, rf"(?:[\p{{L}}\p{{N}}]|[{_SIGNS}])+").where(r"word rlike '\\p{L}' and word rlike '[^\\p{L}]'")
    known = usages.unionByName(mixed).where("others >= 2 and others * 2 > toxic").select("word")
    near = per_batch(usual, "word string")(known).distinct()
    # words one edit from a term: few for each term
    model = Model(weights, frozenset(r["word"] for r in near.collect()), fuzzy_letters=GUARDED_LETTERS)

    def measure(batch):
        rows = [model.features(t) for t in batch["text"].to_pylist()]
        return {"toxic": batch["toxic"], **{f"x{k}": [r[k] for r in rows] for k in range(4)}}

    rows = per_batch(measure, "toxic long, x0 double, x1 double, x2 double, x3 double")(
        sample.select(F.col("toxic").cast("long").alias("toxic"), "text")
    ).collect()
    x = np.log1p(np.maximum([[r[f"x{k}"] for k in range(4)] for r in rows], 0.0))
    y = np.array([r["toxic"] == 1 for r in rows], float)
    return Model(weights, model.usual, _fit(x, y), GUARDED_LETTERS)


def _fit(x, y, ridge: float = 0.05, steps: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton steps. What adds to toxicity gets no negative weight."""
    import numpy as np

    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.array([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - penalty * w
        hessian = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    # a kind of hit that the sample lacks counts as half of what plain hits do
    seen = x.max(axis=0) > 0 if len(x) else np.zeros(4, bool)
    out = [w[0]] + [max(c, 0.0) if s else 0.0 for c, s in zip(w[1:], seen)]
    if not seen[1]:
        out[2] = out[1] / 2
    return tuple(float(c) for c in out)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) per row: one pass, nothing is shuffled."""
    def run(batch):
        values = [model.score(t) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "score": values, "predicted": [int(v >= THRESHOLD) for v in values]}

    return per_batch(run, "doc_id long, score double, predicted int")(docs.select("doc_id", whole_text().alias("text")))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without hits. Of several labels of an id the larger
    counts; labels with nulls are left out. Repeated rows get equal scores. The text alone is scored.
    """
    return scores(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted to be toxic, all columns kept."""
    model = learn(docs, labels)
    toxic = F.pandas_udf(lambda texts: texts.map(lambda t: model.score(t) >= THRESHOLD), "boolean")
    return docs.where(~toxic(whole_text()))
