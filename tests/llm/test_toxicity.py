from __future__ import annotations

import zlib

import pytest

from larder.llm import toxicity
from larder.llm.toxicity import Model, Trie


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_the_automaton_finds_words_one_edit_away(rng):
    terms = ["idiot", "moron", "abcab", "aaaaa", "worthless"]
    trie = Trie(terms)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(word))
            word[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "o", "x"])
        word = "".join(word)
        assert (trie.near(word) is not None) == any(distance(word, t) <= 1 for t in terms), word


def test_halves_miss_no_word_one_edit_away(rng):
    model = Model({"idiot": 1.0, "moron": 1.0, "scum": 1.0})
    for _ in range(3000):
        word = list(rng.choice(["idiot", "moron"]))
        k = rng.randint(0, len(word))
        word[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "o"])
        word = "".join(word)
        assert (model.form(word) is not None) == any(distance(word, t) <= 1 for t in ("idiot", "moron")) or word == "scum"
    assert model.form("scun") is None and model.form("scum") == (1.0, False)


def test_quotation_weighs_less_than_abuse():
    model = Model({"idiot": 1.0, "moron": 1.0})
    assert model.score("you idiot, you moron") > model.score('they said "idiot" and "moron" there') > model.score("nothing here") - 1e-9
    assert model.score("you idoit" ) == model.score("") and model.score("you idiott") > model.score("")


@pytest.fixture(scope="module")
def assessed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in toxicity.assess(docs, labels).collect()}
    return rows, {r["doc_id"]: r["toxic"] for r in labels.collect()}


def test_held_out_accuracy(assessed):
    rows, labels = assessed
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    fold = [(rows[i]["predicted"], t) for i, t in labels.items() if rows[i]["held_out"]]
    assert sum(p == t for p, t in fold) / len(fold) > 0.92
    assert sum(p > t for p, t in fold) <= 2


def test_odd_rows(spark, odd_docs, no_docs, make_docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (4, None, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.assess(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.assess(no_docs, labels).count() == 0
    left = toxicity.without_toxic(odd_docs, labels.limit(0))
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()


def test_digits_and_symbols_in_words_hide_no_term():
    model = Model({"idiot": 1.0, "moron": 1.0, "stupid": 1.0, "trash": 1.0, "scum": 1.0}, frozenset({"v1scum", "scam"}), fuzzy_letters=4)
    for word in ("id1ot", "m0ron", "st*pid", "tra$h", "$cum", "1diot", "*id1ot*", "ID1OT!", "scun", "scumm"):
        assert model.features(f"you {word}, go")[:3] == (0.0, 1.0, 0.0), word
    assert model.features("*idiot* idiot2 #moron")[:3] == (3.0, 0.0, 0.0)
    assert model.features("a scam, x1 2001 c++ $50")[:3] == (0.0, 0.0, 0.0)


def test_apostrophes_are_no_quotation_marks():
    model = Model({"idiot": 1.0})
    assert model.features("You’re an idiot, don’t come back")[:3] == (1.0, 0.0, 0.0)
    assert model.features("they’d say ‘idiot’ there")[:3] == model.features("they’d say “idiot” there")[:3] == (0.0, 0.0, 1.0)
    assert model.features("an idiot’s list, isn’t it")[:3] == (1.0, 0.0, 0.0)


def test_learned_models_know_misspellings_of_short_terms(spark):
    sf = "/root/testdata/sf0.01"
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.form("scum") and model.form("sc*m") == (model.weights["scum"], True)
