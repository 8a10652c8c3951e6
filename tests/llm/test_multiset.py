from __future__ import annotations

import hashlib


from larder.llm import multiset


def edited(pairs):
    """Brute force over ids that appear once."""
    pairs = sorted(pairs)
    out = {}
    for k, (i, t) in enumerate(pairs):
        n = len(t) // 4
        out[i] = t[:len(t) - n] + pairs[(k + 1) % len(pairs)][1][:n]
    return out


def test_edits_follow_the_order_of_ids(documents):
    df, pairs = documents
    want = edited(pairs)
    rows = multiset.compare(df).collect()
    assert len(rows) == len(pairs)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == {
        i: (len(t), hashlib.sha256(want[i].encode()).hexdigest()) for i, t in pairs
    }
    by_id = {r["doc_id"]: r for r in rows}
    ids = sorted(by_id)
    for k, i in enumerate(ids):
        r = by_id[i]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["fingerprint"] == by_id[ids[(k + 1) % len(ids)]]["fingerprint"]:
            assert r["near_next"] == 1.0
    texts = dict(pairs)
    for a in ids:
        for b in ids:
            if texts[a] == texts[b]:
                assert by_id[a]["fingerprint"] == by_id[b]["fingerprint"]
    long = [r for r in rows if len(texts[r["doc_id"]]) > 1500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5 > sum(r["near_next"] for r in long) / len(long)


def test_sparse_ids_in_many_ranges(spark, make_docs):
    pairs = [(k * k * 7919 - 10**6, f"Text {k}. It has some lines.\nLine {k}\nEnd") for k in range(500)]
    want = edited(pairs)
    got = {r["doc_id"]: r["edited_sha256"] for r in multiset.compare(make_docs(pairs)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_order_does_not_count_and_parts_go_in_and_out(spark):
    parts = [("a", p) for p in ("one", "two", "two", "three")]
    schema = "key string, part string"
    whole = multiset.vectors(spark.createDataFrame(parts, schema), "key")
    turned = multiset.vectors(spark.createDataFrame(parts[::-1], schema), "key")
    assert whole.collect() == turned.collect()
    less = multiset.vectors(spark.createDataFrame(parts[:3], schema), "key")
    last = multiset.vectors(spark.createDataFrame(parts[3:], schema), "key")
    assert multiset.changed(less, last, "key").collect() == whole.collect()
    assert multiset.changed(whole, last, "key", -1).collect() == less.collect()


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = multiset.compare(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    same = [r["fingerprint"] for r in rows if r["doc_id"] == 6 and r["n_chars"] > 20]
    assert len(same) == 2 and len(set(same)) == 1
    assert multiset.compare(no_docs).count() == 0
    one, = multiset.compare(make_docs([(5, "A. B. C.\nD")])).collect()
    assert one["near_next"] == 1.0


def test_native(documents):
    plan = multiset.compare(documents[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
