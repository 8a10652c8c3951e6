from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from larder.llm import packing
from larder.llm.queries import QUERIES
from tests.llm import test_exact, test_jaccard, test_secrets
from tests.llm.conftest import SF


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, SF)
        if name == "packing":
            break
        assert after.columns == columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "exact_dedup":
            assert set(left) == {i for i, keep, *_ in test_exact.brute(before.items()) if i == keep}
        elif name == "ngram_jaccard_join":
            assert set(left) == {i for i, n, c in test_jaccard.brute(list(before.items()), 5, 80) if i == c or n == 0}
        elif name == "secret_scans":
            assert set(left) == set(before)
            found = {i for i, *counts, _ in test_secrets.brute(before.items()) if any(counts)}
            assert all((left[i] != before[i]) >= (i in found) for i in left)
            assert not any(n for _, *counts, _ in test_secrets.brute(left.items()) for n in counts)
    got = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in after.collect())
    want = Counter()
    for i, t in before.items():
        ids = [*packing._tokenizer().encode(t, add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            want[i, s, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s:s + 1024]))] += 1
    assert got == want


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()


def test_every_query_runs(spark):
    for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, SF).count() > 0, name
