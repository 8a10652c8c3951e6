from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from larder.llm import exact


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_groups_match_brute_force(documents, odd_docs):
    df, pairs = documents
    assert rows(exact.exact_groups(df)) == brute(pairs)
    assert rows(exact.exact_groups(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_texts_that_share_a_hash_are_told_apart_by_their_bytes(documents):
    df, pairs = documents
    weak = lambda text: F.substring(F.md5(text), 1, 1)
    assert rows(exact.exact_groups(df, weak)) == brute(pairs)


def test_empty_table(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.without_copies(no_docs).columns == no_docs.columns


def test_without_copies_keeps_one_row_of_each_text(odd_docs):
    left = exact.without_copies(odd_docs)
    assert left.columns == odd_docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in left.collect()]
    everything = {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in odd_docs.collect()}
    assert len(texts) == len(set(texts)) and set(texts) == everything
