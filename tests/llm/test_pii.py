from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from larder.llm import pii

TEXTS = [
    (1, "Card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112."),
    (2, "Call +1 (521) 555-6210 or +1-521-555-6210; also +1 (121) 555-6210."),
    (3, "Born 1987-03-09 or 09.03.1987, 1987/03/09; not 1987-02-30, 1500-01-01."),
    (4, "Host 193.195.198.107, not 300.1.1.1 or 1.2.3.4.5."),
    (5, "SSN 123-45-6789, not 000-12-3456 or 666-12-3456 or 900-12-3456."),
    (6, "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013000, not DE88370400440532013000."),
    (7, "Mail hein.19@mail5.example.com, again hein.19@mail5.example.com"),
    (8, None), (9, ""), (None, "no values at all é日本 12 345"), (9, "again 4111111111111111"), (9, "again 4111111111111111"),
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def masked(df, **more):
    return [(r["doc_id"], r["text"]) for r in pii.pseudonyms(df, **more).collect()]


def test_pseudonyms_stay_valid_linked_and_in_their_format(make_docs):
    out = dict(masked(make_docs([t for t in TEXTS if t[0] and t[1] and t[0] < 8])))
    a, b, bad = re.findall(r"[0-9][0-9 ]{14,18}[0-9]", out[1])
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and a[4] == " " and bad == "4111111111111112"
    x, y, bad = re.findall(r"\+1[0-9() -]+[0-9]", out[2])
    assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) != "15215556210" and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x)
    assert bad != "+1 (121) 555-6210" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", bad)
    iso, dotted, slashed = re.match(r"Born (\S+) or (\S+), (\S+);", out[3]).groups()
    day = datetime.date.fromisoformat(iso)
    assert day != datetime.date(1987, 3, 9) and dotted == day.strftime("%d.%m.%Y") and slashed == day.strftime("%Y/%m/%d")
    assert out[3].endswith("not 1987-02-30, 1500-01-01.")
    ip = re.search(r"Host ([\d.]+), not 300.1.1.1 or 1.2.3.4.5.", out[4])[1]
    assert ip != "193.195.198.107" and all(int(p) < 256 for p in ip.split("."))
    ssn = re.search(r"SSN (\d{3}-\d{2}-\d{4}), not 000-12-3456 or 666-12-3456 or 900-12-3456", out[5])[1]
    assert ssn != "123-45-6789" and ssn[:3] not in ("000", "666") and ssn[0] != "9"
    spaced, plain, bad = re.findall(r"DE[0-9 ]{19,}[0-9]", out[6])
    assert spaced.replace(" ", "") == plain and int(plain[4:] + "1314" + plain[2:4]) % 97 == 1 and bad == "DE88370400440532013000"
    one, two = re.findall(r"\S+@mail5.example.com", out[7])
    assert one == two and re.fullmatch(r"[a-z]{4}\.\d\d@mail5.example.com", one) and not one.startswith("hein.19")


def test_the_key_undoes_them(make_docs, documents):
    for df in (make_docs(TEXTS), documents[0]):
        there = pii.pseudonyms(df, key="k1").select("doc_id", "text")
        back = sorted(((r["doc_id"], r["text"]) for r in pii.pseudonyms(there, key="k1", inverse=True).collect()), key=str)
        assert back == sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)
    assert sorted(masked(make_docs(TEXTS), key="k1"), key=str) != sorted(masked(make_docs(TEXTS), key="k2"), key=str)


def test_pairs_are_permuted(spark):
    df = spark.range(35).select(pii.permuted_pair("k", "t", F.col("id") % 5, F.floor(F.col("id") / 5), 5, 7).alias("p"))
    assert {(r["p"]["left"], r["p"]["right"]) for r in df.collect()} == {(a, b) for a in range(5) for b in range(7)}


def test_short_texts_are_permuted(spark):
    df = spark.range(1000).select(pii.permuted_text("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("p"))
    assert len({r["p"] for r in df.collect()}) == 1000


def test_odd_rows_and_native_plan(odd_docs, no_docs):
    assert sorted(masked(odd_docs), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=str)
    assert pii.pseudonyms(no_docs).count() == 0
    plan = pii.pseudonyms(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_phone_numbers_with_any_area_code_are_replaced(make_docs):
    texts = {1: "+1 (152) 555-8590", 2: "+1-052-155-8590", 3: "+1 521 055 6210", 4: "+1 (521) 555-6210"}
    there = make_docs(list(texts.items()))
    out = dict(masked(there))
    assert all(out[i] != t and re.sub(r"\d", "0", out[i][2:]) == re.sub(r"\d", "0", t[2:]) for i, t in texts.items())
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out[4])
    assert dict(masked(make_docs(list(out.items())), inverse=True)) == texts


def test_cards_beside_other_numbers_are_replaced(make_docs):
    texts = {
        1: "7536784127813050 4845168114407329", 2: "4111111111111111 12/26", 3: "4111111111111111-4111111111111111.4111111111111111",
        4: "4111 1111 1111 1111 12/26", 5: "4111 1111 1111 1111 4111 1111 1111 1111", 6: "no. 12 4111111111111111 7",
        7: "2024 4111 1111 1111 1111", 8: "4111 1111 1111 1111 4111111111111111", 9: "0.4111111111111111 and 41111111111111110000",
    }
    rows = {r["doc_id"]: r for r in pii.pseudonyms(make_docs(list(texts.items()))).collect()}
    one = rows[2]["text"].split()[0]
    assert luhn(one) and one != "4111111111111111" and rows[2]["text"] == f"{one} 12/26"
    a, b = rows[1]["text"].split()
    assert luhn(a) and luhn(b) and a != "7536784127813050" and b != "4845168114407329" and rows[1]["n_card"] == 2
    fours = " ".join(one[k:k + 4] for k in range(0, 16, 4))
    assert [rows[k]["text"] for k in range(3, 10)] == [
        f"{one}-{one}.{one}", f"{fours} 12/26", f"{fours} {fours}", f"no. 12 {one} 7", f"2024 {fours}", f"{fours} {one}", texts[9],
    ]
    back = pii.pseudonyms(make_docs([(i, r["text"]) for i, r in rows.items()]), inverse=True).collect()
    assert {r["doc_id"]: r["text"] for r in back} == texts
