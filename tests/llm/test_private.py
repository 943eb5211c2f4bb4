"""Personal data against plain patterns, and the spans that the trees add."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import private
from evidentia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def counts(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if counts(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = [
    None, "", " ", "a@b.c", "a@b.cc@d.ee", "a@b.c_x@d.e", "x@y.z.", "@b.c a@.b", "a@b", "é@b.c ü.a@b-c.d\U0001f600 q@w.e", "%+-@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.02.0003.255",
    "0.0.0.0000000000000000000000000000000000255", "1.2.3.99999999999999999999", "12.34..5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "4111111111111111", "4111111111111112",
    "5 5 5 5-5-5", "0" * 13, "0" * 20, "0 " * 19, "+31 20 123 4567", "+1 (843) 555-4223", "+1", "+12", "+1 2", "+1(((((((2", "+123456789012345", "+1234567890123456", "+1 . . . 5 +31612345678.", "++31612345678",
    "+31 6 1234 5678 tel 4111 1111 1111 1111 bij a.b@c.nl op 10.0.0.1", "7" * 5000, "a" * 50_000, "a." * 20_000 + "@", "x@" + "a." * 20_000, "1." * 20_000, "1 " * 20_000, "+1" + " (" * 20_000,
    "mail a@b.nl. " * 300, "\x00a@b.c\x00", "A@B.C\r\n+49(0)30-123456",
]


def test_base_spans(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["1", "23", "4", ".", "@", "a", "b-", "+", " ", "(", ")", "-", "_", "é", "255", "0"]) for _ in range(rng.randrange(80))) for _ in range(600)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, kind int")
    rows = private.personal_spans(frame).select("doc_id", private.written(F.filter("spans", lambda x: x["base"])).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.s == joined(base_spans(texts[r.doc_id])), texts[r.doc_id]


def test_registered_query(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    df = QUERIES["op13_private"](spark, SF)
    assert dict(df.dtypes) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in private.KINDS}, "base_sha256": "string", "spans": "string"}
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in private.KINDS] == [sum(x[0] == k for x in base) for k in private.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))
    assert sum(bool(base_spans(t)) for t in texts.values()) > 5


def letters(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def written_out(rng, k):
    """Documents with base addresses, with some of the same form spelled out, and with clean texts of like shape."""
    name, host = letters(rng), letters(rng)
    if k % 40 == 0:
        return f"please contact {name} at {host}.com today", [("email", len("please contact "), len(f"please contact {name} at {host}.com"))]
    if k % 3 == 0:
        return f"please contact {name}@{host}.com today", None
    return f"we met near {name} station and {host} left at noon.", []


def test_spelled_out_addresses_are_learned_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    rows = [(k, *written_out(rng, k)) for k in range(3000)]
    found = {r.doc_id: r.s for r in private.personal_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), precision=0.85).select("doc_id", private.written(F.col("spans")).alias("s")).collect()}
    wanted = [r for r in rows if r[2]]
    hits = sum(found[k] == joined(spans) for k, _, spans in wanted)
    assert hits >= 0.9 * len(wanted) and len(wanted) == 75
    assert all(found[k] == "" for k, _, spans in rows if spans == [])


def test_wide_spans_that_are_not_like_base_spans_are_not_added(spark):
    rng = random.Random(9)
    rows = [(k, f"order 12-345-678 of {letters(rng)} a{k}@b{k}.nl" if k % 2 else "scores 10 20 30 40 in 2019-12-31") for k in range(2000)]
    found = private.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", private.written(F.col("spans")).alias("s")).collect()
    assert all(r.s == joined(base_spans(dict(rows)[r.doc_id])) for r in found)


def test_redacted(spark):
    rows = [(1, "mail a@b.nl or +31 20 123 4567, ok", 5), (2, None, 6), (3, "10.0.0.1", 7), (3, "10.0.0.1", 7), (4, "+41 11 1111 1111 1111 x", 8), (5, "clean", None)]
    made = private.redacted(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    assert made.columns == ["doc_id", "text", "spans"]
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got[:2] == [(1, "mail [EMAIL] or [PHONE], ok", 5), (2, None, 6)] and got[2:4] == [(3, "[IP]", 7)] * 2 and got[5] == (5, "clean", None)


def test_empty_table(spark):
    assert private.personal_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_trees_and_thresholds():
    rng = np.random.default_rng(0)
    x = np.stack([rng.integers(0, n, 4000) for n in private.FEATURES.values()], 1)
    odds = (x[:, 1] > 8) & (x[:, 5] == 1)
    good, bad = np.where(odds, 30, 1), np.where(odds, 0, 30)
    model = private.Boosted.fit(x, good, bad, np.arange(4000) % 5 == 0)
    assert all(np.isfinite(t) for t in model.thresholds.values())
    none = private.Boosted.fit(x, good * 0, bad, np.arange(4000) % 5 == 0)
    assert not any(np.isfinite(t) for t in none.thresholds.values())
    assert private.Boosted.fit(x[:0], good[:0], bad[:0], np.zeros(0, bool)).trees == []


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "0595765450607129", "79927398713"])
def test_luhn(spark, digits):
    assert spark.range(1).select(private.luhn(F.lit(digits)).alias("x")).first().x == luhn(digits)
