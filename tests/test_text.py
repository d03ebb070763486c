import sqlite3
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korvex.functions import text as T


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=12))
def test_fnv_against_bytewise(rows):
    assert [int(x) for x in T.fnv1a(rows)] == [fnv(r) for r in rows]


def test_stable_hash_separates_fields(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", None), ("é", "")], "x string, y string").select(T.stable_hash(F.col("x"), F.col("y")).alias("h"))
    want = [format(fnv(x.encode() + b"\xff" + y.encode() + b"\xff"), "x") for x, y in [("ab", "c"), ("a", "bc"), ("ab", ""), ("é", "")]]
    assert [r.h for r in df.collect()] == want and len(set(want)) == 4


TEXTS = ["  a\r\nb\rc\n ", "éa", " x ", "", "İstanbul STRASSE_x 12³", "naïve-café 北京 x_y"]


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    rows = df.select("k", T.normalize(F.col("t")).alias("n"), T.tokens(F.col("t")).alias("w")).orderBy("k").collect()
    assert [r.n for r in rows][:4] == ["a\nb\nc", "éa", "x", ""]
    assert rows[5].w == ["naïve", "café", "北京", "x", "y"] and rows[3].w == []


def test_literal_matching_as_like(spark):
    con = sqlite3.connect(":memory:")
    cases = [("100%_done", "%_D"), ("100Xdone", "%_d"), ("École", "É"), ("école", "É"), ("a\\b", "\\B"), ("abc", "")]
    escaped = lambda q: "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    want = [bool(con.execute("SELECT ? LIKE ? ESCAPE '\\'", (t, escaped(q))).fetchone()[0]) for t, q in cases]
    got = spark.createDataFrame(cases, "t string, q string").select(T.contains_literal(F.col("t"), F.col("q")).alias("m")).collect()
    assert [r.m for r in got] == want


WORDS = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing
filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator
feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance
inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize
probate rate cease controll roll generalizations oscillators flies résumé straße naïvely yes syzygy by eye ab a aeiou logi archaeology été RÉSUMÉ ﬁnding x²ing""".split()


def test_stems_against_a_full_text_index():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for w in WORDS:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        want = [r[0] for r in con.execute("SELECT term FROM v")]
        assert [T.porter(T.fold_term(w))] == want, w


def test_fold_keeps_positions():
    for t in ["İ" * 5 + "needle", "ÀÉ", "ß", "é"]:
        assert len(T.fold_text(t)) == len(t)
    assert T.fold_text("ÀÉñ") == "aen" and unicodedata.normalize("NFC", T.fold_text("X")) == "x"


def test_kinds(spark):
    types = ["net.daringfireball.markdown", "public.json", "application/vnd.api+json", "public.python-script", "public.png", "text/x-unknown", None]
    rows = spark.createDataFrame([(t,) for t in types], "t string").select(T.representation_kind(F.col("t")).alias("k"), T.is_text_like(F.col("t")).alias("l")).collect()
    assert [r.k for r in rows] == ["markdown", "structuredJSON", "structuredJSON", "code", "plainText", "plainText", "plainText"]
    assert [r.l for r in rows] == [True, True, False, True, False, True, False]
