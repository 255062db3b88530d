"""Folding, Arabic forms, kernels and scores: hand-computed expectations."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import arabic, folding, kernels, scores


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [
    ("JOHN SMITH", "john smith"), ("José García", "jose garcia"), ("AL-RASHID, Omar", "al rashid omar"), ("  JOHN   SMITH  ", "john smith"), ("", ""), (None, ""),
    ("AL-HUSSEIN", "al hussein"), ("snake_case", "snake_case"), ("Ünḯçödé", "unicode"), ("Иванов Ё", "иванов е"), (" x y\n", "x y")])
def test_normalize(spark, name, want):
    assert one(spark, folding.normalize, name) == want
    assert scores.plain_normalize(name) == want


def test_tokens(spark):
    assert one(spark, folding.tokenize, "Abu  Bakr al-Baghdadi") == ["abu", "bakr", "al", "baghdadi"]
    assert one(spark, folding.tokenize_no_particles, "Abu Bakr al-Baghdadi al") == ["bakr", "baghdadi"]
    assert one(spark, folding.tokenize, "") == []


@pytest.mark.parametrize(("text", "want"), [("محمد", True), ("mixed محمد", True), ("Mohammed", False), ("", False), (None, False), ("Иван", False), ("ﻻ", True)])
def test_is_arabic(spark, text, want):
    assert one(spark, arabic.is_arabic_script, text) is want


@pytest.mark.parametrize(("make", "text", "want"), [
    (arabic.normalize_arabic_orthography, "أَحْمَد", "احمد"), (arabic.normalize_arabic_orthography, "فاطمة", "فاطمه"), (arabic.normalize_arabic_orthography, "مـوسى", "موسي"),
    (arabic.transliterate_ala_lc, "شيخ  خالد", "shykh khald"), (arabic.transliterate_ala_lc, "عءا٣", "a3"), (arabic.transliterate_ala_lc, "پx", "پx"),
    (arabic.arabic_to_canonical_latin, "مُحَمَّد", "mhmd"), (arabic.canonical_form, "أحمد", "ahmd"),
    (arabic.canonical_form, "HOSSEIN", "husayn"), (arabic.canonical_form, "Hoseyni", "hosini"), (arabic.canonical_form, "KHATAM OL-AMBIA", "khatam al-ambia"),
    (arabic.canonical_form, "ol Fatimeh Moussa", "al fatima musa"), (arabic.canonical_form, "", ""), (arabic.canonical_form, None, "")])
def test_arabic(spark, make, text, want):
    assert one(spark, make, text) == want


@pytest.mark.parametrize(("a", "b", "kind", "low", "high"), [
    ("JOHN SMITH", "JOHN SMITH", "jaro_winkler", 1, 1), ("JOHN SMITH", "JOHN SMITH", "token_set", 1, 1), ("JOHN SMITH", "JOHN SMITH", "phonetic", 1, 1), ("JOHN SMITH", "JOHN SMITH", "ensemble", 1, 1),
    ("john smith", "JOHN SMITH", "jaro_winkler", 1, 1), ("JOHN SMITH", "JON SMITH", "jaro_winkler", 0.85, 1), ("JOHN SMITH", "AHMED HASSAN", "jaro_winkler", 0, 0.6), ("JOHN SMITH", "AHMED HASSAN", "token_set", 0, 0.4),
    ("", "JOHN SMITH", "jaro_winkler", 0, 0), ("JOHN SMITH", "", "jaro_winkler", 0, 0), ("SMITH JOHN", "JOHN SMITH", "token_set", 1, 1), ("JOHN SMITH", "JOHN MICHAEL SMITH", "token_set", 0.85, 1),
    ("HASSAN", "HASAN", "phonetic", 0.8, 1), ("MOHAMMED", "MOHAMED", "phonetic", 0.7, 1), ("JOHN SMITH", "HASSAN OMAR", "phonetic", 0, 0.5), ("", "JOHN", "phonetic", 0, 0), ("JOHN SMITH", "JON SMYTH", "ensemble", 0, 1)])
def test_score_bounds(a, b, kind, low, high):
    got = scores.plain_scores(a, b)
    assert set(got) == {"jaro_winkler", "token_set", "phonetic", "ensemble"}
    assert low <= got[kind] <= high


def test_custom_weights():
    ts, jw = ({k: float(k == w) for k in ("jaro_winkler", "token_set", "phonetic")} for w in ("token_set", "jaro_winkler"))
    assert scores.plain_scores("JOHN SMITH", "SMITH JOHN", ts)["ensemble"] > scores.plain_scores("JOHN SMITH", "SMITH JOHN", jw)["ensemble"]


def test_columns_equal_plain_scores(spark):
    pairs = [("JOHN SMITH", "JON SMYTH"), ("José", "JOSE"), (None, "x"), ("Al-Rashid", "Rashid, Al")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scores.score_all(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r["s"].asDict() == pytest.approx(scores.plain_scores(r["a"], r["b"]))


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=12), st.text("abcd ", min_size=1, max_size=12))
def test_jaro_winkler_equals_duckdb(a, b):
    assert kernels.jaro_winkler(a, b) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_indel_equals_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    want = 2 * best[-1][-1] / (len(a) + len(b)) if a or b else 1.0
    assert kernels.indel_similarity(a, b) == pytest.approx(want)
    assert kernels.token_set(a, b) == kernels.token_set(b, a)


@pytest.mark.parametrize(("word", "code"), [("john", "JN"), ("smith", "SM0"), ("hassan", "HSN"), ("omar", "OMR"), ("knight", "NT"), ("phone", "FN"), ("xavier", "SFR"), ("church", "XRX"), ("wright", "RT"), ("", "")])
def test_metaphone(word, code):
    assert kernels.metaphone(word) == code


def test_registered_for_sql(spark):
    kernels.register(spark)
    row = spark.sql("select jaro_winkler('martha', 'marhta') as jw, token_set_ratio('a b', 'b a') as ts, metaphone('john smith') as m").first()
    assert (round(row.jw, 4), row.ts, row.m) == (0.9611, 1.0, "JN SM0")
