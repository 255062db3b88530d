"""Corpus, scoring, blocking, query generation, evaluation and streams."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.functions import kernels
from palisade.functions.scores import plain_scores
from palisade.operators import best_match, blocking, evaluation, profile, querygen, screening
from palisade.streaming.screen import screen_stream, windowed_counts

NAMES = ["JOHN SMITH", "AHMED HASSAN AL-RASHID", "IVAN PETROV", "JON SMYTHE", "", "JOHN SMITH"]


def corpus(spark):
    return spark.createDataFrame([(k, f"e{k}", n) for k, n in enumerate(NAMES)], "c_ord long, entity_id string, name string")


def akas(spark):
    rows = [("e1", "MOHAMMED ALI HASSAN", True, "Latin"), ("e2", "IVAN IVANOVICH PETROV", True, "Latin"), ("e3", "JOHN SMITH", True, "Latin"), ("e4", "weak", True, "Latin"), ("e5", "اسم", True, "Arabic")]
    entities = [(e, "Individual" if e != "e4" else "Entity", ["P1", "P2"] if e == "e1" else []) for e, *_ in rows]
    return (spark.createDataFrame(rows * 40, "entity_id string, aka_name string, is_primary boolean, script string"),
            spark.createDataFrame(entities * 40, "entity_id string, entity_type string, programs array<string>"))


@pytest.mark.parametrize("block", [2, 5000])
def test_best_matches_equal_all_pairs(spark, block):
    asked = ["JOHN SMITH", "PETROV IVAN", "HASSAN AHMED", "zzz", None, "smith, john"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q_ord long, query_name string")
    got = {r.q_ord: r for r in screening.score_all_queries(queries, corpus(spark), block=block).collect()}
    assert len(got) == len(asked)
    for k, q in enumerate(asked):
        for kind, name in (("jw", "jaro_winkler"), ("ts", "token_set")):
            scored = [plain_scores(q, n)[name] for n in NAMES]
            assert got[k][f"{kind}_score"] == pytest.approx(max(scored))
            assert got[k][f"{kind}_match_id"] == f"e{scored.index(max(scored))}"
    assert (got[0].ens_match_id, got[0].ens_score) == ("e0", pytest.approx(1.0))


@pytest.mark.parametrize("weights", [{"jaro_winkler": 0.4, "token_set": 0.4, "phonetic": 0.2}, {"jaro_winkler": -1.0, "token_set": 0.5, "phonetic": 0.5}])
def test_bounds_lose_no_best_row(weights):
    rng = random.Random(9)
    words = ["al", "hassan", "hasan", "petrov", "petrova", "ivan", "john", "jon", "smith", "smyth", "é", "中文", "x" * 300, "a"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(0, 5))) for _ in range(300)} | {""})
    sounds = [kernels.metaphone_string(n) or n for n in names]
    asked = [(n[1:], kernels.metaphone_string(n[1:]) or n[1:]) for n in names[::3]]
    orders = rng.sample(range(1000), len(names))
    rows = list(zip(orders, [f"e{o}" for o in orders], names, sounds, strict=True))
    kinds = pa.schema([("c_ord", pa.int64()), ("entity_id", pa.string()), ("norm", pa.string()), ("codes", pa.string())])
    batches = [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds) for part in (rows[:100], rows[100:])]
    got = {(r["norm"], r["scorer"]): (r["score"], r["c_ord"], r["entity_id"]) for b in best_match.best_rows(iter(batches), asked, weights) for r in b.to_pylist()}
    want = {}
    for norm, sound in asked:
        for o, e, n, c in rows:
            jw, ts, ph = kernels.jaro_winkler(norm, n), kernels.token_set(norm, n), kernels.token_set(sound, c)
            ens = weights["jaro_winkler"] * jw + weights["token_set"] * ts + weights["phonetic"] * ph
            for kind, s in zip(best_match.SCORERS, (jw, ts, ph, ens), strict=True):
                now = want.get((norm, kind))
                if now is None or (s, -o) > (now[0], -now[1]):
                    want[norm, kind] = (s, o, e)
    assert got == want


def test_build_corpus(spark):
    df = akas(spark)[0].withColumn("is_primary", F.col("entity_id") != "e4")
    rows = screening.build_corpus(df).orderBy("c_ord").collect()
    assert [r.c_ord for r in rows] == list(range(160))
    assert [(r.entity_id, r.name) for r in rows] == sorted((r.entity_id, r.name) for r in rows)


def test_near_duplicates(spark):
    df = spark.createDataFrame([("e", "KARIM AHMED"), ("e", "KARIM AHMAD"), ("e", "XQZ"), ("e", "karim ahmed"), ("f", "A B"), ("f", "A C")], "entity_id string, aka_name string")
    assert {(r.name_a, r.name_b) for r in screening.near_duplicate_aliases(df).collect()} == {("KARIM AHMAD", "KARIM AHMED"), ("KARIM AHMAD", "karim ahmed")}


def test_blocking(spark):
    queries = spark.createDataFrame([(0, "JOHN SMYTH", "e0"), (1, "OHN SMITH", "e0"), (2, "", "e1")], "q_ord long, query_name string, true_entity_id string")
    rows = {r.strategy: r for r in blocking.compare_strategies(queries, corpus(spark)).collect()}
    assert (rows["none"].recall, rows["none"].mean_candidates) == (1.0, 6.0)
    assert (rows["first_letter"].recall, rows["first_letter"].mean_candidates) == (pytest.approx(1 / 3), 1.0)
    assert rows["first_letter"].reduction_factor == 6.0
    assert rows["phonetic"].recall == pytest.approx(1 / 3)
    found = blocking.candidates(queries, blocking.index(corpus(spark), blocking.phonetic_key), blocking.phonetic_key)
    assert {(r.q_ord, r.entity_id) for r in found.collect()} == {(0, "e0"), (0, "e3"), (0, "e5")}
    assert blocking.mean_bucket_fraction(blocking.index(corpus(spark), blocking.first_letter_key)).first()[0] == pytest.approx(1 / 3)


def test_query_sets(spark):
    first, again = (querygen.build_query_set(*akas(spark)) for _ in range(2))
    pos = first["positive"].collect()
    assert len(pos) == 500
    assert first["positive"].columns == ["query_name", "true_entity_id", "true_name", "variant_type", "program"]
    assert {r.variant_type for r in pos} == set(querygen.VARIANTS)
    assert {r.true_entity_id for r in pos} <= {"e1", "e2", "e3"}
    assert {r.program for r in pos if r.true_entity_id == "e1"} == {"P1"}
    assert {r.program for r in pos if r.true_entity_id == "e3"} == {"UNKNOWN"}
    assert (first["hard_negative"].count(), first["near_miss"].count()) == (1000, 200)
    assert {(r.near_miss_type, r["count"]) for r in first["near_miss"].groupBy("near_miss_type").count().collect()} == {("arabic", 100), ("russian", 100)}
    assert first["hard_negative"].filter("negative_type = 'corporate'").count() == 12
    for name in first:
        assert first[name].collect() == again[name].collect()
    assert first["near_miss"].collect() != querygen.generate_near_miss_negatives(spark, seed=7).collect()


def test_variants(spark):
    df = spark.createDataFrame([("Mohammed Ali Hassan",), ("One Two",), ("Single",)], "n string")
    key = F.lit("k")
    rows = {r.n: r for r in df.select("n", querygen.reorder(F.col("n")).alias("reorder"), querygen.drop_middle(F.col("n"), 1, key).alias("drop"), querygen.abbreviate(F.col("n")).alias("abbr"), querygen.misspell(F.col("n"), 1, key).alias("miss"), querygen.transliterate(F.col("n"), 1, key).alias("trans")).collect()}
    assert (rows["Mohammed Ali Hassan"].reorder, rows["Mohammed Ali Hassan"].drop, rows["Mohammed Ali Hassan"].abbr) == ("Hassan Ali Mohammed", "Mohammed Hassan", "M Ali Hassan")
    assert (rows["One Two"].reorder, rows["One Two"].drop, rows["One Two"].abbr) == ("Two One", "One Two", "O Two")
    assert (rows["Single"].reorder, rows["Single"].abbr) == ("Single", "Single")
    assert rows["Mohammed Ali Hassan"].trans in ("mohamed ali hassan",)
    for n, r in rows.items():
        assert len(r.miss) == len(n)


def scored(spark):
    rows = [(0.95, True, True, "a"), (0.9, True, False, "a"), (0.7, True, True, "b"), (0.8, False, False, None), (0.2, False, False, None)]
    return spark.createDataFrame(rows, "score double, positive boolean, correct boolean, grp string")


def test_sweep(spark):
    curve = {r.threshold: r for r in evaluation.sweep_thresholds(scored(spark)).collect()}
    assert len(curve) == 51
    assert (curve[0.0].tp, curve[0.0].fp, curve[0.0].fn, curve[0.0].tn) == (2, 2, 1, 0)
    assert (curve[0.7].tp, curve[0.72].tp, curve[0.8].fp, curve[0.82].fp) == (2, 1, 1, 0)
    assert (curve[1.0].precision, curve[1.0].recall, curve[1.0].f1, curve[1.0].fpr) == (1.0, 0.0, 0.0, 0.0)
    assert curve[0.7].f1 == pytest.approx(2 * (2 / 3) * (2 / 3) / (4 / 3))
    df = evaluation.sweep_thresholds(scored(spark))
    point = evaluation.find_operating_point(df, 0.6).first()
    assert (point.threshold, point.achievable) == (0.7, True)
    assert (lambda p: (p.threshold, p.achievable))(evaluation.find_operating_point(df, 0.99).first()) == (0.0, False)
    cost = evaluation.cost_at_operating_point(evaluation.find_operating_point(df, 0.6)).first()
    assert cost.annual_cost == pytest.approx(0.5 * 1e6 * 12 * 35)
    assert evaluation.best_f1(df).first().threshold == 0.82 or evaluation.best_f1(df).first().f1 == max(r.f1 for r in curve.values())
    groups = {r.grp: r for r in evaluation.sweep_by_group(scored(spark), "grp", least=1).collect()}
    assert set(groups) == {"a", "b"}
    assert groups["b"].max_recall == 1.0
    assert evaluation.operating_grid(df.withColumn("scorer", F.lit("ens"))).count() == 3


def test_empty_sweep(spark):
    assert evaluation.sweep_thresholds(scored(spark).limit(0)).count() in (0, 51)


def test_profiles(spark):
    rows = spark.createDataFrame([(datetime.date(2020, 1, 5), "a"), (datetime.date(2020, 4, 30), "a"), (datetime.date(2020, 2, 1), "b"), (None, "a")], "d date, g string")
    growth = [(str(r.month_end), r.added, r.cumulative) for r in profile.monthly_growth(rows, "d").orderBy("month_end").collect()]
    assert growth == [("2020-01-31", 1, 1), ("2020-02-29", 1, 2), ("2020-03-31", 0, 2), ("2020-04-30", 1, 3)]
    assert profile.monthly_growth(rows, "d", ("g",)).filter("g = 'a'").count() == 4
    assert [(r.bin, r.n) for r in profile.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "v double"), "v", 0.0, 1.0, 4).orderBy("bin").collect()] == [(0, 1), (2, 1), (3, 1)]
    programs = spark.createDataFrame([("e", "IRAN"), ("f", "IRAN"), ("g", "X")], "entity_id string, program string")
    names = spark.createDataFrame([("e", True), ("e", False), ("g", True)], "entity_id string, is_weak boolean")
    ratios = {r.program: (r.n_entities, r.mean_aliases, r.weak_ratio) for r in profile.weak_alias_ratio(programs, names, 1).collect()}
    assert ratios == {"IRAN": (2, 1.0, 0.5), "X": (1, 1.0, 1.0)}
    assert profile.group_ratio(profile.weak_alias_ratio(programs, names, 1), "IRAN|IFSR", "g").first().mean_ratio == 0.5
    assert [r.x for r in spark.createDataFrame([("1970",), ("1970-02",), (None,)], "v string").select(profile.has_month(F.col("v")).alias("x")).collect()] == [False, True, False]
    assert profile.top_rows(rows, 1, "d", largest=False).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("JOHN SMYTH",), ("nobody",)], "name string").write.parquet(f"{tmp_path}/in")
    out = screen_stream(spark.readStream.schema("name string").parquet(f"{tmp_path}/in"), corpus(spark))
    query = out.writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.name, r.entity_id) for r in spark.table("hits").collect()} == {("JOHN SMYTH", "e0"), ("JOHN SMYTH", "e3"), ("JOHN SMYTH", "e5")}


def test_windowed_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 7)] + [(datetime.datetime(2024, 1, 1, 1, 0), "a", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, kind string, value double").parquet(f"{tmp_path}/in")
    query = windowed_counts(events, "ts", "5 minutes", "10 minutes", "kind", value=F.col("value")).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.window_start.minute, r.n, r.total) for r in spark.table("counts").collect()) == [(0, 2, 2.0), (5, 1, 1.0)]
