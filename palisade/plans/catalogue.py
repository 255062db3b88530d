"""Registered queries and their SQL, by name.

The tables at hand are no watchlist, so parts, customers and orders stand in for names, entities and aliases, and deliveries
for shares. Every query reads its whole tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import arabic, folding, scores
from palisade.operators import blocking, communities, evaluation, ownership, profile, querygen, screening
from palisade.sources import advanced_xml, scratch
from palisade.sources.flat_files import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that gives the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


# ---------------------------------------------------------------- profiles


@query("select p_type, count(*) as n, round(100.0 * count(*) / (select count(*) from part), 1) as share from part where p_type is not null group by p_type")
def type_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.composition(table(spark, sf_dir, "part"), "p_type")


def _customer_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("entity_id"), F.array("c_mktsegment", "r_name").alias("programs"))


PROGRAMS_SQL = """with c as (select c_custkey as entity_id, unnest([c_mktsegment, r_name]) as program from customer
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


@query(PROGRAMS_SQL + " select program, count(*) as n from c group by program order by n desc, program limit 5")
def program_explode_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.program_counts(_customer_programs(spark, sf_dir), 5)


GROWTH_SQL = """with m as (select {by} last_day(o_orderdate) as month_end, count(*) as added from orders where o_orderdate is not null group by all),
span as (select {by} date_trunc('month', min(month_end)) as lo, date_trunc('month', max(month_end)) as hi from m {group}),
every as (select {by} last_day(unnest(generate_series(lo, hi, interval 1 month))) as month_end from span)
select {by} cast(cast(month_end as date) as varchar) as month_end, cast(coalesce(added, 0) as bigint) as added, cast(sum(coalesce(added, 0)) over ({part} order by month_end) as bigint) as cumulative
from every left join m using ({by} month_end)"""


@query(GROWTH_SQL.format(by="", group="", part=""))
def monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.monthly_growth(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate").withColumn("month_end", F.col("month_end").cast("string"))


@query(GROWTH_SQL.format(by="o_orderstatus,", group="group by o_orderstatus", part="partition by o_orderstatus"))
def monthly_growth_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.monthly_growth(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderstatus"), "o_orderdate", ("o_orderstatus",)).withColumn("month_end", F.col("month_end").cast("string"))


@query("""select o_orderstatus, count(*) as added from orders where o_orderdate >= date '1998-03-01' and o_orderdate < date '1999-03-01' group by o_orderstatus""")
def added_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.added_between(table(spark, sf_dir, "orders"), "o_orderdate", "1998-03-01", "1999-03-01").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("added"))


@query("""select min(o_orderdate)::date::varchar as first_date, max(o_orderdate)::date::varchar as last_date, count(*) as n, count(o_orderdate) as n_dated from orders""")
def date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.span(table(spark, sf_dir, "orders"), "o_orderdate").withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


def _order_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_weak"))


WEAK_SQL = PROGRAMS_SQL + """, a as (select o_custkey as entity_id, count(*) as n, count(*) filter (o_orderpriority = '1-URGENT') as weak from orders group by 1),
r as (select program, count(*) as n_entities, avg(coalesce(n, 0)) as mean_aliases, cast(sum(coalesce(weak, 0)) as bigint) as n_weak, cast(sum(coalesce(n, 0)) as bigint) as n_aliases
  from c left join a using (entity_id) group by program having count(*) >= 30)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(WEAK_SQL + " select program, n_entities, round(mean_aliases, 6) as mean_aliases, n_weak, n_aliases, round(coalesce(n_weak / nullif(n_aliases, 0), 0), 6) as weak_ratio from r")
def weak_alias_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = _customer_programs(spark, sf_dir).select("entity_id", F.explode("programs").alias("program"))
    return _rounded(profile.weak_alias_ratio(programs, _order_aliases(spark, sf_dir)), "mean_aliases", "weak_ratio")


@query(WEAK_SQL + """, q as (select program, n_weak / nullif(n_aliases, 0) as ratio from r)
select 'regions' as grp, round(avg(ratio), 6) as mean_ratio, count(*) as n from q where regexp_matches(program, 'ASIA|EUROPE')
union all select 'segments', round(avg(ratio), 6), count(*) from q where regexp_matches(program, 'BUILDING|MACHINERY')""")
def group_ratio_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = _customer_programs(spark, sf_dir).select("entity_id", F.explode("programs").alias("program"))
    ratios = profile.weak_alias_ratio(programs, _order_aliases(spark, sf_dir))
    return _rounded(profile.group_ratio(ratios, "ASIA|EUROPE", "regions").unionByName(profile.group_ratio(ratios, "BUILDING|MACHINERY", "segments")), "mean_ratio")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders")
    rows = profile.flag(rows, "entity_id", orders.select(F.col("o_custkey").alias("entity_id")), "ordered")
    return profile.flag(rows, "entity_id", orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity_id")), "urgent")


COVER_SQL = """with f as (select c_custkey, c_mktsegment, c_custkey in (select o_custkey from orders) as ordered,
  c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') as urgent from customer)
select c_mktsegment, count(*) as n, count(*) filter (ordered) as n_ordered, round(avg(cast(ordered as int)), 6) as rate_ordered,
  count(*) filter (urgent) as n_urgent, round(avg(cast(urgent as int)), 6) as rate_urgent,
  count(*) filter (ordered and urgent) as n_all, round(avg(cast(ordered and urgent as int)), 6) as rate_all,
  count(*) filter (not ordered and not urgent) as n_none, round(avg(cast(not ordered and not urgent as int)), 6) as rate_none
from f group by c_mktsegment"""


@query(COVER_SQL)
def identifier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.coverage(_covered(spark, sf_dir), ("ordered", "urgent"), ("c_mktsegment",))
    return _rounded(out, *[c for c in out.columns if c.startswith("rate_")])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT' and o_orderstatus = 'P')")
def entities_without_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order in process."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("""select c_custkey, case when r_name = 'AFRICA' then n_name when r_name = 'EUROPE' then 'Unresolved' else r_name end as entity_type
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def resolve_type_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as subtypes: named in one region, blank or unknown elsewhere; regions as types, of which one isn't known."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    sub = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # as many rows as regions
    named = F.when(F.col("r_name") == "AFRICA", F.col("n_name")).when(F.col("r_name") == "ASIA", "Unknown").otherwise("")
    refs = sub.select(F.lit("party_subtype").alias("kind"), F.col("n_nationkey").cast("string").alias("id"), named.alias("value"), F.col("n_regionkey").cast("string").alias("parent"))
    refs = refs.unionByName(region.filter("r_name <> 'EUROPE'").select(F.lit("party_type").alias("kind"), F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("value"), F.lit(None).cast("string").alias("parent")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"))
    return advanced_xml.resolve_type(rows, refs, "key", "entity_type", "Unresolved").select("c_custkey", "entity_type")


@query("select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1")
def dedup_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ("user_id", "event_type"), "ts", "event_id")


@query("""select least(cast(floor((l_discount - 0.0) * 20 / 0.1) as int), 19) as bin, count(*) as n,
  round(count(*) / (sum(count(*)) over () * (0.1 / 20)), 6) as density from lineitem where l_discount between 0 and 0.1 group by 1""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.histogram(table(spark, sf_dir, "lineitem"), "l_discount", 0.0, 0.1, 20), "density")


@query("""select case when contains(p_type, 'STEEL') then 'steel' when contains(p_type, 'BRASS') then 'brass' else 'other' end as class,
  count(*) as n, count(*) filter (starts_with(p_type, 'PROMO')) as promo from part group by 1""")
def classify_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = profile.classify(F.col("p_type"), (("STEEL", "steel"), ("BRASS", "brass")), "other")
    return table(spark, sf_dir, "part").groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("p_type").startswith("PROMO"), F.lit(False))).alias("promo"))


@query("""select 'customers' as source, count(distinct c_custkey) as n_entities, (select count(*) from orders) as n_aliases from customer
union all select 'suppliers', count(distinct s_suppkey), (select count(*) from lineitem) from supplier""")
def format_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return profile.compare_formats({"customers": (t("customer").select("c_custkey"), t("orders")), "suppliers": (t("supplier").select("s_suppkey"), t("lineitem"))})


# ---------------------------------------------------------------- text


@query("""select doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as norm from documents""")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", folding.normalize(F.col("text")).alias("norm"))


def _canonical_sql(token: str) -> str:
    """The rules for a romanised token; a pattern before a letter is written with that letter, a double one letter by letter."""
    out = f"case {token} " + " ".join(f"when '{name}' then '{form}'" for name, form in arabic.CANONICAL_NAMES.items()) + " when 'al' then 'al' when 'el' then 'al' when 'ul' then 'al' when 'ol' then 'al' else " + token + " end"
    out = f"regexp_replace({out}, '^(el|ul|ol)-', 'al-')"
    for vowels, by in (("ey", "i"), ("ou", "u"), ("oo", "u")):
        out = f"regexp_replace({out}, '{vowels}([^aeiou])', '{by}\\1', 'g')"
    for end, by in (("oo", "u"), ("ou", "u"), ("ee", "i"), ("ah", "a"), ("eh", "a"), ("ain", "ayn"), ("ein", "ayn"), ("eyn", "ayn")):
        out = f"regexp_replace({out}, '{end}$', '{by}')"
    for c in "bcdfghjklmnpqrstvwxyz":
        out = f"replace({out}, '{c}{c}', '{c}')"
    return out


@query(f"""with p as (select doc_id, regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g') as plain from documents),
w as (select doc_id, unnest(string_split_regex(plain, '\\s+')) as word, generate_subscripts(string_split_regex(plain, '\\s+'), 1) as place from p),
t as (select doc_id, place, {_canonical_sql("word")} as token from w where word <> '')
select documents.doc_id, coalesce(string_agg(token, ' ' order by place), '') as canonical from documents left join t using (doc_id) group by documents.doc_id""")
def canonical_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", arabic.canonical_form(F.col("text")).alias("canonical"))


#: Arabic letters for a to z, among them some that are reduced, written with two Latin letters, or silent.
SCRIPT = "أبثدإفغهىجكلمنؤقرشتعوخصيظذ"
ARABIC_SQL = "translate(lower({}), 'abcdefghijklmnopqrstuvwxyz0123456789', '" + SCRIPT + "٠١٢٣٤٥٦٧٨٩')"


@query(f"""with n as (select p_partkey, {ARABIC_SQL.format("p_name || ' ' || p_type || ' ' || p_brand")} as name from part),
r as (select p_partkey, name, translate(name, 'أإىؤ', 'اايو') as plain from n),
d as (select *, replace(replace(replace(replace(replace(plain, 'ث', 'th'), 'خ', 'kh'), 'ذ', 'dh'), 'ش', 'sh'), 'غ', 'gh') as two from r)
select p_partkey, name, regexp_matches(name, '[\u0600-\u06ff]') as is_arabic,
  trim(regexp_replace(replace(translate(two, 'ابتجحدرزسصضطظفقكلمنهوي٠١٢٣٤٥٦٧٨٩', 'abtjhdrzssdtzfqklmnhwy0123456789'), 'ع', ''), '\\s+', ' ', 'g')) as canonical from d""")
def arabic_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, types and brands put into Arabic letters."""
    name = F.translate(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), "abcdefghijklmnopqrstuvwxyz0123456789", SCRIPT + "٠١٢٣٤٥٦٧٨٩")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", arabic.is_arabic_script(F.col("name")).alias("is_arabic"), arabic.canonical_form(F.col("name")).alias("canonical"))


# ---------------------------------------------------------------- matching


def _part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as a corpus; their number is fixed by the generator's word list."""
    return screening.with_ordinal(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("entity_id", F.col("name")), "c_ord", "name")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different part names of one brand."""
    named = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name")).distinct()
    a, b = named.withColumnRenamed("name", "name_a"), named.withColumnRenamed("name", "name_b")
    return a.join(b, "p_brand").filter("name_a < name_b")


NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
PAIR_SQL = "with d as (select distinct p_brand, p_name from part) select a.p_brand, a.p_name as name_a, b.p_name as name_b, {} as {} from d a join d b on a.p_brand = b.p_brand and a.p_name < b.p_name"
JW_SQL = f"jaro_winkler_similarity({NORM.format('a.p_name')}, {NORM.format('b.p_name')})"


@query(f"""with c as (select distinct p_name as name from part), q as (select name as part_name, substr(name, 2) || ' co' as query_name from c),
s as (select part_name, query_name, name, jaro_winkler_similarity({NORM.format('query_name')}, {NORM.format('name')}) as s from q, c),
k as (select *, row_number() over (partition by part_name order by s desc, name) as k from s) select part_name, query_name, name as best_match, round(s, 6) as score from k where k = 1""")
def jw_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that lost a letter and got a word, against all part names."""
    corpus = _part_corpus(spark, sf_dir)
    queries = corpus.select(F.col("c_ord").alias("q_ord"), F.col("name").alias("part_name"), F.concat(F.expr("substr(name, 2)"), F.lit(" co")).alias("query_name"))
    return screening.score_all_queries(queries, corpus).select("part_name", "query_name", F.col("jw_match_id").alias("best_match"), F.round("jw_score", 6).alias("score"))


@query(f"""select p_brand, name_a, name_b, round(similarity, 6) as similarity from ({PAIR_SQL.format(JW_SQL, 'similarity')}) where similarity > 0.7 and similarity < 1.0""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    akas = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity_id"), F.col("p_name").alias("aka_name"))
    return _rounded(screening.near_duplicate_aliases(akas).withColumnRenamed("entity_id", "p_brand"), "similarity")


@query()
def token_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", scores.token_set_score(F.col("name_a"), F.col("name_b")))


@query()
def phonetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", scores.phonetic_score(F.col("name_a"), F.col("name_b")))


@query()
def score_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("s", scores.score_all(F.col("name_a"), F.col("name_b"))).select("p_brand", "name_a", "name_b", "s.*")


@query()
def canonical_gain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and mean scores before and after canonical forms, by outcome."""
    return screening.gain_summary(canonical_gain(spark, sf_dir))


@query()
def canonical_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    base = scores.ensemble_score(F.col("name_a"), F.col("name_b"))
    new = scores.ensemble_score(arabic.canonical_form(F.col("name_a")), arabic.canonical_form(F.col("name_b")))
    return pairs.withColumns({"base": base, "canonical": new}).withColumn("outcome", screening.outcome(F.col("base"), F.col("canonical")))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part names, one a name."""
    corpus = _part_corpus(spark, sf_dir)
    return corpus.select(F.col("c_ord").alias("q_ord"), querygen.misspell(F.col("name"), 42, F.col("name")).alias("query_name"), F.col("entity_id").alias("true_entity_id"))


@query()
def ensemble_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.score_all_queries(_queries(spark, sf_dir), _part_corpus(spark, sf_dir))


@query("select lower(substr(p_name, 1, 1)) as block_key, count(*) as n, count(distinct p_name) as n_names from part where p_name <> '' group by 1")
def first_letter_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocking.index(table(spark, sf_dir, "part"), blocking.first_letter_key, "p_name")
    return rows.groupBy("block_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("n_names"))


@query("select round(1.0 / count(distinct lower(substr(p_name, 1, 1))), 6) as mean_bucket_fraction from part where p_name <> ''")
def bucket_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(blocking.mean_bucket_fraction(blocking.index(table(spark, sf_dir, "part"), blocking.first_letter_key, "p_name")), "mean_bucket_fraction")


@query()
def phonetic_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = blocking.index(_part_corpus(spark, sf_dir), blocking.phonetic_key)
    return blocking.candidates(_queries(spark, sf_dir), corpus, blocking.phonetic_key).select("q_ord", "query_name", "c_ord", "name", "block_key")


@query()
def blocking_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.compare_strategies(_queries(spark, sf_dir), _part_corpus(spark, sf_dir))


# ---------------------------------------------------------------- evaluation


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: quality is the truth, a ratio of the length the score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.pmod("n_chars", F.lit(101)) / 100.0).alias("score"), (F.col("quality") == 1).alias("positive"), F.lit(True).alias("correct"))


CURVE_SQL = """with s as (select lang, (n_chars % 101) / 100.0 as score, quality = 1 as positive from documents join labels using (doc_id)),
t as (select round(0.02 * k, 2) as threshold from range(51) r(k)),
c as (select {by} cast(threshold as double) as threshold, count(*) filter (positive and score >= threshold) as tp, count(*) filter (not positive and score >= threshold) as fp,
  count(*) filter (positive and score < threshold) as fn, count(*) filter (not positive and score < threshold) as tn from s, t group by all),
r as (select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall, case when fp + tn = 0 then 0.0 else fp / (fp + tn) end as fpr from c),
curve as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from r)"""
CURVE_COLUMNS = "threshold, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(fpr, 6) as fpr"
RATIOS = ("precision", "recall", "f1", "fpr")


@query(CURVE_SQL.format(by="") + f" select {CURVE_COLUMNS} from curve")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.sweep_thresholds(_scored(spark, sf_dir)), *RATIOS)


POINT = "(select * from curve where threshold = coalesce((select max(threshold) from curve where recall >= 0.8), (select min(threshold) from curve)))"


@query(CURVE_SQL.format(by="") + f" select {CURVE_COLUMNS}, recall >= 0.8 as achievable from {POINT}")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.find_operating_point(evaluation.sweep_thresholds(_scored(spark, sf_dir)), 0.8), *RATIOS)


@query(CURVE_SQL.format(by="") + f" select threshold, round(fpr * 1000000 * 12, 3) as annual_false_positives, round(fpr * 1000000 * 12 * 35, 2) as annual_cost from {POINT}")
def screening_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = evaluation.find_operating_point(evaluation.sweep_thresholds(_scored(spark, sf_dir)), 0.8)
    out = evaluation.cost_at_operating_point(point)
    return out.select("threshold", F.round("annual_false_positives", 3).alias("annual_false_positives"), F.round("annual_cost", 2).alias("annual_cost"))


@query(CURVE_SQL.format(by="") + " select threshold, round(recall, 6) as recall, round(fpr * 1000000 * 12 * 35, 2) as annual_cost from curve where recall > 0")
def cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluation.cost_at_operating_point(evaluation.sweep_thresholds(_scored(spark, sf_dir)).filter("recall > 0"))
    return curve.select("threshold", F.round("recall", 6).alias("recall"), F.round("annual_cost", 2).alias("annual_cost"))


GROUP_SQL = CURVE_SQL.format(by="lang,").split(",\nr as")[0] + """,
often as (select lang from s where positive group by lang having count(*) >= 10),
neg as (select threshold, cast(sum(fp) as bigint) as fp, cast(sum(tn) as bigint) as tn from c group by threshold),
r as (select lang, threshold, tp, neg.fp, fn, neg.tn, case when tp + neg.fp = 0 then 1.0 else tp / (tp + neg.fp) end as precision, case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall,
  case when neg.fp + neg.tn = 0 then 0.0 else neg.fp / (neg.fp + neg.tn) end as fpr from c join neg using (threshold) where lang in (select lang from often)),
f as (select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from r),
k as (select *, max(recall) over (partition by lang) as max_recall, row_number() over (partition by lang order by f1 desc, threshold) as k from f)
select lang, """ + CURVE_COLUMNS + ", round(max_recall, 6) as max_recall from k where k = 1"


@query(GROUP_SQL)
def per_group_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.sweep_by_group(_scored(spark, sf_dir), "lang"), *RATIOS, "max_recall")


def _negatives(spark: SparkSession) -> DataFrame:
    """Hard negatives and near misses, numbered together."""
    both = querygen.generate_hard_negatives(spark).select("query_name").unionByName(querygen.generate_near_miss_negatives(spark).select("query_name"))
    return both.select(F.monotonically_increasing_id().alias("q_ord"), "query_name")


@query()
def scorer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _part_corpus(spark, sf_dir), _queries(spark, sf_dir)
    pos, neg = screening.score_all_queries(queries, corpus), screening.score_all_queries(_negatives(spark), corpus)
    curves = None
    for k in screening.SCORERS:
        part = evaluation.sweep_results(pos, neg, k)
        curves = part if curves is None else curves.unionByName(part)
    return evaluation.best_f1(curves, ("scorer",))


@query()
def residual_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part names that the ensemble still misses at 0.9."""
    return evaluation.residual_failures(screening.score_all_queries(_queries(spark, sf_dir), _part_corpus(spark, sf_dir)), 0.9)


# ---------------------------------------------------------------- query generation


def _part_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    akas = part.select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("aka_name"), F.lit(True).alias("is_primary"), F.lit("Latin").alias("script"))
    return akas, part.select(F.col("p_partkey").cast("string").alias("entity_id"), F.lit("Individual").alias("entity_type"), F.array("p_brand").alias("programs"))


@query()
def querygen_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querygen.generate_positive_queries(*_part_entities(spark, sf_dir))


@query()
def querygen_hard_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querygen.generate_hard_negatives(spark)


@query()
def querygen_near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querygen.generate_near_miss_negatives(spark)


# ---------------------------------------------------------------- ownership


def _holdings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges, nodes, listed: regions hold nations (by unknown shares), these suppliers and customers, and suppliers customers by
    their share of what they were sent. One region and the suppliers in debt are listed."""
    region, nation, supplier, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier", "customer"))
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    sent = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.sum("l_quantity").alias("q"))
    whole = sent.groupBy(F.col("o_custkey").alias("_c")).agg(F.sum("q").alias("total"))
    edges = nation.select(name("r", "n_regionkey").alias("owner"), name("n", "n_nationkey").alias("asset"), F.lit(None).cast("double").alias("weight"))
    debt = F.when(F.col("s_acctbal") < 2000, 0.3).when(F.col("s_acctbal") < 5000, 0.55).otherwise(0.9)
    edges = edges.unionByName(supplier.select(name("n", "s_nationkey").alias("owner"), name("s", "s_suppkey").alias("asset"), debt.alias("weight")))
    edges = edges.unionByName(customer.select(name("n", "c_nationkey").alias("owner"), name("c", "c_custkey").alias("asset"), F.lit(0.5).alias("weight")))
    edges = edges.unionByName(sent.join(whole, F.col("o_custkey") == F.col("_c")).select(name("s", "l_suppkey").alias("owner"), name("c", "o_custkey").alias("asset"), (F.col("q") / F.col("total")).alias("weight")))
    nodes = region.select(name("r", "r_regionkey").alias("node"))
    for rows, prefix, key in ((nation, "n", "n_nationkey"), (supplier, "s", "s_suppkey"), (customer, "c", "c_custkey")):
        nodes = nodes.unionByName(rows.select(name(prefix, key).alias("node")))
    listed = region.filter("r_name = 'ASIA'").select(name("r", "r_regionkey").alias("node")).unionByName(supplier.filter("s_acctbal < 0").select(name("s", "s_suppkey").alias("node")))
    return scratch.cut(edges, "holdings"), nodes, listed


SENT_SQL = """sent as (select l_suppkey, o_custkey, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey group by all),
share as (select l_suppkey, o_custkey, q / sum(q) over (partition by o_custkey) as share from sent)"""
FRACTION_SQL = "with " + SENT_SQL + """, lister as (select s_suppkey as anchor from supplier where s_acctbal < 0),
fr as (select r_regionkey, case when r_name = 'ASIA' then 1.0 else 0.0 end as f from region),
fn as (select n_nationkey, f from nation join fr on n_regionkey = r_regionkey),
fs as (select s_suppkey, case when s_acctbal < 0 {listed} then 1.0 else f * case when s_acctbal < 2000 then 0.3 when s_acctbal < 5000 then 0.55 else 0.9 end end as f from supplier join fn on s_nationkey = n_nationkey {gone}),
ss as (select o_custkey, sum(share * f) as f from share join fs on l_suppkey = s_suppkey group by o_custkey),
fc as (select c_custkey, least(1.0, 0.5 * fn.f + coalesce(ss.f, 0)) as f from customer join fn on c_nationkey = n_nationkey left join ss on o_custkey = c_custkey),
every as (select 'r' || r_regionkey as node, f, f = 1 as listed from fr union all select 'n' || n_nationkey, f, false from fn union all select 's' || s_suppkey, fs.f, s_acctbal < 0 from fs join supplier using (s_suppkey)
  union all select 'c' || c_custkey, f, false from fc)"""


@query(FRACTION_SQL.format(listed="", gone="") + " select node, round(cast(f as double), 6) as fraction from every")
def listed_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ownership.listed_fractions(*_holdings(spark, sf_dir)), "fraction")


@query(FRACTION_SQL.format(listed="", gone="") + " select node, round_even(cast(f as double), 4) as fraction from every where not listed and f >= 0.5")
def flagged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.flag_blocked(*_holdings(spark, sf_dir))


EDGE_SQL = "with recursive " + SENT_SQL + """, e as (select 'r' || n_regionkey as owner, 'n' || n_nationkey as asset, cast(1.0 as double) as weight from nation
union all select 'n' || s_nationkey, 's' || s_suppkey, cast(case when s_acctbal < 2000 then 0.3 when s_acctbal < 5000 then 0.55 else 0.9 end as double) from supplier
union all select 'n' || c_nationkey, 'c' || c_custkey, cast(0.5 as double) from customer union all select 's' || l_suppkey, 'c' || o_custkey, share from share),
listed as (select 'r' || r_regionkey as node from region where r_name = 'ASIA' union all select 's' || s_suppkey from supplier where s_acctbal < 0),
p as (select owner as start, [owner, asset] as path, weight from e where owner in (select node from listed)
union all select start, list_append(path, asset), p.weight * e.weight from p join e on e.owner = path[len(path)] where not list_contains(path, asset) and len(path) <= 6)"""


@query(EDGE_SQL + " select array_to_string(path, '>') as path, round(weight, 6) as weight from p")
def ownership_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, listed = _holdings(spark, sf_dir)
    return _rounded(ownership.paths(edges, listed).select(F.array_join("path", ">").alias("path"), "weight"), "weight")


@query(EDGE_SQL + """, k as (select path[len(path)] as node, start as listed_node, array_to_string(path, '>') as path, round_even(weight, 4) as contribution,
  row_number() over (partition by path[len(path)], start order by weight desc, path) as k from p) select node, listed_node, path, contribution from k where k = 1""")
def explain_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes, listed = _holdings(spark, sf_dir)
    return ownership.explain_blocking(edges, nodes.select("node"), listed).withColumn("path", F.array_join("path", ">"))


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and the customers they deliver to."""
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_suppkey", "c_custkey").distinct()
    edges = pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("owner"), F.concat(F.lit("c"), "c_custkey").alias("asset"))
    nodes = s.select(F.concat(F.lit("s"), "s_suppkey").alias("node")).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node")))
    return edges.withColumn("weight", F.lit(None).cast("double")), nodes


TRADE_SQL = """with recursive e as (select distinct 's' || l_suppkey as owner, 'c' || o_custkey as asset from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey),
n as (select 's' || s_suppkey as node from supplier union select 'c' || c_custkey from customer)"""
DEGREE_SQL = TRADE_SQL + ", d as (select node, (select count(*) from e where owner = node) as out_degree, (select count(*) from e where asset = node) as in_degree from n)"


@query(DEGREE_SQL + " select node, out_degree, in_degree from d")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.degrees(*_trade(spark, sf_dir))


@query(DEGREE_SQL + " select node, out_degree, in_degree from d order by out_degree desc, node limit 15")
def top_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.top_owners(*_trade(spark, sf_dir))


@query(DEGREE_SQL + """ select count(*) as n_nodes, count(*) filter (out_degree > 0) as n_owners, count(*) filter (in_degree > 0) as n_assets, count(*) filter (in_degree = 0 and out_degree = 0) as n_isolated,
  round(avg(out_degree) filter (out_degree > 0), 6) as mean_owned, round(3 * avg(out_degree) filter (out_degree > 0), 6) as estimated_off_list, (select count(*) from e) as n_edges from d""")
def graph_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ownership.structure(*_trade(spark, sf_dir)), "mean_owned", "estimated_off_list")


@query(TRADE_SQL + """, u as (select owner as a, asset as b from e union select asset, owner from e), w as (select node, node as seen from n union select w.node, u.b from w join u on u.a = w.seen),
c as (select node, min(seen) as component from w group by node) select component, count(*) as size from c group by component""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.component_sizes(*_trade(spark, sf_dir))


@query()
def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _trade(spark, sf_dir)
    edges = scratch.cut(edges, "trade")
    labels = communities.communities(ownership.subgraph(edges, communities.largest_component(edges, nodes)))
    return labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"))


@query(FRACTION_SQL.format(listed="", gone="where s_suppkey <> (select min(anchor) from lister)") + """ select node, round_even(cast(f as double), 4) as fraction from every
where not listed and f >= 0.5 and node in (select 'c' || o_custkey from sent where l_suppkey = (select min(anchor) from lister))""")
def without_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier in debt taken off the list: customers of it that stay blocked."""
    edges, nodes, listed = _holdings(spark, sf_dir)
    first = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").agg(F.min("s_suppkey")).first()[0]  # one row
    return ownership.without_anchor(edges, nodes, listed, f"s{first}")
