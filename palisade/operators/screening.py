"""Screening: a stated set of query names against a corpus of any size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import kernels
from palisade.functions.folding import normalize
from palisade.functions.scores import ENSEMBLE_WEIGHTS
from palisade.operators.best_match import SCORERS, best_rows
from palisade.sources import scratch

TASK_NAMES = 20_000


def build_corpus(akas: DataFrame) -> DataFrame:
    """c_ord, entity_id, name of the primary aliases; c_ord follows (entity_id, name), repeats included."""
    primary = akas.filter("is_primary").select("entity_id", F.col("aka_name").alias("name"))
    return with_ordinal(primary, "c_ord", "entity_id", "name")


def with_ordinal(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with a long column that numbers them from 0 in the given order.

    Ranges are counted first, then each numbers its own rows, so no single task sees all of them.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    keyed = keyed.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    return (keyed.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
            .withColumn(name, F.col("_before") + F.col("_in")).drop("_at", "_part", "_in", "_before"))


def with_codes(names: DataFrame) -> DataFrame:
    """names (of a column norm) with codes; names without any sound code stand for themselves there."""
    return names.withColumn("codes", kernels.metaphone_of(F.col("norm"))).withColumn("codes", F.when(F.col("codes") == "", F.col("norm")).otherwise(F.col("codes")))


def prepared(names: DataFrame, name_col: str) -> DataFrame:
    """names with norm and codes; each normalised name's codes are made once."""
    norm = names.withColumn("norm", normalize(F.col(name_col)))
    return norm.join(with_codes(norm.select("norm").distinct()), "norm")


def score_all_queries(queries: DataFrame, corpus: DataFrame, block: int = 5000, weights=None) -> DataFrame:
    """For each query the best corpus row by each scorer: {jw,ts,ph,ens}_match_id and {..}_score, joined to queries by q_ord.

    queries: q_ord, query_name, ...; corpus: c_ord, entity_id, name. The query set is the stated one: its distinct names go
    to the corpus's tasks in blocks of `block`; each task keeps the best row per query and scorer, so no pair leaves it.
    Corpus rows of one normalised name are one, that with the lowest c_ord, and kernels run only on pairs whose upper
    bounds reach the task's best. Ties go to the lowest c_ord. Names normalise to scores of 0 where empty.
    """
    w = dict(weights or ENSEMBLE_WEIGHTS)
    first = corpus.groupBy(normalize(F.col("name")).alias("norm")).agg(F.min("c_ord").alias("c_ord"), F.min_by("entity_id", "c_ord").alias("entity_id"))
    side = scratch.cut(with_codes(first).select("c_ord", "entity_id", "norm", "codes"), "corpus")
    spread = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-side.count() // TASK_NAMES))
    side = side.repartition(spread)
    wanted = prepared(queries.select("query_name").distinct(), "query_name").select("norm", "codes").distinct()
    fields = "norm string, scorer string, entity_id string, c_ord long, score double"
    out, held = None, []

    def scored(rows: list[tuple[str, str]]) -> DataFrame:
        return side.mapInArrow(lambda batches: best_rows(batches, rows, w), fields)

    for row in wanted.toLocalIterator():
        held.append((row["norm"], row["codes"]))
        if len(held) == block:
            out = scored(held) if out is None else out.unionByName(scored(held))
            held = []
    if held or out is None:
        out = scored(held) if out is None else out.unionByName(scored(held))
    top = out.groupBy("norm").agg(*[F.max(F.when(F.col("scorer") == k, F.struct("score", (-F.col("c_ord")).alias("o"), "entity_id"))).alias(k) for k in SCORERS])
    named = queries.withColumn("norm", normalize(F.col("query_name")))
    return named.join(top, "norm", "left").select(
        *(named[c] for c in queries.columns), *[F.col(f"{k}.entity_id").alias(f"{k}_match_id") for k in SCORERS], *[F.col(f"{k}.score").alias(f"{k}_score") for k in SCORERS])


def near_duplicate_aliases(akas: DataFrame, least: int = 3, low: float = 0.70, score=None) -> DataFrame:
    """Pairs of different aliases of one entity (with at least `least`) whose Jaro-Winkler lies strictly between low and 1."""
    often = akas.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("entity_id")
    named = akas.join(often, "entity_id", "left_semi").select("entity_id", "aka_name").distinct()
    named = named.withColumn("norm", normalize(F.col("aka_name")))
    a = named.select("entity_id", F.col("aka_name").alias("name_a"), F.col("norm").alias("norm_a"))
    b = named.select("entity_id", F.col("aka_name").alias("name_b"), F.col("norm").alias("norm_b"))
    pairs = a.join(b, "entity_id").filter("name_a < name_b")
    score = score or kernels.jaro_winkler_of
    return (pairs.withColumn("similarity", score(F.col("norm_a"), F.col("norm_b")))
            .filter((F.col("similarity") > low) & (F.col("similarity") < 1.0)).select("entity_id", "name_a", "name_b", "similarity"))


def outcome(base: Column, new: Column, least: float = 0.01) -> Column:
    """match (new reaches 1), improved (by more than `least`) or unchanged."""
    return F.when(new >= 1.0, "match").when(new > base + least, "improved").otherwise("unchanged")


def gain_summary(scored: DataFrame) -> DataFrame:
    """outcome, n, mean_base, mean_canonical, mean_gain. scored: base, canonical, outcome."""
    return scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("base").alias("mean_base"), F.avg("canonical").alias("mean_canonical"), F.avg(F.col("canonical") - F.col("base")).alias("mean_gain"))
