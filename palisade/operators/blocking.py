"""Blocking: candidate pairs by an equal key instead of all pairs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import kernels
from palisade.functions.folding import normalize


def first_letter_key(name: Column) -> Column:
    """First character of the normalised name; null where there is none."""
    return F.nullif(F.substring(normalize(name), 1, 1), F.lit(""))


def phonetic_key(name: Column) -> Column:
    """Sound code of the first token; null where it has none."""
    return F.nullif(kernels.metaphone_of(F.substring_index(normalize(name), " ", 1)), F.lit(""))


KEYS = {"first_letter": first_letter_key, "phonetic": phonetic_key}


def index(corpus: DataFrame, key, name_col: str = "name") -> DataFrame:
    """corpus with block_key; rows without a key aren't indexed."""
    return corpus.withColumn("block_key", key(F.col(name_col))).filter("block_key is not null")


def candidates(queries: DataFrame, indexed: DataFrame, key, query_col: str = "query_name") -> DataFrame:
    """Every query with each corpus row of its block."""
    return queries.withColumn("block_key", key(F.col(query_col))).join(indexed, "block_key")


def mean_bucket_fraction(indexed: DataFrame) -> DataFrame:
    """One row: 1 / number of blocks, 0 without any."""
    n = F.count_distinct("block_key")
    return indexed.agg(F.when(n > 0, 1.0 / n).otherwise(0.0).alias("mean_bucket_fraction"))


def blocking_recall(queries: DataFrame, corpus: DataFrame, key, strategy: str) -> DataFrame:
    """One row: strategy, recall of the true entity's row within the query's block, mean candidates, corpus size, reduction factor.

    queries: q_ord, query_name, true_entity_id; corpus: entity_id, name. Blocks are counted before they are joined, and the
    true row is looked up by its entity, so no candidate pair is made. key None is no blocking.
    """
    total = corpus.agg(F.count(F.lit(1)).alias("n_corpus"))
    if key is None:
        hits = queries.join(corpus.select(F.col("entity_id").alias("true_entity_id")).distinct().withColumn("found", F.lit(True)), "true_entity_id", "left")
        counts = hits.crossJoin(total).select("q_ord", F.coalesce("found", F.lit(False)).alias("found"), F.col("n_corpus").alias("n"))
    else:
        indexed = index(corpus, key).select("entity_id", "block_key")
        sizes = indexed.groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))
        where = indexed.select(F.col("entity_id").alias("true_entity_id"), "block_key").distinct().withColumn("found", F.lit(True))
        keyed = queries.withColumn("block_key", key(F.col("query_name")))
        counts = (keyed.join(sizes, "block_key", "left").join(where, ["true_entity_id", "block_key"], "left")
                  .select("q_ord", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("n", F.lit(0)).alias("n")))
    return (counts.agg(F.avg(F.col("found").cast("double")).alias("recall"), F.avg("n").alias("mean_candidates")).crossJoin(total)
            .select(F.lit(strategy).alias("strategy"), "recall", "mean_candidates", "n_corpus", (F.col("n_corpus") / F.nullif(F.col("mean_candidates"), F.lit(0.0))).alias("reduction_factor")))


def compare_strategies(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    out = blocking_recall(queries, corpus, None, "none")
    for name, key in KEYS.items():
        out = out.unionByName(blocking_recall(queries, corpus, key, name))
    return out
