"""Names that arrive as a stream, screened against a fixed corpus block by block; and windowed counts of events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import kernels
from palisade.functions.folding import normalize
from palisade.operators.blocking import first_letter_key


def screen_stream(names: DataFrame, corpus: DataFrame, threshold: float = 0.9, key=first_letter_key, name_col: str = "name") -> DataFrame:
    """Each arriving name with the corpus rows of its block that reach the threshold. Stateless: no watermark is needed."""
    side = corpus.select("entity_id", F.col("name").alias("listed_name")).withColumn("norm_b", normalize(F.col("listed_name"))).withColumn("block_key", key(F.col("listed_name")))
    rows = names.withColumn("norm_a", normalize(F.col(name_col))).withColumn("block_key", key(F.col(name_col)))
    scored = rows.join(side, "block_key").withColumn("score", kernels.jaro_winkler_of(F.col("norm_a"), F.col("norm_b")))
    return scored.filter(F.col("score") >= threshold).drop("norm_a", "norm_b", "block_key")


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *by: str, value: Column | None = None) -> DataFrame:
    """Count (and sum of value) by tumbling window; rows later than `late` behind the newest are left out."""
    more = [F.sum(value).alias("total")] if value is not None else []
    return (events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), *more)
            .select(F.col("window.start").alias("window_start"), *by, "n", *(["total"] if more else [])))
