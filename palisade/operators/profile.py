"""Profiles of a list: composition, growth, alias quality and how far entities can be identified."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def composition(rows: DataFrame, kind: str) -> DataFrame:
    """kind, n, share (percent of all rows, null kinds included in the divisor, 1 digit)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return (rows.filter(F.col(kind).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row
            .select(kind, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("share")))


def value_counts(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    out = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), by).limit(top) if top else out


def program_counts(entities: DataFrame, top: int | None = None) -> DataFrame:
    """Entities by program, each counted under all of its programs."""
    return value_counts(entities.select(F.explode("programs").alias("program")), "program", top)


def monthly_growth(rows: DataFrame, date: str, by: tuple[str, ...] = ()) -> DataFrame:
    """month_end, added, cumulative: every month from the first to the last (of each group), empty ones too."""
    months = rows.filter(F.col(date).isNotNull()).groupBy(*by, F.last_day(F.col(date)).alias("month_end")).agg(F.count(F.lit(1)).alias("added"))
    span = months.groupBy(*by).agg(F.trunc(F.min("month_end"), "month").alias("lo"), F.trunc(F.max("month_end"), "month").alias("hi"))
    every = span.select(*by, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month")).select(*by, F.last_day("month").alias("month_end"))
    running = W.partitionBy(*by).orderBy("month_end").rowsBetween(W.unboundedPreceding, 0)  # a row a month
    return every.join(months, [*by, "month_end"], "left").fillna(0, ["added"]).withColumn("cumulative", F.sum("added").over(running))


def added_between(rows: DataFrame, date: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """rows dated from since on and before until (dates as text, null: open); rows without a date are left out."""
    out = rows.filter(F.col(date).isNotNull())
    if since is not None:
        out = out.filter(F.col(date) >= F.to_timestamp(F.lit(since)))
    return out if until is None else out.filter(F.col(date) < F.to_timestamp(F.lit(until)))


def span(rows: DataFrame, date: str) -> DataFrame:
    """One row: first_date, last_date, n (rows), n_dated."""
    day = F.col(date).cast("date")
    return rows.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count(F.lit(1)).alias("n"), F.count(date).alias("n_dated"))


def weak_alias_ratio(programs: DataFrame, akas: DataFrame, least: int = 30) -> DataFrame:
    """program, n_entities, mean_aliases, n_weak, n_aliases, weak_ratio of programs of at least `least` entities.

    programs: entity_id, program; akas: entity_id, is_weak.
    """
    per = akas.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_weak").alias("weak"))
    rows = programs.join(per, "entity_id", "left").fillna(0, ["n", "weak"])
    return (rows.groupBy("program").agg(F.count(F.lit(1)).alias("n_entities"), F.avg("n").alias("mean_aliases"), F.sum("weak").alias("n_weak"), F.sum("n").alias("n_aliases"))
            .filter(F.col("n_entities") >= least).withColumn("weak_ratio", F.coalesce(F.try_divide("n_weak", "n_aliases"), F.lit(0.0))))


def group_ratio(ratios: DataFrame, pattern: str, name: str) -> DataFrame:
    """Unweighted mean ratio of the programs that the pattern finds."""
    return ratios.filter(F.coalesce(F.col("program").rlike(pattern), F.lit(False))).agg(F.lit(name).alias("grp"), F.avg("weak_ratio").alias("mean_ratio"), F.count(F.lit(1)).alias("n"))


def flag(rows: DataFrame, key: str, having: DataFrame, name: str) -> DataFrame:
    """rows with a boolean: does `having` hold the row's key?"""
    side = having.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return rows.join(side, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def coverage(rows: DataFrame, flags: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """n, n_<flag>, rate_<flag> for each flag, for all flags together and for none of them."""
    everything, nothing = F.lit(True), F.lit(True)
    for f in flags:
        everything, nothing = everything & F.col(f), nothing & ~F.col(f)
    named = [*((f, F.col(f)) for f in flags), ("all", everything), ("none", nothing)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x for name, c in named for x in (F.count_if(c).alias(f"n_{name}"), F.avg(c.cast("int")).alias(f"rate_{name}"))])


def has_month(value: Column) -> Column:
    """Dates of year precision have four characters."""
    return F.coalesce(F.length(value) > 4, F.lit(False))


def any_contains(items: Column, part: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x.contains(part)), F.lit(False))


def classify(text: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    """The label of the first rule whose part the text contains."""
    out = F.lit(other)
    for part, label in reversed(rules):
        out = F.when(text.contains(part), label).otherwise(out)
    return out


def keep_first(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", rank).filter("_n = 1").drop("_n")


def top_rows(rows: DataFrame, n: int, by: str, *ties: str, largest: bool = True) -> DataFrame:
    return rows.orderBy(F.desc(by) if largest else F.asc(by), *ties).limit(n)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """bin (from 0), n, density of values in [low, high]; the last bin holds high itself."""
    inside = rows.filter((F.col(value) >= low) & (F.col(value) <= high))
    at = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))  # over bins
    return counts.withColumn("density", F.col("n") / (total * ((high - low) / bins)))


def compare_formats(sources: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """source, n_entities, n_aliases: distinct ids of each source's entity table, rows of its alias table."""
    out = None
    for name, (entities, akas) in sources.items():
        part = entities.agg(F.count_distinct(entities.columns[0]).alias("n_entities")).crossJoin(akas.agg(F.count(F.lit(1)).alias("n_aliases"))).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("source", "n_entities", "n_aliases")
