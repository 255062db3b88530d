"""Headerless list CSVs, entity JSON lines, Parquet tables, and results kept between runs."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the flat format: columns in order, and its mark for nothing.
ENTITY_COLUMNS = ("ent_num", "sdn_name", "sdn_type", "program", "title", "call_sign", "vess_type", "tonnage", "grt", "vess_flag", "vess_owner", "remarks")
ALIAS_COLUMNS = ("ent_num", "alt_num", "alt_type", "alt_name", "alt_remarks")
NOTHING = "-0- "

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temporary views by table name, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_flat(spark: SparkSession, path: str, columns=ENTITY_COLUMNS) -> DataFrame:
    """All columns as strings; "-0- " is null. Rows with too many fields are dropped, short rows end in nulls."""
    schema = ", ".join(f"{c} string" for c in columns) + ", _beyond string"
    rows = (spark.read.schema(schema).option("encoding", "ISO-8859-1").option("nullValue", NOTHING).option("mode", "PERMISSIVE")
            .option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    return rows.filter("_beyond is null").drop("_beyond").filter(" or ".join(f"{c} is not null" for c in columns))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return read_flat(spark, path, ALIAS_COLUMNS)


def read_entities_json(spark: SparkSession, path: str) -> DataFrame:
    """id, caption, schema, properties (name to values) of entity JSON lines."""
    return spark.read.schema("id string, caption string, schema string, properties map<string, array<string>>").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there."""
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def smoke_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, and for entities and features also rows by type: measure, value, n."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit("rows").alias("measure"), F.lit(None).cast("string").alias("value"), "n")
        for kind in ("entity_type", "feature_type"):
            if kind in df.columns:
                part = part.unionByName(df.groupBy(F.col(kind).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(kind).alias("measure"), "value", "n"))
        out = part if out is None else out.unionByName(part)
    return out
