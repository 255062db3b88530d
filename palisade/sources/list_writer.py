"""A list in the advanced XML format, written by Spark's own writer: one folder of files for each section."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.sources.advanced_xml import REFERENCE_SETS, SCHEMAS


def shaped(rows: DataFrame, tag: str) -> DataFrame:
    """rows with the section's columns and nested fields, by name; what rows don't have is null."""
    return rows.select(F.from_json(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))), SCHEMAS[tag]).alias("x")).select("x.*")


def reference_row(items: DataFrame) -> DataFrame:
    """items: kind, id, value, parent (few rows, as the format has it). The one row of the section of reference values."""
    own = {"area_code": ("_Description",), "legal_basis": ("_SanctionsProgramID",)}
    sets = []
    for kind, tag in REFERENCE_SETS.items():
        names = own.get(kind, ("_VALUE",))
        item = F.struct(F.col("id").alias("_ID"), *(F.col("value").alias(n) for n in names), F.col("parent").alias("_PartyTypeID"))
        sets.append(F.struct(F.collect_list(F.when(F.col("kind") == kind, item)).alias(tag)).alias(f"{tag}Values"))
    return items.agg(*sets)


def write_list(sections: dict[str, DataFrame], path: str) -> str:
    """Write each section (by its tag) below path; returns the path to parse, which ends in a slash."""
    for tag, rows in sections.items():
        shaped(rows, tag).write.format("xml").option("rootTag", f"{tag}List").option("rowTag", tag).save(f"{path}/{tag}")
    return path + "/"
