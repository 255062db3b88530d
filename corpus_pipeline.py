"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, decontamination, packing.

Each stage takes the documents that the one before kept. Stages return the columns of documents, the last the packed
pieces. A stage's scratch tables go when the next stage begins.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palisade.sources import scratch
from palisade.llm.edit_match import decontaminate
from palisade.llm.jaccard_groups import keep_one
from palisade.llm.packing import pack_documents
from palisade.llm.quality import keep_good
from palisade.llm.substring_dedup import rewrite

LABEL = "pipeline stage"


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.clear(spark, LABEL)
        with scratch.labelled(LABEL):
            return work(spark, docs, sf_dir)
    return stage


#: Documents that fail the quality rules go.
quality_rules = _stage(lambda spark, docs, sf_dir: keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
#: Of documents that are near duplicates (80 percent of their five-word shingles), the one with the smallest id stays.
jaccard_join = _stage(lambda spark, docs, sf_dir: keep_one(docs, size=5, percent=80))
#: Passages of 50 words or more that an earlier document has are taken out; documents of which nothing is left go.
substring_dedup = _stage(lambda spark, docs, sf_dir: rewrite(docs))
#: Documents that hold a benchmark item go.
decontamination = _stage(lambda spark, docs, sf_dir: decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
#: What is left becomes sequences of at most 1024 tokens.
packing = _stage(lambda spark, docs, sf_dir: pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))

STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("packing", packing)]
#: No SQL: matching by edits and packing aren't expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
