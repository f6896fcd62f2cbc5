"""From raw documents to packed sequences: quality, toxicity, near duplicates, source mix, packing.

Each stage takes the documents that the one before kept, written and read again, and its decisions take effect: what it
rejects is gone, what it takes twice stands there twice. All but the last return the columns of ``documents``.

Defined results: rows travel as one nested column beside what a stage computes, so columns of any name come through. Null
and empty texts are scored like empty ones; they link with no other document, weigh nothing in the mix, and pack as the
closing id alone. Null doc_ids take part as rows of their own. Repeated rows are scored alike; of rows with equal word sets one
stays. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import quality as quality_
from veilframe.llm import toxicity as toxicity_
from veilframe.llm.mixing import mixed_documents
from veilframe.llm.ngram_join import jaccard_components
from veilframe.llm.packing import pack
from veilframe.llm.tables import nested, table, written
from veilframe.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's cut."""
    ship(spark)
    scored = quality_.score_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), keep=True)
    return scored.where(F.col("score") >= quality_.CUT).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the classifier's cut."""
    ship(spark)
    scored = toxicity_.score_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), keep=True)
    return scored.where(F.col("score") < toxicity_.CUT).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the row with the smallest doc_id (null last; of several, the first). Texts without words all stay.

    Rows are numbered once, in a written table, as the numbers must be the same for those that find and those that drop.
    """
    ship(spark)
    numbered = written(nested(docs, F.monotonically_increasing_id().alias("id")), "pipeline-numbered")
    found = jaccard_components(numbered.select("row.doc_id", "row.text", "id"), "id").where("component is not null")
    rows = written(found.select("row", "doc_id", "component"), "pipeline-rows")
    kept = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("kept"))
    lost = rows.join(kept, F.col("row") == F.col("kept"), "left_anti").select(F.col("row").alias("id"))
    return numbered.join(lost, "id", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    ship(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    ship(spark)
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: The classifiers and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
