"""Quality classifier: hashed word n-gram logistic regression scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table
from furrow.llm.linear import MAX_LABELLED, margins, sigmoid, train

THRESHOLD = 0.3


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs with score (0 to 1, higher: quality 1 likelier) and predicted (1 if score >= threshold, else 0).

    Learns ``quality`` of labels (doc_id, quality; any other column is ignored)
    from max_labelled rows at most; everything is scored over whole texts. A score
    depends on the text alone: equal texts score alike, null and empty texts get
    the score of the intercept. Rows of docs stay as they are, repeated and null
    ids too; columns of docs named score or predicted are replaced.
    """
    spark = docs.sparkSession
    y = labels.select("doc_id", F.array(F.col("quality").cast("double")).alias("y")).where("quality is not null")
    model = spark.sparkContext.broadcast(train(docs, y, 1, max_labelled))

    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sigmoid(margins(batch.column("__text"), model.value)[:, 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got)], names=[*kept, "score"])

    schema = docs.select(*kept).schema.add("score", "double")
    scored = docs.select(*kept, F.col("text").cast("binary").alias("__text")).mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(column: str, of: int = 5):
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id") != 0)
    scored = score_quality(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")
