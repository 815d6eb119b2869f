"""Reading and small shared steps of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word: the longest run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again, so that nothing computes them twice.

    The table stays, below a folder named like the application, as its readers may be lazy.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def fold(doc_id: str, folds: int) -> Column:
    """Which of ``folds`` folds a document is in; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def held_out(folds: int, fold_kept_out: int) -> Column:
    """True for rows that no model may learn from; a null id is never held out."""
    return F.coalesce(fold("doc_id", folds) == fold_kept_out, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """About ``bound`` labelled documents to fit on: (doc_id, text, label), chosen by hash of the id.

    Several label rows of one document count as the largest of them; null
    labels and null ids are left out.  Only the chosen labels are broadcast,
    and ``bound`` limits their number, so no text is shuffled for it.
    """
    known = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    share = min(1.0, bound / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30))
    chosen = known.where(draw < int(share * (1 << 30)))
    return docs.select("doc_id", "text").where(learn).join(F.broadcast(chosen), "doc_id")
