"""The given tables, a fold rule, and shared folders for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """Whether a row is kept from learning; false for a null id, which no label can name."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learnable(doc_id: str | Column) -> Column:
    """Rows that a model may learn from: a non-null id outside the held-out fold."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return key.isNotNull() & ~held_out(key)


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z, all other characters unchanged. ASCII text takes the faster way."""
    text = F.col(text) if isinstance(text, str) else text
    kept = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(kept)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share: below ``spark.checkpoint.dir``, or below the
    session's warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to a shared folder and read again: cuts its lineage, and a lost executor
    costs nothing that was written. Shuffle files of the write are of no use after it and go."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a :func:`stored` table that nothing needs any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
