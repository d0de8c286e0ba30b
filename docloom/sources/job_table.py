"""The job table as a written table that changes of a few jobs touch in a few places.

Rows are in folders by a hash of the job. A micro-batch adds its changes as a delta of one row per job and touches
no row. A fold takes all deltas not folded yet, reads the folders their jobs are in, and replaces those; all other
files stay as they are. Readers see the rows with the open deltas on top.

Rows carry the places of the events that wrote them, and a change counts only if its place is later. So folding
a delta twice, or a batch again after a crash, changes nothing; a crash between delta and fold leaves the delta open,
one between fold and mark has it folded again. Deltas stay after the fold, so the rows can be made again from the
registered jobs and all deltas, should a crash hit the moment in which Spark swaps a folder for its new files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import status
from docloom.sources import sinks
from docloom.sources.keyed import PART, part_of

#: The places that rows carry.
PLACES = ("status_seq", "step_seq", "error_seq", "completed_seq")


@dataclass(frozen=True)
class JobTable:
    """``schema`` is that of the job rows; ``place`` the type of an event's ``seq``."""

    path: str
    parts: int
    schema: T.StructType
    place: T.DataType = T.LongType()

    @property
    def _row_schema(self) -> T.StructType:
        places = [T.StructField(c, self.place) for c in PLACES]
        return T.StructType([*self.schema.fields, *places, T.StructField(PART, T.IntegerType())])

    def create(self, jobs: DataFrame) -> None:
        """Write the registered jobs."""
        rows = jobs.select(*self.schema.names, *[F.lit(None).cast(self.place).alias(c) for c in PLACES])
        dealt = rows.withColumn(PART, part_of("job_id", self.parts)).hint("rebalance", PART)
        dealt.write.partitionBy(PART).parquet(f"{self.path}/rows")

    def add(self, changes: DataFrame, batch_id: int, generation: int = 0) -> None:
        """Write the delta of a batch: rows of :func:`docloom.operators.status.job_changes`."""
        sinks.save_batch(changes, f"{self.path}/deltas", batch_id, generation)

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._row_schema).parquet(f"{self.path}/rows")

    def _change_schema(self) -> T.StructType:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        return T.StructType([T.StructField(c, kinds.get(c, self.place)) for c in status.CHANGE_COLUMNS])

    def open_deltas(self, spark: SparkSession) -> DataFrame:
        """Deltas that are not folded yet, with their ``generation`` and ``batch_id``."""
        deltas = _exists(spark, f"{self.path}/deltas")
        if not deltas:
            return spark.createDataFrame([], T.StructType([*self._change_schema().fields, *_PLACE_FIELDS]))
        rows = sinks.read_batches(spark, f"{self.path}/deltas", self._change_schema())
        if not _exists(spark, f"{self.path}/folded"):
            return rows
        folded = sinks.read_batches(spark, f"{self.path}/folded", T.StructType([T.StructField("part", T.IntegerType())]))
        return rows.join(folded.select("generation", "batch_id").distinct(), ["generation", "batch_id"], "left_anti")

    def fold(self, spark: SparkSession) -> list[int]:
        """Fold open deltas into the rows; gives the folders that were replaced."""
        deltas = self.open_deltas(spark)
        batches = [tuple(r) for r in deltas.select("generation", "batch_id").distinct().collect()]
        if not batches:
            return []
        changes = status.merge_changes(deltas.drop("generation", "batch_id"))
        part = part_of("job_id", self.parts)
        touched = sorted(r[0] for r in changes.select(part.alias("part")).distinct().collect())
        rows = self._rows(spark).filter(F.col(PART).isin(touched))
        folded = status.apply_newer(rows, changes).hint("rebalance", PART)
        writer = folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PART).parquet(f"{self.path}/rows")
        mark = spark.createDataFrame([(p,) for p in touched], "part int")
        for generation, batch_id in batches:
            sinks.save_batch(mark, f"{self.path}/folded", batch_id, generation)
        return touched

    def read(self, spark: SparkSession) -> DataFrame:
        """The job rows with all changes."""
        changes = status.merge_changes(self.open_deltas(spark).drop("generation", "batch_id"))
        return status.apply_newer(self._rows(spark), changes).select(*self.schema.names)


_PLACE_FIELDS = [T.StructField(c, T.LongType()) for c in ("generation", "batch_id")]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
