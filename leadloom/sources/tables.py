"""Idempotent writes: upserts, mirrors, partition replacement, run log and written stages."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task sorts when a stage is written by folders, about.
SORTED_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one that spark.checkpoint.dir names, else one in the warehouse.
    The session's settings stay as they are."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/leadloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a stage as Parquet under the shared folder and reads it back. The file system drops the
    stage when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    stage = spark.read.schema(df.schema).parquet(path)
    stage.written_at = path
    return stage


def by_partition(df: DataFrame, label: str, partition: str) -> DataFrame:
    """A written stage with a folder for each value of a column, so that joins on it can leave folders unread.

    A writing task sorts its rows by that column, and a split of few bytes may hold very many rows, so larger tables are
    dealt evenly first. `df` is read twice: a projection of written stages, which give their rows in one order."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    if (rows := df.count()) > SORTED_ROWS:
        df = df.repartition(max(-(-rows // SORTED_ROWS), spark.sparkContext.defaultParallelism), F.monotonically_increasing_id())
    df.write.partitionBy(partition).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    stage = spark.read.schema(df.schema).parquet(path)
    stage.written_at = path
    return stage


def discard(*stages: DataFrame) -> None:
    """Deletes written stages whose last reader is written itself, so nothing is left that could read them again."""
    for stage in stages:
        spark = stage.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(stage.written_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is updated are replaced; new keys are added. Running it twice changes
    nothing. With only key columns this is insert-or-nothing."""
    kept = target.join(updates.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(updates.select(*target.columns))


def mirror(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key still exists in the source."""
    return target.join(source.select(*keys), list(keys), "left_semi").select(*target.columns)


def replace_partitions(df: DataFrame, path: str, partition: str, replaced: Sequence = ()) -> None:
    """Replaces the partitions present in `df` and those named in `replaced`; a named one without rows is
    left empty, all others stay as they are."""
    spark = df.sparkSession
    if replaced:
        there = {str(r[0]) for r in df.filter(F.col(partition).cast("string").isin(*map(str, replaced))).select(partition).distinct().collect()}
        for value in map(str, replaced):
            if value not in there:
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    df.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert_partitioned(updates: DataFrame, path: str, keys: Sequence[str], partition: str) -> None:
    """Merges into a partitioned table, rewriting only the partitions the updates touch. The merge is
    written beside the table first, because a plan must not read what it overwrites."""
    spark = updates.sparkSession
    touched = spark.read.parquet(path).join(updates.select(partition).distinct(), partition, "left_semi")
    merged = materialize(merge_upsert(touched.select(*updates.columns), updates, keys), "merge")
    replace_partitions(merged, path, partition)


def cached_extractions(cache: DataFrame, extractor: str, version: str, defaults: dict) -> DataFrame:
    """Cache rows of one extractor and version; NULLs read as the default of their field."""
    df = cache.filter((F.col("extractor") == extractor) & (F.col("prompt_version") == version))
    filled = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items() if v is not None}
    return df.withColumns(filled)


class ExtractionStore:
    """What extractors said of each content: the cache of later runs and the raw record of all versions.

    Each run adds one batch, a folder of its own, so nothing is rewritten; a run that is repeated under its name
    replaces its batch. Rows keep what the extractor said; validation and audit are never stored.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, f"{schema}, extractor string, prompt_version string"

    def read(self) -> DataFrame:
        """All rows, with the batch that added them."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], f"{self.schema}, lote string")
        return self.spark.read.schema(f"{self.schema}, lote string").parquet(self.path)

    def cached(self, extractor: str, version: str) -> DataFrame:
        """Rows of one extractor and version, one for each content: that of the last batch."""
        mine = self.read().filter((F.col("extractor") == extractor) & (F.col("prompt_version") == version))
        rest = [c for c in mine.columns if c != "hash_contenido"]
        return mine.groupBy("hash_contenido").agg(F.max_by(F.struct(*rest), "lote").alias("r")).select("hash_contenido", "r.*")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Writes a batch and returns it as it is stored."""
        names = [f.split(" ")[0] for f in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/lote={batch}")
        return self.read().filter(F.col("lote") == batch)


RUN_SCHEMA = T.StructType([
    T.StructField("ejecucion_id", T.StringType()), T.StructField("iniciado_en", T.TimestampNTZType()),
    T.StructField("finalizado_en", T.TimestampNTZType()), T.StructField("estado", T.StringType()),
    T.StructField("fecha_corte", T.DateType()), T.StructField("disparador", T.StringType()),
    T.StructField("conteos", T.MapType(T.StringType(), T.LongType())), T.StructField("detalle_error", T.StringType()),
])


class RunLog:
    """Append-only run log: one row when a run opens and one when it closes; the latest row counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def open(self, run_id: str, started: datetime, trigger: str = "manual") -> None:
        self._append((run_id, started, None, "en_curso", None, trigger, {}, None))

    def close(self, run_id: str, started: datetime, finished: datetime, counts: dict[str, int] | None = None, day=None,
              error: str | None = None, trigger: str = "manual") -> str:
        counts = counts or {}
        state = "error" if error else "ok_con_respaldo" if counts.get("extraccion_respaldo") else "ok"
        self._append((run_id, started, finished, state, day, trigger, counts, error))
        return state

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(RUN_SCHEMA).parquet(self.path)
        last = F.max_by(F.struct(*(c for c in rows.columns if c != "ejecucion_id")), F.coalesce("finalizado_en", F.lit("0001-01-01").cast("timestamp_ntz")))
        return rows.groupBy("ejecucion_id").agg(last.alias("r")).select("ejecucion_id", "r.*")
