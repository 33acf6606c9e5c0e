"""All-text scans of the input files, with the checks on what must be present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import fixed
from leadloom.functions.text import is_blank

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("emisor", T.StringType()), T.StructField("hora", T.StringType()), T.StructField("texto", T.StringType())]))
CHAT_SCHEMA = T.StructType([
    T.StructField("conversacion_id", T.StringType()), T.StructField("lead_id", T.StringType()), T.StructField("canal", T.StringType()),
    T.StructField("fecha_inicio", T.StringType()), T.StructField("mensajes", MESSAGES)])


#: Lines of a block (a power of two), and partitions for each split: the sorted lines of a task stay a bounded part of a split.
_BLOCK_BITS, _PARTS = 16, 4


def missing_columns(df: DataFrame, required) -> list[str]:
    return sorted(set(required) - set(df.columns))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as text: `archivo`, `cabecera` (first record of its file), `registro`.

    Files are read as lines by as many tasks as they have splits. A line begins a record if an even number of quotes
    stands before it in its file: quotes are added up by piece (a block of lines of a split), then by line inside a piece. Lines that are
    records by themselves pass as they are; only those of records with line breaks are gathered, also across pieces.
    The lines are dealt by piece to a number of partitions that follows the splits: lines with their path shrink so much in a
    shuffle that partitions joined by their size there would be too large to sort.
    """
    place = [F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("inicio")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("linea"), "value", F.regexp_count("value", F.lit('"')).alias("comillas"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _PARTS * lines.rdd.getNumPartitions())  # fewer would be dealt again for the join
    lines = lines.select("archivo", F.struct("inicio", F.shiftright("linea", _BLOCK_BITS).alias("bloque")).alias("tramo"), "linea", "value", "comillas")
    totals = lines.groupBy("archivo", "tramo").agg(F.sum("comillas").alias("comillas"))
    in_file = Window.partitionBy("archivo").orderBy("tramo")
    earlier = F.coalesce(F.sum("comillas").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("archivo", "tramo", earlier.alias("antes"), (F.row_number().over(in_file) == 1).alias("primero"))
    inside = Window.partitionBy("archivo", "tramo").orderBy("linea")
    seen = lines.repartition(parts, "archivo", "tramo").join(totals, ["archivo", "tramo"]).withColumn("antes", F.col("antes") + F.coalesce(F.sum("comillas").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begins = F.col("antes") % 2 == 0
    seen = seen.withColumns({"empieza": begins, "n": F.sum(begins.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    alone = F.col("empieza") & (F.col("comillas") % 2 == 0)
    single = seen.filter(alone).select("archivo", (F.col("primero") & (F.col("n") == 1)).alias("cabecera"), F.col("value").alias("registro"))
    torn = seen.filter(~alone)
    # Lines before the first beginning of a piece go on with the last record of the nearest piece that has one.
    last = torn.filter("n > 0").groupBy("archivo", "tramo", "primero").agg(F.max("n").alias("ultimo"))
    heads = torn.filter("n = 0").select("archivo", "tramo").distinct()
    back = Window.partitionBy("archivo").orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    owner = last.unionByName(heads, allowMissingColumns=True).groupBy("archivo", "tramo").agg(F.max("ultimo").alias("ultimo"), F.max("primero").alias("primero"))
    owner = owner.withColumn("de", F.last(F.when(F.col("ultimo").isNotNull(), F.struct("tramo", "ultimo", "primero")), ignorenulls=True).over(back)).select("archivo", "tramo", "de")
    placed = torn.join(owner, ["archivo", "tramo"], "left").withColumn("de", F.when(F.col("n") > 0, F.struct("tramo", F.col("n").alias("ultimo"), "primero")).otherwise(F.col("de")))
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tramo", "linea", "value"))), lambda x: x["value"]), "\n")
    joined = placed.groupBy("archivo", "de").agg(text_.alias("registro")).select("archivo", (F.col("de.primero") & (F.col("de.ultimo") == 1)).alias("cabecera"), "registro")
    return single.unionByName(joined)


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """CSV with header; every column is text, blanks are NULL, missing columns fail by name. Quoted
    fields may hold line breaks; a file is still read by many tasks (see `csv_records`). The header is one line."""
    names = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", escape='"').columns
    if missing := sorted(set(fixed.REQUIRED[name]) - set(names)):
        raise ValueError(f"{name}: missing columns {missing}")
    record = F.regexp_replace("registro", "\\r$", "")
    rows = csv_records(spark, path).filter(~F.col("cabecera")).select(record.alias("r")).filter("r <> ''")
    df = rows.select(F.from_csv("r", ", ".join(f"`{n}` string" for n in names), {"escape": '"', "mode": "PERMISSIVE"}).alias("c")).select("c.*")
    return df.select(*(F.when(~is_blank(F.col(c)), F.col(c)).alias(c) for c in df.columns))


def read_chats(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested JSON chats; an object without one of the required keys fails the job that reads it."""
    df = spark.read.schema(CHAT_SCHEMA).json(path, multiLine=multi_line)
    lacking = F.lit(False)
    for c in fixed.REQUIRED["conversaciones"]:
        lacking = lacking | F.col(c).isNull()
    fail = F.raise_error(F.lit("conversaciones: objects without " + ", ".join(fixed.REQUIRED["conversaciones"]))).cast("string")
    return df.withColumn("conversacion_id", F.when(lacking, fail).otherwise(F.col("conversacion_id")))


def flatten_messages(chats: DataFrame) -> DataFrame:
    """One row per message; `orden` starts at 1."""
    return chats.select("conversacion_id", F.posexplode("mensajes").alias("i", "m")).select(
        "conversacion_id", (F.col("i") + 1).alias("orden"), "m.emisor", "m.hora", "m.texto")


def nested_fingerprint(messages: str = "mensajes") -> Column:
    """Content hash of a nested message array. Only equality matters."""
    return F.sha2(F.to_json(F.col(messages)), 256)
