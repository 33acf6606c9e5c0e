"""What a stage copies, writes and computes once."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators.quality import log_of, problem
from leadloom.operators.stage import staged_new
from leadloom.plans import queries_serving
from leadloom.plans.daily import Daily


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_new_columns_are_staged(spark):
    df = spark.range(3).selectExpr("id AS a", "id * 2 AS b")
    made = staged_new(df.withColumn("c", F.col("a") + F.col("b")), "c")
    assert made.columns == ["a", "b", "c"] and [tuple(r) for r in made.orderBy("a").collect()] == [(0, 0, 0), (1, 2, 3), (2, 4, 6)]
    assert "struct(c," in _plan(made) and "struct(a," not in _plan(made)


def test_log_without_filter_on_arrays(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "T"), (None, "y", "T")], "k int, v string, t string")
    log = log_of(df, "f", F.col("k"), F.col("t"), [
        problem(F.col("v").isNull(), "v", "missing", None, "none"), problem(F.col("k") > 0, F.col("v"), F.col("v"), F.col("v"), F.col("v"))])
    assert log.columns == ["archivo", "registro_id", "campo", "tipo", "valor_original", "accion", "empresa_id"]
    assert {tuple(r) for r in log.collect()} == {
        ("f", "1", "x", "x", "x", "x", None), ("f", "2", "v", "missing", None, "none", "T"), ("f", "2", None, None, None, None, "T")}
    assert "lambda" not in _plan(log)


def test_keyed_leads_are_not_written(spark):
    row = {c: "x" for c in fixed.REQUIRED["leads"]} | {
        "lead_id": "L1", "fecha_registro": "2026-08-26 20:28:00", "canal": "whatsapp", "telefono": "3104824081", "fecha_primer_contacto": None}
    raw = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row)).withColumn("orden_archivo", F.lit(1))
    d = Daily(SimpleNamespace(leads=lambda: raw), materialized=True)
    assert [(r.clave_dedup, r.es_principal) for r in d.keyed_leads.collect()] == [("tel:3104824081", True)]
    assert set(d._stages) == {"measured", "clients"}


def test_signals_are_matched_once(spark):
    catalogue = spark.createDataFrame([("S1", "red", "bolt")], "sku string, marca string, linea string")
    d = SimpleNamespace(_stages={}, catalogue=catalogue, signals=spark.createDataFrame([("L1", "red bolt"), ("L2", None)], "lead_id string, modelo_texto string"))
    first = queries_serving.signals_table(d)
    assert {(r.lead_id, r.sku_extraido) for r in first.collect()} == {("L1", "S1"), ("L2", None)}
    assert queries_serving.signals_table(d) is first
