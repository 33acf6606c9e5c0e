"""One run of the daily plan: every table is written once, counted while it is written, and the run is logged."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadloom.operators import catalogue, extraction, quality
from leadloom.plans.daily import Daily
from leadloom.sources.tables import ExtractionStore, RunLog, replace_partitions


def counted(df: DataFrame, name: str, write: Callable[[DataFrame], None], **more: Column) -> dict[str, int]:
    """Writes a table and returns its rows, and the rows for which further conditions hold, observed by the write itself."""
    seen = Observation()
    sums = [F.count(F.when(when, 1)).alias(f"{name}_{k}") for k, when in more.items()]
    write(df.observe(seen, F.count(F.lit(1)).alias(name), *sums))
    return {k: int(v or 0) for k, v in seen.get.items()}


def run(plan: Daily, folder: str, log: RunLog, store: ExtractionStore, primary: extraction.Extractor | None = None, run_id: str | None = None,
        trigger: str = "manual", clock: Callable[[], datetime] = datetime.now) -> str:
    """Runs the plan into the tables of `folder` and returns the state of the run: ok, ok_con_respaldo or error.

    The log has a row as soon as the run begins, and one when it ends, with the counts by table; after an error
    with those written until then. Tables of a day replace their day, all others their former content, so a repeated run
    leaves the same tables. Chats already known to the store are not extracted again.
    """
    run_id, began, counts = run_id or uuid.uuid4().hex, clock(), {}
    log.open(run_id, began, trigger)

    def whole(name: str, df: DataFrame, **more: Column) -> None:
        counts.update(counted(df, name, lambda d: d.write.mode("overwrite").parquet(f"{folder}/{name}"), **more))

    def of_day(name: str, df: DataFrame, **more: Column) -> None:
        counts.update(counted(df, name, lambda d: replace_partitions(d, f"{folder}/{name}", "fecha_corte"), **more))
        if not counts[name]:
            replace_partitions(df.limit(0), f"{folder}/{name}", "fecha_corte", [day])

    try:
        counts["leads_crudos"] = plan.measured.count()
        day = plan.cutoff.first().fecha_corte
        for name, table in (("catalogo", plan.catalogue), ("asesor", plan.advisors), ("historico_cierre", plan.history), ("cliente", plan.clients),
                            ("conversacion", plan.chats), ("mensaje", plan.messages)):
            whole(name, table)
        plan = plan.with_extraction(store, primary or plan.rules, run_id)
        counts |= plan.extraction_counts
        skus = catalogue.match_texts(plan.signals, "modelo_texto", plan.catalogue).select("modelo_texto", F.col("sku").alias("sku_extraido"))
        source = {"extractor": F.lit(plan.extractor.name), "prompt_version": F.lit(plan.extractor.version)}
        whole("senales_lead", plan.signals.join(skus, "modelo_texto", "left").withColumns(source))
        of_day("score", plan.scores)
        of_day("asignacion", plan.assignment, asignados=F.col("estado") == "asignado", sin_cupo=F.col("estado") == "sin_cupo", prioritarios=F.col("prioritario"))
        whole("problema_calidad", plan.quality_log.withColumn("ejecucion_id", F.lit(run_id)), evidencia=F.col("tipo") == "evidencia_sin_respaldo")
        whole("lead", quality.with_flags(plan.leads, plan.quality_log))
        return log.close(run_id, began, clock(), counts, day, trigger=trigger)
    except Exception as error:  # noqa: BLE001  whatever stops a run is what its log row has to say
        return log.close(run_id, began, clock(), counts, error=repr(error), trigger=trigger)
