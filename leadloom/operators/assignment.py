"""Snake assignment of scored leads to the advisors of each point of sale.

The snake has a closed form: with n advisors in id order, seat j of advisor i is taken in turn
((j - 1) div 2) * 2n + (i when j is odd, 2n - 1 - i when even). Ranking seats by turn and leads by
priority turns the distribution into an equi-join on the rank, with no loop and no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.ranking import id_levels, with_rank

POINT = "punto_venta_id"


def seats(advisors: DataFrame) -> DataFrame:
    """Ranked seats per point of sale: `turno`, `asesor_id`, `orden`. Bounded by staff and capacity."""
    active = advisors.filter(F.col("activo") & (F.col("capacidad_diaria") > 0)).select(POINT, "asesor_id", "capacidad_diaria")
    numbered = with_rank(active, [POINT], [("asesor_id", True)], id_levels(active, "asesor_id"), name="i")
    per_point = active.groupBy(POINT).agg(F.count(F.lit(1)).alias("n"))
    i, n, j = F.col("i") - 1, F.col("n"), F.col("orden")
    turn = F.floor((j - 1) / 2) * 2 * n + F.when(j % 2 == 1, i).otherwise(2 * n - 1 - i)
    spread = (
        numbered.join(per_point, POINT).withColumn("orden", F.explode(F.sequence(F.lit(1), F.col("capacidad_diaria"))))
        .withColumn("posicion", turn.cast("long"))
    )
    ranked = with_rank(spread, [POINT], [("posicion", True)], [(F.shiftright("posicion", 10), True)], name="turno")
    return ranked.select(POINT, "turno", "asesor_id", "orden")


def assign(scored: DataFrame, advisors: DataFrame) -> DataFrame:
    """One row per scored lead: advisor and position in that advisor's list, or `sin_cupo`.

    Leads are ranked by priority, registration and id through buckets, so a point of sale with a
    third of all leads is not sorted in one task.
    """
    order = [("prioridad", False), ("fecha_registro", True), ("lead_id", True)]
    levels = [(F.col("prioridad"), False), (F.to_date("fecha_registro"), True), (F.hour("fecha_registro"), True)]
    ranked = with_rank(scored, [POINT], order, levels, name="turno")
    joined = ranked.join(seats(advisors), [POINT, "turno"], "left")
    return joined.select(
        "fecha_corte", "lead_id", "empresa_id", POINT, "asesor_id", F.col("orden").cast("int").alias("orden"),
        F.when(F.col("asesor_id").isNotNull(), "asignado").otherwise("sin_cupo").alias("estado"), "prioritario",
        "prioridad", "temperatura", "fecha_registro", "turno",
    )
