"""Read views: the daily list, role-scoped visibility, advisor load and list projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators.entities import CLIENT
from leadloom.operators.ranking import id_levels, with_rank
from leadloom.sources.tables import materialize

VERSION = r"^v[1-9][0-9]*$"


def version_number(c: Column) -> Column:
    """Number of a version name (`v10` is 10); NULL when the name is malformed."""
    return F.when(c.rlike(VERSION), F.substring(c, 2, 2_147_483_647).try_cast("decimal(38,0)"))


def latest_scores(scores: DataFrame) -> DataFrame:
    """Per lead and cut-off the row with the highest version by number."""
    keys = ["lead_id", "fecha_corte"]
    rest = [c for c in scores.columns if c not in keys]
    top = scores.groupBy(*keys).agg(F.max_by(F.struct(*rest), version_number(F.col("version_score"))).alias("s"))
    return top.select(*keys, "s.*")


def daily_list(assignment: DataFrame, leads: DataFrame, clients: DataFrame, models: DataFrame, signals: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per assigned or unseated lead and date, with its score and chat signals."""
    lead = leads.select("lead_id", *CLIENT, "punto_venta_id", "canal", "modelo_texto_original", "sku_interes", "marca_interes",
                        "modelo_disponible_pv", "estado_gestion", "fecha_registro", "fecha_primer_contacto")
    person = clients.select(*CLIENT, "nombre", "telefono")
    form = models.select(F.col("sku").alias("sku_interes"), F.col("nombre_completo").alias("modelo"))
    said = models.select(F.col("sku").alias("sku_extraido"), F.col("nombre_completo").alias("ia_modelo"), F.col("precio_lista").alias("ia_precio_lista"))
    names = {"modelo_texto": "ia_modelo_texto", **{c: f"ia_{c}" for c in (
        "cuota_inicial_cop", "menciona_cuota", "forma_pago", "intencion", "objecion", "pidio_cita", "pidio_cotizacion", "cliente_respondio", "conversaciones")}}
    talk = signals.select("lead_id", "sku_extraido", *(F.col(a).alias(b) for a, b in names.items()))
    points = latest_scores(scores).select("lead_id", "fecha_corte", "version_score", "prioridad", "temperatura", "puntos_calidad",
                                          "puntos_conversacion", "puntos_urgencia", "razones")
    return (
        assignment.select("fecha_corte", "lead_id", "asesor_id", "orden", "estado", "prioritario")
        .join(lead, "lead_id").join(person, list(CLIENT)).join(form, "sku_interes", "left")
        .join(talk, "lead_id", "left").join(said, "sku_extraido", "left").join(points, ["lead_id", "fecha_corte"], "left")
    )


# --- visibility -------------------------------------------------------------------------------
def managers(users: DataFrame) -> DataFrame:
    return users.filter(F.col("rol") == "gerente").select("user_id", "empresa_id")


def in_tenant(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows each user sees because they belong to the user's tenant; a NULL tenant is seen by nobody."""
    return df.join(users.select("user_id", "empresa_id"), "empresa_id")


def latest_assignment(assignment: DataFrame) -> DataFrame:
    last = assignment.groupBy("empresa_id").agg(F.max("fecha_corte").alias("fecha_corte"))
    return assignment.join(last, ["empresa_id", "fecha_corte"], "left_semi")


def assigned_clients(users: DataFrame, assignment: DataFrame, leads: DataFrame) -> DataFrame:
    """(user, client) pairs of advisors at the latest cut-off of their tenant."""
    advisors = users.filter(F.col("asesor_id").isNotNull()).select("user_id", "asesor_id", "empresa_id")
    own = latest_assignment(assignment).select("lead_id", "asesor_id", "empresa_id").join(advisors, ["asesor_id", "empresa_id"])
    return own.select("user_id", "lead_id").join(leads.select("lead_id", *CLIENT), "lead_id").select("user_id", *CLIENT).distinct()


def visible_clients(users: DataFrame, clients: DataFrame, assignment: DataFrame, leads: DataFrame) -> DataFrame:
    keys = clients.select(*CLIENT)
    return in_tenant(keys, managers(users)).select("user_id", *CLIENT).unionByName(assigned_clients(users, assignment, leads)).distinct()


def visible_leads(users: DataFrame, assignment: DataFrame, leads: DataFrame) -> DataFrame:
    """(user, lead): managers see their tenant, advisors every lead of their assigned clients."""
    rows = leads.select("lead_id", *CLIENT)
    of_manager = in_tenant(rows, managers(users)).select("user_id", "lead_id", "empresa_id")
    of_advisor = rows.join(assigned_clients(users, assignment, leads), list(CLIENT)).select("user_id", "lead_id", "empresa_id")
    return of_manager.unionByName(of_advisor).distinct()


def inherited(df: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows visible because their parent is, with the user that sees them."""
    return df.join(parents, keys)


def visible_assignment(users: DataFrame, assignment: DataFrame) -> DataFrame:
    """Managers see every date of their tenant, advisors their own rows of the latest one."""
    of_manager = in_tenant(assignment, managers(users))
    advisors = users.select("user_id", "asesor_id", "empresa_id")
    of_advisor = latest_assignment(assignment).join(advisors, ["asesor_id", "empresa_id"])
    cols = ["user_id", "fecha_corte", "lead_id", "asesor_id", "empresa_id"]
    return of_manager.select(*cols).unionByName(of_advisor.select(*cols)).distinct()


class Scope:
    """What one user sees. Entitlements are the user's own rows, and tables are cut to them by semi joins before anything else,
    so of tables partitioned by tenant only the user's partitions are read. A user without tenant sees open tables only.

    Entitlements are written first: Spark then knows that they are small. Planned over all users they look large, and the joins
    would deal every table by tenant and sort all rows of a tenant in one task."""

    def __init__(self, users: DataFrame, user_id: str) -> None:
        own = F.col("user_id") == user_id
        mine = materialize(users.filter(own & F.col("empresa_id").isNotNull()).select("user_id", "empresa_id", "rol", "asesor_id"), "entitlements").filter(own)
        self.tenants = mine.select("empresa_id")
        self.managed = mine.filter(F.col("rol") == "gerente").select("empresa_id")
        self.seat = mine.filter(F.col("asesor_id").isNotNull()).select("asesor_id", "empresa_id")

    def of_tenant(self, df: DataFrame) -> DataFrame:
        """Rows of the user's tenant."""
        return df.join(self.tenants, "empresa_id", "left_semi")

    def managers_only(self, df: DataFrame) -> DataFrame:
        """Rows of the tenant for its manager: history and quality log."""
        return df.join(self.managed, "empresa_id", "left_semi")

    def _own_latest(self, assignment: DataFrame) -> DataFrame:
        return latest_assignment(self.of_tenant(assignment)).join(self.seat, ["asesor_id", "empresa_id"], "left_semi")

    def _clients(self, assignment: DataFrame, leads: DataFrame) -> DataFrame:
        """Clients assigned to the user at the latest cut-off of the tenant."""
        own = self._own_latest(assignment).select("lead_id")
        return self.of_tenant(leads).join(own, "lead_id", "left_semi").select(*CLIENT).distinct()

    def _both(self, df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
        """The manager's tenant, and elsewhere the rows that the others name."""
        elsewhere = df.join(self.tenants.join(self.managed, "empresa_id", "left_anti"), "empresa_id", "left_semi")
        return self.managers_only(df).unionByName(elsewhere.join(others, list(keys), "left_semi"))

    def clients(self, clients: DataFrame, assignment: DataFrame, leads: DataFrame) -> DataFrame:
        return self._both(clients, self._clients(assignment, leads), CLIENT)

    def leads(self, assignment: DataFrame, leads: DataFrame) -> DataFrame:
        return self._both(leads, self._clients(assignment, leads), CLIENT)

    def assignment(self, assignment: DataFrame) -> DataFrame:
        """All dates for the manager, the own rows of the latest one for an advisor."""
        return self._both(assignment, self._own_latest(assignment).select("fecha_corte", "lead_id", "empresa_id"), ["fecha_corte", "lead_id", "empresa_id"])

    def inherited(self, df: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Rows whose parent the user sees."""
        return df.join(parents.select(*keys), list(keys), "left_semi")


# --- boards -----------------------------------------------------------------------------------
def advisor_load(assignment: DataFrame, advisors: DataFrame) -> DataFrame:
    """Assigned and priority leads of active advisors per date, against their capacity."""
    counts = assignment.filter(F.col("estado") == "asignado").groupBy("fecha_corte", "asesor_id").agg(
        F.count(F.lit(1)).alias("asignados"), F.count_if("prioritario").alias("prioritarios"))
    active = advisors.filter("activo").select("asesor_id", "empresa_id", "punto_venta_id", "nombre", "capacidad_diaria")
    return counts.join(active, "asesor_id").withColumn("uso", F.col("asignados") / F.col("capacidad_diaria"))


def assignment_counts(assignment: DataFrame) -> DataFrame:
    return assignment.agg(
        F.count(F.lit(1)).alias("asignacion"), F.count_if(F.col("estado") == "asignado").alias("asignados"),
        F.count_if(F.col("estado") == "sin_cupo").alias("sin_cupo"), F.count_if("prioritario").alias("prioritarios"))


def temperature_counts(scores: DataFrame) -> DataFrame:
    """All four temperatures in fixed order, zero where none."""
    counts = scores.groupBy("temperatura").agg(F.count(F.lit(1)).alias("n"))
    spark = scores.sparkSession
    fixed_order = spark.createDataFrame([(i, t) for i, t in enumerate(fixed.TEMPERATURES)], "posicion int, temperatura string")
    return fixed_order.join(counts, "temperatura", "left").select("posicion", "temperatura", F.coalesce("n", F.lit(0)).alias("leads"))


def hours_to_day_end(registered: Column, day: Column) -> Column:
    """Hours from a moment to the last microsecond of a day, to one decimal."""
    end = F.timestamp_add("MICROSECOND", F.lit(86_399_999_999), day.cast("timestamp_ntz"))
    return F.bround(F.timestamp_diff("MICROSECOND", registered, end) / F.lit(3_600_000_000.0), 1)


def contacted_in_time(rows: DataFrame, limit: float = 24.0) -> DataFrame:
    """(on time, measurable) per date: leads younger than the limit and contacted ones without a date do not count."""
    age = hours_to_day_end(F.col("fecha_registro"), F.col("fecha_corte"))
    wait = age - hours_to_day_end(F.col("fecha_primer_contacto"), F.col("fecha_corte"))
    no_date = F.col("fecha_primer_contacto").isNull()
    measurable = (age >= limit) & (~no_date | (F.col("estado_gestion") == fixed.UNMANAGED))
    return rows.groupBy("fecha_corte").agg(
        F.count_if(measurable & ~no_date & (wait <= limit)).alias("a_tiempo"), F.count_if(measurable).alias("medibles"))


def unseated(rows: DataFrame) -> DataFrame:
    """Leads without a seat in the order a manager reviews them: priority ones, then by score."""
    df = rows.filter(F.col("estado") == "sin_cupo").withColumn("p", F.col("prioritario").cast("int"))
    order = [("p", False), ("prioridad", False), ("lead_id", True)]
    return with_rank(df, [], order, [(F.col("p"), False), (F.col("prioridad"), False), *id_levels(df, "lead_id")], "posicion").drop("p")


def company_list(rows: DataFrame) -> DataFrame:
    df = rows.filter(F.col("estado") == "asignado")
    order = [("prioridad", False), ("fecha_registro", True), ("lead_id", True)]
    return with_rank(df, [], order, [(F.col("prioridad"), False), (F.to_date("fecha_registro"), True), (F.hour("fecha_registro"), True)], "posicion")


def advisor_rows(rows: DataFrame) -> DataFrame:
    """Columns of the advisor's list."""
    pay = F.when(F.col("ia_forma_pago") == "contado", "Contado").when(F.col("ia_forma_pago") == "credito", "Crédito").otherwise("—")
    return rows.select(
        "fecha_corte", "asesor_id", "orden", "lead_id", "temperatura", "prioridad", "nombre", F.coalesce("telefono", F.lit("—")).alias("telefono"), "canal",
        F.coalesce("ia_modelo", "modelo", F.lit("—")).alias("modelo"), F.col("ia_cuota_inicial_cop").alias("cuota"), pay.alias("pago"),
        hours_to_day_end(F.col("fecha_registro"), F.col("fecha_corte")).alias("horas"), "estado_gestion")


def _pesos(c: Column) -> Column:
    return F.concat(F.lit("$"), F.translate(F.format_number(c, 0), ",", "."))


def opening_sentence(rows: DataFrame) -> DataFrame:
    """How to open the call, from what is already known."""
    c = F.col
    first_name = F.try_element_at(F.filter(F.split(F.coalesce("nombre", F.lit("")), r"(?U)\s+"), lambda w: w != ""), F.lit(1))
    name = F.coalesce(first_name, F.lit("El cliente"))

    def filled(x: Column) -> Column:
        return F.when(x != "", x)

    asked = F.coalesce(filled(c("modelo")), filled(c("modelo_texto_original")))
    request = F.when(asked.isNotNull(), F.concat(F.lit("Pidió información de "), asked, F.lit(" por "), c("canal"), F.lit("."))).otherwise("No dejó modelo de interés.")
    cold = F.concat(name, F.lit(" no tiene conversación de WhatsApp. "), request,
                    F.lit(" Califíquelo: confirme modelo, forma de pago, cuota inicial y si quiere pasar a verla."))
    model = F.coalesce(filled(c("ia_modelo")), filled(c("ia_modelo_texto")))
    parts = F.array_join(F.filter(F.array(
        F.concat(F.lit("preguntó por la "), model),
        F.when(c("ia_cuota_inicial_cop") != 0, F.concat(F.lit("tiene "), _pesos(c("ia_cuota_inicial_cop")), F.lit(" de inicial"))),
        F.when(c("ia_forma_pago") == "credito", "va por crédito").when(c("ia_forma_pago") == "contado", "paga de contado"),
    ), lambda p: p.isNotNull()), ", ")
    hours = hours_to_day_end(c("fecha_registro"), c("fecha_corte"))
    tail = [
        F.when(c("ia_pidio_cita"), ". Pidió cita").when(c("ia_pidio_cotizacion"), ". Pidió cotización"),
        F.when(c("ia_objecion") != "ninguna", F.concat(F.lit(". Ojo: puso una objeción de "), F.replace(c("ia_objecion"), F.lit("_"), F.lit(" ")))),
        F.when(~F.coalesce("ia_cliente_respondio", F.lit(False)), ". No respondió al último mensaje"),
        F.when((c("estado_gestion") == fixed.UNMANAGED) & hours.isNotNull(), F.concat(F.lit(". Lleva "), F.bround(hours, 0).cast("long").cast("string"), F.lit(" h sin contacto"))),
    ]
    warm = F.concat(name, F.lit(" "), F.when(parts != "", parts).otherwise("escribió sin dar detalles"), *(F.coalesce(t, F.lit("")) for t in tail), F.lit("."))
    return rows.select("fecha_corte", "lead_id", F.when(F.coalesce(c("ia_conversaciones"), F.lit(0)) > 0, warm).otherwise(cold).alias("frase"))


def other_leads(leads: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each chosen lead, the other leads of the same client. `chosen` holds one lead per client,
    so the result grows with the leads, not with their pairs."""
    picked = chosen.select(*CLIENT, F.col("lead_id").alias("lead_elegido"))
    rows = leads.select("lead_id", *CLIENT, "canal", "estado_gestion", "fecha_registro", "modelo_texto_original")
    return rows.join(picked, list(CLIENT)).filter(F.col("lead_id") != F.col("lead_elegido"))


def evidence_of_version(extractions: DataFrame, chats: DataFrame) -> DataFrame:
    """Evidence of the extractor version that produced the signals: `chats` says which per chat."""
    return extractions.join(chats.select("conversacion_id", "prompt_version"), ["conversacion_id", "prompt_version"], "left_semi")


def points_of_sale(leads: DataFrame, advisors: DataFrame) -> DataFrame:
    """Points of sale of leads and advisors; the advisor's tenant wins; the most frequent lead city."""
    cities = leads.filter(F.col("ciudad").isNotNull()).groupBy("punto_venta_id", "ciudad").agg(F.count(F.lit(1)).alias("n"))
    top = cities.groupBy("punto_venta_id").agg(F.min(F.struct((-F.col("n")).alias("orden"), F.col("ciudad"))).alias("c"))
    tenants = leads.select("punto_venta_id", "empresa_id", F.lit(0).alias("p")).unionByName(advisors.select("punto_venta_id", "empresa_id", F.lit(1).alias("p")))
    owner = tenants.groupBy("punto_venta_id").agg(F.max_by("empresa_id", F.struct("p", "empresa_id")).alias("empresa_id"))
    return owner.join(top, "punto_venta_id", "left").select("punto_venta_id", "empresa_id", F.col("c.ciudad").alias("ciudad"))
