"""Standardisation of leads, chats, advisors and history, with the log of what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import dates, text
from leadloom.operators.stage import staged, staged_new
from leadloom.operators.quality import CHATS_FILE, LEADS_FILE, log_of, problem, union_logs


def split_repeated(raw: DataFrame, key: str = "lead_id", ordinal: str = "orden_archivo") -> tuple[DataFrame, DataFrame]:
    """(first row of every key, the later rows). The joins hash (key, ordinal), so a key that
    repeats a million times is spread over all tasks."""
    first = raw.groupBy(key).agg(F.min(ordinal).alias(ordinal))
    return raw.join(first, [key, ordinal], "left_semi"), raw.join(first, [key, ordinal], "left_anti")


def with_dates(df: DataFrame, window: tuple[str, str] = fixed.WINDOW) -> DataFrame:
    """Adds the readings, date, reason and precision of registration (`reg`) and contact (`con`).

    Each step is a stage of its own: merged, they would compute their parts again for each use.
    """
    def read(prefix: str) -> list[str]:
        return [f"{prefix}_{x}" for x in ("a", "b", "slash", "precision")]

    df = staged_new(dates.with_readings(df, "fecha_registro", "reg"), *read("reg"))
    df = staged_new(dates.with_readings(df, "fecha_primer_contacto", "con"), *read("con"))
    df = staged_new(dates.resolve(df, "fecha_registro", "reg", "con", True, window), "reg_reason", "reg_at")
    return staged_new(dates.resolve(df, "fecha_primer_contacto", "con", "reg", False, window), "con_reason", "con_at")


def measure(raw: DataFrame, window: tuple[str, str] = fixed.WINDOW) -> DataFrame:
    """Raw rows plus every normalised value and cross-field condition; no shuffle."""
    cleaned = {
        "canal_n": text.channel(F.col("canal")),
        "estado_n": text.state(F.col("estado_gestion")),
        "telefono_n": text.phone(F.col("telefono")),
        "email_n": text.email(F.col("email")),
        "nombre_n": text.person_name(F.col("nombre_cliente")),
        "ciudad_n": text.city(F.col("ciudad")),
    }
    df = with_dates(staged_new(raw.withColumns(cleaned), *cleaned), window)
    by_day = F.coalesce(F.col("reg_precision") == "dia", F.lit(False)) | F.coalesce(
        F.col("con_precision") == "dia", F.lit(False)
    )
    before = F.when(by_day, F.to_date("con_at") < F.to_date("reg_at")).otherwise(F.col("con_at") < F.col("reg_at"))
    original = F.when(text.is_blank(F.col("nombre_cliente")), "").otherwise(F.col("nombre_cliente"))
    conditions = {
        "nombre_original": original,
        "es_prueba": F.lower(original).contains("prueba") | (F.col("telefono_n").isNull() & F.col("canal_n").isNull()),
        "por_dia": by_day,
        "contacto_antes": F.coalesce(before, F.lit(False)),
    }
    return staged_new(df.withColumns(conditions), *conditions)


def _date_problem(field: str, prefix: str) -> list:
    why, raw = F.col(f"{prefix}_reason"), F.col(field)
    return [
        problem(why.isin("ventana", "coherencia"), field, "formato_fecha_ambiguo", raw, F.concat(F.lit("resuelta por "), why)),
        problem(why == "por_defecto", field, "fecha_ambigua_resuelta_por_defecto", raw, "se usa dd/mm"),
        problem(why == "invalida", field, "fecha_invalida", raw, "se guarda nula"),
    ]


def measure_all(raw: DataFrame, window: tuple[str, str] = fixed.WINDOW, key: str = "lead_id", ordinal: str = "orden_archivo") -> DataFrame:
    """`measure` for every raw row, with `repetida` for the later rows of a key. The join hashes (key,
    ordinal), so a key that repeats a million times is spread over all tasks."""
    first = raw.groupBy(key).agg(F.min(ordinal).alias(ordinal)).withColumn("_primera", F.lit(True))
    marked = raw.join(first, [key, ordinal], "left").withColumn("repetida", F.col("_primera").isNull()).drop("_primera")
    return measure(marked, window)


def _kept() -> Column:
    return ~F.col("repetida") & ~F.col("es_prueba") & F.col("canal_n").isNotNull()


def lead_log(measured: DataFrame) -> DataFrame:
    """Quality log of measured rows: repeated, test and channel-less rows leave, and every change is logged."""
    c = F.col
    estado = F.coalesce(c("estado_n"), F.lit(fixed.UNMANAGED))
    kept, first = _kept(), ~c("repetida")

    problems = [
        problem(c("repetida"), "lead_id", "lead_repetido", c("lead_id"), "se conserva la primera fila"),
        problem(first & c("es_prueba"), "nombre_cliente", "registro_prueba", c("nombre_original"), "excluido"),
        problem(first & ~c("es_prueba") & c("canal_n").isNull(), "canal", "canal_invalido", c("canal"), "excluido: el canal es obligatorio"),
        problem(kept & ~c("canal_n").eqNullSafe(c("canal")), "canal", "canal_no_estandar", c("canal"),
                F.concat(F.lit("normalizado a "), c("canal_n"))),
        problem(kept & c("estado_n").isNull(), "estado_gestion", "estado_desconocido", c("estado_gestion"), "se asume Sin gestión"),
        problem(kept & (c("estado_n") != c("estado_gestion")), "estado_gestion", "estado_no_estandar", c("estado_gestion"),
                F.concat(F.lit("normalizado a "), c("estado_n"))),
        problem(kept & c("telefono_n").isNull(), "telefono", "telefono_invalido", c("telefono"),
                "se guarda nulo; clave secundaria por email"),
        problem(kept & (c("telefono_n") != c("telefono")), "telefono", "telefono_formato", c("telefono"),
                "solo dígitos, sin prefijo 57"),
        problem(kept & ~text.is_blank(c("email")) & c("email_n").isNull(), "email", "email_invalido", c("email"), "se guarda nulo"),
        problem(kept & (c("email_n") != c("email")), "email", "email_normalizado", c("email"), "strip y minúsculas"),
        problem(kept & (c("nombre_n") != c("nombre_original")), "nombre_cliente", "nombre_normalizado", c("nombre_original"),
                "espacios y formato título"),
        problem(kept & (c("ciudad_n") != c("ciudad")), "ciudad", "ciudad_normalizada", c("ciudad"),
                F.concat(F.lit("normalizada a "), c("ciudad_n"))),
        *(F.when(kept, p) for p in _date_problem("fecha_registro", "reg")),
        *(F.when(kept, p) for p in _date_problem("fecha_primer_contacto", "con")),
        problem(kept & c("contacto_antes"), "fecha_primer_contacto", "contacto_antes_de_registro", c("fecha_primer_contacto"), "bandera"),
        problem(kept & (estado != fixed.UNMANAGED) & c("con_at").isNull(), "fecha_primer_contacto",
                "estado_sin_fecha_contacto", estado, "bandera"),
        problem(kept & (estado == fixed.UNMANAGED) & c("con_at").isNotNull(), "fecha_primer_contacto",
                "sin_gestion_con_contacto", c("fecha_primer_contacto"), "bandera"),
    ]
    return log_of(measured, LEADS_FILE, c("lead_id"), c("empresa_id"), problems)


def clean_leads(measured: DataFrame) -> DataFrame:
    """Typed leads of measured rows; no shuffle and nothing computed again."""
    c = F.col
    estado = F.coalesce(c("estado_n"), F.lit(fixed.UNMANAGED))
    return measured.filter(_kept()).select(
        "lead_id", "empresa_id", "punto_venta_id", c("canal_n").alias("canal"),
        F.when(~text.is_blank(c("campania")), text.strip(c("campania"))).alias("campania"),
        c("reg_at").alias("fecha_registro"),
        F.when(c("reg_at").isNotNull(), c("reg_precision")).alias("fecha_registro_precision"),
        c("con_at").alias("fecha_primer_contacto"),
        F.when(c("con_at").isNotNull(), c("con_precision")).alias("fecha_contacto_precision"),
        estado.alias("estado_gestion"), c("nombre_n").alias("nombre"), c("telefono_n").alias("telefono"),
        c("email_n").alias("email"), c("ciudad_n").alias("ciudad"),
        F.when(~text.is_blank(c("modelo_interes_texto")), text.strip(c("modelo_interes_texto"))).alias("modelo_texto_original"),
    )


def standardize_leads(raw: DataFrame, window: tuple[str, str] = fixed.WINDOW) -> tuple[DataFrame, DataFrame]:
    """(clean leads, quality log) of raw rows."""
    measured = measure_all(raw, window)
    return clean_leads(measured), lead_log(measured)


def with_start(chats: DataFrame, window: tuple[str, str] = fixed.WINDOW) -> DataFrame:
    """Adds `inicio`, the chat start, NULL when unreadable."""
    df = dates.with_readings(chats, "fecha_inicio", "ini")
    df = dates.resolve(df, "fecha_inicio", "ini", None, False, window)
    return staged(df.withColumn("inicio", F.col("ini_at")).drop("ini_a", "ini_b", "ini_slash", "ini_precision", "ini_reason", "ini_at"))


def check_chats(chats: DataFrame, leads: DataFrame) -> DataFrame:
    """Log of orphan chats and of chats that start on a day before the registration of their lead.
    Expects `inicio` (see `with_start`)."""
    owners = leads.select("lead_id", "empresa_id", "fecha_registro", F.lit(True).alias("conocido"))
    df = chats.join(owners, "lead_id", "left")
    known = F.col("conocido").isNotNull()
    orphans = log_of(df, CHATS_FILE, F.col("conversacion_id"), F.lit(None).cast(leads.schema["empresa_id"].dataType), [
        problem(~known, "lead_id", "conversacion_huerfana", F.col("lead_id"), "se carga sin empresa"),
    ])
    early = log_of(df, LEADS_FILE, F.col("lead_id"), F.col("empresa_id"), [
        problem(known & (F.to_date("inicio") < F.to_date("fecha_registro")), "fecha_registro",
                "conversacion_antes_de_registro", F.col("conversacion_id"), "bandera"),
    ])
    return union_logs(orphans, early)


def standardize_advisors(raw: DataFrame) -> DataFrame:
    def clean(name: str):
        return text.strip(F.col(name)) if raw.schema[name].dataType.typeName() == "string" else F.col(name)

    return raw.select(
        clean("asesor_id").alias("asesor_id"), clean("empresa_id").alias("empresa_id"),
        clean("punto_venta_id").alias("punto_venta_id"), text.person_name(F.col("nombre")).alias("nombre"),
        F.col("capacidad_diaria_leads").cast("int").alias("capacidad_diaria"),
        (F.upper(text.strip(F.col("activo"))) == "SI").alias("activo"),
        F.when(~text.is_blank(F.col("fecha_ingreso").cast("string")), F.col("fecha_ingreso")).cast("date").alias("fecha_ingreso"),
    )


def standardize_catalogue(raw: DataFrame) -> DataFrame:
    return raw.select(
        *(text.strip(F.col(n)).alias(n) for n in ("sku", "marca", "linea")), F.col("cilindraje").cast("int").alias("cilindraje"),
        text.strip(F.col("segmento")).alias("segmento"), F.col("precio_lista").cast("long").alias("precio_lista"),
        F.col("unidades_disponibles").cast("int").alias("unidades_disponibles"),
        F.concat_ws(" ", text.strip(F.col("marca")), text.strip(F.col("linea"))).alias("nombre_completo"),
    )


def standardize_history(raw: DataFrame) -> DataFrame:
    hours = F.col("horas_al_primer_contacto").cast("string")
    return raw.select(
        "lead_id", F.col("fecha_registro").cast("date").alias("fecha_registro"), text.channel(F.col("canal")).alias("canal"),
        "empresa_id", "punto_venta_id", "modelo_cotizado", F.col("precio_lista").cast("long").alias("precio_lista"),
        F.when(~text.is_blank(hours), hours).cast("double").alias("horas_al_primer_contacto"),
        F.col("numero_contactos").cast("int").alias("numero_contactos"), "manifesto_cuota_inicial", "forma_pago_declarada",
        (F.col("pidio_cita") == "SI").alias("pidio_cita"), "desenlace",
    )
