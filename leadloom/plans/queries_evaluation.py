"""Registered queries: score validation, policy metrics and extraction quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.stats import two_proportions, wilson
from leadloom.operators import evaluation as ev
from leadloom.operators import extraction
from leadloom.plans.driver_tables import ADJECTIVES, NOUNS, SPLIT_DATE
from leadloom.plans.oracle_base import CTES, key, with_ctes
from leadloom.plans.oracle_chat import B, pattern
from leadloom.plans.registry import Registry, daily

reg = Registry()
ID = "conversacion_id"


def sql_wilson(x: str, n: str) -> tuple[str, str, str]:
    p = f"({x} / nullif({n}, 0)::DOUBLE)"
    z2, d = "3.8415999999999997::DOUBLE", f"(1 + 3.8415999999999997::DOUBLE / {n})"
    centre = f"({p} + {z2} / (2 * {n})) / {d}"
    margin = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0::DOUBLE * {n} * {n})) / {d}"
    return p, f"round({centre} - {margin}, 9)", f"round({centre} + {margin}, 9)"


def sql_p_value(a: str, n: str, b: str, m: str) -> str:
    pool = f"(({a} + {b}) / ({n} + {m})::DOUBLE)"
    err = f"sqrt({pool} * (1 - {pool}) * (1 / {n}::DOUBLE + 1 / {m}::DOUBLE))"
    z = f"(abs({a} / {n}::DOUBLE - {b} / {m}::DOUBLE) / nullif({err}, 0) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z}))"
    poly = f"({t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))))"
    return f"CASE WHEN {n} = 0 OR {m} = 0 THEN NULL WHEN {err} = 0 THEN 1.0::DOUBLE ELSE round({poly} * exp(-{z} * {z}), 6) END"


_TEMP = "CASE WHEN {p} >= 6 THEN 'Caliente' WHEN {p} >= 3 THEN 'Tibio' ELSE 'Frío' END"
CTES.update({
    "prep0": (f"SELECT *, CAST(desenlace = 'Cerrado' AS BIGINT) AS cerrado, CAST(pidio_cita AS BIGINT) AS s_cita, CAST(manifesto_cuota_inicial = 'SI' AS BIGINT) AS s_cuota, CAST(forma_pago_declarada IN ('contado', 'no_informa') AS BIGINT) AS s_contado, "
              f"CAST(precio_lista >= 10000000 AS BIGINT) AS s_precio, fecha_registro >= DATE '{SPLIT_DATE}' AS prueba FROM his WHERE desenlace <> 'Sin gestión'", ("his",)),
    "prep": ("SELECT *, " + _TEMP.format(p="puntos") + " AS temperatura FROM (SELECT *, 3 * s_cita + 3 * s_cuota + 2 * s_precio + s_contado AS puntos FROM prep0) AS q", ("prep0",)),
    "prep_states": ("SELECT 'cita' AS senal, CAST(pidio_cita AS VARCHAR) AS estado, 3 * s_cita AS puntos_estado, cerrado, prueba FROM prep UNION ALL SELECT 'cuota', manifesto_cuota_inicial, 3 * s_cuota, cerrado, prueba FROM prep "
                    "UNION ALL SELECT 'contado', forma_pago_declarada, s_contado, cerrado, prueba FROM prep", ("prep",)),
    "state_rates": ("SELECT senal, estado, puntos_estado, count(*) AS n, sum(cerrado)::BIGINT AS cierres, avg(cerrado) AS tasa, avg(cerrado) FILTER (NOT prueba) AS tasa_entrenamiento, avg(cerrado) FILTER (prueba) AS tasa_prueba FROM prep_states GROUP BY 1, 2, 3", ("prep_states",)),
    "daily_rank": ("SELECT *, row_number() OVER (PARTITION BY fecha_registro ORDER BY lead_id) AS ra, row_number() OVER (PARTITION BY fecha_registro ORDER BY puntos DESC, lead_id) AS rp, count(*) OVER (PARTITION BY fecha_registro) AS dn FROM prep", ("prep",)),
    "caps": ("SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]) AS capacidad", ()),
    "wait_rate": ("SELECT CAST(floor(horas_al_primer_contacto / 24) AS BIGINT) AS dia, avg(cerrado) AS tasa FROM prep GROUP BY 1", ("prep",)),
    "factors": ("SELECT dia, least(1.0::DOUBLE, coalesce(min(tasa / (SELECT tasa FROM wait_rate WHERE dia = 0)) OVER (ORDER BY dia), 1.0::DOUBLE)) AS factor FROM (SELECT unnest(range(0, 6)) AS dia) AS s LEFT JOIN wait_rate USING (dia)", ("wait_rate",)),
    "base_p": ("SELECT temperatura, efecto, sum(cerrado) / sum(1 - efecto * (1 - factor)) AS base FROM (SELECT *, least(5, CAST(floor(horas_al_primer_contacto / 24) AS BIGINT)) AS dia FROM prep) AS p JOIN factors USING (dia), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS efecto) AS e GROUP BY 1, 2", ("prep", "factors")),
    "gold": (
        "SELECT conversacion_id, CASE WHEN conversacion_id % 4 = 1 THEN upper(modelo_texto) WHEN conversacion_id % 9 = 2 THEN 'otra' ELSE modelo_texto END AS modelo_texto, CASE WHEN conversacion_id % 5 = 1 THEN CAST(floor(cuota_inicial_cop * 1.04) AS BIGINT) WHEN conversacion_id % 5 = 2 THEN cuota_inicial_cop * 2 ELSE cuota_inicial_cop END AS cuota_inicial_cop, "
        "menciona_cuota, CASE WHEN conversacion_id % 6 = 1 THEN 'contado' ELSE forma_pago END AS forma_pago, CASE WHEN conversacion_id % 7 = 1 THEN 'alta' ELSE intencion END AS intencion, CASE WHEN conversacion_id % 8 = 1 THEN 'precio' ELSE objecion END AS objecion, "
        "pidio_cita, conversacion_id % 3 = 1 AS pidio_cotizacion, cliente_respondio, conversacion_id % 3 <> 0 AS revisado FROM ext WHERE conversacion_id % 10 <> 9", ("ext",)),
})


def prepared(d) -> DataFrame:
    if "prepared" not in d._stages:
        d._stages["prepared"] = ev.prepare(d.history, SPLIT_DATE)
    return d._stages["prepared"]


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@reg.query("e3_prepared_history", with_ctes("SELECT lead_id, cerrado, puntos, temperatura, prueba FROM prep"))
def prepared_history(spark, folder) -> DataFrame:
    return prepared(daily(spark, folder)).select("lead_id", "cerrado", "puntos", "temperatura", "prueba")


_P, _LO, _HI = sql_wilson("cierres_prueba", "n_prueba")


@reg.query("e4_temperature_rates", with_ctes(
    f"SELECT temperatura, n, cierres, n_prueba, cierres_prueba, round(cierres / n::DOUBLE, 9) AS tasa, round({_P}, 9) AS tasa_prueba, {_LO} AS ic_bajo, {_HI} AS ic_alto FROM (SELECT temperatura, count(*) AS n, sum(cerrado)::BIGINT AS cierres, count(*) FILTER (prueba) AS n_prueba, "
    "coalesce(sum(cerrado) FILTER (prueba), 0)::BIGINT AS cierres_prueba FROM prep GROUP BY 1) AS t"))
def temperature_rates(spark, folder) -> DataFrame:
    return rounded(ev.temperature_table(prepared(daily(spark, folder))), "tasa", "tasa_prueba", "ic_bajo", "ic_alto")


@reg.query("e5_hot_cold_ratio", with_ctes("SELECT round(c, 9) AS caliente, round(f, 9) AS frio, round(c / f, 9) AS razon, c / f >= 1.8 AS cumple FROM (SELECT avg(cerrado) FILTER (temperatura = 'Caliente') AS c, avg(cerrado) FILTER (temperatura = 'Frío') AS f FROM prep WHERE prueba) AS t"))
def hot_cold(spark, folder) -> DataFrame:
    return rounded(ev.hot_cold_ratio(prepared(daily(spark, folder)).filter("prueba")), "caliente", "frio", "razon")


BOOTSTRAP = {
    "boot_n": (f"SELECT CASE temperatura WHEN '{fixed.HOT}' THEN 'caliente' ELSE 'frio' END AS grupo, count(*)::DOUBLE AS n, sum(cerrado)::DOUBLE AS x FROM prep WHERE prueba AND temperatura IN ('{fixed.HOT}', '{fixed.COLD}') GROUP BY 1", ("prep",)),
    "boot_k": ("SELECT grupo, n, x, unnest(CASE WHEN x = 0 OR x = n THEN [x::BIGINT] ELSE range(greatest(0, x - ceil(9 * sqrt(x * (1 - x / n)) + 9))::BIGINT, least(n, x + ceil(9 * sqrt(x * (1 - x / n)) + 9))::BIGINT + 1) END) AS k FROM boot_n", ("boot_n",)),
    "boot_log": ("SELECT grupo, k, sum(CASE WHEN k = k0 THEN 0.0 ELSE ln((n - k + 1) / k * (x / (n - x))) END) OVER (PARTITION BY grupo ORDER BY k) AS l FROM (SELECT *, min(k) OVER (PARTITION BY grupo) AS k0 FROM boot_k) AS q", ("boot_k",)),
    "boot_cdf": ("SELECT grupo, k, sum(m) OVER (PARTITION BY grupo ORDER BY k) / sum(m) OVER (PARTITION BY grupo) AS hasta FROM (SELECT grupo, k, exp(l - max(l) OVER (PARTITION BY grupo)) AS m FROM boot_log) AS q", ("boot_log",)),
    "boot_u": (f"SELECT grupo, n, rep, (CAST('0x' || substr(md5('2026:' || rep || ':' || grupo), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM boot_n, range(1, {fixed.BOOTSTRAP + 1}) AS r(rep)", ("boot_n",)),
    "boot_rate": ("SELECT d.grupo, d.rep, coalesce(min(c.k), (SELECT max(k) FROM boot_cdf AS z WHERE z.grupo = d.grupo)) / any_value(d.n) AS tasa FROM boot_u AS d LEFT JOIN boot_cdf AS c ON c.grupo = d.grupo AND c.hasta > d.u GROUP BY d.grupo, d.rep", ("boot_u", "boot_cdf")),
}


@reg.query("e6_bootstrap_interval", with_ctes(
    "SELECT round(quantile_cont(razon, 0.025), 9) AS bajo, round(quantile_cont(razon, 0.975), 9) AS alto, count(*) AS replicas FROM (SELECT a.tasa / b.tasa AS razon FROM boot_rate AS a JOIN boot_rate AS b USING (rep) WHERE a.grupo = 'caliente' AND b.grupo = 'frio' AND b.tasa > 0) AS q", BOOTSTRAP))
def bootstrap(spark, folder) -> DataFrame:
    return rounded(ev.bootstrap_ratio(prepared(daily(spark, folder)).filter("prueba")), "bajo", "alto")


@reg.query("e7_auc", with_ctes(
    "SELECT parte, round(sum(CASE WHEN cerrado = 1 THEN r ELSE 0 END) - any_value(p) * (any_value(p) + 1) / 2.0::DOUBLE, 3) / (any_value(p) * any_value(q))::DOUBLE AS auc_crudo, count(*) AS n FROM (SELECT *, rk + (ties - 1) / 2.0::DOUBLE AS r, sum(cerrado) OVER (PARTITION BY parte)::BIGINT AS p, "
    "(count(*) OVER (PARTITION BY parte) - sum(cerrado) OVER (PARTITION BY parte))::BIGINT AS q FROM (SELECT *, rank() OVER (PARTITION BY parte ORDER BY puntos) AS rk, count(*) OVER (PARTITION BY parte, puntos) AS ties FROM (SELECT 'todo' AS parte, cerrado, puntos FROM prep UNION ALL "
    "SELECT CASE WHEN prueba THEN 'prueba' ELSE 'entrenamiento' END, cerrado, puntos FROM prep) AS u) AS w) AS z GROUP BY parte").replace("auc_crudo", "auc").replace("SELECT parte, round(", "SELECT parte, round((").replace("/ (any_value(p) * any_value(q))::DOUBLE AS auc", "/ (any_value(p) * any_value(q))::DOUBLE, 9) AS auc").replace("/ 2.0::DOUBLE, 3)", "/ 2.0::DOUBLE)"))
def auc_(spark, folder) -> DataFrame:
    df = prepared(daily(spark, folder))
    part = F.explode(F.array(F.lit("todo"), F.when(F.col("prueba"), "prueba").otherwise("entrenamiento")))
    return rounded(ev.auc(df.select("cerrado", "puntos", part.alias("parte")), "puntos", "cerrado", ["parte"]), "auc")


@reg.query("e7_label_auc", (
    "SELECT round((sum(CASE WHEN quality = 1 THEN r ELSE 0 END) - any_value(p) * (any_value(p) + 1) / 2.0::DOUBLE) / (any_value(p) * any_value(q))::DOUBLE, 9) AS auc, count(*) AS n FROM (SELECT *, rk + (ties - 1) / 2.0::DOUBLE AS r, sum(quality) OVER ()::BIGINT AS p, (count(*) OVER () - sum(quality) OVER ())::BIGINT AS q FROM "
    "(SELECT quality, rank() OVER (ORDER BY n_chars) AS rk, count(*) OVER (PARTITION BY n_chars) AS ties FROM labels JOIN documents USING (doc_id)) AS w) AS z"))
def label_auc(spark, folder) -> DataFrame:
    """How well the length of a document orders its quality label."""
    d = daily(spark, folder).inputs
    return rounded(ev.auc(d.table("labels").join(d.table("documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality"), "auc")


@reg.query("e8_trained_weights_auc")
def trained_auc(spark, folder) -> DataFrame:
    return ev.trained_weights_auc(prepared(daily(spark, folder)))


@reg.query("e9_attribute_regression")
def attribute_regression(spark, folder) -> DataFrame:
    return ev.attribute_regression(prepared(daily(spark, folder)))


@reg.query("e10_state_rates", with_ctes("SELECT senal, estado, puntos_estado, n, cierres, round(tasa, 9) AS tasa, round(tasa_entrenamiento, 9) AS tasa_entrenamiento, round(tasa_prueba, 9) AS tasa_prueba FROM state_rates"))
def state_rates(spark, folder) -> DataFrame:
    return rounded(ev.state_table(prepared(daily(spark, folder))), "tasa", "tasa_entrenamiento", "tasa_prueba")


@reg.query("e11_incoherent_signals", with_ctes("SELECT senal, round(max(tasa) FILTER (puntos_estado = 0), 9) AS max_sin, round(min(tasa) FILTER (puntos_estado > 0), 9) AS min_con, coalesce(max(tasa) FILTER (puntos_estado = 0) > min(tasa) FILTER (puntos_estado > 0), false) AS incoherente FROM state_rates GROUP BY senal"))
def incoherent(spark, folder) -> DataFrame:
    return rounded(ev.incoherent_signals(prepared(daily(spark, folder))), "max_sin", "min_con")


@reg.query("e12_expected_points", with_ctes("SELECT round(3 * avg(s_cita) + 3 * avg(s_cuota) + avg(s_contado), 9) AS esperado FROM prep"))
def expected_points(spark, folder) -> DataFrame:
    return rounded(ev.expected_without_chat(prepared(daily(spark, folder))), "esperado")


@reg.query("w4_daily_top", with_ctes("SELECT lead_id, ra AS por_llegada, rp AS por_puntaje, greatest(1, CAST(ceil(dn * 0.7::DOUBLE) AS BIGINT)) AS cupo FROM daily_rank"))
def daily_top(spark, folder) -> DataFrame:
    r = ev.day_ranks(prepared(daily(spark, folder)).select("lead_id", "fecha_registro", "puntos"))
    return r.select("lead_id", "por_llegada", "por_puntaje", ev.quota(F.col("del_dia"), F.lit(0.7)).alias("cupo"))


@reg.query("e13_captured_closings", with_ctes(
    "SELECT capacidad, llegada, puntaje, round(azar, 6) AS azar, puntaje - llegada AS ganancia, round((puntaje - llegada) / llegada::DOUBLE * 100, 6) AS ganancia_pct FROM (SELECT capacidad, sum(llegada)::BIGINT AS llegada, sum(puntaje)::BIGINT AS puntaje, sum(azar) AS azar FROM (SELECT capacidad, fecha_registro, "
    "sum(CASE WHEN ra <= k THEN cerrado ELSE 0 END) AS llegada, sum(CASE WHEN rp <= k THEN cerrado ELSE 0 END) AS puntaje, least(any_value(k), any_value(dn)) * sum(cerrado) / any_value(dn)::DOUBLE AS azar FROM (SELECT *, greatest(1, CAST(ceil(dn * capacidad) AS BIGINT)) AS k FROM daily_rank CROSS JOIN caps) AS q GROUP BY 1, 2) AS d GROUP BY 1) AS t"))
def captured(spark, folder) -> DataFrame:
    return rounded(ev.captured_closings(prepared(daily(spark, folder)).select("lead_id", "fecha_registro", "puntos", "cerrado")), "azar", "ganancia_pct", digits=6)


@reg.query("w4_event_top", "SELECT event_id, dia, posicion FROM (SELECT event_id, CAST(ts AS DATE) AS dia, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS posicion, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events) AS q WHERE posicion <= greatest(1, ceil(n * 0.1::DOUBLE))")
def event_top(spark, folder) -> DataFrame:
    """The top tenth of every day's events by value."""
    from leadloom.operators.ranking import with_rank
    e = daily(spark, folder).inputs.table("events").select("event_id", F.to_date("ts").alias("dia"), "value")
    r = with_rank(e, ["dia"], [("value", False), ("event_id", True)], [(F.floor("value"), False)], "posicion")
    return r.join(e.groupBy("dia").agg(F.count(F.lit(1)).alias("n")), "dia").filter(F.col("posicion") <= ev.quota(F.col("n"), F.lit(0.1))).select("event_id", "dia", "posicion")


@reg.query("e15_wait_factors", with_ctes("SELECT dia, round(factor, 9) AS factor FROM factors"))
def wait_factors(spark, folder) -> DataFrame:
    return rounded(ev.wait_factors(prepared(daily(spark, folder))), "factor")


@reg.query("e16_base_probability", with_ctes("SELECT temperatura, efecto, round(base, 9) AS base FROM base_p"))
def base_probability(spark, folder) -> DataFrame:
    df = prepared(daily(spark, folder))
    return rounded(ev.base_probability(df, ev.wait_factors(df)), "base")


@reg.query("e17_expected_closings", with_ctes("SELECT efecto, round(sum(base * (1 - efecto * (1 - factor))), 6) AS cierres_esperados FROM (SELECT *, lead_id % 6 AS dia FROM daily_rank WHERE rp <= greatest(1, ceil(dn * 0.7::DOUBLE))) AS a JOIN factors USING (dia) JOIN base_p USING (temperatura) GROUP BY efecto"))
def expected_closings(spark, folder) -> DataFrame:
    df = prepared(daily(spark, folder))
    r = ev.day_ranks(df.select("lead_id", "fecha_registro", "puntos", "temperatura"))
    attended = r.filter(F.col("por_puntaje") <= ev.quota(F.col("del_dia"), F.lit(0.7))).select("temperatura", (F.col("lead_id") % 6).alias("espera"))
    factors = ev.wait_factors(df)
    return rounded(ev.expected_closings(attended, ev.base_probability(df, factors), factors), "cierres_esperados", digits=6)


_HOURS = "(date_diff('day', fecha_registro, (SELECT max(fecha_registro) FROM prep)) * 24 + 12)"


@reg.query("e18_queue_orders", with_ctes(
    "SELECT lead_id, row_number() OVER (ORDER BY fecha_registro, lead_id) AS llegada, row_number() OVER (ORDER BY fecha_registro DESC, lead_id) AS reciente, row_number() OVER (ORDER BY puntos DESC, fecha_registro, lead_id) AS calidad, "
    f"row_number() OVER (ORDER BY puntos + CASE WHEN {_HOURS} < 2 THEN 5 WHEN {_HOURS} < 24 THEN 4 WHEN {_HOURS} < 72 THEN 2 ELSE 1 END DESC, fecha_registro, lead_id) AS completo FROM prep"))
def queue_orders(spark, folder) -> DataFrame:
    return ev.queue_orders(prepared(daily(spark, folder)).select("lead_id", "fecha_registro", "puntos")).select("lead_id", "llegada", "reciente", "calidad", "completo")


def gold(d) -> DataFrame:
    """Labels that follow from the extractions with known differences; some lack a field."""
    c, k = F.col, F.col(ID)
    pick = lambda m, r, v, name: F.when(k % m == r, v).otherwise(c(name))
    df = d.extraction.filter(k % 10 != 9)
    return df.select(
        ID, F.when(k % 4 == 1, F.upper("modelo_texto")).when(k % 9 == 2, "otra").otherwise(c("modelo_texto")).alias("modelo_texto"),
        F.when(k % 5 == 1, F.floor(c("cuota_inicial_cop") * 1.04)).when(k % 5 == 2, c("cuota_inicial_cop") * 2).otherwise(c("cuota_inicial_cop")).cast("long").alias("cuota_inicial_cop"),
        "menciona_cuota", pick(6, 1, "contado", "forma_pago").alias("forma_pago"), pick(7, 1, "alta", "intencion").alias("intencion"), pick(8, 1, "precio", "objecion").alias("objecion"),
        "pidio_cita", (k % 3 == 1).alias("pidio_cotizacion"), "cliente_respondio", (k % 3 != 0).alias("revisado"),
        F.when(k % 2 == 0, F.array(*(F.lit(f) for f in fixed.EVALUATED_FIELDS if f != "objecion"))).otherwise(F.array(*map(F.lit, fixed.EVALUATED_FIELDS))).alias("etiquetados"))


def _accuracy_sql(other: str) -> str:
    def same(f: str) -> str:
        if f == "cuota_inicial_cop":
            return f"CASE WHEN g.{f} IS NULL OR e.{f} IS NULL THEN g.{f} IS NULL AND e.{f} IS NULL WHEN g.{f} = 0 THEN e.{f} = 0 ELSE abs(e.{f} - g.{f}) <= 0.05::DOUBLE * abs(g.{f}) END"
        if f == "modelo_texto":
            return f"{key('g.' + f)} IS NOT DISTINCT FROM {key('e.' + f)}"
        return f"g.{f} IS NOT DISTINCT FROM e.{f}"
    parts = " UNION ALL ".join(f"SELECT '{f}' AS campo, {same(f)} AS ok FROM gold AS g JOIN {other} AS e USING (conversacion_id) WHERE revisado" + (" AND conversacion_id % 2 <> 0" if f == "objecion" else "") for f in fixed.EVALUATED_FIELDS)
    p, lo, hi = sql_wilson("aciertos", "total")
    return f"SELECT campo, aciertos, total, round({p}, 9) AS exactitud, {lo} AS ic_bajo, {hi} AS ic_alto FROM (SELECT campo, count(*) FILTER (ok) AS aciertos, count(*) AS total FROM ({parts}) AS u GROUP BY campo) AS t"


@reg.query("e19_field_accuracy", with_ctes(_accuracy_sql("ext")))
def field_accuracy(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return rounded(ev.field_accuracy(gold(d), d.extraction), "exactitud", "ic_bajo", "ic_alto")


@reg.query("e19_macro_accuracy", with_ctes(f"SELECT round(avg(exactitud), 8) AS promedio, count(*) AS campos FROM ({_accuracy_sql('ext')}) AS m"))
def macro_accuracy(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return rounded(ev.macro_accuracy(ev.field_accuracy(gold(d), d.extraction)), "promedio", digits=8)


REWRITES = [("Lo pago de contado", "Se la cancelo completa"), ("Los visito hoy", "Hoy me asomo"), ("tengo 2 palos", "dispongo de 2 palos"), ("tengo", "cuento con"),
            ("Solo estaba mirando", "No es nada \\ serio, $0"), ("mirando", "viendo")]


ORDERED = sorted(REWRITES, key=lambda s: (-len(s[0]), s[0]))


def _rewritten(steps: int = len(REWRITES)) -> str:
    """The text after so many substitutions."""
    expr = "texto"
    for a, b in ORDERED[:steps]:
        expr = f"regexp_replace({expr}, '{a}', '{b.replace(chr(92), chr(92) * 2)}', 'gi')"
    return expr


@reg.query("e20_rewrites", with_ctes(f"SELECT conversacion_id, orden, nuevo AS texto, nuevo <> texto AS cambiado FROM (SELECT *, CASE WHEN emisor = 'cliente' THEN {_rewritten()} ELSE texto END AS nuevo FROM msg) AS q"))
def rewrites(spark, folder) -> DataFrame:
    return ev.rewrite_clients(daily(spark, folder).messages, REWRITES).select(ID, "orden", "texto", "cambiado")


@reg.query("e20_rewrite_use", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS original, count(*) FILTER (emisor = 'cliente' AND contains(lower({_rewritten(i)}), lower('{a}'))) AS mensajes FROM msg" for i, (a, _) in enumerate(ORDERED))))
def rewrite_use(spark, folder) -> DataFrame:
    """Messages that used each declared substitution; zero for the unused ones."""
    used = ev.rewrite_clients(daily(spark, folder).messages, REWRITES).select(F.explode("usadas").alias("original")).groupBy("original").agg(F.count(F.lit(1)).alias("mensajes"))
    declared = spark.createDataFrame([(a,) for a, _ in REWRITES], "original string")
    return declared.join(used, "original", "left").select("original", F.coalesce("mensajes", F.lit(0)).alias("mensajes"))


@reg.query("e20_robust_accuracy")
def robust_accuracy(spark, folder) -> DataFrame:
    """Accuracy by field before and after rewriting the clients' phrases."""
    d = daily(spark, folder)
    after = extraction.rule_extraction(d.chats, ev.rewrite_clients(d.messages, REWRITES), d.brands)
    labels = gold(d)
    return ev.field_accuracy(labels, d.extraction).withColumn("version", F.lit("original")).unionByName(
        ev.field_accuracy(labels, after).withColumn("version", F.lit("reformulado")))


_NAMES = sorted({*ADJECTIVES, *NOUNS, *(f"{a} {n}" for a in ADJECTIVES for n in NOUNS)}, key=lambda n: (-len(n), n))
_MOLDE = f"lower(regexp_replace(regexp_replace(regexp_replace(texto, '{'|'.join(_NAMES)}', '<MOTO>', 'gi'), '\\$?\\s?\\d[\\d.,]*', '<N>', 'g'), '^\\s+|\\s+$', '', 'g'))"


@reg.query("e21_templates", with_ctes(f"SELECT count(*) AS mensajes, count(DISTINCT {_MOLDE}) AS moldes FROM msg WHERE emisor = 'cliente'"))
def templates(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return ev.vocabulary(d.messages, [*ADJECTIVES, *NOUNS, *(f"{a} {n}" for a in ADJECTIVES for n in NOUNS)])


_FLAG = {n: f"bool_or(regexp_matches(texto, '{pattern(p)}'))" for n, p in fixed.STRATA.items()}
_BRAND = r"(?i)(?:^|[^\p{L}\p{N}_])((?:" + "|".join(sorted(ADJECTIVES, key=lambda b: (-len(b), b))) + r")(?:[\s.\-][\p{L}\p{N}_\s.\-]{0,19}|$|[^\p{L}\p{N}_\s.\-]))"
STRATA_CTES = {
    "found": (f"SELECT c.conversacion_id, coalesce(n, 0) <= 1 AS sin_respuesta, coalesce(modelos > 1, false) AS cambio_de_modelo, " + ", ".join(f"coalesce({n}, false) AS {n}" for n in fixed.STRATA) +
              f", true AS corriente FROM chats_raw AS c LEFT JOIN (SELECT conversacion_id, count(*) AS n, " + ", ".join(f"{v} AS {k}" for k, v in _FLAG.items()) +
              ", any_value(modelos) AS modelos FROM cm LEFT JOIN (SELECT conversacion_id, count(DISTINCT trim(regexp_replace(regexp_replace(m, '[^\\p{L}\\p{N}_\\s.\\-]$', ''), '\\s+', ' ', 'g'))) AS modelos FROM "
              f"(SELECT conversacion_id, unnest(regexp_extract_all(texto, '{_BRAND}', 1)) AS m FROM cm) AS u GROUP BY 1) AS mm USING (conversacion_id) GROUP BY 1) AS a USING (conversacion_id)", ("chats_raw", "cm")),
}
_steps = ["sin_respuesta", "cambio_de_modelo", *fixed.STRATA]
_prev: list[str] = []
for _i, _s in enumerate(_steps):
    _free = " AND ".join(f"conversacion_id NOT IN (SELECT conversacion_id FROM {p})" for p in _prev) or "true"
    STRATA_CTES[f"pick_{_s}"] = (f"SELECT conversacion_id, '{_s}' AS estrato, {_i} AS o FROM found WHERE {_s} AND {_free} ORDER BY conversacion_id LIMIT 2", ("found", *_prev))
    _prev.append(f"pick_{_s}")
_all = " UNION ALL ".join(f"SELECT * FROM {p}" for p in _prev)
STRATA_CTES["hard"] = (_all, tuple(_prev))


@reg.query("w8_stratified_sample", with_ctes(
    "SELECT conversacion_id, estrato FROM hard UNION ALL SELECT conversacion_id, 'corriente' FROM (SELECT conversacion_id, row_number() OVER (ORDER BY conversacion_id) AS k FROM found WHERE conversacion_id NOT IN (SELECT conversacion_id FROM hard)) AS r WHERE k <= 40 - (SELECT count(*) FROM hard)", STRATA_CTES))
def stratified_sample(spark, folder) -> DataFrame:
    d = daily(spark, folder)
    return ev.stratified_sample(d.messages, d.chats, d.brands).select(ID, "estrato")


@reg.query("e1_e2_label_rates", with_ctes(
    f"SELECT source, n, buenos, round({sql_wilson('buenos', 'n')[0]}, 9) AS tasa, {sql_wilson('buenos', 'n')[1]} AS ic_bajo, {sql_wilson('buenos', 'n')[2]} AS ic_alto, {sql_p_value('buenos', 'n', '(tb - buenos)', '(tn - n)')} AS p FROM "
    "(SELECT *, sum(n) OVER ()::BIGINT AS tn, sum(buenos) OVER ()::BIGINT AS tb FROM (SELECT source, count(*) AS n, sum(quality)::BIGINT AS buenos FROM labels JOIN documents USING (doc_id) GROUP BY source) AS g) AS w"))
def label_rates(spark, folder) -> DataFrame:
    """Share of good labels per source with its interval, and its difference from the other sources."""
    i = daily(spark, folder).inputs
    g = i.table("labels").join(i.table("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("buenos"))
    tot = g.agg(F.sum("n").alias("tn"), F.sum("buenos").alias("tb"))
    g = g.withColumns({"tn": tot.select("tn").scalar(), "tb": tot.select("tb").scalar()})
    rate, low, high = wilson(F.col("buenos"), F.col("n"))
    p = two_proportions(F.col("buenos"), F.col("n"), F.col("tb") - F.col("buenos"), F.col("tn") - F.col("n"))
    return g.select("source", "n", "buenos", F.round(rate, 9).alias("tasa"), F.round(low, 9).alias("ic_bajo"), F.round(high, 9).alias("ic_alto"), F.round(p, 6).alias("p"))
