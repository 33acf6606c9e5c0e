"""Data profiling: column profiles, format shapes, quality table, duplicates, rates and volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import dates, text
from leadloom.functions.stats import ratio, two_proportions, wilson
from leadloom.operators.entities import name_similarity


def count(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def column_profile(df: DataFrame, columns: Sequence[str], limit: int = 12, examples: int = 3) -> DataFrame:
    """NULLs, distinct values and either every value with its count or three examples, per column.

    One pass to (column, value) counts; the value list is a partial top-k, so a key column with as
    many values as rows never gathers in one task.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in columns))
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.columna", "p.valor").agg(F.count(F.lit(1)).alias("n"))
    totals = values.groupBy("columna").agg(
        F.coalesce(F.sum(F.when(F.col("valor").isNull(), F.col("n"))), F.lit(0)).alias("nulos"),
        F.count_if(F.col("valor").isNotNull()).alias("distintos"))
    order = Window.partitionBy("columna").orderBy("valor")
    first = values.filter(F.col("valor").isNotNull()).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit)
    shown = first.join(totals, "columna").filter((F.col("distintos") <= limit) | (F.col("k") <= examples))
    return totals.join(shown.select("columna", "valor", F.when(F.col("distintos") <= limit, F.col("n")).alias("n"), "k"), "columna", "left")


def chat_profile(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Counts of chats: total, repeated ids, channel, date format and sender, as (medida, valor, n)."""
    ids = chats.groupBy("conversacion_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = ids.agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit("ids_repetidos").alias("medida"), F.lit("").alias("valor"), "n")
    facts = F.array(*(F.struct(F.lit(m).alias("medida"), v.alias("valor")) for m, v in {
        "conversaciones": F.lit(""), "canal": F.col("canal"), "formato_inicio": dates.date_format_class(F.col("fecha_inicio"))}.items()))
    of_chats = chats.select(F.explode(facts).alias("f")).groupBy("f.medida", "f.valor").agg(F.count(F.lit(1)).alias("n"))
    of_messages = messages.groupBy(F.lit("emisor").alias("medida"), F.col("emisor").alias("valor")).agg(F.count(F.lit(1)).alias("n"))
    return of_chats.unionByName(of_messages).unionByName(repeated)


def date_classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Date format and slash class frequencies per column."""
    return dates.with_classes(df, columns).select(F.explode(F.array(*columns)).alias("p")).groupBy("p.columna", "p.formato", "p.barras").agg(F.count(F.lit(1)).alias("n"))


def quality_table(df: DataFrame) -> DataFrame:
    """Cases and an example per data problem, in one aggregation over measured rows.

    Expects the raw columns with `canal_n`, `estado_n`, `telefono_n`, `reg_*`, `con_*`, `es_prueba`,
    `contacto_antes`, `repetida`, `regla`, `sku_interes` and `modelo_disponible_pv`.
    """
    c = F.col
    name, mail, town = F.trim("nombre_cliente"), c("email"), text.match_key(c("ciudad"))
    official = text.canonical(c("ciudad"), fixed.CITIES)
    synonym = town.isin(*fixed.CITY_SYNONYMS)
    lead = c("lead_id").cast("string")
    checks: dict[str, tuple[Column, Column]] = {
        "canal_no_estandar": (c("canal").isNotNull() & ~c("canal").eqNullSafe(c("canal_n")), c("canal")),
        "canal_nulo": (c("canal").isNull(), lead),
        "estado_no_estandar": (~c("estado_gestion").eqNullSafe(c("estado_n")), c("estado_gestion")),
        "telefono_no_estandar": (~F.coalesce(text.phone_shape(c("telefono")) == "9999999999", F.lit(False)), c("telefono")),
        "telefono_invalido": (c("telefono_n").isNull(), c("telefono")),
        "email_nulo": (mail.isNull(), lead),
        "email_sin_normalizar": (mail.isNotNull() & (~F.trim(mail).rlike("(?U)" + fixed.EMAIL) | (mail != F.lower(F.trim(mail)))), mail),
        "nombre_con_espacios": (c("nombre_cliente") != name, c("nombre_cliente")),
        "nombre_todo_igual": ((name == F.upper(name)) | (name == F.lower(name)), name),
        "nombre_abreviado": (c("nombre_cliente").rlike(r"(?U)\b[A-ZÁÉÍÓÚÑ]\."), name),
        "ciudad_sinonimo": (synonym, c("ciudad")),
        "ciudad_solo_forma": (c("ciudad").isNotNull() & ~F.coalesce(synonym, F.lit(False)) & ~c("ciudad").eqNullSafe(official), c("ciudad")),
        "ciudad_bogota": (town.isin("bogota", "bogota d.c."), c("ciudad")),
        "ciudad_nula": (c("ciudad").isNull(), lead),
        "ciudad_sin_mapeo": (town.isNotNull() & official.isNull(), town),
        "registro_prueba": (c("es_prueba"), lead),
        "lead_repetido": (c("repetida"), lead),
        "fecha_invalida": ((c("reg_reason") == "invalida") | (c("con_reason") == "invalida"), lead),
        "contacto_antes": (c("contacto_antes"), lead),
        "gestionado_sin_fecha": (~c("estado_n").eqNullSafe(fixed.UNMANAGED) & c("fecha_primer_contacto").isNull(), c("estado_n")),
        "sin_gestion_con_fecha": ((c("estado_n") == fixed.UNMANAGED) & c("fecha_primer_contacto").isNotNull(), lead),
        "fecha_con_barras": (c("reg_slash"), c("fecha_registro")),
        "modelo_sin_coincidencia": (c("regla") == "sin_coincidencia", c("modelo_interes_texto")),
        "modelo_no_disponible": (~c("modelo_disponible_pv"), c("sku_interes")),
    }
    aggs = []
    for n, (when, example) in checks.items():
        ok = F.coalesce(when, F.lit(False))
        aggs += [F.count_if(ok).alias(f"c_{n}"), F.min(F.when(ok, example)).alias(f"e_{n}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("problema"), F.col(f"c_{n}").alias("casos"), F.col(f"e_{n}").alias("ejemplo")) for n in checks))
    return one.select(F.inline(rows))


def duplicate_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Repeated keys and whether their rows are identical. Rows reduce to a digest first."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    g = df.select(key, digest.alias("d")).groupBy(key).agg(F.count(F.lit(1)).alias("filas"), (F.min("d") == F.max("d")).alias("identicas"))
    return g.filter("filas > 1")


def model_rules(matched: DataFrame) -> DataFrame:
    return matched.groupBy("regla").agg(
        F.count(F.lit(1)).alias("leads"), F.count_distinct("modelo_texto_original").alias("variantes"),
        F.count_if(~F.coalesce("modelo_disponible_pv", F.lit(True))).alias("no_disponibles"))


def points_of_sale(leads: DataFrame) -> DataFrame:
    """Leads, tenants, most frequent city, its share and distinct cities per point of sale."""
    cities = leads.groupBy("punto_venta_id", "ciudad").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("ciudad").isNotNull()
    top = cities.groupBy("punto_venta_id").agg(
        F.sum("n").alias("leads"), F.count_if(known).alias("ciudades"), F.sum(F.when(known, F.col("n"))).alias("con_ciudad"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("menos"), F.col("ciudad").alias("ciudad")))).alias("t"))
    tenants = leads.groupBy("punto_venta_id").agg(F.size(F.collect_set("empresa_id")).alias("empresas"))  # a handful of tenants
    return top.join(tenants, "punto_venta_id").select(
        "punto_venta_id", "empresas", "leads", F.col("t.ciudad").alias("ciudad"), ratio(-F.col("t.menos"), F.col("con_ciudad")).alias("participacion"), "ciudades")


def duplicate_statistics(leads: DataFrame) -> DataFrame:
    """Shared phones, duplicate groups and collisions, one row."""
    phones = leads.filter(F.col("telefono").isNotNull())
    shared = phones.groupBy("telefono").agg(F.min("empresa_id").alias("a"), F.max("empresa_id").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("compartidos"))
    groups = phones.groupBy("empresa_id", "telefono").agg(F.count(F.lit(1)).alias("n"), F.min("canal").alias("a"), F.max("canal").alias("b"))
    dup = F.col("n") > 1
    sizes = groups.agg(F.count_if(dup).alias("grupos"), F.count_if(dup & (F.col("a") != F.col("b"))).alias("multicanal"),
                       F.coalesce(F.sum(F.when(dup, F.col("n"))), F.lit(0)).alias("leads_en_grupos"), F.coalesce(F.max(F.when(dup, F.col("n"))), F.lit(0)).alias("maximo"))
    low = name_similarity(phones.withColumn("clave_dedup", F.col("telefono"))).agg(F.count_if(F.col("similitud") < fixed.NAME_COLLISION).alias("colisiones"))
    by_mail = leads.filter(F.col("email").isNotNull()).groupBy("empresa_id", "email").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(dup).alias("grupos_email"))
    no_phone = leads.agg(F.count_if(F.col("telefono").isNull() & F.col("email").isNotNull()).alias("sin_telefono_con_email"))
    extra = {"compartidos": shared, "colisiones": low, "grupos_email": by_mail, "sin_telefono_con_email": no_phone}
    return sizes.withColumns({n: d.select(n).scalar() for n, d in extra.items()})


def chat_relation(leads: DataFrame, chats: DataFrame) -> DataFrame:
    """Orphans, leads with chats, with two and with more, and chats that start before registration."""
    owned = chats.join(leads.select("lead_id", "fecha_registro", F.lit(True).alias("k")), "lead_id", "left")
    known = F.col("k").isNotNull()
    base = owned.agg(F.count_if(~known).alias("huerfanas"), F.count_if(known & (F.to_date("inicio") < F.to_date("fecha_registro"))).alias("antes_del_registro"))
    per_lead = owned.filter(known).groupBy("lead_id").agg(F.count(F.lit(1)).alias("n"))
    leads_ = per_lead.agg(F.count(F.lit(1)).alias("con_chat"), F.count_if(F.col("n") == 2).alias("con_dos"), F.count_if(F.col("n") > 2).alias("con_mas"))
    total = leads.agg(F.count(F.lit(1)).alias("t"))
    out = base.withColumns({n: leads_.select(n).scalar() for n in ("con_chat", "con_dos", "con_mas")})
    return out.withColumn("cobertura", ratio(F.col("con_chat"), total.select("t").scalar()))


def rates(df: DataFrame, variables: dict[str, Column]) -> DataFrame:
    """Closing rate of every level of every variable against the rest of the rows."""
    pairs = F.array(*(F.struct(F.lit(n).alias("variable"), c.cast("string").alias("nivel")) for n, c in variables.items()))
    long = df.select(F.explode(pairs).alias("p"), "cerrado").select("p.*", "cerrado").filter(F.col("nivel").isNotNull())
    g = long.groupBy("variable", "nivel").agg(F.count(F.lit(1)).alias("n"), F.sum("cerrado").alias("cierres"))
    tot = g.groupBy("variable").agg(F.sum("n").alias("tn"), F.sum("cierres").alias("tc"))
    g = g.join(tot, "variable")
    rate, low, high = wilson(F.col("cierres"), F.col("n"))
    p = two_proportions(F.col("cierres"), F.col("n"), F.col("tc") - F.col("cierres"), F.col("tn") - F.col("n"))
    return g.select("variable", "nivel", "n", "cierres", rate.alias("tasa"), low.alias("ic_bajo"), high.alias("ic_alto"), p.alias("p"), F.coalesce(p < 0.05, F.lit(False)).alias("significativa"))


def no_contact_in_a_day(leads: DataFrame, moment: Column) -> DataFrame:
    """Share of leads never contacted or contacted after 24 hours, in four readings of day-only dates."""
    reg, con = F.col("fecha_registro"), F.col("fecha_primer_contacto")
    day_only = (F.coalesce("fecha_registro_precision", F.lit("")) == "dia") | (F.coalesce("fecha_contacto_precision", F.lit("")) == "dia")
    seconds = F.timestamp_diff("SECOND", reg, con)
    days = F.datediff(con, reg)
    late = F.coalesce(F.when(day_only, days > 1).otherwise(seconds > 86400), F.lit(False))
    never, doubtful = con.isNull(), F.coalesce(day_only & (days == 1), F.lit(False))
    midnight = never | F.coalesce(seconds > 86400, F.lit(False))
    mature = F.coalesce(reg <= moment - F.expr("interval '24' hour"), F.lit(False))
    n = F.count(F.lit(1))
    return leads.agg(
        n.alias("leads"), F.count_if(never).alias("nunca"), F.count_if(late).alias("tarde"), F.count_if(doubtful).alias("dudosos"),
        ratio(F.count_if(never | late), n).alias("conservador"), ratio(F.count_if(never | late | doubtful), n).alias("pesimista"),
        ratio(F.count_if(midnight), n).alias("medianoche"), ratio(F.count_if(mature & (never | late)), F.count_if(mature)).alias("maduros"))


def volume(leads: DataFrame, advisors: DataFrame) -> DataFrame:
    """Daily leads per tenant over a dense calendar against the capacity of active advisors."""
    dated = leads.filter(F.col("fecha_registro").isNotNull())
    daily = dated.groupBy("empresa_id", F.to_date("fecha_registro").alias("dia")).agg(F.count(F.lit(1)).alias("n"))
    span = daily.agg(F.min("dia").alias("a"), F.max("dia").alias("b"))
    spine = daily.select("empresa_id").distinct().withColumn("dia", F.explode(F.sequence(span.select("a").scalar(), span.select("b").scalar())))
    dense = spine.join(daily, ["empresa_id", "dia"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stats = dense.groupBy("empresa_id").agg(F.avg("n").alias("media"), F.percentile("n", F.lit(0.5)).alias("mediana"), F.max("n").alias("maximo"))
    staff = advisors.filter("activo").groupBy("empresa_id").agg(F.count(F.lit(1)).alias("asesores"), F.sum("capacidad_diaria").alias("capacidad"))
    open_ = leads.filter(F.col("estado_gestion") != fixed.DISCARDED).groupBy("empresa_id").agg(F.count(F.lit(1)).alias("abiertos"))
    return stats.join(staff, "empresa_id", "left").join(open_, "empresa_id", "left").withColumn("uso", ratio(F.col("media"), F.col("capacidad")))


def outcome_exclusions(history: DataFrame) -> DataFrame:
    return history.groupBy("desenlace").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("horas_al_primer_contacto").isNull()).alias("horas_nulas"),
        F.count_if(F.col("numero_contactos") == 0).alias("sin_contactos"), F.count_if(F.col("desenlace") == "Cerrado").alias("cierres"))


def factor_table(df: DataFrame) -> DataFrame:
    """Closing rate where a factor holds against where it does not (or against a named level)."""
    down, pay = F.col("manifesto_cuota_inicial"), F.col("forma_pago_declarada")
    factors = {
        "pidió cita": (F.col("pidio_cita"), ~F.col("pidio_cita")), "cuota contra el resto": (down == "SI", down != "SI"), "cuota contra NO": (down == "SI", down == "NO"),
        "precio alto": (F.col("precio_lista") >= fixed.HIGH_PRICE, F.col("precio_lista") < fixed.HIGH_PRICE), "contado contra crédito": (pay == "contado", pay == "credito"),
        "no informa contra crédito": (pay == "no_informa", pay == "credito")}
    aggs = []
    for i, (a, b) in enumerate(factors.values()):
        aggs += [F.count_if(a).alias(f"n{i}"), F.sum(F.when(a, F.col("cerrado")).otherwise(0)).alias(f"x{i}"), F.count_if(b).alias(f"m{i}"), F.sum(F.when(b, F.col("cerrado")).otherwise(0)).alias(f"y{i}")]
    one = df.agg(*aggs)
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(f"n{i}").alias("n_si"), F.col(f"x{i}").alias("cierres_si"), F.col(f"m{i}").alias("n_no"), F.col(f"y{i}").alias("cierres_no"))
                                         for i, n in enumerate(factors)))))
    return rows.withColumns({"tasa_si": ratio(F.col("cierres_si"), F.col("n_si")), "tasa_no": ratio(F.col("cierres_no"), F.col("n_no")),
                             "p": two_proportions(F.col("cierres_si"), F.col("n_si"), F.col("cierres_no"), F.col("n_no"))})


def with_first_score(df: DataFrame) -> DataFrame:
    """Points and temperature of the first score version, where only cash scores as payment."""
    from leadloom.operators.scoring import temperature

    w = fixed.POINTS
    points = (F.col("pidio_cita").cast("int") * w["cita"] + (F.col("manifesto_cuota_inicial") == "SI").cast("int") * w["cuota"]
              + (F.col("precio_lista") >= fixed.HIGH_PRICE).cast("int") * w["precio_alto"] + (F.col("forma_pago_declarada") == "contado").cast("int") * w["contado"])
    return df.withColumn("puntos", points).withColumn("temperatura", temperature(F.col("puntos")))


def chat_lengths(messages: DataFrame) -> DataFrame:
    """Messages per chat and chats where the client never answers after the first message."""
    mine = F.col("emisor") == "cliente"
    first = F.min("orden")
    per = messages.groupBy("conversacion_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("cliente"), first.alias("primero"), F.max(F.when(mine, F.col("orden"))).alias("ultimo"))
    silent = F.coalesce(F.col("ultimo") <= F.col("primero"), F.lit(True))
    return per.agg(F.count(F.lit(1)).alias("conversaciones"), F.avg("n").alias("media"), F.percentile("n", F.lit(0.5)).alias("mediana"), F.min("n").alias("minimo"), F.max("n").alias("maximo"),
                   F.avg("cliente").alias("media_cliente"), F.count_if(silent).alias("sin_respuesta"))


def lexicon_tags(items: DataFrame, rows: DataFrame, key: str, column: str, lexicon: dict[str, Sequence[str]] = fixed.LEXICON) -> DataFrame:
    """Items with any phrase of each tag, their share of all `items`, and the items without objection words
    (`ninguna`), among them those without rows. Amounts are searched in folded text, those with a
    currency sign in the text itself.

    Tags are literal phrases checked inside one projection: no join, and an item counts once per tag
    however many rows it has.
    """
    folded = text.match_key(F.col(column))
    marks = {f"t_{i}": F.coalesce(_any_phrase(folded, phrases), F.lit(False)) for i, phrases in enumerate(lexicon.values())}
    searched = lambda n: F.col(column) if "$" in n else folded
    patterns = {**fixed.AMOUNT_SHAPES, "cero": fixed.ZERO_AMOUNT}
    shapes = {f"m_{i}": F.coalesce(F.rlike(searched(n), F.lit("(?U)" + p)), F.lit(False)) for i, (n, p) in enumerate(patterns.items())}
    names = [*lexicon, *patterns, "ninguna"]
    all_marks = {**marks, **shapes}
    found = rows.select(key, *(c.alias(n) for n, c in all_marks.items())).groupBy(key).agg(*(F.bool_or(n).alias(n) for n in all_marks))
    per = items.select(key).distinct().join(found, key, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in all_marks})
    objected = F.lit(False)
    for i, n in enumerate(lexicon):
        objected = objected | F.col(f"t_{i}") if n in fixed.LEXICON_OBJECTIONS else objected
    per = per.withColumn("ninguna", ~objected)
    all_marks = [*all_marks, "ninguna"]
    one = per.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(n).alias(n) for n in all_marks))
    return one.select("total", F.inline(F.array(*(F.struct(F.lit(label).alias("etiqueta"), F.col(n).alias("n")) for label, n in zip(names, all_marks, strict=True))))).select(
        "etiqueta", "n", ratio(F.col("n"), F.col("total")).alias("proporcion"))


def _any_phrase(c: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def models_mentioned(messages: DataFrame, catalogue: DataFrame, key: str = "conversacion_id") -> DataFrame:
    """Catalogue models named in each chat with the place where they first appear.

    A name occurs only where its first three letters occur. Only ids and pieces of the texts go out, each
    piece once; those that begin a name bring the text back, which is searched for the name.
    """
    full = catalogue.select("sku", text.match_key(F.concat_ws(" ", "marca", "linea")).alias("nombre"), F.lit(0).alias("p"))
    line = catalogue.select("sku", text.match_key(F.col("linea")).alias("nombre"), F.lit(1).alias("p"))
    # A line shared by several models belongs to the first; a full name wins over a line.
    names = full.unionByName(line).groupBy("nombre").agg(F.min(F.struct("p", "sku")).alias("o")).select(
        "nombre", "o.sku", F.substring("nombre", 1, 3).alias("pieza"))
    folded = messages.filter(F.col("emisor") == "cliente").select(key, "orden", text.match_key(F.col("texto")).alias("t")).filter(F.col("t").isNotNull())
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.col("t").substr(i, F.lit(n)))
    pieces = folded.select(key, "orden", F.explode(F.array_distinct(F.concat(cut(3), cut(2), cut(1)))).alias("pieza"))
    started = pieces.join(names, "pieza").select(key, "orden", "nombre", "sku")
    found = started.join(folded, [key, "orden"]).withColumn("lugar", F.instr("t", F.col("nombre"))).filter(F.col("lugar") > 0)
    return found.groupBy(key, "sku").agg(F.min(F.struct("orden", "lugar")).alias("a")).select(key, "sku", F.col("a.orden").alias("orden"), F.col("a.lugar").alias("lugar"))


def model_counts(mentioned: DataFrame, chats: DataFrame, key: str = "conversacion_id") -> DataFrame:
    """Chats, those that name a model and those that name several."""
    per = chats.select(key).distinct().join(mentioned.groupBy(key).agg(F.count_distinct("sku").alias("n")), key, "left")
    return per.agg(F.count(F.lit(1)).alias("conversaciones"), F.count_if(F.col("n") > 0).alias("con_modelo"), F.count_if(F.col("n") > 1).alias("cambios_modelo"))


def claim_check(metrics: DataFrame, claims: DataFrame) -> DataFrame:
    """Claimed against computed figures: equal at the claimed number of decimals, different, or only
    informative when nothing is claimed."""
    j = claims.join(metrics, "metrica", "left")
    shown = F.round(F.col("valor") * F.pow(F.lit(10.0), F.col("decimales")), 0) / F.pow(F.lit(10.0), F.col("decimales"))
    state = F.when(F.col("citado").isNull(), "informativa").when(F.abs(shown - F.col("citado")) < 1e-9, "sí").otherwise("no")
    return j.select("metrica", "citado", F.col("valor"), state.alias("coincide"))
