"""Literal cases of the operators."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import chat, dates, similarity, stats, text
from leadloom.operators import assignment, catalogue, consolidate, entities, evaluation, extraction, profiling, scoring, serving, standardize
from leadloom.operators.ranking import id_levels, with_rank
from leadloom.plans.daily import Daily
from leadloom.sources import readers, tables


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_phone(spark):
    good = ["3104824081", "310 482 4081", "+57 310 4824081", "310-482-4081", " 3104824081 ", "573104824081", "(310) 482-4081"]
    assert one(spark, text.phone, good) == ["3104824081"] * 7
    assert one(spark, text.phone, ["300123", "6044445555", "  ", None]) == [None] * 4


def test_names_and_dictionaries(spark):
    assert one(spark, text.channel, [" META ADS ", "Fax"]) == ["Meta Ads", None]
    assert one(spark, text.state, ["SIN GESTION"]) == ["Sin gestión"]
    assert one(spark, text.city, ["B/quilla", "Bogota DC", "BOGOTA", "ITAGUI", "san  andrés", None]) == [
        "Barranquilla", "Bogotá D.C.", "Bogotá D.C.", "Itagüí", "San Andrés", None]
    assert one(spark, text.person_name, ["  ana   maría-josé d.c. o'neil ", None]) == ["Ana María-José D.C. O'Neil", ""]
    assert one(spark, text.email, [" A@B.co ", "a b@c", None]) == ["a@b.co", None, None]
    assert one(spark, text.message_hour, ["16:55", "25:99", None]) == ["16:55", None, None]


@pytest.mark.parametrize("value,other,registration,expected", [
    ("2026-08-26 20:28:00", None, True, (datetime(2026, 8, 26, 20, 28), "unica")),
    ("25-08-2026", None, True, (datetime(2026, 8, 25), "unica")),
    ("13/08/2026 10:00", None, True, (datetime(2026, 8, 13, 10), "componente_mayor_12")),
    ("05/08/2026 10:30", None, True, (datetime(2026, 8, 5, 10, 30), "ventana")),
    ("09/08/2026 10:00", "2026-08-10 12:00:00", True, (datetime(2026, 8, 9, 10), "coherencia")),
    ("08/09/2026 10:00", "2026-08-20 09:00:00", False, (datetime(2026, 9, 8, 10), "coherencia")),
    ("09/08/2026 10:00", None, True, (datetime(2026, 8, 9, 10), "por_defecto")),
    ("08/13/2026 10:00", None, True, (datetime(2026, 8, 13, 10), "componente_mayor_12")),
    ("2026-08-33 10:00:00", None, True, (None, "invalida")),
    (" ", None, True, (None, "vacia")),
])
def test_dates(spark, value, other, registration, expected):
    df = spark.createDataFrame([(value, other)], "v string, o string")
    df = dates.with_readings(dates.with_readings(df, "v", "a"), "o", "b")
    row = dates.resolve(df, "v", "a", "b", registration).collect()[0]
    assert (row.a_at, row.a_reason) == expected


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(cur[-1], prev[j + 1]))
        prev = cur
    return prev[-1]


def test_similarity_against_brute_force(spark):
    rng = random.Random(7)
    pairs = [("".join(rng.choices("abc d", k=rng.randint(0, 14))), "".join(rng.choices("abc d", k=rng.randint(0, 14)))) for _ in range(60)]
    pairs += [("".join(rng.choices("abcd", k=70)), "".join(rng.choices("abcd", k=66))) for _ in range(2)]  # beyond one machine word
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", similarity.lcs(F.col("a"), F.col("b")).alias("l"),
                     similarity.token_set_ratio(similarity.tokens(F.col("a")), similarity.tokens(F.col("b"))).alias("t")).collect()
    for r in rows:
        assert r.l == _lcs(r.a, r.b)
        ta, tb = set(r.a.split()), set(r.b.split())
        s, x, y = (" ".join(sorted(v)) for v in (ta & tb, ta - tb, tb - ta))
        if not ta or not tb:
            want = 0.0
        elif s and (not x or not y):
            want = 100.0
        else:
            g = 1 if s else 0
            total = 2 * (len(s) + g) + len(x) + len(y)
            want = 100 * (total - (len(x) + len(y) - 2 * _lcs(x, y))) / total
            if s:
                want = max(want, *(100 * (2 * len(s)) / (2 * len(s) + g + len(z)) for z in (x, y)))
        assert r.t == pytest.approx(want)


CATALOGUE = [("SKU-004", "Honda", "Navi", "PV-002|PV-008|"), ("SKU-001", "Honda", "CB 125F Twister", "PV-001"), ("SKU-008", "Bajaj", "Pulsar NS 125", "PV-001"),
             ("SKU-009", "Bajaj", "Pulsar NS 160", "PV-006"), ("SKU-010", "Bajaj", "Pulsar RS 200", "PV-002"), ("SKU-013", "Suzuki", "GN 125", "PV-001"),
             ("SKU-018", "AKT", "Dynamic R3 125", "PV-005"), ("SKU-019", "AKT", "TTR 200", "PV-003"), ("SKU-021", "Hero", "Eco Deluxe 100", "PV-001")]


def models(spark):
    return spark.createDataFrame(CATALOGUE, "sku string, marca string, linea string, puntos_venta_disponibles string")


def test_catalogue_match(spark):
    want = {"Suzuky GN 125": "SKU-013", "A.K.T Dynamic R3 125": "SKU-018", "TTR 200": "SKU-019", "Honda Navi 2026": "SKU-004", "honda  NAVI": "SKU-004", "Pulsar NS 125": "SKU-008"}
    rules = {"Bajaj Pulsar": ("Bajaj", "modelo_ambiguo"), "Honda": ("Honda", "modelo_ambiguo"), "  ": (None, "modelo_faltante"), "zzz": (None, "sin_coincidencia")}
    df = spark.createDataFrame([(t,) for t in [*want, *rules]], "t string")
    got = {r.t: r for r in catalogue.match_texts(df, "t", models(spark)).collect()}
    assert {t: got[t].sku for t in want} == want
    assert {t: (got[t].marca, got[t].regla) for t in rules} == rules


def test_blocking_loses_no_match(spark):
    """Every pair that scores 85 or more survives the blocking."""
    rng = random.Random(3)
    words = ["navi", "nabi", "cb", "125", "pulsar", "pulsr", "ns", "160", "x", "rs200"]
    texts = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)})
    t = spark.createDataFrame([(x,) for x in texts], "limpio string").withColumn("palabras", similarity.tokens(F.col("limpio")))
    n = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(texts)], "sku string, n string").select("sku", F.lit("m").alias("marca"), similarity.tokens(F.col("n")).alias("nombre_palabras"))
    got = {r.limpio: (r.sku, r.puntaje) for r in catalogue._best_unique(t, n, 85).collect()}
    scores = t.crossJoin(n).select("limpio", "sku", similarity.token_set_ratio("palabras", "nombre_palabras").alias("p")).collect()
    want = {}
    for x, rows in itertools.groupby(sorted(scores, key=lambda r: r.limpio), key=lambda r: r.limpio):
        rows = list(rows)
        best = max(r.p for r in rows)
        top = [r.sku for r in rows if r.p == best]
        if best >= 85 and len(top) == 1:
            want[x] = (top[0], best)
    assert got == want


def test_availability_three_states(spark):
    leads = spark.createDataFrame([(1, "SKU-004", "PV-002"), (2, "SKU-004", "PV-009"), (3, None, "PV-001")], "lead_id int, sku_interes string, punto_venta_id string")
    rows = catalogue.with_availability(leads, catalogue.availability(models(spark))).collect()
    assert {r.lead_id: r.modelo_disponible_pv for r in rows} == {1: True, 2: False, 3: None}


LEAD = "lead_id string, empresa_id string, canal string, estado_gestion string, nombre string, telefono string, email string, ciudad string, fecha_registro timestamp_ntz"


def people(spark, rows):
    return entities.with_client_key(spark.createDataFrame([(*r[:-1], datetime.fromisoformat(r[-1]) if r[-1] else None) for r in rows], LEAD))


def test_clients(spark):
    leads = people(spark, [
        ("L1", "A", "WhatsApp", "Contactado", "Ana", "3001112233", None, "Bello", "2026-08-01"), ("L2", "A", "Meta Ads", "Sin gestión", "Ana Pérez", "3001112233", "a@b.co", None, "2026-08-03"),
        ("L3", "A", "Meta Ads", "Descartado", "Ana P", "3001112233", None, None, "2026-08-09"), ("L4", "B", "WhatsApp", "Sin gestión", "Ana", "3001112233", None, None, None),
        ("L5", "A", "WhatsApp", "Descartado", "X", None, "x@y.co", None, "2026-08-02"), ("L6", "A", "WhatsApp", "Descartado", "X", None, "x@y.co", None, None)])
    rows = {(r.empresa_id, r.clave_dedup): r for r in entities.clients(leads).collect()}
    a = rows[("A", "tel:3001112233")]
    assert (a.lead_principal, a.nombre, a.email, a.ciudad, a.leads, a.canales) == ("L2", "Ana Pérez", "a@b.co", "Bello", 3, 2)
    assert rows[("B", "tel:3001112233")].lead_principal == "L4"
    assert rows[("A", "email:x@y.co")].lead_principal == "L5"
    marked = {r.lead_id for r in entities.with_principal(leads, entities.clients(leads)).filter("es_principal").collect()}
    assert marked == {"L2", "L4", "L5"}


def test_name_collisions(spark):
    leads = people(spark, [("L1", "A", "W", "Contactado", "Ana Pérez", "3", None, None, None), ("L2", "A", "W", "Contactado", "Jorge Quintero", "3", None, None, None),
                           ("L3", "A", "W", "Contactado", "Ana Perez", "4", None, None, None), ("L4", "A", "W", "Contactado", "ANA PEREZ", "4", None, None, None)])
    log = entities.collisions(leads).collect()
    assert {r.registro_id for r in log} == {"L1", "L2"} and log[0].accion == "similitud 26; se conserva el grupo"


def test_large_name_groups(spark):
    """Above the cell size the flag stays exact: one stranger among close names, and none."""
    near = [f"ana maria perez lopez {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows = [(f"N{i}", "A", "W", "Contactado", n, "7", None, None, None) for i, n in enumerate(near)]
    rows += [(f"S{i}", "B", "W", "Contactado", n, "7", None, None, None) for i, n in enumerate([*near, "zzz qqq"])]
    got = {r.empresa_id: r.similitud for r in entities.name_similarity(people(spark, rows)).collect()}
    assert got["B"] < fixed.NAME_COLLISION <= got["A"]


def test_amounts(spark):
    cases = {"2 palos": 2_000_000, "2 millonzitos": 2_000_000, "7,2 millones": 7_200_000, "1500mil": 1_500_000, "0,5 millones": 500_000, "son $10.490.000": 10_490_000,
             "hola": None, "$1.500.000 o 2 palos": 2_000_000, "2 palos o $1.500.000": 1_500_000, "$1.500.000 mil": 500_000}
    assert one(spark, chat.amount, list(cases)) == list(cases.values())


def test_model_named(spark):
    brands = ["Suzuki", "Bajaj"]
    said = ["Suzuki GN 125 y cuánto vale", "la bajaj Pulsar NS 160.", "de Bajaj, mejor Suzuki Best 125", "nada"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, texto string")
    catalogue_ = spark.createDataFrame([(b,) for b in [*brands, "K.T.M (x"]], "marca string")
    for pattern in (chat.brand_pattern(brands), chat.brand_pattern(catalogue_)):
        assert [r.m for r in chat.with_model(df, "texto", pattern, "m").orderBy("i").collect()] == [
        "Suzuki GN 125", "bajaj Pulsar NS 160", "Suzuki Best 125", None]


def extract(spark, *chats_):
    rows = [(f"C{i}", j + 1, who, t) for i, c in enumerate(chats_) for j, (who, t) in enumerate(c)]
    msgs = spark.createDataFrame(rows, "conversacion_id string, orden int, emisor string, texto string")
    ids = spark.createDataFrame([(f"C{i}",) for i in range(len(chats_))], "conversacion_id string")
    return [r for r in extraction.rule_extraction(ids, msgs, chat.brand_pattern(["Bajaj", "Suzuki"])).orderBy(F.expr("int(substr(conversacion_id, 2))")).collect()]


def test_rules(spark):
    hi, c = ("cliente", "hola"), lambda *t: [("cliente", "hola"), *(("cliente", x) for x in t)]
    r = extract(spark, c("tengo 0 millones de inicial"), c("No tengo con qué dar la inicial"), c("los visito hoy"), c("lo voy a consultar en la casa"), [hi],
                c("lo pago de contado, la inicial no"), c("me queda muy caro, estoy comparando"), c("solo estaba mirando"), [("asesor", "2 palos de contado")])
    assert (r[0].cuota_inicial_cop, r[0].menciona_cuota, r[0].objecion, r[0].forma_pago) == (0, "NO", "sin_inicial", "credito")
    assert (r[1].cuota_inicial_cop, r[1].menciona_cuota) == (0, "NO")
    assert (r[2].pidio_cita, r[2].intencion) == (True, "alta")
    assert (r[3].pidio_cita, r[3].objecion) == (False, "consultar_familia")
    assert (r[4].cliente_respondio, r[4].intencion) == (False, "baja")
    assert r[5].forma_pago == "contado"
    assert r[6].objecion == "precio"
    assert (r[7].intencion, r[7].objecion) == ("baja", "solo_averiguando")
    assert (r[8].cuota_inicial_cop, r[8].forma_pago, r[8].objecion, r[8].evidencia) == (None, "no_informa", "ninguna", {})


def test_validation(spark):
    rows = [(2_000_000, 7_190_000), (7_200_000, 7_190_000), (20_000_000, 7_190_000), (-1000, 7_190_000), (5, None), (0, 7_190_000)]
    df = spark.createDataFrame([(i, a, "NO_INFORMA", b) for i, (a, b) in enumerate(rows)], "i int, cuota_inicial_cop long, menciona_cuota string, p long")
    got = [(r.cuota_inicial_cop, r.menciona_cuota, r.correcciones) for r in extraction.validate(df, F.col("p")).orderBy("i").collect()]
    assert got == [(2_000_000, "SI", ["menciona_cuota_incoherente"]), (7_190_000, "SI", ["cuota_redondeada_al_precio", "menciona_cuota_incoherente"]),
                   (None, "NO_INFORMA", ["cuota_mayor_que_precio"]), (None, "NO_INFORMA", ["cuota_negativa"]), (5, "SI", ["menciona_cuota_incoherente"]), (0, "NO", ["menciona_cuota_incoherente"])]


def test_evidence(spark):
    talk = [("asesor", "Buenas, ¿quiere financiar?"), ("cliente", "Sí, quiero VISITAR la sede mañana"), ("asesor", "claro"), ("cliente", "y separar la moto hoy mismo")]
    talk += [("cliente", f"mensaje numero {i} de relleno") for i in range(70)] + [("cliente", "la final")]
    msgs = spark.createDataFrame([("C", i + 1, w, t) for i, (w, t) in enumerate(talk)], "conversacion_id string, orden int, emisor string, texto string")
    quotes = {"a": "quiero visitar la sede", "b": "sede mañana y separar", "c": "cliente [10:00]: quiero visitiar la sede mañana", "d": "quiere financiar", "e": "quiere ir a conocer el local",
              "cliente_respondio": "quiere financiar", "f": "69 de relleno la final", "g": ""}
    ext = spark.createDataFrame([("C", quotes)], "conversacion_id string, evidencia map<string,string>")
    assert {r.campo for r in extraction.unsupported(ext, msgs).collect()} == {"d", "e"}


def test_fingerprint_and_cache(spark):
    rows = [(c, i + 1, "cliente", "10:00", t) for c, ts in {"A": ["hola", "2 palos"], "B": ["hola", "2 palos"], "C": ["2 palos", "hola"]}.items() for i, t in enumerate(ts)]
    msgs = spark.createDataFrame(rows, "conversacion_id string, orden int, emisor string, hora string, texto string")
    chats_ = spark.createDataFrame([("A",), ("B",), ("C",)], "conversacion_id string")
    hashes = extraction.fingerprints(msgs)
    h = {r.conversacion_id: r.hash_contenido for r in hashes.collect()}
    assert h["A"] == h["B"] != h["C"]
    run = lambda c, m: extraction.rule_extraction(c, m, chat.brand_pattern(["Bajaj"]))
    empty = run(chats_, msgs).join(hashes, "conversacion_id").limit(0)
    result, computed = extraction.extract_with_cache(chats_, msgs, hashes, empty, run)
    assert result.count() == 3 and computed.count() == 2
    cache = result.filter("conversacion_id = 'C'").withColumn("intencion", F.lit("alta"))
    again, computed = extraction.extract_with_cache(chats_, msgs, hashes, cache, run)
    assert computed.count() == 1 and again.filter("conversacion_id = 'C'").collect()[0].intencion == "alta"


def test_consolidation(spark):
    schema = ("conversacion_id string, lead_id string, empresa_id string, inicio timestamp_ntz, modelo_texto string, cuota_inicial_cop long, menciona_cuota string, forma_pago string, "
              "intencion string, objecion string, pidio_cita boolean, pidio_cotizacion boolean, cliente_respondio boolean, sin_respaldo array<string>")
    rows = [("1", "L", "A", datetime(2026, 8, 1), "Honda Navi", 5, "SI", "contado", "alta", "precio", True, False, True, ["objecion"]),
            ("2", "L", "A", datetime(2026, 8, 9), None, None, "NO_INFORMA", "no_informa", "baja", "ninguna", False, False, False, ["forma_pago"]),
            ("3", "L", "A", None, "Otra", 9, "SI", "credito", "media", "tasa_cuota", False, True, False, [])]
    r = consolidate.consolidate(spark.createDataFrame(rows, schema)).collect()[0]
    assert (r.modelo_texto, r.cuota_inicial_cop, r.forma_pago, r.intencion, r.objecion) == ("Honda Navi", 5, "contado", "baja", "precio")
    assert (r.pidio_cita, r.pidio_cotizacion, r.cliente_respondio, r.conversaciones, r.sin_respaldo) == (True, True, True, 3, ["forma_pago", "objecion"])
    order = [r.conversacion_id for r in consolidate.chat_order(spark.createDataFrame(rows, schema)).orderBy("posicion").collect()]
    assert order == ["3", "1", "2"]


def test_score_points(spark):
    assert one(spark, scoring.hours_points, [1.0, 10.0, 48.0, 100.0], "double") == [5, 4, 2, 1]
    assert one(spark, scoring.state_points, ["Cotización enviada", "En proceso", "No contesta", "Contactado"]) == [3, 2, 2, 1]
    assert one(spark, scoring.temperature, [-3, 2, 3, 5, 6, 9], "int") == ["Frío", "Frío", "Tibio", "Tibio", "Caliente", "Caliente"]
    base = people(spark, [("L1", "A", "WhatsApp", "Sin gestión", "Ana", "3", None, None, "2026-08-10 10:00:00"), ("L2", "A", "WhatsApp", "Sin gestión", "Eva", "4", None, None, "2026-08-10 09:00:00"),
                          ("L3", "A", "WhatsApp", "Descartado", "Luz", "5", None, None, "2026-08-10 09:00:00"), ("L4", "A", "WhatsApp", "En proceso", "Sol", "6", None, None, "2026-01-10 09:00:00")])
    leads = entities.with_principal(base, entities.clients(base)).withColumns({"punto_venta_id": F.lit("PV"), "sku_interes": F.when(F.col("lead_id") != "x", "S")})
    sig = spark.createDataFrame([("L1", "A", None, 5, "SI", "contado", "alta", "ninguna", True, False, True, 1, ["objecion"]), ("L3", "A", None, None, "NO", "credito", "baja", "sin_inicial", False, False, False, 1, [])],
                                "lead_id string, empresa_id string, modelo_texto string, cuota_inicial_cop long, menciona_cuota string, forma_pago string, intencion string, objecion string, pidio_cita boolean, pidio_cotizacion boolean, cliente_respondio boolean, conversaciones long, sin_respaldo array<string>")
    prices = spark.createDataFrame([("S", 12_000_000)], "sku string, precio_lista long")
    rows = {r.lead_id: r for r in scoring.score(leads, sig, prices, scoring.cutoff(leads)).collect()}
    assert set(rows) == {"L1", "L2"}
    assert (rows["L1"].puntos_calidad, rows["L1"].puntos_conversacion, rows["L1"].puntos_urgencia, rows["L1"].temperatura) == (9, 2, 5, "Caliente")
    assert (rows["L2"].puntos_calidad, rows["L2"].temperatura, rows["L2"].prioritario) == (4, "Sin calificar", True)
    assert rows["L1"].razones[-1].factor.endswith("desconocido: objecion")
    for r in rows.values():
        assert sum(x.puntos for x in r.razones) == r.prioridad


def _snake(capacities, n):
    out, left, cycle, p = [], dict(enumerate(capacities)), [*range(len(capacities)), *reversed(range(len(capacities)))], 0
    for _ in range(n):
        who = None
        for _ in cycle:
            x = cycle[p % len(cycle)]
            p += 1
            if left[x] > 0:
                who = x
                break
        if who is not None:
            left[who] -= 1
        out.append(who)
    return out


def test_snake(spark):
    rng = random.Random(1)
    cases = [([9, 9, 9], 8), ([1, 10], 5), ([2], 5), ([], 3)] + [([rng.randint(1, 5) for _ in range(rng.randint(1, 5))], rng.randint(0, 14)) for _ in range(12)]
    adv = [(f"P{i}", f"P{i}-{j}", c, True) for i, (cs, _) in enumerate(cases) for j, c in enumerate(cs)] + [("P0", "P0-9", 50, False)]
    scored = [(f"P{i}", k, 100 - k, datetime(2026, 8, 1)) for i, (_, n) in enumerate(cases) for k in range(n)]
    a = spark.createDataFrame(adv, "punto_venta_id string, asesor_id string, capacidad_diaria int, activo boolean")
    s = spark.createDataFrame(scored, "punto_venta_id string, lead_id int, prioridad int, fecha_registro timestamp_ntz").withColumns(
        {"fecha_corte": F.to_date("fecha_registro"), "empresa_id": F.lit("A"), "prioritario": F.lit(False), "temperatura": F.lit("Frío")})
    got = {}
    for r in assignment.assign(s, a).collect():
        got.setdefault(r.punto_venta_id, {})[r.lead_id] = (r.asesor_id, r.estado)
    for i, (cs, n) in enumerate(cases):
        for k, who in enumerate(_snake(cs, n)):
            assert got[f"P{i}"][k] == ((f"P{i}-{who}", "asignado") if who is not None else (None, "sin_cupo"))


def test_rank_matches_window_on_a_hot_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(1)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("p"), F.col("id"))
    got = with_rank(df, ["g"], [("p", False), ("id", True)], [(F.col("p"), False), *id_levels(df, "id")], "r")
    from pyspark.sql import Window
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), "id")).cast("long"))
    assert got.select("g", "id", "r").exceptAll(want.select("g", "id", "r")).isEmpty() and got.count() == 20000


def test_versions(spark):
    assert one(spark, serving.version_number, ["v10", "v2", "2", "v02", "v2b", "V3"]) == [10, 2, None, None, None, None]


def test_writes_are_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = tables.merge_upsert(a, b, ["k"])
    assert sorted(map(tuple, tables.merge_upsert(once, b, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.k for r in tables.mirror(once, a, ["k"]).orderBy("k").collect()] == [1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "leads.csv").write_text("lead_id,canal\n1,\n", encoding="utf-8")
    with pytest.raises(ValueError, match="campania"):
        readers.read_csv(spark, str(tmp_path / "leads.csv"), "leads")
    (tmp_path / "c.json").write_text('[{"conversacion_id": "C", "lead_id": "L", "canal": "W", "fecha_inicio": "x", "mensajes": [{"emisor": "cliente", "hora": "1", "texto": "a"}]}]')
    assert readers.flatten_messages(readers.read_chats(spark, str(tmp_path / "c.json"))).collect()[0].orden == 1
    (tmp_path / "bad.json").write_text('[{"conversacion_id": "C"}]')
    with pytest.raises(Exception, match="objects without"):
        readers.read_chats(spark, str(tmp_path / "bad.json")).collect()


def test_statistics(spark):
    df = spark.createDataFrame([(197, 2200), (0, 0)], "x long, n long")
    p, lo, hi = stats.wilson(F.col("x"), F.col("n"))
    a, b = df.select(p.alias("p"), lo.alias("lo"), hi.alias("hi")).collect()
    assert round(a.p, 4) == 0.0895 and a.lo < a.p < a.hi and b.p is None
    z = spark.range(1).select(stats.two_proportions(F.lit(30), F.lit(100), F.lit(20), F.lit(100)).alias("z")).collect()[0].z
    assert z == pytest.approx(0.1024, abs=1e-3)


def test_bootstrap(spark):
    rows = [("Caliente", i % 5 == 0, True) for i in range(200)] + [("Frío", i % 10 == 0, True) for i in range(300)]
    df = spark.createDataFrame(rows, "temperatura string, c boolean, prueba boolean").withColumn("cerrado", F.col("c").cast("int"))
    ratio = evaluation.hot_cold_ratio(df).collect()[0]
    first, second = (evaluation.bootstrap_ratio(df, 400).collect()[0] for _ in range(2))
    assert ratio.razon == pytest.approx(2.0) and ratio.cumple
    assert first == second and first.bajo < 2.0 < first.alto


def test_policies(spark):
    day = datetime(2026, 6, 1).date()
    rows = [(i, day, 9 if i == 4 else 0, int(i == 4)) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "lead_id int, fecha_registro date, puntos int, cerrado int")
    r = evaluation.captured_closings(df, [0.5]).collect()[0]
    assert (r.llegada, r.puntaje, r.azar) == (0, 1, 0.5)
    q = spark.createDataFrame([(10, 0.7), (13, 0.5), (1, 0.5), (0, 0.7)], "n long, f double").select(evaluation.quota(F.col("n"), F.col("f"))).collect()
    assert [x[0] for x in q] == [7, 7, 1, 1]
    waits = spark.createDataFrame([(h, int(i < x)) for h, x in ((1.0, 5), (30.0, 2), (50.0, 6)) for i in range(10)], "horas_al_primer_contacto double, cerrado int")
    assert [round(r.factor, 6) for r in evaluation.wait_factors(waits, 2).orderBy("dia").collect()] == [1.0, 0.4, 0.4]


def test_rewrites_and_templates(spark):
    msgs = spark.createDataFrame([("C", 1, "cliente", "ESA SÍ me sirve. Tengo como 2"), ("C", 2, "asesor", "esa sí me sirve. tengo")], "conversacion_id string, orden int, emisor string, texto string")
    rows = evaluation.rewrite_clients(msgs, [("esa sí me sirve. tengo", "corto"), ("esa sí me sirve. tengo como", "largo \\1 $0")]).orderBy("orden").collect()
    assert [r.texto for r in rows] == ["largo \\1 $0 2", "esa sí me sirve. tengo"] and rows[0].usadas == ["esa sí me sirve. tengo como"] and not rows[1].cambiado
    assert one(spark, lambda c: text.client_template_key(c, ["Bajaj", "Pulsar NS 160", "Bajaj Pulsar NS 160"]), ["Tengo 4 palos, la Bajaj Pulsar NS 160 "]) == ["tengo<n> palos, la <moto>"]


def test_stratified_sample(spark):
    rows = [(f"C{i:03}", 1, "cliente", "hola") for i in range(60)] + [(f"C{i:03}", 2, "cliente", "2 palos de contado" if i % 7 == 0 else "bien") for i in range(5, 60)]
    msgs = spark.createDataFrame(rows, "conversacion_id string, orden int, emisor string, texto string")
    chats_ = spark.createDataFrame([(f"C{i:03}",) for i in range(60)], "conversacion_id string")
    got = evaluation.stratified_sample(msgs, chats_, chat.brand_pattern(["Bajaj"])).orderBy("posicion").collect()
    assert len(got) == 40 and [r.conversacion_id for r in got[:6]] == ["C000", "C001", "C007", "C014", "C021", "C028"]
    assert [r.estrato for r in got[:6]] == ["sin_respuesta"] * 2 + ["jerga_palos"] * 2 + ["contado"] * 2


class FileInputs:
    """Reference-shaped inputs for the whole plan."""

    def __init__(self, spark):
        self.spark = spark

    def leads(self):
        row = ("L1", "2026-08-05 10:00:00", "whatsapp", "A", "PV-001", "ana pérez", "300 111 2233", None, "BOGOTA", "Honda Navi 2026", "SIN GESTION", None, None)
        rows = [(*row, 0), (*row, 1), ("L2", "05/08/2026 10:30", None, "A", "PV-001", "prueba prueba", "300123", None, None, None, "Contactado", None, None, 2),
                ("L3", "2026-08-06 09:00:00", "Meta Ads", "A", "PV-001", "Jorge Quintero", "3009998877", None, None, "Bajaj Pulsar", "Contactado", "2026-08-05 09:00:00", None, 3)]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (
            "lead_id", "fecha_registro", "canal", "empresa_id", "punto_venta_id", "nombre_cliente", "telefono", "email", "ciudad", "modelo_interes_texto", "estado_gestion", "fecha_primer_contacto", "campania")) + ", orden_archivo int")

    def catalogue(self):
        return models(self.spark).withColumns({"cilindraje": F.lit("110"), "segmento": F.lit("Scooter"), "precio_lista": F.lit("7290000"), "unidades_disponibles": F.lit("3")})

    def advisors(self):
        return self.spark.createDataFrame([("AS-1", "luz", "PV-001", "A", "1", "SI", "2024-01-01")], "asesor_id string, nombre string, punto_venta_id string, empresa_id string, capacidad_diaria_leads string, activo string, fecha_ingreso string")

    def chats(self):
        return self.spark.createDataFrame([("C1", "L1", "WhatsApp", "2026-08-04 10:00:00"), ("C2", "nadie", "WhatsApp", "x")], "conversacion_id string, lead_id string, canal string, fecha_inicio string")

    def messages(self):
        return self.spark.createDataFrame([("C1", 1, "cliente", "10:00", "hola"), ("C1", 2, "cliente", "10:01", "los visito, tengo 20 palos para la Honda Navi")], "conversacion_id string, orden int, emisor string, hora string, texto string")


@pytest.mark.parametrize("materialized", [True, False])
def test_daily_plan(spark, materialized):
    d = Daily(FileInputs(spark), materialized=materialized)
    kinds = {r.tipo: r.casos for r in __import__("leadloom.operators.quality", fromlist=["x"]).counts_by_type(d.quality_log).collect()}
    assert kinds["lead_repetido"] == kinds["registro_prueba"] == kinds["conversacion_huerfana"] == kinds["conversacion_antes_de_registro"] == 1
    assert kinds["modelo_ambiguo"] == kinds["contacto_antes_de_registro"] == kinds["cuota_mayor_que_precio"] == 1
    rows = {r.lead_id: r for r in d.assignment.collect()}
    assert set(rows) == {"L1", "L3"} and rows["L1"].estado == "asignado" and rows["L3"].estado == "sin_cupo"


def test_name_groups_of_any_size_follow_one_rule(spark):
    """64 and 65 names around the same two strangers have the same lowest similarity, that of the strangers."""
    strangers, lowest = ["kkkkkk kkkkkk", "qqqqqq wwwwww"], []
    for n in (62, 63, 200):
        near = [f"kkkkkk qqqqqq {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)]
        rows = [(f"N{i}", "A", "W", "Contactado", name, "7", None, None, None) for i, name in enumerate([*near, *strangers])]
        lowest.append(entities.name_similarity(people(spark, rows)).collect()[0].similitud)
    assert lowest[0] == lowest[1] == lowest[2] < fixed.NAME_COLLISION


def test_partial_ratio_of_equal_lengths_looks_both_ways(spark):
    df = spark.createDataFrame([("abcz", "axbc"), ("axbc", "abcz")], "a string, b string")
    assert [round(r.s, 2) for r in df.select(similarity.partial_ratio(F.col("a"), F.col("b")).alias("s")).collect()] == [85.71, 85.71]


def test_ranks_of_text_ids_with_one_beginning(spark):
    ids = [f"LEAD-{i:06d}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(4)
    got = {r.id: r.r for r in with_rank(df, [], [("id", True)], id_levels(df, "id"), "r").collect()}
    assert got == {x: k + 1 for k, x in enumerate(ids)}


def test_chats_without_messages_and_repeated_primary_rows(spark):
    chats_ = spark.createDataFrame([("A",), ("B",)], "conversacion_id string")
    msgs = spark.createDataFrame([("A", 1, "cliente", "10:00", "hola")], "conversacion_id string, orden int, emisor string, hora string, texto string")
    run = lambda c, m: extraction.rule_extraction(c, m, chat.brand_pattern(["Bajaj"]))
    hashes = extraction.fingerprints(msgs)
    result, computed = extraction.extract_with_cache(chats_, msgs, hashes, run(chats_, msgs).join(hashes, "conversacion_id").limit(0), run)
    assert {r.conversacion_id for r in result.collect()} == {"A", "B"} and computed.count() == 2
    said = F.explode(F.array(*(F.struct(F.lit(i).alias("intencion"), F.lit(k).alias("k")) for k, i in enumerate(("media", "alta", "?")))))
    primary = run(chats_, msgs).filter("conversacion_id = 'A'").drop("intencion").withColumn("s", said).select("*", "s.*").drop("s")
    out = extraction.with_fallback(chats_, msgs, primary, run, "k").collect()
    assert sorted((r.conversacion_id, r.extractor, r.intencion) for r in out) == [("A", fixed.PRIMARY_NAME, "alta"), ("B", fixed.RULES_NAME, "baja")]


def test_a_replaced_date_without_rows_is_emptied(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "d string, v int"), path, "d")
    tables.replace_partitions(spark.createDataFrame([("b", 9)], "d string, v int"), path, "d", ["a", "b"])
    assert sorted((r.d, r.v) for r in spark.read.parquet(path).collect()) == [("b", 9), ("c", 3)]


def test_quoted_line_breaks(spark, tmp_path):
    names = fixed.REQUIRED["leads"]
    (tmp_path / "leads.csv").write_text(",".join(names) + "\n" + ",".join('"two\nlines"' if n == "nombre_cliente" else "1" for n in names) + "\n", encoding="utf-8")
    assert [r.nombre_cliente for r in readers.read_csv(spark, str(tmp_path / "leads.csv"), "leads").collect()] == ["two\nlines"]


def test_waits_outside_the_window(spark):
    waits = spark.createDataFrame([("Caliente", 5.0, 1), ("Caliente", -30.0, 0), ("Caliente", 500.0, 1)], "temperatura string, horas_al_primer_contacto double, cerrado int")
    factors = spark.createDataFrame([(i, 1.0) for i in range(6)], "dia int, factor double")
    base = evaluation.base_probability(waits, factors, (0.5,))
    assert round(base.collect()[0].base, 6) == round(2 / 3, 6)
    late = spark.createDataFrame([("Caliente", 1), ("Caliente", 9)], "temperatura string, espera int")
    with pytest.raises(Exception, match="no factor"):
        evaluation.expected_closings(late, base, factors).collect()


def test_date_classes_count_every_text(spark):
    texts = [None, " ", "2001-02-03 04:05:06", " 2001-02-03T04:05:06", "03-02-2001", "13/02/2001 10:00", "02/13/2001 10:00", "05/05/2001 10:00", "05/06/2001 10:00", "5/6/2001"]
    rows = profiling.date_classes(spark.createDataFrame([(t, t) for t in texts], "a string, b string"), ["a", "b"]).collect()
    kinds = {("vacio", None): 2, ("iso_espacio", None): 1, ("iso_t", None): 1, ("dd-mm-yyyy", None): 1, ("barras", "ddmm"): 1, ("barras", "mmdd"): 1,
             ("barras", "igual"): 1, ("barras", "ambigua"): 1, ("desconocido", None): 1}
    assert {(r.columna, r.formato, r.barras): r.n for r in rows} == {(c, *k): n for c in "ab" for k, n in kinds.items()}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_read_once_per_row(spark):
    """Merged projections would strip a date again for each use of it, and clean a model text for each row instead of each distinct text."""
    raw = spark.createDataFrame([("03/04/2001 10:00", "04-04-2001", "red ring")], "fecha_registro string, fecha_primer_contacto string, t string")
    strips = r"^\s+|\s+$"
    assert _plan(profiling.date_classes(raw, ["fecha_registro", "fecha_primer_contacto"])).count(strips) == 2
    assert _plan(standardize.with_dates(raw)).count("inline(") == 4
    names = spark.createDataFrame([("red ring", "red", "ring")], "sku string, marca string, linea string")
    below = _plan(catalogue.match_texts(raw, "t", names)).split("Aggregate [t#")
    assert len(below) > 1 and not any("translate" in line for part in below[1:] for line in part.splitlines()[1:3])
