"""Checking SQL for matching, chats, signals, score and assignment."""

from __future__ import annotations

from leadloom import fixed
from leadloom.plans.driver_tables import ADJECTIVES
from leadloom.plans.oracle_base import CTES, key

B = r"(?:^|$|[^\p{L}\p{N}_])"


def pattern(p: str) -> str:
    return "(?i)" + p.replace(r"\b", B).replace("'", "''")


def lcs(a: str, b: str) -> str:
    full = f"((1::BIGINT << length({a})::INT) - 1)"
    bits = (
        f"list_transform(string_split({b}, ''), lambda c: CAST(list_sum(list_transform(string_split({a}, ''), "
        f"lambda x, i: CASE WHEN x = c THEN (1::BIGINT << (i - 1)::INT) ELSE 0::BIGINT END)) AS BIGINT))"
    )
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce({bits}, "
        f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})) END"
    )


def tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> '')))"


def token_set(source: str) -> str:
    """`source` is a relation with token lists a and b; adds `puntaje`."""
    cut = (
        f"SELECT *, array_to_string(list_filter(a, lambda t: list_contains(b, t)), ' ') AS s_, array_to_string(list_filter(a, lambda t: NOT list_contains(b, t)), ' ') AS ra, "
        f"array_to_string(list_filter(b, lambda t: NOT list_contains(a, t)), ' ') AS rb FROM ({source}) AS p0"
    )
    sized = f"SELECT *, length(ra) + length(rb) - 2 * ({lcs('ra', 'rb')}) AS d, length(s_) AS ls, length(ra) AS la, length(rb) AS lb, CASE WHEN s_ = '' THEN 0 ELSE 1 END AS gap FROM ({cut}) AS p1"

    def sim(d: str, t: str) -> str:
        return f"CASE WHEN {t} > 0 THEN 100::DOUBLE * ({t} - ({d})) / ({t}) ELSE 100::DOUBLE END"

    mixed, wa, wb = sim("d", "(2 * (ls + gap) + la + lb)"), sim("gap + la", "(2 * ls + gap + la)"), sim("gap + lb", "(2 * ls + gap + lb)")
    return (
        f"SELECT * EXCLUDE (s_, ra, rb, d, ls, la, lb, gap), CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0::DOUBLE WHEN ls > 0 AND (la = 0 OR lb = 0) THEN 100::DOUBLE "
        f"WHEN ls = 0 THEN {mixed} ELSE greatest({mixed}, {wa}, {wb}) END AS puntaje FROM ({sized}) AS p2"
    )


def clean_model(x: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_replace(replace({key(x)}, 'a.k.t', 'akt'), '\\b20\\d{{2}}\\b', '', 'g'), '\\s+', ' ', 'g')), '')"


def best(kind: str, name: str, threshold: int) -> str:
    scored = token_set(f"SELECT t.limpio, c.sku, c.marca, {tokens('t.limpio')} AS a, {tokens(clean_model(name))} AS b FROM textos AS t, cat AS c")
    return (
        f"SELECT limpio, any_value(sku) AS sku, any_value(marca) AS marca, max(puntaje) AS puntaje, '{kind}' AS regla FROM "
        f"(SELECT *, max(puntaje) OVER (PARTITION BY limpio) AS m FROM ({scored}) AS s) AS q WHERE puntaje = m AND m >= {threshold} GROUP BY limpio HAVING count(*) = 1"
    )


_short = "CASE WHEN length(mb) <= length(limpio) THEN mb ELSE limpio END"
_long = "CASE WHEN length(mb) <= length(limpio) THEN limpio ELSE mb END"
_piece = "substr(lo, CAST(greatest(i, 0) + 1 AS BIGINT), CAST(least(i + m, n) - greatest(i, 0) AS BIGINT))"
_windows = f"unnest(range(1 - m, n))"

SIGNALS = {
    "sin_inicial": fixed.NO_DOWN_PAYMENT, "contado": fixed.CASH, "credito": fixed.CREDIT, "cita": fixed.APPOINTMENT,
    "cotizacion": fixed.QUOTE_REQUEST, "urgencia": fixed.URGENCY, "desinteres": fixed.DISINTEREST, "unidad": fixed.AMOUNT,
    **{f"o{i}": p for i, p in enumerate(fixed.OBJECTIONS.values())},
}
_sig = ", ".join(f"regexp_matches(texto, '{pattern(p)}') AS s_{n}" for n, p in SIGNALS.items())
_unit = "(?i)" + fixed.AMOUNT
_unit_end, _peso_end = (f"length(regexp_extract(texto, '(?s)^.*(?:{p})', 0))" for p in ("(?i)" + fixed.AMOUNT, fixed.PESOS))
_unit_value = (
    f"CAST(round(CAST(replace(regexp_extract_all(texto, '{_unit}', 1)[-1], ',', '.') AS DOUBLE) * "
    f"CASE WHEN lower(regexp_extract_all(texto, '{_unit}', 2)[-1]) = 'mil' THEN 1000 ELSE 1000000 END) AS BIGINT)"
)
_peso_value = f"CAST(replace(regexp_extract_all(texto, '{fixed.PESOS}', 1)[-1], '.', '') AS BIGINT)"
_brands = "|".join(sorted(ADJECTIVES, key=lambda b: (-len(b), b)))
_mention = r"(?i)(?:^|[^\p{L}\p{N}_])(" + _brands + r")([\s.\-][\p{L}\p{N}_\s.\-]*|$|[^\p{L}\p{N}_\s.\-])"

_first_objection = "CASE " + " ".join(
    f"WHEN obj{i} IS NOT NULL THEN '{n}'" + (" WHEN cuota = 0 THEN 'sin_inicial'" if n == "sin_inicial" else "") for i, n in enumerate(fixed.OBJECTIONS)
) + " ELSE 'ninguna' END"
_first_quote = "CASE " + " ".join(
    f"WHEN obj{i} IS NOT NULL THEN obj{i}" + (" WHEN cuota = 0 THEN t_unidad" if n == "sin_inicial" else "") for i, n in enumerate(fixed.OBJECTIONS)
) + " END"
_over = "(v.cuota_inicial_cop > p.precio_lista)"
_round = f"({_over} AND v.cuota_inicial_cop <= p.precio_lista * 1.05::DOUBLE)"
_points = {
    "q1": "CASE WHEN NOT hay THEN 2 ELSE 0 END", "q2": "CASE WHEN hay AND pidio_cita THEN 3 ELSE 0 END",
    "q3": "CASE WHEN hay AND menciona_cuota = 'SI' THEN 3 ELSE 0 END", "q4": "CASE WHEN precio_lista >= 10000000 THEN 2 ELSE 0 END",
    "q5": "CASE WHEN hay AND forma_pago IN ('contado', 'no_informa') THEN 1 ELSE 0 END",
}
_chat = {
    "b1": "CASE WHEN hay AND intencion = 'alta' THEN 2 WHEN hay AND intencion = 'baja' THEN -2 ELSE 0 END",
    "b2": "CASE WHEN hay AND objecion IN ('reporte_centrales', 'sin_inicial') THEN -1 ELSE 0 END",
    "b3": "CASE WHEN hay AND NOT cliente_respondio THEN -1 ELSE 0 END", "b4": "CASE WHEN canales > 1 THEN 1 ELSE 0 END",
}
_texts = {
    "q1": "'sin conversación: valor esperado de cita, cuota y contado 2'", "q2": "'pidió cita 3'", "q3": "'manifestó cuota inicial 3'",
    "q4": "'modelo de gama alta 2'",
    "q5": "CASE WHEN forma_pago = 'contado' THEN 'paga de contado 1' ELSE 'no dijo la forma de pago (en el histórico cierra como contado) 1' END",
    "b1": "CASE WHEN b1 > 0 THEN 'intención alta 2' ELSE 'intención baja -2' END", "b2": "'objeción: ' || objecion || ' -1'",
    "b3": "'el cliente no respondió -1'", "b4": "'escribió por varios canales 1'", "clip": "'ajuste recortado al rango ±3 ' || CAST(clip AS VARCHAR)",
}
_reasons = "concat_ws('; ', " + ", ".join(f"CASE WHEN {k} <> 0 THEN {v} END" for k, v in _texts.items()) + \
    ", CASE WHEN estado_gestion = 'Sin gestión' THEN 'sin contacto ' ELSE 'estado: ' || estado_gestion || ' ' END || CAST(u AS VARCHAR))"

CTES.update({
    # --- catalogue matching
    "textos": (f"SELECT DISTINCT {clean_model('t')} AS limpio FROM (SELECT modelo_texto_original AS t FROM std UNION SELECT modelo_texto FROM ext) AS z WHERE {clean_model('t')} IS NOT NULL", ("std", "ext", "cat")),
    "m_full": (best("coincidencia_completa", "c.marca || ' ' || c.linea", 85), ("textos", "cat")),
    "m_line": (best("coincidencia_linea", "c.linea", 90), ("textos", "cat")),
    "m_brand": (
        f"SELECT limpio, NULL AS sku, arg_min(marca, (-puntaje, marca)) AS marca, max(puntaje) AS puntaje, 'modelo_ambiguo' AS regla FROM ("
        f"SELECT limpio, marca, max(200::DOUBLE * ({lcs('sh', 'w')}) / (m + length(w))) AS puntaje FROM (SELECT *, {_piece} AS w FROM ("
        f"SELECT *, {_windows} AS i FROM (SELECT * FROM brand_sides UNION ALL SELECT limpio, marca, lo, sh, m, n FROM brand_sides WHERE m = n) AS w0) AS w1) AS w2 GROUP BY limpio, marca) AS g WHERE puntaje >= 85 GROUP BY limpio", ("brand_sides",)),
    "brand_sides": (
        f"SELECT limpio, marca, {_short} AS sh, {_long} AS lo, least(length(mb), length(limpio)) AS m, greatest(length(mb), length(limpio)) AS n "
        "FROM textos, (SELECT DISTINCT marca, lower(marca) AS mb FROM cat) AS br", ("textos", "cat")),
    "resolved": (
        "SELECT * FROM m_full UNION ALL SELECT * FROM m_line WHERE limpio NOT IN (SELECT limpio FROM m_full) UNION ALL SELECT * FROM m_brand WHERE limpio NOT IN (SELECT limpio FROM m_full) "
        "AND limpio NOT IN (SELECT limpio FROM m_line)", ("m_full", "m_line", "m_brand")),
    "bridge": ("SELECT DISTINCT sku, TRY_CAST(trim(p) AS BIGINT) AS punto_venta_id FROM (SELECT sku, unnest(string_split(puntos_venta_disponibles, '|')) AS p FROM cat) AS e WHERE trim(p) <> ''", ("cat",)),
    "matched": (
        f"SELECT r.*, m.sku AS sku_interes, m.marca AS marca_interes, m.puntaje AS match_modelo_score, coalesce(m.regla, CASE WHEN {clean_model('r.modelo_texto_original')} IS NULL THEN 'modelo_faltante' ELSE 'sin_coincidencia' END) AS regla, "
        f"CASE WHEN m.sku IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM bridge AS b WHERE b.sku = m.sku AND b.punto_venta_id = r.punto_venta_id) END AS modelo_disponible_pv "
        f"FROM ranked AS r LEFT JOIN resolved AS m ON m.limpio = {clean_model('r.modelo_texto_original')}", ("ranked", "resolved", "bridge")),
    # --- name collisions
    "sim": (
        "SELECT empresa_id, clave_dedup, min(puntaje) AS similitud FROM (SELECT g.empresa_id, g.clave_dedup, s.puntaje FROM (SELECT DISTINCT x.empresa_id, x.clave_dedup, x.k AS ka, y.k AS kb "
        "FROM nk AS x JOIN nk AS y ON x.empresa_id = y.empresa_id AND x.clave_dedup = y.clave_dedup AND x.lead_id < y.lead_id) AS g JOIN "
        f"(SELECT ka, kb, puntaje FROM ({token_set(f'SELECT ka, kb, {tokens(chr(107) + chr(97))} AS a, {tokens(chr(107) + chr(98))} AS b FROM (SELECT x.k AS ka, y.k AS kb FROM (SELECT DISTINCT k FROM nk) AS x, (SELECT DISTINCT k FROM nk) AS y) AS xy')}) AS t) AS s "
        "ON s.ka = g.ka AND s.kb = g.kb) AS u GROUP BY empresa_id, clave_dedup", ("nk",)),
    "nk": (f"SELECT lead_id, empresa_id, clave_dedup, coalesce({key('nombre')}, '') AS k FROM keyed", ("keyed",)),
    # --- chats
    "cm": ("SELECT conversacion_id, orden, regexp_replace(texto, '^\\s+|\\s+$', '', 'g') AS texto FROM msg WHERE emisor = 'cliente' AND regexp_matches(texto, '\\S')", ("msg",)),
    "sig": (
        f"SELECT *, CASE WHEN eu > ep THEN {_unit_value} WHEN ep > 0 THEN {_peso_value} END AS monto, regexp_extract_all(texto, '{_mention}', 1)[-1] AS marca_m, "
        f"list_filter(string_split_regex(regexp_extract_all(texto, '{_mention}', 2)[-1], '\\s+'), lambda w: w <> '') AS palabras FROM (SELECT *, {_unit_end} AS eu, {_peso_end} AS ep, {_sig} FROM cm) AS z", ("cm",)),
    "sig2": (
        "SELECT *, array_to_string(list_filter(list_concat([marca_m], list_transform(palabras[1:least(3, coalesce(nullif(list_position(list_transform(palabras, "
        "lambda w: NOT (regexp_matches(w, '\\d') OR regexp_matches(w, '^\\p{Lu}'))), true), 0) - 1, len(palabras)))], lambda w: trim(w, '.,;:¿?¡!'))), lambda w: w <> ''), ' ') AS modelo "
        "FROM sig", ("sig",)),
    "chat_agg": (
        "SELECT conversacion_id, count(*) AS n, arg_max(modelo, orden) FILTER (marca_m IS NOT NULL) AS modelo_texto, arg_max(coalesce(monto, 0), orden) FILTER (monto IS NOT NULL OR s_sin_inicial) AS cuota, "
        "arg_max(texto, orden) FILTER (monto IS NOT NULL OR s_sin_inicial) AS t_cuota, arg_min(CASE WHEN s_contado THEN 'contado' ELSE 'credito' END, orden) FILTER (s_contado OR s_credito) AS pago, "
        "arg_min(texto, orden) FILTER (s_contado OR s_credito) AS t_pago, arg_min(texto, orden) FILTER (s_cita) AS t_cita, arg_min(texto, orden) FILTER (s_cotizacion) AS t_cotizacion, "
        "arg_min(texto, orden) FILTER (s_unidad) AS t_unidad, bool_or(s_urgencia) AS urgencia, bool_or(s_desinteres) AS desinteres, "
        + ", ".join(f"arg_min(texto, orden) FILTER (s_o{i}) AS obj{i}" for i in range(len(fixed.OBJECTIONS))) + " FROM sig2 GROUP BY conversacion_id", ("sig2",)),
    "ext": (
        "SELECT c.conversacion_id, modelo_texto, cuota AS cuota_inicial_cop, CASE WHEN cuota IS NULL THEN 'NO_INFORMA' WHEN cuota > 0 THEN 'SI' ELSE 'NO' END AS menciona_cuota, coalesce(pago, 'no_informa') AS forma_pago, "
        "CASE WHEN coalesce(n, 0) <= 1 THEN 'baja' WHEN t_cita IS NOT NULL OR urgencia THEN 'alta' WHEN desinteres THEN 'baja' WHEN t_cotizacion IS NULL AND coalesce(cuota, 0) <= 0 AND pago IS NULL THEN 'baja' ELSE 'media' END AS intencion, "
        f"{_first_objection} AS objecion, t_cita IS NOT NULL AS pidio_cita, t_cotizacion IS NOT NULL AS pidio_cotizacion, coalesce(n, 0) > 1 AS cliente_respondio, "
        f"substr(t_cuota, 1, 160) AS ev_cuota, substr(t_pago, 1, 160) AS ev_pago, substr(t_cita, 1, 160) AS ev_cita, substr(t_cotizacion, 1, 160) AS ev_cotizacion, substr({_first_quote}, 1, 160) AS ev_objecion "
        "FROM chats_raw AS c LEFT JOIN chat_agg AS a USING (conversacion_id)", ("chats_raw", "chat_agg")),
    "valid": (
        f"SELECT v.* EXCLUDE (cuota_inicial_cop, menciona_cuota), m.sku AS sku_extraido, v.cuota_inicial_cop AS cuota_original, v.menciona_cuota AS mencion_original, "
        f"CASE WHEN {_over} AND NOT {_round} THEN NULL WHEN {_round} THEN p.precio_lista ELSE v.cuota_inicial_cop END AS cuota_inicial_cop, "
        f"CASE WHEN {_round} THEN 'cuota_redondeada_al_precio' WHEN {_over} THEN 'cuota_mayor_que_precio' END AS nota FROM ext AS v LEFT JOIN resolved AS m ON m.limpio = {clean_model('v.modelo_texto')} LEFT JOIN cat AS p ON p.sku = m.sku", ("ext", "resolved", "cat")),
    "checked": (
        "SELECT * EXCLUDE (mencion_original), CASE WHEN cuota_inicial_cop > 0 THEN 'SI' WHEN cuota_inicial_cop = 0 THEN 'NO' ELSE mencion_original END AS menciona_cuota FROM valid", ("valid",)),
    "placed": (
        "SELECT k.*, h.inicio, c.lead_principal AS lead_id, c.empresa_id, row_number() OVER (PARTITION BY c.lead_principal ORDER BY coalesce(h.inicio, TIMESTAMP '0001-01-01'), k.conversacion_id) AS posicion "
        "FROM checked AS k JOIN chats AS h USING (conversacion_id) JOIN ranked AS l ON l.lead_id = h.lead_id JOIN clients AS c ON c.empresa_id = l.empresa_id AND c.clave_dedup = l.clave_dedup", ("checked", "chats", "ranked", "clients")),
    "signals": (
        "SELECT lead_id, empresa_id, arg_max(modelo_texto, posicion) FILTER (modelo_texto IS NOT NULL) AS modelo_texto, arg_max(cuota_inicial_cop, posicion) FILTER (cuota_inicial_cop IS NOT NULL) AS cuota_inicial_cop, "
        "coalesce(arg_max(menciona_cuota, posicion) FILTER (cuota_inicial_cop IS NOT NULL), arg_max(menciona_cuota, posicion) FILTER (menciona_cuota <> 'NO_INFORMA'), 'NO_INFORMA') AS menciona_cuota, "
        "coalesce(arg_max(forma_pago, posicion) FILTER (forma_pago <> 'no_informa'), 'no_informa') AS forma_pago, arg_max(intencion, posicion) AS intencion, "
        "coalesce(arg_max(objecion, posicion) FILTER (objecion <> 'ninguna'), 'ninguna') AS objecion, bool_or(pidio_cita) AS pidio_cita, bool_or(pidio_cotizacion) AS pidio_cotizacion, "
        "bool_or(cliente_respondio) AS cliente_respondio, count(*) AS conversaciones FROM placed GROUP BY lead_id, empresa_id", ("placed",)),
    # --- score
    "sc0": (
        "SELECT m.lead_id, m.empresa_id, m.punto_venta_id, m.fecha_registro, m.estado_gestion, cut.fecha_corte, epoch(cut.momento - m.fecha_registro) / 3600.0::DOUBLE AS h, c.canales, p.precio_lista, "
        "s.lead_id IS NOT NULL AS hay, s.* EXCLUDE (lead_id, empresa_id) FROM matched AS m CROSS JOIN cut JOIN clients AS c ON c.empresa_id = m.empresa_id AND c.clave_dedup = m.clave_dedup LEFT JOIN signals AS s ON s.lead_id = m.lead_id "
        "LEFT JOIN cat AS p ON p.sku = m.sku_interes WHERE m.es_principal AND m.estado_gestion <> 'Descartado' AND m.fecha_registro BETWEEN cut.momento - INTERVAL 60 DAY AND cut.momento", ("matched", "cut", "clients", "signals", "cat")),
    "sc1": ("SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in {**_points, **_chat}.items()) +
            ", CASE WHEN estado_gestion = 'Sin gestión' THEN CASE WHEN h < 2 THEN 5 WHEN h < 24 THEN 4 WHEN h < 72 THEN 2 ELSE 1 END WHEN estado_gestion = 'Cotización enviada' THEN 3 "
            "WHEN estado_gestion IN ('En proceso', 'No contesta') THEN 2 ELSE 1 END AS u, estado_gestion = 'Sin gestión' AND h < 24 AS reciente FROM sc0", ("sc0",)),
    "sc2": ("SELECT *, q1 + q2 + q3 + q4 + q5 AS pq, b1 + b2 + b3 + b4 AS br, greatest(-3, least(3, b1 + b2 + b3 + b4)) AS pc, greatest(-3, least(3, b1 + b2 + b3 + b4)) - (b1 + b2 + b3 + b4) AS clip FROM sc1", ("sc1",)),
    "scores": (
        "SELECT lead_id, fecha_corte, 'v3' AS version_score, empresa_id, punto_venta_id, fecha_registro, CAST(pq AS BIGINT) AS puntos_calidad, CAST(pc AS BIGINT) AS puntos_conversacion, CAST(u AS BIGINT) AS puntos_urgencia, "
        f"CAST(pq + pc + u AS BIGINT) AS prioridad, CASE WHEN NOT hay THEN 'Sin calificar' WHEN pq + pc >= 6 THEN 'Caliente' WHEN pq + pc >= 3 THEN 'Tibio' ELSE 'Frío' END AS temperatura, {_reasons} AS razones, reciente AS sin_contacto_reciente, "
        "(hay AND pq + pc >= 6) OR reciente AS prioritario FROM sc2", ("sc2",)),
    "seats": (
        "SELECT punto_venta_id, asesor_id, orden, row_number() OVER (PARTITION BY punto_venta_id ORDER BY pos) AS turno FROM (SELECT a.punto_venta_id, asesor_id, "
        "s.j AS orden, CAST(floor((s.j - 1) / 2) AS BIGINT) * 2 * n + CASE WHEN s.j % 2 = 1 THEN i ELSE 2 * n - 1 - i END AS pos FROM (SELECT *, row_number() OVER "
        "(PARTITION BY punto_venta_id ORDER BY asesor_id) - 1 AS i, count(*) OVER (PARTITION BY punto_venta_id) AS n FROM adv WHERE activo) AS a, "
        "LATERAL (SELECT unnest(range(1, capacidad_diaria + 1)) AS j) AS s) AS z", ("adv",)),
    "assigned": (
        "SELECT u.fecha_corte, u.lead_id, u.empresa_id, u.punto_venta_id, s.asesor_id, s.orden, CASE WHEN s.asesor_id IS NULL THEN 'sin_cupo' ELSE 'asignado' END AS estado, u.prioritario, u.prioridad, u.temperatura, u.fecha_registro "
        "FROM (SELECT *, row_number() OVER (PARTITION BY punto_venta_id ORDER BY prioridad DESC, fecha_registro, lead_id) AS turno FROM scores) AS u LEFT JOIN seats AS s USING (punto_venta_id, turno)", ("scores", "seats")),
})
