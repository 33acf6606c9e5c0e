"""Shared pieces of the checking SQL: the same inputs and an independent standardisation."""

from __future__ import annotations

import re

from leadloom.plans import driver_tables as d

_TABLE = {t: t for t in d.TABLES}


def _raw(text: str, **extra: str) -> str:
    return text.format_map({**_TABLE, **extra})


def key(x: str) -> str:
    return f"nullif(trim(regexp_replace(strip_accents(lower({x})), '\\s+', ' ', 'g')), '')"


def title(x: str) -> str:
    words = f"string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _dictionary(x: str, names: dict[str, str]) -> str:
    return "CASE " + key(x) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _reading(col: str, pattern: str, y: int, m: int, dd: int, h: int | None, mi: int | None) -> str:
    def g(i: int) -> str:
        return f"regexp_extract(trim({col}), '{pattern}', {i})"

    time = f"{g(h)} || ':' || {g(mi)} || ':00'" if h else "'00:00:00'"
    return f"TRY_CAST({g(y)} || '-' || {g(m)} || '-' || {g(dd)} || ' ' || {time} AS TIMESTAMP)"


ISO = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})$"
DAY = r"^(\d{2})-(\d{2})-(\d{4})$"
SLASH = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2})$"


def date_class(col: str) -> str:
    return (
        f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN 'vacio' WHEN regexp_matches(trim({col}), '{ISO}') THEN "
        f"CASE WHEN contains({col}, 'T') THEN 'iso_t' ELSE 'iso_espacio' END WHEN regexp_matches(trim({col}), '{DAY}') THEN 'dd-mm-yyyy' "
        f"WHEN regexp_matches(trim({col}), '{SLASH}') THEN 'barras' ELSE 'desconocido' END"
    )


def readings(col: str, p: str) -> str:
    """Struct-free columns: list of readings, format, precision."""
    cls = date_class(col)
    first = f"CASE {cls} WHEN 'iso_t' THEN {_reading(col, ISO, 1, 2, 3, 4, 5)} WHEN 'iso_espacio' THEN {_reading(col, ISO, 1, 2, 3, 4, 5)} " \
            f"WHEN 'dd-mm-yyyy' THEN {_reading(col, DAY, 3, 2, 1, None, None)} WHEN 'barras' THEN {_reading(col, SLASH, 3, 2, 1, 4, 5)} END"
    second = f"CASE {cls} WHEN 'barras' THEN {_reading(col, SLASH, 3, 1, 2, 4, 5)} END"
    return (
        f"list_distinct(list_filter([{first}, {second}], lambda x: x IS NOT NULL)) AS {p}_all, {first} AS {p}_first, {cls} AS {p}_class, "
        f"CASE {cls} WHEN 'dd-mm-yyyy' THEN 'dia' WHEN 'vacio' THEN NULL WHEN 'desconocido' THEN NULL ELSE 'minuto' END AS {p}_prec"
    )


LO, HI = d.WINDOW


def resolution(col: str, p: str, other: str | None, registration: bool) -> str:
    """Date and reason by counting the readings that survive each rule."""
    inside = f"lambda x: CAST(x AS DATE) BETWEEN DATE '{LO}' AND DATE '{HI}'"
    inn = f"list_filter({p}_all, {inside})"
    cand = f"CASE WHEN len({inn}) > 0 THEN {inn} ELSE {p}_all END"
    if other is None:
        coh = "([]::TIMESTAMP[])"
    else:
        oin = f"list_filter({other}_all, lambda y: CAST(y AS DATE) BETWEEN DATE '{LO}' AND DATE '{HI}')"
        oth = f"CASE WHEN len({oin}) > 0 THEN {oin} ELSE {other}_all END"
        day = f"({p}_prec = 'dia' OR coalesce({other}_prec, '') = 'dia')"
        sign = "<=" if registration else ">="
        coh = (
            f"list_filter({cand}, lambda x: len(list_filter({oth}, lambda z: CASE WHEN {day} "
            f"THEN CAST(x AS DATE) {sign} CAST(z AS DATE) ELSE x {sign} z END)) > 0)"
        )
    reason = (
        f"CASE WHEN {p}_class = 'vacio' THEN 'vacia' WHEN len({p}_all) = 0 THEN 'invalida' "
        f"WHEN len({p}_all) = 1 THEN CASE WHEN {p}_class = 'barras' THEN 'componente_mayor_12' ELSE 'unica' END "
        f"WHEN len({inn}) = 1 THEN 'ventana' WHEN len({coh}) = 1 THEN 'coherencia' ELSE 'por_defecto' END"
    )
    at = (
        f"CASE {reason} WHEN 'vacia' THEN NULL WHEN 'invalida' THEN NULL WHEN 'ventana' THEN {inn}[1] "
        f"WHEN 'coherencia' THEN {coh}[1] WHEN 'por_defecto' THEN {p}_first ELSE {p}_all[1] END"
    )
    return f"{reason} AS {p}_reason, {at} AS {p}_at"


def phone(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    local = f"CASE WHEN length({digits}) = 12 AND {digits} LIKE '57%' THEN substr({digits}, 3) ELSE {digits} END"
    return f"CASE WHEN regexp_full_match({local}, '3[0-9]{{9}}') THEN {local} END"


def email(x: str) -> str:
    return f"CASE WHEN regexp_full_match(lower(trim({x})), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN lower(trim({x})) END"


from leadloom import fixed  # noqa: E402

_CITY = f"CASE WHEN {key('ciudad')} IS NULL THEN NULL ELSE coalesce({_dictionary('ciudad', fixed.CITIES)}, {title('ciudad')}) END"
VISIBLE = ", ".join(f"'{t}'" for t in fixed.VISIBLE_FLAGS)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "raw": (f"SELECT *, 2 * lead_id + unnest(CASE WHEN lead_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS orden_archivo FROM ({_raw(d.RAW_LEADS_ONCE)}) AS r", ()),
    "dated": (f"SELECT *, {readings('fecha_registro', 'reg')}, {readings('fecha_primer_contacto', 'con')}, "
              "row_number() OVER (PARTITION BY lead_id ORDER BY orden_archivo) AS copia FROM raw", ("raw",)),
    "measured": (
        f"SELECT *, {resolution('fecha_registro', 'reg', 'con', True)}, {resolution('fecha_primer_contacto', 'con', 'reg', False)}, "
        f"{_dictionary('canal', fixed.CHANNELS)} AS canal_n, {_dictionary('estado_gestion', fixed.STATES)} AS estado_n, "
        f"{phone('telefono')} AS telefono_n, {email('email')} AS email_n, "
        f"CASE WHEN {key('nombre_cliente')} IS NULL THEN '' ELSE {title('nombre_cliente')} END AS nombre_n, "
        f"CASE WHEN {key('nombre_cliente')} IS NULL THEN '' ELSE nombre_cliente END AS nombre_o, {_CITY} AS ciudad_n FROM dated", ("dated",)),
    "tested": (
        "SELECT *, contains(lower(nombre_o), 'prueba') OR (telefono_n IS NULL AND canal_n IS NULL) AS es_prueba, "
        "coalesce(reg_prec = 'dia', false) OR coalesce(con_prec = 'dia', false) AS por_dia, "
        "coalesce(CASE WHEN coalesce(reg_prec = 'dia', false) OR coalesce(con_prec = 'dia', false) "
        "THEN CAST(con_at AS DATE) < CAST(reg_at AS DATE) ELSE con_at < reg_at END, false) AS antes FROM measured", ("measured",)),
    "std": (
        "SELECT lead_id, empresa_id, punto_venta_id, canal_n AS canal, nullif(trim(campania), '') AS campania, reg_at AS fecha_registro, "
        "CASE WHEN reg_at IS NOT NULL THEN reg_prec END AS fecha_registro_precision, con_at AS fecha_primer_contacto, "
        "CASE WHEN con_at IS NOT NULL THEN con_prec END AS fecha_contacto_precision, coalesce(estado_n, 'Sin gestión') AS estado_gestion, "
        "nombre_n AS nombre, telefono_n AS telefono, email_n AS email, ciudad_n AS ciudad, nullif(trim(modelo_interes_texto), '') AS modelo_texto_original "
        "FROM tested WHERE copia = 1 AND NOT es_prueba AND canal_n IS NOT NULL", ("tested",)),
    "log_std": (
        """SELECT * FROM (
  SELECT lead_id, empresa_id, unnest([
    CASE WHEN es_prueba THEN {'campo': 'nombre_cliente', 'tipo': 'registro_prueba', 'valor': nombre_o, 'accion': 'excluido'} END,
    CASE WHEN NOT es_prueba AND canal_n IS NULL THEN {'campo': 'canal', 'tipo': 'canal_invalido', 'valor': canal, 'accion': 'excluido: el canal es obligatorio'} END,
    CASE WHEN ok AND canal_n IS DISTINCT FROM canal THEN {'campo': 'canal', 'tipo': 'canal_no_estandar', 'valor': canal, 'accion': 'normalizado a ' || canal_n} END,
    CASE WHEN ok AND estado_n IS NULL THEN {'campo': 'estado_gestion', 'tipo': 'estado_desconocido', 'valor': estado_gestion, 'accion': 'se asume Sin gestión'} END,
    CASE WHEN ok AND estado_n <> estado_gestion THEN {'campo': 'estado_gestion', 'tipo': 'estado_no_estandar', 'valor': estado_gestion, 'accion': 'normalizado a ' || estado_n} END,
    CASE WHEN ok AND telefono_n IS NULL THEN {'campo': 'telefono', 'tipo': 'telefono_invalido', 'valor': telefono, 'accion': 'se guarda nulo; clave secundaria por email'} END,
    CASE WHEN ok AND telefono_n <> telefono THEN {'campo': 'telefono', 'tipo': 'telefono_formato', 'valor': telefono, 'accion': 'solo dígitos, sin prefijo 57'} END,
    CASE WHEN ok AND trim(email) <> '' AND email_n IS NULL THEN {'campo': 'email', 'tipo': 'email_invalido', 'valor': email, 'accion': 'se guarda nulo'} END,
    CASE WHEN ok AND email_n <> email THEN {'campo': 'email', 'tipo': 'email_normalizado', 'valor': email, 'accion': 'strip y minúsculas'} END,
    CASE WHEN ok AND nombre_n <> nombre_o THEN {'campo': 'nombre_cliente', 'tipo': 'nombre_normalizado', 'valor': nombre_o, 'accion': 'espacios y formato título'} END,
    CASE WHEN ok AND ciudad_n <> ciudad THEN {'campo': 'ciudad', 'tipo': 'ciudad_normalizada', 'valor': ciudad, 'accion': 'normalizada a ' || ciudad_n} END,
    CASE WHEN ok AND reg_reason IN ('ventana', 'coherencia') THEN {'campo': 'fecha_registro', 'tipo': 'formato_fecha_ambiguo', 'valor': fecha_registro, 'accion': 'resuelta por ' || reg_reason} END,
    CASE WHEN ok AND reg_reason = 'por_defecto' THEN {'campo': 'fecha_registro', 'tipo': 'fecha_ambigua_resuelta_por_defecto', 'valor': fecha_registro, 'accion': 'se usa dd/mm'} END,
    CASE WHEN ok AND reg_reason = 'invalida' THEN {'campo': 'fecha_registro', 'tipo': 'fecha_invalida', 'valor': fecha_registro, 'accion': 'se guarda nula'} END,
    CASE WHEN ok AND con_reason IN ('ventana', 'coherencia') THEN {'campo': 'fecha_primer_contacto', 'tipo': 'formato_fecha_ambiguo', 'valor': fecha_primer_contacto, 'accion': 'resuelta por ' || con_reason} END,
    CASE WHEN ok AND con_reason = 'por_defecto' THEN {'campo': 'fecha_primer_contacto', 'tipo': 'fecha_ambigua_resuelta_por_defecto', 'valor': fecha_primer_contacto, 'accion': 'se usa dd/mm'} END,
    CASE WHEN ok AND con_reason = 'invalida' THEN {'campo': 'fecha_primer_contacto', 'tipo': 'fecha_invalida', 'valor': fecha_primer_contacto, 'accion': 'se guarda nula'} END,
    CASE WHEN ok AND antes THEN {'campo': 'fecha_primer_contacto', 'tipo': 'contacto_antes_de_registro', 'valor': fecha_primer_contacto, 'accion': 'bandera'} END,
    CASE WHEN ok AND coalesce(estado_n, 'Sin gestión') <> 'Sin gestión' AND con_at IS NULL THEN {'campo': 'fecha_primer_contacto', 'tipo': 'estado_sin_fecha_contacto', 'valor': estado_n, 'accion': 'bandera'} END,
    CASE WHEN ok AND coalesce(estado_n, 'Sin gestión') = 'Sin gestión' AND con_at IS NOT NULL THEN {'campo': 'fecha_primer_contacto', 'tipo': 'sin_gestion_con_contacto', 'valor': fecha_primer_contacto, 'accion': 'bandera'} END
  ]) AS p FROM (SELECT *, NOT es_prueba AND canal_n IS NOT NULL AS ok FROM tested WHERE copia = 1) AS t
  UNION ALL SELECT lead_id, empresa_id, {'campo': 'lead_id', 'tipo': 'lead_repetido', 'valor': CAST(lead_id AS VARCHAR), 'accion': 'se conserva la primera fila'} FROM tested WHERE copia > 1
) AS u WHERE p IS NOT NULL""", ("tested",)),
    "keyed": ("SELECT *, coalesce('tel:' || telefono, 'email:' || email, 'lead:' || CAST(lead_id AS VARCHAR)) AS clave_dedup, "
              "coalesce(fecha_registro, TIMESTAMP '0001-01-01') AS f FROM std", ("std",)),
    "ranked": ("SELECT *, row_number() OVER (PARTITION BY empresa_id, clave_dedup ORDER BY (estado_gestion = 'Descartado'), f DESC, lead_id DESC) = 1 AS es_principal "
               "FROM keyed", ("keyed",)),
    "clients": (
        "SELECT empresa_id, clave_dedup, max(lead_id) FILTER (es_principal) AS lead_principal, "
        "arg_max(telefono, (f, lead_id)) FILTER (telefono IS NOT NULL) AS telefono, arg_max(email, (f, lead_id)) FILTER (email IS NOT NULL) AS email, "
        "arg_max(nombre, (length(nombre), f, lead_id)) AS nombre, arg_max(ciudad, (f, lead_id)) FILTER (ciudad IS NOT NULL) AS ciudad, "
        "count(*) AS leads, count(DISTINCT canal) AS canales FROM ranked GROUP BY empresa_id, clave_dedup", ("ranked",)),
    "cut": ("SELECT CAST(max(fecha_registro) AS DATE) AS fecha_corte, max(fecha_registro) AS momento FROM std", ("std",)),
    "cat": (_raw(d.CATALOGUE, first="1", second="2"), ()),
    "adv_raw": (_raw(d.ADVISORS), ()),
    "adv": ("SELECT asesor_id, empresa_id, punto_venta_id, " + title("nombre") + " AS nombre, CAST(capacidad_diaria_leads AS BIGINT) AS capacidad_diaria, "
            "upper(trim(activo)) = 'SI' AS activo, CAST(fecha_ingreso AS DATE) AS fecha_ingreso FROM adv_raw", ("adv_raw",)),
    "usr": (_raw(d.USERS), ()),
    "his_raw": (_raw(d.HISTORY), ()),
    "his": ("SELECT lead_id, fecha_registro, " + _dictionary("canal", fixed.CHANNELS) + " AS canal, empresa_id, punto_venta_id, modelo_cotizado, precio_lista, "
            "CAST(horas_al_primer_contacto AS DOUBLE) AS horas_al_primer_contacto, CAST(numero_contactos AS BIGINT) AS numero_contactos, manifesto_cuota_inicial, "
            "forma_pago_declarada, pidio_cita = 'SI' AS pidio_cita, desenlace FROM his_raw", ("his_raw",)),
    "msg": (_raw(d.MESSAGES), ()),
    "owners": ("SELECT o_orderkey AS lead_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey % 1440 DESC, o_orderkey DESC) AS recency FROM orders", ()),
    "chats_raw": (_raw(d.CHATS, owners="owners"), ("owners",)),
    "chats_read": (f"SELECT *, {readings('fecha_inicio', 'ini')} FROM chats_raw", ("chats_raw",)),
    "chats": (f"SELECT conversacion_id, lead_id, canal, fecha_inicio, ini_at AS inicio FROM (SELECT *, {resolution('fecha_inicio', 'ini', None, False)} FROM chats_read) AS q", ("chats_read",)),
}


def with_ctes(body: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """Prefixes the query with the CTEs it names, in dependency order."""
    pool = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in pool[name][1]:
            visit(parent)
        order.append(name)

    for name in pool:
        if re.search(rf"\b(?:FROM|JOIN|IN)\s+\(?{name}\b", body):
            visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({pool[n][0]})" for n in order) + "\n" + body
