"""Enumerations, dictionaries, thresholds and patterns the results depend on."""

# --- Fixed values: canonical channels, states and cities, by folded key -----------------------
CHANNELS = {"whatsapp": "WhatsApp", "meta ads": "Meta Ads", "formulario web": "Formulario Web"}
STATES = {
    "sin gestion": "Sin gestión",
    "no contesta": "No contesta",
    "contactado": "Contactado",
    "en proceso": "En proceso",
    "cotizacion enviada": "Cotización enviada",
    "descartado": "Descartado",
}
CITIES = {
    "barranquilla": "Barranquilla",
    "b/quilla": "Barranquilla",
    "santa marta": "Santa Marta",
    "sta marta": "Santa Marta",
    "rionegro": "Rionegro",
    "rio negro": "Rionegro",
    "bogota": "Bogotá D.C.",
    "bogota dc": "Bogotá D.C.",
    "bogota d.c.": "Bogotá D.C.",
    "cartagena": "Cartagena",
    "cartagena de indias": "Cartagena",
    "medellin": "Medellín",
    "itagui": "Itagüí",
    "monteria": "Montería",
    "bello": "Bello",
    "soledad": "Soledad",
    "soacha": "Soacha",
}
CITY_SYNONYMS = ("b/quilla", "sta marta", "rio negro", "bogota dc", "cartagena de indias")
UNMANAGED = "Sin gestión"
DISCARDED = "Descartado"

# --- Fixed values: accepted text formats ------------------------------------------------------
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
DATE_ISO = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})$"
DATE_DAY = r"^(\d{2})-(\d{2})-(\d{4})$"
DATE_SLASH = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2})$"
WINDOW = ("2026-08-01", "2026-09-30")  # dates outside it lose an ambiguous reading

# --- Fixed values: problem types shown on the lead --------------------------------------------
VISIBLE_FLAGS = (
    "telefono_invalido",
    "fecha_invalida",
    "fecha_ambigua_resuelta_por_defecto",
    "contacto_antes_de_registro",
    "estado_sin_fecha_contacto",
    "sin_gestion_con_contacto",
    "conversacion_antes_de_registro",
    "modelo_ambiguo",
    "modelo_faltante",
    "posible_colision_telefono",
)

# --- Fixed values: matching thresholds --------------------------------------------------------
FULL_MATCH = 85
LINE_MATCH = 90
BRAND_MATCH = 85
NAME_COLLISION = 60

# --- Fixed values: amounts in chat slang ------------------------------------------------------
UNIT_PESOS = {
    "millon": 1_000_000,
    "millón": 1_000_000,
    "millones": 1_000_000,
    "palo": 1_000_000,
    "palos": 1_000_000,
    "millonzito": 1_000_000,
    "millonzitos": 1_000_000,
    "mil": 1_000,
}
AMOUNT = r"(\d+(?:[.,]\d+)?)\s*(millones|millón|millon|millonzitos|millonzito|palos|palo|mil)\b"
PESOS = r"\$\s?(\d{1,3}(?:\.\d{3})+)"

# --- Fixed values: patterns over one client message -------------------------------------------
NO_DOWN_PAYMENT = (
    r"no tengo (con qu[eé] dar la |nada para la )?(la )?inicial|sin inicial|no tengo nada"
)
CASH = r"\b(de |al )?contado\b|la plata lista"
CREDIT = r"financiad|financiar|\bcr[eé]dito\b|\bcuotas\b|\binicial\b"
APPOINTMENT = (
    r"\bvisit(o|ar|arlos|arlo)\b|\bsep[aá]r(emela|ela|emelo|elo|ar|o)\b"
    r"|\bvoy (en camino|saliendo|esta tarde|para all[aá]|ya)\b|\bya voy\b"
    r"|\bpas(o|ar|ar[ií]a)\b[^.?!]{0,25}\b(sede|local|vitrina|por all[aá])\b"
    r"|\bpuedo pasar\b|\blos visito\b"
)
QUOTE_REQUEST = (
    r"env[ií]e(mela|la|melo)?|m[aá]nd(emela|ela|emelo|elo|e|a)\b|cotiza(ci[oó]n|r|me)?"
)
URGENCY = r"la necesito esta semana|necesito la moto ya|urgente|para ya"
DISINTEREST = (
    r"solo estaba mirando|solo mirando|por curiosidad|solo (estoy )?averiguando|no me interesa|ya no"
)
# In priority order: the first one found anywhere in the chat stays.
OBJECTIONS = {
    "reporte_centrales": r"centrales|datacr[eé]dito|reportad|reporte viejo",
    "sin_inicial": NO_DOWN_PAYMENT,
    "tasa_cuota": r"\btasa\b|inter[eé]s (est[aá] )?(muy )?(caro|alto)|cu[aá]nto queda la cuota|cuota mensual",
    "prefiere_usada": r"\busada?s?\b",
    "tiempo_entrega": r"demora la entrega|cu[aá]ndo.{0,15}entregan|entrega inmediata|necesito la moto ya",
    "consultar_familia": (
        r"lo hablo con mi|hablar con mi|consultar (en la casa|con)"
        r"|con mi (esposa|esposo|se[ñn]ora|marido|familia)|en la casa y le digo"
    ),
    "precio": (
        r"m[aá]s econ[oó]mic|muy caro|est[aá] caro|m[aá]s barat|no me alcanza"
        r"|sale del presupuesto|fuera de presupuesto|muy costosa?|inicial est[aá] muy alta"
        r"|por encima de lo que tengo"
    ),
    "comparando": (
        r"comparando|otra marca|me est[aá]n ofreciendo otra|mirando tambi[eé]n|cotizando en otra"
    ),
    "solo_averiguando": DISINTEREST,
}
EVIDENCE_LENGTH = 160
RULES_VERSION = "reglas_v3"
RULES_NAME = "reglas"
PRIMARY_NAME = "gemini"
PROMPT_VERSION = "v4"
PRICE_TOLERANCE = 0.05
TRANSCRIPT_HEADER = r"^\s*(cliente|asesor)\s*\[[^\]]*\]\s*:\s*"
QUOTE_SIMILARITY = 0.9
MAY_QUOTE_ADVISOR = ("cliente_respondio",)
EVALUATED_FIELDS = (
    "modelo_texto", "cuota_inicial_cop", "menciona_cuota", "forma_pago", "intencion",
    "objecion", "pidio_cita", "pidio_cotizacion", "cliente_respondio",
)
# What each extracted field says when nothing is known.
UNKNOWN = {
    "modelo_texto": None,
    "cuota_inicial_cop": None,
    "menciona_cuota": "NO_INFORMA",
    "forma_pago": "no_informa",
    "intencion": "media",
    "objecion": "ninguna",
    "pidio_cita": False,
    "pidio_cotizacion": False,
    "cliente_respondio": True,
}

# --- Fixed values: score ----------------------------------------------------------------------
SCORE_VERSION = "v3"
POINTS = {"cita": 3, "cuota": 3, "precio_alto": 2, "contado": 1}
HIGH_PRICE = 10_000_000
SCORING_STATES = {"cita": (True,), "cuota": ("SI",), "contado": ("contado", "no_informa")}
NO_CHAT_POINTS = 2
HIGH_INTENT, LOW_INTENT, BLOCKING, SILENT, MULTICHANNEL = 2, -2, -1, -1, 1
CHAT_LIMIT = 3
BLOCKING_OBJECTIONS = ("reporte_centrales", "sin_inicial")
URGENCY_HOURS = ((2, 5), (24, 4), (72, 2))
URGENCY_LATE = 1
URGENCY_STATE = {"Cotización enviada": 3, "En proceso": 2, "No contesta": 2, "Contactado": 1}
URGENT_HOURS = 24
HOT, WARM, COLD, UNRATED = "Caliente", "Tibio", "Frío", "Sin calificar"
HOT_FROM, WARM_FROM = 6, 3
TEMPERATURES = (HOT, WARM, COLD, UNRATED)
LIST_DAYS = 30
SPLIT_DATE = "2026-06-15"
MIN_RATIO = 1.8

# --- Fixed values: evaluation -----------------------------------------------------------------
CAPACITIES = (0.5, 0.7, 0.9, 1.0)
CAUSAL_EFFECTS = (0.0, 0.5, 1.0)
MAX_WAIT_DAYS = 5
ARRIVAL_HOURS = 12
BOOTSTRAP = 5000
SAMPLE_SIZE = 40
PER_STRATUM = 2
STRATA = {
    "jerga_palos": r"\bpalos?\b",
    "jerga_millonzitos": r"millonzitos?",
    "monto_pegado_mil": r"\d+mil\b",
    "monto_en_pesos": r"\$\s?\d{1,3}(?:\.\d{3})+",
    "cero_inicial": r"\b0\s*(millones|palos|millonzitos)\b|no tengo.{0,20}inicial",
    "objecion_centrales": r"centrales|datacr[eé]dito",
    "objecion_tasa": r"\btasa\b|inter[eé]s.{0,15}car|cu[aá]nto queda la cuota",
    "objecion_usada": r"\busada?s?\b",
    "objecion_entrega": r"demora la entrega|necesito la moto ya",
    "objecion_familia": r"hablo con mi|consultar en la casa",
    "objecion_comparando": r"comparando|otra marca|ofreciendo otra",
    "objecion_precio": r"m[aá]s econ[oó]mic|presupuesto|muy costosa|inicial est[aá] muy alta",
    "solo_averiguando": r"solo estaba mirando|por curiosidad",
    "pidio_cita": r"visit|sep[aá]rem|voy en camino|voy saliendo",
    "contado": r"contado",
}

# --- Fixed values: profiling lexicon (folded text) --------------------------------------------
LEXICON = {
    "precio": ("muy cara", "costosa", "presupuesto", "por encima de lo que tengo", "algo mas economico"),
    "tasa_cuota": ("cuanto queda la cuota", "interes esta caro"),
    "sin_inicial": ("inicial esta muy alta", "no tengo inicial", "sin inicial"),
    "reporte_centrales": ("centrales", "reportado", "datacredito"),
    "comparando": ("comparando", "otra marca", "otra por menos plata"),
    "consultar_familia": ("esposa", "consultar en la casa", "familia"),
    "prefiere_usada": ("usada",),
    "tiempo_entrega": ("demora la entrega", "entrega"),
    "solo_averiguando": ("solo estaba mirando", "curiosidad"),
    "pidió cita": (
        "visito", "voy en camino", "voy esta tarde", "visitar", "separemela", "pasar manana", "voy saliendo",
    ),
    "pidió cotización": ("enviemela", "mandemela", "mandela"),
    "urgencia (intención alta)": ("voy en camino", "la necesito esta semana", "necesito la moto ya"),
    "pago de contado": ("de contado",),
    "pago a crédito o financiado": ("financiada", "a credito", "credito"),
}
LEXICON_OBJECTIONS = (
    "precio", "tasa_cuota", "sin_inicial", "reporte_centrales", "comparando", "consultar_familia", "prefiere_usada", "tiempo_entrega", "solo_averiguando",
)
AMOUNT_SHAPES = {
    "millones": r"\b\d+(?:[.,]\d+)?\s*millones\b",
    "palos": r"\b\d+(?:[.,]\d+)?\s*palos\b",
    "millonzitos": r"\b\d+(?:[.,]\d+)?\s*millonzitos\b",
    "Nmil (p. ej. 1500mil)": r"\b\d+\s*mil\b",
    "$ con puntos (p. ej. $2.000.000)": r"\$\s*\d{1,3}(?:\.\d{3})+",
}
ZERO_AMOUNT = r"\b0\s*(?:millones|palos|millonzitos)\b"

# --- Fixed values: tenants --------------------------------------------------------------------
TENANTS = (
    ("EMP-01", "Comercializadora Antioquia", "Antioquia"),
    ("EMP-02", "Comercializadora Costa Atlántica", "Costa Atlántica"),
    ("EMP-03", "Comercializadora Bogotá y Soacha", "Bogotá"),
)

# --- Fixed values: required input columns -----------------------------------------------------
REQUIRED = {
    "leads": (
        "lead_id", "fecha_registro", "canal", "empresa_id", "punto_venta_id", "nombre_cliente",
        "telefono", "email", "ciudad", "modelo_interes_texto", "estado_gestion",
        "fecha_primer_contacto", "campania",
    ),
    "catalogo_motos": (
        "sku", "marca", "linea", "cilindraje", "segmento", "precio_lista",
        "puntos_venta_disponibles", "unidades_disponibles",
    ),
    "asesores": (
        "asesor_id", "nombre", "punto_venta_id", "empresa_id", "capacidad_diaria_leads",
        "activo", "fecha_ingreso",
    ),
    "historico_cierres": (
        "lead_id", "fecha_registro", "canal", "empresa_id", "punto_venta_id", "modelo_cotizado",
        "precio_lista", "horas_al_primer_contacto", "numero_contactos", "manifesto_cuota_inicial",
        "forma_pago_declarada", "pidio_cita", "desenlace",
    ),
    "conversaciones": ("conversacion_id", "lead_id", "fecha_inicio", "mensajes"),
}
