"""Signals of a chat: rule extraction, content cache, validation and evidence audit.

Chats are message rows. Every signal is a first, last or any over messages, so each chat reduces
with combinable aggregates and no chat is gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom import fixed
from leadloom.functions import chat, text
from leadloom.operators.ranking import with_rank
from leadloom.sources.tables import materialize

FIELDS = fixed.EVALUATED_FIELDS
CHAT = "conversacion_id"


def client_messages(messages: DataFrame) -> DataFrame:
    """Non-blank client messages, trimmed."""
    return messages.filter((F.col("emisor") == "cliente") & ~text.is_blank(F.col("texto"))).withColumn("texto", text.strip(F.col("texto")))


def message_signals(messages: DataFrame, brands: Column) -> DataFrame:
    t = F.col("texto")
    return chat.with_model(client_messages(messages), "texto", brands, "modelo").withColumns({"monto": chat.amount(t), **chat.signals(t)})


def rule_extraction(chats: DataFrame, messages: DataFrame, brands: Column) -> DataFrame:
    """One extraction per chat; chats without client messages get the defaults of a silent client.
    `brands` is the mention pattern (`chat.brand_pattern`)."""
    marked = message_signals(messages, brands)
    order, t = F.col("orden"), F.col("texto")

    def first(value: Column, when: Column) -> Column:
        return F.min_by(value, F.when(when, order))

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when, order))

    s = {c[2:]: F.col(c) for c in marked.columns if c.startswith("s_")}
    s["obj_sin_inicial"], s["obj_solo_averiguando"] = s["sin_inicial"], s["desinteres"]
    has_amount = F.col("monto").isNotNull() | s["sin_inicial"]
    agg = marked.groupBy(CHAT).agg(
        F.count(F.lit(1)).alias("mensajes"),
        last(F.col("modelo"), F.col("modelo").isNotNull()).alias("modelo_texto"),
        last(F.struct(F.coalesce("monto", F.lit(0).cast("long")).alias("monto"), t.alias("texto")), has_amount).alias("cuota"),
        first(F.struct(F.when(s["contado"], "contado").otherwise("credito").alias("forma"), t.alias("texto")), s["contado"] | s["credito"]).alias("pago"),
        first(t, s["cita"]).alias("cita"), first(t, s["cotizacion"]).alias("cotizacion"), first(t, s["unidad"]).alias("unidad"),
        F.bool_or(s["urgencia"]).alias("urgencia"), F.bool_or(s["desinteres"]).alias("desinteres"),
        *(first(t, s[f"obj_{n}"]).alias(f"obj_{n}") for n in fixed.OBJECTIONS),
    )
    df = chats.select(CHAT).join(agg, CHAT, "left")
    down = F.col("cuota.monto")
    mention = F.when(down.isNull(), "NO_INFORMA").when(down > 0, "SI").otherwise("NO")
    objection, quote = F, F
    for name in fixed.OBJECTIONS:
        said = F.col(f"obj_{name}")
        objection, quote = objection.when(said.isNotNull(), name), quote.when(said.isNotNull(), said)
        if name == "sin_inicial":
            objection, quote = objection.when(down == 0, name), quote.when(down == 0, F.col("unidad"))
    replied = F.coalesce(F.col("mensajes") > 1, F.lit(False))
    pay = F.coalesce("pago.forma", F.lit("no_informa"))
    intent = (
        F.when(~replied, "baja").when(F.col("cita").isNotNull() | F.col("urgencia"), "alta").when(F.col("desinteres"), "baja")
        .when(F.col("cotizacion").isNull() & (mention != "SI") & (pay == "no_informa"), "baja").otherwise("media")
    )
    quotes = {
        "cuota_inicial_cop": F.col("cuota.texto"), "forma_pago": F.col("pago.texto"), "pidio_cita": F.col("cita"),
        "pidio_cotizacion": F.col("cotizacion"), "objecion": quote,
    }
    return df.select(
        CHAT, "modelo_texto", down.alias("cuota_inicial_cop"), mention.alias("menciona_cuota"), pay.alias("forma_pago"),
        intent.alias("intencion"), objection.otherwise("ninguna").alias("objecion"), F.col("cita").isNotNull().alias("pidio_cita"),
        F.col("cotizacion").isNotNull().alias("pidio_cotizacion"), replied.alias("cliente_respondio"),
        evidence_map({k: F.substring(v, 1, fixed.EVIDENCE_LENGTH) for k, v in quotes.items()}).alias("evidencia"),
    )


def evidence_map(quotes: dict[str, Column]) -> Column:
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in quotes.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def evidence_list_to_map(quotes: DataFrame, order: str) -> DataFrame:
    """Quotes (chat, campo, fragmento, `order`) as one map per chat; a repeated field keeps its last quote.
    A chat has as many entries as fields, whatever the length of its list."""
    last = quotes.groupBy(CHAT, "campo").agg(F.max_by("fragmento", order).alias("fragmento"))
    return last.groupBy(CHAT).agg(F.map_from_entries(F.collect_list(F.struct("campo", "fragmento"))).alias("evidencia"))


# --- content cache ----------------------------------------------------------------------------
def fingerprints(messages: DataFrame, columns: Sequence[str] = ("emisor", "hora", "texto")) -> DataFrame:
    """Content hash per chat: the messages' sha-256 digests (position included), combined by xor.

    The state is four numbers and a count whatever the length of the chat. Only equality matters.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    digest = F.sha2(F.concat_ws("\u0001", F.col("orden").cast("string"), *parts), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"w{i}") for i in range(4)]
    summed = messages.select(CHAT, *words).groupBy(CHAT).agg(
        F.count(F.lit(1)).alias("n"), *(F.bit_xor(f"w{i}").alias(f"w{i}") for i in range(4)))
    return summed.select(CHAT, F.concat_ws("-", F.col("n").cast("string"), *(F.lower(F.hex(f"w{i}")) for i in range(4))).alias("hash_contenido"))


NO_MESSAGES = "0-0-0-0-0"


def content_hashes(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Content hash of every chat; that of a chat without messages is the hash of the empty list."""
    found = chats.select(CHAT).join(fingerprints(messages), CHAT, "left")
    return found.select(CHAT, F.coalesce("hash_contenido", F.lit(NO_MESSAGES)).alias("hash_contenido"))


def extract_with_cache(chats: DataFrame, messages: DataFrame, hashes: DataFrame, cache: DataFrame,
                       extractor: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(extraction of every chat, chats that had to be computed).

    Cached content is looked up; of the rest, one chat per distinct content is extracted and its
    result goes back to every chat with that content.
    """
    keyed = chats.select(CHAT).join(hashes, CHAT, "left").withColumn("hash_contenido", F.coalesce("hash_contenido", F.lit(NO_MESSAGES)))
    pending = keyed.join(cache.select("hash_contenido"), "hash_contenido", "left_anti")
    chosen = pending.groupBy("hash_contenido").agg(F.min(CHAT).alias(CHAT))
    fresh = extractor(chosen.select(CHAT), messages.join(chosen.select(CHAT), CHAT, "left_semi"))
    computed = fresh.join(chosen, CHAT).drop(CHAT)
    known = cache.select("hash_contenido", *FIELDS, "evidencia").unionByName(computed.select("hash_contenido", *FIELDS, "evidencia"))
    return keyed.join(known, "hash_contenido"), chosen


@dataclass(frozen=True)
class Extractor:
    """A plug-in: `extract` takes (chats, their messages) and returns one or more rows per chat, the last by `order`."""

    name: str
    version: str
    extract: Callable[[DataFrame, DataFrame], DataFrame]
    order: str | None = None


#: Columns of a stored extraction.
STORED = (
    "hash_contenido string, modelo_texto string, cuota_inicial_cop bigint, menciona_cuota string, forma_pago string, intencion string, objecion string, "
    "pidio_cita boolean, pidio_cotizacion boolean, cliente_respondio boolean, evidencia map<string;string>"
).replace(";", ",")


def through_store(chats: DataFrame, messages: DataFrame, store, primary: Extractor, fallback: Extractor, batch: str) -> tuple[DataFrame, dict[str, int]]:
    """(extraction of every chat with `hash_contenido`, `extractor` and `en_cache`, counts of the run).

    Contents that the primary extractor resolved in earlier batches are read. Of the others one chat for each content is
    extracted, by the fallback where the primary gives no valid row, and added to the store under the name of
    who resolved it; only what the primary resolved is a hit in later runs. Without new contents no extractor is called.
    """
    keyed = materialize(content_hashes(chats, messages), "hashes")
    cached = store.cached(primary.name, primary.version).select("hash_contenido", *FIELDS, "evidencia", "extractor").withColumn("en_cache", F.lit(True))
    pending = materialize(keyed.join(cached.select("hash_contenido"), "hash_contenido", "left_anti").groupBy("hash_contenido").agg(F.min(CHAT).alias(CHAT)), "pending")
    counts = {"extraccion_calculadas": pending.count(), "extraccion_respaldo": 0}
    if counts["extraccion_calculadas"]:
        ids = pending.select(CHAT)
        asked = messages.join(ids, CHAT, "left_semi")
        told, order = primary.extract(ids, asked), primary.order
        if order is None:
            told, order = told.withColumn("_orden", F.lit(0)), "_orden"
        fresh = with_fallback(ids, asked, told, fallback.extract, order, primary.name, fallback.name)
        added = store.add(fresh.join(pending, CHAT).withColumn("prompt_version", F.lit(primary.version)), batch)
        counts["extraccion_respaldo"] = added.filter(F.col("extractor") == fallback.name).count() if fallback.name != primary.name else 0
        known = cached.unionByName(added.select("hash_contenido", *FIELDS, "evidencia", "extractor").withColumn("en_cache", F.lit(False)))
    else:
        known = cached
    found = keyed.join(known, "hash_contenido")
    counts["extraccion_reusadas"] = keyed.count() - counts["extraccion_calculadas"]
    return found, counts


def with_fallback(chats: DataFrame, messages: DataFrame, primary: DataFrame,
                  fallback: Callable[[DataFrame, DataFrame], DataFrame], order: str, name: str = fixed.PRIMARY_NAME,
                  fallback_name: str = fixed.RULES_NAME) -> DataFrame:
    """Schema-valid primary rows of known chats win, of several for a chat the last by `order`; rules
    resolve the rest. `extractor` says which."""
    ids = chats.select(CHAT)
    valid = primary.filter(_valid_row()).join(ids, CHAT, "left_semi")
    rest_of = [c for c in primary.columns if c not in (CHAT, order)]
    good = valid.groupBy(CHAT).agg(F.max_by(F.struct(*rest_of), order).alias("r")).select(CHAT, "r.*")
    rest = ids.join(good.select(CHAT), CHAT, "left_anti")
    ruled = fallback(rest, messages.join(rest, CHAT, "left_semi"))
    return good.withColumn("extractor", F.lit(name)).unionByName(ruled.withColumn("extractor", F.lit(fallback_name)))


def _valid_row() -> Column:
    allowed = {
        "menciona_cuota": ("SI", "NO", "NO_INFORMA"), "forma_pago": ("contado", "credito", "no_informa"),
        "intencion": ("alta", "media", "baja"), "objecion": (*fixed.OBJECTIONS, "ninguna"),
    }
    ok = F.col(CHAT).isNotNull()
    for name, values in allowed.items():
        ok = ok & F.coalesce(F.col(name).isin(*values), F.lit(False))
    return ok


# --- validation -------------------------------------------------------------------------------
def validate(extraction: DataFrame, price: Column) -> DataFrame:
    """Applies the down-payment rules; adds `correcciones` and `cuota_original`."""
    said = F.col("cuota_inicial_cop")
    over = price.isNotNull() & (said > price)
    rounded = over & (said <= price * (1 + fixed.PRICE_TOLERANCE))
    down = F.when((said < 0) | (over & ~rounded), None).when(rounded, price).otherwise(said)
    expected = F.when(down > 0, "SI").when(down == 0, "NO")
    notes = F.array(
        F.when(said < 0, "cuota_negativa"), F.when((said >= 0) & rounded, "cuota_redondeada_al_precio"),
        F.when((said >= 0) & over & ~rounded, "cuota_mayor_que_precio"),
        F.when(expected != F.col("menciona_cuota"), "menciona_cuota_incoherente"),
    )
    return extraction.withColumns({
        "cuota_original": said, "correcciones": F.filter(notes, lambda n: n.isNotNull()),
        "cuota_inicial_cop": down, "menciona_cuota": F.coalesce(expected, F.col("menciona_cuota")),
    })


def as_unknown(extraction: DataFrame, fields: Column) -> DataFrame:
    """Listed fields return to what nothing-is-known says; the amount and its mention fall together."""
    payment = ("cuota_inicial_cop", "menciona_cuota")
    changed = {}
    for name in FIELDS:
        falls = F.array_contains(fields, name)
        if name in payment:
            falls = F.array_contains(fields, payment[0]) | F.array_contains(fields, payment[1])
        changed[name] = F.when(falls, F.lit(fixed.UNKNOWN[name]).cast(extraction.schema[name].dataType)).otherwise(F.col(name))
    return extraction.withColumns(changed)


# --- evidence audit ---------------------------------------------------------------------------
def _close_runs(quote: str, passage: str, size: int, short_allowed: bool) -> list[str]:
    """Runs of `size` words whose letters alone allow the required similarity: letter counts bound
    it from above, so no other run can reach it."""
    codes = np.frombuffer(passage.encode("utf-32-le"), dtype="<u4")
    cuts = np.concatenate(([-1], np.flatnonzero(codes == 32), [len(codes)]))  # words lie between single spaces
    words = len(cuts) - 1
    if words < size:
        return [passage] if short_allowed else []
    begin, end = cuts[:words - size + 1] + 1, cuts[size:]
    shared = np.zeros(len(begin), dtype=np.int64)
    for letter in set(quote):
        seen = np.concatenate(([0], np.cumsum(codes == ord(letter))))
        shared += np.minimum(seen[end] - seen[begin], quote.count(letter))
    near = 2.0 * shared >= fixed.QUOTE_SIMILARITY * (len(quote) + end - begin) - 1e-9
    return [passage[a:b] for a, b in zip(begin[near], end[near])]


@F.pandas_udf(T.BooleanType())
def _near_quote(quote: pd.Series, passage: pd.Series, short_allowed: pd.Series) -> pd.Series:
    """Whether some run of as many words as the quote is a copy with a slip."""
    def found(q: str, p: str, short: bool) -> bool:
        return any(SequenceMatcher(None, q, run).ratio() >= fixed.QUOTE_SIMILARITY for run in _close_runs(q, p, len(q.split()), short))

    return pd.Series([found(q, p, s) for q, p, s in zip(quote, passage, short_allowed)], dtype="bool")


def quotes_of(extraction: DataFrame) -> DataFrame:
    """One row per non-empty quote: `campo`, `cita`, who may have said it and its block size."""
    header = "(?iU)" + fixed.TRANSCRIPT_HEADER
    df = extraction.select(CHAT, F.explode("evidencia").alias("campo", "fragmento"))
    df = df.withColumn("cita", text.quote_key(F.regexp_replace(F.coalesce("fragmento", F.lit("")), header, "")))
    words = F.size(F.split("cita", " "))
    return df.filter(F.col("cita") != "").withColumns({
        "quien": F.when(F.col("campo").isin(*fixed.MAY_QUOTE_ADVISOR), "todos").otherwise("cliente"),
        "bloque_de": F.greatest(F.lit(16), F.pow(F.lit(2), F.ceil(F.log2(words)))).cast("int"),
    })


def passages(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Overlapping runs of consecutive messages, long enough that any quote lies inside one of them.

    A quote of w words spans at most w messages; with blocks of B >= w messages and runs of two
    blocks, no quote is cut, and no run grows with the chat.
    """
    who = F.when(F.col("emisor") == "cliente", F.array(F.lit("cliente"), F.lit("todos"))).otherwise(F.array(F.lit("todos")))
    needed = quotes.select(CHAT, "quien", "bloque_de").distinct()
    said = (
        messages.withColumn("clave", text.quote_key(F.coalesce("texto", F.lit("")))).filter(F.col("clave") != "")
        .withColumn("quien", F.explode(who)).select(CHAT, "quien", "orden", "clave")
        .join(needed.select(CHAT, "quien").distinct(), [CHAT, "quien"], "left_semi")
    )
    placed = with_rank(said, [CHAT, "quien"], [("orden", True)], [(F.shiftright(F.col("orden").cast("long"), 8), True)], name="pos")
    block = F.floor((F.col("pos") - 1) / F.col("bloque_de")).cast("long")
    own = F.when(block > 0, F.array(block, block - 1)).otherwise(F.array(block))
    runs = placed.join(needed, [CHAT, "quien"]).withColumn("bloque", F.explode(own))
    return runs.groupBy(CHAT, "quien", "bloque_de", "bloque").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clave"))), lambda m: m["clave"]), " ").alias("tramo"))


def unsupported(extraction: DataFrame, messages: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Quotes that do not occur in their chat: `conversacion_id`, `campo`, `fragmento`."""
    quotes = quotes_of(extraction)
    key = [CHAT, "campo"]
    at = quotes.select(*key, "cita", "quien", "bloque_de").join(passages(messages, quotes), [CHAT, "quien", "bloque_de"])
    found = at.filter(F.col("tramo").contains(F.col("cita"))).select(*key).distinct()
    missing = quotes.join(found, key, "left_anti").select(*key, "fragmento")
    if not fuzzy:
        return missing
    near = (
        at.join(missing.select(*key), key, "left_semi")
        .filter(_near_quote("cita", "tramo", F.col("bloque") == 0)).select(*key).distinct()
    )
    return missing.join(near, key, "left_anti")
