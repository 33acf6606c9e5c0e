"""Entity resolution inside each tenant: client key, principal lead, golden record, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions import text
from leadloom.functions.similarity import token_set_floor, token_set_ratio, tokens
from leadloom.operators.quality import LEADS_FILE, log_of, problem

CLIENT = ("empresa_id", "clave_dedup")
_TILE = 64  # names of one side of a tile


def with_client_key(leads: DataFrame) -> DataFrame:
    key = F.coalesce(
        F.concat(F.lit("tel:"), F.col("telefono")), F.concat(F.lit("email:"), F.col("email")),
        F.concat(F.lit("lead:"), F.col("lead_id").cast("string")),
    )
    return leads.withColumn("clave_dedup", key)


def _recency() -> Column:
    """Unreadable dates are the oldest; the id breaks ties."""
    return F.struct(F.coalesce("fecha_registro", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), F.col("lead_id"))


def clients(leads: DataFrame) -> DataFrame:
    """Golden record per client, with the principal lead. Every column is a combinable aggregate."""
    recent = _recency()

    def latest(name: str) -> Column:
        known = F.col(name).isNotNull() & (F.col(name) != "")
        return F.max_by(F.col(name), F.when(known, recent)).alias(name)

    return leads.groupBy(*CLIENT).agg(
        F.max_by("lead_id", F.struct(F.col("estado_gestion") != fixed.DISCARDED, recent)).alias("lead_principal"),
        latest("telefono"), latest("email"),
        F.max_by("nombre", F.struct(F.length("nombre"), recent)).alias("nombre"),
        latest("ciudad"),
        F.count(F.lit(1)).alias("leads"),
        F.size(F.collect_set("canal")).alias("canales"),  # three channels at most
    )


def with_principal(leads: DataFrame, clients_: DataFrame) -> DataFrame:
    """Marks the principal lead of each client; joins on lead_id, which is unique on both sides."""
    principal = clients_.select(F.col("lead_principal").alias("lead_id"), F.lit(True).alias("p"))
    return leads.join(principal, "lead_id", "left").withColumn("es_principal", F.coalesce("p", F.lit(False))).drop("p")


def name_similarity(leads: DataFrame) -> DataFrame:
    """Lowest name similarity per client with several leads: `similitud`, by the same rule at every size.

    Names with the same words collapse first. Comparing all with one of them gives an upper limit of the
    minimum. The pairs are spread in tiles of bounded size; a pair whose shared words alone put it at the
    limit cannot lower it, and only the others are compared letter by letter.
    """
    group = list(CLIENT)
    names = leads.withColumn("palabras", tokens(F.coalesce(text.match_key(F.col("nombre")), F.lit("")))).groupBy(*group, "palabras").agg(
        F.count(F.lit(1)).alias("veces"))
    sizes = names.groupBy(*group).agg(
        F.count(F.lit(1)).alias("distintos"), F.sum("veces").alias("leads"), F.min("palabras").alias("pivote"),
        F.bool_or(F.size("palabras") == 0).alias("vacio")).filter("leads > 1")
    settled = sizes.filter("distintos = 1 OR vacio").select(*group, F.when(F.col("vacio"), 0.0).otherwise(100.0).alias("similitud"))
    several = sizes.filter("distintos > 1 AND NOT vacio").select(*group, "distintos", "pivote")
    members = names.join(several, group).select(*group, "distintos", "pivote", "palabras")
    limits = members.filter("palabras <> pivote").groupBy(*group).agg(F.min(token_set_ratio(F.col("palabras"), F.col("pivote"))).alias("cota"))
    tiles = F.ceil(F.col("distintos") / F.lit(_TILE)).cast("int")
    tiled = (
        members.withColumn("tile", F.pmod(F.xxhash64("palabras"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select(*group, F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "palabras")
    )
    cell = [*group, "t1", "t2"]
    pairs = (
        tiled.withColumnRenamed("palabras", "a").join(tiled.withColumnRenamed("palabras", "b"), cell).filter(F.col("a") < F.col("b"))
        .join(limits, group).filter(token_set_floor(F.col("a"), F.col("b")) < F.col("cota"))
    )
    lower = pairs.groupBy(*group).agg(F.min(token_set_ratio(F.col("a"), F.col("b"))).alias("menor"))
    rest = limits.join(lower, group, "left").select(*group, F.least("cota", "menor").alias("similitud"))
    return settled.unionByName(rest)


def collisions(leads: DataFrame) -> DataFrame:
    """Log: every lead of a client whose names look like different people."""
    low = name_similarity(leads).filter(F.col("similitud") < fixed.NAME_COLLISION)
    action = F.concat(F.lit("similitud "), F.bround("similitud", 0).cast("int").cast("string"), F.lit("; se conserva el grupo"))
    return log_of(leads.join(low, list(CLIENT)), LEADS_FILE, F.col("lead_id"), F.col("empresa_id"), [
        problem(F.lit(True), "nombre_cliente", "posible_colision_telefono", F.col("nombre"), action),
    ])


def deduplicate(leads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clients, leads with key and principal mark, log of name collisions)."""
    keyed = with_client_key(leads)
    people = clients(keyed)
    return people, with_principal(keyed, people), collisions(keyed)


def channels_per_client(leads: DataFrame) -> DataFrame:
    return leads.groupBy(*CLIENT).agg(F.size(F.collect_set("canal")).alias("canales"))
