"""Match lookup and comparison around listings, and what cards show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.functions.text import is_blank

#: Visible listings whose ids are broadcast, to leave out other listings' matches early.
BROADCAST = 200_000
#: Listings whose matches one task lists.
LISTINGS = 50_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Live edges seen from each end: id, other, and the edge's columns."""
    live = edges.where("estado <> 'descartada'")
    kept = ["estado", "puntaje", "imagenes_coincidentes"]
    forth = live.select(F.col("publicacion_id").alias("id"), F.col("candidata_id").alias("other"), F.col("id").alias("edge_id"), *kept)
    back = live.select(F.col("candidata_id").alias("id"), F.col("publicacion_id").alias("other"), F.col("id").alias("edge_id"), *kept)
    return forth.union(back)


def match_order() -> list[Column]:
    """Confirmed first, then the higher score, then the smaller edge."""
    return [F.desc(F.col("estado") == "confirmada"), F.desc_nulls_last("puntaje"), F.asc("edge_id")]


def match_lists(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """id, coincidencias: the matches of every visible listing, in match order; listings without any have an empty array.

    Listings and their matches meet in one grouping, dealt to as many tasks as there are listings for, so a task's share doesn't grow with the tables.
    """
    n = visible.count()
    mine = both_ways(edges).where("id IS NOT NULL")
    if n <= BROADCAST:
        mine = mine.join(F.broadcast(visible.select("id").distinct()), "id", "left_semi")
    # arrays sort ascending, so what sorts first is negated
    item = F.struct((F.col("estado") != "confirmada").alias("k1"), (-F.col("puntaje")).alias("k2"), F.col("edge_id").alias("k3"), "other", "estado", "puntaje")
    mine = mine.select("id", item.alias("item"), F.lit(0).alias("times"))
    seen = visible.select("id", F.lit(None).cast(mine.schema["item"].dataType).alias("item"), F.lit(1).alias("times"))
    dealt = seen.union(mine).repartition(max(1, -(-n // LISTINGS)), "id")
    lists = dealt.groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"), F.sum("times").cast("int").alias("times")).where("times > 0")
    shown = F.transform("items", lambda x: F.struct(x["k3"].alias("edge_id"), x["other"].alias("otra_id"), x["estado"].alias("estado"), x["puntaje"].alias("puntaje")))
    # a listing that is visible more than once has as many rows
    return lists.select("id", shown.cast(empty_type()).alias("coincidencias"), F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("once")).drop("once")


def empty_type() -> str:
    return "array<struct<edge_id:bigint,otra_id:bigint,estado:string,puntaje:decimal(5,2)>>"


def match_counts(edges: DataFrame) -> DataFrame:
    """id, confirmed, candidates of every listing with live edges."""
    return both_ways(edges).groupBy("id").agg(F.count_if(F.col("estado") == "confirmada").alias("confirmadas"), F.count_if(F.col("estado") == "pendiente").alias("candidatas"))


def duplicate_label(confirmed: Column, candidates: Column) -> Column:
    """Confirmed count if any, else candidates, else a dash."""
    return F.when(confirmed > 0, F.concat(confirmed.cast("string"), F.lit(" confirmadas"))).when(candidates > 0, F.concat(candidates.cast("string"), F.lit(" candidatas"))).otherwise("-")


def comparison(listings: DataFrame, edges: DataFrame, sources: DataFrame, root: int) -> DataFrame:
    """A listing and those it is matched with: the root first, then by score (none counts as 0)."""
    near = both_ways(edges).where(F.col("id") == root)
    # of several edges to one listing the last in match order counts
    best = near.groupBy("other").agg(F.max_by(F.struct("edge_id", "puntaje", "estado", "imagenes_coincidentes"), F.struct(F.col("estado") != "confirmada", -F.col("puntaje"), "edge_id")).alias("m"))
    wanted = best.select(F.col("other").alias("id"), "m.*").unionByName(near.sparkSession.createDataFrame([(root,)], "id long"), allowMissingColumns=True)
    named = sources.select(F.col("id").alias("fuente_id"), F.col("nombre").alias("fuente_nombre"))
    found = listings.join(wanted, "id").join(named, "fuente_id", "left")
    found = found.withColumn("imagenes_coincidentes", F.coalesce("imagenes_coincidentes", F.lit(0)))
    return found.orderBy(F.desc(F.col("id") == root), F.desc(F.coalesce("puntaje", F.lit(0))), "id")


def roles_joined(edges: DataFrame, listings: DataFrame, sources: DataFrame, columns: tuple[str, ...] = ("barrio", "precio")) -> DataFrame:
    """Edges with both listings and their sources, by role: a_* and b_*. Edges need both listings, sources may lack."""
    out = edges
    for role, key in (("a", "publicacion_id"), ("b", "candidata_id")):
        side = listings.select(F.col("id").alias(key), F.col("fuente_id").alias(f"{role}_fuente_id"), *[F.col(c).alias(f"{role}_{c}") for c in columns])
        named = sources.select(F.col("id").alias(f"{role}_fuente_id"), F.col("nombre").alias(f"{role}_fuente"))
        out = out.join(side, key).join(named, f"{role}_fuente_id", "left")
    return out


def needs_hashing(evidence: DataFrame, hashes: DataFrame, algorithm: str = "dhash64") -> DataFrame:
    """Image evidence without a complete hash."""
    done = hashes.where((F.col("algoritmo") == algorithm) & F.col("hash_contenido").isNotNull()).select(F.col("evidencia_id").alias("id"))
    return evidence.where("tipo = 'imagen'").join(done, "id", "left_anti")


def existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows (key fila) with the stored listing of the same link, or of the same source and code; the smallest id of several, null for new rows.

    Two equality joins, one for each key space, stand for the one condition with OR.
    """
    codes = ["fuente_id", "codigo_externo"]
    # the smallest id of each key first, so a key that many rows share meets one row
    of_link = stored.groupBy("link_origen").agg(F.min("id").alias("id"))
    of_code = stored.groupBy(*codes).agg(F.min("id").alias("id"))
    by_link = incoming.select("fila", "link_origen").join(of_link, "link_origen").select("fila", "id")
    by_code = incoming.select("fila", *codes).join(of_code, codes).select("fila", "id")
    found = by_link.union(by_code).groupBy("fila").agg(F.min("id").alias("existente_id"))
    return incoming.join(found, "fila", "left")


def link_status(checks: DataFrame) -> DataFrame:
    """id, ok: false if any link is broken, null if any is unknown, else true (from id, ok; ok null is unknown)."""
    some = checks.groupBy("id").agg(F.count_if(F.coalesce(~F.col("ok"), F.lit(False))).alias("broken"), F.count_if(F.col("ok").isNull()).alias("unknown"))
    return some.select("id", F.when(F.col("broken") > 0, False).when(F.col("unknown") > 0, F.lit(None).cast("boolean")).otherwise(True).alias("ok"))


def is_real_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^https?://"), F.lit(False))


def map_url(coordinates: Column) -> Column:
    return F.when(~is_blank(coordinates), F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.url_encode(coordinates)))
