"""Changes to tables as new tables: upserts, fills, JSON patches, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.functions.text import blank_to_null, is_blank, strip
from terrado.operators.windows import keep_first

# States that a review has set.
REVIEWED = ("descartada", "confirmada")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new put over those of equal keys (unique in each), and added.

    kept: for a column, the value of rows that both have, of old.* and new.* .
    """
    has_old, has_new = F.col("old._in").isNotNull(), F.col("new._in").isNotNull()
    a, b = old.withColumn("_in", F.lit(1)).alias("old"), new.withColumn("_in", F.lit(1)).alias("new")
    joined = a.join(b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    out = []
    for c in old.columns:
        mine, theirs = F.col(f"old.{c}"), F.col(f"new.{c}") if c in new.columns else F.lit(None)
        both = (kept or {}).get(c, theirs if c in new.columns else mine)
        out.append(F.when(has_old & has_new, both).when(has_new, theirs).otherwise(mine).alias(c))
    return joined.select(*out)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by ordered pair; a reviewed state stays whatever the detector says."""
    state = F.when(F.col("old.estado").isin(*REVIEWED), F.col("old.estado")).otherwise(F.col("new.estado"))
    kept = {"estado": state} | {c: F.col(f"old.{c}") for c in ("id", "fecha_revision") if c in old.columns}
    return upsert(old, new, ["publicacion_id", "candidata_id"], kept)


def keep_higher(a: Column, b: Column) -> Column:
    """The greater of two scores; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def fill_missing(old: Column, new: Column, blank: bool = False) -> Column:
    """old, or new where old is null (or blank)."""
    return F.coalesce(blank_to_null(old) if blank else old, new)


def json_get(document: Column, path: str, kind: str = "string") -> Column:
    """A value in a JSON text; null if the text is no JSON or the value is not of the kind."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def json_set(document: Column, key: str, value: Column) -> Column:
    """A JSON object with key set to a text; null and invalid documents count as empty ones."""
    pairs = _members(document, key)
    return F.to_json(F.map_concat(pairs, F.create_map(F.lit(key), value.cast("string"))))


def json_remove(document: Column, key: str) -> Column:
    return F.to_json(_members(document, key))


def _members(document: Column, without: str) -> Column:
    found = F.coalesce(F.from_json(document, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    return F.map_filter(found, lambda k, _: k != without)


def corrected_capture(updated: Column, given: Column) -> Column:
    """The update date, else the given one, in yyyy-MM-dd; an update date that is not valid does not fall back."""
    return F.when(~is_blank(updated), F.to_date(F.try_to_timestamp(strip(updated), F.lit("yyyy-MM-dd")))).otherwise(F.to_date(F.try_to_timestamp(strip(given), F.lit("yyyy-MM-dd"))))


def seed_catalog(official: DataFrame, values: DataFrame, key: Column, name: str = "nombre") -> DataFrame:
    """key, nombre: official names first, then those in use, the first spelling of every key. Frames have nombre and orden."""
    both = official.select(name, "orden", F.lit(0).alias("_rank")).union(values.select(name, "orden", F.lit(1).alias("_rank")))
    return keep_first(both.withColumn("key", key).where("key IS NOT NULL AND key <> ''"), [F.col("key")], [F.col("_rank"), F.col("orden")]).select("key", F.trim(name).alias(name))


def new_keys(found: DataFrame, catalog: DataFrame) -> DataFrame:
    return found.join(catalog.select("key"), "key", "left_anti")


def canonical_names(rows: DataFrame, column: str, catalog: DataFrame, key: Column) -> DataFrame:
    """Rows whose name is spelled unlike the catalog's, with the catalog's as nuevo."""
    names = catalog.select(F.col("key").alias("_key"), F.col("nombre").alias("nuevo"))
    return rows.withColumn("_key", key).join(names, "_key").where(F.col(column) != F.col("nuevo")).drop("_key")


def with_reject_reason(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "motivo") -> DataFrame:
    """The first rule that holds, by name; null for rows that pass."""
    return rows.withColumn(name, F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(label)) for label, rule in rules]))


def insert_notes(listings: DataFrame) -> DataFrame:
    """The note history from the notes of listings: publicacion_id, nota, fecha (the note's date, else the capture)."""
    return listings.where(~is_blank(F.col("notas"))).select(F.col("id").alias("publicacion_id"), F.col("notas").alias("nota"), F.coalesce("fecha_nota", "fecha_captura").alias("fecha"))


def delete_with_reason(listings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log rows (id, motivo and a snapshot) and the listings that stay; write the log first."""
    log = listings.join(ids.select("id", "motivo"), "id").select("id", "motivo", *[F.col(c).alias(f"snapshot_{c}") for c in ("link_origen", "barrio", "precio") if c in listings.columns])
    return log, listings.join(ids.select("id"), "id", "left_anti")


def mark_discarded(edges: DataFrame, ids: list[int], now: str) -> DataFrame:
    hit = F.col("id").isin(ids)
    return edges.withColumns({"estado": F.when(hit, "descartada").otherwise(F.col("estado")), "fecha_revision": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("fecha_revision"))})


def reset_automatic(edges: DataFrame) -> DataFrame:
    """Edges that a rebuild keeps: those that a review has set."""
    return edges.where(F.col("estado") != "pendiente")


def placeholder_links(link: Column, key: Column, note: Column) -> tuple[Column, Column]:
    """Link and note of rows whose link is no URL: a placeholder, and the old link joined to the note. Null links stay."""
    bad = F.coalesce(~link.like("http%"), F.lit(False))
    put = F.concat(F.lit("sin-url:"), key.cast("string"))
    kept = F.concat(F.lit("Link original: "), link)
    merged = F.when(is_blank(note), kept).otherwise(F.concat(note, F.lit("\n"), kept))
    return F.when(bad, put).otherwise(link), F.when(bad, merged).otherwise(note)
