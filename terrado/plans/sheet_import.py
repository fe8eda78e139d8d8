"""Spreadsheet rows to listings: fields by header, a gate with reasons, locations and buildings resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrado.functions.numbers import plausible
from terrado.functions.text import blank_to_null, header_key, strip, title_case
from terrado.operators.buildings import building_from_barrio, detect_buildings
from terrado.operators.location import resolve_locations
from terrado.operators.matches import existing

# Headers by field, and headers that no field has.
HEADERS: dict[str, set[str]] = {
    "coordenadas": {"localizacion coordenadas"},
    "tipo_inmueble": {"tipo de inmueble"},
    "concepto": {"concepto"},
    "fecha": {"fecha"},
    "precio": {"precio"},
    "barrio": {"barrio"},
    "ph": {"ph-o especif"},
    "estrato": {"estrato"},
    "estrato_anuncio": {"estrato del anuncio"},
    "m2": {"m2"},
    "m2_construido": {"m2 construidos"},
    "pisos": {"pisos"},
    "habitaciones": {"habitaciones"},
    "banios": {"bano", "banio"},
    "parqueadero": {"parqueadero"},
    "descripcion": {"descripcion"},
    "observacion": {"observacion (antes en esta columna decia valor gastos)", "observacion"},
    "administracion": {"administracion"},
    "avaluo": {"avaluo catastral"},
    "link": {"link"},
    "link2": {"link 2"},
    "link3": {"link 3"},
    "codigo": {"codigo"},
    "fecha_actualizacion": {"fecha actualizacion"},
}
IGNORED = frozenset({
    "unidad territorial", "area de actividad humana", "area morfologica", "ubicacion manzana", "ubicacion supermanzana", "acceso a la via",
    "metraje de frente por metraje de fondo", "material de estructuras", "fecha de construccion", "estado de conservacion", "uso de suelo",
    "nivel sobre o bajo la via", "pendiente", "antiguedad barrio", "1 a 5 estrellas", "fecha no disponible", "no", "precio m2 constru",
})
# Sources by what their links contain, and neighbouring municipalities that stand in the neighbourhood column.
DOMAINS = (("fincaraiz.com.co", "Fincaraiz"), ("metrocuadrado.com", "Metrocuadrado"), ("ciencuadras.com", "Ciencuadras"), ("facebook.com", "Facebook Marketplace"), ("amorelpasto.com", "Amorel"))
NEIGHBOURS = (
    "bogota", "bello", "buesaco", "chachagui", "cundinamarca", "girardot", "imues", "medellin", "mocoa", "ricaurte", "sandona", "taminango",
    "ipiales", "tuquerres", "tumaco", "la union", "consaca", "yacuanquer", "tangua", "popayan", "pitalito", "puerres",
)
NUMBERS = ("precio", "estrato", "estrato_anuncio", "m2", "m2_construido", "pisos", "habitaciones", "banios", "parqueadero", "administracion")


def source_of(link: Column, fallback: str = "Cliente") -> Column:
    """The first source whose domain the link contains."""
    out = F.lit(fallback)
    low = F.lower(link)
    for domain, name in reversed(DOMAINS):
        out = F.when(low.contains(domain), name).otherwise(out)
    return out


def coordinates_of(text: Column) -> Column:
    """struct lat, lon of "lat, lon" with dots or commas for decimals; null unless plausible."""
    pattern = r"(-?\d+(?:[.,]\d+)?)\s*,\s*(-?\d+(?:[.,]\d+)?)"
    part = lambda i: F.replace(F.regexp_extract(text, pattern, i), F.lit(","), F.lit(".")).try_cast("double")
    lat, lon = part(1), part(2)
    return F.when(plausible(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def typed_rows(sheet: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Sheet rows (row, cells, kinds) with a column per field; what is no number in a number's place is null."""
    out = [F.col("row").alias("fila")]
    for field in HEADERS:
        at = columns.get(field)
        cell = F.get("cells", F.lit(at)) if at is not None else F.lit(None).cast("string")
        if field in NUMBERS:
            out.append((F.when(F.get("kinds", F.lit(at)) == "n", cell.try_cast("double")) if at is not None else cell.cast("double")).alias(field))
            out.append((cell.isNotNull() & (cell != "")).alias(f"{field}_dado"))
        else:
            out.append(F.nullif(cell, F.lit("")).alias(field))
    return sheet.select(*out)


def listing_rows(rows: DataFrame, places: DataFrame, buildings: DataFrame, fallback: str = "Cliente") -> DataFrame:
    """Typed rows as listings with skip_reason: sin_precio, then sin_link, then fuera_de_pasto; null for rows to import."""
    folded = header_key(F.coalesce("barrio", F.lit("")))
    first = F.when(F.coalesce(F.col("precio") <= 0, F.lit(True)), "sin_precio").when(F.col("link").isNull(), "sin_link").when(folded.isin(*NEIGHBOURS), "fuera_de_pasto")
    named = building_from_barrio(F.col("barrio"))
    rows = rows.withColumns({"skip": first, "ph_barrio": named}).withColumn("barrio_raw", F.when(F.col("ph_barrio").isNull(), F.col("barrio")))
    nothing = F.lit(None).cast("string")
    asked = rows.where("skip IS NULL").select(F.col("fila").alias("id"), F.col("barrio_raw").alias("candidate"), nothing.alias("title"), F.col("descripcion").alias("description"), nothing.alias("address"), nothing.alias("city"))
    resolved = resolve_locations(asked, places, suggest=False).select(F.col("id").alias("fila"), "value", "accepted", "outside")
    told = detect_buildings(rows.where("skip IS NULL").select(F.col("fila").alias("id"), F.array("descripcion").alias("texts"), nothing.alias("complex_name")), buildings)
    rows = rows.join(resolved, "fila", "left").join(told.select(F.col("id").alias("fila"), F.col("ph").alias("ph_texto")), "fila", "left")
    point = coordinates_of(F.col("coordenadas"))
    whole = lambda c: F.col(c).cast("int")
    from_advert = F.col("estrato_dado") & F.col("estrato").isNull()
    extra = F.struct(
        F.col("link2").alias("link_2"), F.col("link3").alias("link_3"), F.col("concepto").alias("concepto_excel"), F.col("avaluo").alias("avaluo_catastral_excel"),
        F.when(from_advert, F.when(F.col("estrato_anuncio").isNotNull(), "estrato_del_anuncio")).otherwise("estrato").alias("estrato_fuente"),
        F.lit("excel_cliente_estudio_mercado").alias("fuente_importacion"),
    )
    return rows.select(
        "fila",
        F.coalesce("skip", F.when(F.col("outside").isNotNull(), "fuera_de_pasto")).alias("skip_reason"),
        F.col("codigo").alias("codigo_externo"),
        strip(F.col("link")).alias("link_origen"),
        F.to_json(extra).alias("links_adicionales"),
        point["lat"].alias("latitud"),
        point["lon"].alias("longitud"),
        F.lit("Pasto").alias("ciudad"),
        F.when(F.col("accepted"), F.col("value")).otherwise(F.col("barrio_raw")).alias("barrio"),
        title_case(blank_to_null(F.col("tipo_inmueble"))).alias("tipo_inmueble"),
        F.coalesce("ph_barrio", "ph", "ph_texto").alias("ph"),
        F.when(from_advert, whole("estrato_anuncio")).otherwise(whole("estrato")).alias("estrato"),
        "descripcion",
        F.col("precio").cast("decimal(15,0)").alias("precio"),
        F.col("m2").cast("decimal(10,2)").alias("m2"),
        F.col("m2_construido").cast("decimal(10,2)").alias("m2_construido"),
        *[whole(c).alias(c) for c in ("pisos", "habitaciones", "banios", "parqueadero")],
        F.col("administracion").cast("decimal(15,0)").alias("administracion"),
        F.col("observacion").alias("notas"),
        source_of(F.col("link"), fallback).alias("fuente_nombre"),
    )


def to_insert(rows: DataFrame, sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Importable rows that no stored listing has, by link or by source and code; of rows with one link the first."""
    named = rows.where("skip_reason IS NULL").join(sources.select(F.col("id").alias("fuente_id"), F.col("nombre").alias("fuente_nombre")), "fuente_nombre", "left")
    new = existing(named, stored).where("existente_id IS NULL").drop("existente_id")
    first = new.groupBy("link_origen").agg(F.min("fila").alias("fila"))
    return new.join(first.select("fila"), "fila", "left_semi")


def preview(rows: DataFrame) -> DataFrame:
    """skip_reason (importable for rows to import) and fuente_nombre with counts; a preview does not look for stored listings."""
    return rows.groupBy(F.coalesce("skip_reason", F.lit("importable")).alias("motivo"), "fuente_nombre").agg(F.count("*").alias("n"))
