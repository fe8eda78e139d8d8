"""Tables of the engine as DDL, and their constraints as predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column names and types are the stored format of listing databases.
LISTING = (
    "id long, fuente_id long, codigo_externo string, link_origen string, links_adicionales string, fecha_captura timestamp, "
    "coordenadas string, latitud decimal(10,7), longitud decimal(10,7), direccion string, ciudad string, barrio string, "
    "tipo_inmueble string, ph string, estrato int, descripcion string, precio decimal(15,0), m2 decimal(10,2), precio_m2 decimal(15,0), "
    "m2_construido decimal(10,2), precio_m2_construido decimal(15,0), antiguedad string, pisos int, habitaciones int, banios int, "
    "parqueadero int, administracion decimal(15,0), notas string, fecha_nota timestamp"
)
SOURCE = "id long, nombre string, url string, tipo string, activa boolean"
EVIDENCE = "id long, publicacion_id long, tipo string, ruta_archivo string, url_original string, hash_archivo string, fecha timestamp"
IMAGE_HASH = "id long, evidencia_id long, publicacion_id long, algoritmo string, hash_perceptual string, hash_contenido string, ancho int, alto int"
#: Fields of a reason, with their types: what a signal gave, and what it rests on.
REASON = {"signal": "string", "points": "int", "count": "int", "near_count": "int", "minimum_hash_distance": "int", "meters": "double", "similarity": "double", "difference": "double", "address": "string"}
EDGE = (
    "id long, publicacion_id long, candidata_id long, puntaje decimal(5,2), estado string, distancia_metros decimal(12,2), imagenes_coincidentes int, "
    "distancia_hash_minima int, fecha_deteccion timestamp, fecha_revision timestamp, razones array<struct<" + ",".join(f"`{k}`:{v}" for k, v in REASON.items()) + ">>"
)
CATALOG = "key string, canonical string, kind string, parent string, ord long"
NOTE = "id long, publicacion_id long, nota string, fecha timestamp"


def violations() -> list[tuple[str, Column]]:
    """(reason, predicate that holds for a bad listing), in the order in which they are reported."""
    negative = lambda c: F.col(c) < 0
    return [
        ("precio_no_positivo", F.col("precio") <= 0),
        *((f"{c}_negativo", negative(c)) for c in ("m2", "m2_construido", "habitaciones", "banios", "parqueadero", "administracion")),
        ("link_vacio", F.col("link_origen").isNull()),
    ]


def split_valid(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings that meet every constraint, and the others with a reason. Null values meet the range checks."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in violations()])
    judged = listings.withColumn("motivo", reason)
    return judged.where("motivo IS NULL").drop("motivo"), judged.where("motivo IS NOT NULL")
