"""Keeping listings in order: link status, availability, evidence, groups, forms, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrado.functions.json_walk import json_point
from terrado.functions.text import blank_to_null, strip, type_key, unaccent, upper_key

# Texts (lower case) of a page that asks for a login, and of one whose listing is gone.
LOGIN_TEXTS = ("log in to facebook", "iniciar sesión", "checkpoint")
GONE_TEXTS = ("content isn't available", "contenido no está disponible", "this content isn't available right now", "page not found", "página no encontrada")
# Portals that run on a day of the week (1: Sunday).
SCHEDULE = {2: ("fincaraiz", "ciencuadras", "metrocuadrado", "amorel", "facebook"), 6: ("facebook",)}
# Least width and height of an image that is hashed, and most bytes of one that is uploaded.
LEAST_WIDTH, LEAST_HEIGHT, MOST_BYTES = 200, 150, 15 * 1024 * 1024
# Words that stay in capitals, and spellings that get their ñ back.
CAPITALS, SPELLINGS = ("PH", "VIP", "VIS"), (("Narino", "Nariño"), ("Briceno", "Briceño"))
# Words (of an upper-case key) at which a name ends.
NAME_ENDS = (
    r"\b(?:FSE|CONSTA|CUENTA|VALOR|PRECIO|PASTO|NARINO|INF|INFORMES|UBICAD[OA]|SE\s+VENDE|VENTA|AREA|M2|MTS|HABITACION|HABITACIONES|"
    r"ALCOBAS|BANOS|COCINA|SALA|COMEDOR|PARQUEADERO|GARAJE|NEGOCIABLES|ASCENSOR|PISCINA|CANCHAS|PATIO|ZONA\s+DE\s+LAVANDERIA)\b"
)


def typed_json(document: Column, path: str, kind: str) -> Column:
    """A JSON value, only if it has the type: BOOLEAN or STRING; texts that are no JSON give null."""
    value = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return F.when(F.schema_of_variant(value) == kind, F.try_variant_get(value, "$", kind.lower()))


def link_status(document: Column) -> Column:
    """struct ok, detalle, cuando, manual: a mark by hand (which must say yes or no) wins over the last automatic check."""

    def of(name: str, when: str, manual: bool) -> Column:
        at = f"$.{name}"
        return F.struct(typed_json(document, f"{at}.ok", "BOOLEAN").alias("ok"), typed_json(document, f"{at}.detalle", "STRING").alias("detalle"), typed_json(document, f"{at}.{when}", "STRING").alias("cuando"), F.lit(manual).alias("manual"))

    checked = F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), "$.link_check", "variant")).startswith("OBJECT")
    return F.when(typed_json(document, "$.link_check_manual.ok", "BOOLEAN").isNotNull(), of("link_check_manual", "marcado_en", True)).when(checked, of("link_check", "verificado_en", False))


def availability(url: Column, body: Column) -> Column:
    """struct ok, detalle of a listing's page: unknown behind a login, no if its text says it is gone, else yes."""
    address, text = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    any_of = lambda c, words: F.greatest(*[c.contains(w) for w in words])
    login = any_of(address, ("/login", "/checkpoint")) | any_of(text, LOGIN_TEXTS)
    gone = any_of(text, GONE_TEXTS)
    ok = F.when(login, F.lit(None)).otherwise(~gone).cast("boolean")
    return F.struct(ok.alias("ok"), F.when(login, "sesion_perdida_durante_el_chequeo").when(gone, "contenido_no_disponible").otherwise("contenido_visible").alias("detalle"))


def unchecked_sample(listings: DataFrame, checked: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n listings that no check has seen, at random but the same for the same seed."""
    return listings.join(checked.select("id"), "id", "left_anti").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def snapshot(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """What the audit log keeps of a listing, as texts; a listing without a known source keeps null for it."""
    named = sources.select(F.col("id").alias("fuente_id"), F.col("nombre").alias("snapshot_fuente"))
    columns = {"snapshot_tipo_inmueble": "tipo_inmueble", "snapshot_barrio": "barrio", "snapshot_precio": "precio", "snapshot_link": "link_origen"}
    joined = listings.join(named, "fuente_id", "left")
    return joined.select("id", "snapshot_fuente", *[F.col(c).cast("string").alias(name) for name, c in columns.items()])


def _grouped(number: Column, decimals: int) -> Column:
    return F.translate(F.format_number(number, decimals), ",.", ".,")


def format_cop(value: Column) -> Column:
    """Pesos without decimals, as in Colombia: $ 1.234.567 (with a no-break space); a dash for none."""
    whole = F.round(F.abs(value), 0)
    return F.when(value.isNull() | F.isnan(value.cast("double")), "—").otherwise(F.concat(F.when((value < 0) & (whole > 0), "-").otherwise(""), F.lit("$\u00a0"), _grouped(whole, 0)))


def format_count(value: Column, suffix: str = "") -> Column:
    """At most two decimals, with a comma."""
    text = F.regexp_replace(_grouped(value, 2), ",?0+$", "")
    text = F.when(_grouped(value, 2).endswith(",00"), F.substring_index(_grouped(value, 2), ",", 1)).otherwise(text)
    return F.when(value.isNull() | F.isnan(value.cast("double")), "—").otherwise(F.concat(text, F.lit(suffix)))


def format_moment(value: Column) -> Column:
    """Day, month, year and the time of a twelve-hour clock."""
    half = F.when(F.hour(value) < 12, "a.\u00a0m.").otherwise("p.\u00a0m.")
    return F.when(value.isNull(), "—").otherwise(F.concat(F.date_format(value, "d/MM/y, h:mm"), F.lit("\u202f"), half))


def job_progress(elapsed: Column, estimate: Column) -> Column:
    """Percent of a running job, 2 to 95: it has begun, and is not over."""
    percent = F.floor(elapsed * 100 / estimate + 0.5)
    return F.least(F.lit(95), F.greatest(F.lit(2), percent)).cast("int")


def remaining_seconds(elapsed: Column, estimate: Column) -> Column:
    return F.greatest(F.lit(0), estimate - elapsed)


def due_portals(day: Column) -> Column:
    """The portals that run on a date; empty on other days."""
    out = F.array().cast("array<string>")
    for weekday, portals in SCHEDULE.items():
        out = F.when(F.dayofweek(day) == weekday, F.array(*map(F.lit, portals))).otherwise(out)
    return out


def active(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.coalesce("activo", F.lit(False)))


def by_name(catalog: DataFrame, name: str = "nombre") -> DataFrame:
    """A catalog by name, without regard to case and accents."""
    return catalog.orderBy(F.collate(name, "UNICODE_CI_AI"), name)


def by_lower(values: DataFrame, name: str) -> DataFrame:
    return values.orderBy(F.lower(name), name)


def territorial(url: Column, title: Column, html: Column, place: str = "pasto") -> Column:
    """Whether the address, the title or the page's head names the place as a word of its own."""
    head = F.substring_index(F.coalesce(html, F.lit("")), "</head>", 1)
    return unaccent(F.lower(F.concat_ws(" ", url, title, head))).rlike(rf"\b{place}\b")


def hashable_image(width: Column, height: Column) -> Column:
    return F.coalesce((width >= LEAST_WIDTH) & (height >= LEAST_HEIGHT), F.lit(False))


def evidence_files(spark, path: str, kinds: str = "{png,jpg,jpeg,webp,gif,PNG,JPG,JPEG,WEBP,GIF}") -> DataFrame:  # noqa: ANN001
    """publicacion_id (the name of the folder), name, path, length, uploadable of evidence files below a folder; contents are not read. For pages: kinds="{html,htm}"."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kinds}").option("recursiveFileLookup", "true").load(path).select("path", "length")
    steps = F.split("path", "/")
    folder = F.element_at(F.filter(steps, lambda s: s.rlike("^[0-9]+$")), -1).cast("long")
    return files.select(folder.alias("publicacion_id"), F.element_at(steps, -1).alias("name"), "path", "length", (F.col("length") <= MOST_BYTES).alias("uploadable"))


def with_images(listings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Listings that have evidence of kind image."""
    return listings.join(evidence.where("tipo = 'imagen'").select(F.col("publicacion_id").alias("id")), "id", "left_semi")


def missing_evidence(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming evidence whose listing, kind and path are not stored; once each."""
    keys = ["publicacion_id", "tipo", "ruta"]
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def groups_of_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs (publicacion_id, candidata_id) with grupo_a and grupo_b, the groups that they are in, if any."""
    m = members.select("publicacion_id", "inmueble_id")
    return pairs.join(m.toDF("publicacion_id", "grupo_a"), "publicacion_id", "left").join(m.toDF("candidata_id", "grupo_b"), "candidata_id", "left")


def keep_group_ids(components: DataFrame, members: DataFrame) -> DataFrame:
    """publicacion_id, inmueble_id, previos: components (node, component) under a group id that a member has already.

    The group of the smallest member that has one is kept; the others it
    absorbs are in previos. Without any the component's smallest node names it.
    """
    held = components.select(F.col("node").alias("publicacion_id"), "component").join(members.select("publicacion_id", "inmueble_id"), "publicacion_id", "left")
    first = F.min(F.when(F.col("inmueble_id").isNotNull(), F.struct("publicacion_id", "inmueble_id")))["inmueble_id"]
    kept = held.groupBy("component").agg(F.coalesce(first, F.col("component")).alias("inmueble_id"), F.array_sort(F.collect_set("inmueble_id")).alias("all"))
    kept = kept.withColumn("previos", F.array_remove("all", F.col("inmueble_id"))).drop("all")
    return held.select("publicacion_id", "component").join(kept, "component").select("publicacion_id", "inmueble_id", "previos")


def building_changes(listings: DataFrame, found: DataFrame) -> DataFrame:
    """id, ph_anterior, ph_nuevo where the catalog names another building than the listing has."""
    both = listings.select("id", F.col("ph").alias("ph_anterior")).join(found.select("id", F.col("ph").alias("ph_nuevo")), "id")
    return both.where(F.col("ph_nuevo").isNotNull() & ~F.col("ph_nuevo").eqNullSafe(F.col("ph_anterior")))


def checked_types(rows: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the catalog's name of their type (rows without a type pass), and rows whose type the catalog hasn't."""
    catalog = types.select(type_key(F.col("nombre")).alias("type_key"), F.col("nombre").alias("type_name")).dropDuplicates(["type_key"])
    joined = rows.withColumn("type_key", type_key(F.col("tipo_inmueble"))).join(catalog, "type_key", "left").drop("type_key")
    given = blank_to_null(F.col("tipo_inmueble")).isNotNull()
    bad = given & F.col("type_name").isNull()
    return joined.where(~bad).withColumn("tipo_inmueble", F.col("type_name")).drop("type_name"), joined.where(bad).drop("type_name")


def form_values(rows: DataFrame) -> DataFrame:
    """A form as a listing: empty texts are null, the link is trimmed, and a source of 0 is none."""
    texts = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
    out = rows.withColumns({c: F.nullif(strip(F.col(c)) if c == "link_origen" else F.col(c), F.lit("")) for c in texts})
    return out.withColumn("fuente_id", F.nullif("fuente_id", F.lit(0))) if "fuente_id" in rows.columns else out


def with_notes(listings: DataFrame, notes: DataFrame) -> DataFrame:
    """Listings with the newest of the notes that are not blank (publicacion_id, contenido, fecha_creacion), and its date; of one moment the last by its text."""
    told = notes.where(blank_to_null(F.col("contenido")).isNotNull())
    newest = told.groupBy("publicacion_id").agg(F.max_by(F.struct(strip(F.col("contenido")).alias("nota"), F.col("fecha_creacion").alias("cuando")), F.struct("fecha_creacion", strip(F.col("contenido")))).alias("n"))
    joined = listings.join(newest.select(F.col("publicacion_id").alias("id"), "n"), "id", "left")
    return joined.withColumns({"notas": F.coalesce("n.nota", "notas"), "fecha_nota": F.coalesce("n.cuando", "fecha_nota")}).drop("n")


def overwrite_notes(listings: DataFrame, notes: DataFrame) -> DataFrame:
    """One note for each listing named (id, nota, cuando): a blank one clears the note and its date."""
    given = notes.select("id", F.lit(True).alias("given"), blank_to_null(F.col("nota")).alias("nota"), "cuando")
    joined = listings.join(given, "id", "left")
    new = F.col("given").isNotNull()
    return joined.withColumns({"fecha_nota": F.when(new, F.when(F.col("nota").isNotNull(), F.col("cuando"))).otherwise(F.col("fecha_nota")), "notas": F.when(new, F.col("nota")).otherwise(F.col("notas"))}).drop("given", "nota", "cuando")


def smart_title(text: Column) -> Column:
    """Words with a capital, some all in capitals, without the punctuation around them; null if nothing is left."""
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "^[-_,.;:]+|[-_,.;:]+$", "")), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin(*CAPITALS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), " ")
    for plain, own in SPELLINGS:
        out = F.replace(out, F.lit(plain), F.lit(own))
    return F.nullif(out, F.lit(""))


def clean_name(text: Column) -> Column:
    """A building's or place's name: up to the first word that no name has, letters and digits only, as a title."""
    begun = F.regexp_replace(upper_key(text), r"^[\s\-:]+", "")
    kept = F.element_at(F.split(begun, NAME_ENDS, 2), 1)
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"[^A-Z0-9\s\-]", " "), r"\s+", " "), r"^[ -]+|[ -]+$", "")
    return F.when(F.length(kept) > 1, smart_title(kept))


def stored_links(origin: Column, more: Column) -> Column:
    """Array of label, url: the listing's own link, and the others of an array or of a text's lines; blank ones go, the others keep their number."""
    tidy = lambda c: F.nullif(strip(c), F.lit(""))
    others = F.coalesce(F.from_json(more, "array<string>"), F.split(more, "\r?\n"), F.array().cast("array<string>"))
    item = lambda x, i: F.struct(F.concat(F.lit("Adicional "), (i + 1).cast("string")).alias("label"), tidy(x).alias("url"))
    every = F.concat(F.array(F.struct(F.lit("Origen").alias("label"), tidy(origin).alias("url"))), F.transform(others, item))
    return F.filter(every, lambda x: x["url"].isNotNull())


def json_coordinates(document: Column) -> Column:
    """struct lat, lon: the first plausible pair that an object of a JSON text names, in the text's order (`json_walk.json_point`)."""
    return json_point(document)


def capped_links(links: DataFrame, run: list[str], order: list[Column], most: int = 50) -> DataFrame:
    """The first `most` links of each run: what a portal's run takes at most."""
    place = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    return links.withColumn("place", place).where(F.col("place") <= most).drop("place")


def run_counts(outcomes: DataFrame, run: str = "corrida", outcome: str = "resultado") -> DataFrame:
    """A row for each run: how many listings were new, skipped, left out or failed, and all."""
    of = lambda name: F.count_if(F.col(outcome) == name).alias(name)
    return outcomes.groupBy(run).agg(*map(of, ("nueva", "existente", "omitida", "error")), F.count("*").alias("total"))


def column_faults(rows: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """column, n, share: how many rows have a fault, one row for each named fault, in one pass."""
    counted = rows.agg(F.count("*").alias("all"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in faults.items()])
    each = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("n"), (F.col(f"`{name}`") / F.nullif("all", F.lit(0))).alias("share")) for name in faults])
    return counted.select(F.inline(each))


def quarantined(rows: DataFrame, tried: dict[str, Column]) -> DataFrame:
    """rows with `apartado`: names of the computed columns (of try_ functions) that gave null for them, so that one bad row ends nothing."""
    return rows.withColumns(tried).withColumn("apartado", F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in tried])))
