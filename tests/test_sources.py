from __future__ import annotations

from pyspark.sql import functions as F

from terrado.operators import analytics, curate, phrases
from terrado.sources.catalogs import read_names, read_places
from terrado.streaming import incremental


def test_catalog_files(spark, tmp_path):
    places = tmp_path / "places.tsv"
    places.write_text("Comuna:\tComuna 1\tBarrio:\tVilla Flor\tII\nComuna:\tComuna 2\tBarrio:\tvilla  flor ii\n\nCorregimiento:\tLa Laguna\tVereda:\tSan Luis\nCorregimiento:\tLa Laguna\tVereda:\tOtra\nx\ty\n", encoding="utf-8")
    rows = {(r.key, r.canonical, r.kind, r.parent) for r in read_places(spark, str(places)).collect()}
    assert rows == {("villa flor 2", "Villa Flor II", "barrio", "Comuna 1"), ("la laguna", "La Laguna", "corregimiento", None)}
    names = tmp_path / "names.tsv"
    names.write_text("# lista\n\nTorres de Aquine\n TORRES DE AQUINE \nJardín del Río\n", encoding="utf-8")
    assert [(r.key, r.canonical) for r in read_names(spark, str(names)).orderBy("ord").collect()] == [("torres de aquine", "Torres de Aquine"), ("jardin del rio", "Jardín del Río")]


def test_longest_phrase_wins(spark):
    catalog = spark.createDataFrame([("san juan", 0), ("juan", 1), ("san juan de pasto", 2), ("la paz", 3), ("el sol", 4)], "key string, ord long")
    texts = spark.createDataFrame([(1, "casa en san juan de pasto"), (2, "sanjuan"), (3, "el sol y la paz"), (4, "")], "id long, key string")
    assert {(r.id, r.hit.key) for r in phrases.longest_phrases(texts, catalog).collect()} == {(1, "san juan de pasto"), (3, "la paz")}
    assert {(r.id, r.n) for r in phrases.match_counts(texts, catalog).collect()} == {(1, 1), (2, 0), (3, 2), (4, 0)}


def test_stream_takes_items_once_and_merges_edges(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "edges"
    schema = "publicacion_id long, candidata_id long, puntaje decimal(5,2), estado string"
    edge = lambda rows: spark.createDataFrame(rows, schema)
    one = F.lit(1).cast("decimal(5,2)")
    edge([]).withColumn("puntaje", one).write.parquet(str(out / "0"))
    state = {"n": 0}

    def read():
        return spark.read.schema(schema).parquet(str(out / str(state["n"])))

    def write(df):
        df.write.parquet(str(out / str(state["n"] + 1)))
        state["n"] += 1

    for rows in ([(1, 2, None, "pendiente")], [(1, 2, None, "confirmada"), (3, 4, None, "descartada")], [(3, 4, None, "confirmada")]):
        edge(rows).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        incremental.run_available(stream, str(tmp_path / "check"), incremental.edge_sink(read, write)).awaitTermination(60)
    assert {(r.publicacion_id, r.estado) for r in read().collect()} == {(1, "confirmada"), (3, "descartada")}


def test_monthly_and_counts(spark):
    rows = spark.createDataFrame([("2024-01-31 23:59:59",), ("2024-03-01 00:00:00",), ("2023-01-01 00:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    assert [(str(r.mes), r.n) for r in analytics.monthly(rows, "t", "2024-03-15", 3).orderBy("mes").collect()] == [("2024-01-01", 1), ("2024-02-01", 0), ("2024-03-01", 1)]
    labels = spark.createDataFrame([(1, "b"), (2, None), (3, " "), (4, "a"), (5, "a"), (6, "b")], "i long, l string")
    found = analytics.count_by(labels, analytics.labelled(F.col("l"), "Sin dato"), [F.col("i")]).collect()
    assert [(r["label"], r["count"]) for r in found] == [("b", 2), ("Sin dato", 2), ("a", 2)]


def test_upsert_keeps_reviews(spark):
    schema = "publicacion_id long, candidata_id long, puntaje int, estado string"
    old = spark.createDataFrame([(1, 2, 70, "descartada"), (1, 3, 70, "pendiente"), (9, 9, 1, "confirmada")], schema)
    new = spark.createDataFrame([(1, 2, 90, "confirmada"), (1, 3, 90, "confirmada"), (5, 6, 60, "pendiente")], schema)
    assert {tuple(r) for r in curate.upsert_edges(old, new).collect()} == {(1, 2, 90, "descartada"), (1, 3, 90, "confirmada"), (9, 9, 1, "confirmada"), (5, 6, 60, "pendiente")}
