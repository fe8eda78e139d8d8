"""Locations: texts are read once, patterns run only where their words are, and the guards change nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from terrado.functions import text as T
from terrado.operators import location

TEXTS = [
    None, "", "Barrio El Ángel, cerca", "BARRIO Centro", "sector la Aurora y barrio Sur", "ſector norte", "urb. Los Pinos; fin", "urbanización X", "Urbanizacion San Juan",
    "corregimiento de Catambuco", "CORREGİMİENTO de Genoy", "ubıcada en el Morasurco", "Ubicado en la Aurora", "casa en Ipiales", "lote en el Bello Antioquia", "vende en bello", "en bello horizonte",
    "cundinamarca", "cundinamarcas", "municipio de Bogotá", "III etapa II", "Torres i iv XXIII et", "niño i_i ii-i", "casa en", "Medellín ya",
]


def test_guards_change_nothing(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    t = F.col("t")
    key = T._alnum(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), T.PLACE_WORDS, F.lower(T.unaccent(F.coalesce(t, F.lit("")))))) # noqa: SLF001
    spoken = F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(1)) for p in location.PHRASES])
    spoken = F.filter(F.transform(spoken, T.place_text), lambda x: x.isNotNull() & ~x.rlike(location.REFERENCE))
    found = rows.select("t", T.place_key(t).alias("a"), key.alias("b"), location.explicit_places(t).alias("c"), spoken.alias("d")).collect()
    for r in found:
        assert (r.a, r.c) == (r.b, r.d), repr(r.t)
    assert sum(len(r.d) for r in found) > 8


def test_key_of_two_texts_is_their_keys(spark):
    rows = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "a string, b string")
    one = T.place_key(F.concat_ws(" ", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))))
    two = F.concat_ws(" ", F.nullif(T.place_key(F.col("a")), F.lit("")), F.nullif(T.place_key(F.col("b")), F.lit("")))
    assert not rows.where(one != two).count()


def test_texts_are_not_shuffled(spark):
    """What the stages take from the texts is written once; the plan that joins the stages has no text and reads no source."""
    rows = spark.createDataFrame([(1, "Toro bajo", None, "casa en Bogotá", None, None), (2, None, None, "torres de Iguazú, barrio Aquine", None, None), (3, "x", "barrio", "Torobajo", None, "Pasto")], "id long, candidate string, title string, description string, address string, city string")
    places = spark.createDataFrame([("torobajo", "Torobajo", "barrio", 0)], "key string, canonical string, kind string, ord long")
    out = location.resolve_locations(rows, places)
    assert {r.id: (r.value, r.confidence, r.outside) for r in out.collect()} == {1: (None, 100, "Bogota"), 2: ("Torres de Iguazú", 80, None), 3: ("Torobajo", 85, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "description#" not in plan
