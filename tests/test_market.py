"""Areas by spans and coordinates by a walk, against plain walks over the same texts."""

from __future__ import annotations

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from terrado.extract import areas
from terrado.functions import spans
from terrado.functions.json_walk import json_point


def plain_key(text):
    text = " ".join((text or "").split())
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").upper()


def number(text):
    return float(text.replace(",", "."))


def plain_areas(text):
    """A walk with a cursor over the text: spans used are blanked, passes end at the first lot."""
    key = plain_key(text)

    def named(source, words):
        m = re.search(areas.named_area(words), source)
        return (number(m[1]), m.span()) if m and areas.AREAS[0] <= number(m[1]) <= areas.AREAS[1] else None

    built = named(key, areas.BUILT_WORDS)
    rest = key if not built else key[: built[1][0]] + " " * (built[1][1] - built[1][0]) + key[built[1][1] :]
    lot, sides, sure = named(rest, areas.LOT_WORDS), None, True
    value = lot[0] if lot else None
    if value is None:
        pairs = []
        for pattern in (areas.FRONT_AND_DEPTH, areas.SIDE_BY_SIDE):
            for m in re.finditer(pattern, rest):
                w, h, near = number(m[1]), number(m[2]), rest[max(0, m.start() - 40) : m.end() + 15]
                if not (1 <= w <= 500 and 1 <= h <= 500) or re.search(areas.OTHER_THINGS, near):
                    continue
                if re.search(areas.STRONG_WORDS, near) or "FRENTE" in m[0] or "FONDO" in m[0]:
                    pairs.append((0, w, h))
                elif re.search(areas.WEAK_WORDS, near):
                    pairs.append((1, w, h))
        if pairs:
            weak, *sides = min(pairs, key=lambda p: p[0])
            sure, value = not weak, sides[0] * sides[1]
    if value is None and (other := named(rest, areas.AREA_WORDS)):
        value = other[0]
    if value is None:
        bare = (m for m in re.finditer(areas.BARE_AREA, rest) if not re.search(areas.OTHER_THINGS, rest[max(0, m.start() - 40) : m.start()]))
        value = next((v for v in (number(m[1]) for m in bare) if 5 <= v <= 100_000), None)
    source = "multiple_sources" if built and value is not None else "explicit_built_area" if built else "unknown" if value is None else "lot_dimensions" if sides else "explicit_lot_area"
    confidence = None if not built and value is None else "HIGH" if sure else "MEDIUM"
    return (*(sides or (None, None)), value, built[0] if built else None, source, confidence)


def test_areas_equal_a_walk(spark):
    rng = random.Random(8)
    pieces = [
        "Lote", "terreno de", "área construida:", "área privada", "construidos", "Área total", "metros", "frente", "fondo", "x", "por", "*", "casa", "medidas", "piscina", "closet de", "TV", "m2", "mts2", "m²", "M.2",
        "metros cuadrados", "de", "6", "12", "85,5", "120", "7.25", "600", "3", "1500000", "solar", "habitación", ".", "y una vista al río con árboles",
    ]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += ["Lote 60 x 12", "CASA 7X14X3 lote", "Frente 8 fondo 20 m", "área privada: 85 m2", None, "", "xcama 40 m2", "closet " + "a" * 34 + " 40 m2", "closet " + "a" * 33 + "  40 m2 50 m2 lote 6x12"]
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    made = areas.areas(spark.createDataFrame(rows, "id int, text string, area double")).collect()
    want = {i: plain_areas(t) for i, t, _ in rows}
    assert {r.id: tuple(r)[1:] for r in made} == want
    assert {w[4] for w in want.values()} == {"multiple_sources", "explicit_built_area", "explicit_lot_area", "lot_dimensions", "unknown"}
    assert any(w[5] == "MEDIUM" for w in want.values())


def test_spans_have_their_surroundings(spark):
    text = "ab12cd345ef6"
    row = spark.createDataFrame([(text,)], "t string").select(spans.spans(F.col("t"), "([0-9])([0-9]*)", 3, 2).alias("s"), spans.first_span(F.col("t"), "c(d3)").alias("f"), spans.spans(F.col("t"), "(x)").alias("none")).first()
    assert [(m.before, m.found, m.after, m.groups) for m in row.s] == [("ab", "12", "cd", ["1", "2"]), ("2cd", "345", "ef", ["3", "45"]), ("5ef", "6", "", ["6", ""])]
    assert tuple(row.f) == (5, 3, "d3")
    assert row.none == []


# coordinates -----------------------------------------------------------------------------------


def plain_point(value):
    """A recursive walk: an object's own members, then what is in it."""

    def real(x):
        try:
            return None if isinstance(x, dict | list) else float(str(x).strip().replace(",", "."))
        except ValueError:
            return None

    def pair(lat, lon):
        lat, lon = real(lat), real(lon)
        return (lat, lon) if lat is not None and lon is not None and -5 <= lat <= 15 and -82 <= lon <= -66 else None

    def first(names):
        return next((value[n] for n in names if value.get(n)), None)

    if isinstance(value, dict):
        found = pair(first(("latitude", "latitud", "lat")), first(("longitude", "longitud", "lng", "lon", "long")))
        both = first(("coordinates", "coordenadas"))
        if not found and isinstance(both, list) and len(both) >= 2:
            found = pair(both[1], both[0]) or pair(both[0], both[1])
        if not found and isinstance(both, str) and (m := re.search(r"(-?\d+(?:[\.,]\d+)?)\s*,\s*(-?\d+(?:[\.,]\d+)?)", both)):
            found = pair(m[1], m[2])
        if found:
            return found
    inside = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return next((p for p in map(plain_point, inside) if p), None)


def test_coordinates_equal_a_walk(spark):
    rng = random.Random(9)
    names = ["latitude", "latitud", "lat", "longitude", "lng", "lon", "long", "coordinates", "coordenadas", "a", "b", "año"]

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            return rng.choice([1.25, 4, "2,5", -77.3, "-75", 0, "", None, True, 95, "x", [-77.1, 1.5], [2, -70], "1.1, -71.2", '{"lat":1,"lon":-70}', "[1]"])
        if kind < 0.8:
            return {rng.choice(names): tree(depth - 1) for _ in range(rng.randint(0, 5))}
        return [tree(depth - 1) for _ in range(rng.randint(0, 4))]

    trees = [tree(rng.randint(1, 6)) for _ in range(1500)]
    deep = {"lat": 1, "lon": -70}
    for _ in range(60):
        deep = [{"x": deep}]
    trees.append(deep)
    texts = [json.dumps(t, ensure_ascii=bool(i % 2)) for i, t in enumerate(trees)]
    rows = [*enumerate(texts), (-1, None), (-2, ""), (-3, '{"lat":'), (-4, "lat"), (-5, '  {"lat":1,"lon":-70}\n')]
    made = spark.createDataFrame(rows, "id int, t string").select("id", json_point(F.col("t")).alias("p")).collect()
    want = {i: plain_point(t) for i, t in enumerate(trees)} | {-1: None, -2: None, -3: None, -4: None, -5: (1.0, -70.0)}
    assert {r.id: tuple(r.p) if r.p else None for r in made} == want
    assert sum(w is not None for w in want.values()) > 100
