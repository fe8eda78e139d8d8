"""Dashboard and report aggregates: one pass where one is enough, ties by first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrado.functions.numbers import whole_percent
from terrado.functions.text import blank_to_null, is_blank
from terrado.operators.selection import exact_quantile_values

# Upper bounds of the price ranges, with their labels.
PRICE_RANGES = ((100_000_000, "Hasta 100M"), (200_000_000, "100M a 200M"), (400_000_000, "200M a 400M"))
ABOVE, NO_PRICE = "Mas de 400M", "Sin precio"


def labelled(column: Column, fallback: str = "Sin dato") -> Column:
    return F.coalesce(blank_to_null(column), F.lit(fallback))


def count_by(df: DataFrame, label: Column, order: list[Column], most: int | None = None) -> DataFrame:
    """label, count, by count; equal counts by the place (in `order`) where the label first appears."""
    numbered = df.select(label.alias("label"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("at"))
    counts = numbered.groupBy("label").agg(F.count("*").alias("count"), F.min("at").alias("at"))
    out = counts.orderBy(F.desc("count"), "at").select("label", "count")
    return out.limit(most) if most else out


def price_range(price: Column, ranges: tuple[tuple[int, str], ...] = PRICE_RANGES, above: str = ABOVE, none: str = NO_PRICE) -> Column:
    out = F.when(price.isNull(), none)
    for most, label in ranges:
        out = out.when(price <= most, label)
    return out.otherwise(above)


def summary(df: DataFrame, price: str = "precio", unit_price: str = "precio_m2", area: str = "m2", when: str = "fecha_captura") -> DataFrame:
    """One row: n, mean and exact median price, mean price by area, mean area, last capture. Null if no value counts.

    The median is selected first (`selection`), in a few passes over the prices.
    """
    (median,) = exact_quantile_values(df, F.col(price))
    return df.agg(
        F.count("*").alias("n"),
        F.avg(price).alias("precio_promedio"),
        F.lit(median).cast("double").alias("precio_mediano"),
        F.avg(unit_price).alias("precio_m2_promedio"),
        F.avg(area).alias("area_promedio"),
        F.max(when).alias("ultima_captura"),
    )


def quality(df: DataFrame) -> DataFrame:
    """One row: listings with and without neighbourhood, coordinates, area, price by area and notes, with percents."""
    known = {
        "barrio": ~is_blank(F.col("barrio")),
        "coordenadas": ~is_blank(F.col("coordenadas")) | (F.coalesce(F.col("latitud"), F.lit(0)) != 0) & (F.coalesce(F.col("longitud"), F.lit(0)) != 0),
        "area": F.col("m2").isNotNull(),
        "precio_m2": F.col("precio_m2").isNotNull(),
        "notas": ~is_blank(F.col("notas")),
    }
    total = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"con_{k}") for k, c in known.items()])
    return total.select("n", *[x for k in known for x in (F.col(f"con_{k}"), (F.col("n") - F.col(f"con_{k}")).alias(f"sin_{k}"), whole_percent(F.col(f"con_{k}"), F.col("n")).alias(f"pct_{k}"))])


def tone(percent: Column) -> Column:
    return F.when(percent >= 75, "alta").when(percent >= 45, "media").otherwise("baja")


def monthly(df: DataFrame, when: str, now: str, months: int = 6) -> DataFrame:
    """mes (first day), n for the last months up to that of `now`, none left out."""
    spark = df.sparkSession
    last = F.trunc(F.lit(now).cast("date"), "MM")
    calendar = spark.range(1).select(F.explode(F.sequence(F.add_months(last, 1 - months), last, F.expr("interval 1 month"))).alias("mes"))
    first = F.add_months(last, 1 - months)
    recent = df.where((F.col(when) >= first.cast("timestamp_ntz")) & (F.col(when) < F.add_months(last, 1).cast("timestamp_ntz")))
    counts = recent.groupBy(F.trunc(when, "MM").alias("mes")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "mes", "left").select("mes", F.coalesce("n", F.lit(0)).alias("n"))


def recent(df: DataFrame, when: str, now: str, days: int = 7) -> DataFrame:
    """One row: rows of the last days before `now`, later ones included."""
    return df.agg(F.count_if(F.col(when) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")).alias("n"))


def extremes(df: DataFrame, value: str, key: str, columns: list[str]) -> DataFrame:
    """Two rows: the cheapest (of equal ones the first by key) and the dearest (the last)."""
    packed = F.struct(key, value, *columns)
    at = F.struct(value, key)
    one = df.where(F.col(value).isNotNull()).agg(F.min_by(packed, at).alias("lo"), F.max_by(packed, at).alias("hi"))
    rows = one.select(F.explode(F.array(F.struct(F.lit("min").alias("cual"), F.col("lo").alias("r")), F.struct(F.lit("max").alias("cual"), F.col("hi").alias("r")))).alias("x"))
    return rows.where("x.r IS NOT NULL").select("x.cual", "x.r.*")


def status_by_source(df: DataFrame, source: str, status: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each status by source, in one pass."""
    return df.groupBy(source).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values], F.count("*").alias("total"))


def blank_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether each column has blank values."""
    return df.agg(*[F.coalesce(F.bool_or(is_blank(F.col(c))), F.lit(False)).alias(f"{c}_vacio") for c in columns])


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def repeated_names(df: DataFrame, key: Column, group: str) -> DataFrame:
    """Keys that several groups have, or that are short (5 characters at most)."""
    each = df.select(key.alias("key"), F.col(group).alias("g")).where("key IS NOT NULL").groupBy("key").agg(F.countDistinct("g").alias("grupos"))
    return each.select("key", "grupos", (F.length("key") <= 5).alias("corto")).where("grupos > 1 OR corto")


def latest(df: DataFrame, partition: str, order: list[Column]) -> DataFrame:
    """The first row of each partition in an order."""
    place = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def audit(pages: DataFrame, run: str = "corrida") -> DataFrame:
    """One row per crawl: pages, failed and empty ones, links, new and repeated links."""
    ok = F.col("estado") == "ok"
    return pages.groupBy(run).agg(
        F.count("*").alias("paginas"),
        F.count_if(~ok).alias("fallidas"),
        F.count_if(ok & (F.coalesce("links", F.lit(0)) == 0)).alias("vacias"),
        F.sum(F.coalesce("links", F.lit(0))).alias("links"),
        F.sum(F.coalesce("nuevos", F.lit(0))).alias("nuevos"),
        F.sum(F.coalesce("repetidos", F.lit(0))).alias("repetidos"),
    )


def coverage_reasons(pages: DataFrame, run: str = "corrida") -> DataFrame:
    """run, motivos: why a crawl may have missed results, in order; at most 5 failed and 8 empty pages are named."""
    ok = F.col("estado") == "ok"
    failed = F.concat(F.col("pagina").cast("string"), F.lit(" ("), F.coalesce("motivo", F.lit("sin detalle")), F.lit(")"))
    empty = ok & (F.coalesce("links", F.lit(0)) == 0)
    kind = F.when(~ok, "f").when(empty, "e")
    counts = pages.groupBy(run).agg(F.count_if(~ok).alias("f"), F.count_if(empty).alias("e"), F.sum(F.coalesce("repetidos", F.lit(0))).alias("d"))
    told = pages.select(run, kind.alias("kind"), "pagina", F.when(~ok, failed).otherwise(F.col("pagina").cast("string")).alias("v")).where("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(run, "kind").orderBy("pagina", "v"))
    told = told.withColumn("place", place).where("place <= if(kind = 'f', 5, 8)")
    names = told.groupBy(run).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("place", "v")))).alias(f"{k}_named") for k in "fe"])
    named = lambda k: F.array_join(F.transform(f"{k}_named", lambda x: x["v"]), ", ")
    text = F.array(
        F.when(F.col("f") > 0, F.concat(F.col("f").cast("string"), F.lit(" paginas fallidas: "), named("f"))),
        F.when(F.col("e") > 0, F.concat(F.col("e").cast("string"), F.lit(" paginas vacias: "), named("e"))),
        F.when(F.col("d") > 0, F.concat(F.col("d").cast("string"), F.lit(" links repetidos"))),
    )
    return counts.join(names, run, "left").select(run, F.filter(text, lambda x: x.isNotNull()).alias("motivos"))
