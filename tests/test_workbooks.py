"""Workbooks written and read by tasks, whole or as folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from terrado.sources import xlsx


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(xlsx.XlsxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def test_one_workbook_of_several_sheets(session, tmp_path):
    rows = [(i, f"a<{i}>&'\"", None if i % 3 else i / 2, [i]) for i in range(500)]
    first = session.createDataFrame(rows, "id int, t string, x double, l array<int>").repartition(4).orderBy("id")
    path = str(tmp_path / "book.xlsx")
    xlsx.write_workbook({"Ventas": first, "Vacía": session.range(0), "Más": session.range(3).coalesce(1)}, path)
    made = session.read.format("xlsx").option("path", path).load().orderBy("row").collect()
    assert [r.cells for r in made][:3] == [["id", "t", "x", "l"], ["0", "a<0>&'\"", "0.0", "[0]"], ["1", "a<1>&'\"", None, "[1]"]]
    assert len(made) == 501
    assert [[c and c[1] for c in r] for r in xlsx.read_sheet(open(path, "rb").read(), "Vacía")] == [["id"]]
    assert [[c and c[1] for c in r] for r in xlsx.read_sheet(open(path, "rb").read(), "Más")] == [["id"], ["0"], ["1"], ["2"]]
    assert os.listdir(tmp_path) == ["book.xlsx"]
    with pytest.raises(ValueError, match="no sheet"):
        list(xlsx.read_sheet(open(path, "rb").read(), "Otra"))
    xlsx.write_workbook({"Nada": session.range(0)}, path)
    assert len(list(xlsx.read_sheet(open(path, "rb").read(), "Nada"))) == 1


def test_folder_of_workbooks(session, tmp_path):
    path = str(tmp_path / "out")
    frame = xlsx.as_texts(session.range(100).withColumn("t", F.concat(F.lit("ñ"), "id")))
    frame.repartition(3).write.format("xlsx").option("path", path).mode("append").save()
    books = [n for n in os.listdir(path) if n.endswith(".xlsx")]
    assert len(books) == 3
    assert sorted(set(os.listdir(path)) - set(books)) == ["_SUCCESS"]
    read = session.read.format("xlsx").option("path", path).load()
    assert sorted(int(r.cells[0]) for r in read.where("row > 0").collect()) == list(range(100))
    assert read.where("row = 0").count() == 3
    assert {tuple(r.cells) for r in read.where("row <= 0").collect()} == {("id", "t")}
    frame.limit(5).coalesce(1).write.format("xlsx").option("path", path).mode("overwrite").save()
    assert session.read.format("xlsx").option("path", path).load().count() == 6


def test_conditions_on_rows_are_pushed_down():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = xlsx._XlsxReader({"path": "/none"})  # noqa: SLF001
    other = EqualTo(("cells",), 3)
    assert list(reader.pushFilters([GreaterThan(("row",), 4), LessThanOrEqual(("row",), 9), other])) == [other]
    assert (reader.first, reader.last) == (5, 9)


def test_a_failed_write_leaves_nothing(session, tmp_path):
    path = str(tmp_path / "bad")
    boom = session.range(10).repartition(2).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("boom"))).alias("id"))
    with pytest.raises(Exception, match="boom"):
        xlsx.as_texts(boom).write.format("xlsx").option("path", path).mode("append").save()
    assert not os.path.isdir(path) or os.listdir(path) == []
