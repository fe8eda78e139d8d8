"""Spreadsheet files, read and written with the standard library.

"xlsx" is a Python data source. Read, it gives a row per sheet row with its cells as
texts and a tag for what each cell was, since a text in a number's place counts as
none; written, a folder of workbooks. No row passes the driver either way.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from terrado.sources.tables import shared_dir

#: Rows of a sheet, at most: the format's own limit.
MOST_ROWS = 1_048_576
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _place(reference: str) -> int:
    """Column number, from 0, of a cell reference."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def column_name(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


_MAIN = f"{{{_NS['m']}}}"


def _streamed(part: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end, each forgotten after use, so that a part costs the memory of one of them."""
    around: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            around.append(element)
            continue
        around.pop()
        if element.tag == _MAIN + tag:
            yield element
            around[-1].clear()


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(_MAIN + "t"))


def read_sheet(data: bytes | IO[bytes], sheet: str) -> Iterator[list[tuple[str, str] | None]]:
    """Rows of a sheet: (kind, text) of each cell, kind n or s; None for empty ones. data: a workbook's bytes or an open file that can seek."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in set(book.namelist()):
            with book.open("xl/sharedStrings.xml") as part:
                shared = [_texts(item) for item in _streamed(part, "si")]
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(".//m:sheet", _NS)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = next((s for s in sheets if s.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet {sheet!r}")
        path = targets[found.get(_REL)].lstrip("/")
        with book.open(path if path.startswith("xl/") else f"xl/{path}") as part:
            for row in _streamed(part, "row"):
                cells: list[tuple[str, str] | None] = []
                for c in row.findall("m:c", _NS):
                    at = _place(c.get("r")) if c.get("r") else len(cells)
                    cells.extend([None] * (at + 1 - len(cells)))
                    kind, value = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        text = _texts(c)
                        cells[at] = ("s", text) if text else None
                    elif value is not None and value.text:
                        cells[at] = ("s", shared[int(value.text)]) if kind == "s" else ("s" if kind == "str" else "n", value.text)
                yield cells


class XlsxSource(DataSource):
    """spark.read.format("xlsx").option("path", ...).option("sheet", ...), and df.write.format("xlsx").

    Paths are those of any file system that Arrow opens by its address, the same on
    all executors; where only Spark reaches a store, `read_xlsx` reads. A path is a
    workbook or a folder of workbooks. Written frames become a folder with one
    workbook for each task (more, where a task has more rows than a sheet holds).
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "row int, cells array<string>, kinds array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return _XlsxReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _XlsxWriter(self.options, schema.names, overwrite)


class _XlsxReader(DataSourceReader):
    """A partition for each workbook; conditions on the row number end or begin the reading there."""

    def __init__(self, options: dict) -> None:
        self.path, self.sheet = options["path"], options.get("sheet", "Ventas")
        self.first, self.last = 0, MOST_ROWS

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, int):
                low = f.value + 1 if isinstance(f, GreaterThan) else f.value if isinstance(f, GreaterThanOrEqual | EqualTo) else 0
                high = f.value - 1 if isinstance(f, LessThan) else f.value if isinstance(f, LessThanOrEqual | EqualTo) else MOST_ROWS
                self.first, self.last = max(self.first, low), min(self.last, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = FileSystem.from_uri(self.path)
        if system.get_file_info(path).type == FileType.Directory:
            names = [f.path for f in system.get_file_info(FileSelector(path)) if f.path.endswith(".xlsx") and not f.base_name.startswith(("_", "."))]
            return [InputPartition(name) for name in sorted(names)]
        return [InputPartition(path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = FileSystem.from_uri(self.path)
        with system.open_input_file(partition.value) as f:
            for n, cells in enumerate(islice(read_sheet(f, self.sheet), self.last + 1)):
                if n >= self.first:
                    yield n, [c and c[1] for c in cells], [c and c[0] for c in cells]


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _XlsxWriter(DataSourceWriter):
    """Tasks write workbooks in a folder beside the target's; the driver moves the folder's files when all are done, or deletes them."""

    def __init__(self, options: dict, header: list[str], overwrite: bool) -> None:
        self.address, self.sheet, self.header, self.overwrite = options["path"], options.get("sheet", "Ventas"), header, overwrite
        self.attempt = uuid.uuid4().hex

    def _target(self) -> tuple[FileSystem, str, str]:
        system, path = FileSystem.from_uri(self.address)
        return system, path, f"{path}/_temporary-{self.attempt}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, _, beside = self._target()
        system.create_dir(beside, recursive=True)
        context = TaskContext.get()
        rows, paths = (tuple("" if v is None else str(v) for v in r) for r in iterator), []
        while (first := next(rows, None)) is not None or not paths:
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(paths):03d}.xlsx"
            some = chain([first], islice(rows, MOST_ROWS - 2)) if first is not None else iter(())
            with system.open_output_stream(f"{beside}/{name}") as out:
                write_book(out, [self.sheet], iter([(self.header, some)]))
            paths.append(name)
        return _Written(paths)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        system, path, beside = self._target()
        if self.overwrite:
            for f in system.get_file_info(FileSelector(path)):
                if f.type == FileType.File:
                    system.delete_file(f.path)
        for message in messages:
            for name in message.paths if message else ():
                system.move(f"{beside}/{name}", f"{path}/{name}")
        system.delete_dir(beside)
        system.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        system, _, beside = self._target()
        if system.get_file_info(beside).type == FileType.Directory:
            system.delete_dir(beside)


def read_xlsx(spark: SparkSession, path: str, sheet: str = "Ventas") -> DataFrame:
    """row, cells, kinds of a sheet in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def over(frames):
        import pandas as pd

        for frame in frames:
            for data in frame["content"]:
                rows = list(enumerate(read_sheet(bytes(data), sheet)))
                yield pd.DataFrame({"row": [n for n, _ in rows], "cells": [[c and c[1] for c in r] for _, r in rows], "kinds": [[c and c[0] for c in r] for _, r in rows]})

    return files.mapInPandas(over, "row int, cells array<string>, kinds array<string>")


def as_number(cells: str, kinds: str, index: int) -> Column:
    """A cell as a number: null unless it was one."""
    at = F.lit(index)
    return F.when(F.get(kinds, at) == "n", F.get(cells, at).try_cast("double"))


def map_headers(headers: list[str | None], aliases: dict[str, set[str]], ignored: set[str], key) -> tuple[dict[str, int], list[str]]:
    """Field to column, and headers that no field has. key folds a header."""
    found: dict[str, int] = {}
    unmatched: list[str] = []
    for i, header in enumerate(headers):
        folded = key(header or "")
        if not folded or folded in ignored:
            continue
        field = next((f for f, names in aliases.items() if folded in names), None)
        if field is None:
            unmatched.append(header)
        else:
            found[field] = i
    return found, unmatched


def as_texts(df: DataFrame) -> DataFrame:
    """Every column as the text that an export shows: null as empty, dates in ISO form, structures as JSON."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*out)


def _sheet_xml(header: list[str], rows: Iterator[tuple]) -> Iterator[bytes]:
    """A sheet's XML, a row at a time."""
    yield f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode()
    for n, values in enumerate(chain([header], rows), 1):
        if n > MOST_ROWS:
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
        cells = "".join(f'<c r="{column_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for i, v in enumerate(values))
        yield f'<row r="{n}">{cells}</row>'.encode()
    yield b"</sheetData></worksheet>"


def write_book(out: IO[bytes], names: list[str], sheets: Iterator[tuple[list[str], Iterator[tuple]]]) -> None:
    """A workbook of sheets (header, rows of texts), every cell an inline text, parts stored uncompressed; written from front to back, a row at a time."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}">{links}</Relationships>')
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>{named}</sheets></workbook>')
        for i, (header, rows) in enumerate(sheets, 1):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                for piece in _sheet_xml(header, rows):
                    part.write(piece)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each frame, in their order, at a path of any file system that Arrow opens by its address.

    The rows are made texts in parallel and go, sorted by sheet and place, to one
    task, which writes them as they come under another name; the driver renames the
    file, and sees no row. A sheet holds MOST_ROWS rows at most; more is an error.
    """
    names, headers = list(sheets), [df.columns for df in sheets.values()]
    beside = f"{path}.{uuid.uuid4().hex}"
    cells = None
    for k, df in enumerate(sheets.values()):
        texts = as_texts(df)
        row = texts.select(F.lit(k).alias("sheet"), F.monotonically_increasing_id().alias("place"), F.array(*[F.col(f"`{c}`") for c in texts.columns]).alias("cells"))
        cells = row if cells is None else cells.unionByName(row)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, tuple(c)) for b in batches for s, c in zip(b.column("sheet").to_pylist(), b.column("cells").to_pylist(), strict=True))
        grouped = groupby(rows, key=lambda r: r[0])
        held = next(grouped, None)

        def each() -> Iterator[tuple[list[str], Iterator[tuple]]]:
            nonlocal held
            for k, header in enumerate(headers):
                if held and held[0] == k:
                    yield header, (c for _, c in held[1])
                    held = next(grouped, None)
                else:
                    yield header, iter(())

        system, to = FileSystem.from_uri(beside)
        with system.open_output_stream(to) as out:
            write_book(out, names, each())
        yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

    one = cells.repartition(1).sortWithinPartitions("sheet", "place").drop("place")
    done = one.mapInArrow(write, "done boolean").collect()
    system, to = FileSystem.from_uri(beside)
    if not done:  # no rows at all: Spark starts no task for an empty frame
        with system.open_output_stream(to) as out:
            write_book(out, names, iter([(h, iter(())) for h in headers]))
    system.move(to, FileSystem.from_uri(path)[1])


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """A small workbook's bytes, by way of a file in the shared folder."""
    spark = next(iter(sheets.values())).sparkSession
    path = f"{shared_dir(spark)}/book-{uuid.uuid4().hex}.xlsx"
    write_workbook(sheets, path)
    system, at = FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        data = f.read()
    system.delete_file(at)
    return data
