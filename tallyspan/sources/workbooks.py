"""Excel workbooks: a scan whose workbooks may have different headers, and a sink that tasks share.

The scan reads each workbook in one task, its first sheet and those that go on with it as a stream of rows; a workbook's columns
are found there by its own headers. Its bytes come in order in short pieces, and as a workbook's list of parts is at its
end, they are put into a temporary file that goes with the task: no workbook is in memory whole. One that lacks a date, narration or money column, or is no
workbook, becomes one row with the problem, so that it is rejected by name and the others are read.

The sink is a Python data source, "workbook". Rows (sheet, row, cells) are range-sorted; every task
writes its rows' XML to a part of its own beside the target, and sends only the part's name. The
commit joins the parts in order into one file under another name and renames it to the target, so
readers see the old file or the new one; an abort removes the parts. A sheet's headers come from the
options, so an empty one has them; a sheet of more than MOST_ROWS rows goes on in a second one. The target's
folder must be one that the driver and all executors share.

Defined results: null cells are blank; characters that XML forbids are left out; an empty
workbook has no rows; a blank header is no column; of equal headers the first counts.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import posixpath
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
CONTENT = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: Rows of a sheet with its headers, as the format allows.
MOST_ROWS = 1_048_576
#: A byte that parts a workbook in pieces, of 256 bytes in the mean where they are packed.
CUT = b"K"
#: Bytes of a workbook that are held before a file is made.
SPOOL_BYTES = 16 << 20
FIELDS = ("date", "description", "reference", "amount", "debit", "credit")
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def continued(book: zipfile.ZipFile) -> list[str]:
    """The parts of a workbook's first sheet and of those that go on with it: named as the sink names
    them, "its name (2)" and so on."""
    parts = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    names = {}
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("/xl", r.get("Target", ""))).lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{NS}}}sheet"):
            names[targets.get(node.get(f"{{{OFFICE}}}id"))] = node.get("name", "")
    first, by_name = parts[0], {said: part for part, said in names.items() if part in parts}
    out = [first]
    while more := by_name.get(f"{names.get(first, '')[:24]} ({len(out) + 1})"):
        out.append(more)
    return out


def sheet_rows(content: bytes | IO[bytes], on: bool = False) -> Iterator[tuple[int, list]]:
    """(row number, cells) of a workbook's first sheet, one after another; blank cells are None. With `on`,
    sheets that go on with it and repeat its headers follow, their rows numbered on."""
    tag = lambda name: f"{{{NS}}}{name}"
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:
                for _, node in ElementTree.iterparse(stream):
                    if node.tag == tag("si"):
                        shared.append("".join(t.text or "" for t in node.iter(tag("t"))))
                        node.clear()

        def rows_in(name: str) -> Iterator[tuple[int, list]]:
            number, data = 0, None
            with book.open(name) as stream:
                for event, node in ElementTree.iterparse(stream, ("start", "end")):
                    if node.tag == tag("sheetData"):
                        data = node
                    if event == "start" or node.tag != tag("row"):
                        continue
                    cells: list = []
                    for cell in node.iter(tag("c")):
                        at = 0
                        for c in re.sub(r"\d", "", cell.get("r", "")):
                            at = at * 26 + ord(c) - 64
                        cells += [None] * (max(at, len(cells) + 1) - len(cells))
                        value = cell.find(tag("v"))
                        text = "".join(t.text or "" for t in cell.iter(tag("t"))) if cell.get("t") == "inlineStr" else None if value is None else value.text
                        cells[max(at, len(cells)) - 1 if at else -1] = shared[int(text)] if cell.get("t") == "s" and text else text
                    number = int(node.get("r", number + 1))
                    yield number, cells
                    if data is not None:
                        data.clear()

        before, headers = 0, None
        for place, name in enumerate(continued(book)[: None if on else 1]):
            rows, last = rows_in(name), before
            if place:
                if (top := next(rows, (0, None)))[1] != headers:
                    return
                before -= top[0]
            for number, cells in rows:
                headers = cells if headers is None else headers
                last = before + number
                yield last, cells
            before = last


ROWS = "file_name string, sheet_row int, date string, description string, reference string, amount string, debit string, credit string, signed boolean, cells array<struct<column:string,value:string,field:string>>, problem string"


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks under path, their cells by field as strings; signed tells whether
    amount counts or debit and credit. A workbook that can't be used is one row with its problem."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("at"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("_metadata.file_size").alias("size"), F.lit(None).cast("binary").alias("piece"))
    pieces = spark.read.option("lineSep", CUT.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("long").alias("size"), F.col("value").cast("binary").alias("piece"))

    def rows_of(name: str, content: IO[bytes]) -> Iterator[tuple]:
        from .sheets import detect_columns

        try:
            rows = sheet_rows(content, on=True)
            headers = [h or "" for h in next(rows, (0, []))[1]]
            at = detect_columns([h for h in headers if h.strip()])
            roles = {header: field for field, header in at.items()}
            for number, cells in rows:
                cells = (cells + [None] * len(headers))[: len(headers)]
                named = {}
                for header, value in zip(headers, cells, strict=True):
                    if header.strip():
                        named.setdefault(header, value)
                kept = [{"column": h, "value": v or "", "field": roles.get(h)} for h, v in named.items()]
                yield (name, number, *(named.get(at[f]) if f in at else None for f in FIELDS), "amount" in at, kept, None)
        except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError) as problem:
            yield (name, None, *[None] * len(FIELDS), None, None, f"{type(problem).__name__}: {problem}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("column", pa.string()), ("value", pa.string()), ("field", pa.string())])
        kinds = [pa.string(), pa.int32(), *[pa.string()] * len(FIELDS), pa.bool_(), pa.list_(struct), pa.string()]
        names, out = [c.split()[0] for c in ROWS.split(", ")], []
        for name, content in workbook_files(batches):
            with content:
                for row in rows_of(name, content):
                    out.append(row)
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    dealt = listed.unionByName(pieces).repartition(max(1, listed.count()), "file").sortWithinPartitions("file", "block", "at")
    return dealt.mapInArrow(read, ROWS)


def workbook_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, IO[bytes]]]:
    """The name and file of each workbook, from its pieces (file, block, at, file_name, size, piece) in order: first
    the one that names it, then what lies between its cuts."""
    name, size, held, first = None, 0, None, True

    def ended() -> Iterator[tuple[str, IO[bytes]]]:
        if held is not None:
            if held.tell() + len(CUT) == size:  # a cut at the end has nothing behind it
                held.write(CUT)
            if held.tell() != size:
                raise OSError(f"{name}: {held.tell()} bytes of {size} were read")
            held.seek(0)
            yield name, held

    for batch in batches:
        for named, length, piece in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
            if piece is None:
                yield from ended()
                name, size, held, first = named, length, tempfile.SpooledTemporaryFile(SPOOL_BYTES), True
                continue
            if not first:
                held.write(CUT)
            held.write(piece)
            first = False
    yield from ended()


def rejected_workbooks(rows: DataFrame) -> DataFrame:
    """file_name and problem of each workbook that could not be used."""
    return rows.where("problem IS NOT NULL").select("file_name", "problem")


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its name and, for each sheet in it, the first row's number and the bytes."""

    path: str | None
    sheets: list[int]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target = re.sub(r"^file:/*", "/", options["path"])
        self.sheets = json.loads(options["sheets"])  # [name, headers] of each
        self.most_rows = int(options.get("rows", MOST_ROWS))
        self.parts = f"{self.target}.parts-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> Part:
        """One file of a line a row for each sheet that the task has rows of, in their order."""
        from pyspark import TaskContext

        task, held, out = TaskContext.get(), [], None
        stem = f"{self.parts}/{task.partitionId():08d}-{task.taskAttemptId()}"
        os.makedirs(self.parts, exist_ok=True)
        for row in rows:
            if not held or held[-1] != row["sheet"]:
                if out:
                    out.close()
                held.append(row["sheet"])
                out = gzip.open(f"{stem}-{row['sheet']}.gz", "wt", compresslevel=1, encoding="utf-8")
            out.write("<row>" + "".join(cell_xml(c) for c in row["cells"]) + "</row>\n")
        if out:
            out.close()
        return Part(stem if held else None, held)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.path)
        held = f"{self.parts}.xlsx"
        try:
            join_workbook(held, self.sheets, {i: [f"{p.path}-{i}.gz" for p in parts if i in p.sheets] for i in range(len(self.sheets))}, self.most_rows)
            os.replace(held, self.target)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        if os.path.exists(f"{self.parts}.xlsx"):
            os.remove(f"{self.parts}.xlsx")


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options))


def cell_xml(cell) -> str:
    if cell is None or cell["text"] is None:
        return "<c/>"
    if cell["number"]:
        return f"<c><v>{cell['text']}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", cell["text"]))}</t></is></c>'


def join_workbook(path: str, sheets: list, parts: dict[int, list[str]], most_rows: int) -> None:
    """One workbook of the sheets' headers and their parts' lines, as a stream."""
    made: list[str] = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        for i, (name, headers) in enumerate(sheets):
            lines = (line for part in parts.get(i, ()) for line in gzip.open(part, "rb"))
            first, more = True, next(lines, None)
            while first or more is not None:
                made.append(name if first else f"{name[:24]} ({sum(m.startswith(name[:24]) for m in made) + 1})")
                with book.open(f"xl/worksheets/sheet{len(made)}.xml", "w", force_zip64=True) as out:
                    head = "".join(cell_xml({"number": False, "text": h}) for h in headers)
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS}"><sheetData><row>{head}</row>\n'.encode())
                    for _ in range(most_rows - 1):
                        if more is None:
                            break
                        out.write(more)
                        more = next(lines, None)
                    out.write(b"</sheetData></worksheet>")
                first = False
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(made, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(made) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELATIONS}">{links}</Relationships>')
        book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{RELATIONS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{CONTENT}.worksheet+xml"/>' for i in range(1, len(made) + 1))
        types = "http://schemas.openxmlformats.org/package/2006/content-types"
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{CONTENT}.sheet.main+xml"/>{kinds}</Types>')


def write_workbook(tabs: dict[str, DataFrame], path: str, order: dict[str, list[str]] | None = None, most_rows: int = MOST_ROWS) -> None:
    """One workbook of a sheet a tab, in order of the columns named for it (or its first two) as they are
    written, whole numbers by size. Dates are ISO, structures JSON; numbers stay numbers."""
    rows, sheets = None, []
    for i, (name, frame) in enumerate(tabs.items()):
        cells = []
        for field in frame.schema.fields:
            kind = field.dataType.typeName()
            text = F.to_json(field.name) if kind in ("array", "struct", "map") else F.col(f"`{field.name}`").cast("string")
            cells.append(F.struct(F.lit(kind in ("decimal", "long", "integer", "double")).alias("number"), text.alias("text")))
        by = (order or {}).get(name, frame.columns[:2])
        whole = {f.name for f in frame.schema.fields if f.dataType.typeName() in ("long", "integer")}
        turn = F.concat_ws("\x1f", *[F.lpad(F.col(f"`{c}`").cast("string"), 20, "0") if c in whole else F.col(f"`{c}`").cast("string") for c in by])
        part = frame.select(F.lit(i).alias("sheet"), turn.alias("turn"), F.array(*cells).alias("cells"))
        rows = part if rows is None else rows.unionByName(part)
        sheets.append([name[:31], frame.columns])
    spark = rows.sparkSession
    spark.dataSource.register(WorkbookSource)
    sorted_rows = rows.repartitionByRange("sheet", "turn").sortWithinPartitions("sheet", "turn").select("sheet", "cells")
    sorted_rows.write.format("workbook").option("path", path).option("sheets", json.dumps(sheets)).option("rows", str(most_rows)).mode("append").save()
