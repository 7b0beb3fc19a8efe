"""XLSX files as a sink: ``df.write.format("workbook").mode("append").save(path)``.

Each task writes its rows to a file of its own beneath ``_temporary`` while they come (a hundred rows are held, for the columns' widths). When all tasks
are done the files are renamed into the folder; a task that fails deletes its file, and when the write fails nothing stays. Mode ``overwrite``
deletes the folder's earlier workbooks once the new ones are complete.

Text that a spreadsheet would take for a formula gets an apostrophe; null is an empty cell, nested values are JSON, whole numbers of over 15 digits are text.
A file holds ``rows_per_file`` rows at most (the format allows 1,048,576 with the head), a cell 32,767 characters: longer text is cut, as the format asks.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MOST_ROWS, MOST_CHARS, WIDEST = 1_048_575, 32_767, 60
#: Characters that XML can't hold.
ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")
#: The parts of a workbook of one sheet whose first row is bold.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
}


def plain(value) -> str | int | float | bool | None:
    """A cell's value: a number, a truth value, text, or None."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value if abs(value) < 10**15 else str(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, decimal.Decimal):
        return float(value) if len(value.as_tuple().digits) <= 15 else str(value)
    if isinstance(value, (dict, list, tuple)):
        return json.dumps(value, ensure_ascii=False, default=str)
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    text = str(value)
    return "'" + text if text[:1] in ("=", "+", "-", "@", "\t", "\r") else text


def cell(value, style: str = "") -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c{style}><v>{value!r}</v></c>"
    return f'<c{style} t="inlineStr"><is><t xml:space="preserve">{escape(ILLEGAL.sub("", value)[:MOST_CHARS])}</t></is></c>'


def row(cells: list, style: str = "") -> bytes:
    return f"<row>{''.join(cell(c, style) for c in cells)}</row>".encode()


def write_workbook(out, names: list[str], rows: Iterator[list]) -> int:
    """A workbook into a binary stream; returns its number of rows."""
    first = list(islice(rows, 100))
    widths = [min(WIDEST, 2 + max([len(n), *(len(str(r[i])) for r in first if r[i] is not None)])) for i, n in enumerate(names)]
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in PARTS.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">')
            sheet.write("<cols>{}</cols><sheetData>".format("".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))).encode())
            sheet.write(row(names, ' s="1"'))
            for r in chain(first, rows):
                sheet.write(row(r))
                n += 1
            sheet.write(b"</sheetData></worksheet>")
    return n


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    rows: int


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], most: int, overwrite: bool):
        self.path, self.names, self.most, self.overwrite, self.job = path.rstrip("/"), names, most, overwrite, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        if re.match(r"[a-z][a-z0-9+.-]*:", self.path):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def begin(self) -> None:
        """The write's own folder. Tasks don't make it, so one that still runs when the write was given up writes nowhere."""
        store, folder = self._store()
        store.create_dir(f"{folder}/_temporary/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = self._store()
        task = TaskContext.get()
        rows = (r for b in iterator for r in map(list, zip(*([plain(v) for v in c.to_pylist()] for c in b.columns))))
        files: list[tuple[str, str]] = []
        total = 0
        try:
            for head in rows:
                name = f"part-{task.partitionId():05d}-{len(files):03d}-{self.job}.xlsx"
                held = f"{folder}/_temporary/{self.job}/{task.taskAttemptId()}-{name}"
                files.append((held, f"{folder}/{name}"))
                with store.open_output_stream(held) as out:
                    total += write_workbook(out, self.names, chain([head], islice(rows, self.most - 1)))
        except BaseException:
            for held, _ in files:
                if store.get_file_info(held).type == fs.FileType.File:
                    store.delete_file(held)
            raise
        return Written(files, total)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if re.fullmatch(r"part-.*\.xlsx", f.base_name)] if self.overwrite else []
        for m in messages:
            for held, name in m.files if m else ():
                store.move(held, name)
        for f in old:
            store.delete_file(f)
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, folder: str) -> None:
        mine, common = f"{folder}/_temporary/{self.job}", f"{folder}/_temporary"
        for attempt in range(3):  # a task that is being stopped may have begun a file meanwhile
            try:
                for place in (mine, common):
                    if store.get_file_info(place).type == fs.FileType.Directory and (place == mine or not store.get_file_info(fs.FileSelector(common))):
                        store.delete_dir(place)
                return
            except OSError:
                if attempt == 2:
                    raise
                time.sleep(0.5)


class Workbook(DataSource):
    """Options: ``path``; ``rows_per_file``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        most = int(self.options.get("rows_per_file", MOST_ROWS))
        if not 1 <= most <= MOST_ROWS:
            raise ValueError(f"rows_per_file has to be from 1 to {MOST_ROWS}")
        writer = WorkbookWriter(self.options["path"], schema.names, most, overwrite)
        writer.begin()
        return writer


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)


def write_xlsx(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = MOST_ROWS) -> None:
    """The rows as workbooks of a folder, one or more a task."""
    register(df.sparkSession)
    df.write.format("workbook").mode(mode).option("rows_per_file", rows_per_file).save(path)
