"""Workbooks (xlsx) as a Spark data source.

Writing: every task streams its rows into a sheet of its own file, with a header, under a hidden name; the commit of the job gives the
files their names and removes what failed tasks left, so readers see a whole export or none. Reading: tasks take ranges of
rows of a sheet and stream it up to the end of theirs; the driver plans by the sheet's stated size, or by counting its
rows as they stream by. All columns are texts, by the header; a declaration gives them types.

Cases: nulls are empty cells, and empty cells are null; numbers and booleans are written as such; times to the minute; arrays joined by
commas; characters that XML lacks are dropped; texts are cut to the 32,767 characters of a cell; more rows than a sheet holds raise; a
frame without rows gives a sheet with a header; an empty header is named by its column (A, B); of equal headers the
later ones get a number; rows that are empty throughout stay.
"""

from __future__ import annotations

import datetime
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a sheet holds at most, and rows that a task reads.
ROWS, TEXT, RANGE = 1_048_576, 32_767, 5_000
_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: The parts of a workbook beside its sheet; style 1 is that of the header.
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets><sheet name={{sheet}} sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/styles.xml": f'<styleSheet xmlns="{_NS}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF2563EB"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/></cellXfs></styleSheet>',
}


def opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def letters(i: int) -> str:
    """A, B, ... of the column with this number from 0."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def number(ref: str) -> int:
    """The column of a cell like AB12, from 0."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch) - 64
    return n - 1


def cell(value, style: str = "") -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c REF t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (datetime.datetime, datetime.date)):
        value = value.strftime("%Y-%m-%d %H:%M" if isinstance(value, datetime.datetime) else "%Y-%m-%d")
    if isinstance(value, (list, tuple)):
        value = ",".join(map(str, value))
    text = str(value)
    if not isinstance(value, str) and re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?", text):
        return f"<c REF><v>{text}</v></c>"
    return f'<c REF t="inlineStr"{style}><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", text)[:TEXT], {chr(13): "&#13;"})}</t></is></c>'


def row(n: int, values, style: str = "") -> bytes:
    cells = (cell(v, style).replace("REF", f'r="{letters(i)}{n}"', 1) for i, v in enumerate(values))
    return f'<row r="{n}">{"".join(cells)}</row>'.encode()


@dataclass
class Part(WriterCommitMessage):
    name: str


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, heads: list[str], options: dict[str, str], overwrite: bool):
        self.path, self.heads, self.overwrite = path, heads, overwrite
        self.sheet = options.get("sheet", "Sheet1")
        self.widths = [w for w in options.get("widths", "").split(",") if w]

    def write(self, iterator: Iterator) -> Part:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name = f"_{uuid.uuid4().hex}.xlsx"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in PARTS.items():
                book.writestr(part, _XML + text.replace("{sheet}", quoteattr(self.sheet[:31])))
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(self.widths, 1))
                view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
                sheet.write(f'{_XML}<worksheet xmlns="{_NS}">{view}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>'.encode())
                sheet.write(row(1, self.heads, ' s="1"'))
                n = 1
                for r in iterator:
                    n += 1
                    if n > ROWS:
                        raise ValueError(f"a sheet has at most {ROWS} rows")
                    sheet.write(row(n, r))
                sheet.write(f'</sheetData><autoFilter ref="A1:{letters(len(self.heads) - 1)}{n}"/></worksheet>'.encode())
        return Part(name)

    def _files(self):
        from pyarrow.fs import FileSelector

        fs, root = opened(self.path)
        return fs, root, [f.base_name for f in fs.get_file_info(FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".xlsx")]

    def commit(self, messages) -> None:
        fs, root, there = self._files()
        done = [m.name for m in messages if m is not None]
        old = [n for n in there if n.startswith("part-")]
        first = 0 if self.overwrite else 1 + max([int(n[5:10]) for n in old], default=-1)
        if self.overwrite:
            for n in old:
                fs.delete_file(f"{root}/{n}")
        for i, n in enumerate(done, first):
            fs.move(f"{root}/{n}", f"{root}/part-{i:05d}.xlsx")
        for n in set(there) - set(old) - set(done):
            fs.delete_file(f"{root}/{n}")

    def abort(self, messages) -> None:
        fs, root, there = self._files()
        for n in there:
            if not n.startswith("part-"):
                fs.delete_file(f"{root}/{n}")


@dataclass
class Rows(InputPartition):
    """Rows of a file, numbered from 1, the header being the first."""

    name: str
    low: int
    high: int


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, width: int, rows: int):
        self.path, self.width, self.rows = path, width, rows

    def partitions(self) -> list[Rows]:
        out = []
        for name in files_of(self.path):
            n = rows_of(name)
            out += [Rows(name, low, min(n, low + self.rows - 1)) for low in range(2, n + 1, self.rows)]
        return out or [Rows("", 0, -1)]

    def read(self, part: Rows) -> Iterator[tuple]:
        if part.name:
            for values in sheet_rows(part.name, part.low, part.high):
                yield tuple((values + [None] * self.width)[: self.width])


def files_of(path: str) -> list[str]:
    """The workbooks in a folder, or the one at path."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = opened(path)
    if fs.get_file_info(root).type == FileType.File:
        return [path]
    names = sorted(f.base_name for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith(".xlsx") and not f.base_name.startswith(("_", ".", "~")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def _sheet(book: zipfile.ZipFile):
    return book.open(min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)))


def rows_of(path: str) -> int:
    """The number of the last row of the first sheet: as it says, or else as they are counted."""
    fs, root = opened(path)
    with fs.open_input_file(root) as f, zipfile.ZipFile(f) as book, _sheet(book) as sheet:
        for _, e in ElementTree.iterparse(sheet, ["start"]):
            tag = e.tag.rpartition("}")[2]
            if tag == "dimension" and (m := re.fullmatch(r"\$?[A-Z]+\$?\d+:\$?[A-Z]+\$?(\d+)", e.get("ref", ""))):
                return int(m[1])
            if tag == "sheetData":
                break
    with fs.open_input_file(root) as f, zipfile.ZipFile(f) as book, _sheet(book) as sheet:
        n, tail = 0, b""
        while chunk := sheet.read(1 << 20):
            text = tail + chunk
            n += len(re.findall(rb"<(?:\w+:)?row[ >/]", text[:-16] if len(text) > 16 else b""))
            tail = text[-16:]
        return n + len(re.findall(rb"<(?:\w+:)?row[ >/]", tail))


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells of some workbooks refer to."""
    out = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{{{_NS}}}si":
                    out.append("".join(t.text or "" for t in e.iter(f"{{{_NS}}}t")))
                    e.clear()
    return out


def sheet_rows(path: str, low: int, high: int) -> Iterator[list[str | None]]:
    """The values of rows low to high, as texts; the sheet is read no further."""
    fs, root = opened(path)
    with fs.open_input_file(root) as f, zipfile.ZipFile(f) as book:
        texts = _texts(book)
        with _sheet(book) as sheet:
            n, parent = 0, None
            for event, e in ElementTree.iterparse(sheet, ["start", "end"]):
                if e.tag == f"{{{_NS}}}sheetData" and event == "start":
                    parent = e
                if e.tag != f"{{{_NS}}}row" or event != "end":
                    continue
                now = int(e.get("r", n + 1))
                while n + 1 < now:  # rows that are empty may be left out
                    n += 1
                    if low <= n <= high:
                        yield []
                n = now
                if low <= n <= high:
                    values: list[str | None] = []
                    for i, c in enumerate(e.iter(f"{{{_NS}}}c")):
                        at = number(c.get("r")) if c.get("r") else i
                        values += [None] * (at + 1 - len(values))
                        kind, v = c.get("t", "n"), c.find(f"{{{_NS}}}v")
                        if kind == "inlineStr":
                            values[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS}}}t")) or None
                        elif v is not None and v.text is not None:
                            values[at] = texts[int(v.text)] or None if kind == "s" else {"0": "false", "1": "true"}.get(v.text, v.text) if kind == "b" else v.text
                    yield values
                parent.clear()
                if n >= high:
                    return


def headers(path: str) -> list[str]:
    first = next(iter(files_of(path)), None)
    values = next(sheet_rows(first, 1, 1), []) if first else []
    out: list[str] = []
    for i, v in enumerate(values):
        name = base = (v or "").strip() or letters(i)
        k = 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        out = StructType()
        for h in headers(self.options["path"]):
            out = out.add(h, "string")
        return out

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], len(schema), int(self.options.get("rows", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], schema.names, self.options, overwrite)


def read_workbook(spark: SparkSession, path: str, rows: int = RANGE) -> DataFrame:
    """The first sheet of a workbook, or of all in a folder, that of the first giving the header; all columns are texts."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").option("rows", rows).load(path)


def write_workbook(frame: DataFrame, path: str, sheet: str = "Sheet1", widths: tuple[int, ...] = (), mode: str = "overwrite") -> None:
    """A workbook for each partition of frame, in a folder."""
    frame.sparkSession.dataSource.register(Workbook)
    frame.write.format("workbook").mode(mode).option("sheet", sheet).option("widths", ",".join(map(str, widths))).save(path)
