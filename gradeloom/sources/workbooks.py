"""Workbooks of the zipped XML kind (.xlsx) with the standard library: a writer that streams rows and a reader as a table (S3, K4).

Written are numbers, truth values and texts, all texts in full; spreadsheet programs show the first 32,767 characters of a cell. A table of more rows
than a sheet holds goes on in a further sheet, with the header anew, and is read whole again. Of other workbooks the first sheet is read: numbers, texts (shared or in
place, with their control characters), truth values, dates by their format, formulas by their last value, errors as null.
"""

from __future__ import annotations

import datetime
import io
import itertools
import json
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1 << 20
MOST_BYTES = 1 << 30
#: The name under which a workbook tells how many of its sheets, from the first on, are one table, each with the same head.
CONTINUED = "gradeloom_sheets"
# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
BOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
#: Number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML has no way to write, and what looks like the way they are written instead.
_HIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_x[0-9A-Fa-f]{4}_|\r")
_SHOWN = re.compile("_x([0-9A-Fa-f]{4})_")


def column_name(k: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    name = ""
    while k >= 0:
        k, rest = divmod(k, 26)
        name, k = chr(65 + rest) + name, k - 1
    return name


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(value: str) -> str:
    hide = lambda m: f"_x{ord(m[0]):04X}_" if len(m[0]) == 1 else f"_x005F{m[0]}"
    return escape(_HIDDEN.sub(hide, value))


def _cell(reference: str, value) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    value = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


class Writer:
    """Writes rows to a stream as they come."""

    def __init__(self, stream, header: list[str]):
        self.zip, self.header = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), header
        self.sheet, self.sheets = None, 0
        self._open()

    def _open(self) -> None:
        self.sheets += 1
        self.sheet = self.zip.open(f"xl/worksheets/sheet{self.sheets}.xml", "w")
        self.sheet.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.rows = self.size = 0
        self._put(self.header)

    def _close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()

    def _put(self, values: list) -> None:
        self.rows += 1
        cells = "".join(_cell(f"{column_name(k)}{self.rows}", v) for k, v in enumerate(values))
        body = f'<row r="{self.rows}">{cells}</row>'.encode()
        self.sheet.write(body)
        self.size += len(body)

    def row(self, values: list) -> None:
        if self.rows >= MOST_ROWS or self.size >= MOST_BYTES:
            self._close()
            self._open()
        self._put(values)

    def close(self) -> None:
        self._close()
        numbers = range(1, self.sheets + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{SHEET_TYPE}"/>' for k in numbers)
        kinds = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{BOOK_TYPE}"/>{parts}'
        sheets = "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>' for k in numbers)
        links = "".join(f'<Relationship Id="rId{k}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        more = f'<definedNames><definedName name="{CONTINUED}" hidden="1">{self.sheets}</definedName></definedNames>' if self.sheets > 1 else ""
        for name, body in {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{sheets}</sheets>{more}</workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
        }.items():
            self.zip.writestr(name, HEAD + body)
        self.zip.close()


# --- reading


def _plain(text: str) -> str:
    return _SHOWN.sub(lambda m: chr(int(m[1], 16)), text)


def _said(element) -> str:
    """The text of a string item, its phonetic notes left out."""
    tag = f"{{{MAIN}}}"
    runs = [element, *element.findall(f"{tag}r")]
    return _plain("".join(t.text or "" for r in runs for t in r.findall(f"{tag}t")))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, element in ElementTree.iterparse(stream):
            if element.tag == f"{{{MAIN}}}si":
                found.append(_said(element))
                element.clear()
    return found


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{{{MAIN}}}numFmt")}
    is_date = lambda k: k in DATE_FORMATS or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")), re.I))
    styles = root.find(f"{{{MAIN}}}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else []) if is_date(int(x.get("numFmtId", 0)))}


def _sheets(book: zipfile.ZipFile) -> list[str]:
    """The sheets of the first table: the first, and those in which the writer went on."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    told = [n.text or "" for n in root.iter(f"{{{MAIN}}}definedName") if n.get("name") == CONTINUED]
    wanted = [s.get(f"{{{RELATIONS}}}id") for s in root.iter(f"{{{MAIN}}}sheet")][: int(told[0]) if told and told[0].isdigit() else 1]
    links = {link.get("Id"): link.get("Target") for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    if not wanted or any(w not in links for w in wanted):
        raise ValueError("the workbook has no sheet")
    return [links[w].lstrip("/") if links[w].startswith("/") else f"xl/{links[w]}" for w in wanted]


def rows(content: bytes) -> Iterator[list[tuple[str, str] | None]]:
    """The rows of the first sheet; a cell is (kind, text) with kind n, s, b or d, or None."""
    book = zipfile.ZipFile(io.BytesIO(content))
    return _rows(book, _sheets(book)[0], _shared(book), _date_styles(book))


def table_rows(content: bytes) -> Iterator[list[tuple[str, str] | None]]:
    """The rows of the first table: those of the first sheet, and without their heads those of the sheets in which it goes on."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared, dates = _shared(book), _date_styles(book)
    for k, sheet in enumerate(_sheets(book)):
        yield from itertools.islice(_rows(book, sheet, shared, dates), 1 if k else 0, None)


def _rows(book: zipfile.ZipFile, sheet: str, shared: list[str], dates: set[int]) -> Iterator[list[tuple[str, str] | None]]:
    tag = f"{{{MAIN}}}"
    start = datetime.datetime(1899, 12, 30)
    at, holder = 0, None
    with book.open(sheet) as stream:
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                holder = element if element.tag == f"{tag}sheetData" else holder
                continue
            if element.tag != f"{tag}row":
                continue
            number = int(element.get("r") or at + 1)
            for _ in range(at + 1, number):
                yield []
            at, row = number, []
            for cell in element.findall(f"{tag}c"):
                k = column_number(cell.get("r")) if cell.get("r") else len(row)
                row += [None] * (k - len(row))
                kind, value = cell.get("t", "n"), cell.find(f"{tag}v")
                if kind == "inlineStr":
                    found = ("s", _said(cell.find(f"{tag}is")))
                elif value is None or value.text is None or kind == "e":
                    found = None
                elif kind == "s":
                    found = ("s", shared[int(value.text)])
                elif kind == "n" and int(cell.get("s") or 0) in dates:
                    found = ("d", (start + datetime.timedelta(days=float(value.text))).isoformat(" "))
                else:
                    found = ("s" if kind == "str" else kind, _plain(value.text) if kind == "str" else value.text)
                row.append(found)
            yield row
            # A row that is read goes from its sheet too, so no sheet is held.
            (element if holder is None else holder).clear()


#: Where the cells of a column are all of one kind, its type; else it is text.
KINDS = {"b": "boolean", "d": "timestamp"}


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells array<struct<kind, value>>) of each workbook of a path; a workbook is read by one task."""

    def step(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = []
                for n, row in enumerate(table_rows(content.as_py())):
                    found.append((name, n, [None if c is None else {"kind": c[0], "value": c[1]} for c in row]))
                    if len(found) == 1000:
                        yield _batch(found)
                        found = []
                if found:
                    yield _batch(found)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(step, "path string, row long, cells array<struct<kind:string,value:string>>")


def _batch(found: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), kind), strict=True)], names=["path", "row", "cells"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """A workbook as a table: its first row names the columns, which have the type that all their cells have."""
    found = cells(spark, path)
    head = found.filter("row = 0").first()
    if head is None:
        return spark.createDataFrame([], "value string").limit(0)
    names = [c["value"] if c else f"Unnamed: {k}" for k, c in enumerate(head["cells"])]
    seen: dict[str, int] = {}
    for k, n in enumerate(names):  # a name that comes again gets a number
        seen[n] = seen.get(n, -1) + 1
        names[k] = f"{n}.{seen[n]}" if seen[n] else n
    each = found.filter("row > 0").select(F.posexplode("cells").alias("k", "c")).filter("c is not null")
    # A row a column.
    kinds = {r["k"]: r for r in each.groupBy("k").agg(F.collect_set("c.kind").alias("kinds"), F.bool_and(F.col("c.value").rlike(r"^-?[0-9]{1,18}$")).alias("whole")).collect()}
    columns = []
    for k, name in enumerate(names):
        value, told = F.try_element_at("cells", F.lit(k + 1))["value"], kinds.get(k)
        only = told["kinds"][0] if told and len(told["kinds"]) == 1 else None
        if only == "n":
            value = value.cast("long" if told["whole"] else "double")
        elif only == "b":
            value = value.cast("int").cast("boolean")
        elif only in KINDS:
            value = value.cast(KINDS[only])
        columns.append(value.alias(name))
    return found.filter("row > 0").select(*columns)
