"""Workbooks of sheets (Office Open XML) as a source and a sink.

Files are read in parallel, each by one task within limits on its size, unpacked size, rows and columns. A file that can't be
read, or exceeds a limit, gives one row with ``error`` and doesn't end the job. Cells are text: whole numbers without a
fraction, missing cells null, dates as their serial number.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import partial
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE, MAX_UNPACKED = 20 << 20, 100 << 20
#: Rows of a sheet in the file format, and of a batch.
SHEET_ROWS, BATCH = 1_048_576, 4096
SCHEMA = "path string, sheet string, sheet_no int, row int, cells array<string>, error string"
_ARROW = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


class LimitExceeded(Exception):
    """A sheet has more filled rows or columns than allowed."""


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node) -> str:
    """The text of an item, without phonetic hints."""
    return "".join(t.text or "" for part in node for t in ([part] if _name(part.tag) == "t" else part if _name(part.tag) == "r" else []) if _name(t.tag) == "t")


def _column(reference: str) -> int:
    at = 0
    for letter in reference.rstrip("0123456789"):
        at = at * 26 + ord(letter) - 64
    return at - 1


def _value(cell, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), None
    for part in cell:
        if _name(part.tag) == "v":
            value = part.text
        elif _name(part.tag) == "is":
            return _text(part)
    if value is None or kind in ("str", "e"):
        return value
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    return str(int(float(value))) if float(value).is_integer() and abs(float(value)) < 2**53 else value


def _sheets(package: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Names and members of the sheets, in the order of the workbook."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
    for node in ElementTree.fromstring(package.read("xl/workbook.xml")).iter():
        if _name(node.tag) == "sheet":
            target = targets[next(v for k, v in node.attrib.items() if _name(k) == "id")]
            yield node.get("name"), target[1:] if target.startswith("/") else f"xl/{target}"


def read_rows(data: bytes, max_rows: int, max_columns: int, max_unpacked: int = MAX_UNPACKED) -> Iterator[tuple[str, int, int, list]]:
    """(sheet, number of the sheet, row from 0, cells) of every row up to each sheet's last filled one."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        if sum(m.file_size for m in package.infolist()) > max_unpacked:
            raise LimitExceeded("unpacked size")
        shared = []
        if "xl/sharedStrings.xml" in package.namelist():
            shared = [_text(item) for item in ElementTree.fromstring(package.read("xl/sharedStrings.xml"))]
        for number, (sheet, member) in enumerate(_sheets(package)):
            at = filled = -1
            with package.open(member) as stream:
                for _, node in ElementTree.iterparse(stream):
                    if _name(node.tag) != "row":
                        continue
                    at = int(node.get("r", at + 2)) - 1
                    cells: dict[int, str] = {}
                    place = -1
                    for cell in node:
                        place = _column(cell.get("r")) if cell.get("r") else place + 1
                        if (value := _value(cell, shared)) is not None and value.strip():
                            cells[place] = value
                    node.clear()
                    if not cells:
                        continue
                    if max(cells) >= max_columns or at >= max_rows:
                        raise LimitExceeded("columns" if max(cells) >= max_columns else "rows")
                    yield from ((sheet, number, k, []) for k in range(filled + 1, at))
                    yield sheet, number, at, [cells.get(i) for i in range(max(cells) + 1)]
                    filled = at


def _read(batches, max_rows, max_columns):
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                rows = [(path, *row, None) for row in read_rows(data.as_py(), max_rows, max_columns)]
            except LimitExceeded as error:
                rows = [(path, None, None, None, None, f"too many: {error}")]
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, StopIteration, NotImplementedError, EOFError, OSError) as error:
                rows = [(path, None, None, None, None, f"unreadable: {type(error).__name__}")]
            for k in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[k : k + BATCH], strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_workbooks(spark: SparkSession, path: str, max_rows: int = 200_000, max_columns: int = 200, max_file: int = MAX_FILE) -> DataFrame:
    """All rows of all sheets of the files at ``path``; the content of files over ``max_file`` bytes isn't read."""
    files = spark.read.format("binaryFile").load(path)
    read = files.where(F.col("length") <= max_file).select("path", "content").mapInArrow(partial(_read, max_rows=max_rows, max_columns=max_columns), SCHEMA)
    large = files.where(F.col("length") > max_file).selectExpr("path", "CAST(NULL AS string) sheet", "CAST(NULL AS int) sheet_no", "CAST(NULL AS int) row", "CAST(NULL AS array<string>) cells", "'too many: bytes' error")
    return read.unionAll(large)


def records(rows: DataFrame) -> DataFrame:
    """(path, sheet, row, record): each row below a sheet's first as a map by header; columns without one are dropped.

    Of columns with the same header the last counts.
    """
    heads = rows.where("row = 0").select("path", "sheet", F.transform("cells", lambda t: F.trim(t)).alias("heads"))
    joined = rows.where("row > 0").join(heads, ["path", "sheet"])
    pairs = F.transform("heads", lambda h, i: F.struct(h.alias("key"), F.get("cells", i).alias("value")))
    later = lambda p, i: F.array_position(F.slice("heads", i + 2, F.size("heads")), p["key"]) > 0
    named = F.filter(pairs, lambda p, i: F.coalesce(p["key"] != "", F.lit(False)) & ~later(p, i))
    return joined.select("path", "sheet", "row", F.map_from_entries(named).alias("record"))


def _sheet_xml(rows: Iterable[Iterable]) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    for n, row in enumerate(rows):
        if n >= SHEET_ROWS:
            raise LimitExceeded("rows")
        cells = []
        for value in row:
            if value is None:
                cells.append("<c/>")
            elif isinstance(value, int | float) and not isinstance(value, bool):
                cells.append(f"<c><v>{value}</v></c>")
            else:  # inline text, which is never taken for a formula
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(value)))}</t></is></c>')
        yield f"<row>{''.join(cells)}</row>"
    yield "</sheetData></worksheet>"


def workbook_bytes(sheets: dict[str, Iterable[Iterable]]) -> bytes:
    """A workbook with the given rows for each sheet."""
    out, kind = io.BytesIO(), "application/vnd.openxmlformats-officedocument.spreadsheetml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    count = range(1, len(sheets) + 1)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in count) + "</Types>")
        package.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, name in zip(count, sheets, strict=True))
        package.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        package.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in count) + "</Relationships>")
        for k, rows in zip(count, sheets.values(), strict=True):
            with package.open(f"xl/worksheets/sheet{k}.xml", "w") as member:
                for piece in _sheet_xml(rows):
                    member.write(piece.encode())
    return out.getvalue()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each (small) DataFrame, header first, written to any file system Spark knows.

    Rows pass the driver one partition at a time; the format's own row limit, which is checked, bounds a sheet.
    """
    spark = next(iter(sheets.values())).sparkSession
    data = workbook_bytes({name: (r for part in ([df.columns], df.toLocalIterator()) for r in part) for name, df in sheets.items()})
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
