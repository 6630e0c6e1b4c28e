"""Customer files as people keep them: comma, tab or semicolon separated text, or the first sheet of a workbook (xlsx).

Text files of any size are read in ranges. A first pass tells, for each range and either state at its start (in a quoted
field or not), the state at its end, from the range's quotes alone; put together, these give every range's own state. The
second pass reads each range from its first line end that is not in quotes, so a field with line ends in it stays whole.
The separator is the one that the first line has most of; a byte order mark is left out; quoted fields may hold
separators, line ends and doubled quotes. The header is the first row with two filled cells, and tells which column holds what.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmere.functions.text import fingerprint, uploaded_keys

#: Bytes of a range; of a file's beginning in which its header is looked for.
RANGE, HEAD = 32 << 20, 1 << 20
SEPARATORS = [",", "\t", ";"]
# What a header of each detail holds, and what it doesn't.
FIELDS = {
    "name": (r"(business|company|customer|account|client|^name$|name)", r"(contact|first|last|user)"), "phone": (r"(phone|tel|mobile|cell)", None),
    "address": (r"(street|address|addr)", r"(city|state|zip|e-?mail)"), "city": (r"(city|town)", None), "zip": (r"(zip|postal)", None),
}
ROW = "name string, phone string, address string, city string, zip string"
_SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _bytes(path: str, start: int, end: int) -> bytes:
    store, name = _open(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(end - start)


def separator(first_line: str) -> str:
    return max(SEPARATORS, key=lambda s: (first_line.count(s), -SEPARATORS.index(s)))


def columns_of(header: list[str]) -> dict[str, int]:
    """Which column holds which detail, each column once."""
    used: dict[str, int] = {}
    for field, (has, lacks) in FIELDS.items():
        for i, cell in enumerate(header):
            text = cell.strip().lower()
            if i not in used.values() and re.search(has, text) and not (lacks and re.search(lacks, text)):
                used[field] = i
                break
    return used


def _rows(text: str, sep: str) -> Iterator[list[str]]:
    csv.field_size_limit(1 << 30)
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
        if any(c.strip() for c in row):
            yield row


def ends_quoted(data: bytes, quoted: bool, sep: bytes) -> bool:
    """Whether data, which begins a line of the file (or of a quoted field), ends in a quoted field. Only its quotes are looked at."""
    skip = False
    for m in re.finditer(rb'"', data):
        i = m.start()
        if skip:
            skip = False
        elif quoted:
            skip = data[i + 1 : i + 2] == b'"'  # a doubled quote
            quoted = skip
        else:
            quoted = i == 0 or data[i - 1 : i] in (sep, b"\n", b"\r", b"\xbf")  # \xbf ends a byte order mark
    return quoted


def line_over(data: bytes, sep: bytes) -> int | None:
    """Where the line is over that a quoted field goes on in at the beginning of data; None where data has no such end."""
    quoted, skip = True, False
    for m in re.finditer(rb'["\n\r]', data):
        i, ch = m.start(), m.group()
        if skip:
            skip = False
        elif ch == b'"':
            if quoted:
                skip = data[i + 1 : i + 2] == b'"'
                quoted = skip
            else:
                quoted = data[i - 1 : i] in (sep, b"\n", b"\r")
        elif not quoted:
            return i + 2 if data[i : i + 2] == b"\r\n" else i + 1
    return None


def _ranges(path: str, size: int) -> list[tuple[str, int, int, int]]:
    """(path, start, end, length): ranges of about so many bytes, each but the first right after a line feed."""
    store, name = _open(path)
    length = store.get_file_info(name).size
    edges = [0]
    while edges[-1] < length:
        at, found = edges[-1] + size, -1
        while found < 0 and at < length:
            chunk = _bytes(path, at, min(length, at + (1 << 16)))
            found = chunk.find(b"\n")
            at += found + 1 if found >= 0 else len(chunk)
        edges.append(min(at, length))
    return [(path, x, y, length) for x, y in zip(edges[:-1], edges[1:], strict=True)]


def read_customers(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """(path, line long, name, phone, address, city, zip) of the files' rows below their headers, as texts ("" where a file has no such column).

    line orders a file's rows. A file without a header has no rows; old workbooks (.xls) are an error.
    """
    if old := [p for p in paths if p.lower().endswith(".xls")]:
        raise ValueError(f"save these as .xlsx or .csv: {', '.join(old)}")
    books, texts = [p for p in paths if p.lower().endswith(".xlsx")], [p for p in paths if not p.lower().endswith(".xlsx")]
    return _texts(spark, texts, size).union(_books(spark, books))


_SCHEMA = f"path string, line long, {ROW}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "line", *FIELDS]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * len(FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _texts(spark: SparkSession, paths: list[str], size: int) -> DataFrame:
    heads = {}
    for path in paths:  # what each file's beginning says of it
        store, name = _open(path)
        head = _bytes(path, 0, min(HEAD, store.get_file_info(name).size)).decode("utf-8-sig", "replace")
        sep = separator(re.split(r"\r?\n", head, maxsplit=1)[0])
        at = next(((i, row) for i, row in enumerate(_rows(head, sep)) if sum(bool(c.strip()) for c in row) >= 2), None)
        heads[path] = (sep, *at) if at else None
    rows = [(i, *r) for i, r in enumerate(r for p in paths if heads[p] for r in _ranges(p, size))]
    if not rows:
        return spark.createDataFrame([], _SCHEMA)
    dealt = spark.createDataFrame(rows, "i long, path string, start long, end long, length long").repartition(min(len(rows), 10_000), "i")

    def states(batches):
        for batch in batches:
            for i, path, start, end, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, sep = _bytes(path, start, end), heads[path][0].encode()
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([ends_quoted(data, False, sep)]), pa.array([ends_quoted(data, True, sep)])], ["i", "plain", "quoted"])

    told = {r.i: r for r in dealt.mapInArrow(states, "i long, plain boolean, quoted boolean").collect()}  # a row for each range
    quoted, state = {}, False
    for i, _, start, *_ in rows:
        quoted[i] = state = state and start > 0
        state = told[i].quoted if state else told[i].plain

    def parsed(batches):
        for batch in batches:
            for i, path, start, end, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sep, head_at, header = heads[path]
                a, b = start, end
                if quoted[i]:  # the line before goes on here
                    over = line_over(_bytes(path, start, end), sep.encode())
                    if over is None:
                        continue
                    a += over
                more = 1 << 16
                while end < length and quoted[i + 1]:
                    over = line_over(_bytes(path, end, min(length, end + more)), sep.encode())
                    b = length if over is None else end + over
                    if over is not None or end + more >= length:
                        break
                    more *= 4
                text = _bytes(path, a, b).decode("utf-8-sig" if a == 0 else "utf-8", "replace")
                at, out = columns_of(header), []
                for n, row in enumerate(_rows(text, sep)):
                    if start == 0 and n <= head_at:
                        continue
                    out.append((path, (i << 32) + n, *(row[at[f]] if f in at and at[f] < len(row) else "" for f in FIELDS)))
                    if len(out) == 5000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return dealt.mapInArrow(parsed, _SCHEMA)


def _books(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], _SCHEMA)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = iter(sheet_rows(path))
                header = next((r for r in rows if sum(bool(c.strip()) for c in r) >= 2), None)
                if header is None:
                    continue
                at = columns_of(header)
                out = [(path, n, *(row[at[f]] if f in at and at[f] < len(row) else "" for f in FIELDS)) for n, row in enumerate(rows)]
                for a in range(0, len(out), 5000):
                    yield _batch(out[a : a + 5000])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInArrow(read, _SCHEMA)


def sheet_rows(path: str) -> Iterator[list[str]]:
    """Rows of a workbook's first sheet as texts (at most a million, as a sheet has); blank rows are left out."""
    store, name = _open(path)
    with store.open_input_file(name) as f, zipfile.ZipFile(f) as book:
        files = set(book.namelist())
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f".//{_SHEETS}sheet")
        target = "xl/worksheets/sheet1.xml"
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if "xl/_rels/workbook.xml.rels" in files else ():
            if first is not None and link.get("Id") == first.get(_LINKS):
                to = link.get("Target", "")
                target = to[1:] if to.startswith("/") else f"xl/{to}"
        texts = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEETS}t"))
        shared = [texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEETS}si")] if "xl/sharedStrings.xml" in files else []
        with book.open(target) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != f"{_SHEETS}row":
                    continue
                row: list[str] = []
                for cell in node.iter(f"{_SHEETS}c"):
                    ref = re.match(r"[A-Z]+", cell.get("r", ""))
                    column = _number(ref.group()) if ref else len(row)
                    value = cell.find(f"{_SHEETS}v")
                    text = value.text or "" if value is not None else ""
                    if cell.get("t") == "s":
                        text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
                    elif cell.get("t") == "inlineStr":
                        text = texts(cell)
                    row += [""] * (column + 1 - len(row))
                    row[column] = text
                node.clear()
                if any(c.strip() for c in row):
                    yield row


def _number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def with_keys(customers: DataFrame, salt: str) -> DataFrame:
    """(hash) of the customers' keys, for suppress.leave_out; their address may be one column."""
    keys = uploaded_keys(*(F.col(c) for c in ("name", "phone", "address", "city", "zip")))
    return customers.select(F.explode(keys).alias("key")).select(fingerprint(salt, F.col("key")).alias("hash")).distinct()
