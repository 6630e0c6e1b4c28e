"""Exports and backups: CSV, spreadsheets, JSON rows, snapshots and additive restores."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmere.functions.text import clean_controls, guarded_formula
from plotmere.operators.stats import filled_columns

#: Rows that one spreadsheet may have (it is a download for people, made on the driver).
SHEET_ROWS = 1_000_000


def csv_rows(listings: DataFrame, columns: list[str], optional: list[str]) -> DataFrame:
    """The columns to export as guarded text, without optional ones that are empty in every row."""
    kept = set(filled_columns(listings, optional))
    return listings.select(*(guarded_formula(F.col(c).cast("string")).alias(c) for c in columns if c not in optional or c in kept))


def write_csv(listings: DataFrame, path: str, columns: list[str], optional: list[str] = ()) -> None:
    csv_rows(listings, columns, list(optional)).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', encoding="UTF-8")


def xlsx_bytes(listings: DataFrame, columns: list[str], info: dict[str, object] | None = None) -> bytes:
    """A workbook of the rows, and a sheet of labels and values. Raises beyond SHEET_ROWS rows."""
    rows = listings.select(*(clean_controls(F.col(c).cast("string")).alias(c) for c in columns)).limit(SHEET_ROWS + 1)
    table = rows.toArrow().to_pylist()
    if len(table) > SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows; write CSV instead")

    def sheet(lines: list[list[object]], frozen: bool) -> str:
        cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if frozen else ""
        body = "".join(f"<row>{''.join(cell('' if v is None else v) for v in line)}</row>" for line in lines)
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<sheetData>{body}</sheetData></worksheet>'

    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets><sheet name="Listings" sheetId="1" r:id="r1"/><sheet name="Run" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet([columns, *([r[c] for c in columns] for r in table)], True),
        "xl/worksheets/sheet2.xml": sheet([[k, v] for k, v in (info or {}).items()], False),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def json_rows(listings: DataFrame, *columns: str) -> DataFrame:
    return listings.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("row"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as gzipped JSON lines below a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def read_backup(spark: SparkSession, path: str, name: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(f"{path}/{name}")


def restore(current: DataFrame, copy: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """current with the rows of copy whose key it lacks; and one row (in_file, already, added)."""
    once = copy.dropDuplicates(key)
    missing = once.join(current.select(*key).distinct(), key, "left_anti").select(*current.columns)
    counts = once.join(current.select(*key).distinct().withColumn("_has", F.lit(True)), key, "left")
    report = counts.agg(F.count(F.lit(1)).alias("in_file"), F.count_if(F.col("_has")).alias("already"), F.count_if(F.col("_has").isNull()).alias("added"))
    return current.unionByName(missing), report
