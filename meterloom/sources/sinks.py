"""Where results go: rounded text, spreadsheets, and the heat-response pack's files."""

from __future__ import annotations

import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import shared_path

#: Rows of a spreadsheet (a fixed value of the format).
MOST_ROWS = 1_048_575


def write_features(table: DataFrame, path: str, digits: int = 4) -> None:
    """A feature table as CSV with a header, numbers rounded."""
    kinds = {"double", "float"}
    table.select(*[F.round(F.col(f"`{c}`").cast("double") + 1e-9, digits).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in table.dtypes]).write.mode("overwrite").csv(path, header=True)


def write_pack(full: DataFrame, features: list[str], path: str, fill, daily: DataFrame | None = None) -> None:
    """The heat-response pack's files below `path`.

    matrix: mp_id and the features that any house has, filled by fill(table, features); an error if a value is still
    missing or not finite. diagnostics: all other columns. features: the matrix's features in order. missing: for
    each feature that some house lacks, how many do, their share, and whether it was filled or dropped.
    daily: one folder a house, where daily rows are given.
    """
    spark = full.sparkSession
    counts = full.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), F.lit(1))).alias(f) for f in features]).first()
    n = counts["__n"]
    kept = [f for f in features if counts[f] < n]
    matrix = fill(full.select("mp_id", *features), features).select("mp_id", *kept)
    bad = matrix.agg(*[F.count(F.when(F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf")), F.lit(1))).alias(f) for f in kept]).first() if kept else {}
    wrong = [f for f in kept if bad[f]]
    if wrong:
        raise ValueError(f"values are still missing: {', '.join(wrong)}")
    matrix.write.mode("overwrite").csv(f"{path}/matrix", header=True)
    others = [c for c in full.columns if c not in features and c != "mp_id"]
    if others:
        full.select("mp_id", *others).write.mode("overwrite").csv(f"{path}/diagnostics", header=True)
    one = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    one([(i, f) for i, f in enumerate(kept)], "place int, feature string", "features")
    one([(f, counts[f], counts[f] / n, "filled" if f in kept else "dropped") for f in features if counts[f]], "feature string, missing_count long, missing_fraction double, action string", "missing")
    if daily is not None:
        daily.repartition("mp_id").sortWithinPartitions("mp_id", "date").write.mode("overwrite").partitionBy("mp_id").csv(f"{path}/daily", header=True)


def read_matrix(spark, path: str) -> DataFrame:
    """The matrix of write_pack: mp_id and the listed features as numbers."""
    features = [r.feature for r in spark.read.json(f"{path}/features").orderBy("place").collect()]
    rows = spark.read.csv(f"{path}/matrix", header=True)
    return rows.select("mp_id", *[F.col(f"`{f}`").cast("double").alias(f) for f in features])


def round_trip(table: DataFrame, digits: int = 4) -> DataFrame:
    """A feature table as it comes back from its CSV."""
    at = shared_path(table.sparkSession, "features")
    write_features(table, at, digits)
    return table.sparkSession.read.schema(table.schema).csv(at, header=True)


def _cell(column: int, row: int, value) -> str:
    name, k = "", column + 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    at = f'r="{name}{row}"'
    if value is None or value != value:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f"<c {at}><v>{value!r}</v></c>"


def write_xlsx(table: DataFrame, path: str, legend: dict[str, str] | None = None) -> int:
    """A small table as a spreadsheet on the driver's disk: fixed header, filters, a colour scale on numbers, a legend sheet. Returns its rows.

    For tables that one person reads; an error beyond what a sheet can hold.
    """
    rows = table.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a spreadsheet")
    names, kinds = table.columns, dict(table.dtypes)

    def sheet(header, body, extra=("", "")):
        lines = [f'<row r="{i}">{"".join(_cell(j, i, v) for j, v in enumerate(r))}</row>' for i, r in enumerate([header, *body], 1)]
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<sheetData>{"".join(lines)}</sheetData>{extra[0]}{extra[1]}</worksheet>'

    end = _cell(max(0, len(names) - 1), len(rows) + 1, 0).split('"')[1]
    scales = []
    for j, c in enumerate(names):
        if rows and kinds[c] in ("double", "float", "int", "bigint"):
            a, b = (_cell(j, i, 0).split('"')[1] for i in (2, len(rows) + 1))
            scales.append(f'<conditionalFormatting sqref="{a}:{b}"><cfRule type="colorScale" priority="{j + 1}"><colorScale><cfvo type="min"/><cfvo type="max"/><color rgb="FFFFFFFF"/><color rgb="FF63BE7B"/></colorScale></cfRule></conditionalFormatting>')
    sheets = {"features": sheet(names, rows, (f'<autoFilter ref="A1:{end}"/>' if names else "", "".join(scales)))}
    if legend:
        sheets["legend"] = sheet(["column", "meaning"], legend.items())
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in enumerate(sheets, 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{pack}/relationships">{"".join(f"""<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i, _ in enumerate(sheets, 1))}</Relationships>')
        for i, text in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", text)
    return len(rows)
