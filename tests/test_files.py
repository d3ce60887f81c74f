import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from meterloom.plans import hp30
from meterloom.sources import meter_csv, registry, sinks, store
from tests.test_catalog import test_query_equals_its_twin as equals_its_twin

VALUES = [str(k % 5) for k in range(95)] + ["-"]


def write(path, rows, header="head"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return f"file://{path}"


def row(*lead):
    return ";".join([*lead, *VALUES]) + ";"


@pytest.mark.parametrize("name", ["s3_read_files", "s22_pack_files"])
def test_queries_of_files(spark, sf_dir, name):
    equals_its_twin(spark, sf_dir, name)


def test_every_file_has_its_own_layout(spark, tmp_path):
    write(tmp_path / "Juni 2023" / "a.csv", [row("7", "CH1234567", "1-1:1.29.0*255", "05.06.2023", "5000")])
    write(tmp_path / "Mai 2024" / "b.csv", [row("1-1:2.29.0", "06.05.2024", "8", "5001"), row("1-1:2.29.0*255", "06.05.2024", "9", "5001")])
    write(tmp_path / "Mai 2024" / "empty.csv", [])
    files = meter_csv.list_files(spark, f"file://{tmp_path}")
    assert [f.split("/")[-1] for f in files] == ["a.csv", "b.csv", "empty.csv"]
    with pytest.raises(ValueError, match="empty.csv"):
        meter_csv.file_layout(spark, files[2])
    got = {r.mp_id: r for r in meter_csv.read(spark, files[:2]).collect()}
    assert {k: (r.channel, r.date, r.plz, r.meter) for k, r in got.items()} == {"7": ("import", dt.date(2023, 6, 5), "5000", "CH1234567"), "9": ("export", dt.date(2024, 5, 6), "5001", "")}
    assert got["7"].kw[1] == 4.0 and got["9"].kw[95] is None


def test_layouts():
    assert meter_csv.layout(row("7", "CH1234567", "1-1:1.29.0*255", "05.06.2023", "5000")) == {"mp_id": 0, "meter": 1, "obis": 2, "date": 3, "plz": 4}
    assert meter_csv.layout(row("1-1:1.29.0", "05.06.2023", "7")) == {"obis": 0, "date": 1, "mp_id": 2}
    assert meter_csv.layout_names({"obis": 0, "date": 1, "mp_id": 2}, 4)[:5] == ["obis", "date", "mp_id", "x3", "v0"]
    for bad in ("1;2;3", row("7", "8"), row("7", "8", "9"), row("1-1:1.29.0", "05.06.2023", "CH1234567")):
        with pytest.raises(ValueError):
            meter_csv.layout(bad)


def test_guard_stops_files_of_which_nothing_is_kept(spark, tmp_path):
    bad = [row("7", "1-1:9.9.9*255", "05.06.2023", "5000")] * 40
    path = write(tmp_path / "bad.csv", bad)
    with pytest.raises(ValueError, match="none of the first 30 rows.*bad.csv|bad.csv: none of the first 30 rows"):
        meter_csv.read(spark, path, least=30)
    assert meter_csv.read(spark, path, least=41).count() == 0  # too short to judge
    good = write(tmp_path / "good.csv", [*bad[:29], row("7", "1-1:1.29.0*255", "05.06.2023", "5000")])
    meter_csv.convert(spark, [good], f"file://{tmp_path}/store", buckets=4)
    assert [r.mp_id for r in store.read(spark, f"file://{tmp_path}/store", n_buckets=4).collect()] == ["7"]


def test_files_by_first_date(spark, tmp_path):
    files = [write(tmp_path / f"{n}.csv", rows) for n, rows in (("a", [row("7", "x", "02.03.2024")]), ("b", ["no date"]), ("c", [row("7", "x", "31.12.2023")]), ("d", []), ("e", [row("7", "x", "99.99.2020")]))]
    assert [f[-5] for f in meter_csv.chronological(spark, files)] == ["c", "a", "b", "d", "e"]


def test_a_bucket_is_dealt_to_several_tasks(spark, tmp_path):
    days = spark.range(400).select(F.concat(F.lit("house "), (F.col("id") % 40).cast("string")).alias("mp_id"), F.lit("import").alias("channel"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("date"), F.array(*[F.lit(1.0)] * 96).alias("kw"))
    store.write(days, f"file://{tmp_path}/s", buckets=4, pieces=8)
    rows = store.read(spark, f"file://{tmp_path}/s", n_buckets=4).withColumn("file", F.input_file_name())
    assert rows.count() == 400 and rows.select("bucket").distinct().count() == 1 and rows.select("file").distinct().count() > 2
    assert rows.groupBy("mp_id").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()


@pytest.mark.parametrize(("encoding", "found"), [("utf-8-sig", "UTF-8"), ("utf-8", "UTF-8"), ("cp1252", "windows-1252"), ("latin-1", "ISO-8859-1")])
def test_registers_in_any_encoding(spark, tmp_path, encoding, found):
    text = "PLZ;Ort;Kanton;Größe\n5000;Aarau;AG;1\n8000;Zürich;ZH;\n" + ("9000;5 €;SG;x\n" if encoding != "latin-1" else "9000;\x81;SG;x\n")
    (tmp_path / "r.csv").write_bytes(text.encode(encoding))
    path = f"file://{tmp_path}/r.csv"
    assert registry.encoding_of(spark, path) == found
    rows = registry.places(spark, path).collect()
    assert [tuple(r) for r in rows][:2] == [("5000", "Aarau", "AG"), ("8000", "Zürich", "ZH")] and len(rows) == 3
    assert encoding == "latin-1" or rows[2].ort == "5 €"
    assert registry.read(spark, path).columns == ["PLZ", "Ort", "Kanton", "Größe"]


def test_pack_files(spark, tmp_path):
    full = spark.createDataFrame([("1", 1.0, None, None, 5), ("2", None, None, 2.0, 6), ("3", 3.0, None, 4.0, 7)], "mp_id string, a double, b double, c double, n_days int")
    daily = spark.createDataFrame([("1", dt.date(2024, 1, 1), 2.0), ("2", dt.date(2024, 1, 1), 3.0)], "mp_id string, date date, e double")
    at = f"file://{tmp_path}/p"
    sinks.write_pack(full, ["a", "b", "c"], at, hp30.median_fill, daily)
    assert {tuple(r) for r in sinks.read_matrix(spark, at).collect()} == {("1", 1.0, 3.0), ("2", 2.0, 2.0), ("3", 3.0, 4.0)}
    assert {tuple(r) for r in spark.read.json(f"{at}/missing").select("feature", "missing_count", "action").collect()} == {("a", 1, "filled"), ("b", 3, "dropped"), ("c", 1, "filled")}
    assert spark.read.csv(f"{at}/diagnostics", header=True).columns == ["mp_id", "n_days"]
    assert spark.read.csv(f"{at}/daily", header=True).count() == 2 and (tmp_path / "p" / "daily" / "mp_id=1").is_dir()
    with pytest.raises(ValueError, match="a"):
        sinks.write_pack(full.withColumn("a", F.lit(float("inf"))), ["a"], at, hp30.median_fill)


def test_spreadsheet(spark, tmp_path):
    table = spark.createDataFrame([("<1>", 0.5, None), ("2", 1.5, 3)], "mp_id string, score double, n int")
    assert sinks.write_xlsx(table, f"{tmp_path}/t.xlsx", {"score": "a & b"}) == 2
    with zipfile.ZipFile(f"{tmp_path}/t.xlsx") as z:
        assert z.testzip() is None
        sheet, legend = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/sheet2.xml").decode()
    assert 'ref="A1:C3"' in sheet and "frozen" in sheet and "&lt;1&gt;" in sheet and '<c r="B3"><v>1.5</v></c>' in sheet and "colorScale" in sheet
    assert "a &amp; b" in legend
    assert sinks.write_xlsx(table.limit(0), f"{tmp_path}/e.xlsx") == 0


def test_station_files(spark, sf_dir, tmp_path):
    equals_its_twin(spark, sf_dir, "s19_station_files")
    from meterloom.sources import weather_files as wf

    (tmp_path / "a.csv").write_bytes("reference_timestamp;gre000z0;Höhe\n01.01.2024 00:10;1;x\n01.01.2024 00:10;2;x\nno time;3;x\n01.01.2024 00:20;-;x\n".encode("cp1252"))
    got = wf.read_station(spark, [f"file://{tmp_path}/a.csv"], "S").collect()
    assert {(r.t - 1704067200, r.irr, r.temp) for r in got} == {(600, 2.0, None), (1200, None, None)}
    assert wf.read_station(spark, [], "S").columns == ["station", "t", "irr", "temp"]
