import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterloom.operators import days as dy
from meterloom.operators import labels as lb
from meterloom.plans import ev20, pv
from meterloom.sources import meter_csv, store
from meterloom.streaming import noon

D = dt.date


def profile(base=1.0, **at):
    v = [base] * 96
    for k, x in at.items():
        v[int(k[1:])] = x
    return v


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("1", "import", D(2023, 6, 1), profile(1.0, s3=None)), ("1", "import", D(2023, 6, 1), profile(2.0, s3=None, s4=None)),  # two meters
        ("1", "import", D(2023, 6, 2), profile(1.0, s7=-4.0)), ("1", "export", D(2023, 6, 1), profile(0.01, s50=2.0)),
        ("2", "import", D(2023, 3, 26), profile(1.0)), ("2", "import", D(2023, 10, 29), profile(1.0)), ("2", "import", D(2023, 10, 30), [None] * 96),
    ]
    return spark.createDataFrame(rows, "mp_id string, channel string, date date, kw array<double>")


def test_house_days(raw):
    rows = {(r.mp_id, r.channel, r.date): r for r in dy.house_days(raw).collect()}
    two = rows["1", "import", D(2023, 6, 1)]
    assert two.kw[0] == 3.0 and two.kw[3] is None and two.kw[4] == 1.0 and two.n_neg == 0
    negative = rows["1", "import", D(2023, 6, 2)]
    assert negative.kw[7] == 0.0 and negative.n_neg == 1 and negative.vmax_raw == 1.0
    export = rows["1", "export", D(2023, 6, 1)]
    assert export.kw[0] == 0.0 and export.kw[50] == 2.0 and export.vmax_raw == 2.0
    assert rows["2", "import", D(2023, 10, 30)].vmax_raw == -1.0


def test_strict_and_complete_days(raw):
    rows = {(r.mp_id, r.channel, r.date): r.kw for r in dy.strict_days(raw).collect()}
    assert rows["1", "import", D(2023, 6, 1)][4] is None and rows["1", "import", D(2023, 6, 2)] == [None] * 96
    assert [(r.mp_id, r.channel) for r in dy.complete_days(dy.strict_days(raw)).collect()] == [("1", "export")]  # clock changes drop house 2


def test_noon_windows_and_odd_houses(raw):
    w = {(r.mp_id, r.date): r.win for r in dy.noon_windows(dy.house_days(raw)).collect()}
    assert w["1", D(2023, 6, 1)][:48] == [3.0] * 48 and w["1", D(2023, 6, 1)][55] == 0.0 and w["1", D(2023, 6, 2)][48:] == [None] * 48
    table = {r.mp_id: r for r in pv.pv20t(dy.house_days(raw)).collect()}
    assert table["2"].export_kwh_total == 0 and table["2"].has_export_register == 0 and set(table) == {"1", "2"}
    assert {r.mp_id: r.export_kwh_total for r in pv.pv20s(dy.house_days(raw)).collect()} == {"1": None, "2": None}
    assert ev20.ev20(dy.house_days(raw)).count() == 2 and pv.pv20s(dy.house_days(raw.limit(0))).count() == 0


def line(house, obis, date, values, meter=None):
    return ";".join([house, *([meter] if meter else []), obis, date, "5000", *values]) + ";"


def test_layouts_and_parsing(spark, tmp_path):
    values = [str(k % 5) for k in range(94)] + ["-", " "]
    old, new = line("7", "1-1:1.29.0*255", "05.06.2023", values, "CH1234567"), line(" 8 ", "1-1:2.29.0*255", "31.12.2024", values)
    assert meter_csv.layout(old) == {"mp_id": 0, "meter": 1, "obis": 2, "date": 3, "plz": 4}
    assert meter_csv.layout(new) == {"mp_id": 0, "obis": 1, "date": 2, "plz": 3}
    with pytest.raises(ValueError):
        meter_csv.layout("1;2;3")
    rows = [new, line("9", "1-1:9.9.9*255", "01.01.2024", values), line("9", "1-1:1.29.0*255", "31.02.2024", values), "short;row", line("10", "1-1:1.29.0*255", "01.01.2024", values)]
    path = tmp_path / "Juni 2024.csv"
    path.write_text("\ufeffMP ID;OBIS;Datum;PLZ\n" + "\n".join(rows) + "\n", encoding="utf-8")
    got = {r.mp_id: r for r in meter_csv.read(spark, f"file://{path}").collect()}
    assert set(got) == {"8", "10"} and got["8"].channel == "export" and got["8"].date == D(2024, 12, 31)
    assert got["8"].kw[:3] == [0.0, 4.0, 8.0] and got["8"].kw[94:] == [None, None] and got["8"].plz == "5000"
    only = meter_csv.read(spark, f"file://{path}", houses=spark.createDataFrame([("10",)], "mp_id string"))
    assert [r.mp_id for r in only.collect()] == ["10"]
    assert meter_csv.month_range("Juni 2023") == ("2023-06-01", "2023-07-01") and meter_csv.month_range("Dezember 2023") == ("2023-12-01", "2024-01-01") and meter_csv.month_range("Juni") is None
    assert meter_csv.find_files(["b/Juni.csv", "a/JUNI.csv", "c/Mai.csv"], "juni", 1) == ["a/JUNI.csv"]
    with pytest.raises(FileNotFoundError):
        meter_csv.find_files(["x"], "juni")


def test_store_prunes_buckets(spark, raw, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write(raw.unionByName(raw.limit(1).withColumn("mp_id", F.lit("12.5"))), path, buckets=4)
    rows = store.read(spark, path, houses=["1"], dates=("2023-06-02", "2023-06-03"), n_buckets=4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(mp_id" in plan or "EqualTo(mp_id,1)" in plan
    assert [(r.mp_id, r.date) for r in rows.collect()] == [("1", D(2023, 6, 2))]
    assert [(r.bucket, r.mp_id) for r in store.first_ids(spark.read.parquet(path), 2).collect()] == [(0, "12.5"), (1, "1")]


def test_labels(spark):
    reg = spark.createDataFrame([("1", " X "), ("1", "-"), ("2", None), ("3", "Boiler"), ("4", "-")], "gp string, mark string").withColumn("installed", F.lit("01.02.2020"))
    met = spark.createDataFrame([("1", "m1", "h1"), ("1", "m2", "h2"), ("2", "m3", "h1"), ("3", "m4", "h4"), ("4", "m5", "h5")], "gp string, meter string, mp_id string")
    assert {r.mp_id: r.label for r in lb.house_labels(reg, met).collect()} == {"h1": 1, "h2": 1, "h5": 0}
    assert {r.mp_id for r in lb.house_labels(reg, met, absent_is_negative=False).collect()} == {"h1", "h2"}
    assert {r.mp_id: r.installed for r in lb.installation_dates(reg, met).collect()} == {"h1": D(2020, 2, 1), "h2": D(2020, 2, 1)}
    assert [(r.mark, r.n) for r in lb.unknown_marks(reg).collect()] == [("Boiler", 1)]


def test_noon_stream_equals_batch(spark, raw, tmp_path):
    rows = [("1", D(2023, 6, d), profile(float(d))) for d in (1, 2, 3, 5, 6, 9)] + [("2", D(2023, 6, d), profile(0.5)) for d in (2, 3)] + [("z", D(2023, 7, 30), profile(0.0)), ("z", D(2023, 7, 31), profile(0.0))]
    days = spark.createDataFrame(rows, "mp_id string, date date, kw array<double>").withColumn("channel", F.lit("import"))
    want = {(r.mp_id, r.date): r.win for r in dy.noon_windows(days).collect()}
    src = f"file://{tmp_path}/in"
    out = days.withColumn("ts", F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))
    for k, part in enumerate([rows[:3] + rows[6:7], rows[3:6] + rows[7:8], rows[8:9], rows[9:]]):
        keys = [(r[0], r[1]) for r in part]
        out.where(F.struct("mp_id", "date").isin([F.struct(F.lit(a).alias("mp_id"), F.lit(b).alias("date")) for a, b in keys])).coalesce(1).write.mode("append").parquet(src)
        stream = noon.noon_stream(spark.readStream.schema(out.schema).parquet(src), "1 day")
        q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = {(r.mp_id, r.date): r.win for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    early = {k: v for k, v in want.items() if k[0] != "z"}
    assert {k: v for k, v in got.items() if k[0] != "z"} == early
