import duckdb
import pytest
from pyspark.sql import functions as F

from meterloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each family; the driver compares them all.
CHECKED = ["f2_pv20t_sparse", "a3_sum_meters", "a9_mad", "a27_circular_concentration", "j2_labels_to_houses", "j3_installation_dates", "l6_evaluate_scores", "m2_interpolate", "p6_season_or_all_house", "pu3_sampling_weights", "s7_read_store", "t2_stations_by_distance", "u5_duplicate_keys", "w1_adjacent_days", "w3_equal_bands"]


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf_dir).select(*want.columns).collect()
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert order(got) == order(want.fetchall())


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 130


def test_models_run(spark, sf_dir):
    from meterloom.operators import ml
    from meterloom.queries import models

    rows = models.matrix(spark, sf_dir)
    model = ml.fit(rows, models.FEATURES, trees=10, depth=4)
    assert ml.evaluate(ml.score(model, rows, models.FEATURES)).first().auc > 0.8
    with pytest.raises(ValueError, match="f99"):
        ml.require(rows, ["f1", "f99"])
    for r in rows.limit(3).collect():
        base, parts = ml.contributions(model, r.asDict(), models.FEATURES)
        assert base + sum(parts.values()) == pytest.approx(ml.score(model, rows.where(F.col("mp_id") == r.mp_id), models.FEATURES).first().score, abs=1e-9)
