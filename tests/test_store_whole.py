import pytest

from meterloom import fixtures as fx
from meterloom.sources import store
from tests.test_catalog import test_query_equals_its_twin as equals_its_twin


def test_store_returns_every_house(spark, sf_dir):
    equals_its_twin(spark, sf_dir, "s13_store_whole_round_trip")


@pytest.mark.parametrize("lost", ["3", "9"])
def test_lost_house_shows(spark, sf_dir, monkeypatch, lost):
    read = store.read
    monkeypatch.setattr(store, "read", lambda *a, **k: read(*a, **k).where(f"mp_id <> '{lost}'"))
    with pytest.raises(AssertionError):
        equals_its_twin(spark, sf_dir, "s13_store_whole_round_trip")


def test_pruned_reading(spark, sf_dir, tmp_path):
    at = str(tmp_path / "store")
    days = fx.meter_days(spark, sf_dir)
    store.write(days, at, buckets=16)
    keys = lambda x: sorted((r.mp_id, r.channel, r.date) for r in x.select("mp_id", "channel", "date").collect())
    whole = keys(days)
    some = {"1", "3", "8"}
    low, high = "2023-05-01", "2023-09-01"
    assert keys(store.read(spark, at, n_buckets=16)) == whole
    assert keys(store.read(spark, at, houses=sorted(some), n_buckets=16)) == [k for k in whole if k[0] in some]
    assert keys(store.read(spark, at, dates=(low, high), n_buckets=16)) == [k for k in whole if low <= str(k[2]) < high]
