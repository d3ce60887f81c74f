import pytest
from pyspark.sql import functions as F

from meterloom.llm import common


@pytest.mark.parametrize("total", [10**9, 7 * 10**8, 10**11, 10**13])
def test_rates_of_very_large_tables(spark, total):
    """The drawn share of hashes is wanted / total, however small: read off the threshold itself."""
    text = str(common.sampled(4000, total, F.col("id")))
    cut = max(int(x) for x in "".join(c if c.isdigit() else " " for c in text).split())
    assert abs(cut / 2**63 * total - 4000) < 1


def test_draw_of_a_small_table(spark):
    rows = spark.range(50_000)
    assert rows.where(common.sampled(50_000, 50_000, "id")).count() == 50_000
    assert rows.where(common.sampled(7, 0, "id")).count() == 50_000
    assert abs(rows.where(common.sampled(5000, 50_000, "id")).count() - 5000) < 350


def test_shared_folder_is_asked_of_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Cluster)
