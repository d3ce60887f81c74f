from meterloom import catalog
from meterloom.queries import models
from tests.test_catalog import test_query_equals_its_twin as equals_its_twin


def test_bagging_reads_every_house(spark, sf_dir):
    rows = models.matrix(spark, sf_dir).collect()
    known = {r.mp_id for r in rows if r.label == 1 and r.mp_id % 3 == 0}
    hidden = {r.mp_id for r in rows if r.label == 1} - known
    got = {r.mp_id for r in catalog.queries()["pu5_bagging"](spark, sf_dir).collect()}
    assert hidden and got == {r.mp_id for r in rows} - known


def test_scores_of_all_houses(spark, sf_dir):
    equals_its_twin(spark, sf_dir, "j16_scores_of_all_houses")
    got = catalog.queries()["j16_scores_of_all_houses"](spark, sf_dir).collect()
    assert {r.mp_id for r in got} == {r.mp_id for r in models.matrix(spark, sf_dir).collect()}
    assert any(r.pv is None for r in got) and any(r.ev is None for r in got)
