"""Each registered query with a DuckDB twin gives the twin's rows."""

import pytest

from tickloom.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, spark, sf, same):
    same(QUERIES[name](spark, sf), SQL[name])


@pytest.mark.parametrize("name", ["kraus_score", "kraus_loss"])
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_period_pipeline_has_all_lengths_predictors_and_classes(spark, sf):
    rows = QUERIES["period_pipeline"](spark, sf).groupBy("predictor", "kind", "length").count().collect()
    assert len({(r.predictor, r.kind, r.length) for r in rows}) == 8 * 4 * 6
