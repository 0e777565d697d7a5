"""The whole way from ticks to a report."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tidebook.operators.features import extract_features, model_columns
from tidebook.plans import walk_forward as WF
from tidebook.plans.queries import dense


@pytest.fixture(scope="module")
def rows(spark):
    from tidebook.functions.windows import lead
    from tidebook.sources.cache import written

    df = extract_features(dense(spark, SMALL)).withColumn("ret_0_5s", F.try_divide(lead("mid_price", 6), lead("mid_price", 1)) - 1.0)
    return written(df.where("ret_0_5s is not null"), "rows")


def test_feature_inventory(rows):
    names = model_columns(rows.columns, ("ES",))
    assert len(names) == 127 and not any(n.startswith("ES_") for n in names)
    assert rows.select([F.max(F.col(c).isNull().cast("int")).alias(c) for c in names]).first() == (0,) * 127


def test_report(spark, rows, tmp_path):
    tagged = WF.tagged_folds(rows, 2, 900_000_000)
    parts = {(r.fold, r.split) for r in tagged.select("fold", "split").distinct().collect()}
    assert parts == {(0, "train"), (0, "test"), (1, "train"), (1, "test")}
    scored = WF.predictions(tagged, ["ofi_raw_z180", "obi_L1", "spread_bps"], ["ret_0_5s"], "huber")
    metrics = WF.signal_metrics(scored, least_names=2, overlap={0: 5})
    assert metrics.count() == 2
    portfolio, makers = WF.simulations(scored, {0: 5}, k=2)
    text = WF.report(metrics, portfolio, makers)
    assert "rank_ic_mean" in text and "net_sharpe_mean" in text and "baseline" in text
    days = WF.tagged_days(rows, 3, 2)
    assert days.where("split = 'test'").groupBy("fold").agg(F.countDistinct("date").alias("n")).agg(F.max("n")).first()[0] == 2


def test_command_line():
    from tidebook.__main__ import options

    a = options().parse_args(["--equities", "x", "--cache", "y", "--source", "ES=z", "--stream", "--mm"])
    assert a.stream and a.mm and a.source == ["ES=z"] and a.n_splits == 4
