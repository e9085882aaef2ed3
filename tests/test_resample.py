import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import resample
from lattix.functions.resample import bootstrap_of, bootstrap_quantile, counts, walk


def drawn(n, resamples, seed):
    """How often each row is drawn in each resample, all in one place."""
    out = np.zeros((resamples, n), dtype=int)
    for chunk, own, _ in walk(n, np.full(resamples, n, dtype=np.int64), seed, 0, n):
        for r in range(resamples):
            at = chunk * resample.CHUNK
            out[r, at : at + resample.CHUNK] = counts(n, chunk, r, own[r], seed)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(round(x, 1)), float(rng.normal())) for i, x in enumerate(rng.exponential(9, 9001))] + [(9001, None, 1.0), (9002, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "id long, v double, w double").repartition(5)


@pytest.fixture(params=["true", "false"])
def ranges(spark, request):
    """One partition, or several that end within chunks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_against_whole_resamples(spark, table, ranges):
    values = np.sort([r.v for r in table.where("v is not null and not isnan(v)").collect()])
    whole = drawn(9001, 60, 5)
    assert (whole.sum(axis=1) == 9001).all()
    for q in (0.5, 0.13, 0.0, 1.0):
        got = bootstrap_quantile(table, "id", "v", q, resamples=60, seed=5).first()
        own = [np.quantile(np.repeat(values, c), q) for c in whole]
        assert np.allclose([got.estimate, got.low, got.high], [np.quantile(values, q), np.quantile(own, 0.025), np.quantile(own, 0.975)], atol=1e-9) and got.n == 9001


def test_functions_of_sums_against_whole_resamples(spark, table, ranges):
    got = bootstrap_of(table, "id", {"a": F.col("v"), "b": F.col("w") * F.col("w"), "clash": F.col("id")}, F.col("a") / F.col("b") + F.col("n"), resamples=40, seed=2, level=0.8).first()
    values = np.array([(r.v, r.w**2) for r in table.where("v is not null and not isnan(v)").orderBy("id").collect()])
    sums = drawn(9001, 40, 2) @ values
    own = sums[:, 0] / sums[:, 1] + 9001
    assert np.allclose([got.estimate, got.low, got.high], [values[:, 0].sum() / values[:, 1].sum() + 9001, np.quantile(own, 0.1), np.quantile(own, 0.9)])


def test_draws_are_those_of_resampling(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 7)
    whole = drawn(40, 4000, 1)
    assert (whole.sum(axis=1) == 40).all() and abs(whole.mean(axis=0) - 1).max() < 0.08 and abs(whole.var(axis=0) - 39 / 40).max() < 0.12
    assert abs(np.corrcoef(whole.T)[np.triu_indices(40, 1)] + 1 / 39).max() < 0.08


def test_edges(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert tuple(bootstrap_quantile(df, "id", "v", resamples=9).first()) == (2.0, 2.0, 2.0, 1)
    for none in (df.limit(0), df.withColumn("v", F.lit(None).cast("double"))):
        assert tuple(bootstrap_quantile(none, "id", "v", resamples=9).first()) == (None, None, None, 0)
        assert tuple(bootstrap_of(none, "id", {"a": F.col("v")}, F.col("a"), resamples=9).first()) == (None, None, None, 0)
    with pytest.raises(ValueError):
        bootstrap_quantile(df, "id", "v", level=95)
