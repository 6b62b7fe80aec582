import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import strings
from sievelight.operators import fits, folds


def _rows(spark, y):
    return spark.createDataFrame([("g", float(i), float(v)) for i, v in enumerate(y)], "k string, x double, y double")


def test_consensus_line_drops_the_outlier(spark):
    y = 2.0 * np.arange(12) + 1
    y[5] += 9
    got = fits.consensus_line(_rows(spark, y), "k", "x", "y", tolerance=1.2).first()
    assert got.n_kept == 11 and got.slope == pytest.approx(2) and got.intercept == pytest.approx(1)


def test_consensus_line_of_three_rows_is_null(spark):
    assert fits.consensus_line(_rows(spark, [1, 2, 3]), "k", "x", "y", tolerance=1.2).first().slope is None


def test_huber_line_equals_numpy(spark):
    x, y = np.arange(20.0), 3 * np.arange(20.0) + np.sin(np.arange(20))
    y[3] += 50
    c = np.polyfit(x, y, 1)
    for _ in range(5):
        r = np.abs(np.polyval(c, x) - y)
        c = np.polyfit(x, y, 1, w=np.minimum(1, 1.5 * (np.median(r) * 1.4826 + 1e-9) / (r + 1e-12)))
    got = fits.huber_line(_rows(spark, y), "k", "x", "y").first()
    assert (got.slope, got.intercept) == pytest.approx(tuple(c), abs=1e-6)


def test_folds(spark):
    df = spark.sql("select array(1, 2, 4, 10, 11) v, cast(array() as array<int>) e")
    near, better = (lambda a, b: b - a <= 2), (lambda b, a: b > a)
    got = df.select(folds.collapse_adjacent(F.col("v"), near, better).alias("c"), folds.collapse_adjacent(F.col("e"), near, better).alias("n"), folds.diverse_top(F.col("v"), 2, lambda a, b: b - a <= 2).alias("t")).first()
    assert got.c == [4, 11] and got.n == [] and got.t == [1, 4]


def test_component_sizes():
    mask = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 1, 1]], bool)
    assert sorted(folds.component_sizes(mask)) == [1, 2, 2, 3]
    assert len(folds.component_sizes(np.zeros((3, 3), bool))) == 0


def test_base32_refuses(spark):
    df = spark.createDataFrame([("00",), ("o0-",), ("01",), ("0U",), ("0000",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(strings.from_base32(F.col("x"), 1)).collect()] == ["00", "00", None, None, None, None, None]
