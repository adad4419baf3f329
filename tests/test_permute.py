import pytest
from pyspark.sql import functions as F

from loomspark.functions.permute import permuted
from loomspark.operators import scoring, split


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 50, 1000, 10_007])
def test_every_place_is_taken_once(spark, n):
    got = [r.p for r in spark.range(n).select(permuted(F.col("id"), n, 7).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    other = [r.p for r in spark.range(n).select(permuted(F.col("id"), n, 8).alias("p")).collect()]
    assert n < 7 or got != other


def test_places_are_spread(spark):
    n = 20_000
    got = [r.p for r in spark.range(n).select(permuted(F.col("id"), n, 3).alias("p")).collect()]
    first = sum(p < n // 10 for p in got[: n // 2])  # of a tenth of the places, half go to the first half
    assert abs(first - n / 20) < 5 * (n / 40) ** 0.5
    near = sum(abs(a - b) < n // 10 for a, b in zip(got, got[1:], strict=False))
    assert abs(near - 0.19 * n) < 0.02 * n


def test_large_ranges_and_bad_numbers(spark):
    n = 10**14 + 7
    x = spark.range(5000).select((F.col("id") * 19_999_999_999).alias("x")).select(permuted(F.col("x"), n, 5).alias("p"))
    got = [r.p for r in x.collect()]
    assert len(set(got)) == 5000 and all(0 <= p < n for p in got) and max(got) > n * 0.99
    with pytest.raises(Exception, match="outside"):
        spark.range(3).select(permuted(F.col("id"), 2, 5)).collect()


def test_batches_and_samples(spark):
    order = scoring.batch_order(spark, 40, 7).collect()
    assert sorted(r.position for r in order) == sorted(r.batch for r in order) == list(range(40))
    rows = spark.range(500).select((F.col("id") * 3).alias("row_id"))
    a, b = ({r.row_id for r in split.exact_sample(rows, 0.1, s).collect()} for s in (1, 2))
    assert len(a) == len(b) == 50 and a != b
