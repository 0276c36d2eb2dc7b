"""Work that is slow by the row is dealt to tasks by rows, however small the file is; values at several points equal those at each."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import puzzles
from sparkloom.plans import catalog

ROWS = 25_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One small file a table, with more rows than a task should take."""
    path, i = str(tmp_path_factory.mktemp("tables")), F.col("id")
    ids = spark.range(ROWS).coalesce(1)
    ids.select(i.alias("c_custkey"), (i % 25).cast("int").alias("c_nationkey")).write.parquet(f"{path}/customer.parquet")
    ids.select(i.alias("p_partkey"), (i % 50 + 1).cast("int").alias("p_size"), (i / 100 + 1).alias("p_retailprice")).write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["equivalent_answers", "answer_forms", "linear_answers", "rewritten_prices", "transformed_records"])
def test_rows_are_dealt_to_tasks(spark, folder, name):
    assert catalog.queries()[name](spark, folder).rdd.getNumPartitions() == 3


def test_values_at_several_points():
    letters = {"x": [Fraction(1, 2), Fraction(-3), Fraction(0)], "y": [Fraction(2), Fraction(5), Fraction(7, 3)]}
    for text in ("2(x + 1)^2/y - \\frac{x}{3}", "y^-2 + 1/4", "1.5x - 1,000"):
        found = puzzles.values_at(text, letters, 3)
        assert [Fraction(*v) for v in found] == [puzzles.value_at(text, {n: at[k] for n, at in letters.items()}) for k in range(3)]
    assert puzzles.values_at("1/x", letters, 3) is None and puzzles.values_at("xy", letters, 3) is None and puzzles.values_at("2^y", letters, 3) is None
    deep = lambda n: "(" * n + "x" + ")" * n
    assert puzzles.value_at(deep(98), {"x": 1}) == 1 and puzzles.value_at(deep(97), {"x": -1}) == -1
    assert puzzles.value_at(deep(99), {"x": 1}) is None and puzzles.value_at(deep(98), {"x": -1}) is None
