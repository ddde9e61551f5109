import __spark_entry__ as e
from siftgate.operators import scoring
from pyspark.sql import functions as F


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_auroc_ties_and_direction(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (2.0, True), (3.0, False)], "s double, p boolean")
    a = scoring.auroc(df, [], "s", F.col("p")).first()
    assert (a.n_pos, a.n_neg, a.u2) == (2, 2, 7) and a.auroc == 0.875
    assert scoring.auroc(df, [], "s", F.col("p"), lower=False).first().auroc == 0.125


def test_auroc_of_one_class_is_null(spark):
    assert scoring.auroc(spark.createDataFrame([(1.0, True)], "s double, p boolean"), [], "s", F.col("p")).first().auroc is None
