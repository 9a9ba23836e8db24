from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.ordinal import number_within, with_ordinal


def test_with_ordinal_matches_row_number(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5003).alias("k"), F.col("id").alias("v"))
    got = with_ordinal(df, ["k"], "n", partitions=7)
    want = df.withColumn("n", F.row_number().over(Window.orderBy("k")))
    assert got.select("k", "n").exceptAll(want.select("k", F.col("n").cast("long"))).count() == 0
    assert got.count() == 5000


def test_with_ordinal_column_start(spark):
    df = spark.range(0, 10).select(F.col("id").alias("k"))
    start = spark.range(0, 3).select(F.max("id") + 1).scalar()
    got = sorted(r.n for r in with_ordinal(df, ["k"], "n", start=start, partitions=3).collect())
    assert got == list(range(3, 13))


def test_number_within_skewed_group(spark):
    # one invoice holds a third of all rows
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("g"), F.col("id").alias("o"))
    got = number_within(df, ["g"], ["o"], "n", partitions=6)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert got.select("g", "o", "n").exceptAll(want.select("g", "o", "n")).count() == 0
