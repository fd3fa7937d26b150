from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.work import sound
from stratalens.operators.skew import lookup


def test_lookup_equals_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, f"r{i}") for i in range(300)] + [(None, "n")], "k long, v string")
    left = left.unionByName(spark.range(120_000).selectExpr("1L AS k", "'hot' AS v"))
    right = spark.createDataFrame([(1, "one"), (3, "three"), (9999, "none")], "k long, w string")
    for how in ("inner", "left"):
        got = lookup(left, right, "k", left.count(), how)
        want = left.join(right, "k", how)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert lookup(left.limit(0), right, ["k"], 0).count() == 0


def test_unions_of_alike_partitioned_inputs_keep_their_groups(spark, tmp_path):
    """Two halves, windowed by the key, of different sizes: every key must come out once."""
    spark.range(4000).selectExpr("id % 1000 AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sound(spark)
    last = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("v"))).where("rn = 1")
    both = last.select("k", F.lit(1).alias("n"), F.repeat(F.lit("x"), 2000).alias("wide")).unionByName(last.where("k % 50 > 0").select("k", F.lit(2).alias("n"), F.lit("y").alias("wide")))
    assert both.groupBy("k").agg(F.sum("n").alias("n"), F.max("wide").alias("w")).count() == 1000
