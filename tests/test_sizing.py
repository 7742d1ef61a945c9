from pyspark.sql import functions as F

from spark_explore import sizing


def test_only_counted_small_sides_are_broadcast(spark):
    df = spark.range(100)
    big = spark.range(10).join(sizing.small_side(df, 50), "id")
    small = spark.range(10).join(sizing.small_side(df, 200), "id")
    hint = "strategy=broadcast"
    heavy = df.select("id", F.expr("repeat('x', 1000)").alias("text"), F.sequence(F.lit(1), F.lit(50)).alias("list"))
    rows, size = sizing.size_of(heavy)
    assert rows == 100 and 100 * (1000 + 400) <= size <= 100 * 1600
    assert hint not in sizing.small_side(heavy, 200, 100_000)._jdf.queryExecution().analyzed().toString()
    assert hint in small._jdf.queryExecution().analyzed().toString()
    assert hint not in big._jdf.queryExecution().analyzed().toString()


def test_lineage_is_cut_into_the_checkpoint_folder(spark):
    folder = sizing.checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir().startswith(("file:", folder))
    cut = sizing.cut_lineage(spark.range(5).withColumn("r", F.rand()))
    assert cut.collect() == cut.collect()
    assert "ExistingRDD" in cut._jdf.queryExecution().executedPlan().toString()


def test_local_tables_hold_typed_rows(spark):
    made = sizing.local_table(spark, [{"a": 1, "b": None}], "a int, b string")
    assert made.dtypes == [("a", "int"), ("b", "string")] and made.count() == 1
    assert sizing.local_table(spark, [], "a int").count() == 0
