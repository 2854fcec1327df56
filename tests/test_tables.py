"""Notes are dealt to tasks by their number, however few splits or shuffle partitions their tables have."""

from pyspark.sql import functions as F

from veilspark.plans import fixtures


def test_no_task_has_more_notes_than_its_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "NOTES_A_TASK", 50)
    ids = spark.range(2000).coalesce(1)
    ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"), F.timestamp_seconds(F.col("id") * 86400).alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    ids.limit(3).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Ann "), "id").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    for most in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            tasks = [r["count"] for r in fixtures.noted(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sum(tasks) == 2000 and max(tasks) <= 60, tasks
