"""Steps of trails beside an edge table that is larger than Spark can know."""

from pyspark.sql import functions as F

from zonehour.operators import graph as G


def test_unrolled_edges_are_not_broadcast(spark, tmp_path):
    zones = str(tmp_path / "zones")
    spark.range(50).write.parquet(zones)
    hours = spark.read.parquet(zones).select("id", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("h"))
    edges = hours.select((F.col("id") * 168 + F.col("h")).alias("src"), (F.col("id") * 168 + (F.col("h") + 1) % 168).alias("dst"),
                         F.lit(True).alias("temporal"))
    steps = spark.createDataFrame([(0, 1), (167, 0), (1, 0), (3, 9), (None, 4)], "vertex bigint, next_vertex bigint")
    tagged = G.tag_edges(steps, edges)
    assert "Broadcast" not in tagged._jdf.queryExecution().executedPlan().toString()
    got = {(r.vertex, r.next_vertex): r.temporal for r in tagged.collect()}
    assert got == {(0, 1): True, (167, 0): True, (1, 0): True, (3, 9): False, (None, 4): False}
