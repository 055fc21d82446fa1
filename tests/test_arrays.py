"""Array behavior the level steps rely on."""

from pyspark.sql import functions as F

from tightknit.functions.arrays import after, computed, ordered_intersect


def test_intersect_keeps_left_order(spark):
    left = [9, 2, 7, 4, 1, 8, 3]
    rows = spark.createDataFrame(
        [(i, left, sorted([3, 9, 4, 100 + i, 2])) for i in range(50)], "i int, a array<bigint>, b array<bigint>"
    )
    for found in (rows, rows.repartition(3)):
        out = found.select(ordered_intersect("a", "b").alias("x")).distinct().collect()
        assert [r.x for r in out] == [[9, 2, 4, 3]]
    long_left = list(range(5000, 0, -1))
    big = spark.createDataFrame([(long_left, list(range(1, 5001, 3)))], "a array<bigint>, b array<bigint>")
    assert big.select(ordered_intersect("a", "b").alias("x")).first().x == [v for v in long_left if v % 3 == 1]


def test_intersect_order_survives_interpreted_evaluation(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        rows = spark.createDataFrame([([5, 1, 3], [1, 3, 5])], "a array<bigint>, b array<bigint>")
        assert rows.select(ordered_intersect("a", "b").alias("x")).first().x == [5, 1, 3]
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")


def test_after(spark):
    rows = spark.createDataFrame([([4, 5, 6], p) for p in range(3)], "a array<bigint>, p int")
    assert [r.x for r in rows.orderBy("p").select(after("a", "p").alias("x")).collect()] == [[5, 6], [6], []]


def test_computed_is_not_repeated_by_filters(spark):
    rows = spark.range(4).select("id", F.array("id", F.lit(1)).alias("a"), F.array(F.lit(1)).alias("b"))
    out = computed(rows, ["id"], x=F.array_intersect("a", "b")).filter(F.size("x") > 0).filter(F.size("x") < 9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1
    assert out.count() == 4
