"""Work is spread over the cores, and expensive gates are computed once."""

import random

from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.operators import curation as C
from pairloom.session import TASKS_PER_CORE, spread


def test_one_row_group_is_spread_over_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(4000).selectExpr("id", "repeat(md5(string(id)), 40) AS text").coalesce(1).write.parquet(path)
    size, key = sum(f.stat().st_size for f in (tmp_path / "one").glob("*.parquet")), "spark.sql.files.maxPartitionBytes"
    old, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(key, str(size // 100))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert df.select(F.spark_partition_id()).distinct().count() == 1
        parts = spread(df).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == TASKS_PER_CORE * spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 4000
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_distance_by_words_bounds_the_edit_distance(spark):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abü가") for _ in range(pick.choice([0, 1, 2, 3, 9, 80])))
    line = lambda: " ".join(word() for _ in range(pick.randrange(9)))
    rows = [(line(), line()) for _ in range(300)] + [(x, x[:-1] + " ya") for x in (line() for _ in range(100))] + [("", ""), ("a", ""), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", X.distance_by_words("a", "b").alias("most"), X.edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("plain")).collect():
        assert r.d == r.plain and (r.plain is None) == (r.most is None)
        assert r.most is None or r.most >= r.d, (r.a, r.b)


def test_gates_are_not_computed_again_after_curation(spark):
    rows = [(i, "train" if i % 3 else "valid", f"word {i % 40} and more", f"ward {i % 37} und mere" + "x" * (i % 3), ("jejudo", "jeollado")[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, split string, standard string, dialect string, do string")
    for caps in ({}, {"max_per_label": 20, "standard_cap_ratio": 1.2}):
        table = C.classifier_table(df, endings=("zz",), **caps)
        assert "levenshtein" not in table._jdf.queryExecution().optimizedPlan().toString()
        keys = C.classifier_table(df, endings=("zz",), keys_only=True, **caps)
        assert keys.columns == ["id", "side", "label", "split"]
        assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, table.select(*keys.columns).collect()))
