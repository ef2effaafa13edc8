"""Ranks and splits of many seeds: cells of large keys, no table of the seeds' rows sent through the driver."""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.operators import ranking as R
from edgeloom.operators import splits as S


def _pairs(spark, n=900):
    return spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 10_000).alias("b"), F.when(F.col("id") < n // 2, 0).otherwise(F.col("id") % 7).cast("bigint").alias("group_id"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_large_keys_rank_like_a_plain_window(spark):
    df = _pairs(spark).withColumn("h", F.md5(F.col("a").cast("string")))
    want = Window.partitionBy("group_id").orderBy("h", "a")
    for cell_rows in (1, 30, 200, 10_000):
        got = R.hash_rank(df, ["group_id"], "h", ["a"], cell_rows=cell_rows)
        rows = got.withColumn("w", F.row_number().over(want)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group_id")))
        assert rows.filter("rank <> w OR key_rows <> n").count() == 0
        assert rows.count() == 900
    assert sorted(r["rank"] for r in R.hash_rank(df, [], "h", ["a"], cell_rows=50).collect()) == list(range(1, 901))


def test_counted_cells_split_like_whole_ranks(spark):
    pairs = _pairs(spark)
    for keys, rule in ((["group_id"], "floor"), ([], "round")):
        whole = S.split_edges(pairs, keys, 3, salt="t", rule=rule)
        for cell_rows in (1, 20, 150):
            cut = S.split_edges(pairs, keys, 3, salt="t", rule=rule, cell_rows=cell_rows)
            assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0


def test_rows_of_all_seeds_are_not_broadcast(spark):
    """The offsets of the hash cells, as many as the rows of all seeds, were once taken for small and sent through the driver."""
    for split in (S.split_edges_by_group(_pairs(spark), 20), S.split_edges_random(_pairs(spark), 20)):
        assert "BroadcastHashJoin" not in _plan(split)


def test_parts_of_more_seeds_than_a_long_holds(spark):
    nodes = spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") % 2).alias("group_id"))
    seeds = list(range(3, 70, 2))
    pairs = nodes.alias("x").join(nodes.alias("y"), F.expr("x.group_id = y.group_id AND x.node_id < y.node_id")).selectExpr("x.node_id a", "y.node_id b", "x.group_id")
    parts = {(r.seed, r.node_id): r.part for r in S.node_parts(nodes, seeds).collect()}
    got = {(r.seed, r.a, r.b): r.split for r in S.split_node_disjoint(pairs, nodes, seeds).collect()}
    want = {(s, r.a, r.b): parts[s, r.a] for r in pairs.collect() for s in seeds if parts[s, r.a] == parts[s, r.b]}
    assert got == want


def test_written_tables_count_for_more_than_their_files(spark, tmp_path):
    from edgeloom.driver.inputs import Inputs
    key = "spark.sql.sources.fileCompressionFactor"
    spark.conf.unset(key)
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    Inputs(spark, str(tmp_path))
    assert float(spark.conf.get(key)) == 8.0
    spark.conf.set(key, "3.0")
    Inputs(spark, str(tmp_path))
    assert float(spark.conf.get(key)) == 3.0
    spark.conf.unset(key)


def test_hashes_of_taken_pairs_are_made_after_the_shuffle(spark):
    pool = _pairs(spark).withColumn("seed", (F.col("a") % 1).cast("int"))
    wanted = pool.groupBy("seed", "group_id").agg(F.lit(5).cast("bigint").alias("n"))
    taken = S._take(pool, ["seed"], wanted)
    assert taken.groupBy("group_id").count().filter("count <> 5").count() == 0
    plan = _plan(taken)
    assert plan.index("md5(") < plan.index("REPARTITION_BY_NUM")                      # printed from the last step down
