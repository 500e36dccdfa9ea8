"""Plans and helpers that matter at scale."""

from pyspark.sql import functions as F

from pagemill.operators.dedup import keep_first
from pagemill.operators.extract import explode_links, extract_pages
from pagemill.operators.frontier import domain_heads, plan_batch, tasks
from pagemill.operators.metrics import recent_points
from pagemill.plans.flagship import domain_summary
from pagemill.session import cut_lineage, placed_by, work_folder, written
from pagemill.sources.tables import spread


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_reads_pages_once_and_shuffles_narrow_rows(spark, small):
    plan = plan_of(domain_summary(spark.read.parquet(f"{small}/pages.parquet")))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("row_number(), 1, Partial") == 2


def test_links_are_computed_once(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    optimized = explode_links(extract_pages(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("tree_fields") == 1 and "size(" not in optimized.split("Generate")[0]


def test_hot_domain_is_trimmed_before_the_shuffle(spark):
    df = tasks(spark.range(100).select(F.concat(F.lit("http://h/"), "id").alias("url"), "id"), 0, 2, seq=F.col("id"))
    none = spark.createDataFrame([], "domain string, ts timestamp")
    assert plan_of(plan_batch(df, none, horizon=5.0)).count("row_number(), 5, Partial") >= 1
    assert "Window" not in plan_of(domain_heads(df))
    points = df.select(F.substring("url", 1, 6).alias("name"), F.current_timestamp().alias("ts"), "seq")
    assert "row_number(), 10, Partial" in plan_of(recent_points(points, 10))


def test_keep_first_without_keys_does_not_gather(spark):
    df = spark.range(1000).select("id", F.lit(None).cast("string").alias("k"))
    assert keep_first(df, "k", "id").count() == 1000


def test_placed_table_is_not_shuffled_again(spark):
    links = placed_by(spark.range(1000).select(F.col("id").cast("string").alias("url"), F.lit(1).alias("x")), "url")
    level = spark.range(300).select((F.col("id") * 5).cast("string").alias("url"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        joined = links.join(level, "url", "left_semi")
        assert plan_of(joined).count("Exchange") == 1
        assert joined.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_intermediate_tables_live_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark, "x").startswith(root.rstrip("/") + "/x-")
    df = spark.range(10)
    assert cut_lineage(df).count() == 10
    assert "FileScan" in plan_of(written(df, "ten")) and written(df, "ten").count() == 10


def test_spread_leaves_large_scans_alone(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert spread(pages, "page_id").rdd.getNumPartitions() == cores
    many = pages.repartition(cores + 1)
    assert spread(many, "page_id") is many
