"""The content table as a key index: what a lookup reads, how ties are settled, what compaction moves."""

import datetime
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagemill.schemas import CONTENT
from pagemill.sources import store
from pagemill.sources.tables import seed_urls

DAY = datetime.datetime(2024, 1, 1)


def _records(spark, count, start=0, text="text"):
    given = {"url": F.concat(F.lit("http://h/"), "id"), "title": F.concat(F.lit(f"{text} "), "id"), "content": F.repeat(F.sha2(F.col("id").cast("string"), 256), 4)}
    rows = spark.range(start, start + count).select(*[
        given.get(f.name, F.lit(None)).cast("map<string,array<string>>" if f.name == "schema_org_data" else f.dataType).alias(f.name)
        for f in CONTENT if f.name not in store._STORAGE
    ])
    return rows


def _scanned(df):
    """Rows that a scan without shuffle hands on, from Spark's own counters."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def _groups(path, key):
    """Row counts of the row groups whose bounds hold a key, and of all."""
    held, everything = [], []
    for file in glob.glob(f"{path}/hash_prefix={key[:2]}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = [meta.schema.column(i).path for i in range(meta.num_columns)].index("url_hash")
        for i in range(meta.num_row_groups):
            bounds = meta.row_group(i).column(column).statistics
            everything.append((bounds.min, bounds.max, meta.row_group(i).num_rows))
            if bounds.min <= key <= bounds.max:
                held.append(meta.row_group(i).num_rows)
    return held, sorted(everything)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "content")
    # Wide partitions, so that one has many row groups.
    store.store_content(_records(spark, 60_000), path, F.lit(DAY), tasks=3, row_group_bytes=16_000)
    return path


def test_a_lookup_reads_one_row_group(spark, table):
    url = "http://h/4711"
    key = spark.range(1).select(F.sha2(F.lit(url), 256)).first()[0]
    held, everything = _groups(table, key)
    assert len(held) == 1 and len(everything) > 1
    assert all(a[1] < b[0] for a, b in zip(everything, everything[1:]))  # in order, without overlap
    rows = store._rows_of(spark, table, url).select("title")
    assert 1 <= _scanned(rows) <= held[0]
    assert [r.title for r in store.get_content(spark, table, url).collect()] == ["text 4711"]


def test_an_absent_key_reads_nothing(spark, table):
    """Bounds hold most absent keys; the Bloom filters do not."""
    read = [_scanned(store._rows_of(spark, table, f"http://none/{i}").select("title")) for i in range(12)]
    assert sum(n > 0 for n in read) <= 2


def test_write_tasks_follow_the_setting(spark, tmp_path):
    path = str(tmp_path / "c")
    store.store_content(_records(spark, 3000), path, F.lit(DAY), tasks=300)
    files = glob.glob(f"{path}/*/*.parquet")
    assert 300 <= len(files) <= 600 and store.read_content(spark, path).count() == 3000


def test_of_equal_instants_the_last_write_counts(spark, tmp_path):
    path = str(tmp_path / "c")
    for text in ("zz", "aa", "mm"):
        store.store_content(_records(spark, 5, text=text), path, F.lit(DAY))
    assert {r.title for r in store.read_content(spark, path).collect()} == {f"mm {i}" for i in range(5)}
    store.compact(spark, path, str(tmp_path / "d"))
    store.store_content(_records(spark, 2, text="bb"), str(tmp_path / "d"), F.lit(DAY))
    assert sorted(r.title for r in store.read_content(spark, str(tmp_path / "d")).collect()) == ["bb 0", "bb 1", "mm 2", "mm 3", "mm 4"]


def test_ties_within_a_write_see_the_whole_record(spark, tmp_path):
    one = _records(spark, 1).withColumn("links", F.array(F.lit("http://a/")))
    two = one.withColumn("links", F.array(F.lit("http://b/")))
    found = []
    for k, rows in enumerate((one.unionByName(two), two.unionByName(one).repartition(2))):
        path = str(tmp_path / f"c{k}")
        store.store_content(rows, path, F.lit(DAY))
        found.append(store.read_content(spark, path).first().links)
    assert found[0] == found[1]


def test_compaction_is_one_shuffle(spark, table, tmp_path):
    plan = store._compacted(store._scan(spark, table), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    store.store_content(_records(spark, 100, text="new"), table, F.lit(DAY + datetime.timedelta(days=1)))
    target = str(tmp_path / "d")
    store.compact(spark, table, target, tasks=2, row_group_bytes=16_000)
    rows = spark.read.parquet(target)
    assert rows.count() == 60_000 and rows.filter("title LIKE 'new %'").count() == 100
    for file in glob.glob(f"{target}/hash_prefix=0*/*.parquet"):
        keys = pq.read_table(file, columns=["url_hash"])["url_hash"].to_pylist()
        assert keys == sorted(keys)


def test_existence_asks_before_it_makes_distinct(spark, table):
    urls = seed_urls(spark, ["http://h/1", "http://h/1", "http://none/"])
    asked = store.content_exists(spark, table, urls)
    assert sorted((r.url, r.stored) for r in asked.collect()) == [("http://h/1", True), ("http://h/1", True), ("http://none/", False)]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Aggregate") < plan.index("Join LeftSemi")
    assert "ReadSchema: struct<url_hash:string>" in asked._jdf.queryExecution().executedPlan().toString()
