"""Duplicate detection against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import dedup as D
from pagemill.operators import skew
from pagemill.operators.skew import _parts_per_round, hot_keys, rank_in_group, salted_join, top_k_per_group

KEYED = "id bigint, ord bigint, url_key string, content_key string, title_key string, fuzzy_key string"


def greedy(rows, types, seen=()):
    """One pass in arrival order; only kept rows register their keys."""
    taken, kept = set(seen), set()
    for row in sorted(rows, key=lambda r: r["ord"]):
        keys = {(t, row[f"{t}_key"]) for t in types if row[f"{t}_key"] is not None}
        if not keys & taken:
            kept.add(row["id"])
            taken |= keys
    return kept


def random_rows(n, values, seed, null=0.2):
    rng = random.Random(seed)
    order = list(range(n))
    rng.shuffle(order)

    def key(t):
        return None if rng.random() < null else f"{t}{rng.randrange(values)}"

    return [
        {"id": i, "ord": order[i], **{f"{t}_key": key(t) for t in D.KEY_TYPES}} for i in range(n)
    ]


@pytest.mark.parametrize("seed, n, values", [(1, 60, 12), (2, 150, 100), (3, 200, 25), (4, 120, 400)])
@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_greedy_matches_brute_force(spark, seed, n, values, hot_rows):
    rows = random_rows(n, values, seed)
    df = spark.createDataFrame(rows, KEYED)
    for types in (D.DEFAULT, D.STRICT):
        got = {r.id for r in D.greedy_dedup(df, "ord", types, hot_rows=hot_rows).filter("kept").collect()}
        assert got == greedy(rows, types)


def test_greedy_follows_long_chains(spark):
    # Neighbours share a key, alternately by content and by the near-duplicate key: every second row stays.
    rows = [
        {"id": i, "ord": i, "url_key": f"u{i}", "content_key": f"c{(i + 1) // 2}", "title_key": "t", "fuzzy_key": f"f{i // 2}"}
        for i in range(14)
    ]
    got = D.greedy_dedup(spark.createDataFrame(rows, KEYED), "ord").filter("kept")
    assert {r.id for r in got.collect()} == set(range(0, 14, 2)) == greedy(rows, D.DEFAULT)


def test_greedy_with_one_text_in_a_third_of_all_rows(spark):
    rows = random_rows(300, 60, 7)
    for row in rows[:100]:
        row["content_key"], row["fuzzy_key"] = "hot", "hotf"
    seen = [("content", "c3"), ("fuzzy", "f5"), ("title", "t1")]
    df = spark.createDataFrame(rows, KEYED)
    seen_df = spark.createDataFrame(seen, "key_type string, key string")
    seen_keys = [("content", "content3"), ("fuzzy", "fuzzy5"), ("title", "title1")]
    seen_df = spark.createDataFrame(seen_keys, "key_type string, key string")
    got = D.greedy_dedup(df, "ord", seen=seen_df, hot_rows=20)
    assert got.count() == 300
    assert {r.id for r in got.filter("kept").collect()} == greedy(rows, D.DEFAULT, seen_keys)


def test_title_never_decides_and_empty_content_has_no_key(spark):
    rows = [(0, "http://a/1", "Same", ""), (1, "http://a/2", "Same", None), (2, "http://a/1?ref=x", "Same", "text")]
    keyed = D.with_keys(spark.createDataFrame(rows, "id bigint, url string, title string, content string"))
    kept = D.greedy_dedup(keyed, "id").filter("kept")
    assert {r.id for r in kept.collect()} == {0, 1}
    flags = D.as_of_flags(keyed, kept, "id").orderBy("id").collect()
    assert [(r.url_duplicate, r.content_duplicate, r.title_duplicate) for r in flags] == [
        (False, False, False), (False, False, True), (True, False, True),
    ]


def test_flags_against_history(spark):
    rows = random_rows(80, 30, 11)
    history = [("url", "url3"), ("content", "content4"), ("content", "content4"), ("title", "title5"), ("fuzzy", "fuzzy6")]
    df = spark.createDataFrame(rows, KEYED)
    seen = spark.createDataFrame(history, "key_type string, key string")
    for r in D.duplicate_flags(df, seen, hot_rows=2).collect():
        for t in D.KEY_TYPES:
            assert r[f"{t}_duplicate"] == ((t, r[f"{t}_key"]) in history)


def test_keep_first_and_stats(spark):
    rows = random_rows(200, 20, 5)
    df = spark.createDataFrame(rows, KEYED)
    got = {r.id for r in D.keep_first(df, "content_key", "ord").collect()}
    first = {}
    for row in sorted(rows, key=lambda r: r["ord"]):
        key = row["content_key"] or ("own", row["id"])
        first.setdefault(key, row["id"])
    assert got == set(first.values())


def as_of(rows, types=D.DEFAULT):
    """Flags, kept ids and registered keys when rows come in order and only kept rows register keys."""
    sets, flags, kept = {t: set() for t in D.KEY_TYPES}, {}, set()
    for row in sorted(rows, key=lambda r: r["ord"]):
        own = {t: row[f"{t}_key"] is not None and row[f"{t}_key"] in sets[t] for t in D.KEY_TYPES}
        flags[row["id"]] = own
        if not any(own[t] for t in types):
            kept.add(row["id"])
            for t in D.KEY_TYPES:
                sets[t] |= {row[f"{t}_key"]} - {None}
    return flags, kept, sets


@pytest.mark.parametrize("seed, values, hot_rows", [(5, 20, 1000), (6, 60, 5), (7, 150, 2)])
def test_flags_and_statistics_of_stored_rows(spark, seed, values, hot_rows):
    rows = random_rows(200, values, seed)
    df = spark.createDataFrame(rows, KEYED)
    flags, kept, sets = as_of(rows)
    flagged = D.as_of_flags(df, D.keep_greedy(df, "ord"), "ord", hot_rows=hot_rows).cache()
    assert {r.id: {t: r[f"{t}_duplicate"] for t in D.KEY_TYPES} for r in flagged.collect()} == flags
    assert {r.id for r in flagged.filter("kept").collect()} == kept
    assert {r.id for r in flagged.filter(~D.is_duplicate()).collect()} == kept
    stats = D.duplicate_stats(flagged).first()
    assert stats.total_checks == 200
    for t in D.KEY_TYPES:
        assert stats[f"{t}_duplicates"] == sum(f[t] for f in flags.values())
        assert stats[f"total_{t}_hashes"] == len(sets[t])


def test_a_page_that_was_not_stored_registers_nothing(spark):
    rows = [
        {"id": 0, "ord": 0, "url_key": "u0", "content_key": "c", "title_key": "t0", "fuzzy_key": "f0"},
        {"id": 1, "ord": 1, "url_key": "u1", "content_key": "c", "title_key": "t", "fuzzy_key": "f"},
        {"id": 2, "ord": 2, "url_key": "u2", "content_key": "d", "title_key": "t", "fuzzy_key": "f"},
    ]
    df = spark.createDataFrame(rows, KEYED)
    last = D.as_of_flags(df, D.keep_greedy(df, "ord"), "ord").filter("id = 2").first()
    assert last.kept and not (last.fuzzy_duplicate or last.title_duplicate)
    stats = D.duplicate_stats(D.as_of_flags(df, D.keep_greedy(df, "ord"), "ord")).first()
    assert (stats.content_duplicates, stats.fuzzy_duplicates, stats.total_fuzzy_hashes, stats.total_title_hashes) == (1, 0, 2, 2)


def test_new_and_retained_keys(spark):
    rows = random_rows(50, 20, 9)
    now = datetime.datetime(2024, 3, 1)
    seen = spark.createDataFrame(
        [("content", "content1", now - datetime.timedelta(days=31)), ("title", "title1", now - datetime.timedelta(days=30))],
        "key_type string, key string, first_seen timestamp",
    )
    assert [r.key for r in D.retained_keys(seen, F.lit(now)).collect()] == ["title1"]
    added = D.new_keys(spark.createDataFrame(rows, KEYED), seen, F.lit(now)).collect()
    expected = {(t, r[f"{t}_key"]) for r in rows for t in D.KEY_TYPES if r[f"{t}_key"]} - {("content", "content1"), ("title", "title1")}
    assert {(r.key_type, r.key) for r in added} == expected and len(added) == len(expected)


def test_documents_keep_as_many_as_one_pass(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    keyed = D.with_keys(documents).withColumn("ord", F.col("id"))
    rows = [r.asDict() for r in keyed.collect()]
    got = {r.id for r in D.greedy_dedup(keyed, "ord").filter("kept").collect()}
    assert got == greedy(rows, D.DEFAULT)


def test_salted_join_equals_plain_join(spark):
    left = spark.range(400).select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        salted = sorted(map(tuple, salted_join(left, right, ["k"], how, ["id"], hot_rows=100).collect()), key=str)
        assert salted == plain, how


def test_ranking_helpers(spark):
    df = spark.range(1000).select(
        (F.col("id") * 3).alias("seq"), F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        (F.col("id") % 4).alias("p"),
    )
    rows = df.collect()
    expected = {}
    for g in {r.g for r in rows}:
        for rank, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: (-r.p, r.seq)), 1):
            expected[r.seq] = rank
    ranked = rank_in_group(df, ["g"], [-F.col("p")], "seq", cell_bits=6)
    assert {r.seq: r["rank"] for r in ranked.collect()} == expected
    top = top_k_per_group(df, ["g"], [F.desc("p"), F.col("seq")], 10, ["seq"], hot_rows=60)
    assert {r.seq: r["rank"] for r in top.collect()} == {s: k for s, k in expected.items() if k <= 10}


def test_a_hot_key_gets_as_many_parts_as_its_rows_ask_for(spark):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).when(F.col("id") < 750, 1).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(facts, ["k"], 100)
    assert [tuple(r) for r in hot.collect()] == [(0, 7)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for name, value in zip(before, ("-1", "false", "200")):
            spark.conf.set(name, value)
        lookup = spark.range(3).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        tasks = salted_join(facts, lookup, ["k"], "inner", ["id"], hot_rows=100).filter("k = 0").select(F.spark_partition_id().alias("t"), "id")
        counts = [r["count"] for r in tasks.groupBy("t").count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(counts) == 700 and 5 <= len(counts) <= 7 and max(counts) < 250


def test_ranking_takes_rounds_for_large_groups():
    assert _parts_per_round(100, 10, 100) == []
    assert _parts_per_round(10_000, 10, 100) == [100, 10]
    assert _parts_per_round(10_000, 100, 100) == [50, 25, 13, 7, 4, 2]


def test_a_greedy_round_writes_one_narrow_table(spark, monkeypatch):
    """Counted by what is written: keys, the first open rows, the hot keys, and one table a round."""
    names = []
    for module in (D, skew):
        monkeypatch.setattr(module, "written", lambda df, name, original=module.written: names.append((name, df.columns)) or original(df, name))
    rows = [
        {"id": i, "ord": i, "url_key": f"u{i}", "content_key": f"c{(i + 1) // 2}", "title_key": "t", "fuzzy_key": f"f{i // 2}"} for i in range(8)
    ]
    kept = D.keep_greedy(spark.createDataFrame(rows, KEYED), "ord")
    assert {r.id for r in kept.collect()} == {0, 2, 4, 6}
    assert [name for name, _ in names] == ["greedy-keys", "greedy-round", "hot-keys"] + ["greedy-round"] * 4
    assert all(set(columns) <= {"_i", "_o", "_keys", "_touched", "_kept", *(f"{t}_key" for t in D.DEFAULT)} for name, columns in names if name == "greedy-round")
