"""Text columns against plain Python."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.values import EMAIL_PATTERN, STOP_WORDS
from pagemill.operators.dedup import with_keys

SAMPLES = [
    "", " ", "\xa0 a b\x1cc\x85d\n", "Mail me: First.Last+x@Mail-Host.co.uk, or é@x.org or foo@x.o", "The the THE cat sat sat",
    "word " * 250, "zebra apple zebra apple mango kiwi", "İstanbul Σίσυφος ΟΔΟΣ", "𝔘𝔫𝔦 code 𝔭oints", "a@b.c|| x@y.zz|",
]


def features(text, title):
    words = text.lower().split()
    long_words = [w for w in words if len(w) > 3 and w not in STOP_WORDS]
    top = [w for w, _ in sorted(Counter(long_words).items(), key=lambda x: -x[1])[:10]]
    return len(words) // 100, len(text) // 1000, len(title.split()), len(long_words), top


def test_clean_text(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    rows = df.select("s", T.clean_text(F.col("s")).alias("c"), T.word_count(T.clean_text(F.col("s"))).alias("n")).collect()
    for r in rows:
        expected = re.sub(EMAIL_PATTERN, "[EMAIL]", re.sub(r"\s+", " ", r.s.strip()))
        assert r.c == expected
        assert r.n == len(expected.split())
    assert spark.range(1).select(T.clean_text(F.lit(None).cast("string")).alias("c")).first().c == ""


def test_hashes(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES] + [(None,)], "s string")
    for r in df.select("s", T.content_hash(F.col("s")).alias("c"), T.title_hash(F.col("s")).alias("t")).collect():
        if not r.s:
            assert r.c is None and r.t is None
        else:
            key = " ".join(r.s.lower().split()).encode()
            assert r.c == hashlib.sha256(key).hexdigest()
            assert r.t == hashlib.md5(key).hexdigest()


def test_fuzzy_features_on_samples_and_documents(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select(F.col("text").alias("s"))
    df = spark.createDataFrame([(s,) for s in SAMPLES if s], "s string").union(documents).withColumn("t", F.lit(" Two words "))
    for r in df.select("s", "t", T.fuzzy_features(F.col("s"), F.col("t")).alias("f")).collect():
        assert tuple(r.f) == features(r.s, r.t)


def test_fuzzy_hash_tells_features_apart(spark):
    texts = ["alpha beta gamma delta", "alpha  BETA gamma\ndelta", "beta alpha gamma delta", "alpha beta gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    h = [r.h for r in df.orderBy("i").select(T.fuzzy_hash(F.col("s"), F.lit("")).alias("h")).collect()]
    assert h[0] == h[1] and len(set(h)) == 3
    assert spark.range(1).select(T.fuzzy_hash(F.lit(""), F.lit("x")).alias("h")).first().h is None


def test_decode_body(spark):
    cases = [
        ("café".encode(), "utf-8", "café"), ("café".encode("latin-1"), "utf-8", "café"), ("café".encode(), None, "café"),
        ("café".encode("latin-1"), "ISO-8859-1", "café"), (b"\x80uro", "windows-1252", "€uro"), (b"x", "no-such", None),
        ("日本".encode("shift_jis"), "Shift_JIS", "日本"), (b"\xff\xff", "ascii", "ÿÿ"), ("日本".encode(), "ascii", "日本"),
        (b"\xff\xff\xff", "utf-16", "ÿÿÿ"), (b"", None, ""),
    ]
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(cases)], "i int, b binary, c string")
    rows = df.orderBy("i").select(T.decode_body(F.col("b"), F.col("c")).alias("t")).collect()
    assert [r.t for r in rows] == [e for _, _, e in cases]


def test_hostile_charsets_give_null(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), c) for c in ("undefined", "x\0y", "idna", "hex", "no-such")], "b binary, c string")
    got = [r.t for r in df.select(T.decode_body(F.col("b"), F.col("c")).alias("t"), "c").collect() if r.c != "idna"]
    assert got == [None] * 4


def test_white_space_collapses_and_collapsed_text_is_left(spark):
    rng = random.Random(5)
    signs = "ab  \t\n\x0b\x1c\x1f\x85\xa0   　"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.collapse_ws(F.col("x")).alias("c"))
    rows = rows.withColumn("left", F.regexp_count("c", F.lit(T.RUNS))).collect()
    assert all(r.c == " ".join(r.x.split()) and r.left == 0 for r in rows)


def test_content_is_normalised_once_for_all_keys(spark):
    keyed = with_keys(spark.createDataFrame([(1, "http://h/a", "T", "Some Words")], "id long, url string, title string, content string"))
    plan = keyed.select("content_key", "fuzzy_key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(content") == 1
