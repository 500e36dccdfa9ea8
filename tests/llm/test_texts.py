"""PII, quality, toxicity, deduplication, shards and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.llm import common, exact_dedup, packing, pii, quality, sharding, simhash, toxicity
from pagemill.llm.queries import LLM_QUERIES


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _number(found):
    return re.sub("[^0-9]", "", found)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_number(m)) <= 19 and _luhn(_number(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_number(m)) <= 15),
]


def _base(text):
    spans = sorted((m.start(), k, name, m.end()) for k, (name, p, valid) in enumerate(KINDS) for m in re.finditer(p, text) if valid(m.group()))
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)


def test_base_spans(spark):
    rnd = random.Random(9)
    bits = ["a@b.co", "_x@d.e", "1.2.3.4", ".5", "000255", "300", "4111 1111 1111 1111", "+1 (663) 555-6869", "😀", " ", "-", "+", "é", "@", "9", "user", "."]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(800)]
    texts += ["", "7" * 30_000, "a" * 30_000 + "@", "+" + "1 " * 5000, "a@b.c_x@d.e", "4111111111111111", "1" * 16 + " " + "1.1.1.1"]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(9999, None, 1)], "doc_id long, text string, row int")
    got = {r.doc_id: r.base_sha256 for r in pii.pii_digest(table).collect()}
    assert got == {i: hashlib.sha256(_base(t or "").encode()).hexdigest() for i, t in [*enumerate(texts), (9999, None)]}
    assert pii.pii_digest(table.limit(0)).count() == 0


def test_contexts_find_new(spark):
    rows = [(i, f"some words call +1 (663) 555-686{i} please") for i in range(9)] + [(20, "now call ext-5512 and wait 77 days"), (21, "nothing 5 here"), (21, "nothing 5 here")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.pii_digest(table).collect()}
    assert found[20] == "context:9:17" and found[21] == ""
    clean = {r.doc_id: r.text for r in pii.mask(table).collect()}
    assert clean[20] == "now call <context> and wait 77 days" and clean[3] == "some words call <phone> please" and pii.mask(table).count() == len(rows)


def test_quality_held_out(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    met = quality.quality_scores(docs).join(labels, "doc_id").toPandas()
    assert ((met.quality == 1) == met.kept).mean() > 0.97
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1)], "doc_id long, text string, score int")
    assert quality.quality_scores(odd).count() == 3 and quality.quality_scores(odd.limit(0)).count() == 0


def test_toxicity_chain(spark):
    rnd = random.Random(4)
    plain = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(60)]
        toxic = i % 9 == 0
        if toxic:
            words[rnd.randrange(60)] = rnd.choice(["foul", "vile"])
        rows.append((i, " ".join(words), int(toxic), int(toxic and "vile" in words)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, worse int")
    out = toxicity.toxicity(table, table.filter("doc_id < 600"), ("toxic", "worse")).join(table, "doc_id").filter("doc_id >= 600").toPandas()
    assert ((out.toxic == 1) == out.flagged).all() and ((out.p_worse >= 0.5) == (out.worse == 1)).mean() > 0.98
    none = toxicity.toxicity(table, table.limit(0), ("toxic",))
    assert none.filter("p_toxic = 0 AND NOT flagged").count() == 900 and toxicity.toxicity(table.limit(0), table, ("toxic",)).count() == 0


def test_simhash_groups(spark):
    texts = [None, "", " ", "A b c", "a  B\tc", *(f"x{i} y{i % 3} z" for i in range(60)), "long " * 3000]
    table = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, print string")
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if int(np.bitwise_count(np.uint64((a ^ b) & (2**64 - 1)))) <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()} == dict(enumerate(root))


def test_exact_groups(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, "a  b"), (5, None), (6, " "), (7, "é"), (8, "e")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, id int")).collect()}
    assert got == {3: (2, 4, False), 1: (2, 4, False), 2: (2, 4, True), 4: (2, 4, False), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True), 8: (8, 1, True)}


def test_shards(spark):
    table = spark.createDataFrame([(i % 40, None if i % 7 == 0 else f"t{i}", i) for i in range(330)], "doc_id long, text string, shard int")
    out = sharding.shard_digest(sharding.external_shuffle(table, shards=16, bucket_bytes=100)).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 330 and sizes.max() - sizes.min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_scores(docs).filter("kept").collect()}
    left = {r.doc_id for r in docs.collect() if r.doc_id in kept}
    groups = {}
    for r in docs.filter(docs.doc_id.isin(list(left))).collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        groups.setdefault(key, []).append((-len(r.text or ""), r.doc_id))
    exact = {min(g)[1] for g in groups.values()}
    near = simhash.near_duplicates(docs.filter(docs.doc_id.isin(list(exact)))).filter("doc_id = component_id")
    assert set(out.doc_id) == {r.doc_id for r in near.collect()}
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()
    assert "op4_best_fit_packing" in LLM_QUERIES


def test_pipeline_without_unique_ids(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = [f"The {a} walked to the {b} and spoke, softly." for a in ("fox", "cat", "dog", "owl") for b in ("house", "river", "bridge", "market", "garden")]
    junk = "$$ @@ ## %% ^^ && | | $$ @@ ## %% | | " * 6
    texts = [(None, t) for t in plain[:8]] + [(7, t) for t in plain[8:16]] + [(k, t) for k, t in enumerate(plain[16:], 20)]
    texts += [(None, junk), (7, junk), (None, None), (None, None)] + [(k, junk + str(k)) for k in range(40, 46)]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in texts], schema)
    got = corpus_pipeline.drop_low_quality(spark, docs, "")
    verdict = {r.doc_id: r.kept for r in quality.quality_scores(docs.withColumn("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))).collect()}
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert got.columns == docs.columns and not all(verdict.values())
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(str((r.doc_id, r.text)) for r in hashed if verdict[r.h])

    rows = [(None, "a b"), (None, "ab"), (None, "a b"), (3, "a b"), (3, "a b"), (3, "c"), (None, "c"), (5, "d"), (5, "d"), (None, "e"), (None, "f")]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], schema)
    left = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("None", "a b"), ("None", "c"), ("5", "d"), ("None", "e"), ("None", "f")])

    rows = [(None, "one two three four"), (None, "One two  three four"), (None, plain[0]), (4, plain[0]), (4, plain[0]), (2, plain[0]), (4, plain[7]), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], schema)
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), (r.text or "").lower().split()) for r in left) == sorted([("None", "one two three four".split()), ("2", plain[0].lower().split()), ("4", plain[7].lower().split()), ("None", [])])


def _context_rows(times):
    """A fixture of 116 texts, repeated with new seeds and identifiers: common clean numbers follow many words, each of which has some seeds."""
    out, words = [], [f"w{chr(97 + k)}" for k in range(8)]
    for t in range(times):
        for k, word in enumerate(words):
            out += [f"{word} p{t}x{k}y{i}@d.co" for i in range(4)]
            out += [f"{word} {1990 + i}" for i in range(8)]
        out += [f"call p{t}z{i}@d.co" for i in range(9)] + [f"call ext-{t}00{i} so" for i in range(2)]
        out += [f"ring ext-{t}00{i} so" for i in range(2)] + [f"ring p{t}r{i}@d.co" for i in range(3)] + [f"in 1990 and {t}7" for _ in range(4)]
    return out


def test_contexts_do_not_grow_with_size(spark):
    for times in (1, 10, 100):
        table = spark.createDataFrame(list(enumerate(_context_rows(times))), "doc_id long, text string").repartition(8)
        found = pii.pii_digest(table).withColumnRenamed("doc_id", "id").join(table, F.col("id") == F.col("doc_id")).filter("n_context > 0")
        words = {r.text.split()[0]: r["count"] for r in found.withColumn("text", F.split("text", " ")[0]).groupBy("text").count().collect()}
        assert words == {"call": 2 * times, "ring": 2 * times}


def test_contexts_inside_punctuation(spark):
    rows = [f"some words call +1 (663) 555-68{i} please" for i in range(10, 60)] + [f"write      a{i}@b.co" for i in range(9)]
    rows += [f"to a{i}@b.co c{i}@d.co" for i in range(9)] + [f"ref: \u00e9p{i}@x.co" for i in range(9)]
    odd = {
        "call ext-5512, please": "ext-5512", "call (AB-99)": "AB-99", "call      AB12C.": "AB12C", "call \t \n  X7": "X7", "write 12-3456.": "12-3456",
        "call, X8": None, "call nothing": None, "call x-" + "-" * 20_000 + "1!": "x-" + "-" * 20_000 + "1", "call 7-up's": "7-up's",
        "call \U0001f600Z5\U0001f600\u2028": "Z5",
    }
    texts = rows + list(odd)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s.startswith("context")] for r in pii.pii_digest(table).collect()}
    assert [[texts[k][int(a):int(b)] for _, a, b in found[k]] for k in range(len(rows), len(texts))] == [[w] if w else [] for w in odd.values()]
    words = pii.spans(table).filter("valid and kind = 'email'").select("before").distinct().collect()
    assert {w.before for w in words} >= {"write", "to", *(f"a{i}@b.co" for i in range(9))}
    beside = spark.createDataFrame([(0, "10.0.0.1,10.0.0.2\n\n\n\n\n\n 10.0.0.3 x10.0.0.4y  10.0.0.5")], "doc_id long, text string")
    assert [r.before for r in pii.spans(beside).filter("kind = 'ip'").orderBy("start").collect()] == ["", "10.0.0.1,", "10.0.0.1,10.0.0.2", "x", "x10.0.0.4y"]


def test_quality_reads_long_words(spark):
    plain = [f"The {a} walked to the {b} and spoke, softly." for a in ("fox", "cat", "dog", "owl") for b in ("house", "river", "bridge", "market", "garden")]
    clean, junk = [f"one,two,six,ten,{'red,sea,' * k}" for k in range(1, 11)], [f"one,two,six,ten,{'$%#' * (40 + k)}" for k in range(10)]
    table = spark.createDataFrame(list(enumerate(plain + clean + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.quality_scores(table).filter("kept").collect()}
    assert kept == set(range(len(plain) + len(clean)))
    assert quality.fired(junk[0]) & 1 and not np.array_equal(quality.features(clean[0]), quality.features(junk[0]))


def test_work_on_a_long_text_is_linear(spark):
    """A text with 20,000 matches, and one of twice the length: found and masked in about twice the time at most."""
    import time

    def seconds(n):
        text = " ".join(f"call +1 (663) 555-{i:04d}, id{i} and a{i}@b.co" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.pii_digest(df).first().n_email == n
        out = pii.mask(df).first().text
        assert out.count("<email>") == n and "@" not in out
        return time.perf_counter() - began

    seconds(50)
    short, long = seconds(3_000), seconds(6_000)
    assert long < 20 and long < 3 * short + 3


def test_columns_with_clashing_names(spark):
    rows = [(1, "mail a@b.co now", 5, 6, 7), (None, "none", 1, 2, 3), (None, "ip 10.0.0.1", 4, 4, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _mark int, _found int")
    assert sorted(map(tuple, pii.mask(df).collect()), key=str) == sorted(
        [(1, "mail <email> now", 5, 6, 7), (None, "none", 1, 2, 3), (None, "ip <ip>", 4, 4, 4)], key=str)


def test_masking_by_code_points(spark):
    text = "\U0001f600é a@b.co\u0301 " + "x" * 10 + " 10.0.0.1 \U0001f600"
    df = spark.createDataFrame([(1, text), (2, "a@b.co"), (3, "")], "doc_id long, text string")
    assert [r.text for r in pii.mask(df).orderBy("doc_id").collect()] == ["\U0001f600é <email>\u0301 xxxxxxxxxx <ip> \U0001f600", "<email>", ""]


def test_suspects_alone_are_shuffled(spark, monkeypatch):
    """The filter lets all suspects through, also where it is as small as it can be."""
    from pagemill.llm import common

    rows = [(i, f"text number {i // 2 if i < 200 else i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(exact_dedup.exact_duplicates(df).collect())
    assert sum(r.group_size == 2 for r in expected) == 200
    keys = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    everything = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    passed = common.filtered(everything, keys, "k")
    assert passed.join(keys, "k", "left_semi").count() == 100 and passed.count() < 200
    small = common.filtered(everything, everything.limit(15_000), "k", most=1)
    assert small.count() >= 15_000
    assert common.filtered(everything, keys.limit(0), "k").count() == 0


def test_toxicity_handles_odd_labels_and_rows(spark):
    good, bad = "kind words about the weather today", "awful nasty rude words and threats"
    docs = [(i, (bad if i % 3 == 0 else good) + f" {i % 7}") for i in range(120)] + [(500, None), (501, ""), (None, bad), (0, good), (502, "nasty " * 50_000)]
    labels = [(i, int(i % 3 == 0)) for i in range(100)] + [(0, 0), (3, None), (None, 1), (9999, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS pick", "2 AS labels", "3 AS fold")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    first = toxicity.toxicity(df, marks, ("toxic",)).collect()
    again = toxicity.toxicity(df.repartition(7), marks.repartition(3), ("toxic",)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == len(docs)
    flagged = {r.doc_id for r in first if r.flagged}
    assert set(range(3, 120, 3)) <= flagged and not flagged & {1, 2, 4, 500, 501}
    none = toxicity.toxicity(df, marks.limit(0), ("toxic",)).collect()
    assert all(r.p_toxic == 0 and not r.flagged for r in none)
    assert toxicity.toxicity(df.limit(0), marks, ("toxic",)).count() == 0


def test_quality_does_not_depend_on_partitions_or_ids(spark):
    rows = [(None, f"Some plain words of text number {i % 40}." if i % 4 else "!!%% $$ ## ||| " * (i % 5 + 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    totals = [sorted((r.fired, r.score) for r in quality.quality_scores(d, sample_rows=30).collect()) for d in (df, df.repartition(7))]
    assert totals[0] == totals[1]


def test_readings_equal_a_plain_count(spark):
    """Labellers and features over distinct words against a count word by word."""
    import re
    from collections import Counter

    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice(["word", "WORD!!", "|", "a_b", "$$%", "Mixed1", "ÄÖ", "12", "x" * 90, "same", "same"]) for _ in range(rng.randrange(1, 60)))
        words = text.split()
        shapes = [s for w in words for s in quality._folded(w)]
        n = len(words)
        odd = sum(any(c not in "aA0.,;:'\"()-?!’" for c in s) for s in shapes) / len(shapes)
        signs = sum(not (c.isalnum() or c.isspace() or c in ".,;:'\"()-?!") for c in text) / len(text)
        upper = sum(quality._folded(w)[0].startswith("A") and len(w) > 1 for w in words) / n
        same = sum(a == b for a, b in zip(words, words[1:])) / n
        again = 1 - sum(len(set(words[i:i + 128])) for i in range(0, n, 128)) / n
        tests = (odd > 0.25, signs > 0.05, upper > 0.25 and n > 3, sum(w.endswith("!!") for w in words) / n > 0.1, words.count("|") / n > 0.15, again > 0.5 and n > 8, same > 0.15 and n > 8)
        assert quality.fired(text) == sum(1 << k for k, t in enumerate(tests) if t)
        found = np.zeros(quality.DIM)
        for name, times in Counter([*shapes, *(f"{a} {b}" for a, b in zip(shapes, shapes[1:]))]).items():
            found[quality.bucket(name)] += times / len(shapes)
        found[quality.bucket(f"again {round(10 * again)}")] += 1
        assert np.allclose(quality.features(text), np.sqrt(found), atol=1e-5)


def test_stages_keep_columns_and_read_files_without_writing_them(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i % 5, f"A plain text about matter {i // 2} with words enough to be kept.", "en", "s", 1, 10 + i, 20 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, _key int")
    df.write.parquet(str(tmp_path / "docs"))
    docs, names = spark.read.parquet(str(tmp_path / "docs")), []
    monkeypatch.setattr(corpus_pipeline, "written", lambda d, name, original=corpus_pipeline.written: names.append(name) or original(d, name))
    for stage in (corpus_pipeline.drop_low_quality, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, "")
        assert out.columns == df.columns
        assert {(r["_row"], r["_key"]) for r in out.collect()} <= {(10 + i, 20 + i) for i in range(30)}
    assert set(names) == {"pipeline-rejected"} and corpus_pipeline.drop_copies(spark, docs, "").count() == 15
    assert corpus_pipeline.drop_copies(spark, df, "").count() == 15 and "pipeline-rows" in names
    for stage in (corpus_pipeline.drop_low_quality, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mask_private):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_words_are_coded_like_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.Words(path)
    rng = random.Random(1)
    parts = ["It's", "they'LL", "’tis", "Ünïcode", "naïve", "ǅ", "İstanbul", "ΑΣ", "e\u0301", "12³½", "--!'s", "\x1c", "\x85", "\xa0", "…", "€5", "<|endoftext|>", "<|", "日本", "\u0345", "ﬁ", "ß", "Ǆ", "_a_", "''s", "x" * 100, "\ud7ff", "ŉ", "µ", "ª"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n", "'"]) for _ in range(rng.randrange(12)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    for c in packing._PLAIN:
        for text in (f"a{chr(c)}b", f"{chr(c)}'s {chr(c)}"):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_small_batches_leave_the_session_as_it_was(spark):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 1000) AS text")

    def most():
        return max(r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect())

    assert most() == 4000
    with common.small_batches(spark, 1 << 18):
        assert most() < 1000
    assert spark.conf.get(key, None) is None and most() == 4000
    spark.conf.set(key, "8m")
    try:
        with common.small_batches(spark, 1 << 18):
            assert most() == 4000
        assert spark.conf.get(key) == "8m"
    finally:
        spark.conf.unset(key)


def test_words_are_kept_once_they_come_again(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "_KEPT_WORDS", 40)
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    first = own.coded([" ".join(f"w{'abcdefghij'[k % 10]}o{'abc'[k // 10]}" for k in range(30))])
    assert len(own) == 0
    assert own.coded([" ".join(f"w{'abcdefghij'[k % 10]}o{'abc'[k // 10]}" for k in range(30))]) == first and len(own) == 30
    own.coded(["some other words than these, in which few come back"] * 2)
    assert len(own) <= 40 and own.coded(["waoa wboa"]) == own.coded(["waoa wboa"])


def test_stages_hand_texts_over_in_small_batches(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    rows = [(k, f"The {k} quick foxes, and so on. " * 40, "en", "web", 1280) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs, seen = spark.read.parquet(str(tmp_path / "docs")), []
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    for module in (simhash, packing):
        monkeypatch.setattr(module, "written", lambda d, n, original=module.written: seen.append(spark.conf.get(limit, None)) or original(d, n))
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() and corpus_pipeline.pack(spark, docs, "").count() == 60
    assert len(seen) > 1 and None not in seen and spark.conf.get(limit, None) is None


def test_plain_words_need_no_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    library, own = Tokenizer.from_file(path), packing.Words(path)
    own._library = None
    texts = ["", " ", "\xa0 ", " led by blanks", "\n", "'", "''s", "don't'll've", "x'they 's't", "a1²½'re", "é'É", *(f"{chr(c)}a{chr(c)}{chr(c)}'s" for c in packing._PLAIN)]
    texts += ["".join(rng.choices("etaoinshrdlu ÉÑß'’.,-1€\xa0", k=rng.randrange(200))) for _ in range(400)]
    want = [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(3):  # the third time from the words kept
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.coded(texts)] == want
        rng.shuffle(order := list(range(len(texts))))
        texts, want = [texts[k] for k in order], [want[k] for k in order]
    assert own.coded([]) == [] and len(own)


def test_pairs_found_by_hash():
    from pagemill.llm.merges import HashedPairs

    rng = np.random.default_rng(6)
    made, symbols = {}, [(k,) for k in range(20)]
    while len(symbols) < 3000:
        a, b = (int(x) for x in rng.integers(len(symbols), size=2) ** 2 // len(symbols))
        if (a, b) not in made and len(symbols[a] + symbols[b]) < 7 and symbols[a] + symbols[b] not in symbols:
            made[a, b] = len(symbols)
            symbols.append(symbols[a] + symbols[b])
    pairs = HashedPairs(made)
    rows = rng.integers(0, 20, (500, 9))
    ids, sizes = pairs.merge(rows.copy())
    for row, found, size in zip(rows.tolist(), ids.tolist(), sizes.tolist()):
        while (ranked := [(made[p], k) for k, p in enumerate(zip(row, row[1:])) if p in made]):
            number, k = min(ranked)
            row[k:k + 2] = [number]
        assert found[:size] == row
    try:
        HashedPairs({(0, 1): 5, (1, 2): 4})
    except ValueError:
        return
    raise AssertionError("merges out of order were taken")
