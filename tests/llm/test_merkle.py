"""The manifest against plain Python that hashes level by level."""

import hashlib
import random
import zlib

import pytest

from pagemill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(doc):
    parts = []
    for value in doc:
        text = None if value is None else str(value)
        parts.append("-" if text is None else f"{len(text.encode())}:{text}")
    return _hash("".join(parts))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
    return levels


def _path(levels, at):
    """The run and the place in it, level by level."""
    steps = []
    for level in levels[:-1]:
        start = at - at % 16
        steps.append((level[start:start + 16], at % 16))
        at //= 16
    return steps


def _brute(docs):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    groups = {}
    for doc_id, text, lang, source, n_chars in docs:
        leaf = _leaf((doc_id, source, lang, n_chars, text))
        lowered = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        other = _leaf((doc_id, source, lang, n_chars, lowered)) if hit else leaf
        key = (source is not None, (source or "").encode())
        groups.setdefault(key, []).append(((doc_id is not None, doc_id or 0), leaf, doc_id, other))
    trees = {key: _levels([leaf for _, leaf, _, _ in sorted(rows, key=lambda r: r[:2])]) for key, rows in groups.items()}
    top = _levels([trees[key][-1][0] for key in sorted(trees)])
    rows = []
    for place, key in enumerate(sorted(trees)):
        for at, (_, leaf, doc_id, other) in enumerate(sorted(groups[key], key=lambda r: r[:2])):
            steps = _path(trees[key], at) + _path(top, place)
            proof = _hash("".join("".join(run[:i] + run[i + 1:]) for run, i in steps))
            node = other
            for run, i in steps:
                node = _hash("".join([*run[:i], node, *run[i + 1:]]))
            root = top[-1][0]
            rows.append((doc_id, leaf, trees[key][-1][0], root, proof, node, node == root))
    return rows


def _same(spark, docs):
    made = merkle.verification(spark.createDataFrame(docs, SCHEMA).repartition(5))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, _brute(docs)))


@pytest.mark.parametrize("counts", [(1,), (2, 1), (16, 17), (256, 257, 15), (700, 4500, 1)])
def test_trees_of_many_heights(spark, counts):
    rng = random.Random(sum(counts))
    docs = []
    for source, count in enumerate(counts):
        docs += [(rng.randrange(10**6), rng.choice(["Äb C", "plain", "", None, "A" * 50]), rng.choice(["en", None]), f"s{source}", 3) for _ in range(count)]
    _same(spark, docs)


def test_many_groups_need_a_tree_of_their_own(spark):
    _same(spark, [(i, f"Text {i}", "en", f"{'é' if i % 2 else 'z'}{i % 300}", i) for i in range(900)])


def test_null_and_repeated_rows(spark):
    docs = [(None, "A", None, None, None)] * 40 + [(None, None, None, None, None)] * 3 + [(7, "A B", "en", "", 1)] * 300 + [(7, "a", "en", "", 1), (8, None, "en", None, 2)]
    _same(spark, docs)


def test_empty_table(spark):
    assert merkle.verification(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_do_not_matter(spark):
    docs = [(i, f"T{i}", "en", f"s{i % 2}", i) for i in range(40)]
    plain = spark.createDataFrame(docs, SCHEMA)
    extra = plain.selectExpr("*", "1 AS tree", "2 AS node", "3 AS place", "4 AS path", "5 AS tampered", "6 AS id", "7 AS total")
    assert sorted(merkle.verification(extra).collect()) == sorted(merkle.verification(plain).collect())


def test_only_some_levels_are_stored(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    made = merkle.manifest(docs)
    assert [level.count() for level in made.groups.levels] == [5000, 20, 1]  # 313 and 2 are made again for proofs
    path = merkle.proofs(made).filter("id = 4999").first()["path"]
    assert [len(step["before"] + step["after"]) // 64 for step in path] == [7, 8, 3, 1]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = merkle.verification(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(_brute([tuple(r) for r in docs.collect()]))
    assert 0 < sum(not r["verified"] for r in rows) < len(rows) / 4
