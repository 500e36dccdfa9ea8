"""Vector near-duplicates and packing against brute force."""

import math

import numpy as np
import public_tokenizers

from pagemill.llm import embedding_dedup, packing


def _brute(rows, threshold=0.98):
    good = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    n, links, root = len(rows), [0] * len(rows), [r[0] for r in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2]:
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    pairs.append((i, j))
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in range(n):
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    return {r[0]: (links[k], root[k], r[0] == root[k]) for k, r in enumerate(rows)}


def test_vectors(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16))
    rows = []
    for k in range(420):
        group = 0 if k % 3 == 0 else int(rnd.integers(12))  # a third of all rows around one centre
        spread = float(rnd.choice([0, 0.05, 0.12, 0.2]))
        rows.append((k * 7 % 421, (centres[group] * float(rnd.choice([1, 3])) + spread * rnd.normal(size=16)).astype(np.float32).tolist(), int(k % 5 == 0)))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, centres[0].tolist(), None), (1005, [], 1)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    rows = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows]
    want = _brute(rows)
    assert sum(w[0] for w in want.values()) > 1000
    for tile in (1024, 16):
        got = embedding_dedup.near_duplicate_vectors(table, tile_rows=tile, list_rows=32)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == want
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_bounds_and_best_fit():
    rnd = np.random.default_rng(1)
    for _ in range(40):
        lengths = rnd.integers(1, 60, rnd.integers(1, 80))
        where, offset = packing.best_fit(lengths, 64)
        assert packing.lower_bound(lengths, 64) <= where.max() + 1
        for b in range(where.max() + 1):
            own = np.flatnonzero(where == b)
            own = own[np.argsort(offset[own])]
            assert lengths[own].sum() <= 64 and offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]
    assert packing.lower_bound(np.array([40, 40, 40]), 64) == 3


def test_packing(spark):
    rnd = np.random.default_rng(2)
    rows = [(int(i) if i % 50 else None, " ".join(["word"] * int(n)), "x") for i, n in enumerate(rnd.integers(0, 90, 600))] + [(7, None, "x"), (7, None, "x"), (8, "one " * 5000, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for part in (4096, 40):
        out = packing.pack_documents(table, path, 64, part_rows=part).toPandas()
        assert sorted(out.length) == sorted(packing.pieces(table, path, 64).toPandas().length)
        for _, held in out.sort_values("offset").groupby("sequence_id"):
            assert held.length.sum() <= 64 and held.offset.tolist() == [0, *np.cumsum(held.length)[:-1].tolist()]
        assert out.sequence_id.nunique() <= 1.05 * packing.lower_bound(out.length.to_numpy(), 64)
    assert packing.pack_documents(table.limit(0), path).count() == 0


def test_packing_many_partitions(spark):
    for length in ("1 + id % 8", "1"):
        cut = spark.range(30_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"CAST({length} AS long) AS length", "0L AS ids_crc32")
        out = packing.pack(cut, 64, part_rows=200).toPandas()
        assert sorted(out.doc_id) == list(range(30_000)) and (out.groupby("sequence_id").length.sum() <= 64).all()
        for _, held in out.sort_values("offset").groupby("sequence_id"):
            assert held.offset.tolist() == [0, *np.cumsum(held.length)[:-1].tolist()]
        assert out.sequence_id.nunique() <= packing.lower_bound(out.length.to_numpy(), 64) + 1
