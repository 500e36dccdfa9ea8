"""Near-duplicate vectors by product quantisation.

Unit vectors are put into coarse inverted lists by their nearest centre; what
is left of them is coded by subspace codebooks.  A vector looks into every list
that can hold a vector within the threshold: its distance to the plane between
two centres bounds that.  Inside a list, distances to the codes come from a
lookup table; the stored coding error of each entry makes the test safe, so
nothing within the threshold is lost.  What passes is compared by exact cosine.

Lists are compared in tiles of bounded size.  A tile yields counts and links
enough to connect what its pairs connect, never all pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pagemill.llm.components import components
from pagemill.session import written

_PARTS, _CODES = 8, 64
_SLACK = 1e-6


def _kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    centres = np.random.default_rng(seed).permutation(distinct)[:k].copy()
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(1)
        for j in np.unique(nearest):
            centres[j] = points[nearest == j].mean(0)
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1))


class Quantiser:
    """Coarse centres and, for each subspace of the residuals, a codebook."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        self.centres = _kmeans(sample, lists, seed)
        residual = sample - self.centres[_squares(sample, self.centres).argmin(1)]
        self.slots = np.array_split(np.arange(sample.shape[1]), min(_PARTS, sample.shape[1]))
        self.books = [_kmeans(residual[:, s], _CODES, seed + 1 + k) for k, s in enumerate(self.slots)]
        self.gaps = np.sqrt(_squares(self.centres, self.centres))

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        home = _squares(points, self.centres).argmin(1)
        residual = points - self.centres[home]
        codes = np.stack([_squares(residual[:, s], b).argmin(1) for s, b in zip(self.slots, self.books)], 1).astype(np.uint8)
        near = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return home, codes, np.sqrt(((residual - near) ** 2).sum(1))

    def probes(self, points: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius`` of each point."""
        squares = _squares(points, self.centres)
        home = squares.argmin(1)
        gap = np.maximum(self.gaps[home], 1e-12)
        far = (squares - squares[np.arange(len(points)), home][:, None]) / (2 * gap)
        far[np.arange(len(points)), home] = 0
        return far <= radius + _SLACK

    def distances(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the codes of a list, by table lookup."""
        residual = queries - self.centres[home]
        out = np.zeros((len(queries), len(codes)))
        for k, (slot, book) in enumerate(zip(self.slots, self.books)):
            out += _squares(residual[:, slot], book)[:, codes[:, k]]
        return np.sqrt(out)


def _unit(vectors, dim: int) -> np.ndarray:
    points = np.array(vectors, np.float64).reshape(-1, dim)
    return points / np.sqrt((points * points).sum(1))[:, None]


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
    sample_rows: int = 20_000, list_rows: int = 512, most_lists: int = 1024, tile_rows: int = 1024,
) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, ``n_links``, ``component_id`` and ``kept`` (its id is the smallest of its component).

    Only vectors with equal labels and equal sizes are compared.  Null labels, and vectors that
    are null, empty, zero or hold null or non-finite components, link with
    nothing: no links, a component of their own.  Equal vectors are compared
    once and counted as often as they occur.  Null ids are not counted as smallest.

    The quantiser is fitted on at most ``sample_rows`` vectors; every vector is
    entered and every list that can matter is probed.
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    plain = F.transform(vector, lambda x: x + F.lit(0.0))
    rows = df.select(F.col(id_col).alias("id"), F.when(fine, F.struct(F.col(label_col).cast("string").alias("label"), F.size(vector).alias("dim"), plain.alias("v"))).alias("c"))
    rows = written(rows.withColumn("class", F.when(F.col("c").isNotNull(), F.sha2(F.to_json("c"), 256))), "pq-rows")
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = written(classes.select("class", "c.*", "n", "least", F.monotonically_increasing_id().alias("node")), "pq-classes")
    links = None
    kind = "<f4" if df.schema[vector_col].dataType.elementType == FloatType() else "<f8"  # as exact as the column itself
    for found in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        part = written(_compared(classes.filter(F.col("dim") == found), found, threshold, sample_rows, list_rows, most_lists, tile_rows, kind), "pq-links")
        links = part if links is None else links.unionByName(part)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("m"))
    roots = components(links.filter("b IS NOT NULL").select("a", "b"))
    named = classes.select("class", "node", "n", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = named.join(names, "root").select("class", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "class").join(facts, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _compared(classes: DataFrame, dim: int, threshold: float, sample_rows: int, list_rows: int, most_lists: int, tile_rows: int, kind: str) -> DataFrame:
    """``(a, b, m)``: links between classes, and with null ``b`` how many rows of other classes (part ``m``) class ``a`` links to."""
    count = classes.count()
    sample = _unit([r["v"] for r in classes.orderBy("class").limit(sample_rows).select("v").collect()], dim)
    quantiser = Quantiser(sample, max(1, min(most_lists, len(sample) // 16 + 1, math.ceil(count / list_rows / 4))))
    held = classes.sparkSession.sparkContext.broadcast(quantiser)
    radius = math.sqrt(2 - 2 * threshold)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as an entry of its list and as a query of every list it probes."""
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                if not part.num_rows:
                    continue
                vectors = np.array(part.column("v").to_pylist(), np.float64).reshape(-1, dim)
                points = _unit(vectors, dim)
                home, codes, error = held.value.encode(points)
                at, to = np.nonzero(held.value.probes(points, radius))
                row = np.concatenate([np.arange(len(points)), at])
                entry = np.arange(len(row)) < len(points)
                taken = part.select(["label", "node", "n"]).take(pa.array(row))
                raw = [v.tobytes() for v in vectors.astype(kind)]
                blob = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays([
                    taken.column("label"), pa.array(np.concatenate([home, to]), pa.int32()), taken.column("node"), taken.column("n"), pa.array([raw[i] for i in row.tolist()], pa.binary()), pa.array(entry),
                    pa.array([*blob, *[None] * len(at)], pa.binary()), pa.array(np.concatenate([error, np.zeros(len(at))])),
                ], ["label", "list", "node", "n", "v", "entry", "code", "error"])

    entered = classes.select("label", "node", "n", "v").mapInArrow(enter, "label string, list int, node long, n long, v binary, entry boolean, code binary, error double")
    sizes = entered.groupBy("label", "list").agg(F.sum(F.col("entry").cast("int")).alias("entries"), F.sum((~F.col("entry")).cast("int")).alias("queries"))
    sizes = sizes.select("label", "list", F.ceil(F.col("entries") / tile_rows).cast("int").alias("rows"), F.ceil(F.col("queries") / tile_rows).cast("int").alias("columns")).filter("rows > 0")
    placed = entered.join(sizes, ["label", "list"])
    mixed = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    tiles = placed.withColumn("i", F.explode(F.when(F.col("entry"), F.array(F.pmod(mixed, F.col("rows")).cast("int"))).otherwise(every("rows"))))
    tiles = tiles.withColumn("j", F.explode(F.when(F.col("entry"), every("columns")).otherwise(F.array(F.pmod(mixed, F.greatest("columns", F.lit(1))).cast("int"))))).drop("rows", "columns")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        entries, queries = tile[tile.entry], tile[~tile.entry]
        if entries.empty or queries.empty:
            return pd.DataFrame({"a": [], "b": [], "m": []}).astype({"a": "int64", "b": "Int64", "m": "int64"})
        codes = np.frombuffer(b"".join(entries.code), np.uint8).reshape(len(entries), -1)
        stored, asked = (np.frombuffer(b"".join(side.v), kind).reshape(-1, dim).astype(np.float64) for side in (entries, queries))
        stored_norm, asked_norm = np.sqrt((stored * stored).sum(1)), np.sqrt((asked * asked).sum(1))
        units = asked / asked_norm[:, None]
        e_node, q_node, times = entries.node.to_numpy(), queries.node.to_numpy(), entries.n.to_numpy()
        close = held.value.distances(units, int(tile["list"].iloc[0]), codes) <= radius + entries.error.to_numpy() + _SLACK
        close &= q_node[:, None] != e_node
        at, to = np.nonzero(close)
        exact = np.zeros(len(at), bool)
        for s in range(0, len(at), 1 << 16):
            a, b = at[s:s + (1 << 16)], to[s:s + (1 << 16)]
            exact[s:s + (1 << 16)] = (asked[a] * stored[b]).sum(1) / (asked_norm[a] * stored_norm[b]) >= threshold
        at, to = at[exact], to[exact]
        linked = np.bincount(at, times[to], minlength=len(queries)).astype(np.int64)
        some = linked > 0
        pairs = _spanning(q_node[at], e_node[to])
        return pd.DataFrame({
            "a": np.concatenate([q_node[some], pairs[:, 0]]), "b": pd.array([*[None] * int(some.sum()), *pairs[:, 1].tolist()], "Int64"),
            "m": np.concatenate([linked[some], np.zeros(len(pairs), np.int64)]),
        })

    return tiles.groupBy("label", "list", "i", "j").applyInPandas(compare, "a long, b long, m long")


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that connect what the given links connect, fewer than there are nodes: smallest labels spread until they stand."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]], 1) if len(nodes) else np.zeros((0, 2), np.int64)
