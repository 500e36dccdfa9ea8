"""Byte-level BPE: pre-tokenisation by scans over code-point classes, cached pair merging, decoding.

Every code point has a class, and with the class of what follows it a symbol.
A symbol is a function from state to state of a small automaton whose states
say what piece is open.  Functions compose associatively, so the state before
each code point comes from a scan in blocks: inside all blocks at once, then
over the blocks' composed functions.  A piece begins where the pair of state
and symbol says so.  No regular expression is involved.

The pieces' places are kept, so ids decode piece by piece as well as whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices, text_of
from pagemill.llm.merges import Pairs, merge

# Unicode white space, and the endings that an apostrophe takes with it.
_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# Classes and symbols.  A symbol from _FIRST on begins a text.
_LETTER, _NUMBER, _OTHER, _QUOTE1, _QUOTE2, _LAST_BLANK, _LAST_SPACE, _SPACE = range(8)
_FIRST = 8
# States: nothing open; a run of letters, numbers, others, white space; a blank that joins what follows; one or two letters of an ending to come.
_NONE, _LETTERS, _NUMBERS, _OTHERS, _SPACING, _JOINING, _ONE_MORE, _TWO_MORE = range(8)
_CACHE = 1 << 18
_BLOCK = 256
_TOGETHER = 48  # pieces of more bytes are merged one by one, with a heap
_BYTES = [bytes([i]) for i in range(256)]


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, by the Unicode properties that the vocabulary's library goes by."""
    every = "".join(chr(p) if not 0xD800 <= p < 0xE000 else "\x00" for p in range(0x110000))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for name, kind in (("L", _LETTER), ("N", _NUMBER)):
        for run in regex.finditer(rf"\p{{{name}}}+", every):
            kinds[run.start():run.end()] = kind
    kinds[list(_SPACES)] = _SPACE
    return kinds


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]`` is the next state; ``cut[symbol, state]`` says that a piece begins."""
    step, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for state in range(8):
        for symbol, run in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_OTHER, _OTHERS), (_SPACE, _SPACING)):
            step[symbol, state] = run
            cut[symbol, state] = not (state == run or (state == _JOINING and symbol != _SPACE))
        for symbol, after in ((_QUOTE1, _ONE_MORE), (_QUOTE2, _TWO_MORE)):
            goes_on = state in (_OTHERS, _JOINING)
            step[symbol, state], cut[symbol, state] = (_OTHERS, False) if goes_on else (after, True)
        for symbol, after in ((_LAST_BLANK, _JOINING), (_LAST_SPACE, _NONE)):
            step[symbol, state], cut[symbol, state] = after, True
    step[_LETTER, _ONE_MORE], cut[_LETTER, _ONE_MORE] = _NONE, False
    step[_LETTER, _TWO_MORE], cut[_LETTER, _TWO_MORE] = _ONE_MORE, False
    step[_FIRST:], cut[_FIRST:] = step[:8, _NONE][:, None], True
    return step, cut


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    kinds = _classes()[points]
    ahead = np.append(kinds[1:], _SPACE)
    ahead[firsts[1:] - 1] = _SPACE  # white space at the end of a text is one piece
    symbols = kinds.copy()
    last = (kinds == _SPACE) & (ahead != _SPACE)
    symbols[last] = np.where(points[last] == 32, _LAST_BLANK, _LAST_SPACE)
    quotes = np.flatnonzero(points == ord("'"))
    ends = np.append(firsts[1:], len(points))[np.searchsorted(firsts, quotes, "right") - 1]
    far = np.append(points, [0, 0])
    for ending in _ENDINGS:
        hit = (far[quotes + 1] == ord(ending[0])) & (quotes + len(ending) < ends)
        if len(ending) == 2:
            hit &= far[quotes + 2] == ord(ending[1])
        symbols[quotes[hit]] = _QUOTE1 if len(ending) == 1 else _QUOTE2
    symbols[firsts] += _FIRST
    return symbols


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of texts laid end to end, which begin at ``firsts`` (none empty)."""
    step, cut = _automaton()
    symbols = _symbols(points, firsts)
    rows = -(-len(symbols) // _BLOCK)
    grid = np.zeros(rows * _BLOCK, np.uint8)
    grid[: len(symbols)] = symbols
    grid = grid.reshape(rows, _BLOCK)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in range(_BLOCK):
        maps = step[grid[:, column, None], maps]
    span = 1
    while span < rows:  # prefix scan: each map is composed with what lies before it
        maps[span:] = np.take_along_axis(maps[span:], maps[:-span], 1)
        span *= 2
    state = np.append(np.uint8(_NONE), maps[:-1, _NONE])
    found = np.empty(grid.shape, bool)
    for column in range(_BLOCK):
        found[:, column] = cut[grid[:, column], state]
        state = step[grid[:, column], state]
    return np.flatnonzero(found.ravel()[: len(symbols)])


@dataclass
class Encoded:
    """Ids of one text; piece ``k`` begins at code point ``starts[k]`` and has ``ids[at[k]:at[k + 1]]``."""

    ids: np.ndarray
    starts: np.ndarray
    at: np.ndarray


class ByteBpe:
    """Encodes and decodes by a rank file.  The pieces of many texts that were not met before are merged together."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._pairs = Pairs(self.ranks)
        self._single = np.array([self.ranks[b] for b in _BYTES], np.int64)
        # Ids of pieces, as little-endian bytes, in two generations: what is used again moves to the young one.
        self.known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _coded(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece and its ids."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                yield piece, whole.to_bytes(4, "little")
            elif len(raw) > _TOGETHER:
                yield piece, np.array([self.ranks[p] for p in merge(list(map(_BYTES.__getitem__, raw)), self.ranks.get)], "<u4").tobytes()
            else:
                by_size.setdefault(len(raw), []).append((piece, raw))
        for size, group in by_size.items():
            rows = self._single[np.frombuffer(b"".join(raw for _, raw in group), np.uint8)].reshape(-1, size)
            ids, sizes = self._pairs.merge(rows)
            blob, ends = ids.astype("<u4").tobytes(), (4 * sizes).tolist()
            for k, (piece, _) in enumerate(group):
                yield piece, blob[4 * size * k:4 * size * k + ends[k]]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        found = list(map(self.known.get, pieces))
        new = {piece for piece, ids in zip(pieces, found) if ids is None}
        if not new:
            return found
        if len(self.known) + len(new) > _CACHE:
            self._old, self.known, new = self.known, {}, set(pieces)
        known, old = self.known, self._old
        known.update((piece, old[piece]) for piece in new if piece in old)
        known.update(self._coded([piece for piece in new if piece not in known]))
        found = list(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > 256:  # long pieces seldom come back
                del known[piece]
        return found

    def encode(self, texts: list[str]) -> Iterator[Encoded]:
        filled = [t for t in texts if t]
        sizes = np.fromiter(map(len, filled), np.int64, len(filled))
        firsts = np.cumsum(sizes) - sizes
        joined = "".join(filled)
        starts = piece_starts(np.frombuffer(joined.encode("utf-32-le"), "<u4"), firsts) if filled else np.zeros(0, np.int64)
        edges = [*starts.tolist(), len(joined)]
        coded = self._ids([joined[a:b] for a, b in zip(edges, edges[1:])])
        ids = np.frombuffer(b"".join(coded), "<u4")
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)])
        cuts = np.searchsorted(starts, np.append(firsts, len(joined))).tolist()
        k = 0
        for text in texts:
            if not text:
                yield Encoded(np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(1, np.int64))
                continue
            a, b = cuts[k], cuts[k + 1]
            yield Encoded(ids[at[a]:at[b]], starts[a:b] - firsts[k], at[a:b + 1] - at[a])
            k += 1

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``id_col``, ``ids`` and the pieces' places: ``starts`` in code points and ``at`` in the ids (one more entry).

    Null texts count as empty: no ids.  Repeated rows and null ids are rows like others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, limit=1 << 20):
            made = list(own.encode(batch.column("text").to_pylist()))
            columns = [pa.array([getattr(m, name) for m in made], pa.list_(kind)) for name, kind in (("ids", pa.int32()), ("starts", pa.int64()), ("at", pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "ids", "starts", "at"])

    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, starts array<long>, at array<long>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and the decoded ``text_bytes`` for each row of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            raw = [own.decode(np.array(ids, "<u4")) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(raw, pa.binary())], ["id", "ids", "text_bytes"])

    source = encoded.select(F.col(id_col).alias("id"), "ids")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, text_bytes binary").withColumnRenamed("id", id_col)


def coding_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the number of ids, and SHA-256 of the ids and of what they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, limit=1 << 20):
            made = [(len(e.ids), hashlib.sha256(e.ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(e.ids)).hexdigest()) for e in own.encode(batch.column("text").to_pylist())]
            n, ids, decoded = (list(c) for c in zip(*made))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
