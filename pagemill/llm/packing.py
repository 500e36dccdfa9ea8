"""Best-fit packing of token pieces, with bounds that say when a partition needs no more work.

Pieces are dealt over partitions of bounded size, and each is packed by
best-fit decreasing.  Dual feasible functions give a lower bound on its bins.
A partition that meets its bound is certified and final but for its least
filled bin.  The others keep what is filled to the brim.  These bins and the
rest go to new partitions, mixed anew, and are packed again; what is given up
comes back in no more bins, or the earlier packing stays.  This ends with one
partition, or after a fixed number of rounds.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm.common import slices, takes_over, text_of
from pagemill.llm.merges import HashedPairs
from pagemill.session import written

_PACKED = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long, part long, round int, bin int, offset long, bins int, bound int, room long, last boolean"


# Characters below U+0180 and common punctuation, for which lower case and word
# classes are the same everywhere and normalisation changes nothing; control
# characters and the dotted capital I are left to the library.
_PLAIN = [*range(9, 14), *range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), 0x20AC]
_BLANK = (*range(9, 14), 0x20, 0xA0)
_KEPT_WORDS, _LONGEST_KEPT = 1 << 18, 64
_MARKS = 1 << 22
# Words of up to so many bytes are merged together, filled up with a symbol that no pair has; longer ones go to the library.
_WIDTHS, _NO_SYMBOL = (4, 6, 8, 10, 12, 16, 24, 48), (1 << 31) - 1
_END = "</w>"


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself, if it is printed, or else the next free one from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in printed else next(free)) for b in range(256)]


_SPACE, _LETTER, _NUMBER, _SIGN, _ODD = range(5)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Words(dict):
    """Token ids of words, as little-endian bytes, made once and kept, as most words of a text came before.

    The vocabulary cuts lower-cased text into words, each encoded alone.  Texts
    of plain characters are cut here, all of a slice at once, and each different
    word is looked up once.  The bytes of new words are merged by the library's
    own list of merges, many words at once.  All other texts, and those that
    hold a special string, go to the library whole, as do very long words.  A
    word is kept from the second slice on that has it, as most words never come
    again: the first leaves a mark at its hash.  Words are kept in two
    generations: what is used again moves to the young one, and when that is
    full the old one goes.
    """

    def __init__(self, path: str) -> None:
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        model = json.loads(self._library.to_str())["model"]
        number = model["vocab"]
        self._pairs = HashedPairs({(number[a], number[b]): number[a + b] for a, b in model["merges"]})
        signs = _byte_signs()
        self._within = np.array([number[sign] for sign in signs], np.int64)
        self._last = np.array([number[sign + _END] for sign in signs], np.int64)
        self._old: dict[str, bytes] = {}
        self._marks = bytearray(_MARKS)
        plain = "".join(re.escape(chr(c)) for c in _PLAIN)
        self._other = re.compile(f"[^{plain}]|<\\|").search
        # By code point: kind, lower case and bytes; the last stands for all above.
        size = max(_PLAIN) + 2
        self._kinds = np.full(size, _ODD, np.uint8)
        self._lower = np.arange(size, dtype="<u4")
        for c in _PLAIN:
            self._kinds[c] = _SPACE if c in _BLANK else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SIGN)
            self._lower[c] = ord(chr(c).lower())
        self._widths = np.array([1] * 0x80 + [2] * 0x780 + [3] * (size - 0x800), np.int32)

    def _library_ids(self, texts: list[str]) -> Iterator[bytes]:
        for coded in self._library.encode_batch_fast(texts, add_special_tokens=False):  # leaves out the places in the text
            yield np.array(coded.ids, "<u4").tobytes()

    def _word_ids(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Plain words, each with its ids: those of about one length are merged together."""
        raws = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        long = np.flatnonzero(sizes > _WIDTHS[-1])
        yield from zip([words[k] for k in long], self._library_ids([words[k] for k in long]))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        symbols = self._within[raw]
        symbols[ends - 1] = self._last[raw[ends - 1]]
        symbols = np.append(symbols, np.full(_WIDTHS[-1], _NO_SYMBOL))
        for narrower, width in zip((0, *_WIDTHS), _WIDTHS):
            group = np.flatnonzero((sizes > narrower) & (sizes <= width))
            rows = symbols[(ends - sizes)[group, None] + np.arange(width)]
            spare = width - sizes[group]
            rows[np.arange(width) >= sizes[group, None]] = _NO_SYMBOL
            ids, left = self._pairs.merge(rows)
            blob = ids.astype("<u4").tobytes()
            for k, a, size in zip(group.tolist(), range(0, len(blob), 4 * width), (4 * (left - spare)).tolist()):
                yield words[k], blob[a:a + size]

    def _keep(self, made: dict[str, bytes], met: dict[str, bytes]) -> None:
        """Keep the words that an earlier slice had as well, ``met`` among them."""
        marks, again = self._marks, list(met)
        for word in made:
            mark = hash(word) % _MARKS
            if not marks[mark]:
                marks[mark] = 1
            elif len(word) <= _LONGEST_KEPT:
                again.append(word)
        if len(self) + len(again) > _KEPT_WORDS:
            self._old, self._marks = dict(self), bytearray(_MARKS)
            self.clear()
        self.update((word, met.get(word) or made[word]) for word in again)

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of plain words, all different."""
        found = list(map(self.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        met = {w: ids for w in new if (ids := self._old.get(w)) is not None}
        made = dict(self._word_ids([w for w in new if w not in met]))
        self._keep(made, met)
        made |= met
        return [made[w] if ids is None else ids for w, ids in zip(words, found)]

    def _edges(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where words and runs of blanks begin in lower-cased code points that end with a blank, and the end."""
        before = np.append(np.uint8(_SPACE), kinds[:-1])
        edges = (kinds != before) | (kinds == _NUMBER)
        edges[0] = True
        quotes = np.flatnonzero((points == ord("'")) & (before != _SIGN))
        far = np.append(points, [0, 0])
        for ending in _ENDINGS:
            hit = quotes[far[quotes + 1] == ord(ending[0])]
            if len(ending) == 2:
                hit = hit[far[hit + 2] == ord(ending[1])]
            edges[hit + 1] = False
            edges[hit + 1 + len(ending)] = True
        return np.append(np.flatnonzero(edges), len(points))

    def coded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not texts:
            return []
        joined = "\n".join([*texts, ""])
        points = np.minimum(np.frombuffer(joined.encode("utf-32-le"), "<u4"), len(self._kinds) - 1)
        kinds = self._kinds[points]
        if (kinds == _ODD).any() or "<|" in joined:
            whole = [t for t in texts if self._other(t)]
            by_library = dict(zip(whole, self._library_ids(whole)))
            own = iter(self.coded([t for t in texts if t not in by_library]))
            return [by_library[t] if t in by_library else next(own) for t in texts]
        points = self._lower[points]
        edges = self._edges(points, kinds)
        places = np.append(0, np.cumsum(self._widths[points], dtype=np.int32))[edges]
        parts = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
        parts = parts.dictionary_encode()  # each different word is looked up once
        different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        words = [w for w in different if not w.isspace()]
        ids = dict(zip(words, self._ids_of(words)))
        coded = pa.array([ids.get(w, b"") for w in different], pa.large_binary()).take(parts.indices)
        _, ends, blob = coded.buffers()
        ends = np.frombuffer(ends, np.int64)[:len(edges)]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = ends[np.searchsorted(edges, np.append(0, text_ends))].tolist()
        blob = memoryview(blob) if blob else b""
        return [bytes(blob[a:b]) for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coded([text])[0], "<u4").tolist()


@functools.lru_cache(2)
def _words(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    return Words(path)


def pieces(df: DataFrame, path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids, ``end_id`` last, cut into pieces of ``size``: ``doc_id, piece, start, length, ids_crc32``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("packing", _words.cache_clear)
        own = _words(path)
        for batch in slices(batches, limit=1 << 20):
            made = []
            for doc, coded in zip(batch.column("doc_id").to_pylist(), own.coded(batch.column("text").to_pylist())):
                ids = np.append(np.frombuffer(coded, "<u4"), np.array([end_id], "<u4"))
                made += [(doc, k, s, len(ids[s:s + size]), zlib.crc32(ids[s:s + size].tobytes())) for k, s in enumerate(range(0, len(ids), size))]
            columns = list(zip(*made))
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs, by dual feasible functions: for each cut-off, pieces above its complement count whole, those below it nothing."""
    if not len(lengths):
        return 0
    best = -(-int(lengths.sum()) // size)
    counts = np.bincount(lengths, minlength=size + 1)
    many, mass = np.cumsum(counts), np.cumsum(counts * np.arange(size + 1))
    for low in range(1, size // 2 + 1):
        large = int(many[size] - many[size - low])
        middle = int(mass[size - low] - mass[low - 1])
        best = max(best, large + -(-middle // size))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each piece.  Rooms are kept in a bit set, so the tightest fit is its lowest bit."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    present, bins = 0, 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = present >> need
        if fits:
            room = need + ((fits & -fits).bit_length() - 1)
            chosen = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, chosen, bins = size, bins, bins + 1
        where[i], offset[i] = chosen, size - room
        if room > need:
            rooms[room - need].append(chosen)
            present |= 1 << (room - need)
    return where, offset


def pack(cut: DataFrame, size: int = 4096, part_rows: int = 4096, rounds: int = 6, least_bins: int = 64) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset`` for each piece, and ``certified``: its partition met its bound.

    A partition holds about ``part_rows`` pieces whatever the size of the table,
    or more where these would not fill ``least_bins`` sequences.  There are at
    most ``rounds`` rounds; after the last, a partition may keep a bin that is
    partly filled.
    Pieces are dealt by place, not by value, so repeated rows spread.  An empty
    table gives no sequences.
    """
    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = _PACKED.format(kind=kind)
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    full = rows.filter(F.col("length") == size).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.lit(-1).alias("round"), F.col("row").alias("part"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"),
    )
    final, open_rows, number = [full], rows.filter(F.col("length") < size).withColumns({"was": F.lit(0).cast("long")}), 0
    bins_before = None

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        lengths = group.length.to_numpy()
        where, offset = best_fit(lengths, size)
        held = np.bincount(where, weights=lengths).astype(np.int64)
        made = group.assign(bin=where, offset=offset, bins=len(held), bound=lower_bound(lengths, size), room=size - held[where], last=where == held.argmin())
        return made[[c.split()[0] for c in schema.split(", ")]]

    while True:
        count, mass = open_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if count == 0:
            break
        parts = max(1, min(math.ceil(count / part_rows), math.ceil(mass / (least_bins * size))))
        dealt = open_rows.drop("was").withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts))).withColumn("round", F.lit(number))
        packed = written(dealt.groupBy("part").applyInPandas(fill, schema), "pack-round")
        tally = packed.select("part", "bins").distinct().agg(F.sum("bins").alias("bins")).first()
        sure = F.col("bins") == F.col("bound")
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "round", "part", "bin", "offset"]
        worse = bins_before is not None and tally["bins"] >= bins_before[0]
        if worse:  # the exchange gained nothing: the packing before it stays
            final.append(bins_before[1].select(*names, sure.alias("certified")))
            break
        again = (F.col("room") > 0) & (~sure | F.col("last"))
        loose, settled = packed.filter(again), packed.filter(~again)
        if parts == 1 or number + 1 >= rounds:
            final.append(packed.select(*names, sure.alias("certified")))
            break
        final.append(settled.select(*names, sure.alias("certified")))
        left = loose.select("part", "bin").distinct().count()
        bins_before = (left, loose)
        open_rows = loose.select("doc_id", "piece", "start", "length", "ids_crc32", "row", F.lit(0).cast("long").alias("was"))
        number += 1
    out = functools.reduce(DataFrame.unionByName, final)
    sequence = F.when(F.col("round") < 0, F.col("part") * 8).otherwise(((F.col("part") * (1 << 20) + F.col("bin")) * 8) + F.col("round") + 1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), "offset", "certified")


def pack_documents(df: DataFrame, path: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pieces of all rows, packed.  A null text counts as empty: one piece, which holds the end id alone."""
    packed = pack(pieces(df, path, size, id_col=id_col, text_col=text_col), size, **options)
    return packed.withColumnRenamed("doc_id", id_col)
