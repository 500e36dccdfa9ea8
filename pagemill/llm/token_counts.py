"""Token counts by cached merging of segments, without making the tokens.

A merge never joins two characters that stand side by side in no entry of the
vocabulary, so a text falls apart at such pairs, and its count is the sum over
the segments.  A segment is counted by merging when first met, and its count is
kept if it has up to 64 characters.  No states or transitions are compiled from
the merge table: the state is the open segment itself.

A chunk of text is then a function from states to states, kept as a triple:
what it adds to the open segment, the count emitted after, and the segment it
leaves open.  Triples compose associatively, so chunks are counted on their
own and joined by a prefix scan; a text of any length needs only its chunks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices, text_of
from pagemill.llm.merges import merge

_CHUNK = 1 << 16
_CACHE = 1 << 18


@dataclass
class ChunkMap:
    """``open + head`` closes (if ``cuts``), ``count`` tokens follow, ``tail`` stays open; without cuts only ``head`` is added."""

    head: str
    count: int = 0
    tail: str = ""
    cuts: bool = False


class Transducer:
    """Counts of a BPE vocabulary with byte fallback, blanks as U+2581 and one before the text."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        letters = sorted({ord(c) for piece in self.rank for c in piece})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.held = np.zeros((len(letters) + 1,) * 2, bool)
        for piece in self.rank:
            at = self.letter[[ord(c) for c in piece]]
            self.held[at[:-1], at[1:]] = True
        self.counts: dict[str, int] = {}

    def count(self, segment: str) -> int:
        """Tokens of a segment; a character that is no token itself falls back to its bytes."""
        if len(segment) > 64:
            return self._merged(segment)
        if segment not in self.counts:
            if len(self.counts) >= _CACHE:
                self.counts.clear()
            self.counts[segment] = self._merged(segment)
        return self.counts[segment]

    def _merged(self, segment: str) -> int:
        return sum(1 if part in self.rank else len(part.encode()) for part in merge(list(segment), self.rank.get))

    def joins(self, left: str, right: str) -> bool:
        """Whether two characters may stand in one token."""
        return bool(self.held[self.letter[ord(left)], self.letter[ord(right)]])

    def chunk(self, text: str) -> ChunkMap:
        at = self.letter[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = (np.flatnonzero(~self.held[at[:-1], at[1:]]) + 1).tolist()
        if not cuts:
            return ChunkMap(text)
        count = self.count
        return ChunkMap(text[:cuts[0]], sum(count(text[a:b]) for a, b in zip(cuts, cuts[1:])), text[cuts[-1]:], True)

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        """The map of two chunks, the second after the first."""
        last, first = (left.tail or left.head), right.head
        if last and first and not self.joins(last[-1], first[0]):  # the border itself cuts
            if not left.cuts:
                left = ChunkMap(left.head, 0, "", True)
            elif left.tail:
                left = ChunkMap(left.head, left.count + self.count(left.tail), "", True)
            right = right if right.cuts else ChunkMap("", 0, right.head, True)
            return ChunkMap(left.head, left.count + (self.count(right.head) if right.head else 0) + right.count, right.tail, True)
        if not left.cuts:
            return ChunkMap(left.head + right.head, right.count, right.tail, right.cuts)
        if not right.cuts:
            return ChunkMap(left.head, left.count, left.tail + right.head, True)
        middle = left.tail + right.head
        return ChunkMap(left.head, left.count + (self.count(middle) if middle else 0) + right.count, right.tail, True)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Compose neighbours pairwise until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, text: str, chunk: int = _CHUNK) -> int:
        """Tokens of a whole text; the empty text has none."""
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        whole = self.scan([self.chunk(text[i:i + chunk]) for i in range(0, len(text), chunk)])
        return self.count(whole.head) + whole.count + (self.count(whole.tail) if whole.tail else 0)


@functools.lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null texts count as empty: no bytes, no tokens.  Repeated rows and null ids are rows like others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            counts = [own.tokens(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    counted = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
