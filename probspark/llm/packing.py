"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Every task packs the documents of its own partition as they come.  A document's
whole windows are cut off first; its rest goes to the fill level (an empty window
is level 0) that makes the sum of squared counts of partly filled windows smallest.
The counts stand in a level array.  When more than ``most_open`` windows are partly
filled, and at the end of the partition, the emptiest windows are poured into the
gaps of the fullest, cutting documents, so a task holds a bounded number of
windows and leaves one partly filled window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.llm.common import by_bytes
from probspark.llm.token_ids import encoder
from probspark.llm.words import pieces

WINDOW = 2048
END_ID = 1
MOST_OPEN = 512
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """The windows of one task.  ``rows`` are finished pieces, in the columns of PIECE_SCHEMA."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, first_id: int = 0):
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows; a window is a list of (doc_id, start, ids, tokens)
        self.n_open = 0
        self.rows: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The level whose use adds least to the sum of squares; of equal ones the fullest."""
        room = self.window - size
        after = np.zeros(room + 1, np.int64)
        after[:room] = 2 * self.counts[size : self.window] + 1  # a window that gets full isn't counted
        change = after - 2 * self.counts[: room + 1] + 1
        change[self.counts[: room + 1] == 0] = np.iinfo(np.int64).max
        change[0] = after[0]
        return room - int(np.argmin(change[::-1]))

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._finish([(doc_id, start, ids[start : start + self.window], len(ids))])
        if len(ids) > whole:
            piece = (doc_id, whole, ids[whole:].copy(), len(ids))
            level = self.level_for(len(ids) - whole)
            self._put(self._take(level) if level else [], level, piece)
            if self.n_open > self.most_open:
                self.pour(self.most_open // 2)

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, held: list, level: int, piece: tuple) -> None:
        held.append(piece)
        self._keep(held, level + len(piece[2]))

    def _keep(self, held: list, level: int) -> None:
        if level == self.window:
            self._finish(held)
        elif level:
            self.open.setdefault(level, []).append(held)
            self.counts[level] += 1
            self.n_open += 1

    def _finish(self, held: list) -> None:
        at = 0
        for doc_id, start, ids, tokens in held:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, tokens, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def pour(self, leave: int = 1) -> None:
        """Empties the least filled windows into the gaps of the fullest until ``leave`` are partly filled."""
        while self.n_open > leave:
            levels = np.flatnonzero(self.counts)
            source, target, level = self._take(int(levels[0])), self._take(int(levels[-1])), int(levels[-1])
            gap = self.window - level
            while gap and source:
                doc_id, start, ids, tokens = source.pop()
                if len(ids) > gap:  # the piece's end goes over, its beginning stays
                    source.append((doc_id, start, ids[:-gap], tokens))
                    start, ids = start + len(ids) - gap, ids[-gap:]
                target.append((doc_id, start, ids, tokens))
                gap, level = gap - len(ids), level + len(ids)
            self._keep(source, sum(len(p[2]) for p in source))
            self._keep(target, level)

    def close(self) -> None:
        self.pour()
        for level in list(self.open):
            while self.open[level]:
                self._finish(self._take(level))

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of the documents of ``docs`` (``doc_id, text``) in sequences of at most ``window`` ids.

    A document is its text's ids and ``end_id``; null and empty texts are that id
    alone.  Repeated rows are packed once each; a null ``doc_id`` is carried.  An
    empty table gives no rows.  A text of any length is encoded whole and cut into windows; of equally
    good fill levels the fullest is taken.  Other columns are not read.  ``sequence_id`` tells sequences apart (it starts
    with the partition's number); ``offset`` is gapless from 0 in each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = SumOfSquares(window, most_open, (context.partitionId() if context else 0) << 40)
        tokens = encoder(tokenizer_path, keep_space=False)
        for batch in batches:
            for piece in pieces(batch):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), tokens.ids(piece.column("text")), strict=True):
                    packer.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
                yield packer.drain()
        packer.close()
        yield packer.drain()

    return by_bytes(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)
