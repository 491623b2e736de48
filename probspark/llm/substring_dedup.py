"""Removal of repeated word windows by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words; words of a window that also starts earlier
(smaller id, or earlier in the document) go.

The method asks for automata of all reference text, broadcast to all tasks.  Here the
reference is the corpus itself, so they would have no size bound, and every document
would pass every shard.  Therefore

1. Every window selects its smallest gram of ``GRAM`` words as an anchor (winnowing);
   equal windows select equal anchors.  Anchors meet by value, and only stretches whose
   anchors occur twice go on.  Nothing else can repeat.
2. A shard is a block of documents in one task.  It builds a suffix automaton over its
   stretches in order of ids, word by word; the length of the newest state's suffix link
   is the matching statistic against all earlier text of the shard, and where it
   reaches the window length the window goes.
3. Windows that are first in their shard meet the other shards' by a 128-bit
   fingerprint, and all but the first go.  A shard sends each repeated window once, so
   a passage that a third of all documents share weighs one entry a shard.
4. Every document gets its windows' places back and drops the maximal spans they cover.

Anchors, fingerprints and places travel as packed arrays, texts compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probspark.llm.common import by_bytes
from probspark.llm.words import gram_hashes, mix, pieces, spans, text_bytes, word_checks, word_hashes
from probspark.operators.ranks import joined, numbered

WINDOW = 20
GRAM = 5
SHARD_BYTES = 2 << 20
_NO_ID = -(1 << 63)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_PACKED = "bucket long, first binary, second binary, third binary, fourth binary"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:]) if len(values) > step else values[:0]
        done += step
    return values


class ShardWords:
    """Words of some rows, with the grams and windows that start at each word (a window lies in one row)."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.data, offsets = text_bytes(texts)
        self.start, self.end, self.before = spans(self.data, offsets)
        self.hashes = word_hashes(self.data, self.start, self.end)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.before))
        self.place = np.arange(len(self.row)) - self.before[self.row]
        self.window = window
        self.width = window - gram + 1
        self.grams = gram_hashes(self.hashes, gram)
        n = max(0, len(self.row) - window + 1)
        self.inside = self.row[:n] == self.row[window - 1 :] if n else np.zeros(0, bool)
        self.least = _sliding(self.grams, self.width, np.minimum)[:n]

    def anchors(self) -> np.ndarray:
        """Words at which a gram starts that is the smallest of some window."""
        if not len(self.inside):
            return np.zeros(0, np.int64)
        pad = np.zeros(self.width - 1, np.uint64)
        chosen = np.where(self.inside, self.least, np.uint64(0))
        highest = _sliding(np.concatenate([pad, chosen, pad]), self.width, np.maximum)
        return np.flatnonzero((highest == self.grams) & (highest > 0))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Windows whose smallest gram is one of the repeated anchors (a mask of words)."""
        if not len(self.inside):
            return np.zeros(0, bool)
        values = np.where(repeated[: len(self.grams)], self.grams, _TOP)
        return self.inside & (_sliding(values, self.width, np.minimum) == self.least)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every window: 128 bits tell any number of windows apart that a corpus holds."""
        return gram_hashes(self.hashes, self.window), gram_hashes(word_checks(self.data, self.start, self.end), self.window)


class SuffixAutomaton:
    """Built one symbol at a time; ``extend`` gives the length of the longest suffix that occurred before."""

    def __init__(self):
        self.next, self.link, self.length, self.last = [{}], [-1], [0], 0

    def extend(self, symbol: int) -> int:
        next_, link, length = self.next, self.link, self.length
        state, p = len(next_), self.last
        next_.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in next_[p]:
            next_[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = next_[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(next_)
                next_.append(next_[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and next_[p].get(symbol) == q:
                    next_[p][symbol] = clone
                    p = link[p]
                link[q] = link[state] = clone
        self.last = state
        return length[link[state]]


def repeats_in_shard(words: ShardWords, candidate: np.ndarray) -> np.ndarray:
    """Candidate windows (mask by first word) that also start earlier in the shard, from matching statistics.

    Words that lie in no candidate window are skipped; a gap and the start of a row put a
    symbol of their own between stretches, so that no match runs over it.
    """
    window, hashes = words.window, words.hashes
    covered = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(candidate)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    some = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    if not len(some):
        return np.zeros(len(candidate), bool)
    _, symbols = np.unique(hashes[some], return_inverse=True)
    breaks = np.diff(some, prepend=-2) != 1
    breaks |= words.place[some] == 0
    found, gap = [], -1
    extend = SuffixAutomaton().extend
    for word, symbol, apart in zip(some.tolist(), symbols.reshape(-1).tolist(), breaks.tolist(), strict=True):
        if apart:
            extend(gap)
            gap -= 1
        if extend(symbol) >= window:
            found.append(word - window + 1)
    out = np.zeros(len(candidate), bool)
    out[np.array(found, np.int64)] = True
    return out & candidate


def _ids(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _pack(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the bytes of its entries' columns."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket)) if len(bucket) else cuts
    packed = [[c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for c in (c[order] for c in columns)]
    packed += [[None] * len(cuts)] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], ["bucket", "first", "second", "third", "fourth"])


def _unpack(table: pa.Table, *kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x for x in table.column(i + 1).to_pylist() if x is not None), k) for i, k in enumerate(kinds)]


def _reply(ids: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places for the documents' own tasks; buckets below 0 name these."""
    return _pack(-1 - _doc_bucket(ids, buckets), ids, places.astype(np.int32))


def _meeting(first_too: bool, buckets: int):
    """Where keys meet: replies with the entries of keys that occur twice, all of them or all but the first."""

    def meet(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        keys, ids, places, checks = _unpack(table, np.uint64, np.int64, np.int32, np.uint64)
        checks = checks if len(checks) else np.zeros(len(keys), np.uint64)
        order = np.lexsort((places, ids, checks, keys))
        keys, ids, places, checks = keys[order], ids[order], places[order], checks[order]
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (checks[1:] == checks[:-1])
        if first_too:
            same[:-1] |= same[1:]
        else:  # rows that repeat the first entry's id and place are that entry again
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))
            same &= (ids != ids[head]) | (places != places[head])
        return pa.Table.from_batches([_reply(ids[same], places[same], buckets)])

    return meet


def _compressed(docs: DataFrame, buckets: int) -> DataFrame:
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in pieces(batch):
                texts = [packer.compress((t or "").encode()) for t in piece.column("text").to_pylist()]
                bucket = -1 - _doc_bucket(_ids(piece.column("doc_id")), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), piece.column("doc_id").cast(pa.int64()), piece.column("own_id"), pa.array(texts, pa.binary())], ["bucket", "doc_id", "own_id", "packed"])

    return docs.mapInArrow(compress, "bucket long, doc_id long, own_id long, packed binary")


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id, own_id, text`` where ``doc_id`` tells documents apart and orders them, and ``own_id`` is the row's own.

    Mostly that is the row's id.  Where ids are null or repeat, documents are distinct pairs of id and text, numbered in order of
    id (null first) and the text's digest, so null ids are as many documents as they have texts, in as many buckets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text")
    again = docs.groupBy("own_id").count().filter("own_id is null or count > 1")
    if again.isEmpty():
        return docs.select(F.col("own_id").alias("doc_id"), "own_id", "text")
    docs = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    key = ["own_id", "digest"]
    numbers = numbered(docs.select(*key).distinct(), [F.col("own_id").asc_nulls_first(), F.col("digest")], "doc_id")
    return joined(docs, numbers, key).select("doc_id", "own_id", "text")


def _texts(table: pa.Table) -> pa.Array:
    unpacker = zstandard.ZstdDecompressor()
    return pa.array([unpacker.decompress(t) for t in table.column("packed").to_pylist()], pa.large_binary())


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(_ids(table.column("doc_id")), kind="stable")))


def _places(words: ShardWords, ids: np.ndarray, replies: pa.Table) -> np.ndarray:
    """A mask of words: where a reply names the word's document and place."""
    mask = np.zeros(len(words.row), bool)
    if len(replies):
        of, places = _unpack(replies, np.int64, np.int32)
        for offset in range(int(np.unique(ids, return_counts=True)[1].max(initial=0))):  # rows that repeat an id all get its places
            row = np.searchsorted(ids, of) + offset
            row = np.minimum(row, len(ids) - 1)
            own = (ids[row] == of) & (places < np.diff(words.before)[row])
            mask[words.before[row[own]] + places[own]] = True
    return mask


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_words, n_removed, kept_sha256, kept_text``.

    ``kept_text`` holds the kept words joined by one space.  Null and empty texts have no
    words.  Null ids come before all others.  Rows of equal id and text are one document and
    don't remove each other's words; rows of one id, or none, and different texts are
    documents in the order of their texts' digests.  Columns but these two are not read, whatever their names.  A text of any length is one document of one shard.  An empty
    table gives no rows.
    """
    docs = _documents(by_bytes(docs))
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=shard_bytes):
                words = ShardWords(piece.column("text"), window, gram)
                at = words.anchors()
                keys, ids, places = words.grams[at], _ids(piece.column("doc_id"))[words.row[at]], words.place[at].astype(np.int32)
                _, first, count = np.unique(keys, return_index=True, return_counts=True)
                some = np.ones(len(keys), bool)
                some[first[count == 1]] = False  # what repeats here is known to repeat; one entry of each key goes on
                if some.any():
                    yield _reply(ids[some], places[some], buckets)
                if len(first):
                    yield _pack((keys[first] % np.uint64(buckets)).astype(np.int64), keys[first], ids[first], places[first])

    repeated = docs.select("doc_id", "text").mapInArrow(anchors, _PACKED).groupBy("bucket").applyInArrow(_meeting(True, buckets), _PACKED)

    def windows(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(texts) or not len(replies):
            return pa.Table.from_batches([_pack(np.zeros(0, np.int64), *[np.zeros(0)] * 4)])
        texts = _sorted(texts)
        ids = _ids(texts.column("doc_id"))
        words = ShardWords(_texts(texts), window, gram)
        candidate = words.candidates(_places(words, ids, replies))
        twice = np.zeros(len(ids), bool)
        twice[1:] = ids[1:] == ids[:-1]
        candidate &= ~twice[words.row[: len(candidate)]]
        gone = repeats_in_shard(words, candidate)
        first = np.flatnonzero(candidate & ~gone)
        gone = np.flatnonzero(gone)
        keys, checks = (f[first] for f in words.fingerprints())
        return pa.Table.from_batches([
            _reply(ids[words.row[gone]], words.place[gone], buckets),
            _pack((keys % np.uint64(buckets)).astype(np.int64), keys, ids[words.row[first]], words.place[first].astype(np.int32), checks),
        ])

    texts = _compressed(docs, buckets)
    # one plan from here on, so that the texts are sent to their shards once
    firsts = texts.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(windows, _PACKED)
    gone = firsts.groupBy("bucket").applyInArrow(_meeting(False, buckets), _PACKED)

    def cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = _sorted(texts)
        ids = _ids(texts.column("doc_id"))
        words = ShardWords(_texts(texts), window, gram)
        n = np.zeros(len(words.row) + 1, np.int64)
        at = np.flatnonzero(_places(words, ids, replies))
        n[at] += 1
        np.add.at(n, np.minimum(at + window, len(n) - 1), -1)
        kept = np.flatnonzero(np.cumsum(n[:-1]) == 0)
        length = words.end[kept] - words.start[kept] + 1  # with a space behind
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(words.start[kept] - (ends - length), length) + np.arange(total)
        joined = words.data[np.minimum(source, max(0, len(words.data) - 1))] if total else np.zeros(0, np.uint8)
        joined[ends - 1] = 0x20
        joined, rows = joined.tobytes(), np.searchsorted(kept, words.before)
        bounds = np.concatenate(([0], ends))[rows]
        out = [joined[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        count = np.diff(words.before)
        return pa.table({
            "doc_id": texts.column("own_id"),
            "n_words": count,
            "n_removed": count - np.diff(rows),
            "kept_sha256": [hashlib.sha256(t).hexdigest() for t in out],
            "kept_text": pa.array([t.decode() for t in out], pa.string()),
        })

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(cut, schema)
