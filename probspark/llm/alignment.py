"""Alignment of two tokenizers over distinct texts.

1. The corpus is shuffled by full text, with copies counted before the shuffle, and each
   distinct text is tokenised and aligned once.
2. Both tokenizers' byte ends cut a text into segments; a segment lies in one A token
   and one B token, so segments are the overlapping token pairs (links), and ends that
   both share close a group.  Texts are stored with their links and multiplicity.
3. Pair counts are summed over the stored links, weighted by multiplicity.
4. The counts go to the tasks in slices of at most ``most_pairs`` pairs.  Every slice is
   looked up for every distinct text, the sums over slices are a text's measures, and
   they are joined to the rows by the text's digest.

Neither tokenizer has a token that crosses from a character into a following space, so
a text's tokens are those of its chunks (a space, up to the next space that follows a
character).  A worker aligns a chunk once and keeps it, all new chunks of a piece together.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.llm.common import by_bytes, fresh_path, remove, stored
from probspark.llm.token_ids import WIDE_SPACE
from probspark.llm.words import IS_SPACE, pieces, text_bytes

MOST_PAIRS = 4_000_000
KEPT_CHUNKS = 600_000
KEPT_BYTES = 64 << 20
#: Links hashed or gathered at a time.
TOGETHER = 100_000
#: Distinct pairs that a task sums before it gives them out.
SUMMED_PAIRS = 2_000_000
#: Texts with more copies than this, and more than a 500th of all rows, are spread in the last join.
COPIES = 1000

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


class _Column:
    """A numpy array that grows by doubling."""

    def __init__(self, kind):
        self.values, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)

    def all(self) -> np.ndarray:
        return self.values[: self.n]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n numbers, one range after another."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between one bound of ``before`` and the next."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[before])


def _bounds(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


class _Strings:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.start[numbers], self.length[numbers])]


class Aligner:
    """Aligned chunks of a byte-level vocabulary (A, ``tokenizers`` file) and a piece model (B, ``sentencepiece`` file)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        # the byte-level alphabet: visible bytes stand for themselves, the others for code points from 256 up, in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        assert set(byte_of) == set(ByteLevel.alphabet())
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = _Strings([bytes(byte_of[c] for c in self.a.id_to_token(i) or "" if c in byte_of) for i in range(size_a)])
        names = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = _Strings([bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.numbers = _Strings([b"%d," % i for i in range(max(size_a, self.size_b))])
        # where a piece could run from a character into a space, chunks would not be independent
        self.by_chunks = not any(re.search("[^▁]▁", n) for n in names)
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.kept_bytes = 0
        self.measures = {name: _Column(np.int32) for name in MEASURES}
        self.good = _Column(bool)
        self.first = _Column(np.int64)  # of a chunk's links
        self.pair = _Column(np.int64)  # of a link: A id * size of B + B id
        self.string_start, self.string_length, self.strings = _Column(np.int64), _Column(np.int32), _Column(np.uint8)

    def full(self) -> bool:
        return len(self.known) > KEPT_CHUNKS or self.kept_bytes > KEPT_BYTES

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers of all rows one after another, chunks before each row); every text starts with a space."""
        data, offsets = text_bytes(texts)
        cut = np.zeros(len(data), bool)
        if self.by_chunks:
            cut[1:] = (data[1:] == 0x20) & ~IS_SPACE[data[:-1]]
            for found in re.finditer(WIDE_SPACE, data):  # A splits runs of white space by what follows them
                row = int(np.searchsorted(offsets, found.start(), side="right")) - 1
                cut[offsets[row] : offsets[row + 1]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        ends = np.append(start, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        distinct = column.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        if new:
            self._add(new)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return numbers[column.indices.to_numpy(zero_copy_only=False)], np.searchsorted(start, offsets)

    def _add(self, new: list[bytes]) -> None:
        texts = [c.decode() for c in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        for i, c in enumerate(new):
            if c == b" ":  # a last space: the model adds none to an empty text
                ids_b[i] = [self.space]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        data, size = np.frombuffer(b"".join(new), np.uint8), np.fromiter(map(len, new), np.int64, len(new))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        good = _gives(flat_a, n_a, self.bytes_a, data, size) & _gives(flat_b, n_b, self.bytes_b, data, size)
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
        n_a, n_b, size = (np.where(good, x, 0) for x in (n_a, n_b, size))
        ends_a, ends_b = np.cumsum(self.bytes_a.length[flat_a]), np.cumsum(self.bytes_b.length[flat_b])
        ends = np.union1d(ends_a, ends_b)  # one for each link
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)  # one for each group
        chunk_ends = np.cumsum(size)
        n_groups, n_links = (np.diff(np.searchsorted(x, chunk_ends, side="right"), prepend=0) for x in (shared, ends))
        for name, n in zip(MEASURES, (n_a, n_b, n_groups, n_links), strict=True):
            self.measures[name].add(n)
        self.good.add(good)
        self.first.add(self.pair.n + np.cumsum(n_links) - n_links)
        if len(ends):
            self.pair.add(flat_a[np.searchsorted(ends_a, ends)] * self.size_b + flat_b[np.searchsorted(ends_b, ends)])
        # a1,a2|b1; of every group: A's tokens and then B's, each with the sign that follows it
        group = np.concatenate([np.searchsorted(shared, ends_a) * 2, np.searchsorted(shared, ends_b) * 2 + 1])
        order = np.argsort(group, kind="stable")
        group, ids = group[order], np.concatenate([flat_a, flat_b])[order]
        last = np.ones(len(group), bool)
        last[:-1] = group[1:] != group[:-1]
        length = self.numbers.length[ids]
        string = self.numbers.joined(ids)
        string[np.cumsum(length)[last] - 1] = np.where(group[last] % 2 == 0, ord("|"), ord(";"))
        lengths = _sums(length, _bounds(n_a + n_b))
        self.string_start.add(self.strings.n + np.cumsum(lengths) - lengths)
        self.string_length.add(lengths)
        self.strings.add(string)
        self.kept_bytes += len(data) + len(string)

    def whole_rows(self, numbers: np.ndarray, before: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Rows whose text both tokenizers give back byte by byte; a lone space stands for an empty text."""
        _, offsets = text_bytes(texts)
        return (_sums(~self.good.all()[numbers], before) == 0) & (np.diff(offsets) > 1)

    def links_of(self, chunks: np.ndarray) -> np.ndarray:
        """The links of ``chunks``, one after another."""
        return self.pair.all()[_ranges(self.first.all()[chunks], self.measures["n_links"].all()[chunks].astype(np.int64))]

    def groups_sha256(self, chunks: np.ndarray) -> str:
        """Digest of the groups of a text, without the sign after the last one."""
        found = hashlib.sha256()
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            string = self.strings.all()[_ranges(self.string_start.all()[part], self.string_length.all()[part].astype(np.int64))]
            found.update(string[:-1] if at + TOGETHER >= len(chunks) else string)
        return found.hexdigest()


def _gives(ids: np.ndarray, n: np.ndarray, strings: _Strings, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Chunks (``size`` bytes of ``data`` each) that are the strings of their ``n`` ids, byte by byte."""
    same = _sums(strings.length[ids], _bounds(n)) == size
    differ = strings.joined(ids[np.repeat(same, n)]) != data[np.repeat(same, size)]
    same[same] = _sums(differ, _bounds(size[same])) == 0
    return same


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each worker process and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per distinct text of ``docs`` (null counts as empty): ``digest, copies``, its own measures, ``groups_sha256`` and ``links``.

    ``links`` are 64-bit numbers one after another: A id * size of B's vocabulary + B id.
    """
    schema = "digest string, copies long, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string, links binary"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(path_a, path_b)
        for batch in batches:
            for piece in pieces(batch):
                if found.full():
                    found.clear()
                texts = piece.column("text")
                numbers, before = found.chunks(texts)
                whole = found.whole_rows(numbers, before, texts)
                measures = [np.where(whole, _sums(found.measures[name].all()[numbers], before), 0) for name in MEASURES]
                groups = [found.groups_sha256(numbers[a:b]) if ok else "" for a, b, ok in zip(before[:-1].tolist(), before[1:].tolist(), whole.tolist(), strict=True)]
                links = found.links_of(numbers[np.repeat(whole, np.diff(before))]).astype("<i8")
                links = pa.Array.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(_bounds(measures[-1]) * 8), pa.py_buffer(links)]).cast(pa.binary())
                columns = [piece.column("digest"), piece.column("copies"), *map(pa.array, measures), pa.array(groups, pa.string()), links]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "copies", *MEASURES, "groups_sha256", "links"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select(F.concat(F.lit(" "), "text").alias("text"), "copies", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return by_bytes(texts).mapInArrow(align, schema)


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(links of all rows, links before each row)."""
    data, offsets = text_bytes(batch.column("links"))
    return np.frombuffer(data.tobytes(), "<i8"), offsets // 8


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """``a, b, links, best``: how many links of the corpus hold an id pair, and whether none of its B id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = total = np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair // size_b), pa.array(pair % size_b), pa.array(total)], ["a", "b", "links"])

        for batch in batches:
            links, before = _links(batch)
            copies = np.repeat(batch.column("copies").to_numpy(zero_copy_only=False), np.diff(before))
            held, links = np.concatenate([total, copies]), np.concatenate([pair, links])
            order = np.argsort(links, kind="stable")
            links, held = links[order], held[order]
            new = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]])) if len(links) else np.zeros(0, np.int64)
            pair, total = links[new], np.add.reduceat(held, new) if len(new) else held
            if len(pair) > SUMMED_PAIRS:
                yield rows()
                pair = total = np.zeros(0, np.int64)
        yield rows()

    pairs = by_bytes(texts).select("copies", "links").mapInArrow(count, "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))
    return pairs.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _measure(slice_of_pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A text's row with what this slice of pairs adds to ``n_best`` and ``count_sum`` instead of its links."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = slice_of_pairs.value
        for batch in batches:
            links, before = _links(batch)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
                held = keys[at] == links
                added = [_sums(held & best[at], before), _sums(np.where(held, counts[at], 0), before)]
            else:
                added = [np.zeros(len(batch), np.int64)] * 2
            own = [batch.column(c) for c in OWN]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, pa.int64()) for x in added)], [*OWN, "n_best", "count_sum"])

    return measure


OWN = ["digest", "copies", *MEASURES, "groups_sha256"]


def text_measures(texts: DataFrame, pairs: DataFrame, size_b: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per distinct text: ``digest, copies``, all measures and ``groups_sha256``."""
    spark = texts.sparkSession
    slices = max(1, -(-pairs.count() // most_pairs))
    schema = "digest string, copies long, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string, n_best long, count_sum long"
    parts = []
    for i in range(slices):
        own = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == i).select((F.col("a") * size_b + F.col("b")).alias("pair"), "links", "best")
        table = own.toArrow().sort_by("pair")  # about most_pairs rows, by their hash
        columns = tuple(table.column(c).to_numpy() for c in ("pair", "links", "best"))
        parts.append(by_bytes(texts).select(*OWN, "links").mapInArrow(_measure(spark.sparkContext.broadcast(columns)), schema))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if slices == 1:
        return whole
    return whole.groupBy(*OWN).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _size_b(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs) of ``docs`` (``doc_id, text``).

    ``rows``: one per row of ``docs`` with ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``.  ``pairs``: ``a, b, links, best`` over the
    corpus, copies counted each.  Null and empty texts, and texts that a tokenizer does
    not give back byte by byte, have zeros and an empty string, and count nowhere.
    Repeated rows give a row each, a null ``doc_id`` is carried, ties for a B id's
    highest count are all best, other columns are not read, an empty table gives no
    rows.  A text is one unit of work however long it is; copies are aligned once.
    """
    size_b, kept = _size_b(path_b), fresh_path(docs.sparkSession, "aligned-texts")
    texts = stored(aligned_texts(docs, path_a, path_b), "aligned-texts", kept, "zstd")
    pairs = stored(pair_counts(texts, size_b), "pair-counts")
    measures = stored(text_measures(texts, pairs, size_b, most_pairs), "text-measures")
    remove(docs.sparkSession, kept)
    # a text of very many copies meets its rows in several tasks; fewer than 500 texts have more than a 500th of the rows
    rows = measures.agg(F.sum("copies")).first()[0] or 0
    spread = max(COPIES, rows // 500)
    hot = measures.filter(F.col("copies") > spread).select("digest", F.ceil(F.col("copies") / spread).cast("int").alias("ways"))
    hot = F.broadcast(hot)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    keyed = keyed.withColumn("row", F.monotonically_increasing_id()).join(hot, "digest", "left")
    keyed = keyed.select("doc_id", "digest", F.coalesce(F.pmod("row", "ways"), F.lit(0)).cast("int").alias("way"))
    dealt = measures.join(hot, "digest", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
    out = keyed.join(dealt, ["digest", "way"])
    return out.select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256"), pairs
