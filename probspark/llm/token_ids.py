"""Token ids of whole texts through ids of their distinct chunks.

Both tokenizers used here split a text before they merge, and a split never lies
inside a chunk of white space followed by other characters.  So a text's tokens are
those of its chunks in order, and each task encodes a chunk once however often it
occurs.  Texts with white space outside ASCII, or that may hold a special token's
string, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from probspark.llm.words import IS_SPACE, LOWER, spans, text_bytes, word_checks, word_hashes

#: White space outside ASCII, in UTF-8; fixed values.
WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: A sign that is one token of its own; it stands between words that are encoded together.
_MARK = "\u2665"
CACHED_CHUNKS = 1_500_000
TOGETHER = 256


class ChunkEncoder:
    """Encodes pieces of a text column with one tokenizer file.

    Ids of at most ``cached`` chunks are kept, in arrays sorted by a 64-bit hash; a
    second 64-bit hash must agree as well.  When they are full, all are dropped.
    """

    def __init__(self, path: str, keep_space: bool, cached: int = CACHED_CHUNKS):
        """keep_space: the white space before a word belongs to its tokens (byte-level vocabularies)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_space, self.cached = keep_space, cached
        tokens = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens += [] if keep_space else [_MARK.encode()]
        self.apart = re.compile(b"|".join([WIDE_SPACE, *map(re.escape, tokens)]))
        if keep_space:
            size = self.tokenizer.get_vocab_size()
            self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        else:
            (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)
        self.used = 0

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each chunk)."""
        ids, lengths = [], []
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            if self.keep_space:
                (found,) = self._fast([b"".join(part).decode()])
                ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
                tokens = np.searchsorted(np.cumsum(self.bytes_of[found]), ends, side="right")
                lengths.append(np.diff(tokens, prepend=0))
            else:
                (found,) = self._fast([f" {_MARK} ".join([*(c.decode() for c in part), ""])])
                marks = np.flatnonzero(found == self.mark)
                lengths.append(np.diff(marks, prepend=-1) - 1)
                found = np.delete(found, marks)
            ids.append(found)
        return np.concatenate(ids), np.concatenate(lengths)

    def _add(self, raw: bytes, start: np.ndarray, end: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.cached:
            self.clear()
        chunks = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if self.keep_space:  # a chunk at a row's start or of white space alone would run into its neighbour
            joins = np.fromiter((IS_SPACE[c[0]] and not IS_SPACE[c[-1]] for c in chunks), bool, len(chunks))
            order = np.argsort(~joins, kind="stable")
            chunks, keys, checks, n = [chunks[i] for i in order], keys[order], checks[order], int(joins.sum())
        else:
            n = len(chunks)
        ids, lengths = self._encode_chunks(chunks[:n]) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if chunks[n:]:
            alone = self._fast([c.decode() for c in chunks[n:]])
            ids, lengths = np.concatenate([ids, *alone]), np.concatenate([lengths, [len(x) for x in alone]])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.checks = np.concatenate([self.checks, checks])[order]
        self.first = np.concatenate([self.first, first])[order]
        self.length = np.concatenate([self.length, lengths.astype(np.int32)])[order]

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def _chunks(self, texts: pa.Array):
        """(first id and number of ids of each chunk, chunks before each row, rows that go whole)."""
        data, offsets = text_bytes(texts)
        whole = {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in self.apart.finditer(data)}
        if self.keep_space:
            # a chunk starts where a row starts, or at white space after other characters
            space = IS_SPACE[data]
            cut = np.zeros(len(data), bool)
            cut[1:] = space[1:] & ~space[:-1]
            cut[offsets[:-1][np.diff(offsets) > 0]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(data))
        else:
            data = LOWER[data]
            start, end, _ = spans(data, offsets)
        before = np.searchsorted(start, offsets)
        first, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        used = np.ones(len(start), bool)
        for row in whole:
            used[before[row] : before[row + 1]] = False
        if used.any():
            own = slice(None) if used.all() else used
            hashes = word_hashes(data, start[own], end[own])
            _, some, which = np.unique(hashes, return_index=True, return_inverse=True)
            start, end = start[own][some], end[own][some]
            keys, checks = hashes[some], word_checks(data, start, end)
            at, known = self._find(keys, checks)
            if not known.all():
                new = ~known
                kept = len(self.keys)
                self._add(data.tobytes(), start[new], end[new], keys[new], checks[new])
                if len(self.keys) != kept + new.sum():  # it was full: all chunks of this piece go in anew
                    self.clear()
                    self._add(data.tobytes(), start, end, keys, checks)
                at, known = self._find(keys, checks)
            first[own], length[own] = self.first[at][which], self.length[at][which]
        return first, length, before, whole

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each row."""
        _, lengths, before, whole = self._chunks(texts)
        sums = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        counts = np.diff(sums[before])
        for row in whole:
            counts[row] = len(self._encode(texts[row]))
        return counts

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each row."""
        first, lengths, before, whole = self._chunks(texts)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(first - (ends - lengths), lengths) + np.arange(total)
        flat = self.flat[at]
        cuts = np.concatenate(([0], ends))[before]
        rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for row in whole:
            rows[row] = np.array(self._encode(texts[row]), np.uint32)
        return rows

    def _encode(self, text: pa.Scalar) -> list[int]:
        value = text.as_py() or ""
        return self.tokenizer.encode(value, add_special_tokens=False).ids


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, keep_space: bool) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer file."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = ChunkEncoder(path, keep_space)
    return _encoders[path, keep_space]
