"""Term frequencies of sources held against each other, by two passes and minimal perfect hashes.

1. First pass: documents of a language that hold a term, exactly; the terms in enough
   of them are kept.
2. Kept (language, term) keys are dealt to shards of bounded size.  Each shard gets a
   minimal perfect hash: levels of bit arrays in which a key takes the first place that
   it has for itself; its slot is the number of taken places before it.  The
   keys are stored in slot order, and a looked-up term must equal the stored one.
3. Second pass: shards are broadcast, at most ``ROUND_BYTES`` of them at a time, and
   each task increments dense slot arrays of its (language, source) groups.
4. Shares and differences are exact integers.  Pairs of sources are compared within
   blocks of ``BLOCK`` sources and ``BLOCK_SLOTS`` of a shard's slots, and the blocks' sums are added.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.llm.common import by_bytes, stored
from probspark.llm.words import LOWER, mix, pieces, text_bytes, word_checks, word_hashes

LEAST_DOCUMENTS = 30
TOP = 50
SHARD_KEYS = 32_768
ROUND_BYTES = 64 << 20
LIVE_CELLS = 4 << 20
BLOCK = 32
BLOCK_SLOTS = 2048
LEVELS = 40

IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every term of the rows, and the distinct terms: runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    inside = IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = inside[starts]
    row = np.searchsorted(offsets, np.flatnonzero(first), side="right") - 1
    kept = data[inside]
    at = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(kept)]).dictionary_encode()
    return row, column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``lang, term, documents``: rows of the language that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=4 << 20):
                row, code, distinct = terms(piece.column("text"))
                langs = piece.column("lang").dictionary_encode()
                once = np.unique(row * len(distinct) + code)  # a term counts once in a document
                lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[once // max(1, len(distinct))]
                key, n = np.unique(lang * len(distinct) + once % max(1, len(distinct)), return_counts=True)
                columns = [langs.dictionary.take(pa.array(key // max(1, len(distinct)))), distinct.take(pa.array(key % max(1, len(distinct)))).cast(pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "documents"])

    found = by_bytes(docs).select("lang", "text").mapInArrow(run, "lang string, term string, documents long")
    return found.groupBy("lang", "term").agg(F.sum("documents").alias("documents"))


def _hashes(langs: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of (language, term) keys; ``langs`` are hashes of the languages."""
    data, offsets = text_bytes(words)
    with np.errstate(over="ignore"):
        return mix(word_hashes(data, offsets[:-1], offsets[1:]) + langs), mix(word_checks(data, offsets[:-1], offsets[1:]) ^ langs)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) + (len(x) << 32) for x in langs], np.uint64))


class PerfectHash:
    """A minimal perfect hash of (language, term) keys, with the keys in slot order."""

    def __init__(self, langs: list[str], words: pa.Array):
        names = sorted(set(langs))
        of = {x: i for i, x in enumerate(names)}
        lang = np.fromiter((of[x] for x in langs), np.int64, len(langs))
        a, b = _hashes(_lang_hashes(names)[lang], words)
        self.bits, slots, base = [], np.zeros(len(lang), np.int64), 0
        left = np.arange(len(lang))
        while len(left) and len(self.bits) < LEVELS:
            size = max(64, len(left) * 3 // 2)
            place = _places(a[left], b[left], len(self.bits), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            taken = np.zeros(size, bool)
            taken[place[alone]] = True
            slots[left[alone]] = base + (np.cumsum(taken) - 1)[place[alone]]
            base += int(alone.sum())
            self.bits.append((size, np.packbits(taken)))
            left = left[~alone]
        slots[left] = np.arange(base, len(lang))  # keys that agree in both hashes: found by name
        self.rest = {(langs[i], words[i].as_py()): int(slots[i]) for i in left}
        self.slots = slots
        order = np.argsort(slots)
        self.langs, self.lang = names, lang[order].astype(np.int32)
        self.words = words.take(pa.array(order)).cast(pa.large_string())

    def payload(self) -> bytes:
        """What a reader needs."""
        data, offsets = text_bytes(self.words)
        return pickle.dumps({"bits": self.bits, "rest": self.rest, "langs": self.langs, "lang": self.lang, "data": data.tobytes(), "offsets": offsets})


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(a + b * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


class Lookup:
    """A shard as its readers hold it."""

    def __init__(self, payload: bytes):
        held = pickle.loads(payload)
        self.ranks, base = [], 0
        for size, bits in held["bits"]:
            taken = np.unpackbits(bits, count=size).astype(bool)
            self.ranks.append(np.where(taken, base + np.cumsum(taken) - 1, -1).astype(np.int32))
            base += int(taken.sum())
        self.rest, self.lang, self.offsets = held["rest"], held["lang"], held["offsets"]
        self.lang_number = {x: i for i, x in enumerate(held["langs"])}
        self.data = np.frombuffer(held["data"], np.uint8)
        self.n = len(self.lang)

    def find(self, names: list[str], lang: np.ndarray, words: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of the keys (``names[lang[i]], words[i]``), -1 for keys that are not stored."""
        slots = np.full(len(lang), -1, np.int64)
        left = np.arange(len(lang))
        for level, ranks in enumerate(self.ranks):
            rank = ranks[_places(a[left], b[left], level, len(ranks))]
            slots[left[rank >= 0]] = rank[rank >= 0]
            left = left[rank < 0]
            if not len(left):
                break
        # the stored key decides
        own = np.array([self.lang_number.get(x, -1) for x in names], np.int64)[lang] if len(lang) else lang
        data, offsets = text_bytes(words)
        length = np.diff(offsets)
        found = np.flatnonzero(slots >= 0)
        at = slots[found]
        found = found[(self.lang[at] == own[found]) & (np.diff(self.offsets)[at] == length[found])]
        at, n = slots[found], length[found]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = self.data[np.repeat(self.offsets[:-1][at], n) + inner] == data[np.repeat(offsets[:-1][found], n) + inner]
        good = np.diff(np.concatenate([[0], np.cumsum(~same)])[np.concatenate([[0], np.cumsum(n)])]) == 0
        out = np.full(len(lang), -1, np.int64)
        out[found[good]] = at[good]
        for (name, word), slot in self.rest.items():
            for i in np.flatnonzero(out < 0).tolist():
                if names[lang[i]] == name and words[i].as_py() == word:
                    out[i] = slot
        return out


def perfect_hashes(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(``shard, slot, lang, term, payload``, number of shards); a shard's payload stands in its row of slot 0."""
    shards = max(1, -(-kept.count() // shard_keys))
    key = F.concat("lang", F.lit("\0"), "term").cast("binary")
    dealt = kept.select("lang", "term", F.pmod(F.crc32(key), F.lit(shards)).cast("int").alias("shard"))

    def build(table: pa.Table) -> pa.Table:
        words = table.column("term").combine_chunks()
        made = PerfectHash(table.column("lang").to_pylist(), words)
        order = pa.array(np.argsort(made.slots))
        payload = [made.payload(), *[None] * (len(words) - 1)]
        columns = [table.column("shard"), pa.array(np.arange(len(words))), table.column("lang").take(order), words.take(order), pa.array(payload, pa.binary())]
        return pa.table(columns, ["shard", "slot", "lang", "term", "payload"])

    return dealt.groupBy("shard").applyInArrow(build, "shard int, slot long, lang string, term string, payload binary"), shards


def recount(docs: DataFrame, keys: DataFrame, shards: int, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``lang, source, shard, slot, n``: occurrences of every kept term in every group, where there are any."""
    payloads = keys.filter(F.col("payload").isNotNull()).select("shard", "payload")
    sizes = payloads.select("shard", F.octet_length("payload").alias("n")).orderBy("shard").collect()  # a row per shard_keys kept terms
    rounds, room = [], 0
    for shard, n in sizes:
        if room < n or not rounds:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(shard)
        room -= n
    docs = by_bytes(docs).select("lang", "source", "text")
    parts = []
    for own in rounds:
        held = dict(payloads.filter(F.col("shard").between(own[0], own[-1])).collect())  # at most round_bytes, or one shard
        parts.append(docs.mapInArrow(_counter(docs.sparkSession.sparkContext.broadcast(held), shards), "lang string, source string, shard int, slot long, n long"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, source string, shard int, slot long, n long")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


_lookups: dict[str, dict[int, Lookup]] = {}


def _counter(held, shards: int, live_cells: int = LIVE_CELLS):
    """Counts a task's terms in slot arrays; when they hold more than ``live_cells`` slots they are given out and begun anew."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _lookups:  # a worker keeps the shards of one round
            _lookups.clear()
            _lookups[name] = {shard: Lookup(payload) for shard, payload in held.value.items()}
        lookups = _lookups[name]
        dense: dict[tuple[str, str, int], np.ndarray] = {}
        cells = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), n in dense.items():
                slot = np.flatnonzero(n)
                constant = [pa.repeat(pa.scalar(x, t), len(slot)) for x, t in ((lang, pa.string()), (source, pa.string()), (shard, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*constant, pa.array(slot), pa.array(n[slot])], ["lang", "source", "shard", "slot", "n"])

        for batch in batches:
            for piece in pieces(batch, limit=4 << 20):
                row, code, distinct = terms(piece.column("text"))
                if not len(distinct):
                    continue
                m = len(distinct)
                langs, sources = piece.column("lang").dictionary_encode(), piece.column("source").dictionary_encode()
                names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
                lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
                group_of_row = lang * len(source_names) + source
                key, n = np.unique(group_of_row[row] * m + code, return_counts=True)
                group, code = key // m, key % m
                pair, which = np.unique(group // len(source_names) * m + code, return_inverse=True)
                shard, slot = _find_all(lookups, shards, names, pair // m, distinct.take(pa.array(pair % m)))
                shard, slot = shard[which], slot[which]
                kept = slot >= 0
                group, shard, slot, n = group[kept], shard[kept], slot[kept], n[kept]
                order = np.lexsort((shard, group))
                group, shard, slot, n = group[order], shard[order], slot[order], n[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(shard) != 0)])) if len(group) else np.zeros(0, np.int64)
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(group)], strict=True):
                    at = (names[group[a] // len(source_names)], source_names[group[a] % len(source_names)], int(shard[a]))
                    if at not in dense:
                        if cells > live_cells:
                            yield from flush()
                            dense.clear()
                            cells = 0
                        dense[at] = np.zeros(lookups[at[2]].n, np.int64)
                        cells += len(dense[at])
                    dense[at][slot[a:b]] += n[a:b]  # a slot stands once in a group and shard
        yield from flush()

    return run


def _find_all(lookups: dict[int, Lookup], shards: int, names: list[str], lang: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a, b = _hashes(_lang_hashes(names)[lang], words)
    before = [zlib.crc32(x.encode() + b"\0") for x in names]
    shard = np.fromiter((zlib.crc32(w.encode(), before[x]) % shards for w, x in zip(words.to_pylist(), lang.tolist(), strict=True)), np.int64, len(lang))
    slot = np.full(len(lang), -1, np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    for at in np.split(order, cuts[1:]):
        if len(at) and int(shard[at[0]]) in lookups:
            slot[at] = lookups[int(shard[at[0]])].find(names, lang[at], words.take(pa.array(at)), a[at], b[at])
    return shard, slot


def _share(n: str, total: str, kept: str):
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exactly; 38 digits hold it for any long ``n`` below 10^18."""
    return F.expr(f"1 + cast((cast({n} as decimal(19,0)) + 5) * 1000000000 div (cast({total} as decimal(19,0)) + 5 * cast({kept} as decimal(19,0))) as long)")


def source_divergence(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, shard_keys: int = SHARD_KEYS, round_bytes: int = ROUND_BYTES, block: int = BLOCK
) -> DataFrame:
    """How far the term shares of each (language, source) group are from those of the language's other sources.

    ``docs`` (``text, lang, source``; null counts as empty, a null and an empty source
    are one group) gives ``lang, source, part, item, value, rank``.  Part ``pair``: every other source of the
    language, the sum of share differences over kept terms (0 without any).  Part
    ``term``: the ``top`` terms whose share is above the language's.  Ties rank by the item's bytes.
    Repeated rows count each, ids and other columns are not read, texts are counted whole, an
    empty table gives no rows; a language with one source has no pairs.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = document_frequencies(rows).filter(F.col("documents") >= least_documents)
    made, shards = perfect_hashes(stored(kept.select("lang", "term"), "kept-terms"), shard_keys)
    keys = stored(made, "perfect-hashes")
    cells = stored(recount(rows, keys, shards, round_bytes), "group-slots")
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "total"])
    groups = stored(groups.withColumn("p0", F.when(F.col("kept") > 0, _share("0", "total", "kept"))), "term-groups")
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept"))
    return _terms(shares, keys, top).unionByName(_pairs(shares, groups, keys, block))


def _terms(shares: DataFrame, keys: DataFrame, top: int) -> DataFrame:
    of_lang = shares.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("lang_n"))
    lang_total = shares.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.first("kept").alias("lang_kept"))
    q = keys.select("lang", "shard", "slot", "term").join(of_lang, ["lang", "shard", "slot"]).join(lang_total, "lang")
    q = q.select("lang", "shard", "slot", F.col("term").alias("item"), _share("lang_n", "lang_total", "lang_kept").alias("q"))
    above = shares.join(q, ["lang", "shard", "slot"]).filter(F.col("p") > F.col("q"))
    above = above.select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _pairs(shares: DataFrame, groups: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    blocks = groups.join(n_sources, "lang").withColumn("blocks", F.ceil(F.col("sources") / block).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    to_pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    placed = blocks.select("lang", "source", "block", "p0", to_pairs.alias("at")).select("lang", "source", "block", "p0", "at.i", "at.j")
    cut = F.floor(F.col("slot") / BLOCK_SLOTS).cast("int").alias("cut")
    in_shard = keys.groupBy("lang", "shard", cut).agg(F.count(F.lit(1)).alias("terms"))
    members = placed.join(in_shard, "lang")
    held = shares.select("lang", "source", "shard", cut, "slot", "p").join(placed.select("lang", "source", "i", "j"), ["lang", "source"])
    by = ["lang", "shard", "cut", "i", "j"]
    held, members = (x.toDF(*x.columns) for x in (held, members))  # columns of their own: both come from the groups

    def compare(key, cells: pa.Table, sources: pa.Table) -> pa.Table:
        names, n = sources.column("source").to_pylist(), sources.column("terms")[0].as_py()
        block_of, p0 = sources.column("block").to_numpy(), sources.column("p0").to_numpy()
        number = {x: k for k, x in enumerate(names)}
        slots, column = np.unique(cells.column("slot").to_numpy(), return_inverse=True)
        shares_of = np.repeat(p0[:, None], len(slots), axis=1)
        of = cells.column("source").combine_chunks().dictionary_encode()
        rank = np.array([number[x] for x in of.dictionary.to_pylist()], np.int64)
        shares_of[rank[of.indices.to_numpy(zero_copy_only=False)] if len(rank) else np.zeros(0, np.int64), column] = cells.column("p").to_numpy()
        i, j = key[3].as_py(), key[4].as_py()
        out = ([], [], [])
        for k in range(len(names)):
            for m in range(k + 1, len(names)):
                if i == j or block_of[k] != block_of[m]:
                    a, b = sorted((names[k], names[m]), key=str.encode)
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(int(np.abs(shares_of[k] - shares_of[m]).sum()) + (n - len(slots)) * abs(int(p0[k]) - int(p0[m])))
        lang = pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(out[0]))
        return pa.table([lang, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "a", "b", "value"])

    sums = held.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(compare, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    bare = groups.filter(F.col("kept") == 0).select("lang", "source")
    zero = bare.alias("a").join(bare.alias("b"), F.expr("a.lang = b.lang AND a.source < b.source"))
    sums = sums.unionByName(zero.select("a.lang", F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.lit(0).cast("long").alias("value")))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("at"))
    return _ranked(both.select("lang", "at.source", F.lit("pair").alias("part"), "at.item", "value"))
