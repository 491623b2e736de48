"""Mixing sources to target weights, by blocks of fixed length.

Each source's documents, in a hashed order, form one stream of words that is cut
into blocks of ``block`` words.  Every output shard draws how many slots each
source gets from a multinomial law over what the sources still have to give (the
last shard takes what is left, so totals are exact).  The n-th slot of a source
holds block ``permutation(n mod blocks)``, a keyed pseudorandom permutation that
changes with each pass over the source, and slots meet blocks in a join on
(source, block number).

A source's last slot is cut to the words that its target still lacks, so taken
words equal the rounded target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probspark.llm.common import by_bytes, stored
from probspark.llm.words import pieces as pieces_of
from probspark.llm.words import spans, text_bytes

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 256
OUTPUT_SHARDS = 64
SLOT_RUN = 8192
ROWS_PER_CELL = 50_000
WORD = r"[^\x20\x09-\x0D]+"
_MASK = np.uint64(0xFFFFFFFF)


def targets(sizes: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words for each source, in the order given: ``share`` of all words by weight, none above ``most`` times its own."""
    result, fixed = [0.0] * len(sizes), [False] * len(sizes)
    left = share * sum(sizes)
    while not all(fixed):
        total = sum(weights[i % len(weights)] for i in range(len(sizes)) if not fixed[i])
        over = [i for i in range(len(sizes)) if not fixed[i] and left * weights[i % len(weights)] / total > most * sizes[i]]
        if not over:
            for i in range(len(sizes)):
                if not fixed[i]:
                    result[i] = left * weights[i % len(weights)] / total
            return result
        for i in over:
            result[i], fixed[i] = most * sizes[i], True
        left -= sum(result[i] for i in over)
    return result


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1: a Feistel network of four rounds on the next power of four, walked until inside."""
    return _walk(index, n, key, range(4))


def unpermute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    return _walk(index, n, key, range(3, -1, -1))


def _walk(index: np.ndarray, n: int, key: int, rounds) -> np.ndarray:
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    x = np.asarray(index, np.uint64).copy()
    todo = np.ones(len(x), bool)
    backwards = list(rounds)[0] != 0
    with np.errstate(over="ignore"):
        while todo.any():
            a, b = x[todo] >> half, x[todo] & low
            for r in rounds:
                salt = np.uint64((key * 8 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                if backwards:
                    a, b = b ^ (_scramble(a, salt) & low), a
                else:
                    a, b = b, a ^ (_scramble(b, salt) & low)
            x[todo] = (a << half) | b
            todo = x >= n
    return x.astype(np.int64)


def _scramble(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Plan:
    """What one source gives: blocks in its stream, slots in the mix, and words of the last slot."""

    number: int
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def plan_source(number: int, size: int, target: float, block: int, seed: int) -> Plan:
    """Whole passes over the source, then blocks in permuted order until the rounded target is reached."""
    want, blocks = round(target), -(-size // block)
    if not want or not size:
        return Plan(number, size, target, blocks, 0, 0)
    passes, rest = divmod(want, size)
    if not rest:
        passes, rest = passes - 1, size
    short = block * blocks - size  # words that the last block lacks
    at = int(unpermute(np.array([blocks - 1]), blocks, _key(seed, number, passes))[0])
    taken = lambda k: k * block - (short if at < k else 0)
    k = max(1, rest // block)
    while taken(k) < rest:
        k += 1
    while k > 1 and taken(k - 1) >= rest:
        k -= 1
    return Plan(number, size, target, blocks, passes * blocks + k, rest - taken(k - 1))


def _key(seed: int, number: int, epoch: int) -> int:
    return (seed * 1_000_003 + number) * 64 + epoch


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard: multinomial over what is left, with exact sums over shards."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    counts = np.zeros((shards, len(slots)), np.int64)
    for s in range(shards):
        total = int(left.sum())
        size = total // (shards - s)
        if size == total:
            counts[s] = left
        while (short := size - int(counts[s].sum())) > 0:  # what a source can't give is drawn again from the others
            rest = left - counts[s]
            counts[s] += np.minimum(rng.multinomial(short, rest / rest.sum()), rest)
        left -= counts[s]
    return counts


def mixture_slots(docs: DataFrame, block: int = BLOCK, shards: int = OUTPUT_SHARDS, seed: int = 11, weights=WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(pieces, slots) of the mix of ``docs`` with columns ``doc_id, source, size, again`` (a number that tells equal rows apart).

    pieces: ``doc_id, source, size, source_size, target, source_no, again, start, block_no, low, high``: the words
    low..high of a block that a document fills (no block for documents without words), which starts at word ``start``
    of its source.
    slots: ``output_shard, position, source_no, block_no, words``: the blocks of every output shard in order.
    """
    spark = docs.sparkSession
    docs = stored(docs, "mix-sizes")
    cells = max(64, -(-docs.count() // ROWS_PER_CELL))  # however many rows there are, a sort has so many
    docs = docs.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "again"), F.lit(cells)).cast("int"))
    cells = docs.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    sums = cells.groupBy("source").agg(F.sum("cell_size").alias("n")).collect()  # one row per source
    sums.sort(key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[1] for r in sums], weights)
    plans = [plan_source(i, r[1], t, block, seed) for i, (r, t) in enumerate(zip(sums, wanted, strict=True))]
    table = spark.createDataFrame(
        [(r[0], p.number, p.size, p.target, p.blocks) for r, p in zip(sums, plans, strict=True)],
        "source string, source_no int, source_size long, target double, blocks long",
    )
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "cell", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_start"))
    within = Window.partitionBy("source", "cell").orderBy("doc_id", "size", "again").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    placed = placed.join(starts, same(placed, starts, "source", "cell")).drop(starts["source"]).drop(starts["cell"])
    placed = placed.join(F.broadcast(table), same(placed, table, "source")).drop(table["source"])
    placed = placed.withColumn("start", F.col("start") + F.col("cell_start"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    numbers = F.when(F.col("size") > 0, F.sequence(first, last))
    pieces = placed.select("doc_id", "source", "size", "source_size", "target", "source_no", "again", "start", F.explode_outer(numbers).alias("block_no"))
    pieces = pieces.withColumn("low", F.greatest(F.col("start") - F.col("block_no") * block, F.lit(0)))
    pieces = pieces.withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block_no") * block, F.lit(block)))

    counts = shard_counts([p.slots for p in plans], shards, seed)
    first_slot = counts.cumsum(axis=0) - counts
    runs = [
        (s, p.number, int(first_slot[s, p.number]), int(counts[s, p.number]))
        for s in range(shards)
        for p in plans
        if counts[s, p.number]
    ]
    runs = spark.createDataFrame(runs, "output_shard int, source_no int, first_slot long, n long")
    pieces_of_run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_RUN).cast("long")))
    runs = runs.select("output_shard", "source_no", "first_slot", "n", pieces_of_run.alias("skip"))
    # a stated number, or adaptive execution would put these few short rows, and all that they make, in one task
    runs = runs.repartition(shards + sum(p.slots for p in plans) // (32 * SLOT_RUN), "output_shard", "source_no", "skip")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                p = plans[run["source_no"]]
                low = run["first_slot"] + run["skip"]
                slot = np.arange(low, min(low + SLOT_RUN, run["first_slot"] + run["n"]))
                numbers = np.empty(len(slot), np.int64)
                for epoch in np.unique(slot // p.blocks):
                    own = slot // p.blocks == epoch
                    numbers[own] = permute(slot[own] % p.blocks, p.blocks, _key(seed, p.number, int(epoch)))
                words = np.minimum(block, p.size - numbers * block)
                words[slot == p.slots - 1] = p.last
                yield pa.RecordBatch.from_pydict({
                    "output_shard": np.full(len(slot), run["output_shard"], np.int32),
                    "slot": slot,
                    "source_no": np.full(len(slot), p.number, np.int32),
                    "block_no": numbers,
                    "words": words,
                })

    slots = runs.mapInArrow(fill, "output_shard int, slot long, source_no int, block_no long, words long")
    return pieces, slots.withColumn("position", F.xxhash64(F.lit(seed), "source_no", "slot"))


def _with_cuts(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """``pieces`` with ``cuts``: how far into the block each of its slots reaches (none where the mix has no slot)."""
    blocks = slots.groupBy("source_no", "block_no").agg(F.collect_list("words").alias("cuts"))  # as many as passes, so three at most
    # the size that Spark expects of Python's rows is that of the few runs they come from: it would broadcast them
    pieces = pieces.join(blocks.hint("merge"), ["source_no", "block_no"], "left")
    return pieces.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows that agree in all columns told apart by ``again``."""
    return docs.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, source, size``): ``doc_id, size, source_size, target, taken``.

    A null source is a source of its own, last in the order of weights; an empty
    string is an ordinary one.  Documents without words are taken 0 times.  Repeated
    rows are mixed each for itself, in an order that their number decides.  Columns but these
    three are not read, whatever their names.  An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"))
    pieces = _with_cuts(*mixture_slots(_numbered(rows), **options))
    part = F.aggregate("cuts", F.lit(0).cast("long"), lambda total, cut: total + F.greatest(F.least(F.col("high"), cut) - F.col("low"), F.lit(0)))
    key = ["doc_id", "again", "source_no", "size", "source_size", "target"]
    parts = pieces.withColumn("part", F.when(F.col("block_no").isNotNull(), part).otherwise(0))
    return parts.groupBy(*key).agg(F.sum("part").alias("taken")).drop("source_no", "again")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs`` (``doc_id, text, source`` and more).

    A document comes once for every pass that takes some of its words; its text is whole
    where all are taken, else the taken words joined by one space (``n_chars``, where there
    is one, follows).  Documents of which nothing is taken don't come.  Rows that repeat
    ``doc_id``, ``source`` and number of words are mixed as one, and each comes as that one does.
    Null texts have no words; long ones are cut into blocks like others; columns may have any
    names; an empty table gives no rows.
    """
    names = by_bytes(docs).columns
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size")).distinct()
    pieces = _with_cuts(*mixture_slots(rows.withColumn("again", F.lit(1)), **options))
    spans_ = F.transform("cuts", lambda cut: F.struct((F.col("before") + F.col("low")).alias("a"), (F.col("before") + F.least(F.col("high"), cut)).alias("b")))
    pieces = pieces.filter(F.size("cuts") > 0).withColumn("before", F.col("block_no") * F.lit(options.get("block", BLOCK)) - F.col("start"))
    taken = pieces.select("doc_id", F.col("source").alias("__source"), F.col("size").alias("__size"), F.explode(spans_).alias("s")).filter("s.b > s.a")
    taken = taken.groupBy("doc_id", "__source", "__size").agg(F.collect_list("s").alias("__taken")).withColumnRenamed("doc_id", "__id")
    known = docs.withColumn("__words", size)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    joined = known.join(taken.hint("shuffle_hash"), same).select(*names, "__taken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                data, offsets = text_bytes(piece.column("text"))
                start, end, before = spans(data, offsets)
                rows, texts = [], []
                for row, taken in enumerate(piece.column(len(names)).to_pylist()):
                    n = int(before[row + 1] - before[row])
                    times = np.zeros(n + 1, np.int64)
                    np.add.at(times, [s["a"] for s in taken], 1)
                    np.add.at(times, [s["b"] for s in taken], -1)
                    times = np.cumsum(times)[:n]
                    for k in range(int(times.max(initial=0))):
                        own = np.flatnonzero(times > k)
                        if len(own) == n:
                            text = data[offsets[row] : offsets[row + 1]].tobytes()
                        else:
                            text = b" ".join(data[a:b].tobytes() for a, b in zip(start[before[row] + own], end[before[row] + own], strict=True))
                        rows.append(row)
                        texts.append(text.decode())
                out = pa.Table.from_batches([piece.select(names)]).take(pa.array(rows, pa.int64())).combine_chunks()
                columns = {n: out.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(out.column("n_chars").type)
                yield from pa.table(columns).to_batches()

    return joined.mapInArrow(cut, docs.schema)
