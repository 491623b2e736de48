"""Token ids as flat binary files that readers map into memory.

A folder holds, for each part (ascending: part 0 has the smallest doc_ids):

- ``part-00000.bin``: ids, little-endian unsigned integers of 16 bits where the
  vocabulary allows it, of 32 bits else; nothing but ids;
- ``part-00000.off``: 64-bit offsets into it, one more than documents, from 0;
- ``part-00000.doc``: the documents' ids, 64-bit (null ids come first);

and, for all parts, ``bases.off`` (64-bit: ids before each part, from prefix sums of the
parts' totals, one more than parts) and ``format.json``.  A document's place in the
whole is its part's base plus its offset.

Texts are encoded where they are and stored as bytes; then the ids, not the texts, are
dealt by ranges of doc_id.  A task writes under a name of its own and renames the files when
they are whole, and the same rows make the same file, so a repeated task does no harm.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probspark.llm.common import by_bytes, fresh_path, remove, stored
from probspark.llm.token_ids import encoder
from probspark.llm.words import pieces

END_ID = 2
PART_BYTES = 64 << 20
SLICE_IDS = 8 << 20
FILES = (".bin", ".off", ".doc")


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system (local or shared mount, hdfs, s3, gs) and path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith(("/", "file:")) else (fs.LocalFileSystem(), folder)


def _name(part: int) -> str:
    return f"part-{part:05d}"


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, tie, row, ids``: each document's ids and the end id as bytes of the file's integers."""
    kind = id_type(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, row = TaskContext.get(), 0
        row = (context.partitionId() if context else 0) << 40
        tokens = encoder(tokenizer_path, keep_space=False)
        for batch in batches:
            for piece in pieces(batch):
                found = [np.append(ids, ids.dtype.type(end_id)).astype(kind).tobytes() for ids in tokens.ids(piece.column("text"))]
                rows = pa.array(np.arange(row, row + len(piece)))
                row += len(piece)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([zlib.crc32(x) for x in found], pa.int64()), rows, pa.array(found, pa.binary())], ["doc_id", "tie", "row", "ids"])

    rows = by_bytes(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, row long, ids binary")


def id_type(tokenizer_path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _writer(folder: str, width: int):
    """Writes the rows of a task, in order, as one part; gives ``part, documents, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(folder)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        lengths, documents, nulls = [], [], 0
        with system.open_output_stream(f"{root}/.{own}.bin") as out:
            for batch in batches:
                column = batch.column("ids")
                _, offsets, data = column.buffers()
                offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
                if len(column):
                    out.write(memoryview(data)[int(offsets[0]) : int(offsets[-1])])
                lengths.append(np.diff(offsets) // width)
                nulls += batch.column("doc_id").null_count
                documents.append(batch.column("doc_id").fill_null(0).to_numpy())
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *lengths]), dtype="<i8")
        with system.open_output_stream(f"{root}/.{own}.off") as out:
            out.write(ends.astype("<u8").tobytes())
        with system.open_output_stream(f"{root}/.{own}.doc") as out:
            out.write(np.concatenate([np.zeros(0, np.int64), *documents]).astype("<i8").tobytes())
        for kind in FILES:
            system.move(f"{root}/.{own}{kind}", f"{root}/{_name(part)}{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(ends) - 1, nulls, int(ends[-1]))], ["part", "documents", "nulls", "ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, parts: int | None = None) -> dict:
    """Writes the ids of ``docs`` (``doc_id, text``) to ``folder`` in ascending doc_id order and returns its format.

    Null and empty texts are the end id alone.  Null doc_ids come first; rows of one
    doc_id stand by a checksum of their ids, repeated rows each have their place.
    Other columns are not read.  An empty table makes a folder without documents.  A
    document is never split over parts.  ``parts``: one for 64 MB of ids if not given.
    ``folder`` must be one that all executors share, on a file system that pyarrow opens.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer_path, end_id)
    width = int(kind[2])
    kept = fresh_path(spark, "encoded-documents")
    rows = stored(encoded(docs, tokenizer_path, end_id), "encoded-documents", kept, "zstd")
    if parts is None:
        total = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    system, root = _at(folder)
    system.create_dir(root, recursive=True)
    ordered = rows.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    made = ordered.select("doc_id", "ids").mapInArrow(_writer(folder, width), "part long, documents long, nulls long, ids long").collect()  # a row per file
    remove(spark, kept)
    made = sorted(made, key=lambda r: r.part)
    bases = np.cumsum([0, *(r.ids for r in made)], dtype="<u8")
    about = {
        "ids": kind, "end_id": end_id, "parts": [r.part for r in made], "documents": [r.documents for r in made],
        "null_doc_ids": [r.nulls for r in made], "bases": [int(b) for b in bases],
    }
    for name, data in (("bases.off", bases.tobytes()), ("format.json", json.dumps(about).encode())):
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
    return about


def read_format(folder: str) -> dict:
    system, root = _at(folder)
    with system.open_input_stream(f"{root}/format.json") as f:
        return json.loads(f.read())


class Part:
    """One part, mapped into memory where its file system is a mounted one, read by ranges elsewhere."""

    def __init__(self, folder: str, part: int, kind: str):
        system, root = _at(folder)
        local = isinstance(system, fs.LocalFileSystem)
        self.files = {k: pa.memory_map(f"{root}/{_name(part)}{k}") if local else system.open_input_file(f"{root}/{_name(part)}{k}") for k in FILES}
        self.kind = np.dtype(kind)

    def _read(self, file: str, kind: np.dtype, start: int, stop: int) -> np.ndarray:
        held = self.files[file]
        held.seek(start * kind.itemsize)
        return np.frombuffer(held.read_buffer((stop - start) * kind.itemsize), kind)

    def offsets(self, start: int, stop: int) -> np.ndarray:
        """Offsets of documents start to stop, and where the last one ends."""
        return self._read(".off", np.dtype("<u8"), start, stop + 1).astype(np.int64)

    def doc_ids(self, start: int, stop: int) -> np.ndarray:
        return self._read(".doc", np.dtype("<i8"), start, stop)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return self._read(".bin", self.kind, start, stop)

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def read_token_files(spark: SparkSession, folder: str, documents: int = 20_000) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a folder of token files, from the files alone.

    ``start``: ids of all documents before it.  ``ids_crc32``: of its ids as unsigned
    32-bit integers.  A task reads ``documents`` documents at a time, of one part.
    """
    about = read_format(folder)
    slices = [
        (part, first, min(first + documents, n), nulls, base)
        for part, n, nulls, base in zip(about["parts"], about["documents"], about["null_doc_ids"], about["bases"][:-1], strict=True)
        for first in range(0, n, documents)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(folder, row["part"], about["ids"])
                ends = part.offsets(row["first"], row["last"])
                crcs = [_crc32(part, a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                null = np.arange(row["first"], row["last"]) < row["nulls"]
                columns = [pa.array(part.doc_ids(row["first"], row["last"]), mask=null), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())]
                part.close()
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(slices, "part long, first long, last long, nulls long, base long").repartition(max(1, len(slices)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _crc32(part: Part, start: int, stop: int) -> int:
    crc = 0
    for at in range(start, stop, SLICE_IDS):
        crc = zlib.crc32(part.ids(at, min(at + SLICE_IDS, stop)).astype("<u4").tobytes(), crc)
    return crc
