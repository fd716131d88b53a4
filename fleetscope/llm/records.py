"""Token ids as length-delimited binary records with an offset index.

A record is

    length  unsigned 64 bit, little-endian: bytes of data
    masked checksum of the length field, unsigned 32 bit
    data    kind (1 byte: 2 or 4 bytes an id, plus 8 if there is no doc_id), doc_id (signed 64 bit), ids little-endian
    masked checksum of the data, unsigned 32 bit

A checksum c (CRC-32) is stored rotated right by 15 bits plus 0xA282EAD8, so a
checksum of data that hold checksums stays sound. The index file of a part has, per
record, the byte offset and the number of ids as unsigned 64-bit integers: a reader
can fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, only, per_worker, stored, string_chunks, vocabulary
from .storage import PartFile, create_folder, new_stem, open_part
from .token_counts import LibraryEncoder

#: A part is closed once it has so many bytes; a record is never split.
PART_BYTES = 32 << 20
_NO_ID = 8
CHECKS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
PARTS = "folder string, part string, bytes bigint, records bigint, n_ids bigint, first_doc bigint, last_doc bigint, task int, seq int"


def masked(checksum: int) -> int:
    """The stored form of a CRC."""
    return (((checksum >> 15) | (checksum << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), data, struct.pack("<I", masked(zlib.crc32(data)))))


def read_frame(stream) -> bytes | None:
    """The next record's data; None at the end. A wrong length or checksum is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", head[:8])[0]
    data, tail = stream.read(n), stream.read(4)
    if len(data) < n or len(tail) < 4 or masked(zlib.crc32(data)) != struct.unpack("<I", tail)[0]:
        raise ValueError("damaged record data")
    return data


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<Bq", width if doc_id is not None else width | _NO_ID, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    kind, doc_id = struct.unpack_from("<Bq", data)
    return None if kind & _NO_ID else doc_id, np.frombuffer(data, f"<u{kind & ~_NO_ID}", offset=9).astype("<u4")


def write_records(
    docs: DataFrame, folder: str | None = None, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
    part_bytes: int = PART_BYTES, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes records in ascending doc_id order.

    Returns the stored list of parts: ``folder, part, bytes, records, n_ids,
    first_doc, last_doc, task, seq``; ``(task, seq)`` orders the parts. Null text is
    empty, null ids come first, rows that share an id follow each other in the order
    of their text. Range partitions split on the id and a hash of the text, so many
    rows of one id need not share a task.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    create_folder(folder)
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_worker(LibraryEncoder, path)
        task, seq, part, done, end = TaskContext.get().partitionId(), 0, None, [], np.array([end_id], "<u4")

        def finish():
            index.write(np.array(offsets, "<u8").tobytes())
            index.close()
            part.close()
            done.append((folder, part.name, part.size, len(offsets), n_ids, first, last, task, seq))

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, texts in string_chunks(batch.column(1)):
                flat, ends = encoder.of(texts)
                for doc_id, own in zip(doc_ids[i:j], np.split(flat, ends[:-1]), strict=True):
                    if part is None:
                        stem = new_stem()
                        part, index = PartFile(folder, stem + ".rec"), PartFile(folder, stem + ".idx")
                        offsets, n_ids, first = [], 0, doc_id
                    ids = np.concatenate([own, end])
                    offsets.append((part.write(frame(serialize(doc_id, ids))), len(ids)))
                    n_ids, last = n_ids + len(ids), doc_id
                    if part.size >= part_bytes:
                        finish()
                        part, seq = None, seq + 1
        if part is not None:
            finish()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, row, strict=True)) for row in done], schema=pa.schema(kinds)
        )

    names = ["folder", "part", "bytes", "records", "n_ids", "first_doc", "last_doc", "task", "seq"]
    kinds = [(n, pa.string() if k < 2 else pa.int64() if k < 7 else pa.int32()) for k, n in enumerate(names)]
    rows = only(docs, id_column, text_column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    parts = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order).mapInArrow(run, PARTS)
    return stored(parts, "parts")


def read_records(parts: DataFrame, checks: bool = False) -> DataFrame:
    """``doc_id, start, ids`` of all records; ``start`` counts the ids of all records before.

    With ``checks`` the rows are those of ``record_digests``, made as the records are read. Reads part by part as a stream, checks every length and checksum and the counts
    of the list. The running total of parts is a window over the list of parts alone,
    one row per part of some 32 MB.
    """
    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = placed.select("folder", "part", "records", "n_ids", "start")

    make = _check_batch if checks else _batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, records, rows, size = row["start"], 0, [], 0
                with open_part(row["folder"], row["part"]) as stream:
                    while (data := read_frame(stream)) is not None:
                        doc_id, ids = deserialize(data)
                        rows.append((doc_id, start, ids))
                        start, records, size = start + len(ids), records + 1, size + len(ids)
                        if size > 1 << 20:
                            yield make(rows)
                            rows, size = [], 0
                if (records, start - row["start"]) != (row["records"], row["n_ids"]):
                    raise ValueError(f"part {row['part']} is incomplete")
                if rows:
                    yield make(rows)

    spread = placed.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism * 2), "part")
    return spread.mapInArrow(run, CHECKS if checks else "doc_id bigint, start bigint, ids array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r[2]) for r in rows], out=offsets[1:])
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[2] for r in rows]).astype("<i4")))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), ids], ["doc_id", "start", "ids"]
    )


def _check_batch(rows: list[tuple]) -> pa.RecordBatch:
    found = [(doc_id, start, len(ids), zlib.crc32(ids.tobytes())) for doc_id, start, ids in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def record_digests(records: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of ``doc_id, start, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.values.to_numpy().astype("<u4").tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return records.mapInArrow(run, CHECKS)


def read_at(folder: str, part: str, ordinals: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of a part by their place, through its index: the access a shuffled reader needs."""
    with open_part(folder, part.removesuffix(".rec") + ".idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    found = []
    with open_part(folder, part) as stream:
        for k in ordinals:
            stream.seek(int(index[k, 0]))
            found.append(deserialize(read_frame(stream)))
    return found
