"""Byte-level BPE encoding and decoding with a local rank file.

A long text is cut where a match of the split pattern is sure to end: before a blank or
line break that follows a printable ASCII character, or between closing punctuation and a
letter. Cutting there changes no match, so the segments' ids are the text's ids and the library never
holds more than a segment. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, only, per_worker, text_chunks, vocabulary

#: Characters a segment holds at least before it is cut.
SEGMENT = 1 << 16
#: Before white space, or before a letter (ASCII, Han, kana, Hangul) that follows punctuation other than an apostrophe.
_SAFE = re.compile("(?<=[!-~])(?=[ \n])|(?<=[.,;:!?。、，！？])(?=[A-Za-z一-龥ぁ-ゖァ-ヺ가-힣])")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters; concatenating gives it back.

    Without a boundary the rest stays whole.
    """
    out, start = [], 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def tiktoken_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_ids(encoding, text: str, size: int = SEGMENT) -> np.ndarray:
    """Ids of a whole text; nothing in it counts as a special token."""
    return np.concatenate([encoding.encode_to_numpy(s, disallowed_special=()) for s in segments(text, size)]).astype("<u4")


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, "<i4"), *ids]).astype("<i4")))


def _texts(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    docs = only(docs, id_column, text_column).withColumn("text", F.col("text").cast("binary"))
    return docs, docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, in text order.

    Null and empty texts give an empty list; repeated rows and null ids are kept;
    other columns are dropped. ``ranks`` is a public vocabulary's name or a path that
    every executor has.
    """
    path = vocabulary(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = per_worker(tiktoken_encoding, path)
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], id_lists([text_ids(encoding, t) for t in texts])], ["doc_id", "ids"])

    rows, kind = _texts(docs, id_column, text_column)
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _list_chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a list column with some 8 MB of ids together."""
    sizes = column.value_lengths().fill_null(0).to_pylist()
    return chunks([4 * n for n in sizes], 8 << 20)


def decode(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids``, to ``doc_id, ids``. An id outside the ranks is an error."""
    path = vocabulary(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = per_worker(tiktoken_encoding, path)
        for batch in batches:
            for i, j in _list_chunks(batch.column(1)):
                ids = batch.column(1)[i:j]
                decoded = [encoding.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], ids, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` of ``doc_id, ids, decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            packed = [x.values.to_numpy().astype("<u4").tobytes() if x.is_valid else b"" for x in ids]
            sha = [hashlib.sha256(p).hexdigest() for p in packed]
            back = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = decoded.schema["doc_id"].dataType.simpleString()
    return decoded.select("doc_id", "ids", "decoded").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def round_trip(
    docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", keep_ids: bool = True, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256``: encoding, decoding and digests in one pass over the texts.

    The rows are those of ``digests(decode(encode(docs)))``. A task holds one worker and one chunk of texts
    with its ids and bytes, freed before the next. Without ``keep_ids`` the ids are digested and dropped.
    """
    path = vocabulary(ranks)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = per_worker(tiktoken_encoding, path)
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(1)):
                ids, rows = [], []
                for text in texts:
                    own = text_ids(encoding, text)
                    rows.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(encoding.decode_bytes(own.tolist())).hexdigest()))
                    if keep_ids:
                        ids.append(own)
                values = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
                named = [id_lists(ids)] if keep_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *named, *values], ["doc_id", *["ids"] * keep_ids, *kinds])

    rows, kind = _texts(docs, id_column, text_column)
    return rows.mapInArrow(run, f"doc_id {kind}, " + "ids array<int>, " * keep_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
