"""Helpers of the training-data operators: shared storage, words, hashes, bounded batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A semi join's key side is broadcast up to so many counted keys; beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000
#: Text bytes that a Python helper holds as arrays at a time; longer texts are taken alone.
CHUNK_BYTES = 2 << 20
#: Estimated bytes of a per-worker cache; an entry costs its contents and some ``ENTRY_BYTES`` of objects and table.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 180
#: Longer keys are never kept: one text without blanks must not fill a cache.
KEPT_KEY = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A ``local[n]`` session without that setting, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fleetscope-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``stored``, with aggregates of the rows that are taken while they are written, not by a job of their own."""
    seen = Observation()
    rows = stored(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return rows, seen.get


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``stored`` and the number of rows."""
    rows, seen = measured(df, name, n=F.count(F.lit(1)))
    return rows, seen["n"]


def semi_join(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi", bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows whose ``on`` is among ``keys``, or with ``left_anti`` is not; only a counted, bounded key set is broadcast."""
    keys, n = counted(keys.select(on).distinct(), "keys")
    return rows.join(F.broadcast(keys) if n <= bound else keys, on, how)


def only(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text``: extra columns dropped, null text empty."""
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary array, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lengths(column: pa.Array) -> list[int]:
    """Bytes of each value of a string or binary array, null as 0."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def plain_text(column: pa.Array) -> list[str]:
    """Texts of a binary column; bytes that are no UTF-8 become U+FFFD."""
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """``first row, end, texts`` of chunks of a binary column; only one chunk at a time exists as Python strings."""
    for i, j in chunks(lengths(column)):
        yield i, j, plain_text(column[i:j])


def string_chunks(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """``first row, end, texts`` of chunks of a binary column, as string arrays; null as empty, no UTF-8 as U+FFFD."""
    for i, j in chunks(lengths(column)):
        try:
            texts = column[i:j].cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array(plain_text(column[i:j]), pa.string())
        yield i, j, pc.fill_null(texts, "")


def words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: exactly what bytes methods do."""
    return data.lower().split()


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most ``most`` together, or one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


class WordHashes(dict):
    """Cache of 64-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_KEY:
            self[word] = value
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) * ENTRY_BYTES > CACHE_BYTES:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of the documents at ``starts``, and the document of each.

    A document of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(width, n)):
        rolled[: n - k] = mix(rolled[: n - k] + hashes[k:])
    counts = np.maximum(lengths - width + 1, 0)
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    positions = np.arange(counts.sum()) - first[owner] + starts[owner]
    found = rolled[positions]
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        whole = [int(xxhash.xxh3_64_intdigest(hashes[starts[i] : starts[i] + lengths[i]].tobytes(), seed=int(lengths[i]))) for i in short]
        found = np.concatenate([found, np.array(whole, np.uint64)])
        owner = np.concatenate([owner, short])
    return found, owner


def per_worker(build: Callable, *key):
    """``build(*key)``, kept in a Python worker until a builder of another module is asked for.

    Workers serve one operator after the other; what the last one kept must not stay.
    """
    cache = per_worker.__dict__.setdefault("cache", {})
    for other in [at for at in cache if at[0] != build.__module__]:
        del cache[other]
    at = (build.__module__, build.__qualname__, *key)
    if at not in cache:
        cache[at] = build(*key)
    return cache[at]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file; every executor has the same package."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)
