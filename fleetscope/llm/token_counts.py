"""Token counts through a digest cache.

A stored table maps (tokenizer digest, content digest) to a count. A run joins the
distinct contents against it, encodes only those it lacks, appends them, and reads
all counts from it. A copy of a text is encoded once, whatever the number of copies.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, per_worker, string_chunks, vocabulary
from .pieces import JoinedEncoder, PieceCache

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and the library's version: counts of another version never match."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def _whole(path: str):
    """``texts -> lists of ids``, whole texts, as the library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]


class LibraryEncoder:
    """Packed ids of whole texts. Byte-level vocabularies work by safe pieces, others text by text."""

    def __init__(self, path: str):
        self.whole = per_worker(_whole, path)
        self.cache, self.special = None, []
        if not path.endswith(".model"):
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            self.special = [t.content for t in model.get_added_tokens_decoder().values()]
            if model.normalizer is None and type(model.pre_tokenizer).__name__ == "ByteLevel":
                # A token of a byte-level vocabulary has one character for each byte.
                id_bytes = np.zeros(model.get_vocab_size(), np.int64)
                for token, i in model.get_vocab().items():
                    id_bytes[i] = len(token)
                self.cache = PieceCache(JoinedEncoder(self.whole, id_bytes))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, one after another, and where each text ends."""
        if self.cache is None:
            ids = [np.asarray(x, "<u4") for x in self.whole(texts.to_pylist())]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)
        # A special string may take white space beside it: such a text is not cut.
        uncut = sorted({i for s in self.special for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist()})
        own = self.whole([texts[i].as_py() for i in uncut]) if uncut else []
        return self.cache.of(texts, {i: np.asarray(ids, "<u4").tobytes() for i, ids in zip(uncut, own, strict=True)})

    def packed(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.of(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


def count_misses(misses: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``tokenizer, digest, n_tokens`` of ``digest, text`` (binary)."""
    path = vocabulary(tokenizer)
    version = tokenizer_digest(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(LibraryEncoder, path)
        for batch in batches:
            counts = []
            for _, _, texts in string_chunks(batch.column(1)):
                counts += np.diff(encoder.of(texts)[1], prepend=0).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column(0), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def token_counts(
    docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, through the cache at ``cache_path``.

    Normalised content is the text in UTF-8, null as empty: anything beyond would
    change counts. Repeated rows and null ids are kept, other columns dropped. The cache is
    created if it is absent and only ever appended to; a failed run leaves a valid
    cache, and two runs at a time at worst store a count twice.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(vocabulary(tokenizer))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    text = only(docs, id_column, text_column).select("doc_id", F.col("text").cast("binary").alias("text"))
    keyed = text.withColumn("digest", F.sha2("text", 256))

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # Copies collapse before the exchange, so a hot content is one row per task; both joins are on its key.
    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(known(), "digest", "left_anti")
    count_misses(misses, tokenizer).write.mode("append").parquet(cache_path)
    narrow = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = narrow.join(known(), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
