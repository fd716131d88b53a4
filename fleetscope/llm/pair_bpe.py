"""BPE encoding by an index of pair occurrences, and decoding, without a tokenizer library.

The distinct words that a task meets for the first time are laid out as one sequence of byte
symbols, linked to their neighbours. An index maps each pair of neighbours to all its positions in
that sequence. The ranks that are active there are applied in ascending order: every
position of the lowest pair is merged at once, and only the lists of the pairs beside it grow. A vocabulary is
accepted if every merge needs symbols of lower ranks only; then a merge never wakes a lower rank, and
ascending order over all words is what each word alone would do.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, per_worker, string_chunks, vocabulary
from .pieces import PieceCache

#: Fixed values of the byte-level alphabet: these bytes stand for themselves, the others for 256, 257, ...
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: how a byte-level vocabulary splits texts into words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of the vocabulary's alphabet."""
    rest = [b for b in range(256) if b not in _PLAIN]
    return {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """``merges[left << 32 | right]`` is ``rank << 32 | merged symbol``; ``raw`` the bytes of each id."""

    byte_ids: list[int]
    merges: dict[int, int]
    raw: list[bytes]
    special: dict[str, int]


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a byte-level BPE vocabulary file. Any setting that this encoder does not follow is an error."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or odd:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    alphabet, ids = byte_alphabet(), model["vocab"]
    special = {}
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} has options that are not followed")
        special[t["content"]] = t["id"]
    raw = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        raw[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
    for token, i in special.items():
        raw[i] = token.encode()
    merges, made = {}, {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        if made.get(left, -1) >= rank or made.get(right, -1) >= rank or (len(left) > 1 and left not in made) or (len(right) > 1 and right not in made):
            raise ValueError(f"merge {rank} needs a symbol of a later rank")
        made.setdefault(left + right, rank)
        merges.setdefault(ids[left] << 32 | ids[right], rank << 32 | ids[left + right])
    own = {b: c for c, b in alphabet.items()}
    return Vocabulary([ids[own[b]] for b in range(256)], merges, raw, special)


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The packed ids of each word, by one pair occurrence index over all of them."""
    if not words:
        return []
    merges, lengths = vocabulary.merges, np.array([len(w) for w in words], np.int64)
    # One sequence of symbols; -1 stands before, between and after words and pairs with nothing.
    laid = np.frombuffer(b"\0" + b"".join(w + b"\0" for w in words), np.uint8)
    ends = np.concatenate([[0], np.cumsum(lengths + 1)])
    first = np.array(vocabulary.byte_ids, np.int64)[laid]
    first[ends] = -1
    keys = (first[:-1] << 32) | first[1:]
    keys[(first[:-1] < 0) | (first[1:] < 0)] = -1
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-2))
    index = {
        key: group.tolist()
        for key, group in zip(keys[order[cuts]].tolist(), np.split(order, cuts[1:]), strict=True)
        if key in merges
    }
    symbols, after, before = first.tolist(), list(range(1, len(first) + 1)), list(range(-1, len(first) - 1))
    ranks = [(merges[pair], pair) for pair in index]
    heapq.heapify(ranks)
    while ranks:
        merge, pair = heapq.heappop(ranks)
        left, right, new = pair >> 32, pair & 0xFFFFFFFF, merge & 0xFFFFFFFF
        # Earlier merges may have used a position; of overlapping ones the leftmost wins.
        for p in sorted(index.pop(pair)):
            q = after[p]
            if symbols[p] != left or symbols[q] != right:
                continue
            symbols[p], symbols[q] = new, -2
            after[p] = r = after[q]
            before[r] = p
            if (other := symbols[before[p]]) >= 0 and (key := other << 32 | new) in merges:
                if key not in index:
                    index[key] = []
                    heapq.heappush(ranks, (merges[key], key))
                index[key].append(before[p])
            if (other := symbols[r]) >= 0 and (key := new << 32 | other) in merges:
                if key not in index:
                    index[key] = []
                    heapq.heappush(ranks, (merges[key], key))
                index[key].append(p)
    last = np.array(symbols, np.int64)
    packed = last[last >= 0].astype("<u4").tobytes()
    at = (4 * np.cumsum(last >= 0))[ends].tolist()
    return [packed[i:j] for i, j in zip(at, at[1:])]


class PairEncoder:
    """Packed ids of whole texts; words met before come from the piece cache."""

    def __init__(self, path: str):
        self.vocabulary = load_vocabulary(path)
        self.split = regex.compile(_SPLIT)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.cache = PieceCache(self._pieces)

    def _pieces(self, missing: list[str]) -> list[bytes]:
        split = [[w.encode() for w in self.split.findall(p)] for p in missing]
        distinct = list({w for words in split for w in words})
        ids = dict(zip(distinct, encode_words(distinct, self.vocabulary), strict=True))
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array, one after another, and where each ends. Special strings inside a text are single ids."""
        given = {}
        if self.special is not None:
            ids = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.special.items()}
            for i in sorted({i for s in ids for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist()}):
                # Odd places of the split hold the special strings.
                parts = self.special.split(texts[i].as_py())
                plain = iter(self.cache.packed(parts[::2]))
                given[i] = b"".join(ids[p] if k % 2 else next(plain) for k, p in enumerate(parts))
        return self.cache.of(texts, given)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.of(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []

    def decoded(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.raw.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    docs = only(docs, id_column, text_column).withColumn("text", F.col("text").cast("binary"))
    return docs, docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: ids of every whole text as packed little-endian unsigned 32-bit integers (binary).

    Null and empty texts give no ids, null ids and repeated rows are kept, other columns are dropped.
    """
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(PairEncoder, path)
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                ids, ends = encoder.of(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())], ["doc_id", "ids"])

    rows, kind = _rows(docs, id_column, text_column)
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id, ids, text`` of ``doc_id, ids``. An id that the vocabulary lacks is an error."""
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(PairEncoder, path)
        for batch in batches:
            texts = [encoder.decoded(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: each chunk of texts is encoded, decoded, digested and freed in its task."""
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(PairEncoder, path)
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                flat, ends = encoder.of(texts)
                ids = [x.tobytes() for x in np.split(flat, ends[:-1])]
                sha = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [hashlib.sha256(encoder.decoded(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows, kind = _rows(docs, id_column, text_column)
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
