"""Language-model scores by a weighted backoff automaton.

The model is a smoothed bigram. A state is a word of the training texts, the root
stands for no history. The arc of state h for word w, present if the pair was seen, has weight

    (1 - f(h)) * c(h w) / c(h) + f(h) * p(w)

and leads to the state of w; the failure arc of h has weight f(h) and leads to the
root, whose arcs have the add-one probability p(w) = (c(w) + 1) / (N + V + 1),
unknown words included. The weights of a state sum to one. f(h) is the share of new
successors that a history seen c(h) times should expect, k / (k + c(h)^(1 - GROWTH)): the
number of different successors grows as a power of c(h). k is set so that the expected number of new pairs equals
the number of pairs seen once, the estimate of unseen mass. c(h) counts how often h was
followed by anything, so it is the sum of its pair counts.

Counts grow with the corpus, so no task or driver holds them all. Texts are packed
into blocks of a few MB of word numbers, stored once. A block sends its distinct words and pairs,
as sorted 64-bit hashes dealt out by range of hash, and gets their training counts
back: a frequent word or pair is one entry per block and range, whatever its frequency. From
these a task builds the part of the automaton that its block can reach, and runs all
texts of the block through it in one left-to-right traversal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, only, per_worker, stored, text_bytes, words

#: The number of different successors of a history grows as its count to this power.
GROWTH = 0.8
#: Bytes of text in a block, and texts in it at most (a text is never split).
BLOCK_BYTES, BLOCK_TEXTS = 10 << 20, 20_000
END = b"\n"
_END_HASH = WordHashes()[END]
_START = np.uint64(0x5851F42D4C957F2D)
BLOCKS = "block bigint, doc_ids binary, held binary, lengths binary, word_hashes binary, tokens binary"


def _pack(array: np.ndarray) -> bytes:
    """Bytes of an array, planes of equal significance together, deflated."""
    return zlib.compress(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def text_blocks(docs: DataFrame, held: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts as packed blocks of word numbers, stored."""
    rows = only(docs, id_column, text_column).select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.coalesce(held, F.lit(False)).alias("held")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, hashes = TaskContext.get().partitionId() << 32, per_worker(WordHashes)
        ids, flags, lengths, numbers, tokens, size = [], [], [], {}, [], 0

        def row() -> pa.RecordBatch:
            local = hashes.of(list(numbers))
            no_id = np.iinfo(np.int64).min
            values = [
                [block], [_pack(np.array([no_id if i is None else i for i in ids], np.int64))], [_pack(np.array(flags, np.uint8))],
                [_pack(np.array(lengths, np.int32))], [_pack(local)], [_pack(np.concatenate(tokens))],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)],
                ["block", "doc_ids", "held", "lengths", "word_hashes", "tokens"],
            )

        for batch in batches:
            for doc_id, data, flag in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                text = words(data)
                text.append(END)
                for word in set(text):
                    if word not in numbers:
                        numbers[word] = len(numbers)
                tokens.append(np.fromiter(map(numbers.__getitem__, text), np.int32, len(text)))
                ids.append(doc_id)
                flags.append(flag)
                lengths.append(len(text))
                size += len(data)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                    yield row()
                    block += 1
                    ids, flags, lengths, numbers, tokens, size = [], [], [], {}, [], 0
        if ids:
            yield row()

    return stored(rows.mapInArrow(run, BLOCKS), "text-blocks")


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash per token, hash of (history, word) per token, and starts and lengths of texts."""
    lengths = _unpack(row["lengths"], np.int32).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    word = _unpack(row["word_hashes"], np.uint64)[_unpack(row["tokens"], np.int32)]
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[starts] = _START
    return word, mix(mix(history) + word), starts, lengths


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def _requests(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``level, keys, training counts``: of words, of histories, of pairs; keys sorted and distinct."""
    word, pair, starts, lengths = _tokens(row)
    train = np.repeat(1 - _unpack(row["held"], np.uint8).astype(np.int64), lengths)
    yield 0, *_sums(word, train)
    yield 1, *_sums(pair, train)


def training_counts(blocks: DataFrame, ranges: int) -> DataFrame:
    """``block, level, part, keys, counts``: the corpus-wide training counts of every block's words and pairs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, bound = np.uint64(64 - 16), (np.arange(1, ranges, dtype=np.uint64) << np.uint64(16)) // np.uint64(ranges)
        for batch in batches:
            for row in batch.to_pylist():
                for level, keys, counts in _requests(row):
                    cuts = np.concatenate([[0], np.searchsorted(keys >> shift, bound), [len(keys)]])
                    out = [
                        {"block": row["block"], "level": level, "part": p, "keys": _pack_sorted(keys[i:j]), "counts": _pack(counts[i:j].astype(np.int64))}
                        for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i
                    ]
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    kinds = "block bigint, level int, part int, keys binary, counts binary"

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack_sorted(k) for k in group["keys"]]
        total_keys, totals = _sums(np.concatenate(keys), np.concatenate([_unpack(c, np.int64) for c in group["counts"]]))
        group["counts"] = [_pack(totals[np.searchsorted(total_keys, k)]) for k in keys]
        # The range's own sums travel once, with its first block.
        power = np.floor(np.log2(np.maximum(1, totals))).astype(np.int64)
        known = totals > 0
        sums = [totals.sum(), known.sum(), (totals == 1).sum(), *np.bincount(power[known], totals[known], 64).astype(np.int64), *np.bincount(power[known], minlength=64)]
        group["sums"] = [sums] + [None] * (len(group) - 1)
        return group[["block", "level", "part", "counts", "sums"]]

    asked = blocks.select("block", "held", "lengths", "word_hashes", "tokens").mapInArrow(ask, kinds)
    return asked.groupBy("level", "part").applyInPandas(answer, "block bigint, level int, part int, counts binary, sums array<bigint>")


def failure_weights(seen: np.ndarray, k: float) -> np.ndarray:
    """f(h) of histories seen so many times; 1 if never."""
    return np.where(seen > 0, k / (k + np.maximum(seen, 1.0) ** (1 - GROWTH)), 1.0)


def fitted_k(tokens: np.ndarray, words: np.ndarray, new: int) -> float:
    """k for which histories, ``words`` with ``tokens`` occurrences by power of two, expect ``new`` unseen pairs."""
    some = words > 0
    seen, tokens = tokens[some] / words[some], tokens[some]
    lo, hi = 1e-3, 1e3
    for _ in range(60):
        k = float(np.sqrt(lo * hi))
        lo, hi = (k, hi) if (tokens * failure_weights(seen, k)).sum() < new else (lo, k)
    return float(np.sqrt(lo * hi))


class Automaton:
    """The part of the model that the words and pairs of one block reach.

    State 0 is the root, state 1 the begin of a text, state 2 + k the k-th word. Arcs are the seen pairs,
    sorted by ``state * words + word``; ``fail`` has the weight of each state's failure arc.
    """

    def __init__(self, unigram: np.ndarray, seen: np.ndarray, arcs: np.ndarray, counts: np.ndarray, k: float):
        self.words, self.unigram, self.arcs = len(unigram), unigram, arcs
        state, word = np.divmod(arcs, max(1, self.words))
        fail = failure_weights(seen, k)
        self.fail = np.log10(fail)
        self.weight = np.log10((1 - fail[state]) * counts / seen[state] + fail[state] * 10.0 ** unigram[word])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log weights of reading ``word`` in ``state``: by its arc, else by the failure arc to the root."""
        key = state * self.words + word
        at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
        by_arc = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
        return np.where(by_arc, self.weight[at] if len(self.arcs) else 0.0, self.fail[state] + self.unigram[word])

    def run(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probabilities of all texts: one traversal, side by side, longest texts last to end."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        total, state = np.zeros(len(order)), np.ones(len(order), np.int64)
        alive = len(order)
        for t in range(int(lengths[0]) if len(order) else 0):
            while lengths[alive - 1] <= t:
                alive -= 1
            word = tokens[starts[:alive] + t]
            total[:alive] += self.step(state[:alive], word)
            state[:alive] = word + 2
        back = np.empty_like(total)
        back[order] = total
        return back


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scores(docs: DataFrame, held: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from rows for which ``held`` is not true (null ids are learnt from). Words are
    as in the contract, with one end token a text; null and empty texts are just their
    end. Repeated rows count and are scored each; other columns are dropped. Without
    rows the result is empty.
    """
    spark = docs.sparkSession
    blocks = text_blocks(docs, held_out(F.col(id_column)) if held is None else held, id_column, text_column)
    ranges = min(65_536, max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    answers = stored(training_counts(blocks, ranges), "training-counts")
    sums = answers.filter("sums IS NOT NULL").groupBy("level").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(131))).alias("sums"))
    totals = {r["level"]: np.array(r["sums"], np.float64) for r in sums.collect()}  # two rows
    words_, pairs = totals.get(0, np.zeros(131)), totals.get(1, np.zeros(131))
    n, v, k = int(words_[0]), int(words_[1]), fitted_k(words_[3:67], words_[67:], int(pairs[2]))

    def score(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = blocks.iloc[0].to_dict()
        word, pair, starts, lengths = _tokens(row)
        parts = answers.sort_values(["level", "part"])
        counts = [np.concatenate([_unpack(c, np.int64) for c in parts["counts"][parts["level"] == k]]) for k in (0, 1)]
        words_, number = np.unique(word, return_inverse=True)
        _, first, pair_number = np.unique(pair, return_index=True, return_inverse=True)
        c_word, c_pair = counts[0], counts[1]
        unigram = np.log10((c_word + 1) / (n + v + 1))
        # Every training occurrence of a word but the end is followed by a token.
        seen = np.concatenate([[0], [c_word[words_ == np.uint64(_END_HASH)].sum()], np.where(words_ == np.uint64(_END_HASH), 0, c_word)]).astype(np.float64)
        history = np.empty_like(number)
        history[1:] = number[:-1] + 2
        history[starts] = 1
        known = c_pair > 0
        arcs = (history[first] * len(words_) + number[first])[known]
        order = np.argsort(arcs)
        model = Automaton(unigram, seen, arcs[order], c_pair[known][order], k)
        ids = _unpack(row["doc_ids"], np.int64)
        return pd.DataFrame({
            "doc_id": pd.array([None if i == np.iinfo(np.int64).min else i for i in ids], "Int64"),
            "held_out": _unpack(row["held"], np.uint8).astype(bool), "n_tokens": lengths,
            "n_known": np.add.reduceat((c_word[number] > 0).astype(np.int64), starts),
            "train_tokens": n, "base_score": np.add.reduceat(unigram[number], starts), "score": model.run(number, starts, lengths),
        })

    return blocks.groupBy("block").cogroup(answers.select("block", "level", "part", "counts").groupBy("block")).applyInPandas(score, SCORES)
