"""Benchmark passages in documents, by SimHash windows and multi-index Hamming blocks.

A window has as many words as the benchmark item it is held against and is aligned
with it on a shared shingle. Windows and items get 64-bit SimHash fingerprints of their weighted shingles (a
shingle weighs as often as it occurs). Fingerprints are cut into ``RADIUS + 1`` blocks: two
that differ in at most ``RADIUS`` bits agree in a block, so the join on blocks finds all
pairs within the radius. The candidates are decided on the weighted similarity, the sum of
the smaller over the sum of the larger weights. Everything is built-in expressions.

Documents that cannot reach the threshold are left before any fingerprint is made, by a bound
that loses nothing: such a window holds at least that share of the item's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, counted, measured, semi_join, stored

WIDTH, THRESHOLD = 5, 0.8
#: At similarity 0.8 fingerprints differ in 9.7 bits on average, deviation 2.9.
RADIUS = 20
WORD = r"[\p{L}\p{N}]+"


def word_list(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: str, width: int) -> Column:
    """Hashes of all shingles of ``width`` words, by position."""
    count = F.size(words) - (width - 1)
    at = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.xxhash64(F.lit(width), *(F.element_at(words, (i + k).cast("int")) for k in range(width))),
    )
    return F.when(count > 0, at).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(hashes: str) -> Column:
    """Sign of the weighted sum of each bit over a group's rows of one shingle hash."""
    # Bits b and b + 32 are counted in the halves of one number; arrays, and so groups, have less than 2^31 shingles.
    pair = F.lit(0x1_0000_0001)
    sums = [F.sum(F.shiftright(hashes, b).bitwiseAND(pair)) for b in range(32)]
    ones = [s.bitwiseAND(F.lit(0xFFFF_FFFF)) for s in sums] + [F.shiftrightunsigned(s, 32) for s in sums]
    bits = [F.shiftleft((n * 2 > F.count(hashes)).cast("bigint"), b) for b, n in enumerate(ones)]
    # Added in pairs: a chain of 64 operators would be deep.
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def _blocks(fingerprint: str) -> Column:
    """``array<struct<block, value>>``: the fingerprint cut into ``RADIUS + 1`` blocks."""
    cuts = [round(k * 64 / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return F.array(*(
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
    ))


def leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, similarity, window_start, window_words``: a row per document and item it holds.

    The row is that of the most similar window, then the first. Windows are clipped to
    the document. Items of fewer than five words are one shingle; items and documents without words,
    and null texts, match nothing. Rows with a null id are left out. Rows sharing
    an id are taken apart by text and give the best of them. Extra columns are dropped.
    """
    items = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), word_list(F.col(item_text)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("item", F.xxhash64("item_id", "words"))
    items = items.withColumn("width", F.least(F.lit(WIDTH), "n")).dropDuplicates(["item"])
    items, seen = measured(items, "items", **{f"n{w}": F.count_if(F.col("width") == w) for w in range(1, WIDTH + 1)})
    widths = [w for w in range(1, WIDTH + 1) if seen[f"n{w}"]]
    docs = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    # A row's own key: rows of one id with other texts stay apart, whatever their number.
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    found = None
    for width in widths:
        part = _leaks(docs, items.filter(F.col("width") == width), width, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        key = docs.select("doc_id").limit(0)
        found = key.crossJoin(items.select("item_id").limit(0)).selectExpr("doc_id", "item_id", "0D AS similarity", "0 AS window_start", "0 AS window_words")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("window_start")).alias("back"), "window_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("window_start"), "b.window_words")


def _leaks(docs: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    # Every shingle of every document against those of the items.
    wanted = items.select("item", "item_id", "n", F.posexplode(_shingles("words", width)).alias("item_pos", "h"))
    wanted, n_wanted = counted(wanted, "item-shingles")
    few = n_wanted <= BROADCAST_KEYS
    placed = wanted.groupBy("h").agg(F.collect_list(F.struct("item", "item_pos", "n")).alias("at")) if few else wanted.select("h", F.array(F.struct("item", "item_pos", "n")).alias("at"))
    every = docs.select("doc", word_list(F.col("text")).alias("words")).select("doc", F.posexplode(_shingles("words", width)).alias("pos", "h"))
    hits = every.join(F.broadcast(placed) if few else placed, "h").select("doc", "pos", F.explode("at").alias("at"))
    hits = stored(hits.select("doc", "at.item", "at.n", "pos", (F.col("pos") - F.col("at.item_pos")).alias("start")), "hits")
    # A window at the threshold holds that share of the item's shingles.
    enough = hits.groupBy("doc", "item", "n").agg(F.countDistinct("pos").alias("shared")).filter(F.col("shared") >= threshold * (F.col("n") - width + 1))
    spots = stored(hits.join(enough.select("doc", "item"), ["doc", "item"]).select("doc", "n", "start").distinct(), "spots")

    texts = semi_join(docs, spots, "doc").dropDuplicates(["doc"])
    hashed = texts.select("doc", "doc_id", word_list(F.col("text")).alias("words")).select("doc", "doc_id", F.size("words").alias("n_words"), _shingles("words", width).alias("hashes"))
    begin, end = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("n"), "n_words")
    windows = hashed.join(spots, "doc").select("doc", "doc_id", "n", "start", begin.alias("begin"), (end - begin).alias("words"), "hashes")
    windows = windows.filter(F.col("words") >= width).withColumn("hashes", F.slice("hashes", F.col("begin") + 1, F.col("words") - (width - 1)))
    windows = stored(windows, "windows")
    key = ["doc", "n", "start"]
    window_rows = windows.select(*key, F.explode("hashes").alias("h"))
    window_prints = window_rows.groupBy(*key).agg(_fingerprint("h").alias("print"))
    item_prints = wanted.groupBy("item", "n").agg(_fingerprint("h").alias("item_print"))

    left = window_prints.withColumn("b", F.explode(_blocks("print")))
    right = item_prints.withColumn("b", F.explode(_blocks("item_print")))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    candidates = left.join(right, ["n", "b"]).filter(near).select(*key, "item").distinct()

    window_weights = window_rows.groupBy(*key, "h").agg(F.count("*").alias("w"))
    item_weights = wanted.groupBy("item", "h").agg(F.count("*").alias("v"))
    common = candidates.join(window_weights, key).join(item_weights, ["item", "h"]).groupBy(*key, "item").agg(F.sum(F.least("w", "v")).alias("common"))
    sized = common.join(windows.select(*key, "doc_id", "begin", "words"), key).join(items.select("item", "item_id"), "item")
    union = F.col("words") - (width - 1) + F.col("n") - (width - 1) - F.col("common")
    return sized.withColumn("similarity", F.col("common") / union).filter(F.col("similarity") >= threshold).select(
        "doc_id", "item_id", "similarity", F.col("begin").alias("window_start"), F.col("words").alias("window_words")
    )
