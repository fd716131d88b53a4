"""Near-duplicate groups by b-bit MinHash.

Every distinct word sequence gets 128 minima of its shingle hashes. 32 bands of 4 minima
generate candidates: two texts that share a band meet in its bucket; at similarity 0.8 a pair
misses all bands with probability 5e-8. The lowest ``BITS`` bits of the minima are
packed into a signature whose matching positions give an estimate, corrected for
collisions by chance; pairs far below the threshold are left. What remains is decided on
the full shingle sets.

In each of ``LEADER_ROUNDS`` rounds a bucket has one
leader, every member outside its component is estimated against it, and a text checks its
best leader only: linear in the bucket, whatever its size. A leader has met its bucket and leaves it. What is left
of a bucket, where it still holds several regions, is estimated block against block, so no pair that shares a band stays
without an estimate. Texts that hang together by estimates but not by links form a region. Its members outside the region's largest component are compared with all of
it, in blocks: estimates, then full sets, inside the task, which gives links and no pairs. Exact copies take part as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, counted, mix, only, per_worker, semi_join, shingle_hashes, stored, text_bytes, words
from .components import counted_components

PERMUTATIONS, ROWS, BITS = 128, 4, 2
LEADER_ROUNDS = 2
#: Members of a block where the rest of a region is compared.
BLOCK = 384
#: Members of a block where the rest of a bucket is estimated; these carry no texts.
SIGNATURE_BLOCK = 4096
#: How far the estimate of a linked pair may fall below the threshold: 5 standard deviations at 0.8.
MARGIN = 0.21
_FACTORS = np.random.default_rng(20_240_229).integers(1, 2**32, (2, PERMUTATIONS), dtype=np.uint64).astype(np.uint32)
_FACTORS[0] |= 1
SIGNATURES = "doc_id bigint, key binary, digest binary, n_shingles bigint, bands array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
_SIGNATURE = ["s0", "s1", "s2", "s3"]


def minima(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """``texts x PERMUTATIONS`` minima; ``owner`` ascends and names every text."""
    out = np.empty((texts, PERMUTATIONS), np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    # Ranges that stay in a core's cache while all permutations pass over them.
    first = np.searchsorted(owner, np.arange(texts + 1))
    for i, j in chunks(np.diff(first).tolist(), 1 << 15):
        part, cuts = low[first[i] : first[j]], first[i:j] - first[i]
        for p in range(PERMUTATIONS):
            out[i:j, p] = np.minimum.reduceat((part ^ _FACTORS[1, p]) * _FACTORS[0, p], cuts)
    return out


def keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, text, key``: an id may stand on several texts, ``key`` tells them apart."""
    text = F.col("text").cast("binary")
    return only(docs, id_column, text_column).select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def signatures(docs: DataFrame, width: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: key of its text, digest of its word sequence, size of its shingle set, band keys and packed signature.

    Texts without words have size 0 and no bands.
    """
    rows = keyed_texts(docs, id_column, text_column).select("doc_id", "text", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker(WordHashes)
        for batch in batches:
            data = text_bytes(batch.column(1))
            for i, j in chunks([len(d) for d in data]):
                yield _signed([batch.column(0)[i:j], batch.column(2)[i:j]], data[i:j], width, cache)

    return rows.mapInArrow(run, SIGNATURES)


def _signed(ids: list[pa.Array], data: list[bytes], width: int, cache: WordHashes) -> pa.RecordBatch:
    tokens = [words(d) for d in data]
    digests = [xxhash.xxh3_128_digest(b" ".join(t)) for t in tokens]
    lengths = np.array([len(t) for t in tokens], np.int64)
    hashes = cache.of([w for t in tokens for w in t])
    found, owner = shingle_hashes(hashes, np.cumsum(lengths) - lengths, lengths, width)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(data))
    full = np.flatnonzero(sizes)
    low = minima(found, np.searchsorted(full, owner), len(full)) if len(full) else np.zeros((0, PERMUTATIONS), np.uint32)
    bands = np.zeros((len(full), PERMUTATIONS // ROWS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(31) + low[:, r::ROWS].astype(np.uint64))
    bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64)).view(np.int64)
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & 1
    packed = np.packbits(bits.reshape(len(full), PERMUTATIONS * BITS).astype(np.uint8), axis=1).view("<i8")
    offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands.shape[1])]).astype(np.int32)
    signature = np.zeros((len(data), len(_SIGNATURE)), np.int64)
    signature[full] = packed
    columns = [*ids, pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1)))]
    return pa.RecordBatch.from_arrays(
        [*columns, *(pa.array(np.ascontiguousarray(signature[:, k]), pa.int64()) for k in range(4))],
        ["doc_id", "key", "digest", "n_shingles", "bands", *_SIGNATURE],
    )


def estimate(left: str, right: str) -> Column:
    """Similarity from two packed signatures: equal positions, less those equal by chance."""
    ones = F.lit(0x5555555555555555)
    equal = F.lit(PERMUTATIONS)
    for s in _SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        equal = equal - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    chance = 2.0**-BITS
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def shingle_set(data: bytes, width: int) -> set[tuple]:
    """Distinct shingles of a text; with fewer words the whole sequence."""
    t = words(data)
    return {tuple(t[i : i + width]) for i in range(len(t) - width + 1)} if len(t) >= width else {tuple(t)} if t else set()


def similar(a: set, b: set, percent: int) -> bool:
    common = len(a & b)
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def similar_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full shingle sets have ``100 * intersection >= percent * union``."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, mine = [], None, set()
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, mine = a, shingle_set(ta, width)
                keep.append(similar(mine, shingle_set(tb, width), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _split(own: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of the groups that hold several ``comp``: with the ``largest`` and the numbers of blocks outside it, ``xs``, and of all, ``ys``."""
    sizes = own.groupBy(group, "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy(group).agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most")).filter("n > most.n")
    split = split.select(group, F.col("most.comp").alias("largest"), F.ceil(F.col("n") / block).alias("ys"), F.ceil((F.col("n") - F.col("most.n")) / block).alias("xs"))
    return own.join(split, group)


def _dealt(inside: DataFrame, lot: Column) -> tuple[DataFrame, DataFrame]:
    """Rows outside the largest component and all rows, with the places ``x, y`` where each block of the ones meets each of the others."""
    every = inside.withColumn("y", F.pmod(lot, "ys")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)))
    apart = inside.filter("comp <> largest").withColumn("x", F.pmod(lot, "xs")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)))
    return apart, every


def _named(buckets: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``bucket, m, comp`` with the labels of ``node`` in ``label``; a member without one stands for itself."""
    named = buckets.select("bucket", "m", F.col("m.doc_id").alias("node")).join(labels, "node", "left")
    return named.select("bucket", "m", F.coalesce(label, "node").alias("comp"))


def _joined(labels: tuple[DataFrame, int], edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The components of ``labels`` after ``n`` more edges; both with a bound of their rows."""
    rows, known = labels
    return counted_components(rows.toDF("a", "b").unionByName(edges.select("a", "b")), known + n) if n else labels


def bucket_links(buckets: DataFrame, possible: Column) -> DataFrame:
    """Members ``a, b`` of one bucket but not of one ``comp`` for which ``possible`` holds, one ``b`` per text and component.

    Members outside a bucket's largest component meet all of it, block against block, whatever its size.
    """
    apart, every = _dealt(stored(_split(buckets, "bucket", SIGNATURE_BLOCK), "bucket-rest"), F.xxhash64("m.doc_id"))
    every = every.select("bucket", "x", "y", F.col("m").alias("o"), F.col("comp").alias("o_comp"))
    met = apart.select("bucket", "x", "y", "m", "comp").join(every, ["bucket", "x", "y"]).filter(possible)
    return met.groupBy(F.col("m.doc_id").alias("a"), "o_comp").agg(F.min("o.doc_id").alias("b")).select("a", "b")


def region_links(regions: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that join the components of each region, found block against block.

    A region's members are dealt to blocks of some ``BLOCK`` by a hash of their id; those outside
    its largest component, in blocks too, meet every block. So a task holds two blocks,
    whatever the size of a region, and gives back one link per text and component at most.
    """
    own = regions.join(labels, "node", "left").select("region", F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("comp"))
    inside, n = counted(_split(own, "region", BLOCK), "regions")
    if not n:
        return inside.select(F.col("doc_id").alias("a"), F.col("comp").alias("b"))
    carried = inside.join(reps.select("doc_id", "n_shingles", *_SIGNATURE), "doc_id").join(texts, "doc_id")
    carried = stored(carried, "region-texts")
    columns = ["region", "x", "y", "doc_id", "comp", "n_shingles", *_SIGNATURE, "text"]
    apart, every = (side.select(*columns) for side in _dealt(carried, F.xxhash64("doc_id")))
    chance, least = 2.0**-BITS, percent / 100 - MARGIN

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            a, b = (np.ascontiguousarray(d[_SIGNATURE].to_numpy(np.int64)).view(np.uint64) for d in (left, right))
            differ = np.zeros((len(left), len(right)), np.int64)
            for k in range(len(_SIGNATURE)):
                x = a[:, None, k] ^ b[None, :, k]
                differ += np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
            near = ((PERMUTATIONS - differ) / PERMUTATIONS - chance) / (1 - chance)
            na, nb = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
            near[np.minimum(na[:, None], nb) * 100 < np.maximum(na[:, None], nb) * percent] = -1
            comps, other = left["comp"].to_numpy(), right["comp"].to_numpy()
            near[comps[:, None] == other[None, :]] = -1
            grams = [shingle_set(t, width) if (near[:, j] >= least).any() else None for j, t in enumerate(right["text"])]
            for i in np.flatnonzero((near >= least).any(1)):
                mine, linked = shingle_set(left["text"].iloc[i], width), set()
                for j in np.argsort(-near[i], kind="stable"):
                    if near[i, j] < least:
                        break
                    if other[j] not in linked and similar(mine, grams[j], percent):
                        linked.add(other[j])
                        found.append((left["doc_id"].iloc[i], right["doc_id"].iloc[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    key = ["region", "x", "y"]
    return apart.groupBy(*key).cogroup(every.groupBy(*key)).applyInPandas(meet, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, width: int = 4, percent: int = 80, leader_rounds: int = LEADER_ROUNDS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, a set holds the distinct
    shingles of ``width`` words (with fewer words the whole sequence), texts are linked
    from ``percent`` on. ``component_id`` is the smallest doc_id reachable. Null texts and texts
    without words are linked with nothing. Ties and repeated rows of one id: each row is
    given, with the component of its own text; equal texts are one. A null id is its own
    row, with a null component, and links nothing. Extra columns are dropped.
    """
    signed = stored(signatures(docs, width, id_column, text_column), "signatures")
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is a word sequence with a number of its own: an id may stand on several texts. A task keeps one copy of
    # each before the exchange; the smallest id and its text speak for the class.
    first = F.min(F.struct("doc_id", "key")).alias("first")
    classes = stored(linkable.groupBy("digest").agg(first).withColumn("rep", F.monotonically_increasing_id()), "classes")
    reps = linkable.drop("doc_id", "key").dropDuplicates(["digest"]).join(classes.select("digest", F.col("rep").alias("doc_id")), "digest")
    keyed = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    signature = F.struct("doc_id", "n_shingles", *_SIGNATURE)
    full = keyed.join(shared, "bucket").join(reps.select("doc_id", signature.alias("m")), "doc_id")
    buckets = stored(full.select("bucket", "m", F.col("doc_id").alias("comp")), "buckets")
    ids = buckets.select("m.doc_id").distinct()
    speaking = stored(classes.join(ids.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "first.doc_id", "first.key"), "speaking")
    plain = semi_join(keyed_texts(docs, id_column, text_column), speaking, "doc_id").dropDuplicates(["doc_id", "key"])
    texts = stored(plain.join(speaking, ["doc_id", "key"]).select(F.col("rep").alias("doc_id"), "text"), "bucket-texts")
    least = percent / 100 - MARGIN
    smaller, larger = F.least("m.n_shingles", "o.n_shingles"), F.greatest("m.n_shingles", "o.n_shingles")
    possible = (F.col("comp") != F.col("o_comp")) & (smaller * 100 >= larger * percent) & (estimate("m", "o") >= least)
    # Components that links make, and that estimates make; the labels of a step stand for its links in the next.
    none = buckets.select(F.col("comp").alias("node"), F.col("comp").alias("component")).filter(F.lit(False))
    labels, close, n_close, left = (none, 0), none.toDF("a", "b"), 0, 1
    for turn in range(leader_rounds):
        # A member drawn by lot leads; a hot bucket is one row per task before the exchange.
        lot = F.xxhash64("m.doc_id", "bucket", F.lit(turn))
        leaders = buckets.groupBy("bucket").agg(F.min(F.struct(lot.alias("lot"), F.col("m").alias("o"), F.col("comp").alias("o_comp"))).alias("leader"))
        met = buckets.join(leaders.select("bucket", "leader.o", "leader.o_comp"), "bucket").filter(possible)
        met, n = counted(met.select(F.col("m.doc_id").alias("a"), F.col("o.doc_id").alias("b"), estimate("m", "o").alias("e")).distinct(), "met")
        close, n_close = close.unionByName(met.select("a", "b")), n_close + n
        pairs = met.groupBy("a").agg(F.max(F.struct("e", "b")).alias("best")).select("a", "best.b")
        labels = _joined(labels, *counted(similar_pairs(pairs, texts, width, percent), "links"))
        # Buckets within one component are done, and so is a leader: all others have met it.
        named = stored(_named(buckets, labels[0], "component"), "named")
        mixed = named.groupBy("bucket").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(lot.alias("lot"), F.col("m.doc_id").alias("doc_id"))).alias("led")
        ).filter("lo <> hi").select("bucket", "led")
        buckets, left = counted(named.join(mixed, "bucket").filter("m.doc_id <> led.doc_id").drop("led"), "buckets")
        if not left:
            break
    regions = counted_components(close, n_close)
    if left:
        regions = _joined(regions, *counted(bucket_links(_named(buckets, regions[0], "component"), possible), "met"))
    regions = regions[0].select("node", F.col("component").alias("region"))
    labels, _ = _joined(labels, *counted(region_links(regions, labels[0], reps, texts, width, percent), "links"))
    own = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.col("first.doc_id").alias("least"), F.coalesce("component", "rep").alias("component"))
    smallest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = own.join(smallest, "component").select("digest", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.select("doc_id", "digest", "n_shingles").join(placed, "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )
