"""Phrases whose words stand together far more often than chance: counting by broadcast tries.

Candidates come level by level. Every n-gram that can still be frequent (both n-grams it is made of fell into a frequent
bucket) adds to the bucket of its 64-bit hash; buckets below the least count hold no frequent phrase. The
frequent buckets of a level become a bit table of bounded size, which lets a few rare n-grams pass and loses none.

The candidates, words and phrases alike, are cut into shards, and each becomes a double-array trie over the bytes of
``lang``, line feed and words with a blank after each. A group of shards of bounded size is broadcast. In a chunk of text, numpy moves the states of
all word starts on by one byte at a time; states reached with a blank are counted by one bincount a chunk, and the counts of
all tasks are summed. Counts are of the strings themselves, so hashes decide nothing but what is looked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, lengths, mix, new_path, stored, text_bytes

#: Phrases of a trie shard, phrases of the shards that are broadcast together, phrases of a block of counts.
SHARD, TOGETHER, BLOCK = 1 << 17, 1 << 20, 1 << 14
#: Bits of a bit table at most, and bits for each frequent bucket below that.
TABLE_BITS, BITS_EACH = 27, 64
#: N-grams that a task holds before it hands them on.
HELD = 1 << 21
#: Bits of a bucket within its part; the parts follow the session's partitions.
BUCKET_BITS = 24
#: Phrases that a task gathers before it hands them on.
GATHERED = 1 << 18
#: Longer words go through the trie as a digest of 128 bits.
LONG_WORD = 64
#: Parts of a language whose first phrases are taken before all of them meet in one task.
PARTS = 8
_STOP = b"."
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _STOP * 9)
_PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_SEGMENT = 4 << 20
#: Normalised text bytes of a row of coded texts, or one segment more.
CODED_BYTES = 2 << 20
_CODED = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary())])


def _spelt(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begins and sizes of words with a blank after each."""
    text = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(text == 0x20)
    begins = np.concatenate([[0], ends[:-1] + 1])
    return text, begins, ends - begins


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of words with a blank after each, eight bytes of all words at a time; 0 for the first, which is the stop, and no other."""
    text, begins, sizes = _spelt(data)
    hashes = mix(sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > LONG_WORD)
    who = np.flatnonzero(sizes <= LONG_WORD)
    begins, sizes = begins[who], sizes[who]
    while len(who):
        eight = np.ascontiguousarray(text[np.minimum(begins[:, None] + np.arange(8), len(text) - 1)]).view("<u8")[:, 0]
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.minimum(sizes, 8)).astype(np.uint64)
        hashes[who] = mix(hashes[who] + eight)
        more = sizes > 8
        who, begins, sizes = who[more], begins[more] + 8, sizes[more] - 8
    if len(long):
        words = data.split(b" ")
        hashes[long] = [xxhash.xxh3_64_intdigest(words[k]) for k in long.tolist()]
    hashes[hashes == 0] = 1
    hashes[0] = 0
    return hashes


def _segments(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end with a piece; phrases never cross these ends."""
    start = 0
    while len(data) - start > _SEGMENT and (end := _PIECE_END.search(data, start + _SEGMENT)):
        yield data[start : end.end()]
        start = end.end()
    yield data[start:]


def _width(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<i4"


def _rows_of(lang: str, parts: list[bytes]) -> pa.RecordBatch:
    """A row ``lang, words, codes`` of normalised parts of texts, each ended by a stop: distinct words and the number of the word at each place.

    Word 0 is the stop. Each of ``words`` has a blank after it; ``codes`` holds integers of the width that the number of words asks for.
    """
    parts = [_STOP + b" ", *parts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])
    coded = pc.ascii_split_whitespace(flat).flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # before a blank at the beginning, after one at the end
        empty = words.index(b"")
        codes = codes[codes != empty]
        codes = codes - (codes > empty)
        del words[empty]
    return pa.RecordBatch.from_pydict({"lang": [lang], "words": [b" ".join([*words, b""])], "codes": [codes.astype(_width(len(words))).tobytes()]}, schema=_CODED)


def coded_texts(rows: DataFrame) -> DataFrame:
    """Stored ``lang, words, codes`` of all ``lang, text``: words ``[^\\x20\\x09]+`` with A-Z lower-cased, a stop for each of ``[.,;:!?\\x0A-\\x0D]`` and text end.

    The texts are split here once; all later passes read the numbers of the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            numbers = langs.indices.to_numpy()
            order = np.split(np.argsort(numbers, kind="stable"), np.cumsum(np.bincount(numbers, minlength=1))[:-1])
            for lang, places in zip(langs.dictionary.to_pylist(), order, strict=False):  # an empty batch has no language
                held, size = [], 0
                own = batch.column(1).take(pa.array(places))
                for i, j in chunks(lengths(own)):
                    for data in text_bytes(own[i:j]):
                        for part in _segments(data):
                            held.append(part.translate(_NORMAL).replace(_STOP, b" . ") + b" . ")
                            size += len(held[-1])
                            if size >= CODED_BYTES:
                                yield _rows_of(lang, held)
                                held, size = [], 0
                if held:
                    yield _rows_of(lang, held)

    path, kinds = new_path(rows.sparkSession, "coded"), "lang string, words binary, codes binary"
    rows.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(path)  # numbers of words: entropy coding takes what Snappy leaves
    return rows.sparkSession.read.schema(kinds).parquet(path)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            lang, words, codes = (c[k] for c in batch.columns)
            words = words.as_py()
            yield lang.as_py(), words, np.frombuffer(codes.as_buffer(), _width(words.count(b" "))).astype(np.int32)


def _places(keys: np.ndarray, part_bits: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key's bucket in a table, both in the segment of its part."""
    own, hashed = keys >> np.uint64(64 - part_bits) << np.uint64(segment_bits), mix(keys >> np.uint64(64 - BUCKET_BITS - part_bits))
    return own | hashed >> np.uint64(64 - segment_bits), own | hashed & np.uint64((1 << segment_bits) - 1)


def _passes(table: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set in a bit table."""
    part_bits, held = table
    found = np.ones(len(keys), bool)
    for at in _places(keys, part_bits, 3 + int(log2(len(held))) - part_bits):
        found &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _shared(rows: DataFrame, tables: list[tuple[int, bytes]]) -> list:
    return [rows.sparkSession.sparkContext.broadcast(t) for t in tables]


def _here(shared: list) -> list[tuple[int, np.ndarray]]:
    return [(b.value[0], np.frombuffer(b.value[1], np.uint8)) for b in shared]


def _grams(lang: str, words: bytes, codes: np.ndarray, tables: list, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ... ``levels``: the key of the n-gram at each place, and whether it can be frequent by the tables of its level and those below."""
    own = word_hashes(words)
    keys, able = mix(own + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))), own != 0
    if tables:  # once for each distinct word
        able[able] = _passes(tables[0], keys[able])
    own, keys, able = own[codes], keys[codes], able[codes]
    yield keys, able
    for n in range(1, levels):
        able = able[:-1] & able[1:]
        places, longer = np.flatnonzero(able), np.zeros(len(able), np.uint64)
        longer[places] = mix(keys[places] + own[places + n])
        keys = longer
        if n < len(tables):
            able[able] = _passes(tables[n], keys[able])
        yield keys, able


def _planes(numbers: np.ndarray) -> bytes:
    """Sorted numbers below ``2 ** 24``: all their first bytes, then all second ones, then all third ones, which compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(3, -1).T
    return out.view("<u4")[:, 0]


def frequent_buckets(coded: DataFrame, tables: list, min_count: int, part_bits: int) -> DataFrame:
    """``part, buckets, n``: the ``n`` buckets of n-grams of the next level that have ``min_count`` occurrences or more.

    A bucket is the first ``part_bits + BUCKET_BITS`` bits of a key: its part, and a number that ``buckets`` holds sorted as 32-bit integers.
    """
    shared = _shared(coded, tables)
    least = np.min_scalar_type(min_count).newbyteorder("<")  # a task counts no further than min_count, which is enough for the sum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _here(shared)
        held, size = [], 0

        def handed_on() -> pa.RecordBatch:
            """The held n-grams, each once, with their counts: a row for each part."""
            buckets = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            buckets.sort()
            first = np.flatnonzero(np.concatenate([buckets[:1] == buckets[:1], buckets[1:] != buckets[:-1]]))
            counts = np.minimum(np.diff(np.append(first, len(buckets))), min_count).astype(least)
            buckets = buckets[first]
            ends = np.searchsorted(buckets, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(BUCKET_BITS))
            rows = [(k, _planes(x), n.tobytes()) for k, (x, n) in enumerate(zip(np.split(buckets, ends), np.split(counts, ends), strict=True)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "buckets", "counts"])

        for lang, words, codes in _coded(batches):
            *_, (keys, able) = _grams(lang, words, codes, bits, len(bits) + 1)
            held.append(keys[able] >> np.uint64(64 - BUCKET_BITS - part_bits))
            size += len(held[-1])
            if size > HELD:
                yield handed_on()
                size = 0
        yield handed_on()

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        buckets, counts = np.concatenate([_of_planes(x) for x in group["buckets"]]), np.frombuffer(b"".join(group["counts"]), least)
        order = np.argsort(buckets)
        buckets = buckets[order]
        first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        often = buckets[first][np.add.reduceat(counts[order], first, dtype=np.int64) >= min_count]
        return pd.DataFrame({"part": [group["part"].iloc[0]], "buckets": [often.tobytes()], "n": [len(often)]})

    found = coded.mapInArrow(run, "part int, buckets binary, counts binary")
    return stored(found.groupBy("part").applyInPandas(summed, "part int, buckets binary, n bigint"), "buckets")


def bit_table(buckets: DataFrame, part_bits: int) -> tuple[int, bytes]:
    """Two bits for each bucket, in a table of a power of two that never exceeds ``2 ** TABLE_BITS`` bits; each part has a segment of it."""
    found = buckets.agg(F.sum("n")).first()[0] or 0
    bits = max(min(TABLE_BITS, max(16, ceil(log2(BITS_EACH * (found + 1))))), part_bits + 3)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = (np.uint64(part) << np.uint64(BUCKET_BITS) | np.frombuffer(own, "<u4").astype(np.uint64)) << np.uint64(64 - BUCKET_BITS - part_bits)
                held = np.zeros(1 << (bits - part_bits), np.uint8)
                for at in _places(keys, part_bits, bits - part_bits):
                    held[at & np.uint64(len(held) - 1)] = 1
                out.append(np.packbits(held, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["part", "bits"])

    table = bytearray(1 << (bits - 3))
    for r in buckets.select("part", "buckets").mapInArrow(pack, "part int, bits binary").toLocalIterator():
        table[r.part * len(r.bits) : (r.part + 1) * len(r.bits)] = r.bits
    return part_bits, bytes(table)


def candidates(coded: DataFrame, tables: list) -> DataFrame:
    """Distinct ``lang, phrase`` of all words and phrases that the tables of their level let pass.

    A task hands its phrases on in lists, one for each part of the keys; no phrase holds a line feed.
    """
    shared, part_bits = _shared(coded, tables), tables[0][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _here(shared)
        seen = [np.zeros(0, np.uint64) for _ in bits]
        gathered, size, of = [], 0, ""

        def handed_on() -> pa.RecordBatch:
            parts = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in gathered)]) >> np.uint64(64 - part_bits)
            order = np.argsort(parts, kind="stable")
            ends = np.searchsorted(parts[order], np.arange((1 << part_bits) + 1, dtype=np.uint64))
            phrases = pa.concat_arrays([pa.array([], pa.large_binary()), *(x for _, x in gathered)]).take(pa.array(order))
            lists = pc.binary_join(pa.LargeListArray.from_arrays(ends, phrases), pa.scalar(b"\n", pa.large_binary())).cast(pa.binary())
            there = pa.array(np.flatnonzero(np.diff(ends)).astype(np.int32))
            return pa.RecordBatch.from_arrays([there, pa.array([of] * len(there), pa.string()), lists.take(there)], ["part", "lang", "phrases"])

        for lang, words, codes in _coded(batches):
            if gathered and (size > GATHERED or lang != of):
                yield handed_on()
                gathered, size = [], 0
            of = lang
            held = pa.array(words.split(b" ")[:-1], pa.large_binary())
            for n, (keys, able) in enumerate(_grams(lang, words, codes, bits, len(bits))):
                places = np.flatnonzero(able)
                # Sorted by the first bits of the key; if two keys share them, a phrase may be named again.
                low = np.uint64((1 << len(codes).bit_length()) - 1)
                places = (np.sort(keys[places] & ~low | places.astype(np.uint64)) & low).astype(np.int64)
                own = keys[places]
                new = np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]])
                places, own = places[new], own[new]
                at = np.searchsorted(seen[n], own)
                new = np.ones(len(own), bool)
                new[at < len(seen[n])] = seen[n][at[at < len(seen[n])]] != own[at < len(seen[n])]
                places, own = places[new], own[new]
                # Once full it starts anew, and a phrase may be named again.
                seen[n] = np.sort(np.concatenate([seen[n], own])) if len(seen[n]) < HELD else np.sort(own)
                phrases = [held.take(pa.array(codes[places + k])) for k in range(n + 1)]
                phrases = pc.binary_join_element_wise(*phrases, pa.scalar(b" ", pa.large_binary())) if n else phrases[0]
                gathered.append((own, phrases))
                size += len(own)
        yield handed_on()

    def distinct(group: pd.DataFrame) -> pd.DataFrame:
        every = pc.split_pattern(pa.array([b"\n".join(group["phrases"])], pa.large_binary()), b"\n").flatten().unique()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "phrase": every.to_pylist()})

    found = coded.mapInArrow(run, "part int, lang string, phrases binary")
    return stored(found.groupBy("part", "lang").applyInPandas(distinct, "lang string, phrase binary"), "candidates")


def trie_word(word: bytes) -> bytes:
    """A word as it goes through the trie; the digest of a long one starts with a stop, which no word holds."""
    return word if len(word) <= LONG_WORD else _STOP + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, ends`` of a trie of sorted distinct keys; ``ends`` has the state of each key.

    From state ``s``, byte ``c`` leads to ``base[s] + c`` if ``check`` there is ``s``. The root is 256; places below it stay empty.
    """
    n, width = len(keys), max(map(len, keys))
    sizes = np.array([len(k) for k in keys], np.int64)
    grid = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(n, width)
    differ = np.ones((n, width + 1), bool)
    differ[1:, :width] = grid[1:] != grid[:-1]
    shared = np.minimum(differ.argmax(1), np.minimum(sizes, np.concatenate([[0], sizes[:-1]])))
    shared[0] = 0
    # A key has nodes of its own below what it shares with the key before. Node 0 is the root.
    own = sizes - shared
    first = 1 + np.cumsum(own) - own
    parent, label = np.zeros(1 + own.sum(), np.int64), np.zeros(1 + own.sum(), np.int64)
    holder, last = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of each key, its node at the depth before
    rows = np.arange(n)
    for depth in range(width):
        starts = (shared <= depth) & (sizes > depth)
        # The node at this depth is that of the last key which has one of its own here.
        owner = np.maximum.accumulate(np.where(starts, rows, 0))
        node = first[owner] + depth - shared[owner]
        parent[node[starts]], label[node[starts]] = holder[starts], grid[starts, depth]
        inside = sizes > depth
        holder = np.where(inside, node, holder)
        last[inside] = node[inside]
    fan = np.bincount(parent[1:], minlength=len(parent))
    order = 1 + np.argsort(parent[1:], kind="stable")
    begins = np.cumsum(fan) - fan
    base, rng = np.zeros(len(parent), np.int64), np.random.default_rng(5)
    free = np.ones(int(1.25 * len(parent)) + 1024, bool)
    free[:257] = False
    # Nodes of many children first: all of a class draw a place at once, those that collide draw again.
    for least in (128, 64, 32, 16, 8, 6, 4, 3, 2):
        left = np.flatnonzero((fan >= least) & (base == 0))
        turn = 0
        while len(left):
            turn += 1
            if turn % 64 == 0:
                free = np.concatenate([free, np.ones(len(free) // 4, bool)])
            draw = rng.integers(256, len(free) - 256, len(left))
            who = np.repeat(np.arange(len(left)), fan[left])
            child = order[np.repeat(begins[left], fan[left]) + np.arange(len(who)) - np.repeat(np.cumsum(fan[left]) - fan[left], fan[left])]
            slot = draw[who] + label[child]
            mine = np.full(len(free), len(left), np.int32)
            np.minimum.at(mine, slot, who.astype(np.int32))
            bad = np.zeros(len(left), bool)
            bad[who[~free[slot] | (mine[slot] != who)]] = True
            base[left[~bad]] = draw[~bad]
            free[slot[~bad[who]]] = False
            left = left[bad]
    single = np.flatnonzero(fan == 1)
    spare = np.flatnonzero(free[512:]) + 512
    if len(spare) < len(single):
        spare = np.concatenate([spare, len(free) + np.arange(len(single) - len(spare))])
    base[single] = spare[: len(single)] - label[order[begins[single]]]
    slot = np.full(len(parent), 256, np.int64)
    slot[1:] = base[parent[1:]] + label[1:]
    size = int(slot.max()) + 513
    bases, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    bases[slot] = base
    check[slot[1:]] = slot[parent[1:]]
    return bases, check, slot[last].astype(np.int32)


TRIES = "shard string, phrases bigint, langs array<string>, base binary, check binary, ends binary, block int, lang array<string>, phrase array<binary>"


def tries(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """Stored tries of ``lang, phrase``: for each shard a row with its arrays, and rows ``block, lang, phrase`` with its phrases in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        schema = pa.schema([
            ("shard", pa.string()), ("phrases", pa.int64()), ("langs", pa.list_(pa.string())), ("base", pa.binary()), ("check", pa.binary()),
            ("ends", pa.binary()), ("block", pa.int32()), ("lang", pa.list_(pa.string())), ("phrase", pa.list_(pa.binary())),
        ])

        def built(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            keyed = sorted({(lang.encode() + b"\n" + b"".join(trie_word(w) + b" " for w in phrase.split(b" ")), lang, phrase) for lang, phrase in rows})
            base, check, ends = double_array([k for k, *_ in keyed])
            name, out, of = uuid4().hex, [], lambda a: a.astype("<i4").tobytes()
            out.append({"shard": name, "phrases": len(keyed), "langs": sorted({lang for lang, _ in rows}), "base": of(base), "check": of(check), "ends": of(ends)})
            for k in range(0, len(keyed), BLOCK):
                part = keyed[k : k + BLOCK]
                out.append({"shard": name, "block": k // BLOCK, "lang": [lang for _, lang, _ in part], "phrase": [p for *_, p in part]})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        held: list[tuple[str, bytes]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= shard:
                yield built(held[:shard])
                held = held[shard:]
        if held:
            yield built(held)

    parts = max(1, ceil(found.count() / shard))
    return stored(found.repartitionByRange(parts, "lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(run, TRIES), "tries")


def states_after(base: np.ndarray, check: np.ndarray, text: np.ndarray, places: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The state behind the blank that follows each of ``places`` of ``text``, from ``states``; 0 if there is none: all move on by one byte at a time."""
    reached, who = np.zeros(len(places), np.int32), np.arange(len(places))
    while len(places):
        byte = text[places]
        step = base[states] + byte
        able = check[step] == states
        done = able & (byte == 0x20)
        reached[who[done]] = step[done]
        able &= ~done
        states, places, who = step[able], places[able] + 1, who[able]
    return reached


def _start(base: np.ndarray, check: np.ndarray, lang: str) -> int:
    state = 256
    for c in lang.encode() + b"\n":
        step = int(base[state]) + c
        if check[step] != state:
            return 0
        state = step
    return state


def trie_counts(coded: DataFrame, tables: list, shards: list, totals: bool) -> DataFrame:
    """``shard, block, lang, counts, n``: summable counts of each block of phrases, and with ``totals`` the words ``n`` of each language.

    Only places that the tables let pass go through a trie beyond their first word; first words go through it once for each row of texts.
    """
    tries_shared = coded.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.base), bytes(r.check), bytes(r.ends), r.langs) for r in shards])
    shared = _shared(coded, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _here(shared)
        tries_here = [(name, *(np.frombuffer(x, "<i4") for x in arrays), set(langs)) for name, *arrays, langs in tries_shared.value]
        sums = [np.zeros(len(base), np.int64) for _, base, *_ in tries_here]
        total: dict[str, int] = {}
        for lang, words, codes in _coded(batches):
            grams = [np.flatnonzero(able) for _, able in _grams(lang, words, codes, bits, len(bits))][1:]
            if max(map(len, words.split(b" "))) > LONG_WORD:
                words = b"".join(trie_word(w) + b" " for w in words.split(b" ")[:-1])
            text, begins, _ = _spelt(words)
            times = np.bincount(codes, minlength=len(begins))
            total[lang] = total.get(lang, 0) + int(times[1:].sum())
            for k, (_, base, check, _, own) in enumerate(tries_here):
                start = _start(base, check, lang) if lang in own else 0
                if not start:
                    continue
                firsts = np.zeros(len(begins), np.int32)
                firsts[1:] = states_after(base, check, text, begins[1:], np.full(len(begins) - 1, start, np.int32))
                sums[k][firsts[firsts > 0]] += times[firsts > 0]  # each word has a state of its own
                states = firsts[codes]
                reached = []
                for n, places in enumerate(grams, 1):
                    places = places[states[places] > 0]
                    after = np.zeros(len(codes), np.int32)
                    after[places] = states_after(base, check, text, begins[codes[places + n]], states[places])
                    reached.append(after[places])
                    states = after
                if any(map(len, reached)):
                    sums[k] += np.bincount(np.concatenate(reached), minlength=len(base))
        out = []
        for (name, _, _, ends, _), found in zip(tries_here, sums, strict=True):
            counted = found[ends]
            out += [{"shard": name, "block": k // BLOCK, "counts": part.astype("<i8").tobytes()} for k in range(0, len(counted), BLOCK) if (part := counted[k : k + BLOCK]).any()]
        out += [{"lang": x, "n": n} for x, n in total.items()] if totals else []
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("shard", pa.string()), ("block", pa.int32()), ("lang", pa.string()), ("counts", pa.binary()), ("n", pa.int64())]))

    return stored(coded.mapInArrow(run, "shard string, block int, lang string, counts binary, n bigint"), "counts")


def _summed(built: DataFrame, counted: DataFrame, min_count: int) -> DataFrame:
    """``lang, phrase, words, a`` of the phrases that are frequent, from blocks of phrases and of counts."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            for x in part["counts"]:
                own = np.frombuffer(x, "<i8")
                total = own.copy() if total is None else total + own
            shard, block = part["shard"].iloc[0], part["block"].iloc[0]
        yield pd.DataFrame({"shard": [shard], "block": [block], "counts": [total.tobytes()]})

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, phrases, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(x, p.decode("utf-8", "replace"), p.count(b" ") + 1, a) for x, p, a in zip(langs, phrases, np.frombuffer(counts, "<i8").tolist(), strict=True) if a >= min_count]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["lang", "phrase", "words", "a"])

    sums = counted.filter("shard IS NOT NULL").select("shard", "block", "counts").groupBy("shard", "block").applyInPandas(add, "shard string, block int, counts binary")
    joined = built.filter("block IS NOT NULL").select("shard", "block", "lang", "phrase").join(sums, ["shard", "block"])
    return stored(joined.select("lang", "phrase", "counts").mapInArrow(named, "lang string, phrase string, words int, a bigint"), "frequent")


def frequent_phrases(rows: DataFrame, max_words: int, min_count: int, shard: int = SHARD, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, a`` of every phrase of up to ``max_words`` with ``min_count`` occurrences, single words too; ``lang, n`` of all words."""
    coded, tables = coded_texts(rows), []
    # The parts of the buckets follow the session's partitions.
    part_bits = min(12, max(8, 1 + ceil(log2(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    for _ in range(max_words):
        tables.append(bit_table(frequent_buckets(coded, tables, min_count, part_bits), part_bits))
    built = tries(candidates(coded, tables), shard)
    sizes = built.filter("block IS NULL").select("shard", "phrases").collect()  # one short row for each shard
    groups, size = [[]], 0
    for r in sorted(sizes):
        if groups[-1] and size + r.phrases > together:
            groups.append([])
            size = 0
        groups[-1].append(r.shard)
        size += r.phrases
    counted = None
    for k, group in enumerate(groups):
        arrays = built.filter("block IS NULL").filter(F.col("shard").isin(group)).collect()
        part = trie_counts(coded, tables, arrays, totals=k == 0)
        counted = part if counted is None else counted.unionByName(part)
    totals = counted.filter("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return _summed(built, counted, min_count), totals


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, contained_percent: int = 50, top: int = 2000,
    text_column: str = "text", lang_column: str = "lang", shard: int = SHARD, together: int = TOGETHER,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``max_words`` words.

    ``a`` counts a phrase's occurrences inside pieces, ``l`` and ``r`` those of its parts at the cut with the lowest
    score ``floor(1000000 a a / (l r))``, ``n`` all words. A phrase goes if some longer candidate that contains it has
    ``contained_percent`` of its count. Ranks go by score, count (both falling) and phrase; ties end there, phrases are distinct.
    A null language is ``und``; null and empty texts have no words, every row counts, repeated ones too; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("binary").alias("text"))
    found, totals = frequent_phrases(rows, max_words, min_count, shard, together)
    longer = found.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", "a", "words", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    for side, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    score = F.expr("CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(14, 0)) * CAST(a AS DECIMAL(14, 0)) div (CAST(l AS DECIMAL(14, 0)) * CAST(r AS DECIMAL(14, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = longer.filter("words > 2").select(
        "lang", F.col("a").alias("most"),
        F.explode(F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), b -> array_join(slice(w, b, s), ' '))))")).alias("phrase"),
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * contained_percent))
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    # A phrase among the first of its language is among the first of its part: one task sorts PARTS * top rows at most.
    parted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(parted)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
