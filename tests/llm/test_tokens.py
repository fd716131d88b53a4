"""Tokens: BPE, counts through the cache, and binary records, against the libraries on whole texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetscope.llm import bpe, pieces, records, token_counts
from fleetscope.llm.common import new_path, vocabulary

RANKS, JSON = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
PARTS = [
    " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\x0b", "\x1c", "\x85", "​", "a", "don't", "'s", "'S", "é", "²", "½", "7", "123",
    ",", ".", "!!", "<|endoftext|>", "日本", "😀", "x̂", "_", "ab_c", "'", "Ünï", "×", "Ж",
]
TEXTS = [None, "", "same", "same", "A tie, a tie.", "<|endoftext|> inside", "é" * 5000, "word " * 40_000, " \n\n  end "]
SCHEMA = "doc_id bigint, text string"


def rows_of(texts):
    return list(enumerate(texts))


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


def test_pieces_change_no_match():
    rng = random.Random(3)
    tik, lib = bpe.tiktoken_encoding(RANKS), token_counts.LibraryEncoder(JSON)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert "".join(pieces.pieces(text)) == text and "".join(bpe.segments(text, 3)) == text
        assert packed(bpe.text_ids(tik, text, 3)) == packed(tik.encode_ordinary(text))
        assert lib.packed([text])[0] == packed(lib.whole([text])[0])


def test_piece_cache_stays_in_its_bound():
    seen = []

    def encode(missing):
        seen.extend(missing)
        return [p.encode() for p in missing]

    cache = pieces.PieceCache(encode, most=20_000)
    for k in range(50):
        assert cache.packed([f"a{k} b c{k} d" + "x" * 500, "b"]) == [f"a{k} b c{k} d".encode() + b"x" * 500, b"b"]
        assert len(cache.young) + len(cache.old) < 130 and all(len(p) <= 64 for p in cache.young)
    assert seen.count(" b") == 1


def test_words_are_looked_up_without_what_follows_them():
    """A word before a full stop or a line break is the piece it is before a blank, so the library meets it once."""
    seen = []

    def encode(missing):
        seen.extend(missing)
        return [p.encode("utf-32-le") for p in missing]

    texts = ["tie. A tie, a tie; tie&&&\ntie", "", "a tie:a\n\ntie's é.tie x\u0302.", "tie\u3000tie", "", " \n tie "]
    ids, ends = pieces.PieceCache(encode).of(pa.array(["cut off", *texts])[1:], {5: "given".encode("utf-32-le")})
    found = ["".join(map(chr, x)) for x in np.split(ids, ends[:-1])]
    assert found == [*texts[:5], "given"]
    assert sorted(seen) == sorted([
        "tie", ".", " A", " tie", ",", " a", ";", "&&&", "\ntie", "a", ":a", "\n\ntie", "'s", " é.tie", " x\u0302.", "tie\u3000tie", " ",
    ])


def test_texts_of_a_batch_keep_their_places():
    rng, lib = random.Random(12), token_counts.LibraryEncoder(JSON)
    texts = ["".join(rng.choices([*PARTS, "tie", "Tie", " a"], k=rng.choice([0, 1, 3, 30]))) for _ in range(3000)]
    for first in (0, 7):
        ids, ends = lib.of(pa.array(texts)[first:])
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == lib.whole(texts[first:])


def test_joined_pieces_are_told_apart():
    lib, rng = token_counts.LibraryEncoder(JSON), random.Random(8)
    missing = ["".join(rng.choices([" ", "\n", "é", "a", "日本", "'s", "7", "!", "\t"], k=rng.randint(1, 9))) for _ in range(4000)]
    assert lib.cache.encode(missing) == [packed(x) for x in lib.whole(missing)]


def test_encode_decode(frame):
    tik = bpe.tiktoken_encoding(RANKS)
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(frame(rows_of(TEXTS), SCHEMA)))).collect()}
    for i, text in enumerate(TEXTS):
        ids = tik.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_is_one_pass(frame):
    docs = frame(rows_of(TEXTS), SCHEMA)
    apart = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs))).collect()}
    assert {r.doc_id: r for r in bpe.round_trip(docs).collect()} == apart
    digested = bpe.round_trip(docs, keep_ids=False)
    assert digested.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    plan = digested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and bpe.round_trip(frame([], SCHEMA)).count() == 0


def test_encode_keeps_null_ids_and_repeats(frame):
    got = bpe.encode(frame([(None, "x"), (1, "y"), (1, "y")], SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert bpe.encode(frame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, frame, name):
    path = new_path(spark, "cache")
    whole = token_counts._whole(vocabulary(name))
    docs = frame(rows_of(TEXTS), SCHEMA)
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.token_counts(docs, path, name, limit=5).collect()}
        for i, text in enumerate(TEXTS):
            n = len(whole([text or ""])[0])
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 5)
    # One entry per distinct content; the second run added none.
    assert spark.read.parquet(path).count() == len({t or "" for t in TEXTS})


def test_counts_of_another_tokenizer_never_match(spark, frame):
    path, docs = new_path(spark, "cache"), frame([(1, "internationalisation")], SCHEMA)
    counts = [token_counts.token_counts(docs, path, n).first().n_tokens for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.json")]
    assert counts[0] == counts[2] and spark.read.parquet(path).count() == 2
    assert token_counts.token_counts(frame([], SCHEMA), path).count() == 0


def test_records_round_trip(spark, frame):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, "w%d " % i * rng.randint(0, 30)) for i in range(20, 120)] + [(7, "again"), (None, "no id")]
    whole = token_counts._whole(JSON)
    parts = records.write_records(frame(rng.sample(rows, len(rows)), SCHEMA), part_bytes=4000)
    assert parts.count() > 3
    got = records.record_digests(records.read_records(parts)).orderBy("start").collect()
    assert records.read_records(parts, checks=True).orderBy("start").collect() == got
    ids = [r.doc_id for r in got]
    assert len(got) == len(rows) and ids[0] is None and ids[1:] == sorted(ids[1:])
    start = 0
    expected = {}
    for i, text in rows:
        data = whole([text or ""])[0] + [2]
        expected.setdefault(i, set()).add((len(data), zlib.crc32(packed(data))))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in expected[r.doc_id]
        start += r.n_tokens
    part = parts.filter("records > 2").first()
    one, two = records.read_at(part.folder, part.part, [2, 0])
    assert two[0] == part.first_doc and len(one[1]) > 0


def test_records_empty(frame):
    parts = records.write_records(frame([], SCHEMA))
    assert parts.count() == 0 and records.record_digests(records.read_records(parts)).count() == 0


def test_damaged_records():
    import io

    data = records.frame(records.serialize(5, np.array([1, 70_000], "<u4")))
    doc_id, ids = records.deserialize(records.read_frame(io.BytesIO(data)))
    assert doc_id == 5 and ids.tolist() == [1, 70_000]
    for other in (None, -(1 << 63), 0):
        assert records.deserialize(records.serialize(other, np.zeros(0, "<u4")))[0] == other
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(data[:-2]))
    assert records.masked(0) == 0xA282EAD8 and struct.unpack("<Q", data[:8])[0] == 17
