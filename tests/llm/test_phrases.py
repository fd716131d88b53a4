"""Collocations against a count over all n-grams in plain Python, and the double-array trie against a set of strings."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetscope.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string"


def expected(docs, max_words=3, min_count=10, contained=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang or "und"] += len(words)
            for n in range(1, max_words + 1):
                counts.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {k: a for k, a in counts.items() if a >= min_count}
    out = []
    for lang in totals:
        found = []
        for (own, p), a in frequent.items():
            if own != lang or len(p) < 2:
                continue
            score, _, left, right = min((1_000_000 * a * a // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k, frequent[lang, p[:k]], frequent[lang, p[k:]]) for k in range(1, len(p)))
            inside = any(x == lang and len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in frequent.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def sample():
    rng = random.Random(12)
    words = ["new", "york", "New", "city", "é", "日本", "x" * 70, "x" * 69 + "y", "\x01", "\xa0", "don't", "a-b", "s" * 64, "s" * 65]
    texts = [None, "", " \t ", ".,;", "new york, new york"] * 2
    for _ in range(150):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(rng.randrange(1, 40))))
    texts += ["big apple pie is one thing"] * 12 + ["the big apple"] * 3
    return [(i, t, rng.choice(["en", "en", "de", None, "a\nb"])) for i, t in enumerate(texts)] + [(1, "big apple pie is one thing", "en")] * 9


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("max_words, min_count, top, shard, together", [(3, 10, 2000, 1 << 17, 1 << 19), (4, 3, 7, 9, 20), (2, 1, 50, 50, 1000)])
def test_collocations(frame, monkeypatch, max_words, min_count, top, shard, together):
    monkeypatch.setattr(phrases, "BLOCK", 4)
    docs = sample()
    got = phrases.collocations(frame(docs, SCHEMA), max_words, min_count, top=top, shard=shard, together=together)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == expected(docs, max_words, min_count, top=top)


def test_collocations_of_nothing(frame):
    assert phrases.collocations(frame([], SCHEMA)).count() == 0
    assert phrases.collocations(frame([(1, None, None), (2, "one two", "en")], SCHEMA)).count() == 0


def test_a_small_bit_table_loses_nothing(frame, monkeypatch):
    monkeypatch.setattr(phrases, "TABLE_BITS", 16)
    monkeypatch.setattr(phrases, "HELD", 5)
    monkeypatch.setattr(phrases, "_SEGMENT", 20)
    docs = sample()
    got = phrases.collocations(frame(docs, SCHEMA))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == expected(docs)


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    rows = [(a, a + rng.randrange(10**12), a + rng.randrange(10**12)) for a in (rng.randrange(1, 10**13) for _ in range(500))] + [(10**13, 10**13, 10**13)]
    sql = "CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(14, 0)) * CAST(a AS DECIMAL(14, 0)) div (CAST(l AS DECIMAL(14, 0)) * CAST(r AS DECIMAL(14, 0)))"
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").selectExpr("a", "l", "r", f"{sql} AS score").collect()
    assert all(r.score == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_double_array():
    rng = random.Random(2)
    for most in (1, 5, 300, 4000):
        keys = sorted({bytes(rng.choices(range(1, 256), k=rng.randint(1, 9))) for _ in range(most)} | {b"a", b"ab ", b"ab  c"})
        base, check, ends = phrases.double_array(keys)

        def walk(key, base=base, check=check):
            state = 256
            for c in key:
                if check[base[state] + c] != state:
                    return None
                state = base[state] + c
            return state

        assert [walk(k) for k in keys] == ends.tolist() and len(set(ends.tolist())) == len(keys)
        prefixes = {k[:i] for k in keys for i in range(len(k) + 1)}
        for _ in range(2000):
            k = bytes(rng.choices(range(256), k=rng.randint(1, 4)))
            assert (walk(k) is not None) == (k in prefixes)
    assert len(np.unique(ends)) == len(keys)


def test_texts_are_read_once_however_many_passes_count(frame, spark):
    from pyspark.sql import functions as F

    read, docs = spark.sparkContext.accumulator(0), sample()
    seen = F.udf(lambda text: (read.add(1), text)[1])
    got = phrases.collocations(frame(docs, SCHEMA).withColumn("text", seen("text")), shard=200, together=400)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == expected(docs)
    assert read.value == len(docs)


def test_coded_texts_hold_the_words_of_the_texts(frame, monkeypatch):
    monkeypatch.setattr(phrases, "CODED_BYTES", 40)
    texts = [None, "", "  a\tB. ", "\x00 \x1c\x85   a", "x" * 300 + " é,\r\nÉ", "...", "ab " * 50]
    rows = frame([(None if t is None else t.encode(), "en" if k % 2 else "") for k, t in enumerate(texts)], "text binary, lang string", extra=False).select("lang", "text")
    got = Counter()
    for r in phrases.coded_texts(rows).collect():
        words = bytes(r.words).split(b" ")[:-1]
        codes = np.frombuffer(r.codes, "<u2")
        assert words[0] == b"." and len(set(words)) == len(words) and codes[0] == 0 == codes[-1]
        got.update((r.lang, words[c].decode()) for c in codes if c)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert got == Counter(("en" if k % 2 else "", w) for k, t in enumerate(lower) for w in re.split("[\x20\x09.,;:!?\x0a-\x0d]+", t) if w)


def test_hashes_of_words():
    rng = random.Random(8)
    words = sorted({bytes(rng.choices(range(33, 36), k=rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)} - {b"."})
    hashes = phrases.word_hashes(b" ".join([b".", *words, b""]))
    assert hashes[0] == 0 and len(set(hashes.tolist())) == len(words) + 1
    back = phrases.word_hashes(b" ".join([b".", *words[::-1], b""]))
    assert (back[1:][::-1] == hashes[1:]).all()
