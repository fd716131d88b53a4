"""Near copies, benchmark passages and vector links against brute force, and the pipeline's stages."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetscope.llm import common, decontaminate, embeddings, minhash
from fleetscope.llm.components import components, counted_components
from fleetscope.llm.oracle import ORACLE
from fleetscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def groups(nodes, linked):
    """Smallest member of the component of each node."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def near_texts():
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [None, "", " \t ", "one two", "ONE  two", "one two three", "a b c d", "a b c d a b c d"]
    texts += [edited(rng, base, rng.randrange(0, 5)) for _ in range(60)]  # some link, some only through others
    texts += [" ".join(base)] * 30 + [" ".join(base).upper()]
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    texts += [" ".join(base[:40] + [f"u{k}x{j}" for j in range(60)]) for k in range(20)]  # a shared passage
    return list(enumerate(texts))


@pytest.mark.parametrize("width, rounds", [(4, 2), (4, 0), (5, 1)])
def test_near_duplicates(frame, monkeypatch, width, rounds):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = near_texts()
    sets = {i: minhash.shingle_set((t or "").encode(), width) for i, t in rows}
    linked = [(a, b) for a in sets for b in range(a) if minhash.similar(sets[a], sets[b], 80)]
    label = groups(sets, linked)
    got = minhash.near_duplicates(frame([*rows, rows[9], (None, "a b c d")], SCHEMA), width, 80, max(1, rounds)).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_near_duplicates_in_one_bucket(frame, monkeypatch):
    """Pairs that meet in one crowded bucket only, most of them far from every leader."""
    signed, rng = minhash.signatures, random.Random(5)
    monkeypatch.setattr(minhash, "signatures", lambda *a, **k: signed(*a, **k).withColumn("bands", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 8, raising=False)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(20)]
    rows = [(2 * k + j, edited(rng, words, j)) for k, words in enumerate(texts) for j in (0, 1)]
    got = minhash.near_duplicates(frame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(40)]


def test_near_duplicates_of_ids_with_several_texts(frame):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    near = lambda words, at: " ".join([*words[:at], "other", *words[at + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 3)), (3, near(b, 50)), (3, near(b, 50)), (0, near(b, 2)), (5, " ".join(a))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows, SCHEMA)).collect())
    assert got == sorted([(1, 1, True), (1, 0, False), (2, 1, False), (3, 0, False), (3, 0, False), (0, 0, True), (5, 1, False)])


def test_links_of_ids_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [0.0, 1.0], "x"), (2, [1.0, 0.001], "x"), (2, [1.0, 0.001], "x"), (0, [0.001, -1.0], "x"), (1, [1.0, 0.0], "y")]
    got = embeddings.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted([(1, 2, 1), (1, 0, 1), (2, 2, 1), (2, 2, 1), (0, 0, 0), (1, 0, 1)])


def test_near_duplicates_of_nothing(frame):
    assert minhash.near_duplicates(frame([], SCHEMA)).count() == 0
    assert minhash.near_duplicates(frame([(1, None)], SCHEMA)).first().component_id == 1


def test_components(spark):
    rng = random.Random(2)
    for _ in range(3):
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
        label = groups({n for e in edges for n in e}, edges)
        touched = {n for a, b in edges if a != b for n in (a, b)}
        got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert {r.node: r.component for r in got} == {n: label[n] for n in touched} and len(got) == len(touched)


def test_components_of_one_lot_take_no_round(spark, monkeypatch):
    """Edges that fit a task are stars when they are first written; every further round is some ten exchanges of the driver."""
    rounds = []
    store = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: rounds.append(name) or store(df, name))
    monkeypatch.setattr("fleetscope.llm.components.stored", common.stored, raising=False)
    got = components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint").repartition(4)).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(61), 0) and rounds == ["edges"]
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_components_of_few_edges_in_many_tasks(spark, monkeypatch):
    """Stars of many tasks that fit one lot are joined as one, and counted edges need no exchange: rounds cost hundreds of tasks each."""
    stores = []
    store = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: stores.append(name) or store(df, name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint").repartition(4)
        got = components(edges).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.component for r in got} == dict.fromkeys(range(61), 0) and len(got) == 61 and len(stores) == 2
    rows, n = counted_components(edges, 60)
    assert {r.node: r.component for r in rows.collect()} == dict.fromkeys(range(61), 0) and n == 61 and len(stores) == 3
    rows, n = counted_components(edges, 60, most=8)
    assert {r.node: r.component for r in rows.collect()} == dict.fromkeys(range(61), 0) and n >= 61


def test_components_of_many_lots(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    label = groups({n for e in edges for n in e}, edges)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3), most=4).collect()
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in got} == {n: label[n] for n in touched} and len(got) == len(touched)


def weighted(text, width):
    import re

    words = re.findall(r"[^\W_]+", (text or "").lower())
    return words, min(width, len(words))


def test_leaks_against_all_windows(frame):
    rng = random.Random(4)
    items = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (6, 12, 30, 30, 50)] + ["alpha beta", "", None, "solo word here now"]
    docs = []
    for i in range(120):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            copy = edited(rng, rng.choice(items[:6]).split(), rng.randrange(0, 3)).split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy[rng.randrange(2) :]
        docs.append((i, ", ".join(words).title()))
    docs += [(200, None), (201, ""), (202, items[4] + ". " + items[4]), (203, "x " * 20_000 + items[3]), (202, items[4]), (None, items[4])]
    items_rows = [*enumerate(items), (4, items[4])]
    from collections import Counter

    expected = {}
    for i, text in docs:
        if i is None:
            continue
        words, _ = weighted(text, 5)
        for k, item in enumerate(items):
            target, width = weighted(item, 5)
            if not target:
                continue
            want = Counter(tuple(target[j : j + width]) for j in range(len(target) - width + 1))
            grams = [tuple(words[j : j + width]) for j in range(len(words) - width + 1)]
            if not set(grams) & set(want):
                continue
            for s in range(-len(target), len(words)):
                b, e = max(s, 0), min(s + len(target), len(words))
                have = Counter(grams[b : max(b, e - width + 1)])
                common = sum((have & want).values())
                union = sum((have | want).values())
                if common and common / union >= 0.8:
                    expected[i, k] = max(expected.get((i, k), 0), common / union)
    got = decontaminate.leaks(frame(docs, SCHEMA), frame(items_rows, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == expected and len(got) == len(expected) > 20


def test_leaks_of_nothing(frame):
    items = frame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.leaks(frame([], SCHEMA), items).count() == 0
    assert decontaminate.leaks(frame([(1, "a b c d e f")], SCHEMA), items.limit(0)).count() == 0


def test_hamming_blocks_miss_nothing(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(decontaminate.RADIUS + 1)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint")
    shared = F.size(F.array_intersect(decontaminate._blocks("a"), decontaminate._blocks("b")))
    assert pairs.filter(shared == 0).count() == 0


def test_vector_links(frame, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 24)
    monkeypatch.setattr(embeddings, "LEAF", 5)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + rng.normal(scale=rng.choice([0.0, 0.12, 0.2]), size=16)).astype("f4").tolist() for _ in range(260)]
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(vectors)] + [(300 + i, vectors[0], 1) for i in range(40)]
    odd = [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [None, *vectors[0][1:]], 1), (405, vectors[0], None), (406, [1.0], 1), (407, [2.0], 1), (408, [float("inf"), 1.0], 1), (409, [-3.0], 1), (None, vectors[0], 1)]
    good = [r for r in rows] + [r for r in odd if r[0] in (406, 407, 409)]

    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / np.sqrt((a @ a) * (b @ b))

    linked = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98]
    label, degree = groups([r[0] for r in good], linked), {}
    for pair in linked:
        for n in pair:
            degree[n] = degree.get(n, 0) + 1
    got = embeddings.link_vectors(frame(rows + odd, "vec_id bigint, embedding array<float>, label int")).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        expected = (degree.get(r.vec_id, 0), label.get(r.vec_id, r.vec_id))
        assert (r.n_links, r.component_id) == expected and r.kept == (None if r.vec_id is None else expected[1] == r.vec_id)
    assert embeddings.link_vectors(frame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    result = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in result.select("doc_id").collect()}
        result = corpus_pipeline.stored(stage(spark, result, SF), "stage")
        after = [r.doc_id for r in result.select("doc_id").collect()]
        assert result.columns == docs.columns and set(after) <= before and len(set(after)) == len(after)
        if name == "near_copies":
            sets = {i: minhash.shingle_set(texts[i].encode(), 5) for i in before}
            ids = sorted(sets)
            label = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if minhash.similar(sets[a], sets[b], 80)])
            assert set(after) == {i for i in ids if label[i] == i}
        if name == "benchmark":
            leaking = {r.doc_id for r in decontaminate.leaks(docs, benchmark).collect()}
            assert set(after) == before - leaking
    assert corpus_pipeline.run(spark, SF).count() == result.count()


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (2, "", None, "s", 0), (None, "text", "en", "s", 4), (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("score", F.lit("clash"))
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).count()
