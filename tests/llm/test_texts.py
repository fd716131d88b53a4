"""Language model, quality, HTML and WARC."""

import io
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import html, lm, quality, warc

SCHEMA = "doc_id bigint, text string"
DOCS = [
    (0, "The cat sat. The cat ran."), (1, None), (2, ""), (3, "the CAT sat"), (4, "the cat sat"), (4, "the cat sat"),
    (5, "an unseen word"), (6, "x " * 3000), (None, "the dog"), (8, "the cat\x0bsat\tagain"),
]


def test_lm_matches_its_formula(frame):
    held = F.col("doc_id").isin(3, 5)
    got = lm.scores(frame(DOCS, SCHEMA), held).collect()
    assert len(got) == len(DOCS)
    texts = [(i, (t or "").encode().lower().split() + [lm.END]) for i, t in DOCS]
    train = [w for i, w in texts if i not in (3, 5)]
    words, pairs, after = Counter(), Counter(), Counter()
    for text in train:
        words.update(text)
        pairs.update(zip([None, *text], text, strict=False))
        after.update([None, *text[:-1]])
    n, v = sum(words.values()), len(words)
    by_power = np.zeros((2, 64))
    for c in words.values():
        by_power[:, int(math.log2(c))] += (c, 1)
    k = lm.fitted_k(*by_power, sum(c == 1 for c in pairs.values()))

    def base(w):
        return (words[w] + 1) / (n + v + 1)

    def step(h, w):
        f = float(lm.failure_weights(np.array([float(after[h])]), k)[0])
        return (1 - f) * pairs[h, w] / max(1, after[h]) + f * base(w)

    for h in list(after)[:5]:
        assert sum(step(h, w) for w in words) + step(h, b"never seen") == pytest.approx(1)
    expected = Counter()
    for i, text in texts:
        score = sum(math.log10(step(h, w)) for h, w in zip([None, *text], text, strict=False))
        low = sum(math.log10(base(w)) for w in text)
        expected[i, i in (3, 5), len(text), sum(w in words for w in text), n, round(low, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected


def test_lm_blocks_change_nothing(frame, monkeypatch):
    one = {r.doc_id: r.score for r in lm.scores(frame(DOCS[:4], SCHEMA)).collect()}
    monkeypatch.setattr(lm, "BLOCK_TEXTS", 1)
    many = {r.doc_id: r.score for r in lm.scores(frame(DOCS[:4], SCHEMA)).collect()}
    assert one == pytest.approx(many)
    assert lm.scores(frame([], SCHEMA)).count() == 0


def test_lm_default_split(spark):
    ids = spark.range(200).select("id", lm.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in ids)


def labelled(n):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        plain = ["".join(rng.choice(list("aeinrst"), rng.integers(2, 9))) for _ in range(rng.integers(5, 60))]
        if i % 5 == 0:
            plain = [w.upper() + "!!" for w in plain] if i % 10 else [w for w in plain for _ in range(6)]
        rows.append((i, " ".join(plain), int(i % 5 != 0)))
    return rows


def test_quality_held_out(spark, frame):
    rows = labelled(600)
    docs = frame([r[:2] for r in rows] + [(None, "text"), (1000, None), (1001, ""), (5, rows[5][1])], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 400] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.with_quality(docs, model).select("doc_id", "score", "words").collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r["words"] == "clash" for r in got)
    held = [(r.score >= 0.3, rows[r.doc_id][2]) for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert sum(p == q for p, q in held) >= 0.98 * len(held)
    same = [r.score for r in got if r.doc_id == 5]
    assert same[0] == same[1]
    empty = [r.score for r in got if r.doc_id in (1000, 1001)]
    assert empty[0] == empty[1]


def test_quality_without_labels(spark, frame):
    docs = frame([(1, "a b")], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.with_quality(docs, quality.train(docs, none)).first().score > 0.99
    low = spark.createDataFrame([(1, 0)], "doc_id bigint, quality int")
    assert quality.with_quality(docs, quality.train(docs, low)).first().score < 0.01
    assert quality.with_quality(frame([], SCHEMA), quality.train(docs, none)).count() == 0


def test_shape():
    assert [quality.shape(w) for w in ("Then,!!", "ABC", "12a", "é", "--")] == ["Aa,!", "A", "0a", "a", "-"]


PAGE = """<!doctype html><html><head><title>Site</title><style>p{}</style></head><body><header><h1>Brand</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies, a lot of them, everywhere.</div>
<article><header><h1>Head&amp;line</h1></header><p>First <b>par</b>agraph&nbsp;of
 the text, long enough to count.<p>Short.<script>var x = "</p>";</script><div class="ad">Buy this now</div>
<form><label>Mail</label><input></form><p>Last <span hidden>secret</span>words<br>here &#233;.</p><footer>Filed under</footer></article>
<section id="comments"><article class="comment"><p>Nice article, thank you for writing all this.</p></article></section>
<aside>More to read</aside><footer>Imprint</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head&line First paragraph of the text, long enough to count. Short. Last words here é."
    assert html.main_text("") == "" and html.main_text("<nav>menu</nav>") == ""
    assert html.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert html.main_text("<div><p>" + "long text " * 50 + "</div><div><a>x</a><a>y</a></div>").startswith("long text")


def test_extract_rows(frame):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>" * 5000 + "deep" + "</div>" * 300), (5, "u", "<article>" + "<p>word</p>" * 20_000)]
    got = html.extract(frame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 6
    texts = {r.page_id: r.text for r in got}
    assert texts[2] == texts[3] == "" and texts[None] == "deep" and len(texts[5]) == 5 * 20_000 - 1
    assert all(r.n_chars == len(r.text) for r in got)


PAGES = "page_id bigint, url string, html string"


def test_warc_round_trip(frame):
    same, small = "<p>" + "copy " * 40, "tiny"
    rows = [(9, "http://h/ä b", same), (3, "u", same), (4, None, same), (5, "u", small), (6, "u", small), (7, "u", None), (8, "u", ""), (10, "u", "é" * 200_000), (3, "u", same)]
    rows += [(100 + i, "u", f"<html><nav>menu</nav>{i} text " * 60) for i in range(40)] + [(None, "u", same)]
    got = warc.read_warc(warc.write_warc(frame(rows, PAGES), part_bytes=2000)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert [(by_id[i].record_type, by_id[i].refers_to) for i in (3, 4, 9, 5, 6, 7)] == [("response", None), ("revisit", 3), ("revisit", 3)] + [("response", None)] * 3
    for i, _, text in rows:
        r, data = by_id[i], (text or "").encode()
        import hashlib

        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.payload == (None if r.record_type == "revisit" else data)
    assert by_id[None].record_type == "response"
    assert warc.read_warc(warc.write_warc(frame([], PAGES))).count() == 0


def test_damaged_archives(tmp_path):
    good = warc.record(1, "u", b"payload", "d", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)[1].endswith(b"payload")
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"Content-Length: ", b"Content-Length: 1"), good.replace(b"WARC-Type:", b"WARC-Kind:")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    archive = warc.Archive(str(tmp_path))
    for _ in range(40):
        archive.add(good * 1)
    archive.close()
    data = (tmp_path / archive.part.name).read_bytes()
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 40
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(data[:-3])))


def test_a_name_alone_takes_no_article_away():
    body = "".join(f"<p>Sentence {i} of the story, long enough to count as text.</p>" for i in range(9))
    told = " ".join(f"Sentence {i} of the story, long enough to count as text." for i in range(9))
    for start, end in (('<div class="post-share-article">', "</div>"), ('<article id="comments-on-trade">', "</article>")):
        assert html.main_text(f"<body><nav>menu</nav><div class=side><p>Note</p></div>{start}{body}{end}</body>") == told
    comment = '<div class="comment-content"><p>I liked the story very much, thank you.</p></div>'
    assert html.main_text(f"<body><main>{body}</main><div class=comments>{comment * 9}</div>{comment}</body>") == told


def test_unmatched_end_tags_take_linear_time():
    start = time.perf_counter()
    assert html.main_text("<div>" * 50_000 + "words of the page" + "</b>" * 50_000) == "words of the page"
    assert time.perf_counter() - start < 5
