"""The filter audit against plain Python, and pair-index BPE against the tokenizers library on whole texts."""

import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest

from fleetscope.llm import filter_audit, pair_bpe, token_counts
from fleetscope.llm.common import vocabulary

JSON = vocabulary("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string"
LABELS = "doc_id bigint, quality int, toxic int"


def expected(docs, labels):
    """All audit rows, order by order and document by document."""
    fails = []
    for i, text, _ in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        })
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    out, orders = {}, ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {lang or "" for *_, lang in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = list(own)
            for step, f in enumerate(order, 1):
                removed = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                shapley[f] += len(removed)
                failing = [k for k in own if fails[k][f]]
                out[part, order, step] = [
                    len(left), len(removed), len(failing) - len(removed), sum(sum(fails[k].values()) == 1 for k in failing),
                    sum(docs[k][0] in good for k in removed), sum(docs[k][0] in toxic for k in removed),
                ]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def sample():
    rng = random.Random(4)
    texts = [None, "", "Few words", "a " * 150, "$ " + " ".join(map(str, range(120))), "ABC " * 130, "É" * 30, " \t\n"]
    texts += [" ".join(rng.choice(["x", "Y", "#"]) + str(rng.randrange(60)) for _ in range(rng.randrange(40, 160))) for _ in range(30)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(120)]
    docs += [(5, "one more row of an id", "en"), docs[7], docs[7], (None, texts[3], "en"), (None, texts[3], "de")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    return docs, labels


def test_audit(frame):
    docs, labels = sample()
    got = filter_audit.audit(frame(docs, DOCS).withColumnsRenamed({"a": "row", "bucket": "filter"}), frame(labels, LABELS)).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got} == expected(docs, labels)
    assert len(got) == 3 * 600


def test_audit_of_nothing(frame):
    assert filter_audit.audit(frame([], DOCS), frame([], LABELS)).count() == 0
    got = filter_audit.audit(frame([(1, "x", None)], DOCS), frame([], LABELS)).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.good_lost) for r in got][:2] == [("", 0, 1, 0), ("", 0, 0, 0)]


PARTS = [
    " ", "  ", "\n", "\t", "\r\n", "\xa0", "　", "\x0b", "\x1c", "\x85", "​", "a", "don't", "'s", "é", "²", "½", "123", ",", "!!", "<|endoftext|>",
    "日本", "😀", "x̂", "_", "'", "Ünï", "Ж", "aaaaaaa", "the", "\0", "International",
]
TEXTS = [None, "", "same", "same", "<|endoftext|><|endoftext|> x ", "é" * 5000, "ab" * 9000, "word " * 40_000, " \n\n  end "]


def test_pair_index_gives_the_library_s_ids():
    encoder, whole, rng = pair_bpe.PairEncoder(JSON), token_counts._whole(JSON), random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(3000)]
    got = encoder.packed(texts)
    assert got == [np.array(x, "<u4").tobytes() for x in whole(texts)]
    assert [encoder.decoded(x) for x in got] == texts
    assert encoder.decoded(got[0][:0] + np.array([encoder.vocabulary.byte_ids[0xE9]], "<u4").tobytes()) == "�"


def test_pair_index_of_random_merges():
    """Against the definition, word by word: again and again the lowest rank, leftmost first."""
    rng = random.Random(9)
    made, merges = [bytes([b]) for b in b"abc"], {}
    for rank in range(40):
        left, right = rng.choice(made), rng.choice(made)
        if (left, right) not in merges and left + right not in made:
            merges[left, right] = rank
            made.append(left + right)
    ids = {t: i for i, t in enumerate(made)}
    byte_ids = [ids.get(bytes([b]), 0) for b in range(256)]
    packed = {ids[a] << 32 | ids[b]: r << 32 | ids[a + b] for (a, b), r in merges.items()}
    words = list({bytes(rng.choices(b"abc", k=rng.randint(0, 14))) for _ in range(3000)})
    got = pair_bpe.encode_words(words, pair_bpe.Vocabulary(byte_ids, packed, made, {}))
    for word, ids_of in zip(words, got, strict=True):
        parts = [bytes([b]) for b in word]
        while found := [(merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert np.frombuffer(ids_of, "<u4").tolist() == [ids[p] for p in parts]


def test_round_trip(frame):
    whole, docs = token_counts._whole(JSON), [*enumerate(TEXTS), (None, "x"), (2, "other")]
    got = pair_bpe.round_trip(frame(docs, "doc_id bigint, text string")).collect()
    want = []
    for i, text in docs:
        ids = np.array(whole([text or ""])[0], "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    encoded = pair_bpe.encode(frame(docs, "doc_id bigint, text string"))
    assert {(r.doc_id, r.text) for r in pair_bpe.decode(encoded).collect()} == {(i, t or "") for i, t in docs}
    assert pair_bpe.round_trip(frame([], "doc_id bigint, text string")).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            pair_bpe.load_vocabulary(str(tmp_path / "other.json"))
