"""Features, learning and scores against plain loops, and accuracy on rows that were held out."""

import math
import os
import random

import numpy as np
import pytest
import xxhash

from sitequill.llm import quality_classifier as qc


def plain_features(text):
    words = qc._WORD.findall(text or "")
    shapes = []
    for i, w in enumerate(words):
        shapes.append((1 << 20) if i and words[i - 1] == w else xxhash.xxh32_intdigest(qc.shape_of(w).encode()) & 0xFFFF)
    words = [xxhash.xxh3_64_intdigest(w.encode()) >> 16 for w in words]
    found = {}
    for kind, values in enumerate((words, shapes)):
        for n in ((1, 2), (1, 2, 3))[kind]:
            for i in range(len(values) - n + 1):
                x = kind * 10 + n
                for j in range(n):
                    x = (x + values[i + j] * int(qc._PLACES[kind][j])) % 2**64
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
                bucket = (x ^ (x >> 31)) >> (64 - qc.BITS)
                found[bucket] = found.get(bucket, 0) + 1
    total = sum(found.values())
    return {b: math.sqrt(c / total) for b, c in found.items()}


TEXTS = ["", None, " \n ", "one", "One one TWO two2 two2 ### ### é_x", "a b c " * 50, "x" * 5000, "wort, " * 7 + "Ähre ǅ 12 !!"]


def test_features_equal_plain_loops(monkeypatch):
    for stretch in (1 << 16, 1, 2, 3, 7):
        monkeypatch.setattr(qc, "STRETCH", stretch)
        for text in TEXTS:
            at, values = qc.features(text, qc._Words())
            want = plain_features(text)
            assert dict(zip(at.tolist(), values.tolist())) == pytest.approx(want)


def test_updates_equal_plain_loops():
    rng = random.Random(2)
    rows = [({rng.randrange(30): rng.random() for _ in range(5)}, rng.randrange(2)) for _ in range(200)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= qc.L1:
            return 0.0
        return -(z[i] - math.copysign(qc.L1, z[i])) / ((qc.BETA + math.sqrt(n[i])) / qc.ALPHA + qc.L2)

    model = qc.Ftrl()
    for x, label in rows:
        model.learn(np.array(list(x)), np.array(list(x.values())), label)
        x = x | {1 << qc.BITS: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / qc.ALPHA
            z[i] = z.get(i, 0) + g - sigma * w[i]
            n[i] = n.get(i, 0) + g * g
    got = model.weights()
    assert np.nonzero(got)[0].tolist() == sorted(i for i in z if weight(i))
    assert [got[i] for i in sorted(z)] == pytest.approx([weight(i) for i in sorted(z)])


def made(rng, good):
    words = ["".join(rng.choice(["re", "th", "on", "al", "ti"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 80))]
    if good:
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(3)
    return " ".join(f"{w}{rng.choice(['###', '&&&', '$$$'])}" for w in words) if kind == 0 else " ".join(words).upper() if kind == 1 else " ".join(f"{w} {w} {w}" for w in words)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    rows = [(i, made(rng, i % 5 > 0), int(i % 5 > 0)) for i in range(600)]
    return rows + [(700, None, 1), (701, "", 0), (702, "word " * 60_000, 0), (702, "another text", 0), (None, "no id", 1)]


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, score double")

    return make


def test_held_out_accuracy_and_scores(documents, labels, table):
    docs = documents([(i, t) for i, t, _ in table])
    marks = labels([(i, y, None, "label", 0.5) for i, _, y in table if i not in (2, 7)] + [(7, None, 0, "", 0.0), (8, 3, 0, "", 0.0), (9999, 1, 0, "", 0.0)])
    weights = qc.learn(docs, marks)
    rows = qc.quality_scores(docs, marks).collect()
    assert len(rows) == len(table)
    known = qc._Words()
    texts = {i: t for i, t, _ in table}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None and r.doc_id != 702:
            x = plain_features(texts[r.doc_id])
            assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weights[b] * v for b, v in x.items()) - weights[-1])))
            assert r.score == qc.score(texts[r.doc_id], weights, known)
    truth = {i: y for i, _, y in table}
    apart = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(apart) > 100 and sum(r.predicted == truth[r.doc_id] for r in apart) >= 0.97 * len(apart)
    assert not [r for r in rows if r.doc_id is None][0].held_out


def test_held_out_labels_are_never_learnt(documents, labels, table):
    docs = documents([(i, t) for i, t, _ in table if i is not None])
    apart = {r.doc_id for r in docs.where(qc.held_out(docs.doc_id)).collect()}
    marks = [(i, y, None, "", 0.0) for i, _, y in table if i is not None]
    other = [(i, 1 - y if i in apart else y, *rest) for i, y, *rest in marks]
    assert (qc.learn(docs, labels(marks)) == qc.learn(docs, labels(other))).all()


def test_nothing_to_learn_or_score(documents, labels, table):
    docs = documents([(i, t) for i, t, _ in table[:20]])
    for marks in ([], [(i, 1, 0, "", 0.0) for i in range(20)]):
        assert {r.score for r in qc.quality_scores(docs, labels(marks)).collect()} == {0.5}
    assert qc.quality_scores(documents([]), labels([(1, 1, 0, "", 0.0)])).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no sample data")
def test_accuracy_on_the_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = qc.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
