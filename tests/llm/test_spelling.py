"""Spelling variants against a plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from sitequill.llm import spelling


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    n = {w: c for w, c in found.items() if len(w) >= 5 and c >= 3}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(others[w]), n.get(form[w])) for w in n)


def result(docs):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "abeéßÀ÷ÿ"
    stems = ["thing" + "".join(rng.choice(letters) for _ in range(rng.randrange(4))) for _ in range(40)]
    stems += ["".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7]))) for _ in range(40)]
    words = [w for w in stems for _ in range(rng.choice([1, 3, 9, 30]))]
    for w in list(words):
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            words.append(w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1 :])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "\n", "-", "1"]).join(words[i * 9 : i * 9 + 9])) for i in range(len(words) // 9)]
    long = "x" * 30_000
    rows += [(900, None), (901, ""), (902, "123 \n"), (903, "THINGS Things ÉTAIT était étäit"), (None, "thing thing thing"), (None, None)]
    return rows + [(904, f"{long} {long}y {long}"), (905, f"{long}y {long} {long}y q{long}"), rows[0], rows[0]]


def test_equal_to_all_pairs(documents, texts):
    want = brute(texts)
    assert result(documents(texts)) == want
    assert any(r[2] != r[1] and r[1] for r in want) and any(r[4] > 3 for r in want)


def test_small_blocks_and_slabs(documents, texts, monkeypatch):
    for slab, block in ((4, 2), (16, 64), (3, 10_000)):
        monkeypatch.setattr(spelling, "SLAB", slab)
        monkeypatch.setattr(spelling, "BLOCK", block)
        monkeypatch.setattr(spelling, "CELLS", 4)
        assert result(documents(texts, extra=False)) == brute(texts)


def test_nothing(documents):
    assert result(documents([])) == []
    assert result(documents([(1, "abcd abcd abcd"), (2, "three three")])) == []


def test_index_alone():
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.choice([6, 7]))) for _ in range(500)})
    asked = [w for w in words if len(w) == 6]
    got = {(asked[q], words[w]) for some, found in spelling.PositionIndex(words, 6).near(asked) for q, w in zip(some, found)}
    assert got == {(a, b) for a in asked for b in words if near(a.decode("latin-1"), b.decode("latin-1"))}
