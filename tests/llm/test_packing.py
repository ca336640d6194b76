import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sitequill.llm import mixing, packing


def check_plan(counts, length):
    plan = packing.Plan(counts, length)
    rows = plan.places()
    placed, ends = Counter(), {}
    taken = {}
    for size, first, each, _, _ in rows:
        assert first >= taken.get(int(size), 0)
        taken[int(size)] = int(first)
    used = {}
    for room in plan.rooms:
        for runs, times in plan.open[room]:
            assert sum(s * n for s, n in runs) == length - room >= 0 and times > 0
            for s, n in runs:
                used[s] = used.get(s, 0) + n * times
    assert used == {s: n for s, n in counts.items() if n}
    return plan.sequences


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(0, 50), max_size=40))
def test_plan_places_every_piece_once(counts):
    n = check_plan(counts, 256)
    total = sum(s * c for s, c in counts.items())
    assert n >= -(-total // 256)


def test_plan_is_near_the_least_number():
    rng = random.Random(1)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(20_000))
    least = -(-sum(s * c for s, c in counts.items()) // 4096)
    assert check_plan(counts, 4096) <= 1.005 * least + 1


def test_least_squares():
    rng = np.random.default_rng(0)
    a, truth = rng.random((20, 40)), np.zeros(40)
    truth[[3, 7, 20]] = [1.0, 2.0, 0.5]
    x = packing.nonnegative_least_squares(a, a @ truth)
    assert (x >= 0).all() and np.allclose(a @ x, a @ truth, atol=1e-6)
    assert packing.patterns(4, 2) == ((4,), (3, 1), (2, 2))


def brute(rows):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    out = []
    for i, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


ROWS = [
    (200, "It's <|endoftext|> x<|startoftext|>y I'll don't 1234 ½ ²"), (201, "É e\u0301 \u0301a ΣΑΣ İstanbul ﬁ"), (202, "a\u00a0b\u2003c\u3000d\x85e\x1cf"),
    (203, "hello,world!!! (a-b) 漢字かな 한국어 😀😀"), (204, "a\x00b \x0b\x0c c"), (None, "no id"), (205, "same"), (205, "same"),
]


def test_pieces_and_places(documents, random_texts):
    rows = [*random_texts, *ROWS]
    got = packing.packed_documents(documents(rows)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(rows)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert len(ends) <= -(-sum(r.length for r in got) // 4096) + 1


def test_sequences_hold_the_ids(spark, documents, random_texts, tmp_path):
    packing.pieces(documents(random_texts)).write.parquet(str(tmp_path / "p"))
    found = spark.read.parquet(str(tmp_path / "p"))
    rows = packing.sequences(found).collect()
    assert all(len(r.ids) == 4 * r.length <= 4 * 4096 for r in rows)
    assert sum(r.length for r in rows) == sum(r.length for r in found.collect())
    assert packing.packed_documents(documents([])).collect() == []


def test_order_of_the_files_decides(spark, documents, tmp_path):
    """Weights of the mixing stage reach sequence_id: pieces of a length and sequences are in file order."""
    rows = [(i, "word " * (3 if i % 3 else 2500) + "end") for i in range(400)] + [(7, "word word word end")]
    docs, seen = documents(rows, lambda i: "ab"[i % 2]), []
    for k, weights in enumerate(({"a": 9, "b": 1}, {"a": 1, "b": 9})):
        mixing.in_mixed_order(docs, weights).write.option("maxRecordsPerFile", 70).parquet(str(tmp_path / str(k)))
        read = spark.read.parquet(str(tmp_path / str(k)))
        place, n = {}, 0
        for f in sorted((tmp_path / str(k)).glob("part-*")):
            for r in spark.read.parquet(str(f)).collect():
                place.setdefault(r.doc_id, n)
                n += 1
        got = corpus_pipeline.packed_sequences(spark, read, "").collect()
        plain = packing.packed_documents(docs).collect()
        same = lambda x: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in x)
        assert same(got) == same(plain) and len({(r.sequence_id, r.offset) for r in got}) == len(got) == len(plain)
        first = {}
        for r in got:
            first[r.sequence_id] = min(first.get(r.sequence_id, n), place[r.doc_id])
        assert sorted(first) == list(range(len(first)))
        assert [first[s] for s in sorted(first)] == sorted(first.values())
        seen.append({(r.doc_id, r.sequence_id) for r in got})
    assert seen[0] != seen[1]
