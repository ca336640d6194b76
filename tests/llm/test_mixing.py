from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitequill.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_period_deviates_by_less_than_one_block(units):
    units = dict(enumerate(units))
    total = sum(units.values())
    slots = mixing.period(units)
    at = {t: s for s, own in slots.items() for t in own}
    assert sorted(at) == list(range(total))
    given_out = Counter()
    for t in range(total):
        given_out[at[t]] += 1
        for s, u in units.items():
            assert abs(given_out[s] * total - u * (t + 1)) < total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=6))
def test_phases_use_every_block_once_and_leave_no_gap(table):
    blocks = {i: n for i, (n, _) in enumerate(table)}
    units = {i: u for i, (_, u) in enumerate(table)}
    slots = []
    seen = Counter()
    for s, first, used, start, total, u, own in mixing.phases(blocks, units):
        assert first == seen[s]
        seen[s] += used
        slots += [start + k // u * total + own[k % u] for k in range(used)]
    assert {s: seen[s] for s in blocks} == blocks
    assert sorted(slots) == list(range(sum(blocks.values())))


def source(i):
    return None if i is not None and i % 11 == 0 else "hot" if i is None or i % 3 else f"s{i % 4}"


def test_every_document_has_a_place(documents):
    rows = [(i, "t") for i in range(700)] + [(5, "t"), (None, "t")]
    docs = documents(rows, source)
    got = mixing.mixed(docs, block=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(700)) + Counter([None])
    assert len({(r.slot, r.place) for r in got}) == len(got)
    owner = {r.slot: r.source for r in got}
    assert sorted(owner) == list(range(len(owner)))
    for s in set(owner.values()):
        own = sorted((r.block, r.place) for r in got if r.source == s)
        assert own == [(k // 8, k % 8) for k in range(len(own))]
        slots = [slot for _, slot in sorted({(r.block, r.slot) for r in got if r.source == s})]
        assert slots == sorted(slots)


def test_weights_hold_until_a_source_is_used_up(documents):
    docs = documents([(i, "t") for i in range(600)], lambda i: "abc"[i % 3])
    got = mixing.mixed(docs, {"a": 4, "b": 2, "c": 2}, block=10).collect()
    order = [s for _, s in sorted({(r.slot, r.source) for r in got})]
    done = Counter()
    for t, s in enumerate(order[:38], 1):
        done[s] += 1
        assert all(abs(done[x] - t * w) < 1 for x, w in {"a": 0.5, "b": 0.25, "c": 0.25}.items())
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"a": 0})


def test_order_of_rows(spark, documents, tmp_path):
    docs = documents([(i, f"text {i}") for i in range(300)] + [(7, "text 7")], source)
    ordered = mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns
    ordered.write.parquet(str(tmp_path / "o"))
    files = sorted((tmp_path / "o").glob("part-*"))
    ids = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
    place = {r.doc_id: (r.slot, r.place) for r in mixing.mixed(docs).collect()}
    assert sorted(ids) == sorted([*range(300), 7])
    assert [place[i] for i in ids] == sorted(place[i] for i in ids)
    assert mixing.mixed(documents([])).collect() == []
    assert mixing.in_mixed_order(documents([])).collect() == []


@pytest.mark.parametrize(
    "blocks,weights",
    [
        ((14_000, 6_000), (0.7, 0.3)),
        ((20_000, 3), (0.9999, 0.0001)),
        ((31_250, *[3_125] * 4), (1_000_000**0.5, *[100_000**0.5] * 4)),
        ((9_000, 500, 3_000, 1, 40), (0.7, 0.2, 0.1, 1e-7, 1 / 3)),
    ],
)
def test_real_weights_hold_over_the_whole_schedule(blocks, weights):
    """Less than one block from the exact target at every slot, also after a source is used up."""
    exact = [Fraction(w) for w in weights]
    ends = sorted({Fraction(n) / w for n, w in zip(blocks, exact, strict=True)})
    given_out, seen = [0] * len(blocks), 0
    moment, at = Fraction(0), 0
    for t, (i, k) in enumerate(mixing.schedule(list(blocks), list(weights)), 1):
        assert k == given_out[i]
        given_out[i] += 1
        seen = t
        rest = Fraction(1)  # one slot of fluid service, which may cross the end of a source
        while rest:
            rate = sum(w for n, w in zip(blocks, exact, strict=True) if n > moment * w)
            step = min(rest, (ends[at] - moment) * rate)
            moment, rest = moment + step / rate, rest - step
            at += moment == ends[at]
        if t % 7 == 0 or t > sum(blocks) - 50:
            assert all(abs(g - min(n, moment * w)) < 1 for g, n, w in zip(given_out, blocks, exact, strict=True))
    assert seen == sum(blocks) and tuple(given_out) == blocks


def test_weights_over_many_slots_of_a_table(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 10 < 7, 'a', 'b') as source")
    slots = [r.slot for r in mixing.mixed(docs, {"a": 0.7, "b": 0.3}, block=1).where("source = 'a'").orderBy("slot").collect()]
    assert len(slots) == 14_000
    assert all(abs(k - 0.7 * (slot + 1)) < 1 + 1e-6 for k, slot in enumerate(slots, 1))


def test_many_sources(spark):
    """Sources by the thousand: every document has a place, no source is a block from its target."""
    docs = spark.range(6_000).selectExpr("id as doc_id", "if(id < 3000, concat('s', id % 1500), 'big') as source", "'t' as text")
    got = mixing.mixed(docs, block=1).collect()
    assert sorted(r.doc_id for r in got) == list(range(6_000))
    assert sorted(r.slot for r in got) == list(range(6_000))
    total = 1500 * 2**0.5 + 3000**0.5
    big = sorted(r.slot for r in got if r.source == "big")
    both = 2 / 2**0.5 * total  # slots until the small sources are used up
    assert all(abs(k - (slot + 1) * 3000**0.5 / total) < 1 + 1e-6 for k, slot in enumerate(big, 1) if slot + 1 <= both)
    assert mixing.in_mixed_order(docs).count() == 6_000
