"""The trie of rebuilt conversations against plain nested loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sitequill.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    nodes = {w[:d] for w in whole.values() for d in range(len(w) + 1)}
    members = {x: sorted(c for c, w in whole.items() if w[: len(x)] == x) for x in nodes}
    children = {x: [y for y in nodes if len(y) == len(x) + 1 and y[: len(x)] == x] for x in nodes}
    found = []
    for x in nodes:
        below = [y for y in nodes if y[: len(x)] == x]
        tokens = sum((len(members[y]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", y[-1][1])) for y in below if y)
        ends = ",".join(str(c) for c in members[x] if whole[c] == x)
        found.append((
            members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(children[x]),
            sum(not children[y] for y in below), tokens, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


def result(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in conversation_trie.prefix_trie(frame).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    said = [("user", "hello there"), ("assistant", "a\tb\nc"), (None, "x"), ("user", None), ("", ""), ("user", "é d ")]
    found = []
    for c in [*range(45), 60, 61, 79, 83, -3, -20, -25, 2**40]:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 9])):
            found.append((c, turn, *rng.choice(said[: rng.choice([1, 2, 6])])))
    found += [(100, t, "user", f"turn {t}") for t in range(40)] + [(c, t, "user", f"turn {t}") for c in (101, 102, 103) for t in range(40)]
    # Null numbers come first; rows of one turn stand by role and text; null ids are no conversation.
    found += [(200, None, "b", "null"), (200, 0, "z", "first"), (200, None, "a", "null"), (200, 1, "a", "y"), (200, 1, "a", "x"), (200, 1, "a", "x")]
    found += [(None, 0, "user", "nobody"), (None, None, None, None), (300, 0, "user", "long " * 20_000)]
    rng.shuffle(found)
    return found


def test_equal_to_loops(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], f"{SCHEMA}, conv long, k1 string, depth int")
    assert result(frame) == brute(rows)


def test_small_parts_and_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PART", 3)
    monkeypatch.setattr(conversation_trie, "PIECE", 2)
    copies = [(c, t, "user", f"same {t}") for c in range(400, 460) for t in range(3)]
    assert result(spark.createDataFrame(rows + copies, SCHEMA)) == brute(rows + copies)


def test_nothing(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []


def test_conversations_without_turns(spark):
    # All are rebuilt from a conversation that is absent, and have no turn after the first h.
    lost = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:5]
    rows = [(c, 0, "user", "gone") for c in lost]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 5
