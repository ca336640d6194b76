import random
import zlib

from sitequill.llm import toxicity
from sitequill.llm.lexicon_match import Automaton, Matches, Trie, edits_allowed


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_and_trie_equal_edit_distance():
    rng = random.Random(3)
    terms = [("abcde", False), ("abcabcabc", False), ("bca", False), ("cabb", True), ("ccccc", False)]
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11))) for _ in range(1500)] + [t for t, _ in terms]
    trie, known = Trie(terms), Matches(terms)
    for word in words:
        close = []
        for term, stem in terms:
            most = edits_allowed(term, stem)
            d = min(distance(word[:n], term) for n in range(len(word) + 1)) if stem else distance(word, term)
            if d <= most:
                close.append((d, term))
        want = min(close, default=None)
        got = trie.match(word)
        assert got == (want and (want[1], want[0])), word
        assert known[word] == got, word
    a = Automaton("kitten", 2)
    state = a.start()
    for c in "sittin":
        state = a.step(state, c)
    assert a.distance(state) == 2


def labelled(n=400):
    rng = random.Random(5)
    clean = [f"c{i}word" for i in range(200)]
    bad = ["snarfle", "grumbleton", "wexo"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad[:2]) if rng.random() < 0.7 else bad[2] + rng.choice("abcdefgh") + "ty"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, term string")


def test_held_out_accuracy_and_misspellings(spark, documents):
    rows, labels = labelled()
    extra = [(1000, None), (1001, ""), (1002, "snarfle snarflee snarfl c1word c2word " * 2), (1003, "snarfle " * 20_000), (None, "c1word"), (3, rows[3][1])]
    labels += [(None, 1, 1), (5000, 0, 1), (2, 1, None)]
    got = toxicity.toxic_scores(documents([*rows, *extra]), label_table(spark, labels)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    judged = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 400]
    assert len(judged) > 50 and all(r.predicted == truth[r.doc_id] for r in judged)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].predicted for i in (1000, 1001, 1002, 1003, None)] == [0, 0, 1, 1, 0]


def test_labels_of_held_out_rows_are_never_used(spark, documents):
    rows, labels = labelled()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one = toxicity.learn(documents(rows), label_table(spark, labels))
    assert one == toxicity.learn(documents(rows), label_table(spark, flipped)) and len(one.terms) == 3


def test_context_of_matches():
    known = Matches([("snarfle", False)])
    said = toxicity.hits_of('He said "you are a snarfle" and left early today', known)
    plain = toxicity.hits_of("you are a snarfle and nobody likes that at all", known)
    assert said[0]["quoted"] and not plain[0]["quoted"] and plain[0]["addressed"]
    assert toxicity.hits_of("nothing here", known) == []


def test_empty_tables(spark, documents):
    assert toxicity.toxic_scores(documents([]), label_table(spark, [])).collect() == []
    rows = toxicity.toxic_scores(documents([(1, "a b")]), label_table(spark, [])).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)]
    docs = documents([(1, "a b"), (1, "a b")])
    assert toxicity.clean_documents(docs, label_table(spark, [])).columns == docs.columns


def test_quoted_stretches_equal_the_plain_test():
    known = Matches((("bad", False),))
    for text in ("bad “bad” bad", "“bad bad", "bad” “x bad y” bad “bad”", '"bad" bad "bad\n bad" bad', "„bad“ «bad» bad", "“” bad"):
        marks = toxicity._quoted(text)
        starts = [m.start() for m in toxicity._WORD.finditer(text)]
        for h in toxicity.hits_of(text, known):
            assert h["quoted"] == any(a < starts[h["word"]] < b for a, b in marks), text
