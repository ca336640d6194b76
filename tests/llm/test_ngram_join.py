import pytest

from sitequill.llm import ngram_join


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_classes_equal_brute_force(documents, random_texts, width, num, den):
    got = ngram_join.ngram_classes(documents(random_texts), width, num, den)
    assert sorted(map(tuple, got.collect())) == brute(random_texts, width, num, den)


def test_chains_and_repeated_rows(documents):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):  # each links with its neighbours only
        own = words[2 * i :] + [f"n{j}" for j in range(2 * i)]
        rows.append((100 - i, " ".join(own)))
    rows += [rows[3], rows[3], (50, "a b c")]
    got = ngram_join.ngram_classes(documents(rows), 1, 90, 100)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1, 90, 100)


def test_null_ids_and_empty_table(documents):
    rows = [(None, "a b c d"), (3, "a b c d"), (None, "x y z")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_classes(documents(rows)).collect()}
    assert got == {(None, 3), (3, 3), (None, None)}
    assert ngram_join.ngram_classes(documents([])).collect() == []


def test_one_of_each(documents, random_texts):
    docs = documents([*random_texts, random_texts[0], (None, "null id")])
    kept = ngram_join.one_of_each(docs)
    want = sorted({i for i, _, c in brute(random_texts, 5, 80, 100) if i == c})
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert kept.where("doc_id is null").count() == 1


def test_no_pair_twice_and_no_squares(spark, documents):
    """A group of near copies gives candidates in proportion to its size, not to its square."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = list(words)
        own[i] = f"n{i}"
        rows.append((i, " ".join(own)))
    counted = []
    original = ngram_join._links

    def spy(pairs, *rest):
        counted.append(pairs.count())
        assert pairs.select("a", "b").distinct().count() == counted[-1]
        return original(pairs, *rest)

    ngram_join._links = spy
    try:
        got = {r.component_id for r in ngram_join.ngram_classes(documents(rows)).collect()}
    finally:
        ngram_join._links = original
    assert got == {0}
    assert sum(counted) <= 150 * (ngram_join.ORDERS * ngram_join.REACH + 1)


def test_a_class_of_null_ids_links_others(documents):
    """1 and 3 are linked only by a text whose rows all have a null id."""
    words = [f"w{i}" for i in range(40)]
    text = lambda k: " ".join([*words[k:], *[f"n{j}" for j in range(k)]])
    rows = [(1, text(0)), (None, text(2)), (None, text(2)), (3, text(4)), (4, "other words")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_classes(documents(rows), 1, 90, 100).collect()}
    assert got == {(1, 1), (None, 1), (3, 1), (4, 4)}
    numbered = [(2 if i is None else i, t) for i, t in rows]
    want = {(None if i == 2 else i, c) for i, _, c in brute(numbered, 1, 90, 100)}
    assert got == want


def test_repeated_ids_with_unlike_texts(documents):
    """Each text of a repeated doc_id is judged on its own."""
    words = [f"w{i}" for i in range(30)]
    a, near, b, c = " ".join(words), " ".join([*words[:-1], "end"]), "all other words here", "and yet some more words"
    rows = [(1, a), (5, near), (5, b), (5, b), (6, c), (6, b + " x y z"), (6, ""), (6, None), (7, "")]
    kept = ngram_join.one_of_each(documents(rows), 1, 80, 100)
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert got == [(1, a), (5, b), (6, ""), (6, b + " x y z"), (6, c), (7, "")]
