import re

from sitequill.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed)


def texts(random_texts):
    line = "some words of a line that is long enough to count as a window"
    return [
        *random_texts,
        (200, "\n".join([line] * 5)), (201, f"{line} {' '.join(map(str, range(30)))} {line}"), (202, "a " * 500),
        (203, "😀 é x #*$%&|<> " + " ".join(map(str, range(30)))), (204, "\n\n \n"), (205, "x\x1cy \x0b\x0c z"),
        (206, " ".join(f"{w}***" for w in "these are words with far too many symbols in them to be of any use".split() * 3)),
    ]


def test_measures_equal_brute_force(documents, random_texts):
    rows = texts(random_texts)
    got = quality.quality_columns(documents(rows)).collect()
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got}
    assert found == {i: brute(t) for i, t in rows}
    assert not any(r.kept for r in got if r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert {0, 1, 2, 97} <= kept and 206 not in kept


def test_order_of_rules_does_not_change_the_verdict(documents, random_texts):
    rows = documents(texts(random_texts))
    rules = [*quality.BASE_RULES, *quality.METHOD_RULES]
    one = quality.kept_documents(rows, rules)
    other = quality.kept_documents(rows, rules[::-1])
    assert one.columns == rows.columns
    wanted = {r.doc_id for r in quality.quality_columns(rows).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in other.collect()} == wanted


def test_native_and_lazy(documents, random_texts):
    """No Python in the plan; features of later rules stand behind the verdict of earlier ones."""
    plan = quality.kept_documents(documents(random_texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert quality.kept_documents(documents([])).collect() == []
    assert quality.quality_columns(documents([(1, "a"), (1, "a"), (None, None)])).count() == 3


def test_best_rule_first():
    """Most rejections per cost; features already there are free, rows already rejected don't count."""
    rule = lambda *features: quality.Rule("r", features, "true")
    rules = [rule("n_repeat_words"), rule("n_stutters"), rule("n_symbols"), rule("n_words")]
    costs = dict.fromkeys(["words", "hashes", "windows", "sorted", "again", "n_repeat_words", "n_stutters", "n_words"], 1.0)
    costs["n_symbols"] = 0.5
    hits = {frozenset({0}): 10, frozenset({1, 3}): 8, frozenset({2}): 3, frozenset(): 70}
    # 3 rows for 0.5; then 8 for two of words and a count, which leaves rule 3 nothing; 10 for five more.
    assert quality.best_first(rules, hits, costs) == [2, 1, 0, 3]
    assert quality.best_first(rules, hits, costs, frozenset({"again", "words", "n_words"}))[0] == 3
    assert quality.best_first(rules, {}, costs) == [2, 1, 3, 0]


def test_sample_reads_few_splits(spark):
    """The sample is bounded in rows and in length, and takes its rows from the first splits."""
    texts = spark.range(0, 200_000, 1, 64).selectExpr("concat('text ', id) as __q_text")
    rows = [int(r[0].split()[1]) for r in quality._sample(texts).collect()]
    assert len(rows) == quality.SAMPLE_ROWS and max(rows) < 200_000 // 64
    assert rows != list(range(len(rows)))
    assert quality._sample(texts.where("false")) is None
    assert quality._sample(spark.sql("select repeat('x', 40000) as __q_text")) is None


def test_long_texts_and_failed_rows(documents):
    """Texts beyond the sample's length are judged like others; a base failure is never kept."""
    words = " ".join(f"word{i}" for i in range(9_000))
    rows = [(1, words), (2, words + " *" * 5_000), (3, "a b"), (4, "*** " * 30)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_columns(documents(rows)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False)}
    assert sorted(r.doc_id for r in quality.kept_documents(documents(rows)).collect()) == [1]
