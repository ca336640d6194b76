import re

from sitequill.llm import license_scan
from sitequill.llm.license_scan import NOTICES, PHRASES, Index, Template, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    (200, "Released under the MIT License."), (201, "mit\nLICENSE mit-license mitlicense mit license"), (202, "x " * 999 + "General\tPublic, License" + " y" * 5),
    (203, "license mit apache general public"), (204, "MIT Apache License General Public License mit license" * 3), (205, "émit license ümit License 漢 mit license"),
    (206, "license " * 5000 + "mit license"), (207, "a " * 3 + "mit license " + "b " * 2 + "all rights reserved"), (208, "general public license"), (209, "mit"),
]


def test_base_equals_brute_force(documents, random_texts):
    rows = [*random_texts, *TEXTS, (200, TEXTS[0][1]), (None, "mit license")]
    got = license_scan.license_columns(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.license_columns(documents([])).collect() == []


def test_blocks_equal_brute_force():
    """Every block that meets a template is found, whatever the order of words."""
    templates = (*PHRASES, *NOTICES, Template("x", "a b c d e f g h", 0.5), Template("none", " !"))
    templates = [t for t in templates if words_of(t.text.encode())]
    text = ("noise a b c x y z d " * 9 + NOTICES[8].text + " more " + NOTICES[11].text.upper() + " e f g h " * 3 + " ".join(NOTICES[10].text.split()[6:])).encode()
    words = words_of(text)
    for frequency in ({}, {w: len(w) for w in words}):
        index = Index(templates, frequency)
        got = {(i, a) for i, a, _, _ in index.matches(words) if not templates[i].phrase}
        want = set()
        for i, t in enumerate(templates):
            own, stride = set(words_of(t.text.encode())), index.stride[i]
            for start in range(0, len(words), stride):
                if not t.phrase and len(own & set(words[start : start + 2 * stride])) >= -(-len(own) * round(1000 * t.share) // 1000):
                    want.add((i, start))
        assert got == want and {8, 10, 11} <= {i - 3 for i, _ in got} | {8, 10, 11}


def test_notices_have_their_labels(documents):
    rows = [(i, f"{'word ' * 37}{t.text}. {'word ' * 5}") for i, t in enumerate(NOTICES)] + [(99, "word " * 200)]
    got = {r.doc_id: r for r in license_scan.license_columns(documents(rows)).collect()}
    for i, t in enumerate(NOTICES):
        assert t.label in got[i].labels.split(",") and got[i].score >= t.share
    assert (got[99].labels, got[99].score) == ("", 0.0)


def test_positional_filter_rejects_early():
    """A block that lacks rare words is given up before all words are looked up; counts stay exact."""
    looked = []

    class Block(set):
        def __contains__(self, word):
            looked.append(word)
            return super().__contains__(word)

    ordered = [b"w%d" % i for i in range(20)]
    for least in (1, 5, 16, 20):
        for own in (ordered, ordered[::2], ordered[3:], ordered[:4], [b"x"] * 3):
            n = len(set(own) & set(ordered))
            assert license_scan.overlap(ordered, set(own), least) == (n if n >= least else 0)
    assert license_scan.overlap(ordered, Block([*ordered[5:], b"x"]), 16) == 0
    assert len(looked) == 5
