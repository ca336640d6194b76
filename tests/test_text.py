import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequill.functions import text


def test_clean_text(apply):
    cases = {
        "<p>a <b>b</b>\n\tc</p>": "a b c",
        "a &amp;lt; b": "a &lt; b",
        "&#8364;&#x41;&#39;&quot;": "€A'\"",
        "&apos; &nope; & &#1; &#xD800;": "&apos; &nope; & &#1; &#xD800;",
        "a  b": "a b",
        "a < b": "a < b",
        "x<script>bad()</script><STYLE>p{}</STYLE>y": "xy",
        "tail <a href='": "tail",
        "": "",
    }
    assert apply(text.clean_text, [*cases, None]) == [*cases.values(), None]


def test_truncation(apply):
    long = "word " * 100
    got = apply(lambda c: text.clean_text(c, 50), [long, "x" * 60, "short", "a" * 20 + " " + "b" * 60])
    assert got[0] == ("word " * 10).strip() + "..."
    assert got[1] == "x" * 50 + "..."
    assert got[2] == "short"
    assert got[3] == "a" * 20 + " " + "b" * 29 + "..."  # the space lies before 80 %


def test_truncation_counts_characters(apply):
    assert apply(lambda c: text.truncate_words(c, 3), ["äöüß", "🙂🙂🙂"]) == ["äöü...", "🙂🙂🙂"]


def test_excerpt_prefers_a_summary_that_is_not_empty(spark):
    rows = spark.createDataFrame(
        [("sum", "body"), ("", "body"), ("0", "body"), (None, "body")], "s string, b string"
    )
    got = rows.select(text.excerpt(F.col("s"), F.col("b")).alias("e")).collect()
    assert [r.e for r in got] == ["sum", "body", "body", "body"]


def test_keys(spark):
    row = spark.range(1).select(
        text.item_key(F.lit("post"), F.lit("hello-world")).alias("a"),
        text.item_key(F.lit("Po st!"), F.lit(42)).alias("b"),
        text.listing_key(F.array(F.lit("post"), F.lit("page"))).alias("c"),
        text.slug_normalise(F.lit("A b_C")).alias("d"),
        text.raise_first(F.lit("two words")).alias("e"),
        text.date_display(F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")).alias("f"),
    ).first()
    assert row.a == "content_post_hello-world"
    assert row.b == "content_post_42"
    assert row.c == "listing_" + __import__("hashlib").md5(b"post,page").hexdigest()
    assert (row.d, row.e, row.f) == ("a-b-c", "Two words", "January 5, 2024")


def test_settings_texts(apply):
    assert apply(text.line_list, [" a \n\n0\nb\r\n", None]) == [["a", "b"], []]
    assert apply(text.email_text, ["in fo(a)@x.org", None]) == ["infoa@x.org", ""]
    assert apply(lambda c: text.bounded_int(c, 10, 100), [-20, 5, 500], "int") == [20, 10, 100]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab<>/ &;#x\t\n é", max_size=40), min_size=200, max_size=200))
def test_clean_text_leaves_no_tag_and_no_odd_space(apply, values):
    for raw, got in zip(values, apply(text.clean_text, values)):
        assert not re.search(r"\s\s|^\s|\s$| ", got), (raw, got)
        if "&" not in raw:
            assert not re.search(r"<[^\s>][^>]*>", got) or "<" in re.sub(r"<[^>]*>", "", raw)


def test_named_entities_are_those_of_html_4(apply):
    from html.entities import name2codepoint

    names = [f"&{n};" for n in name2codepoint]
    assert apply(text.decode_entities, names) == [chr(c) for c in name2codepoint.values()]
