from pyspark.sql import functions as F

from sitequill.functions import html, markup

CASES = {
    "<h1>A</h1><h2>B</h2><h3>C</h3>": "# A\n\n## B\n\n### C",
    "<p><strong>bold</strong> and <em>italic</em></p>": "**bold** and *italic*",
    "<strong><em>Nested</em></strong>": "***Nested***",
    '<a href="https://example.com">Link</a>': "[Link](https://example.com)",
    '<img src="i.jpg" alt="Alt">': "![Alt](i.jpg)",
    '<img alt="Alt" src="i.jpg" />': "![Alt](i.jpg)",
    '<img src="i.jpg">': "![](i.jpg)",
    "<ul><li>One</li><li>Two</li></ul>": "- One\n- Two",
    "<ol><li>One</li><li><b>Two</b></li><li>Three</li></ol>": "1. One\n2. **Two**\n3. Three",
    '<pre><code class="language-php">echo 1 &lt; 2;</code></pre>': "```php\necho 1 < 2;\n```",
    # Decoded code meets the tag stripper: an open "<" swallows the rest, as it does on the host.
    "<pre><code>a &lt;b&gt; c</code></pre>": "```\na c\n```",
    "x &lt; 3": "x < 3",
    "I <3 you": "I",
    "<pre><code>x  y</code></pre>": "```\nx y\n```",
    "<blockquote>This is a quote.</blockquote>": "> This is a quote.",
    "<blockquote><p>a</p><p>b</p></blockquote>": "> a\n> b",
    "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr>"
    "</tbody></table>": "| A | B |\n| --- | --- |\n| 1 | 2 |",
    "<table><tr><td>1</td></tr><tr><td>2</td></tr><tr></tr></table>": "| 1 |\n| --- |\n| 2 |",
    "<table><tbody><tr><td>1</td></tr></tbody></table>": "| 1 |",
    "<table></table>x": "x",
    "<p>Before</p><script>alert('x')</script><p>After</p>": "Before\n\nAfter",
    "a<!-- no\n<b>x</b> -->b": "ab",
    "<dl><dt>T</dt><dd>D</dd><dt>U</dt></dl>": "**T**\n: D\n\n**U**",
    '<figure><img src="a" alt="b"><figcaption>cap</figcaption></figure>': "![b](a)\n*cap*",
    '<figure><img alt="b" src="a"></figure>': "![](a)",
    "a<hr/>b<br>c": "a\n---\nb\nc",
    '<abbr title="Long">L</abbr> <mark>m</mark> <code>c</code> <del>d</del>': "L (Long) ==m== `c` ~~d~~",
    "&amp;lt;b&amp;gt;": "&lt;b&gt;",
    "<ul><li>a<ul><li>b</li></ul></li></ul>": "- a\n<li>b\n\n".replace("<li>", ""),
    "<P>Upper</P><B>x</B>": "Upper\n\n**x**",
    "<p><b>never closed</p>": "never closed",
    "<table><tr><td>&lt;b&gt;t&lt;/b&gt;</td></tr></table>": "| **t** |\n| --- |",
    "": "",
}


def test_html_to_markdown(apply):
    got = apply(html.html_to_markdown, [*CASES, None])
    for source, expected, result in zip(CASES, CASES.values(), got):
        assert result == expected.strip(), source
    assert got[-1] is None


def test_tag_names_without_boundary(apply):
    source = ["<span>a</span> <s>b</s>", "<body><b>x</b></body>", "<pre>p</pre><p>q</p>"]
    assert apply(html.html_to_markdown, source)[0] == "~~a b~~"
    bounded = apply(lambda c: html.html_to_markdown(c, strict=False), source)
    assert bounded == ["a ~~b~~", "**x**", "```\np\n```\nq"]


def test_head_rows_repeat_without_a_body_section(apply):
    source = ["<table><thead><tr><th>A</th></tr></thead><tr><td>1</td></tr></table>"]
    assert apply(html.html_to_markdown, source) == ["| A |\n| --- |\n| A |\n| 1 |"]
    assert apply(lambda c: html.html_to_markdown(c, strict=False), source) == [
        "| A |\n| --- |\n| 1 |"
    ]


def test_guards_change_nothing(apply, monkeypatch):
    sources = [
        *CASES,
        "</<p>b></p><b>x</b>",
        "<<i>b</i>>t</b>",
        "<pre>&lt;mark&gt;m&lt;/mark&gt;</pre>",
        "<blockquote>&#60;mark>m&#60;/mark></blockquote>",
        "<td>&amp;lt;hr&gt;</td><blockquote>&amp;lt;hr></blockquote>",
    ]
    guarded = apply(html.html_to_markdown, sources)
    monkeypatch.setattr(html, "tags_present", lambda t: F.lit(None).cast("string"))
    assert apply(html.html_to_markdown, sources) == guarded


def test_safe_markup(apply):
    cases = {
        '<a href="javascript:x" title="t" onclick="y">k</a>': '<a title="t">k</a>',
        '<a href="https://e.org">k</a>': '<a href="https://e.org">k</a>',
        "<A HREF='/local'>k</A>": "<a HREF='/local'>k</a>",
        "<script>s</script><iframe src=x></iframe>t": "st",
        '<img src="http://p" onerror="z" />': '<img src="http://p" />',
        '<img src=" java\nscript:z">': "<img>",
        "<!-- c -->1 < 2 > 0": "1 < 2 > 0",
        '<td colspan="2" style="x">c</td>': '<td colspan="2">c</td>',
        "[x](javascript:y)": "[x](javascript:y)",
    }
    assert apply(markup.safe_markup, cases) == list(cases.values())
    assert apply(markup.unsafe_links, ["[x](javascript:y) [z](http://a)"]) == [
        "[x](#) [z](http://a)"
    ]


def test_steps_keep_their_type_and_guards_see_decoded_brackets(apply, monkeypatch):
    """A step's type is worked out once, not for every row; `&gt;` can complete a tag in code."""
    assert "element_at" in str(html.let(F.col("x"), F.upper))
    sources = ["<pre><mark>x</mark&gt; a > b</pre>", "<PRE><hr&gt;</PRE>", "<script>s</script><style>t</STYLE>u"]
    guarded = apply(html.html_to_markdown, sources)
    monkeypatch.setattr(html, "tags_present", lambda t: F.lit(None).cast("string"))
    assert apply(html.html_to_markdown, sources) == guarded and guarded[2] == "u"
