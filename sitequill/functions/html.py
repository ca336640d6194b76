"""HTML to Markdown as one column expression.

``html_to_markdown`` is a chain of regex rules that Spark runs inside the JVM, one narrow
projection per page and no shuffle. Rules whose replacement has to be computed (tables,
lists, quotes, code) go through ``block_replace``. The order of the rules matters.

``strict=False`` gives the repaired forms: tag names must end at a word boundary (so ``<b``
does not open on ``<body``), header rows are not repeated when a table has no body section.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequill.functions.basics import block_replace, let
from sitequill.functions.text import clean_text, decode_entities, strip_tags, trim_all

# ---------------------------------------------------------------------------------------
# The patterns that decide what counts as which element. They are valid both
# for Java and for RE2. `$n` marks the captured groups in a replacement.
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
COMMENT = r"(?s)<!--.*?-->"

TABLE = r"(?is)<table[^>]*>(.*?)</table>"
TABLE_HEAD = r"(?is)<thead[^>]*>(.*?)</thead>"
TABLE_BODY = r"(?is)<tbody[^>]*>(.*?)</tbody>"
TABLE_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
HEADER_CELL = r"(?is)<th[^>]*>(.*?)</th>"
DATA_CELL = r"(?is)<td[^>]*>(.*?)</td>"

DEFINITIONS = r"(?is)<dl[^>]*>(.*?)</dl>"
DEFINITION_TERM = r"(?is)<dt[^>]*>(.*?)</dt>"
DEFINITION_TEXT = r"(?is)<dd[^>]*>(.*?)</dd>"

FIGURE = r"(?is)<figure[^>]*>(.*?)</figure>"
FIGURE_CAPTION = r"(?is)<figcaption[^>]*>(.*?)</figcaption>"

IMAGE_SRC_ALT = r"""(?is)<img[^>]+src=["']([^"']+)["'][^>]*alt=["']([^"']*)["'][^>]*/?>"""
IMAGE_ALT_SRC = r"""(?is)<img[^>]+alt=["']([^"']*)["'][^>]*src=["']([^"']+)["'][^>]*/?>"""
IMAGE_SRC = r"""(?is)<img[^>]+src=["']([^"']+)["'][^>]*/?>"""

# (rule, lower-case text that must be present, pattern, replacement), in order, after the blocks above.
INLINE_RULES = [
    ("heading 6", "</h6>", r"(?is)<h6[^>]*>(.*?)</h6>", "\n###### $1\n"),
    ("heading 5", "</h5>", r"(?is)<h5[^>]*>(.*?)</h5>", "\n##### $1\n"),
    ("heading 4", "</h4>", r"(?is)<h4[^>]*>(.*?)</h4>", "\n#### $1\n"),
    ("heading 3", "</h3>", r"(?is)<h3[^>]*>(.*?)</h3>", "\n### $1\n"),
    ("heading 2", "</h2>", r"(?is)<h2[^>]*>(.*?)</h2>", "\n## $1\n"),
    ("heading 1", "</h1>", r"(?is)<h1[^>]*>(.*?)</h1>", "\n# $1\n"),
    ("paragraph", "</p>", r"(?is)<p[^>]*>(.*?)</p>", "$1\n\n"),
    ("line break", "<br", r"(?i)<br\s*/?>", "\n"),
    ("strong", "</strong>", r"(?is)<strong[^>]*>(.*?)</strong>", "**$1**"),
    ("bold", "</b>", r"(?is)<b[^>]*>(.*?)</b>", "**$1**"),
    ("emphasis", "</em>", r"(?is)<em[^>]*>(.*?)</em>", "*$1*"),
    ("italic", "</i>", r"(?is)<i[^>]*>(.*?)</i>", "*$1*"),
    ("deleted", "</del>", r"(?is)<del[^>]*>(.*?)</del>", "~~$1~~"),
    ("struck", "</s>", r"(?is)<s[^>]*>(.*?)</s>", "~~$1~~"),
    ("link", "</a>", r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>""", "[$2]($1)"),
    ("image, src first", "<img", IMAGE_SRC_ALT, "![$2]($1)"),
    ("image, alt first", "<img", IMAGE_ALT_SRC, "![$1]($2)"),
    ("image, no alt", "<img", IMAGE_SRC, "![]($1)"),
]

ORDERED_LIST = r"(?is)<ol[^>]*>(.*?)</ol>"
LIST_ITEM = r"(?is)<li[^>]*>(.*?)</li>"

UNORDERED_RULES = [
    ("list item", "</li>", LIST_ITEM, "- $1\n"),
    ("list tags", "ul", r"(?i)</?ul[^>]*>", "\n"),
]

QUOTE = r"(?is)<blockquote[^>]*>(.*?)</blockquote>"
CODE_WITH_LANGUAGE = (
    r"""(?is)<pre[^>]*><code[^>]*class=["'].*?language-([^"'>\s]+)["'][^>]*>(.*?)</code></pre>"""
)
PREFORMATTED = r"(?is)<pre[^>]*>(.*?)</pre>"
CODE_TAG = r"(?i)</?code[^>]*>"

CLOSING_RULES = [
    ("inline code", "</code>", r"(?is)<code[^>]*>(.*?)</code>", "`$1`"),
    ("rule", "<hr", r"(?i)<hr[^>]*/?>", "\n---\n"),
    ("abbreviation", "</abbr>", r"""(?is)<abbr[^>]+title=["']([^"']+)["'][^>]*>(.*?)</abbr>""", "$2 ($1)"),
    ("highlight", "</mark>", r"(?is)<mark[^>]*>(.*?)</mark>", "==$1=="),
]

NEWLINE_RUNS = r"\n{3,}"
BLANK_RUNS = r" [ \t]+|\t[ \t]*"
LINE_START_SPACES = r"(?md)^ +"
# ---------------------------------------------------------------------------------------


def _bounded(pattern: str) -> str:
    """The repaired pattern: the tag name ends at white space or at the closing bracket."""
    return re.sub(r"(<(?:[a-z]+[1-6]?))\[\^>\]\*>", r"\1(?:\\s[^>]*)?>", pattern, count=1)


def tags_present(text: Column) -> Column:
    """The page in lower case, or null when a later rule may make new tags.

    Most rules look for a tag that most pages lack, and a plain search for its last part is
    cheaper than a pattern. New tags can only come from decoded ``&lt;`` or ``&gt;`` in a block,
    or from a '<' that another tag separates from its '>'; for such pages every rule scans.
    """
    open_ended = (
        text.contains("lt;")
        | text.contains("gt;")
        | text.contains("&#")
        | text.contains("amp;#")
        | text.rlike("<[^>]*<")
    )
    return F.when(~open_ended, F.lower(text))


def _has(seen: Column | None, fragment: str) -> Column | None:
    return None if seen is None else F.coalesce(seen.contains(fragment), F.lit(True))


def _apply(
    c: Column, rules: list[tuple[str, str, str, str]], strict: bool, seen: Column | None
) -> Column:
    """Fold the text through a list of rules held as data."""
    steps = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"),
                F.lit(pattern if strict else _bounded(pattern)).alias("pattern"),
                F.lit(replacement).alias("replacement"),
            )
            for _, tag, pattern, replacement in rules
        ]
    )

    def step(text: Column, rule: Column) -> Column:
        replaced = F.regexp_replace(text, rule["pattern"], rule["replacement"])
        if seen is None:
            return replaced
        wanted = F.coalesce(F.contains(seen, rule["tag"]), F.lit(True))
        return F.when(wanted, replaced).otherwise(text)

    return F.aggregate(steps, c, step)


def drop_invisible(c: Column) -> Column:
    """Remove scripts, styles and comments."""

    def drop(text: Column, low: Column) -> Column:
        # Only a page with a script can get a style tag that it did not have before.
        scripts = F.regexp_replace(text, SCRIPT, "")
        bare = F.when(low.contains("</script>"), F.regexp_replace(scripts, STYLE, "")).when(
            low.contains("</style>"), F.regexp_replace(text, STYLE, "")
        )
        return let(
            F.coalesce(bare, text),
            lambda t: F.when(t.contains("<!--"), F.regexp_replace(t, COMMENT, "")).otherwise(t),
        )

    return let(c, lambda text: let(F.lower(text), lambda low: drop(text, low)))


def _every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _section_rows(section: Column) -> Column:
    """Rows of one table section: header cells, then data cells; empty rows are dropped."""

    def row(source: Column, index: Column) -> Column:
        def of(heads: Column) -> Column:
            cells = F.concat(heads, _every(source, DATA_CELL))
            return F.struct(
                (((index == 0) & section["first_is_header"]) | (F.size(heads) > 0)).alias("is_header"),
                F.transform(cells, lambda cell: clean_text(cell)).alias("cells"),
            )

        heads = F.when(F.lower(source).contains("</th>"), _every(source, HEADER_CELL))
        return let(F.coalesce(heads, F.array().cast("array<string>")), of)

    rows = F.transform(_every(section["html"], TABLE_ROW), row)
    return F.filter(rows, lambda r: F.size(r["cells"]) > 0)


def _pipe_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))


def _table(strict: bool):
    def render(inner: Column) -> Column:
        has_head = F.lower(inner).contains("</thead>") & inner.rlike(TABLE_HEAD)
        has_body = F.lower(inner).contains("</tbody>") & inner.rlike(TABLE_BODY)
        unsectioned = inner if strict else F.regexp_replace(inner, TABLE_HEAD, "")
        sections = F.array(
            F.struct(
                F.when(has_head, F.regexp_extract(inner, TABLE_HEAD, 1)).otherwise("").alias("html"),
                F.lit(True).alias("first_is_header"),
            ),
            F.struct(
                F.when(has_body, F.regexp_extract(inner, TABLE_BODY, 1))
                .otherwise(unsectioned)
                .alias("html"),
                (~has_head & ~has_body).alias("first_is_header"),
            ),
        )

        def layout(rows: Column) -> Column:
            def line(row: Column, index: Column) -> Column:
                dashes = F.array_repeat(F.lit("---"), F.size(row["cells"]))
                ruled = (index == 0) & (row["is_header"] | has_head)
                return F.concat(
                    _pipe_line(row["cells"]),
                    F.when(ruled, _pipe_line(dashes)).otherwise(F.lit("")),
                )

            text = F.array_join(F.transform(rows, line), "")
            return F.when(F.size(rows) == 0, F.lit("")).otherwise(
                F.concat(F.lit("\n"), text, F.lit("\n"))
            )

        return let(F.flatten(F.transform(sections, _section_rows)), layout)

    return render


def convert_tables(c: Column, strict: bool = True, seen: Column | None = None) -> Column:
    return block_replace(c, TABLE, _table(strict), _has(seen, "</table>"))


def convert_definitions(c: Column, seen: Column | None = None) -> Column:
    def render(inner: Column) -> Column:
        # `zip_with` pads the shorter list with nulls: a term without text keeps its own line,
        # a text without term is dropped.
        pairs = F.zip_with(
            _every(inner, DEFINITION_TERM),
            _every(inner, DEFINITION_TEXT),
            lambda term, text: F.when(
                term.isNotNull(),
                F.concat(
                    F.lit("**"),
                    strip_tags(term),
                    F.lit("**\n"),
                    F.coalesce(F.concat(F.lit(": "), strip_tags(text), F.lit("\n\n")), F.lit("")),
                ),
            ).otherwise(F.lit("")),
        )
        return F.concat(F.lit("\n"), F.array_join(pairs, ""))

    return block_replace(c, DEFINITIONS, render, _has(seen, "</dl>"))


def convert_figures(c: Column, seen: Column | None = None) -> Column:
    def render(inner: Column) -> Column:
        def image(pattern: str, alt: Column) -> Column:
            return F.concat(
                F.lit("!["), alt, F.lit("]("), F.regexp_extract(inner, pattern, 1), F.lit(")\n")
            )

        picture = (
            F.when(
                inner.rlike(IMAGE_SRC_ALT),
                image(IMAGE_SRC_ALT, F.regexp_extract(inner, IMAGE_SRC_ALT, 2)),
            )
            .when(inner.rlike(IMAGE_SRC), image(IMAGE_SRC, F.lit("")))
            .otherwise(F.lit(""))
        )
        caption = F.when(
            inner.rlike(FIGURE_CAPTION),
            F.concat(
                F.lit("*"), strip_tags(F.regexp_extract(inner, FIGURE_CAPTION, 1)), F.lit("*\n")
            ),
        ).otherwise(F.lit(""))
        return F.concat(F.lit("\n"), picture, caption, F.lit("\n"))

    return block_replace(c, FIGURE, render, _has(seen, "</figure>"))


def convert_ordered_lists(c: Column, seen: Column | None = None) -> Column:
    def render(inner: Column) -> Column:
        items = F.transform(
            _every(inner, LIST_ITEM),
            lambda item, i: F.concat(
                (i + 1).cast("string"), F.lit(". "), clean_text(item), F.lit("\n")
            ),
        )
        return F.concat(F.lit("\n"), F.array_join(items, ""), F.lit("\n"))

    return block_replace(c, ORDERED_LIST, render, _has(seen, "</ol>"))


def convert_quotes(c: Column, seen: Column | None = None) -> Column:
    def render(inner: Column) -> Column:
        text = trim_all(decode_entities(strip_tags(inner)))
        lines = F.filter(
            F.transform(F.split(text, "\n", -1), trim_all), lambda line: line != ""
        )
        quoted = F.transform(lines, lambda line: F.concat(F.lit("> "), line, F.lit("\n")))
        return F.concat(F.lit("\n"), F.array_join(quoted, ""), F.lit("\n"))

    return block_replace(c, QUOTE, render, _has(seen, "</blockquote>"))


def convert_code_blocks(c: Column, seen: Column | None = None) -> Column:
    def fence(language: Column, code: Column) -> Column:
        return F.concat(
            F.lit("\n```"), language, F.lit("\n"), trim_all(code), F.lit("\n```\n")
        )

    def with_language(match: Column) -> Column:
        return fence(
            F.regexp_extract(match, CODE_WITH_LANGUAGE, 1),
            decode_entities(F.regexp_extract(match, CODE_WITH_LANGUAGE, 2)),
        )

    def plain(inner: Column) -> Column:
        return fence(F.lit(""), F.regexp_replace(decode_entities(inner), CODE_TAG, ""))

    guard = _has(seen, "</pre>")
    c = block_replace(c, CODE_WITH_LANGUAGE, with_language, guard, group=0)
    return block_replace(c, PREFORMATTED, plain, guard)


def tidy_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, NEWLINE_RUNS, "\n\n")
    c = F.regexp_replace(c, BLANK_RUNS, " ")
    return trim_all(F.regexp_replace(c, LINE_START_SPACES, ""))


def inline_markup(c: Column, strict: bool = True, seen: Column | None = None) -> Column:
    return _apply(c, INLINE_RULES, strict, seen)


def unordered_lists(c: Column, strict: bool = True, seen: Column | None = None) -> Column:
    return _apply(c, UNORDERED_RULES, strict, seen)


def closing_markup(c: Column, strict: bool = True, seen: Column | None = None) -> Column:
    return _apply(c, CLOSING_RULES, strict, seen)


def _while_tags(text: Column, step: Callable[[Column], Column]) -> Column:
    """Go on with the rules while there is a '<'; every pattern needs one, so the rest is left out."""
    return let(text, lambda t: F.when(t.contains("<"), step(t)).otherwise(t))


def html_to_markdown(c: Column, strict: bool = True) -> Column:
    def blocks(text: Column, seen: Column) -> Column:
        text = unordered_lists(convert_ordered_lists(text, seen), strict, seen)
        text = convert_code_blocks(convert_quotes(text, seen), seen)
        return strip_tags(closing_markup(text, strict, seen))

    def convert(page: Column, seen: Column) -> Column:
        def inline(text: Column) -> Column:
            marked = inline_markup(convert_figures(convert_definitions(text, seen), seen), strict, seen)
            return _while_tags(marked, lambda t: blocks(t, seen))

        text = _while_tags(convert_tables(page, strict, seen), inline)
        return tidy_whitespace(decode_entities(text))

    return let(
        drop_invisible(c),
        lambda page: let(tags_present(page), lambda seen: convert(page, seen)),
    )
