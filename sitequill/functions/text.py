"""Text scalars: cleaning, truncation, normalising, keys and setting clean-up."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequill.functions.basics import let, nonempty

# Patterns and formats whose results have to agree with the host's functions.
SCRIPT_OR_STYLE = r"(?is)<(script|style)[^>]*>.*?</\1>"
ANY_TAG = r"(?s)<(?:[^\s>][^>]*)?(?:>|\z)"
ENTITY_TOKENS = r"(?s)&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"
UNICODE_SPACES = r"(?U)\s+"
TRIM_CHARS = " \t\n\r\u000b\u0000"
DATE_FORMAT = "MMMM d, yyyy"
NOT_IN_KEY = "[^a-z0-9_-]"
NOT_IN_SLUG = "[^a-z0-9-]"
NOT_IN_EMAIL = r"[^A-Za-z0-9!#$%&'*+\-=?^_`{|}~@.\[\]]"
EXCERPT_LENGTH = 300
WORD_CUT_SHARE = 0.8
LISTING_PREFIX = "listing_"
ITEM_PREFIX = "content_"

# A single word of ASCII without tag, entity or white space; cleaning leaves it as it is.
CLEAN_WORD = r"^[!-%'-;=-~]*\z"

# The HTML 4.01 named entities come from the standard library, as "name=codepoint" pairs.
NAMED_ENTITIES = ",".join(f"{name}={code}" for name, code in sorted(name2codepoint.items()))


def strip_tags(c: Column) -> Column:
    """Drop scripts and styles with their bodies, then every tag."""

    def strip(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, SCRIPT_OR_STYLE, ""), ANY_TAG, "")
        return F.when(text.contains("<"), bare).otherwise(text)

    return let(c, strip)


# One token of the text: an entity becomes its character, anything else stays. Written as SQL
# so that the driver sends one expression instead of building it call by call.
# The most frequent names come before the search in the whole list.
_DECODE_TOKEN = f"""token -> CASE
  WHEN NOT startswith(token, '&') THEN token
  WHEN token = '&amp;' THEN '&' WHEN token = '&lt;' THEN '<' WHEN token = '&gt;' THEN '>'
  WHEN token = '&quot;' THEN '"' WHEN token = '&nbsp;' THEN '\u00a0'
  WHEN token LIKE '&_%' THEN get(transform(
    array(CAST(coalesce(
      nullif(regexp_extract(token, '^&#0*([0-9]{{1,7}});$', 1), ''),
      conv(nullif(regexp_extract(token, '^&#[xX]0*([0-9a-fA-F]{{1,6}});$', 1), ''), 16, 10),
      try_element_at(str_to_map('{NAMED_ENTITIES}', ',', '='), substr(token, 2, length(token) - 2))
    ) AS BIGINT)),
    code -> CASE
      WHEN code IN (9, 10, 13) OR code BETWEEN 32 AND 126 OR code BETWEEN 160 AND 55295
        OR code BETWEEN 57344 AND 1114111
      THEN decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32')
      ELSE token END), 0)
  ELSE token END"""


def decode_entities(c: Column) -> Column:
    """Decode named and numeric entities in one pass, so ``&amp;lt;`` becomes ``&lt;``."""

    def decode(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(ENTITY_TOKENS), F.lit(0))
        decoded = F.call_function("transform", tokens, F.expr(_DECODE_TOKEN))
        return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)

    return let(c, decode)


def trim_all(c: Column) -> Column:
    return F.trim(c, F.lit(TRIM_CHARS))


def truncate_words(c: Column, max_length: int) -> Column:
    """Cut at ``max_length`` characters, at the last space when that lies late enough."""

    def cut(text: Column) -> Column:
        def finish(head: Column) -> Column:
            from_end = F.instr(F.reverse(head), " ")
            last_space = F.length(head) - from_end
            late = (from_end > 0) & (last_space > WORD_CUT_SHARE * max_length)
            kept = F.when(late, F.substring(head, F.lit(1), last_space)).otherwise(head)
            return F.concat(kept, F.lit("..."))

        return F.when(
            F.length(text) > max_length, let(F.substring(text, 1, max_length), finish)
        ).otherwise(text)

    return let(c, cut)


def clean_text(c: Column, max_length: int | None = None) -> Column:
    """Strip tags, decode entities, collapse Unicode white space, trim; optionally truncate."""

    def clean(raw: Column) -> Column:
        text = trim_all(F.regexp_replace(decode_entities(strip_tags(raw)), UNICODE_SPACES, " "))
        return F.when(raw.rlike(CLEAN_WORD), raw).otherwise(text)

    text = let(c, clean)
    return truncate_words(text, max_length) if max_length else text


def excerpt(summary: Column, body: Column, max_length: int = EXCERPT_LENGTH) -> Column:
    return clean_text(F.when(nonempty(summary), summary).otherwise(body), max_length)


def date_display(c: Column) -> Column:
    return F.date_format(c, DATE_FORMAT)


def key_normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NOT_IN_KEY, "")


def slug_normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), NOT_IN_SLUG, "-")


def header_text(c: Column) -> Column:
    """Free text from a header or a settings form: no tags, no outer white space."""
    return trim_all(strip_tags(F.coalesce(c, F.lit(""))))


def email_text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), NOT_IN_EMAIL, "")


def raise_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def bounded_int(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.abs(c)))


def line_list(c: Column) -> Column:
    """Split on newlines, trim, drop the empty ones."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), trim_all)
    return F.filter(lines, nonempty)


def listing_key(types: Column) -> Column:
    return F.concat(F.lit(LISTING_PREFIX), F.md5(F.array_join(types, ",")))


def item_key(post_type: Column, identifier: Column) -> Column:
    return F.concat(
        F.lit(ITEM_PREFIX),
        key_normalise(post_type),
        F.lit("_"),
        key_normalise(identifier.cast("string")),
    )


def client_key(ip: Column) -> Column:
    return F.md5(ip)
