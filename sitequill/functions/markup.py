"""Allow-list for HTML left in Markdown: known tags, listed attributes, safe link schemes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequill.functions.basics import let
from sitequill.functions.text import decode_entities

# The elements that may stay, each with the attributes it may keep.
ALLOWED_TAGS = {
    "a": ["href", "title", "rel", "target"],
    "abbr": ["title"],
    "b": [],
    "blockquote": ["cite"],
    "br": [],
    "cite": [],
    "code": ["class"],
    "del": ["datetime"],
    "em": [],
    "h1": [],
    "h2": [],
    "h3": [],
    "h4": [],
    "h5": [],
    "h6": [],
    "hr": [],
    "i": [],
    "img": ["alt", "src", "title", "width", "height"],
    "li": [],
    "ol": ["start"],
    "p": [],
    "pre": [],
    "s": [],
    "strong": [],
    "sub": [],
    "sup": [],
    "table": [],
    "tbody": [],
    "td": ["colspan", "rowspan"],
    "th": ["colspan", "rowspan", "scope"],
    "thead": [],
    "tr": [],
    "ul": [],
}
ALLOWED_SCHEMES = ["http", "https", "mailto", "tel"]
LINK_ATTRIBUTES = ["href", "src", "cite"]

TOKENS = r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+|<"
TAG_NAME = r"^</?([a-zA-Z][a-zA-Z0-9]*)"
ATTRIBUTE = r"""(?s)([a-zA-Z][a-zA-Z0-9-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Browsers end a numeric reference at the first other character, with or without its semicolon.
OPEN_REFERENCE = r"&#([xX][0-9a-fA-F]++|[0-9]++)(?!;)"
LINK_NAMES = [("colon", ":"), ("Tab", ""), ("NewLine", "")]
LEFT_REFERENCE = r"&#[xX]?[0-9a-fA-F]+;"
IGNORED_IN_LINK = r"(?U)[\s\p{Cntrl}\p{Cf}]+"
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
DECODE_ROUNDS = 4


def _allowed_pairs() -> list[str]:
    return [f"{tag} {name}" for tag, names in ALLOWED_TAGS.items() for name in names]


def _decode_once(value: Column) -> Column:
    """One round of entity decoding, with the references that matter in a link."""
    for name, char in LINK_NAMES:
        value = F.replace(value, F.lit(f"&{name};"), F.lit(char))
    return decode_entities(F.regexp_replace(value, OPEN_REFERENCE, "&#$1;"))


def _plain_link(value: Column) -> Column:
    """The link as a browser reads it; null if it still changes after DECODE_ROUNDS rounds."""
    rounds = F.sequence(F.lit(1), F.lit(DECODE_ROUNDS))
    decoded = F.aggregate(rounds, value, lambda v, _: _decode_once(v))
    settled = let(decoded, lambda v: F.when(_decode_once(v) == v, v))
    plain = F.when(value.contains("&"), settled).otherwise(value)
    return F.regexp_replace(F.regexp_replace(plain, LEFT_REFERENCE, ""), IGNORED_IN_LINK, "")


def _safe_link(value: Column) -> Column:
    """True when the decoded value names no scheme or one of the allowed ones."""

    def safe(link: Column) -> Column:
        scheme = F.lower(F.regexp_extract(link, SCHEME, 1))
        return F.coalesce((scheme == "") | scheme.isin(*ALLOWED_SCHEMES), F.lit(False))

    return let(_plain_link(value), safe)


def _keep_attribute(tag: Column, attribute: Column) -> Column:
    name = F.lower(F.regexp_extract(attribute, ATTRIBUTE, 1))
    value = F.regexp_replace(F.regexp_extract(attribute, ATTRIBUTE, 2), "^[\"']|[\"']$", "")
    listed = F.concat(tag, F.lit(" "), name).isin(*_allowed_pairs())
    return listed & (~name.isin(*LINK_ATTRIBUTES) | _safe_link(value))


def _token(token: Column) -> Column:
    def tag(name: Column) -> Column:
        attributes = F.filter(
            F.regexp_extract_all(token, F.lit(ATTRIBUTE), F.lit(0)),
            lambda a: _keep_attribute(name, a),
        )
        opening = F.concat(
            F.lit("<"),
            F.array_join(F.concat(F.array(name), attributes), " "),
            F.when(token.rlike(r"/\s*>$"), F.lit(" />")).otherwise(F.lit(">")),
        )
        return (
            F.when(~name.isin(*ALLOWED_TAGS), F.lit(""))
            .when(token.startswith("</"), F.concat(F.lit("</"), name, F.lit(">")))
            .otherwise(opening)
        )

    return (
        F.when(token.startswith("<!--"), F.lit(""))
        .when(token.rlike(TAG_NAME), let(F.lower(F.regexp_extract(token, TAG_NAME, 1)), tag))
        .otherwise(token)
    )


def safe_markup(c: Column) -> Column:
    """Drop tags and attributes outside the allow-list; text stays as it is."""

    def clean(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
        return F.when(
            text.contains("<"), F.array_join(F.transform(tokens, _token), "")
        ).otherwise(text)

    return let(c, clean)


def unsafe_links(c: Column) -> Column:
    """Replace Markdown link targets with other schemes by '#'; optional, off by default."""
    return F.regexp_replace(
        c, r"(?i)\]\(\s*(?!(?:http|https|mailto|tel):)[a-z][a-z0-9+.-]*:[^)]*\)", "](#)"
    )
