"""Pieces of DuckDB SQL shared by the oracle queries."""

from __future__ import annotations

from html.entities import name2codepoint


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def replace_all(expr: str, pattern: str, replacement: str) -> str:
    """``regexp_replace`` of every match; ``$n`` in the replacement becomes RE2's form."""
    for n in "123":
        replacement = replacement.replace(f"${n}", f"\\{n}")
    return f"regexp_replace({expr}, {q(re2(pattern))}, {q(replacement)}, 'g')"


def re2(pattern: str) -> str:
    """RE2 spelling of the flags that only Java knows."""
    return pattern.replace("(?md)", "(?m)")


def every(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({expr}, {q(re2(pattern))}, {group})"


def gaps(expr: str, pattern: str) -> str:
    return f"string_split_regex({expr}, {q(re2(pattern))})"


ENTITY_MAP = (
    "MAP {" + ", ".join(f"{q(n)}: {c}" for n, c in sorted(name2codepoint.items())) + "}"
)
ENTITY_TOKENS = r"(?s)&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"
WHITE = "E' \\t\\n\\r\\x0b'"


def _allowed(n: str) -> str:
    return (
        f"({n} IN (9, 10, 13) OR {n} BETWEEN 32 AND 126 OR {n} BETWEEN 160 AND 55295"
        f" OR {n} BETWEEN 57344 AND 1114111)"
    )


def decode(expr: str) -> str:
    """Entities in one pass: cut into tokens, look each one up."""
    number = r"regexp_extract(t, '^&#0*([0-9]{1,7});$', 1)"
    hexa = r"regexp_extract(t, '^&#[xX]0*([0-9a-fA-F]{1,6});$', 1)"
    named = f"({ENTITY_MAP})[substr(t, 2, length(t) - 2)]"
    code = (
        f"CASE WHEN {number} <> '' THEN CAST({number} AS INT)"
        f" WHEN {hexa} <> '' THEN CAST(('0x' || {hexa}) AS INT) ELSE {named} END"
    )
    one = (
        f"CASE WHEN t[1] = '&' AND length(t) > 1 THEN list_transform([{code}],"
        f" lambda n: CASE WHEN {_allowed('n')} THEN chr(n) ELSE t END)[1] ELSE t END"
    )
    return (
        f"array_to_string(list_transform(regexp_extract_all({expr}, {q(ENTITY_TOKENS)}),"
        f" lambda t: {one}), '')"
    )


def strip(expr: str) -> str:
    out = replace_all(expr, r"(?is)<script[^>]*>.*?</script>", "")
    out = replace_all(out, r"(?is)<style[^>]*>.*?</style>", "")
    return replace_all(out, r"(?s)<(?:[^\s>][^>]*)?(?:>|\z)", "")


def trim(expr: str) -> str:
    return f"trim({expr}, {WHITE})"


def clean(expr: str) -> str:
    return trim(replace_all(decode(strip(expr)), r"[\s\p{Z}\x0b\x{85}\x{180e}]+", " "))


def cut(expr: str, length: int) -> str:
    """Word-safe truncation of ``expr``, which should be a plain column or variable."""
    head = f"substr({expr}, 1, {length})"
    rev = f"instr(reverse({head}), ' ')"
    last = f"({length} - {rev})"
    return (
        f"CASE WHEN length({expr}) > {length} THEN"
        f" CASE WHEN {rev} > 0 AND {last} > 0.8 * {length}"
        f" THEN substr({expr}, 1, {last}) ELSE {head} END || '...' ELSE {expr} END"
    )


def nonempty(expr: str) -> str:
    return f"({expr} IS NOT NULL AND {expr} <> '' AND {expr} <> '0')"


def lines(*parts: str) -> str:
    """Join with newlines, nulls vanish."""
    return f"concat_ws(E'\\n', {', '.join(parts)})"


def chain(name: str, keep: str, column: str, source: str, steps: list[str]) -> str:
    """CTEs that apply ``steps`` (expressions over ``h``) one after another; ends in ``name``."""
    out = [f"{name}_0 AS (SELECT {keep}, {column} AS h FROM {source})"]
    for i, step in enumerate(steps):
        last = name if i == len(steps) - 1 else f"{name}_{i + 1}"
        out.append(f"{last} AS (SELECT {keep}, {step} AS h FROM {name}_{i})")
    return ",\n".join(out)


def block(pattern: str, render: str, group: int = 1) -> str:
    """Replace each match over ``h`` by ``render``, an expression over the match ``b``."""
    made = f"list_transform({every('h', pattern, group)}, lambda b: {render})"
    return (
        f"array_to_string(list_transform(list_zip({gaps('h', pattern)}, {made}),"
        f" lambda z: z[1] || coalesce(z[2], '')), '')"
    )
