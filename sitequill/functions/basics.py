"""Small building blocks shared by the text and HTML functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Catalyst repeats an expression that a column function mentions twice; a one-element
    array with ``transform`` gives it a name instead, so a long regex chain runs once.
    """
    # `get` works its type out anew for every row, from the whole body; `element_at` does so once.
    return F.element_at(F.transform(F.array(value), body), 1)


def nonempty(c: Column) -> Column:
    """The data model's idea of "present": not null, not '' and not '0'."""
    return c.isNotNull() & (c != "") & (c != "0")


def fallback(first: Column, second: Column) -> Column:
    return F.when(nonempty(first), first).otherwise(F.coalesce(second, F.lit("")))


def keep_lines(*lines: Column) -> Column:
    """Join lines with newlines; a null line disappears."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def block_replace(
    c: Column,
    pattern: str,
    render: Callable[[Column], Column],
    guard: Column | None = None,
    group: int = 1,
) -> Column:
    """Replace every match of ``pattern`` by ``render(match group)``.

    ``split`` gives the text between the matches and ``regexp_extract_all`` the matches, so
    both lists line up. Where ``guard`` is false the text stays as it is, unscanned.
    """

    def rebuild(text: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        made = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), render)
        joined = F.zip_with(gaps, made, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))))
        rebuilt = F.array_join(joined, "")
        return rebuilt if guard is None else F.when(guard, rebuilt).otherwise(text)

    return let(c, rebuild)
