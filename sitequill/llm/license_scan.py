"""License scan: exact containment join of text blocks with license templates.

A template is a set of words, a block a window of consecutive words. A block meets a template
if it contains the template's threshold share of words. Words of templates are ordered by their
frequency in the whole corpus, rarest first. A template with least overlap o has a prefix of
|T| - o + 1 words, of which each block that meets it holds one, so only blocks around prefix
words are looked at (prefix filter), if they are long enough (length filter) and enough words
of the template can still follow (positional filter); the rest is compared exactly.

Windows are twice as long as the template and overlap by half, so any stretch of its length lies
in one. Templates are a small table of fixed size, so their index goes to the scan by broadcast
and no text is shuffled. Templates that are phrases also need their words one after another.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A license text; `phrase` asks for its words in a row, `share` for that part of its words."""

    label: str
    text: str
    share: float = 1.0
    phrase: bool = False


#: Phrases that name a license.
PHRASES = (
    Template("mit", "mit license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("gpl", "general public license", phrase=True),
)
#: Usual notices, and the main paragraphs of well-known licenses.
NOTICES = (
    Template("all-rights-reserved", "All rights reserved"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc0", "Creative Commons Zero public domain dedication"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("mpl", "Mozilla Public License version 2.0"),
    Template("bsd", "Released under the BSD License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        0.8,
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer",
        0.8,
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        0.8,
    ),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        0.8,
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        0.8,
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software",
        0.8,
    ),
)

#: A-Z to lower case, bytes that end words to blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def overlap(ordered: list[bytes], own: set[bytes], least: int) -> int:
    """How many of the words are in a block, rarest first; 0 as soon as too few can follow.

    Positional filter: at a place, the words found before it and those from it on bound the count.
    """
    if len(own) < least:
        return 0
    spare = len(ordered) - least
    for word in ordered:
        if word not in own:
            spare -= 1
            if spare < 0:
                return 0
    return least + spare


class Index:
    """Templates with their words in rare-first order, and the prefix words that lead to them."""

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int]) -> None:
        self.templates = templates
        self.words = [words_of(t.text.encode()) for t in templates]
        self.ordered = [sorted(set(w), key=lambda x: (frequency.get(x, 0), x)) for w in self.words]
        self.least = [max(1, -(-len(o) * round(1000 * t.share) // 1000)) for o, t in zip(self.ordered, templates, strict=True)]
        self.stride = [max(4, len(w)) for w in self.words]
        self.prefix: dict[bytes, list[int]] = defaultdict(list)
        for i, own in enumerate(self.ordered):
            for word in own[: len(own) - self.least[i] + 1]:
                self.prefix[word].append(i)

    def matches(self, words: list[bytes]) -> list[tuple]:
        """(template, first word, end, containment) of each block, and of each phrase's place."""
        prefix, found, seen = self.prefix, {}, set()
        for at, word in enumerate(words):
            if word not in prefix:
                continue
            for i in prefix[word]:
                stride, least = self.stride[i], self.least[i]
                for block in (at // stride - 1, at // stride):
                    start, end = block * stride, min(len(words), (block + 2) * stride)
                    if block < 0 or (i, block) in seen or end - start < least:
                        continue
                    seen.add((i, block))
                    own = set(words[start:end])
                    share = overlap(self.ordered[i], own, least)
                    if share < least:
                        continue
                    if not self.templates[i].phrase:
                        found[i, start] = (i, start, end, share / len(self.ordered[i]))
                        continue
                    phrase = self.words[i]
                    for s in range(start, end - len(phrase) + 1):
                        if words[s : s + len(phrase)] == phrase:
                            found[i, s] = (i, s, s + len(phrase), 1.0)
        return [found[k] for k in sorted(found)]


def _counted(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = vocabulary.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(filter(wanted.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    return run


_FOUND = "array<struct<label: string, phrase: boolean, first_word: long, end: long, containment: double>>"


def _scanned(index):
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                found.append([
                    {"label": index.templates[i].label, "phrase": index.templates[i].phrase, "first_word": a, "end": b, "containment": c}
                    for i, a, b, c in index.matches(words)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "matches"]
            )

    return run


def license_blocks(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES)) -> DataFrame:
    """Per document: doc_id, n_words, matches (label, phrase, first_word, end, containment).

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, counted from
    0 over the whole text. A null text is empty. A template without words matches nothing.
    Repeated rows are scanned alike; other columns are ignored; an empty table gives no rows.
    Templates are given by the caller and small.
    """
    templates = [t for t in templates if words_of(t.text.encode())]
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))
    counts = texts.select("text").mapInArrow(_counted(context.broadcast(vocabulary)), "word binary, n long")
    frequency = {bytes(r.word): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    index = Index(templates, frequency)
    return texts.mapInArrow(_scanned(index), f"doc_id long, n_words long, matches {_FOUND}")


def license_columns(docs: DataFrame) -> DataFrame:
    """Per document: base phrases with their places, all labels, and the best containment."""
    base = F.filter("matches", lambda m: m.phrase)
    labels = lambda rows: F.array_join(F.sort_array(F.array_distinct(F.transform(rows, lambda m: m.label))), ",")
    starts = F.transform(base, lambda m: m.first_word)
    return license_blocks(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.containment)), F.lit(0.0)).alias("score"),
    )
