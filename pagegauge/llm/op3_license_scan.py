"""Operator 3: scan for licence texts by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, table

#: Public licence notices that texts are compared with. Callers may pass their own.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "proprietary": "All rights reserved.",
}
THRESHOLD = 0.8
WORDS = r"[\p{L}\p{Nd}]+"
#: Place of the whole text in the order of passages; windows come after it.
LAST = (1 << 31) - 2


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def best_window(templates: dict[str, str], threshold: float) -> Callable[[str], tuple[list[str], tuple[int, float, str] | None]]:
    """Finder of all names that a text's windows match, and of the best match (common bigrams, dice, name): a window
    begins with a bigram of the template and has as many words as the template, or those up to the end of the text.
    The best has most bigrams in common, then the highest coefficient, then the first name. Windows with fewer template
    bigrams than the size bound asks for aren't compared."""
    known = {n: (len(w) - 1, frozenset(template_bigrams(v))) for n, v in sorted(templates.items()) if len(w := template_words(v)) > 1}
    owners: dict[str, list[str]] = {}
    for name, (_, grams) in known.items():
        for g in grams:
            owners.setdefault(g, []).append(name)
    word = regex.compile(WORDS)

    def find(text: str) -> tuple[list[str], tuple[int, float, str] | None]:
        words = word.findall(text)
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        starts: dict[str, list[int]] = {}
        for i, g in enumerate(grams):
            for name in owners.get(g, ()):
                starts.setdefault(name, []).append(i)
        names, best = [], None
        for name in sorted(starts):
            length, own = known[name]
            at = np.asarray(starts[name])
            inside = np.searchsorted(at, at + length) - np.arange(len(at))
            for i in at[inside >= len(own) * threshold / (2 - threshold)].tolist():
                seen = set(grams[i : i + length])
                both = len(seen & own)
                dice = 2.0 * both / (len(seen) + len(own))
                if dice >= threshold:
                    if names[-1:] != [name]:
                        names.append(name)
                    if best is None or (both, dice) > best[:2]:
                        best = (both, dice, name)
        return names, best

    return find


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(words, i + 1))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_passages, license, dice, passage, licenses) for every row of ``docs(doc_id, text)``; no shuffle.

    Passages are the \\n-split lines (numbered from 0) and, for texts of several lines, the whole text (-1), and windows
    of the whole text's words, across lines (-3): notices wrapped over lines of a longer file or within a line of
    prose; see ``best_window``. A passage matches a template when twice their common distinct word bigrams reach ``threshold`` times the sum of their
    numbers. Templates whose number of bigrams rules that out are left out first, and passages that no template can
    match aren't compared. ``licenses`` has all names that match, sorted; the best match has most bigrams in common with
    its template, so a long notice goes before a phrase, then the highest coefficient, then is a line, the whole text
    or a window, of lines the first, then has the first name; without one, license is null, dice 0 and passage -2.
    n_passages counts lines and whole texts that match. Null and empty texts have no bigrams and match nothing; ids aren't looked at, so null and
    repeated ones keep a row each, and other columns are left out.
    """
    templates = TEMPLATES if templates is None else templates
    sets = {k: b for k, v in sorted(templates.items()) if (b := template_bigrams(v))}
    if not sets:
        raise ValueError("no template has two words")
    low = min(len(b) for b in sets.values()) * threshold / (2 - threshold)
    high = max(len(b) for b in sets.values()) * (2 - threshold) / threshold

    def against(passage: Column, grams: Column) -> Column:
        """Matches of one passage, best first by order of the structs."""
        n = F.size(grams)
        found = []
        for i, (name, b) in enumerate(sets.items()):
            fits = n.between(len(b) * threshold / (2 - threshold), len(b) * (2 - threshold) / threshold)
            both = F.size(F.array_intersect(grams, F.array(*map(F.lit, b))))
            dice = 2.0 * both / (n + len(b))
            found.append(F.when(fits, F.when(dice >= threshold, F.struct(both.alias("both"), dice.alias("dice"), (-F.when(passage < 0, LAST).otherwise(passage)).alias("place"), F.lit(-i).alias("rank"), F.lit(name).alias("name")))))
        return F.array_compact(F.array(*found))

    def of(passage: Column, words: Column) -> Column:
        return F.when(F.size(words) > low, let(_bigrams(words), lambda g: F.when(F.size(g).between(low, high), against(passage, g))))

    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    split = lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    by_line = F.transform(F.split(text, "\n"), lambda x, i: let(split(x), lambda w: of(i, w)))
    whole = F.when(text.contains("\n"), let(split(text), lambda w: of(F.lit(-1), w)))

    @F.pandas_udf("names array<string>, both int, dice double, name string")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = best_window(templates, threshold)
        for batch in batches:
            found = [find(x) if x else ([], None) for x in batch]
            best = [f[1] or (None, None, None) for f in found]
            yield pd.DataFrame({"names": [f[0] for f in found], "both": pd.Series([b[0] for b in best], dtype="Int32"), "dice": pd.Series([b[1] for b in best], dtype="float64"), "name": [b[2] for b in best]})

    full = lambda hits: F.filter(hits, lambda x: x.isNotNull() & (F.size(x) > 0))
    row = docs.select("doc_id", text.alias("t"), full(F.concat(by_line, F.array(whole))).alias("hits"))
    row = row.select("doc_id", F.size("hits").alias("n_passages"), F.flatten("hits").alias("hits"), windows("t").alias("window"))
    window = F.when(F.col("window.name").isNotNull(), F.array(F.struct("window.both", "window.dice", F.lit(-LAST - 1).alias("place"), F.lit(0).alias("rank"), F.col("window.name").alias("name"))))
    row = row.withColumn("best", F.array_max(F.concat("hits", F.coalesce(window, F.slice("hits", 1, 0)))))
    names = F.array_join(F.array_sort(F.array_distinct(F.concat("hits.name", F.coalesce("window.names", F.array().cast("array<string>"))))), ",")
    place = -F.col("best.place")
    place = F.when(place == LAST, -1).when(place == LAST + 1, -3).otherwise(F.coalesce(place, F.lit(-2)))
    return row.select("doc_id", "n_passages", F.col("best.name").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), place.cast("int").alias("passage"), names.alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_values() -> str:
    rows = []
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        grams = ", ".join(f"'{b}'" for b in template_bigrams(text))
        rows.append(f"({i}, '{name}', [{grams}], {len(template_words(text)) - 1})")
    return ", ".join(rows)


ORACLE = rf"""
WITH t(rank, name, b, n) AS (VALUES {_sql_values()}),
p AS (
  SELECT rid, unnest(l) AS x, unnest(range(len(l))) AS place FROM (SELECT rid, string_split(t, chr(10)) AS l FROM (SELECT row_number() OVER () AS rid, lower(coalesce(text, '')) AS t FROM documents))
  UNION ALL SELECT row_number() OVER () AS rid, lower(coalesce(text, '')), -1 FROM documents
), w AS (
  SELECT rid, place, regexp_extract_all(x, '{WORDS}') AS w FROM p WHERE place >= 0 OR contains(x, chr(10))
), g AS (
  SELECT rid, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1
), m AS (
  SELECT rid, place, rank, name, len(list_intersect(g, b)) AS common, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t
  WHERE len(g) BETWEEN len(b) * {THRESHOLD} / {2 - THRESHOLD} AND len(b) * {2 - THRESHOLD} / {THRESHOLD}
), best AS (
  SELECT rid, count(DISTINCT place) AS n FROM m WHERE dice >= {THRESHOLD} GROUP BY rid
), s AS (
  SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents) WHERE len(w) > 1
), h AS (
  SELECT DISTINCT rid, i, rank FROM (SELECT rid, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM s) JOIN (SELECT rank, unnest(b) AS x FROM t) USING (x)
), v AS (
  SELECT rid, i, rank, name, b, list_distinct(g[i:i + n - 1]) AS g FROM h JOIN s USING (rid) JOIN t USING (rank)
), every AS (
  SELECT rid, place, CASE WHEN place < 0 THEN {LAST} ELSE place END AS seat, rank, name, common, dice FROM m WHERE dice >= {THRESHOLD}
  UNION ALL
  SELECT rid, -3, {LAST + 1}, rank, name, common, 2.0::DOUBLE * common / (len(g) + len(b)) AS dice FROM (SELECT *, len(list_intersect(g, b)) AS common FROM v) WHERE 2.0::DOUBLE * common / (len(g) + len(b)) >= {THRESHOLD}
), named AS (
  SELECT rid, first(name ORDER BY common DESC, dice DESC, seat, rank) AS license, first(dice ORDER BY common DESC, dice DESC, seat, rank) AS dice,
    first(place ORDER BY common DESC, dice DESC, seat, rank) AS place, array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses
  FROM every GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_passages, license, coalesce(dice, 0) AS dice, CAST(coalesce(place, -2) AS INTEGER) AS passage, coalesce(licenses, '') AS licenses
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN best USING (rid) LEFT JOIN named USING (rid)
"""
