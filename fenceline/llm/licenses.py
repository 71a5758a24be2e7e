"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text's units are the whole text, each of its lines, and runs of consecutive lines. A unit is normalised (lower case, runs of
anything but letters and digits are one space) and compared with every template by 2 |A & B| / (|A| + |B|) over the sets of their word bigrams.
A coefficient of t or more needs |A| between t / (2 - t) and (2 - t) / t times |B|, and at least t / (2 - t) of the template's bigrams:
a template of which the text holds fewer is compared with none of its units.

Runs find texts that are wrapped or embedded: a run begins and ends with a line that has words, may hold blank ones, so paragraphs
are runs, and has at most (2 - t) / t times the words of the template. Of a template's runs those count that score more than the whole text
and than every matching line in them, and overlap no better run; of equal ones the shorter, then the earlier is better. Borders of units are
borders of lines.

Rows are scanned one by one in Python workers; nothing is shuffled. The templates are a parameter and travel with the function.
Nulls, empty texts and units of less than two words match nothing. Repeated rows are scanned one by one. Of equal coefficients the
first template by name, then the first unit is the best.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
OTHER = r"[^\p{L}\p{N}]+"

# Wordings of public licences and of their notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
}


# Whole published licences and the headers that they recommend, by the names of their files.
PUBLISHED = {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
WORD = re.compile(r"[^\W_]+")


def bigrams_of(template: str) -> list[str]:
    words = re.findall(r"[^\W_]+", template.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


class Template(NamedTuple):
    name: str
    bigrams: frozenset[tuple[str, str]]
    need: float  # the fewest of its bigrams in a match
    most: float  # the most bigrams of a match
    words: float  # the most words of a run


def prepared(templates: dict[str, str], threshold: float) -> list[Template]:
    found = []
    for name, t in sorted(templates.items()):
        words = WORD.findall(t.lower())
        own = frozenset(pairwise(words))
        if own:
            # A little room for rounding: scores decide.
            less, more = threshold / (2 - threshold) - 1e-12, (2 - threshold) / threshold + 1e-12
            found.append(Template(name, own, len(own) * less, len(own) * more, len(words) * more))
    return found


def runs(t: Template, words: list[list[str]], floor: float) -> list[tuple[float, int, int]]:
    """Score, first and last line of each run of at least two lines with words, but not all of them, that scores ``floor`` or more.

    A run that begins or ends with a line which adds no bigram of the template is left out: without that line it scores no less.
    """
    lines = [k for k, w in enumerate(words) if w]
    flat = list(chain.from_iterable(words))
    pairs = list(pairwise(flat))
    at = [0, *accumulate(len(words[k]) for k in lines)]
    # Bigrams of the template that start before each word.
    before = [0, *accumulate(p in t.bigrams for p in pairs)]
    before.append(before[-1])
    found = []
    for i in range(len(lines) - 1):
        start = at[i]
        if before[at[i + 1]] == before[start] or before[min(len(pairs), start + int(t.words))] - before[start] < t.need:
            continue
        seen: set[tuple[str, str]] = set()
        common, p = 0, start
        for j in range(i, len(lines)):
            end = at[j + 1]
            if end - start > t.words:
                break
            had = common
            for pair in pairs[p : end - 1]:
                if pair not in seen:
                    seen.add(pair)
                    common += pair in t.bigrams
            p = end - 1
            if len(seen) > t.most:
                break
            if j > i and common > had and common >= t.need and (i, j) != (0, len(lines) - 1):
                score = 2.0 * common / (len(seen) + len(t.bigrams))
                if score >= floor:
                    found.append((score, lines[i], lines[j]))
    return found


def matches(text: str, templates: list[Template], every: frozenset[tuple[str, str]], threshold: float) -> list[tuple[float, str, int]]:
    """(-score, license, unit) of each match."""
    words = [WORD.findall(line) for line in text.lower().split("\n")]
    flat = list(chain.from_iterable(words))
    held = every.intersection(pairwise(flat))
    near = [t for t in templates if len(held) >= t.need and len(held & t.bigrams) >= t.need]
    if not near:
        return []
    units = [set(pairwise(flat)), *([set(pairwise(w)) for w in words] if len(words) > 1 else [])]
    found = []
    for t in near:
        own = {}
        for unit, bigrams in enumerate(units):
            if t.need <= len(bigrams) <= t.most:
                score = 2.0 * len(bigrams & t.bigrams) / (len(bigrams) + len(t.bigrams))
                if score >= threshold:
                    own[unit] = score
        found += [(-score, t.name, unit) for unit, score in own.items()]
        taken: list[tuple[int, int]] = []  # disjoint, in order
        whole, single = own.pop(0, 0.0), sorted(own)
        for score, first, last in sorted(runs(t, words, threshold), key=lambda r: (-r[0], r[2] - r[1], r[1])):
            k = bisect_right(taken, (first, last))
            clear = (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last)
            inside = single[bisect_right(single, first) : bisect_right(single, last + 1)]
            if clear and score > whole and all(score > own[u] for u in inside):
                taken.insert(k, (first, last))
                found.append((-score, t.name, first + 1))
    return found


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (its ``doc_id``) and, per row, ``license``, ``score`` and ``unit`` of the best match (nulls
    without one; unit 0 is the whole text, n the n-th line or the run that begins there), ``n_matches`` and the ``licenses`` that match.
    ``templates`` are ``TEMPLATES`` and ``PUBLISHED`` if not given."""
    known = prepared(TEMPLATES | PUBLISHED if templates is None else templates, threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = frozenset().union(*(t.bigrams for t in known))
        for batch in batches:
            found = [matches(t.as_py() or "", known, every, threshold) for t in batch.column(batch.num_columns - 1)]
            best = [min(m, default=None) for m in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([b and b[1] for b in best], pa.string()),
                    pa.array([b and -b[0] for b in best], pa.float64()),
                    pa.array([b and b[2] for b in best], pa.int32()),
                    pa.array(map(len, found), pa.int64()),
                    pa.array([",".join(sorted({m[1] for m in f})) for f in found], pa.string()),
                ],
                names=[*batch.schema.names[:-1], "license", "score", "unit", "n_matches", "licenses"],
            )

    own = docs.select(*[docs[f"`{c}`"] for c in keep or ["doc_id"]], docs[f"`{text}`"].alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(scan, f"{kept}, license string, score double, unit int, n_matches long, licenses string")
