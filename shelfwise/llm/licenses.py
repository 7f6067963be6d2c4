"""Licence notices: a classifier of passages whose findings are confirmed by comparing templates.

Lines between lines without words are a block, and a notice may be wrapped over its lines.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.linear import Rows, fit_logistic, sigmoid

#: Paragraphs of the corpus that show the classifier ordinary text, the least by a seeded hash, and the
#: words of each that it looks at. Scanning has no such limits.
SAMPLE_PARAGRAPHS = 4000
SAMPLE_WORDS = 400
PENALTY = 2e-4
FOLDS = 4
CONFIRMED = 0.6
UNKNOWN = "unknown"
#: Words on either side of a notice, in its own lines, that belong to it and are no notice of their own.
BESIDE = 12
#: Words around notices that are none themselves.
AROUND = ["copyright", "the", "authors"], ["see", "the", "file", "for", "details"]

#: Customary notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT license.",
        "This project is MIT licensed.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 3 of the License.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, version 3 of the License.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the public "
        "domain under CC0 1.0 Universal.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
             "to alter it and redistribute it freely, subject to the following restrictions:"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Notices of families that are not told apart: they show the model what a notice of no listed family looks like.
UNLISTED: dict[str, list[str]] = {
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or later."],
    "Artistic-2.0": ["You may redistribute and modify it under the terms of the Artistic License 2.0."],
    "WTFPL": ["This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You "
              "Want To Public License, Version 2."],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License."],
    "MS-PL": ["This source is subject to the Microsoft Public License."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "PSF": ["Licensed to PSF under a Contributor Agreement."],
    "ODbL-1.0": ["This database is made available under the Open Database License."],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
             "Documentation License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "Proprietary": ["This software is proprietary and may not be copied, distributed or modified without the written "
                    "permission of the copyright holder."],
}

#: Ordinary sentences with the words of licences: they show the model that words alone are no notice.
ORDINARY = [
    "Her fishing licence expired last spring and the permission to use the boat was never granted.",
    "The city council granted the company a license to sell food in the park.",
    "He lost his driver license and had to apply for a new copy at the office.",
    "Under the terms of the agreement the public shares were sold without any further notice.",
    "The general public was asked to use the other entrance during the work.",
    "The software is available to students free of charge until the end of the year.",
    "The court found that the copyright of the song belonged to the author and not to the publisher.",
    "The version of the report distributed to the members was modified without permission.",
    "A license fee has to be paid for every television set in the house.",
    "The foundation published two books about free trade and general rights of the public.",
    "You may use the kitchen subject to the following conditions, which the landlord has written down.",
    "The minister said that the license of the station would be revoked in the public interest.",
    "They obtained a copy of the contract and the terms were not what they had been promised.",
    "The apache helicopter flew over the old mission, and the pilot had a license for both.",
    "Students at MIT released a new version of their software for public use.",
    "The creative commons of the village was open to everyone who worked there.",
    "The company licensed the patent to a rival and distributed the rights among its owners.",
    "All conditions of the sale were met and the source of the money was public.",
    "She was granted permission to redistribute the food that the hotel had left.",
    "The library lent the old books to the school under the same terms as before.",
    "Drivers without a valid license were stopped by the police, and two licenses were taken away.",
    "The program of the concert was free, and the license to record it had been given to the radio.",
    "It was the second license that the bank had asked for under the new law.",
    "The pilot had no license, and the plane had been modified without the permission of the owner.",
    "The work is granted to whoever asks for it first, the mayor said.",
    "No charge was made for the use of the file room, provided that notice was given.",
]

#: Words that tell families with like notices apart, by what they stand for.
MARKS = {
    "sa": "sa", "sharealike": "sa", "nc": "nc", "noncommercial": "nc", "nd": "nd", "noderivatives": "nd",
    "noderivs": "nd", "lesser": "lesser", "affero": "affero",
}
_NUMBER = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")

#: A line that names licences by their identifiers, and what follows an identifier of a version or exception.
_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n*/]+)")
_EXCEPTION = re.compile(r"\bWITH\s+\S+")
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9.-]*[A-Za-z0-9]")
_LATER = re.compile(r"-(only|or-later)$")

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(words: list[str]) -> set[str]:
    """Different words and pairs of neighbours."""
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def blocks(text: str | None) -> Iterator[tuple[list[str], list[int]]]:
    """The words of each run of lines that have words, and the number of the line each word is in."""
    words, lines = [], []
    for i, line in enumerate((text or "").split("\n")):
        new = words_of(line)
        if words and not new:
            yield words, lines
            words, lines = [], []
        words += new
        lines += [i] * len(new)
    if words:
        yield words, lines


def tagged(line: str, families: list[str]) -> list[str]:
    """The families whose identifiers a line with a licence tag names, an unknown one for those not listed."""
    tag = _TAG.search(line)
    names = _IDENTIFIER.findall(_EXCEPTION.sub(" ", tag[1])) if tag else []
    plain = [_LATER.sub("", n) for n in names if n not in ("AND", "OR", "WITH")]
    return list(dict.fromkeys(n if n in families else UNKNOWN for n in plain))


def _triples(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}


def resemblance(words: list[str], template: set[tuple[str, ...]]) -> float:
    """Share of a template's word triples that a paragraph has."""
    return len(_triples(words) & template) / len(template)


def marks_of(words: list[str]) -> set[str]:
    """The words that tell families with like notices apart."""
    library = {"lesser"} if ("gnu", "library") in zip(words, words[1:], strict=False) else set()
    return library | {MARKS[w] for w in words if w in MARKS}


def versions_of(words: list[str]) -> set[str]:
    """Version numbers, without zeros at their end."""
    return {m[1] for m in map(_NUMBER.fullmatch, words) if m}


def _variants(template: str) -> list[list[str]]:
    """A notice as it stands, with words before and after it, and without its first or last word."""
    words = words_of(template)
    before, after = AROUND
    return [words, before + words, words + after, before + words + after, words[1:], words[:-1]]


@dataclass(frozen=True)
class Classifier:
    """The weights of words and pairs and an intercept for each family and, last, for notices of any licence.

    The scale turns the last one's score into the probability that a passage is a notice, and what has less
    than ``threshold`` is none. Both are set by notices of families that the model had not seen.
    """

    families: list[str]
    weights: dict[str, dict[int, float]]
    intercepts: list[float]
    slope: float
    shift: float
    threshold: float

    def hits(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Start, end and name of the words and pairs that have weights, in order."""
        found = [(i, i + 1, w) for i, w in enumerate(words) if w in self.weights]
        pairs = map(" ".join, zip(words, words[1:], strict=False))
        return sorted(found + [(i, i + 2, p) for i, p in enumerate(pairs) if p in self.weights])

    def best(self, names: set[str]) -> tuple[int, float]:
        """The likeliest family of a passage with these words and pairs, and the probability that it is a notice."""
        last = len(self.families)
        sums = [0.0] * (last + 1)
        for f in names & self.weights.keys():
            for k, x in self.weights[f].items():
                sums[k] += x
        if sums[last] <= 0:  # nothing speaks for a notice
            return 0, 0.0
        k = max(range(last), key=lambda i: (sums[i] + self.intercepts[i], -i), default=0)
        return k, float(sigmoid(np.array(self.slope * (sums[last] + self.intercepts[last]) + self.shift)))


class Comparison:
    """Finds the passages that have ``confirmed`` of a template's word triples, its marks and its version."""

    def __init__(self, families: list[str], templates: dict[str, list[str]], confirmed: float) -> None:
        self.confirmed, self.longest = confirmed, 1
        self.triples = [[_triples(words_of(t)) for t in templates[f]] for f in families]
        self.of: list[int] = []
        self.sizes: list[int] = []
        self.reach: list[int] = []
        self.words: list[list[str]] = []
        self.starts: dict[int, dict[str, set[str]]] = {}
        self.index: dict[int, dict[str, list[int]]] = {}
        for k, family in enumerate(families):
            for words in map(words_of, templates[family]):
                grams = _triples(words)
                for g in grams:
                    self.starts.setdefault(len(g), {}).setdefault(g[0], set()).update(g[1:2])
                    self.index.setdefault(len(g), {}).setdefault(" ".join(g), []).append(len(self.of))
                self.of.append(k)
                self.words.append(words)
                self.sizes.append(len(grams))
                self.reach.append(len(words) + len(words) // 2)
                self.longest = max(self.longest, len(words))

    def likeness(self, words: list[str], family: int) -> float:
        """The largest share of triples of a family's templates that the words have."""
        return max(resemblance(words, t) for t in self.triples[family])

    def agrees(self, t: int, words: list[str], a: int, b: int) -> bool:
        """Whether a passage has the template's marks and version and no others.

        Where the template goes on before or after the passage, so does the part that is looked at.
        """
        template = self.words[t]
        if words[a] != template[0]:
            a = max(0, a - 1 - template.index(words[a]))
        if words[b - 1] != template[-1]:
            b += 3 + template[::-1].index(words[b - 1])
        own, versions = words[a:b], versions_of(template)
        return marks_of(own) == marks_of(template) and (not versions or versions_of(own) == versions)

    def passages(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """Share of the triples, start, end and family of the passages that are like a template, the most like first."""
        places: dict[int, list[tuple[int, int, str]]] = {}
        for size, index in self.index.items():
            starts = self.starts[size]
            for i, w in enumerate(words):
                # Few pairs of neighbours begin a triple; only those are joined.
                if w in starts and (size == 1 or i + size <= len(words) and words[i + 1] in starts[w]):
                    gram = " ".join(words[i:i + size])
                    for t in index.get(gram, ()):
                        places.setdefault(t, []).append((i, i + size, gram))
        found = []
        for t, at in places.items():
            if len(at) < self.confirmed * self.sizes[t]:
                continue
            inside: Counter[str] = Counter()
            first = 0
            for _, end, gram in at:
                inside[gram] += 1
                # What is too far back, or comes again later, does not belong to the passage.
                while at[first][0] < end - self.reach[t] or inside[at[first][2]] > 1:
                    inside[at[first][2]] -= 1
                    if not inside[at[first][2]]:
                        del inside[at[first][2]]
                    first += 1
                share = len(inside) / self.sizes[t]
                if share >= self.confirmed and self.agrees(t, words, at[first][0], end):
                    found.append((share, at[first][0], end, self.of[t]))
        return sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3]))


def _fit(templates: dict[str, list[str]], unlisted: dict[str, list[str]], folds: int, penalty: float):
    families = sorted(templates)

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        notices = [templates[f] for f in families] + [unlisted[f] for f in sorted(unlisted)]
        known = [_triples(words_of(t)) for ts in notices for t in ts]
        rows, of, fold = [], [], []
        # Whole families are left out of a fold, so that no score is one of a near copy.
        for k, ts in enumerate(notices):
            for words in (v for t in ts for v in _variants(t)):
                rows.append(features_of(words))
                of.append(k)
                fold.append(k % folds)
        ordinary = [words_of(text)[:SAMPLE_WORDS] for text in sorted(sample["paragraph"].dropna())]
        prose = [(i, v) for i, t in enumerate(ORDINARY) for v in _variants(t)]
        for i, words in [*enumerate(AROUND), *prose, *enumerate(ordinary)]:
            if words and max(resemblance(words, t) for t in known) < 0.3:
                rows.append(features_of(words))
                of.append(-1)
                fold.append(i % folds)
        often = Counter(f for r in rows for f in r)
        vocabulary = sorted({f for r, k in zip(rows, of, strict=True) if k >= 0 for f in r} | {f for f, n in often.items() if n >= 3})
        place = {f: i for i, f in enumerate(vocabulary)}
        sparse = Rows([sorted(place[f] for f in r if f in place) for r in rows], len(vocabulary))
        of, fold, none = np.array(of), np.array(fold), np.zeros((len(rows), 0))
        out = []
        notice = (of >= 0).astype(float)
        for k, wanted in enumerate([*((of == k).astype(float) for k in range(len(families))), notice]):
            w, _, b = fit_logistic(sparse, none, wanted, penalty)
            out += [(k, "word", vocabulary[i], w[i]) for i in np.flatnonzero(w)]
            out.append((k, "intercept", "", b))
        unseen = np.zeros(len(rows))
        for j in range(folds):
            own = fold == j
            w, _, b = fit_logistic(sparse.take(~own), none[~own], notice[~own], penalty)
            unseen[own] = sparse.take(own).dot(w) + b
        # Platt's scale on scores of unseen families and rows.
        _, slope, shift = fit_logistic(Rows([[]] * len(rows), 1), unseen[:, None], notice, 0.0, 500)
        # The threshold with the best F1 on them, halfway to the next score below, but notices are likelier than not.
        order = np.argsort(-unseen, kind="stable")
        right = np.cumsum(notice[order])
        f1 = 2 * right / (np.arange(1, len(rows) + 1) + notice.sum())
        f1[:-1][unseen[order][:-1] == unseen[order][1:]] = -1
        best = int(np.argmax(f1))
        edges = sigmoid(slope[0] * unseen[order][best:best + 2] + shift)
        out += [(0, "slope", "", float(slope[0])), (0, "shift", "", shift), (0, "threshold", "", max(0.5, float(edges.mean())))]
        return pd.DataFrame(out, columns=["family", "kind", "name", "value"])

    return fit


def fit_classifier(documents: DataFrame, templates: dict[str, list[str]] = TEMPLATES,
                   sample_paragraphs: int = SAMPLE_PARAGRAPHS, folds: int = FOLDS,
                   penalty: float = PENALTY, unlisted: dict[str, list[str]] = UNLISTED) -> Classifier:
    """One logistic regression for each family and one for all notices, on notices and a bounded sample of ordinary paragraphs.

    The sample, one paragraph each of the documents with the least hash, leaves out what resembles a
    notice. The scores of families left out of the fit, and of unseen paragraphs, calibrate the probability of
    a notice and set the threshold. Fitted in one task, whose rows are bounded.
    """
    lines = F.split("text", "\n")
    draw = F.xxhash64(F.lit(3), "doc_id", "text")
    drawn = documents.filter(F.length("text") > 0).select(draw.alias("draw"), lines.alias("lines"))
    # A bound that twice as many hashes as wanted lie below: tasks send few paragraphs more than are used.
    texts = documents.filter(F.length("text") > 0).count()
    if texts > 4 * sample_paragraphs:
        drawn = drawn.filter(F.col("draw") < -(1 << 63) + (1 << 64) * 2 * sample_paragraphs // texts)
    # Any of the lines: first ones alone are no sample of all.
    sample = drawn.select(
        "draw", F.element_at("lines", (F.pmod(F.xxhash64("draw"), F.size("lines")) + 1).cast("int")).alias("paragraph"),
    ).orderBy("draw").limit(sample_paragraphs).select("paragraph")
    # A group of its own, so that there is a model without any paragraph too.
    spark = documents.sparkSession
    rows = sample.union(spark.createDataFrame([(None,)], "paragraph string")).groupBy().applyInPandas(
        _fit(templates, unlisted, folds, penalty), "family int, kind string, name string, value double"
    ).collect()  # at most the words and pairs of the notices and the sample
    families = sorted(templates)
    intercepts = [0.0] * (len(families) + 1)
    numbers: dict[str, float] = {}
    weights: dict[str, dict[int, float]] = {}
    for r in rows:
        if r["kind"] == "word":
            weights.setdefault(r["name"], {})[r["family"]] = r["value"]
        elif r["kind"] == "intercept":
            intercepts[r["family"]] = r["value"]
        else:
            numbers[r["kind"]] = r["value"]
    return Classifier(families, weights, intercepts, numbers["slope"], numbers["shift"], numbers["threshold"])


def find_notices(text: str | None, classifier: Classifier, comparison: Comparison, least: float) -> list[dict]:
    """Place, family, probability and resemblance of each notice of a text.

    The place is the line a notice begins in, for an unknown one the line of the word that says most.
    """
    found = []
    tags: dict[int, list[str]] = {}
    if text and "SPDX-License-Identifier:" in text:
        tags = {i: f for i, line in enumerate(text.split("\n")) if (f := tagged(line, classifier.families))}
        found += [{"place": i, "family": f, "probability": 1.0, "resemblance": 1.0} for i, fs in tags.items() for f in fs]
    for words, lines in blocks(text):
        hits = classifier.hits(words)
        if not hits:
            continue
        starts = [h[0] for h in hits]
        taken = bytearray(i in tags for i in lines) if tags else bytearray(len(words))

        def judge(a: int, b: int, hits=hits, starts=starts, taken=taken) -> tuple[int, float]:
            own = hits[bisect_left(starts, a):bisect_left(starts, b)]
            return classifier.best({f for i, j, f in own if j <= b and not any(taken[i:j])})

        def note(a: int, b: int, place: int, family: str, p: float, like: float, taken=taken, lines=lines) -> None:
            taken[a:b] = b"\1" * (b - a)
            found.append({"place": lines[place], "family": family, "probability": p, "resemblance": like})

        for like, a, b, family in comparison.passages(words):
            if not any(taken[a:b]):
                k, p = judge(a, b)
                if k == family and p >= least:
                    note(a, b, a, classifier.families[k], p, like)
        # The words beside a confirmed notice, in its lines, are part of it.
        for a in [i for i in range(len(words)) if taken[i] and not (i and taken[i - 1])]:
            b = a
            while b < len(words) and taken[b]:
                b += 1
            left = max(a - BESIDE, bisect_left(lines, lines[a]))
            right = min(b + BESIDE, bisect_right(lines, lines[b - 1]))
            taken[left:right] = b"\1" * (right - left)
        # What else is probably a notice is of no listed family: windows that hold the longest notice
        # whole, wherever it begins, then single lines.
        step = comparison.longest
        windows = [(a, min(a + 2 * step, len(words))) for a in range(0, max(1, len(words) - step), step)]
        edges = [0, *(i for i in range(1, len(words)) if lines[i] != lines[i - 1]), len(words)]
        for units in (windows, list(zip(edges, edges[1:], strict=False))):
            likely = [(p, k, a, b) for a, b in units for k, p in [judge(a, b)] if p >= least]
            for _, _, a, b in sorted(likely, key=lambda x: (-x[0], x[2])):
                k, p = judge(a, b)
                if p >= least:
                    own = [h for h in hits[bisect_left(starts, a):bisect_left(starts, b)]
                           if h[1] <= b and not any(taken[h[0]:h[1]])]
                    last = len(classifier.families)
                    place = max(own, key=lambda h: (classifier.weights[h[2]].get(last, 0.0), -h[0]))[0]
                    like = comparison.likeness(words[a:b], k)
                    note(a, b, place, UNKNOWN, p, like)
    return sorted(found, key=lambda n: n["place"])


def scan_licenses(documents: DataFrame, classifier: Classifier, templates: dict[str, list[str]] = TEMPLATES,
                  least: float | None = None, confirmed: float = CONFIRMED) -> DataFrame:
    """``doc_id`` and ``notices`` of every row: place, family, probability and resemblance of each notice.

    Every block of every text is read, joined over its lines. A passage that is a notice by the classifier, likeliest
    of a family, and has ``confirmed`` of the word triples of one of its templates and the same marks and version is
    that family's; of passages that overlap, the one most like its template. What is a notice otherwise, in
    windows or lines of the block, is one of an ``unknown`` licence; up to ``BESIDE`` words beside a named notice, in its lines, are
    part of it. A line with an ``SPDX-License-Identifier`` tag is read by its identifiers, with probability and resemblance 1.
    All else is no notice: ``least`` is the least probability of one, by default the classifier's threshold. A NULL or empty text
    has none; repeated rows are each scanned, an empty table gives none, and columns but id and text are not read.
    """
    least = classifier.threshold if least is None else least
    comparison = Comparison(classifier.families, templates, confirmed)
    kind = documents.schema["doc_id"].dataType.simpleString()
    notice = pa.struct([("place", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("resemblance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_notices(t.as_py(), classifier, comparison, least) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(notice))], names=["doc_id", "notices"]
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, notices array<struct<place:int,family:string,probability:double,resemblance:double>>"
    )
