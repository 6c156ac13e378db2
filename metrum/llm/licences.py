"""License scans: headers and licence files against templates by sparse TF-IDF cosine, then inheritance by path.

A file's candidates are the lines that speak of a licence: of a licence file all, of any other file those that hold
one of the cue words or enough words of a template. Further ones are windows of a template's length over the words of
the whole text, wherever these hold enough of its words, as notices are wrapped or stand amid other text. Words are weighed by how rare they are among the candidates of the whole corpus and the
templates. A file's licence is the template of the greatest cosine, if that reaches the threshold; of equals
the longest, and none whose text is a part of another licence's that is found as well. A file without one
takes the licence of the nearest directory above it that has a licence file; its directories are joined by path.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import durable, table
from metrum.llm.text import map_arrow

THRESHOLD = 0.6
CUE = re.compile(r"licen[cs]e|copyright|public domain|all rights reserved|spdx", re.IGNORECASE)
#: Words that tell nothing of a template, as they are in any text.
PLAIN = frozenset("a all and any are as at be but by for from in into is it its may no not of on or provided such that the this to under use we with without work you".split())
MARK = re.compile(r"^\s*(?:rem|dnl)\s", re.IGNORECASE)  # comment marks of letters; others are no words
#: Licences whose text holds the notice of another.
HOLDS = {"BSD-3-Clause": {"BSD-2-Clause"}}
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
FILE = r"(?i)^(un)?licen[cs]e([-_.].*)?$|^copying([-_.].*)?$|^notice([-_.].*)?$"
#: Notices as their licences' publishers word them, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "Proprietary": ["Copyright. All rights reserved", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Headers for source files as the publishers of these licences word them.
HEADERS = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
}
#: Licences whose identifier goes on with "only" or "or-later".
VERSIONED = ("AGPL", "GPL", "LGPL")


def identifiers(name: str) -> list[str]:
    """Lines that name a licence by its identifier."""
    ends = ["", "-only", "-or-later", "+"] if name.startswith(VERSIONED) else [""]
    return [f"SPDX-License-Identifier: {name}{end}" for end in ends]


for _name, _texts in TEMPLATES.items():
    _texts += [HEADERS[_name]] if _name in HEADERS else []
    _texts += identifiers(_name) if _name != "Proprietary" else []


class Cues:
    """The telling words of templates, and of how many a text must hold for a cosine at the threshold.

    No cosine exceeds the share of a template's length that the common words have. Plain words weigh little, the others
    count alike here, so a share of the square of the threshold is needed.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.need: list[int] = []
        self.size: list[int] = []
        self.templates: dict[str, set[int]] = {}
        self.offsets: dict[str, list[tuple[int, int]]] = {}
        for words in (WORD.findall(text.lower()) for texts in templates.values() for text in texts):
            telling = set(words) - PLAIN or set(words)
            for word in telling:
                self.templates.setdefault(word, set()).add(len(self.need))
            for offset, word in enumerate(words):
                if word in telling:
                    self.offsets.setdefault(word, []).append((len(self.need), offset))
            self.size.append(len(words))
            self.need.append(max(1, math.ceil(threshold * threshold * len(telling))))

    def enough(self, words: list[str]) -> bool:
        """Whether these words hold enough telling ones of a template."""
        held = self.templates.keys() & words
        counts = Counter(n for word in held for n in self.templates[word])
        return any(k >= self.need[n] for n, k in counts.items())

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """Windows of a template's length that hold enough of its telling words.

        They start where one of these words has its place in the template. Of windows that overlap the one counts that
        holds most of them, then with most in place, then the first.
        """
        held: dict[int, list[int]] = {}
        starts: dict[int, Counter] = {}
        for place, word in enumerate(words):
            if word in self.offsets:
                for n in self.templates[word]:
                    held.setdefault(n, []).append(place)
                for n, offset in self.offsets[word]:
                    starts.setdefault(n, Counter())[max(0, place - offset)] += 1
        found: set[tuple[int, int]] = set()
        for n, places in held.items():
            size, need, best = self.size[n], self.need[n], None
            if len(places) < need:
                continue
            for start, fit in sorted(starts[n].items()):
                low, high = bisect_left(places, start), bisect_left(places, start + size)
                if high - low < need or (k := len({words[p] for p in places[low:high]})) < need:
                    continue
                if best and start < best[2] + size:
                    best = max(best, (k, fit, start), key=lambda b: (b[0], b[1], -b[2]))
                    continue
                if best:
                    found.add((best[2], min(best[2] + size, len(words))))
                best = (k, fit, start)
            if best:
                found.add((best[2], min(best[2] + size, len(words))))
        return sorted(found)


CUES = Cues(TEMPLATES, THRESHOLD)


def candidates(text: str | None, licence_file: bool, cues: Cues = CUES) -> list[Counter]:
    """Word counts of the lines of a whole text that speak of a licence, and of the windows that do."""
    if not text:
        return []
    cue, every, found = CUE.search(text), [], {}
    for line in text.splitlines():
        words = WORD.findall(MARK.sub("", line).lower())
        if words and (licence_file or cue and CUE.search(line) or cues.enough(words)):
            found[len(every), len(every) + len(words)] = Counter(words)
        every += words
    for low, high in cues.windows(every):
        if (low, high) not in found:
            found[low, high] = Counter(every[low:high])
    return list(found.values())


class Templates:
    """Unit TF-IDF vectors of the templates. ``documents`` and ``frequency`` count candidates of the corpus by word."""

    def __init__(self, templates: dict[str, list[str]], documents: int, frequency: dict[str, int]):
        counted = [(name, Counter(WORD.findall(text.lower()))) for name, texts in sorted(templates.items()) for text in texts]
        total = documents + len(counted)
        self.weight = {w: math.log((1 + total) / (1 + frequency.get(w, 0) + sum(w in c for _, c in counted))) + 1 for _, c in counted for w in c}
        self.other = math.log(1 + total) + 1  # a word of no template: taken as rare
        self.vectors = [(name, self._unit(counts)) for name, counts in counted]

    def _unit(self, counts: Counter) -> dict[str, float]:
        raw = {w: n * self.weight.get(w, self.other) for w, n in counts.items()}
        size = math.sqrt(sum(raw[w] * raw[w] for w in sorted(raw)))
        return {w: x / size for w, x in raw.items()}

    def closest(self, counts: Counter) -> tuple[float, str, int]:
        """The best cosine, its template and the number of its words; of equals the first name."""
        own = self._unit(counts)
        best = (-1.0, "", 0)
        for name, vector in self.vectors:
            cosine = math.fsum(x * own[w] for w, x in vector.items() if w in own)
            if cosine > best[0]:
                best = (cosine, name, len(vector))
        return best

    def choose(self, found: list[Counter], threshold: float) -> tuple[float, str] | None:
        """The cosine and template of a file with these candidates, if one reaches the threshold."""
        close = [(self.closest(counts), counts) for counts in found]
        good = [b for b, _ in close if b[0] >= threshold]
        # A notice may be part of another licence's text, but not of a line that names one.
        parts = {part for b, counts in close if b[0] >= threshold and "spdx" not in counts for part in HOLDS.get(b[1], ())}
        best = max((b for b in good if b[1] not in parts), key=lambda b: (round(b[0], 6), b[2]), default=None)
        return best and best[:2]


def frequencies(files: DataFrame, words: set[str], cues: Cues) -> tuple[int, dict[str, int]]:
    """Number of candidates in all files, and of those that hold each word of the templates (a bounded list)."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for text, own in zip(batch.column("text").to_pylist(), batch.column("licence_file").to_pylist()):
            for counts in candidates(text, own, cues):
                found.update({""} | (words & counts.keys()))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    summed = map_arrow(files.select("text", "licence_file"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in summed.collect()}
    return counts.pop("", 0), counts


def parent(path: Column) -> Column:
    """The directory of a path: empty for the root of relative paths, a slash for that of absolute ones."""
    return F.when(path.rlike("^/[^/]*$"), "/").otherwise(F.regexp_replace(path, r"(^|/)[^/]*$", ""))


def with_ancestors(dirs: DataFrame) -> DataFrame:
    """(dir, above): each directory with itself and all above it, up to its root."""
    parts = F.split("dir", "/")
    named = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    root = F.when(F.col("dir").startswith("/"), "/").otherwise("")
    # The first part of an absolute path is empty: its root is the slash.
    above = F.array_distinct(F.concat(F.array(root), F.filter(named, lambda x: x != "")))
    return dirs.select("dir", F.explode(above).alias("above"))


def licences(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: ``path, licence, score, origin, inherited_from``.

    ``origin`` is own, inherited or none. Paths are separated by slashes; the roots of relative and of absolute paths are
    directories of their own. A licence file is told by its name. Of
    several in a directory the greatest cosine counts, then the smallest path. Its own candidates come first for every
    file. A null or empty text has no candidates; a null path inherits nothing. Repeated rows give repeated results.
    Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    name = F.regexp_extract(F.col("path"), r"[^/]*$", 0)
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    rows = rows.withColumn("licence_file", F.coalesce(name.rlike(FILE), F.lit(False)))
    words = {w for texts in templates.values() for t in texts for w in WORD.findall(t.lower())}
    cues = Cues(templates, threshold)
    held = files.sparkSession.sparkContext.broadcast(Templates(templates, *frequencies(rows, words, cues)))

    def match(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, scores = [], []
        for whole, own in zip(batch.column("text").to_pylist(), batch.column("licence_file").to_pylist()):
            best = held.value.choose(candidates(whole, own, cues), threshold)
            found.append(best[1] if best else None)
            scores.append(round(best[0], 6) if best else None)
        return pa.RecordBatch.from_arrays([batch.column("path"), batch.column("licence_file"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["path", "licence_file", "licence", "score"])

    matched = durable(map_arrow(rows, match, "path string, licence_file boolean, licence string, score double").withColumn("dir", parent(F.col("path"))))
    order = F.struct(-F.col("score"), "path", "licence")
    at = matched.where("licence_file AND licence IS NOT NULL").groupBy("dir").agg(F.min(order).alias("m"))
    own = at.select(F.col("dir").alias("above"), F.col("m.licence").alias("given"), F.col("m.path").alias("giver"))
    # Directories are resolved once each: every directory with those above it, the deepest with a licence file counts.
    dirs = matched.where("licence IS NULL AND dir IS NOT NULL").select("dir").distinct()
    nearest = with_ancestors(dirs).join(own, "above").groupBy("dir").agg(F.max_by(F.struct("given", "giver"), F.length("above")).alias("n"))
    joined = matched.join(nearest, "dir", "left")
    inherited = F.col("licence").isNull() & F.col("n").isNotNull()
    return joined.select(
        "path", F.coalesce("licence", "n.given").alias("licence"), "score",
        F.when(F.col("licence").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("n.giver")).alias("inherited_from"))


def document_path() -> Column:
    """Documents as files: a directory for each source, thousand and fifty; of every tenth the licence file of its place.

    The given documents have no paths, so this lays them out as repositories. The first document stands for the licence
    file of all, one divisible by 1000 for that of its source, one divisible by 50 for that of the thousand, any other tenth for its fifty.
    """
    n = F.col("doc_id")
    thousand, fifty = F.floor(n / 1000).cast("string"), F.floor(n / 50).cast("string")
    return F.when(n == 0, "LICENSE").when(n % 1000 == 0, F.concat_ws("/", "source", F.concat(F.lit("LICENSE-"), n.cast("string")))) \
        .when(n % 50 == 0, F.concat_ws("/", "source", thousand, F.concat(F.lit("LICENSE-"), n.cast("string")))) \
        .when(n % 10 == 0, F.concat_ws("/", "source", thousand, fifty, F.concat(F.lit("LICENSE-"), n.cast("string")))) \
        .otherwise(F.concat_ws("/", "source", thousand, fifty, F.concat(n.cast("string"), F.lit(".md"))))


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """The licence of every document, laid out as files."""
    return licences(table(spark, sf_dir, "documents").select(document_path().alias("path"), "text"))
