"""Licence scans: notices by TF-IDF cosine to templates, then inheritance along directories.

Every line of every text that shares a word with a template, every whole text, and every block is
compared with all templates; the best cosine decides. Blocks are runs of consecutive lines of up to
``RUN`` words (twice the longest template), and paragraphs of any length: a notice may be wrapped.
A text with too few words of each template for a cosine of ``LEAST`` needs no blocks. Whole licence
texts are known by their titles and by the notices and conditions they hold. A file whose whole text is near a template, or whose
name is that of a licence file and that holds a notice, is a licence file and speaks for its
directory. Files without a notice of their own take the licence of the nearest directory above
them that has one: directories, not files, are joined to their ancestors, so a directory with a
third of all files costs one row there.

Templates and their vocabulary are bounded by this module and travel with the code. Word counts
for the weights cover all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# Licence, and notices by which it is usually declared, or the title of its text.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("Artistic-1.0", "The \"Artistic License\" Preamble"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)
#: Every licence also has its identifier line, with the endings that the GNU ones take.
TEMPLATES = NOTICES + tuple((n, f"SPDX-License-Identifier: {n}{end}") for n in dict.fromkeys(n for n, _ in NOTICES) if n != "proprietary" for end in (("", "-only", "-or-later") if "GPL" in n or "GFDL" in n else ("",)))
#: A line, or a whole text, at least so near a template declares its licence.
LEAST = 0.6
#: Stands beside many a licence: it counts where no other licence is declared.
RESERVED = "proprietary"
#: Keys over which the files of one directory are dealt when its licence comes back to them.
SPREAD = 16
FILE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\.\w+)?$"
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


#: Most words of a run of lines.
RUN = 2 * max(len(words_of(t)) for _, t in TEMPLATES)
VOCABULARY = sorted({w for _, t in TEMPLATES for w in words_of(t)})


def _presence(batches):
    """How many texts of a task hold each word of the vocabulary."""
    seen, known = Counter(), set(VOCABULARY)
    for b in batches:
        for text in b["text"]:
            seen.update(known.intersection(words_of(text)))
    yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": list(seen.values())})


def rank(found: tuple[float, str | None]) -> tuple[bool, float]:
    """Order of (cosine, licence): declared licences before reserved rights, then by cosine."""
    return found[0] >= LEAST and found[1] != RESERVED, found[0]


class Weights:
    """Inverse document frequencies of the templates' words over all texts; a word of no template weighs as much as one that a single text holds."""

    def __init__(self, texts: int, df: dict[bytes, int]):
        self.idf = {w: math.log((1 + texts) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = math.log((1 + texts) / 2) + 1
        self.templates = []
        self.by: dict[bytes, list[tuple[int, float]]] = {}
        for i, (name, text) in enumerate(TEMPLATES):
            v = self.unit(Counter(words_of(text)))
            self.templates.append(name)
            for w, x in v.items():
                self.by.setdefault(w, []).append((i, x))

    def unit(self, tf: Counter) -> dict[bytes, float]:
        v = {w: n * self.idf.get(w, self.other) for w, n in tf.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    def blocks(self, lines: list[list[bytes]]) -> tuple[float, str | None]:
        """Best cosine of the runs of consecutive lines and of the paragraphs, if it is ``LEAST`` or more.

        A cosine is at most the length of the template's vector over the words they share, so
        templates below that are out; and a first or last line without their words only lowers it.
        """
        mass = [0.0] * len(self.templates)
        for w in {w for x in lines for w in x}:
            for i, y in self.by.get(w, ()):
                mass[i] += y * y
        open_ = {i for i, m in enumerate(mass) if m >= LEAST * LEAST - 1e-9}
        if not open_ or len(lines) < 2:
            return 0.0, None
        near = [any(i in open_ for w in x for i, _ in self.by.get(w, ())) for x in lines]
        top, name = 0.0, None
        for start in range(len(lines)):
            if not near[start]:
                continue
            tf: dict[bytes, int] = {}
            size, many, dot = 0.0, 0, dict.fromkeys(sorted(open_), 0.0)
            for end in range(start, len(lines)):
                many += len(lines[end])
                if many > RUN:
                    break
                for w in lines[end]:
                    x, n = self.idf.get(w, self.other), tf.get(w, 0)
                    tf[w] = n + 1
                    size += (2 * n + 1) * x * x
                    for i, y in self.by.get(w, ()):
                        if i in open_:
                            dot[i] += x * y
                if near[end] and end > start:
                    for i, x in dot.items():
                        if x > top * math.sqrt(size) or name == RESERVED:
                            top, name = max((top, name), (x / math.sqrt(size), self.templates[i]), key=rank)
        paragraph: list[bytes] = []
        for x in [*lines, []]:
            if not x and len(paragraph) > RUN:
                top, name = max((top, name), self.best(paragraph), key=rank)
            paragraph = paragraph + x if x else []
        return (top, name) if top >= LEAST else (0.0, None)

    def best(self, words: list[bytes]) -> tuple[float, str | None]:
        """Best cosine and its licence; ties go to the template listed first."""
        tf = Counter(words)
        if tf.keys().isdisjoint(self.by):
            return 0.0, None
        score = [0.0] * len(self.templates)
        for w, x in self.unit(tf).items():
            for i, y in self.by.get(w, ()):
                score[i] += x * y
        top, name = max(zip(score, self.templates), key=rank)
        return (top, name) if top > 0 else (0.0, None)


def _detect(weights: Weights):
    def run(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                lines = [words_of(x) for x in (text or "").lower().splitlines()]
                line: tuple[float, str | None] = (0.0, None)
                for x in dict.fromkeys(map(tuple, lines)):
                    line = max(line, weights.best(x), key=rank)
                whole = weights.best([w for x in lines for w in x])
                out.append((*max(whole, line, weights.blocks(lines), key=rank), whole[0] >= max(line[0], LEAST)))
            yield b.drop(columns="text").assign(**dict(zip(("similarity", "near", "by_text"), map(list, zip(*out)) if out else ([], [], []))))

    return run


def detect(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, directory, own_license, similarity, license_file) of every row of files.

    A null text is empty and declares nothing; a null path has a null directory and is no licence file.
    """
    source = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    df = {bytes(r["word"]): r["n"] for r in source.select("text").mapInPandas(_presence, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the vocabulary's size
    weights = Weights(source.count(), df)
    found = source.mapInPandas(_detect(weights), "path string, similarity double, near string, by_text boolean")
    own = F.when(F.col("similarity") >= LEAST, F.col("near"))
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(F.col("path").isNotNull() & own.isNotNull() & (F.col("by_text") | name.rlike(FILE_NAME)), F.lit(False))
    return found.select("path", directory(F.col("path")).alias("directory"), own.alias("own_license"), "similarity", is_file.alias("license_file"))


def directory(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """Adds ``license`` and ``inherited_from``: the file's own licence, else that of the nearest directory at or above it with a licence file.

    A directory with several licence files takes the nearest to a template, ties by path.
    """
    found = keep(found, "found")
    speaks = found.filter("license_file").groupBy("directory").agg(F.max_by("own_license", F.struct("similarity", F.hash("path"), "path")).alias("its_license"))
    places = found.filter("directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = places.select("directory", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "above"))
    near = above.join(speaks.withColumnRenamed("directory", "above"), "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "its_license")).alias("n"))
    # the files of one directory meet its licence over several keys: a directory may hold a third of all files
    near = near.select("directory", F.col("n.above").alias("above"), F.col("n.its_license").alias("its_license"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    joined = found.withColumn("salt", F.pmod(F.xxhash64("path", "similarity"), F.lit(SPREAD)).cast("int")).join(near, ["directory", "salt"], "left")
    return joined.select("path", "directory", "own_license", "similarity", "license_file", F.coalesce("own_license", "its_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("above")).alias("inherited_from"))


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, directory, own_license, similarity, license_file, license, inherited_from) of every row of files.

    A null text is empty and declares nothing; a row with a null path has only its own licence.
    Rows that repeat are judged alike; an empty table gives no rows. Further columns are ignored.
    """
    return inherit(detect(files, path, text))
