"""License scan: TF-IDF cosine to templates, then inheritance from the nearest directory.

Every page is cut into blocks (lines, paragraphs, list items, comments). A block that holds a cue
word is a possible header; a page that is named like a licence file is also compared as a whole and
by all its overlapping windows. A template names the version words that a block must hold and the
words of other licences of its family that it must not.
Both become sparse TF-IDF vectors and are compared by cosine with the vectors of the templates.
Words are weighed by how many of the possible headers of the whole table have them; only the words
of the templates are counted (a few hundred, whatever the table), any other word weighs like one
seen once.

Licence files and directory indexes name the licence of their directory. A page without a licence
of its own takes that of the nearest directory above it, found by joining the paths of the
directories that occur, not the pages, with the directories that have one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import configure, materialize

# fixed values: licence names, the usual wording of their notices, titles and conditions, and the
# words that a block must hold ("a|b": one of them, "+a": also in a sentence without it) or must not
# hold ("!a") to be that licence and no other version or relative of it
TEMPLATES = {
    "Apache-2.0": ("+apache 2", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
                   "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    "MIT": ("mit|charge|sublicense", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    "ISC": ("isc|fee", "Licensed under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-3-Clause": ("3|endorse", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "BSD-2-Clause": ("bsd|redistribution|redistributions !3 !endorse", "Licensed under the BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted.",
                     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "GPL-3.0": ("3 !lesser !affero !library", "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it.",
                "GNU General Public License Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("2 !lesser !affero !library", "This work is licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it.",
                "GNU General Public License Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("3 lesser", "This library is licensed under the GNU Lesser General Public License, version 3.",
                 "GNU Lesser General Public License Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "LGPL-2.1": ("2.1 lesser", "This library is licensed under the GNU Lesser General Public License, version 2.1.",
                 "GNU Lesser General Public License Version 2.1, February 1999. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
                 "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-2.0": ("2 library", "This library is licensed under the GNU Library General Public License, version 2.",
                 "GNU Library General Public License Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "AGPL-3.0": ("3 affero", "Licensed under the GNU Affero General Public License, version 3.",
                 "GNU Affero General Public License Version 3, 19 November 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    "MPL-2.0": ("2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0. Definitions. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    "MPL-1.1": ("1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1.", "Mozilla Public License Version 1.1. Definitions. Commercial Use means distribution or otherwise making the Covered Code available to a third party."),
    "EPL-2.0": ("2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Eclipse Public License v 2.0. The accompanying program is provided under the terms of this Eclipse Public License."),
    "Unlicense": ("", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    "CC0-1.0": ("", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal public domain dedication.", "Creative Commons Legal Code CC0 1.0 Universal."),
    "CC-BY-4.0": ("4 !sharealike !sa !noncommercial !nc !noderivatives !nd", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("4 !noncommercial !nc", "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("4 !sharealike !sa !noderivatives !nd", "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Proprietary": ("", "Copyright. All rights reserved. No part may be reproduced without written permission of the publisher."),
}
CUES = ("licen", "copyright", "spdx", "permission", "rights", "cc0", "creative", "redistribut", "unencumbered")
FILE_NAMES = ("license", "licence", "copying", "notice", "legal", "copyright")
THRESHOLD = 0.5
PAGE_WORDS = frozenset({"endorse"})  # sought in the whole page: a condition of its own paragraph
SPAN = 40  # words of a window of a licence file; windows overlap by half
_BLOCK_TAGS = "p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|article|header|footer|nav|body|head|title|blockquote|pre"
_CUT = re.compile(rf"(?ia)<(script|style)\b|<!--|-->|</?(?:{_BLOCK_TAGS})\b[^>]*>|\n")
_CLOSERS = {name: re.compile(rf"(?ia)</{name}>") for name in ("script", "style")}
_TAIL_CUT = re.compile(r"<!--|\n")
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[a-z0-9)])\.\s")


def word_list(text: str) -> list[str]:
    """Words and version numbers in order; 2.0 and 2 are the same version."""
    return [w[:-2] if w.endswith(".0") else w for w in _WORD.findall(text.lower())]


def words(text: str) -> Counter[str]:
    return Counter(word_list(text))


def untagged(text: str) -> str:
    """Tags become spaces. Behind the last '>' no tag can end, so only the text before it is
    searched and every attempt succeeds: time is linear whatever is left unclosed."""
    end = text.rfind(">") + 1
    return _TAG.sub(" ", text[:end]) + text[end:]


def blocks(html: str) -> list[str]:
    """Texts between block tags, comment marks and line ends, without scripts and styles. A script
    that is not closed is text. Linear in the page: a closer is looked for only where one follows."""
    end = html.rfind(">") + 1
    last = {name: max((m.start() for m in closer.finditer(html)), default=-1) for name, closer in _CLOSERS.items()}
    out, begin, at = [], 0, 0
    while found := _CUT.search(html, at, end):
        at = found.end()
        if found[1]:
            name = found[1].lower()
            if last[name] < at:
                continue
            at = _CLOSERS[name].search(html, at).end()
        out.append(html[begin : found.start()])
        begin = at
    rest = max(begin, end)
    tail = _TAIL_CUT.split(html[rest:])
    return [*out, html[begin:rest] + tail[0], *tail[1:]]


@dataclass(frozen=True)
class Template:
    """Words of a notice; ``needs`` are groups of which a block must hold one each, ``bars`` must
    be absent."""

    name: str
    counts: Counter[str]
    needs: tuple[tuple[str, ...], ...]
    bars: tuple[str, ...]

    def allows(self, counts: Counter[str], page: set[str]) -> bool:
        has = lambda w: w in (page if w in PAGE_WORDS else counts)
        return all(any(map(has, group)) for group in self.needs) and not any(map(has, self.bars))


def _templates() -> list[Template]:
    """The sentences of the first notice of a licence may stand alone, and so may every notice. A
    sentence that does not name a version asks for none, but never stands for a barred relative."""
    out = []
    for name, (terms, *texts) in TEMPLATES.items():
        asks = [t for t in terms.split() if t[0] != "!"]
        needs = [tuple(t.strip("+").split("|")) for t in asks]
        always = {g for g, t in zip(needs, asks) if t[0] == "+" or len(g) > 1}
        bars = tuple(t[1:] for t in terms.split() if t[0] == "!")
        for i, text in enumerate(texts):
            for part in dict.fromkeys([text, *(_SENTENCE.split(text) if i == 0 else [])]):
                counts = words(part)
                if len(counts) >= 4:
                    asked = [g for g in needs if part is text or g in always or g[0] in counts]
                    out.append(Template(name, counts, tuple(asked), bars))
    return out


def headers(html: str | None) -> list[Counter[str]]:
    """Word counts of the blocks that hold a cue."""
    out = []
    for block in blocks(html or ""):
        if any(c in block.lower() for c in CUES):
            for sentence in [block, *_SENTENCE.split(block)]:
                found = words(untagged(sentence))
                if len(found) >= 3 and any(w.startswith(CUES) for w in found):
                    out.append(found)
    return out


def windows(html: str) -> list[Counter[str]]:
    """Word counts of a licence file as a whole and of all its overlapping windows."""
    found = word_list(untagged(html))
    return [Counter(found), *(Counter(found[i : i + SPAN]) for i in range(0, max(len(found) - SPAN // 2, 1), SPAN // 2))]


def vocabulary() -> list[str]:
    return sorted({w for t in _templates() for w in t.counts})


def header_counts(pages: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of possible headers and, by template word, of those that have it."""
    known = set(vocabulary())

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                for found in headers(html):
                    seen.update(["", *(w for w in found if w in known)])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}  # at most the words of the templates
    return seen.pop("", 0), seen


class Matcher:
    """Cosine of word counts to the templates."""

    def __init__(self, n: int, seen: dict[str, int]):
        self.idf = {w: float(np.log(1 + (n + 1) / (1 + seen.get(w, 0)))) for w in vocabulary()}
        self.other = float(np.log(1 + (n + 1) / 2))
        self.templates, self.vectors, self.norms = _templates(), [], []
        for template in self.templates:
            vector = {w: (1 + np.log(c)) * self.idf[w] for w, c in template.counts.items()}
            self.vectors.append(vector)
            self.norms.append(float(np.sqrt(sum(x * x for x in vector.values()))))

    def best(self, counts: Counter[str], page: set[str] = frozenset()) -> tuple[str | None, float]:
        own = {w: (1 + np.log(c)) * self.idf.get(w, self.other) for w, c in counts.items()}
        norm = float(np.sqrt(sum(x * x for x in own.values())))
        top, score = None, 0.0
        for template, vector, size in zip(self.templates, self.vectors, self.norms):
            dot = sum(x * own[w] for w, x in vector.items() if w in own)
            cosine = dot / (norm * size) if norm and size else 0.0
            if cosine > score + 1e-12 and template.allows(counts, page):
                top, score = template.name, cosine
        return top, score


def directory(url: Column) -> Column:
    """Host and directory of a URL or path, without scheme, query and fragment; ends with '/'."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    bare = F.when(bare.contains("/"), bare).otherwise(F.concat(bare, F.lit("/")))
    return F.regexp_replace(bare, r"[^/]*$", "")


def _file_name(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.lower(F.when(bare.contains("/"), F.regexp_extract(bare, r"([^/]*)$", 1)).otherwise(""))


def own_licences(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, own_license (null where no block reaches the threshold) and its cosine."""
    configure(pages.sparkSession)
    n, seen = header_counts(pages)
    whole = F.coalesce(_file_name(F.col("url")).rlike(f"^({'|'.join(FILE_NAMES)})([._-]|$)"), F.lit(False))

    def run(batches):
        matcher = Matcher(n, seen)
        for batch in batches:
            names, scores = [], []
            for html, is_file in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = headers(html)
                if is_file and html:
                    found += windows(html)
                page = PAGE_WORDS & set(word_list(untagged(html))) if found else set()
                name, score = max((matcher.best(x, page) for x in found), key=lambda x: x[1], default=(None, 0.0))
                names.append(name if score >= threshold else None)
                scores.append(score)
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "own_license", "cosine", "is_file"])

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html", whole.alias("is_file")).mapInArrow(
        run, f"page_id {kind['page_id']}, url string, own_license string, cosine double, is_file boolean"
    )


def scan(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages``: page_id, url, own_license, cosine, license and inherited_from.

    ``license`` is the page's own, or else that of the nearest directory above it that has one,
    with ``inherited_from`` naming the directory. A directory has the licence of the licence file
    or index page in it with the highest cosine (ties: by licence name). Null and empty pages have
    no licence of their own; a null url has no directory and inherits nothing; rows that repeat are
    each reported; an empty table gives no rows; further columns are not carried.
    """
    own = materialize(own_licences(pages, threshold), "own-licences")  # read three times below
    own = own.withColumn("_dir", F.when(F.col("url").isNotNull(), directory(F.col("url"))))
    names_directory = F.col("is_file") | (_file_name(F.col("url")) == "") | _file_name(F.col("url")).startswith("index.")
    given = own.where(F.col("own_license").isNotNull() & F.col("_dir").isNotNull() & names_directory)
    given = given.groupBy("_dir").agg(F.min(F.struct(-F.col("cosine"), F.col("own_license"))).alias("best"))
    given = given.select(F.col("_dir").alias("above"), F.col("best.own_license").alias("given"))

    steps = F.split(F.regexp_replace("_dir", "/$", ""), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/")))
    chains = own.select("_dir").where("_dir is not null").distinct().select("_dir", F.explode(ancestors).alias("above"))
    nearest = chains.join(given, "above").groupBy("_dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("up"))
    nearest = nearest.select(F.col("_dir").alias("_of"), F.col("up.above").alias("above"), F.col("up.given").alias("given"))
    inherits = F.col("own_license").isNull()
    return own.join(nearest, own["_dir"] == F.col("_of"), "left").select(
        "page_id", "url", "own_license", "cosine", F.coalesce("own_license", "given").alias("license"),
        F.when(inherits, F.col("above")).alias("inherited_from"),
    )
