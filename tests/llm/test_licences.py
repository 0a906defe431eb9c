"""Cosine to the templates and inheritance along directories, against a direct reading."""

import glob
import math
import random
import re
import time
from collections import Counter

import pytest

from marginalia.llm import licences


def scan(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, license int")
    return {r.page_id: r for r in licences.scan(df).collect()}


def test_headers_and_inheritance(spark):
    mit = "<p>Released under the MIT License.</p>"
    got = scan(spark, [
        (1, "https://h.org/LICENSE.txt", "Licensed under the Apache License, Version 2.0.", 0),
        (2, "https://h.org/a/b/page.html?x=1", "<p>plain words</p>", 0),
        (3, "https://h.org/a/COPYING", "This work is licensed under the GNU General Public License, version 3.", 0),
        (4, "https://h.org/a/b/own.html", "<div>words</div>" + mit, 0),
        (5, "https://h.org/c/page", None, 0),
        (6, "https://other.org/c/page", "", 0),
        (7, "https://h.org/a/b/", "<p>Licensed under CC BY-NC 4.0.</p>", 0),
        (8, None, mit, 0),
        (9, "h.org", "the licence of a driver is not a notice at all for this", 0),
    ])
    assert {k: (r.own_license, r.license, r.inherited_from) for k, r in got.items()} == {
        1: ("Apache-2.0", "Apache-2.0", None),
        2: (None, "CC-BY-NC-4.0", "h.org/a/b/"),
        3: ("GPL-3.0", "GPL-3.0", None),
        4: ("MIT", "MIT", None),
        5: (None, "Apache-2.0", "h.org/"),
        6: (None, None, None),
        7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        8: ("MIT", "MIT", None),
        9: (None, "Apache-2.0", "h.org/"),
    }


def test_inheritance_against_walk(spark):
    """Deep and shallow directories: the same as walking up from each page."""
    notices = {"x.org/": "MIT", "x.org/a/": "GPL-3.0", "x.org/a/b/c/": "Apache-2.0", "x.org/d/e/": "MPL-2.0"}
    rows = [(k, f"https://{d}LICENSE", licences.TEMPLATES[n][1], 0) for k, (d, n) in enumerate(notices.items())]
    paths = [f"{'/'.join(p)}/f{k}" for k, p in enumerate([["x.org", *"abcde"[:n]] for n in range(6)] + [["x.org", "d", *"efg"[:n]] for n in range(4)])]
    rows += [(100 + k, f"http://{p}", "text", 0) for k, p in enumerate(paths)]
    got = scan(spark, rows)
    for k, p in enumerate(paths):
        up = p.rsplit("/", 1)[0] + "/"
        while up not in notices:
            up = up[:-1].rsplit("/", 1)[0] + "/"
        assert (got[100 + k].license, got[100 + k].inherited_from) == (notices[up], up)


def test_edge_rows(spark):
    rows = [(1, "u/LICENSE", "Released under the MIT License.", 1)] * 2 + [(None, "u/x", "word " * 100_000 + "\nLicensed under CC BY 4.0.", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, license int")
    got = licences.scan(df).collect()
    assert sorted((r.page_id or 0, r.license) for r in got) == [(0, "CC-BY-4.0"), (1, "MIT"), (1, "MIT")]
    assert licences.scan(df.limit(0)).count() == 0


def judged(texts, name="LICENSE"):
    """Verdicts of pages by one matcher without counts of a table."""
    matcher = licences.Matcher(0, {})
    out = []
    for text in texts:
        found = licences.headers(text) + (licences.windows(text) if name == "LICENSE" else [])
        page = licences.PAGE_WORDS & set(licences.word_list(licences.untagged(text)))
        name_, score = max((matcher.best(x, page) for x in found), key=lambda x: x[1], default=(None, 0.0))
        out.append(name_ if score >= licences.THRESHOLD else None)
    return out


def test_versions_and_relatives():
    """Notices as they are rendered in files and pages, near relatives of each other."""
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that:\n1. Redistributions of source code must retain the above copyright notice."
    cases = {
        "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\nEveryone is permitted to copy": "GPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "LGPL-2.1",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\nEveryone is permitted to copy and distribute verbatim copies of this license document": "AGPL-3.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Licensed under the Apache License, Version 2.0 (the License)": "Apache-2.0",
        bsd: "BSD-2-Clause",
        bsd + "\n3. Neither the name of the author may be used to endorse or promote products.": "BSD-3-Clause",
    }
    assert judged(cases) == list(cases.values())
    assert judged(["Licensed under the Apache License, Version 1.1"])[0] is None
    assert judged(["the driver showed a licence and went on along the road"])[0] is None


def test_rendered_licence_files():
    """Recall on the licence files of this machine, where there are any."""
    kinds = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
             "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    files = [f for f in glob.glob("/usr/share/common-licenses/*") if f.split("/")[-1] in kinds]
    if not files:
        pytest.skip("no licence files here")
    texts = [open(f, encoding="utf8", errors="replace").read() for f in files]
    right = sum(g == kinds[f.split("/")[-1]] for f, g in zip(files, judged(texts)))
    assert right >= 0.9 * len(files)
    marked = ["<html><body><pre>" + re.sub(r"([&<>])", " ", t) + "</pre></body></html>" for t in texts]
    assert judged(marked) == judged(texts)


def test_cosine_against_brute_force():
    """Vectors over the full vocabulary, written out."""
    rng = random.Random(3)
    known = licences.vocabulary()
    seen = {w: rng.randint(0, 40) for w in known[::2]}
    matcher = licences.Matcher(50, seen)
    for _ in range(40):
        counts = Counter(rng.choices([*known, "one", "two"], k=rng.randint(1, 30)))
        axes = sorted({*known, *counts})
        idf = {w: math.log(1 + 51 / (1 + (seen.get(w, 0) if w in known else 1))) for w in axes}
        vec = lambda c: [(1 + math.log(c[w])) * idf[w] if c.get(w) else 0.0 for w in axes]
        own, top = vec(counts), (None, 0.0)
        for t in licences._templates():
            other = vec(t.counts)
            cosine = sum(a * b for a, b in zip(own, other)) / math.sqrt(sum(a * a for a in own) * sum(b * b for b in other))
            if t.allows(counts, set()) and cosine > top[1] + 1e-12:
                top = (t.name, cosine)
        got = matcher.best(counts)
        assert got[0] == top[0] and abs(got[1] - top[1]) < 1e-9


def test_blocks_against_a_plain_pattern():
    """The same cuts as one pattern that may look back and forth."""
    plain = re.compile(rf"(?ias)<script\b.*?</script>|<style\b.*?</style>|<!--|-->|</?(?:{licences._BLOCK_TAGS})\b[^>]*>|\n")
    rng = random.Random(5)
    parts = ["<script>", "</script>", "<style a>", "</style>", "<p>", "</p", ">", "<", "<!--", "-->", "\n", " licence ", "<b>", "<br/>", "x"]
    for _ in range(3000):
        html = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert licences.blocks(html) == plain.split(html), html


def test_unclosed_tags_are_linear():
    for bad in ("<script>" * 25_000, "<" * 200_000, "<p " * 70_000, "<style>" * 25_000 + "</script>"):
        begin = time.time()
        licences.headers(bad + " licence ")
        licences.windows(bad)
        assert time.time() - begin < 5
