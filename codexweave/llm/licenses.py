"""License scans (5): patience alignment of texts with notice templates.

A template covers a stretch of text as far as its words are aligned there: words unique in both are matched, the
longest increasing subsequence of these anchors stays, and the gaps between them are aligned in the same way, with
equal ends first. Stretches are tried wherever one of the template's words could begin one: of an alignment that covers
``COVER`` of a template at most a fifth of its words is missing, so one of its rarest fifth (and one more) of words, by their count in the
text, is there; each of their places is a pivot, with as many words on either side as the template has. A text that holds
too few of a template's words for that cover is passed over at once. A stretch lacking a word that tells the license from others
(its name, its version, NC, ND, SA) doesn't count. Of overlapping stretches that with most words aligned stays, then the better covered.

Null and empty texts hold nothing; a stretch may be found in any number of documents and places; of ties the earlier one, then
the earlier template stays; repeated rows are found each; a null doc_id is kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .words import U, bare, slices

COVER = 0.8

#: Notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache short": "Released under the Apache License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Rights reserved": "Copyright All rights reserved",
}
#: Words that tell a notice from others of the same form; a stretch without one of them is not that notice.
TELLING = {
    "Apache-2.0": "Apache 2 0",
    "Apache-2.0 header": "Apache 2 0",
    "Apache short": "Apache",
    "CC-BY-4.0": "CC BY 4 0",
    "CC-BY-NC-4.0": "CC BY NC 4 0",
    "CC-BY-NC-ND-4.0": "CC BY NC ND 4 0",
    "CC-BY-NC-SA-4.0": "CC BY NC SA 4 0",
    "CC-BY-ND-4.0": "CC BY ND 4 0",
    "CC-BY-SA-4.0": "CC BY SA 4 0",
    "CC long": "Creative Commons Attribution 4 0",
    "GPL-2.0": "GNU General 2",
    "GPL-3.0": "GNU General 3",
    "GPL header": "GNU General",
    "MIT": "MIT",
    "MPL-2.0": "Mozilla 2 0",
    "Rights reserved": "Copyright rights reserved",
}


def align(x: list, y: list) -> list[tuple[int, int]]:
    """Matched places (in x, in y), ascending in both: patience anchors, then their gaps."""
    out, work = [], [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = Counter(x[a:b])
        there = Counter(y[c:d])
        at = {y[k]: k for k in range(c, d) if there[y[k]] == 1}
        anchors = [(k, at[x[k]]) for k in range(a, b) if once[x[k]] == 1 and x[k] in at]
        tails, ends, back = [], [], []
        for n, (_, k) in enumerate(anchors):
            p = bisect_left(tails, k)
            back.append(ends[p - 1] if p else -1)
            tails[p : p + 1], ends[p : p + 1] = [k], [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        low = (a, c)
        for p, q in reversed(chain):
            out.append((p, q))
            work.append((low[0], p, low[1], q))
            low = (p + 1, q + 1)
        if chain:
            work.append((low[0], b, low[1], d))
    return sorted(out)


def notices(h: np.ndarray, templates: dict[str, np.ndarray], telling: dict[str, list[int]]) -> list[tuple[str, int, int, float]]:
    """License, first word, word after the last, coverage of the stretches of one text (hashes of its words); each of a license's ``telling`` words must be aligned."""
    found = []
    for order, (name, words) in enumerate(templates.items()):
        n = len(words)
        here = np.flatnonzero(np.isin(h, words))
        count = Counter(h[here].tolist())
        lack = int((1 - COVER) * n + 1e-9)
        if sum(1 for x in words.tolist() if x in count) < n - lack:
            continue
        rare = sorted(set(words.tolist()), key=lambda x: (count[x], x))
        taken = Counter(words.tolist())
        pivots, missed = [], 0
        for x in rare:
            pivots.append(x)
            missed += taken[x]
            if missed > lack:
                break
        for p in here[np.isin(h[here], np.array(pivots, U))].tolist():
            low = max(p - n, 0)
            part = h[low : p + n + 1].tolist()
            pairs = align(part, words.tolist())
            if len(pairs) >= n - lack and {part[x] for x, _ in pairs}.issuperset(telling.get(name, ())):
                found.append((-len(pairs), -len(pairs) / n, low + pairs[0][0], order, low + pairs[-1][0] + 1, name))
    kept = []
    for _, cover, start, _, end, name in sorted(set(found)):
        if all(end <= a or start >= b for _, a, b, _ in kept):
            kept.append((name, start, end, -cover))
    return sorted(kept, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, telling: dict[str, str] = TELLING, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, license, first_word, end_word (exclusive), coverage: one row per notice found."""
    needed = {name: bare(pa.array([t]))[1].tolist() for name, t in telling.items()}
    hashed = {name: bare(pa.array([t]))[1] for name, t in templates.items()}
    every = np.unique(np.concatenate(list(hashed.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = np.zeros(1 << 16, bool)
        quick[every & U(0xFFFF)] = True
        for batch in slices(batches):
            w, h = bare(batch["text"])
            hit = np.flatnonzero(quick[h & U(0xFFFF)])
            place = np.minimum(np.searchsorted(every, h[hit]), len(every) - 1)
            true = every[place] == h[hit]
            hit, place = hit[true], place[true]
            of = np.searchsorted(w.first, hit, side="right") - 1
            present = np.zeros((len(batch), len(every)), bool)
            present[of, place] = True
            able = np.zeros(len(batch), bool)
            for words in hashed.values():
                columns = np.searchsorted(every, words)
                able |= present[:, columns].sum(1) >= len(words) - int((1 - COVER) * len(words) + 1e-9)
            out = [(batch["doc_id"][i].as_py(), *x) for i in np.flatnonzero(able).tolist() for x in notices(h[w.first[i] : w.first[i + 1]], hashed, needed)]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "license", "first_word", "end_word", "coverage"])

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, first_word long, end_word long, coverage double")


def op5_patience_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
