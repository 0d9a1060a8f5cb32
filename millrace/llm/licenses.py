"""Operator 4: license scans by MinHash bands over overlapping windows, verified by exact shingle containment.

A template of m shingles (of five words) is looked for in windows of m shingles, a new one every m / 4. A copy of
which at least `threshold` of the shingles are kept then overlaps some window with Jaccard similarity of at least
`jaccard_floor`; each band is one MinHash, and `bands_for` gives as many as make a shared band as likely as `chance`
asks. Windows that share a band with a template are candidates; around them the template's shingles are counted in every
window of m shingles, and the fullest windows that don't overlap are the copies.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .neardup import WordHash

SHINGLE = 5
WORD = re.compile(r"[^\W_]+")
#: Tokens that are scanned together, but for a longer document.
BATCH = 400_000

#: The wording of public license notices.
TEMPLATES = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_hashes = WordHash()


def jaccard_floor(threshold: float, step: float = 0.25) -> float:
    """Least similarity of a window and a kept copy: at most half a step of the shingles stand outside."""
    shared = threshold - step / 2
    return shared / (2 - shared)


def bands_for(threshold: float, chance: float = 0.999) -> int:
    return math.ceil(math.log(1 - chance) / math.log(1 - jaccard_floor(threshold)))


def shingles(words: list[str]) -> np.ndarray:
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]], threshold: float):
        self.threshold = threshold
        self.seeds = [np.uint64((0xD1342543DE82EF95 * (2 * b + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for b in range(bands_for(threshold))]
        self.templates = [(license_id, kind, np.unique(shingles([w.lower() for w in WORD.findall(text)]))) for license_id, kind, text in templates]
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for i, (_, _, s) in enumerate(self.templates):
            if len(s):
                self.by_size[len(s)].append(i)

    def candidates(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(template, starts of windows that share a band with it)."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for seed in self.seeds:
            mixed = s * seed
            mixed ^= mixed >> np.uint64(32)
            for size, members in self.by_size.items():
                step = max(1, size // 4)
                pad = -len(mixed) % step
                blocks = np.concatenate([mixed, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, step).min(1)
                width = -(-size // step)
                least = blocks.copy()
                for k in range(1, min(width, len(blocks))):
                    least[: len(least) - k] = np.minimum(least[: len(least) - k], blocks[k:])
                for i in members:
                    own = self.templates[i][2] * seed
                    own ^= own >> np.uint64(32)
                    at = np.flatnonzero(least == own.min())
                    if len(at):
                        found[i].append(at * step)
        for i, parts in found.items():
            yield i, np.unique(np.concatenate(parts))

    def scan(self, s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, template, first shingle, last shingle, containment) of each hit; starts, ends: of each text's shingles in s."""
        for i, at in self.candidates(s):
            own = self.templates[i][2]
            m = len(own)
            text = np.clip(np.searchsorted(starts, at, "right") - 1, 0, len(starts) - 1)
            # a window at a boundary may belong to the next text
            text = np.unique(np.concatenate([text, np.clip(np.searchsorted(starts, at + m, "right") - 1, 0, len(starts) - 1)]))
            for t in text.tolist():
                lo, hi = int(starts[t]), int(ends[t])
                near = at[(at > lo - 2 * m) & (at < hi)]
                if not len(near) or hi <= lo:
                    continue
                for group in np.split(near, np.flatnonzero(np.diff(near) > 2 * m) + 1):
                    a, b = max(lo, int(group[0]) - m), min(hi, int(group[-1]) + 2 * m)
                    for first, last, kept in copies_of(s[a:b], own, self.threshold):
                        yield t, i, a + first - lo, a + last - lo, kept


def copies_of(s: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(first shingle, last shingle, containment) of each copy of a template, its shingles own (sorted, distinct), in shingles s.

    A window has as many shingles as the template; it is a copy if at least `threshold` of the template's stand in it.
    The fullest window comes first (of equals the earliest), then the fullest that does not overlap it, and so on.
    """
    m = len(own)
    hit = np.flatnonzero(np.isin(s, own))
    if len(hit) < threshold * m - 1e-9:
        return
    which = np.searchsorted(own, s[hit])
    order = np.lexsort((hit, which))
    before = np.full(len(hit), -1)
    again = which[order][1:] == which[order][:-1]
    before[order[1:][again]] = hit[order[:-1][again]]
    # a hit counts in the windows that begin after its shingle's place before and hold it
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, np.maximum(np.maximum(before + 1, hit - m + 1), 0), 1)
    np.add.at(edge, hit + 1, -1)
    full = np.cumsum(edge[:-1])
    free = full >= threshold * m - 1e-9
    while free.any():
        at = int(np.where(free, full, -1).argmax())
        inside = hit[(hit >= at) & (hit < at + m)]
        yield int(inside[0]), int(inside[-1]), float(full[at] / m)
        free[max(0, at - m + 1) : at + m] = False


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, license, kind, start, stop, containment: a row for each template found in a text.

    start and stop are code points of the whole text; each copy is a row, and copies don't overlap. Words
    are runs of letters and digits of the text as it is, each lower-cased by itself. A null or empty text has no hits; repeated rows have theirs each; an
    empty table gives no rows; other columns are ignored. Templates are few (a parameter) and go with the task.
    """
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)

        def finish(part: list[tuple]) -> pa.RecordBatch:
            lists = [[w.lower() for w in WORD.findall(text)] for _, text in part]
            flat = [shingles(w) for w in lists]
            ends = np.cumsum([len(x) for x in flat])
            starts = ends - [len(x) for x in flat]
            out = []
            for t, i, first, last, kept in scanner.scan(np.concatenate(flat), starts, ends):
                doc_id, text = part[t]
                spans = [w.span() for w in WORD.finditer(text)]
                license_id, kind, _ = scanner.templates[i]
                out.append((doc_id, license_id, kind, spans[first][0], spans[min(len(spans), last + SHINGLE) - 1][1], kept))
            out.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1], r[2]))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "kind", "start", "stop", "containment"])

        part, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text:
                    part.append((doc_id, text))
                    size += len(text) // 6
                if size >= BATCH:
                    yield finish(part)
                    part, size = [], 0
        if part:
            yield finish(part)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, license string, kind string, start long, stop long, containment double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License notices in all documents; see scan_licenses()."""
    return scan_licenses(documents(spark, sf_dir))
