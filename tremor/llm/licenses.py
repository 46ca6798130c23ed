"""License scan: MinHash bands over overlapping windows, exact containment after.

Words are runs of letters and digits of the lower-cased text.  Templates and
texts are compared by word bigrams (one-line notices are too short for longer
ones).  For each template length, windows of one and a half times that length
step through a text at half the length, so any occurrence lies in a window as
a whole, at a Jaccard similarity of RETRIEVAL_SIMILARITY or more.  A window is
signed by MinHash; bands of ROWS values retrieve the templates that share one.
Their number is the least with 1 - (1 - s^ROWS)^bands >= MIN_PROBABILITY.
Windows with fewer template bigrams than any template needs are not signed;
they could not be verified.

A retrieved template is verified exactly: among runs of the text up to its
own length it must have at least CONTAINMENT of its distinct bigrams in one,
found by sliding over the whole neighbourhood of the window.  Overlapping
findings of one template are one; the best run is reported.  ``best_licenses``
takes whole licences (license_bodies), asks for the phrases that tell them
apart and, where findings of several templates overlap by half of the shorter
one, keeps the one with most matched bigrams, then the better contained.

Null and empty texts have no findings.  Templates of fewer than two words are
ignored.  Repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import mix64, slices

CONTAINMENT = 0.8
RETRIEVAL_SIMILARITY, MIN_PROBABILITY, ROWS = 0.4, 0.9999, 1
_WORD = re.compile(r"[^\W_]+")

#: notices as they are commonly written, by name
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or "
               "(at your option) any later version",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc0-1.0": "dedicated to the public domain under CC0 1.0 Universal",
    "all-rights-reserved": "All rights reserved",
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bands_needed(similarity: float = RETRIEVAL_SIMILARITY, rows: int = ROWS, probability: float = MIN_PROBABILITY) -> int:
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity ** rows))


class Templates:
    """Signed templates; equal bigrams have equal numbers everywhere."""

    def __init__(self, texts: dict[str, str], required: dict[str, tuple[str, ...]] | None = None):
        self.number: dict[str, int] = {}                    # word -> number from 1, 0: in no template
        self.names, self.grams, self.size = [], [], []
        for name in sorted(texts):
            words = _WORD.findall(texts[name].lower())
            if len(words) < 2:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            self.names.append(name)
            self.grams.append(np.unique(self.bigrams(ids)))
            self.size.append(len(words))
        self.every = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.int64)
        # per template, bigrams that a finding must hold; None: any finding counts, overlapping ones too
        self.required = None if required is None else [
            np.unique(np.concatenate([np.zeros(0, np.int64), *(self.bigrams(np.array([self.number.get(w, 0) for w in words_of(x)], np.int64))
                                                               for x in required.get(n, ()))])) for n in self.names]
        # per length, which of all bigrams its templates have
        self.member = {size: np.isin(self.every, np.concatenate([g for g, n in zip(self.grams, self.size) if n == size]))
                       for size in set(self.size)}
        rng = np.random.default_rng(5)
        self.bands = bands_needed()
        self.salts = rng.integers(1, 1 << 62, self.bands * ROWS).astype(np.uint64)
        # lengths; within one, band values -> templates
        self.classes: dict[int, list[dict[tuple, list[int]]]] = {}
        self.least: dict[int, int] = {}                     # fewest bigrams that verify one of a length
        for t, g in enumerate(self.grams):
            tables = self.classes.setdefault(self.size[t], [{} for _ in range(self.bands)])
            need = math.ceil(CONTAINMENT * len(g))
            self.least[self.size[t]] = min(need, self.least.get(self.size[t], need))
            for band, value in enumerate(self.sign(g[None, :], np.ones((1, len(g)), bool))[0]):
                tables[band].setdefault(tuple(value), []).append(t)

    @staticmethod
    def bigrams(ids: np.ndarray) -> np.ndarray:
        return ids[:-1] << 32 | ids[1:]

    def sign(self, grams: np.ndarray, real: np.ndarray) -> np.ndarray:
        """MinHash bands (rows, bands, ROWS) of padded bigram rows."""
        values = [np.where(real, mix64(grams.view(np.uint64) ^ s), np.uint64((1 << 64) - 1)).min(axis=1) for s in self.salts]
        return np.stack(values, 1).reshape(len(grams), self.bands, ROWS)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(name, start, end, containment), by start and name, code points."""
        low = (text or "").lower()
        if len(low) != len(text or ""):                      # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        ids = np.array([self.number.get(w, 0) for w in _WORD.findall(low)], np.int64)
        if not ids.any() or len(ids) < 2:
            return []
        grams = self.bigrams(ids)
        known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        spot = np.minimum(np.searchsorted(self.every, grams[known]), len(self.every) - 1)
        real = self.every[spot] == grams[known]
        every, spot = known[real], spot[real]
        if len(every) < min(self.least.values()):
            return []
        retrieved: dict[int, set[tuple[int, int]]] = {}
        for size, tables in self.classes.items():
            if len(every) < self.least[size]:
                continue
            hits = every[self.member[size][spot]]
            if len(hits) < self.least[size]:
                continue
            length, step = size + (size + 1) // 2, max(1, size // 2)
            last = hits // step
            starts = np.unique(np.concatenate([np.maximum(0, last - k) for k in range(-(-length // step))])) * step
            inside = np.searchsorted(hits, starts + length) - np.searchsorted(hits, starts)
            starts = starts[inside >= self.least[size]]
            if not len(starts):
                continue
            at = starts[:, None] + np.arange(length)
            real = at < len(grams)
            window = np.where(real, grams[np.minimum(at, len(grams) - 1)], 0)
            for start, bands in zip(starts, self.sign(window, real)):
                for table, value in zip(tables, bands):
                    for t in table.get(tuple(value), ()):
                        retrieved.setdefault(t, set()).add((int(start), length))
        if not retrieved:
            return []
        found = list(_WORD.finditer(low))
        out = []
        for t, windows in retrieved.items():
            places = np.unique(np.concatenate([np.arange(max(0, a - n), min(len(grams), a + 2 * n)) for a, n in windows]))
            out += [(t, found[a].start(), found[b - 1].end(), c) for a, b, c in self.verify(t, grams, places)
                    if self.required is None or np.isin(self.required[t], grams[a:b - 1]).all()]
        if self.required is not None:
            out = self.best(out)
        return sorted(((self.names[t], *r) for t, *r in out), key=lambda r: (r[1], r[0]))

    def best(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        kept: list[tuple[int, int, int, float]] = []
        for r in sorted(found, key=lambda r: (-round(r[3] * len(self.grams[r[0]])), -r[3], r[1], self.names[r[0]])):
            if all(2 * (min(r[2], b) - max(r[1], a)) <= min(r[2] - r[1], b - a) for _, a, b, _ in kept):
                kept.append(r)
        return kept

    def verify(self, t: int, grams: np.ndarray, places: np.ndarray) -> list[tuple[int, int, float]]:
        """Best runs of words, as long as the template, at these places:
        (first word, one past the last, containment)."""
        own, size = self.grams[t], self.size[t]
        spot = np.searchsorted(own, grams[places])
        match = own[np.minimum(spot, len(own) - 1)] == grams[places]
        spot, places = spot[match], places[match]
        width = size - 1
        runs = []
        ends, spots = np.searchsorted(places, places + width).tolist(), spot.tolist()
        times, distinct, j = [0] * len(own), 0, 0            # of the run's bigrams
        for i, a in enumerate(places):                       # a best run begins with a bigram of the template
            while j < ends[i]:
                times[spots[j]] += 1
                distinct += times[spots[j]] == 1
                j += 1
            share = distinct / len(own)
            times[spots[i]] -= 1
            distinct -= times[spots[i]] == 0
            if share >= CONTAINMENT:
                runs.append((share, int(a), int(places[j - 1]) + 2))
        best: list[tuple[int, int, float]] = []
        for share, a, b in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
            if all(b <= x or a >= y for x, y, _ in best):
                best.append((a, b, share))
        return best


_scanners: dict[tuple, Templates] = {}


def best_licenses(docs: DataFrame) -> DataFrame:
    """As ``scan_licenses``, for whole licences and their parts; ``license`` is
    the licence, or those that share the part, joined by ``|``."""
    from tremor.llm.license_bodies import LICENSES, REQUIRED
    return scan_licenses(docs, LICENSES, REQUIRED).withColumn("license", F.substring_index("license", "#", 1))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, required: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, license, start, end, containment: a row per finding, code
    points, end exclusive.  A null doc_id is kept.  With ``required`` (phrases
    by template) only the best of overlapping findings are reported."""
    key = tuple(sorted(templates.items())), None if required is None else tuple(sorted(required.items()))

    def run(batches):
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Templates(dict(key[0]), None if key[1] is None else dict(key[1]))
        scanner = _scanners[key]
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows += [(doc_id, *r) for r in scanner.scan(text)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64())],
                names=["doc_id", "license", "start", "end", "containment"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, license string, start bigint, end bigint, containment double"))
