"""Licence scan by a trained paragraph classifier.

A multinomial logistic regression over sparse hashed word n-grams (one to three
words) tells licence families from each other and from unknown text.  It is
trained on the driver from short notices of each family, varied by dropped,
swapped and surrounding words, and from a bounded sample of corpus paragraphs
for the unknown class.  Its temperature is fitted on variants held back, and a
family must reach ``SURE`` of probability.  A prediction is confirmed by
comparison with the family's templates: enough of a template's word pairs must
be in the window.

A paragraph ends at a line without a word, so a blank line with a comment leader
ends one too.  Notices stand on one line or are wrapped over several, so the
lines of a paragraph are scored one by one and joined: as a whole up to
``WINDOW`` words, else in windows that overlap by half, so a notice inside a
long paragraph is seen.  Comment leaders are no words, or dropped if they are
(``LEADERS``).  Weights of n-grams are summed by running totals: the
cost per word is constant.  Scoring is a map over the documents.

Defined cases: null or blank text has no paragraph and no row; a family that
occurs several times in a document is one row with its best window and the
number of windows (joined windows that touch a line with the same family are
not counted again); repeated rows give repeated results; without any document
the classifier is trained on the notices alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_of
from weftgraph.llm.words import blocks, hash_spans, mixed

#: Short notices by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1"],
    "bsd": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal and dedicated the work to the public domain"],
    "proprietary": ["All rights reserved"],
}
FAMILIES = [*TEMPLATES, "unknown"]
UNKNOWN = len(FAMILIES) - 1
#: Least probability, least share of a template's word pairs, words of a window.
SURE, CONFIRMED, WINDOW = 0.8, 0.6, 24
#: Hash space of n-grams, variants per family, corpus paragraphs and bytes of each for the unknown class.
SPACE_BITS, VARIANTS, SAMPLE, SAMPLE_BYTES = 17, 240, 3000, 600
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6

#: Words that lead comment lines.
LEADERS = [b"rem", b"dnl"]

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLACE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its line): words are runs of letters, digits and non-ASCII bytes, A-Z lowered."""
    buf = _FOLD[np.frombuffer(text + b" ", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[buf])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    line = np.cumsum(buf == 10)[starts] if len(starts) else starts
    return hash_spans(buf, starts, ends), line


def led(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether each word leads a comment line."""
    return np.isin(h, _LEADING) & np.concatenate(([True], line[1:] != line[:-1]))


def paragraphs(line: np.ndarray) -> np.ndarray:
    """Number of each word's paragraph: lines without a word between two words part them."""
    return np.cumsum(np.concatenate(([0], np.diff(line) > 1)))


_LEADING = np.concatenate([tokens(x)[0] for x in LEADERS])


def grams(h: np.ndarray, line: np.ndarray) -> list[np.ndarray]:
    """Feature of the n-gram that ends at each word, for n = 1, 2, 3; -1 where it would cross a line."""
    out = []
    for n in (1, 2, 3):
        value = np.full(len(h), -1, dtype=np.int64)
        if len(h) >= n:
            total = np.zeros(len(h) - n + 1, dtype=np.uint64)
            for j in range(n):
                total += h[j : len(h) - n + 1 + j] * _PLACE[j]
            whole = line[n - 1 :] == line[: len(h) - n + 1]
            value[n - 1 :] = np.where(whole, (mixed(total + np.uint64(n)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64), -1)
        out.append(value)
    return out


def _features(text: str) -> np.ndarray:
    h, line = tokens(text.encode())
    f = np.concatenate(grams(h, np.zeros_like(line)))
    return f[f >= 0]


def _variants(r: np.random.Generator, noise: list[str]) -> list[tuple[str, int]]:
    """Notices with a few words dropped or swapped and others' words around them."""
    out = []
    for family, notices in TEMPLATES.items():
        for i in range(VARIANTS):
            words = notices[i % len(notices)].split()
            if i >= len(notices) * 4 and len(words) > 6:
                words = [w for w in words if r.random() > 0.06]
                if r.random() < 0.3:
                    a = r.integers(0, len(words) - 1)
                    words[a], words[a + 1] = words[a + 1], words[a]
            if noise and i % 2:
                other = noise[r.integers(len(noise))].split()
                cut = int(r.integers(0, min(len(other), 20) + 1))
                words = other[:cut] + words if i % 4 == 1 else words + other[:cut]
            out.append((" ".join(words), FAMILIES.index(family)))
    return out


class Classifier:
    def __init__(self):
        self.w = np.zeros((1 << SPACE_BITS, len(FAMILIES)), dtype=np.float32)
        self.b = np.zeros(len(FAMILIES), dtype=np.float32)
        self.heat = 1.0

    def probabilities(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From sums of weights and numbers of features."""
        z = (total / np.sqrt(np.maximum(n, 1))[:, None] + self.b) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, rows: list[tuple[np.ndarray, int]], r: np.random.Generator) -> None:
        held, used = rows[::5], [x for i, x in enumerate(rows) if i % 5]
        for epoch in range(EPOCHS):
            for i in r.permutation(len(used)):
                f, y = used[i]
                if not len(f):
                    continue
                p = self.probabilities(self.w[f].sum(axis=0, keepdims=True), np.array([len(f)]))[0]
                p[y] -= 1
                step = RATE / (1 + epoch)
                np.add.at(self.w, f, (-step / np.sqrt(len(f)) * p).astype(np.float32))
                self.b -= (0.1 * step * p).astype(np.float32)
            self.w *= 1 - DECAY * len(used)
        # Temperature: the least loss on rows that training did not see.
        total = np.array([self.w[f].sum(axis=0) for f, _ in held])
        n, y = np.array([len(f) for f, _ in held]), np.array([y for _, y in held])

        def loss(heat: float) -> float:
            self.heat = heat
            return float(-np.log(self.probabilities(total, n)[np.arange(len(y)), y] + 1e-9).mean())

        self.heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)


def sample(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE`` different paragraphs of at most ``SAMPLE_BYTES`` bytes, those with the least hashes.

    A paragraph counts once, however often it is repeated, and the order is of the hashes alone.
    """
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("p"))
    lines = lines.where((F.octet_length("p") <= SAMPLE_BYTES) & (F.length(F.trim("p")) > 0)).select("p", F.xxhash64("p").alias("h"))
    least = lines.select(F.col("h").alias("s_h")).distinct().orderBy("s_h").limit(SAMPLE)
    # Texts are fetched for the chosen hashes only.
    chosen = lines.join(F.broadcast(least), F.col("h") == F.col("s_h")).groupBy("h").agg(F.min("p").alias("p"))
    return [x["p"] for x in sorted(chosen.collect(), key=lambda x: x["h"])]


def train(docs: DataFrame, seed: int = 3) -> Classifier:
    """From the notices and a bounded sample of unlabelled corpus paragraphs."""
    texts = sample(docs)
    known = [{name: _pairs(t) for name, t in ((i, x) for i, x in enumerate(v))} for v in TEMPLATES.values()]
    # Paragraphs that hold a notice are not unknown text.
    noise = [t for t in texts if not any(_share(p, _pairs(t)) >= 0.5 for group in known for p in group.values())]
    r = np.random.default_rng(seed)
    rows = [(_features(t), y) for t, y in _variants(r, noise)] + [(_features(t), UNKNOWN) for t in noise]
    # Parts of notices are not enough to name a family.
    for notices in TEMPLATES.values():
        for t in notices:
            words = t.split()
            rows += [(_features(" ".join(words[:k])), UNKNOWN) for k in range(1, max(2, len(words) // 3))] if len(words) > 5 else []
    order = r.permutation(len(rows))
    model = Classifier()
    model.fit([rows[i] for i in order], r)
    return model


def _pairs(text: str) -> set[int]:
    h, _ = tokens(text.encode())
    return set((h[:-1] * _PLACE[0] + h[1:] * _PLACE[1]).tolist()) if len(h) > 1 else set(h.tolist())


def _share(template: set[int], window: set[int]) -> float:
    return len(template & window) / max(1, len(template))


class Scanner:
    def __init__(self, model: Classifier):
        self.model = model
        self.templates = {f: [_pairs(t) for t in v] for f, v in TEMPLATES.items()}

    def windows(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 word of every window."""
        cuts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1], [True])))
        first, last, half = cuts[:-1], cuts[1:], WINDOW // 2
        n = np.where(last - first <= WINDOW, 1, -(-(last - first - half) // half))
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(first, n) + step * half
        return starts, np.minimum(starts + WINDOW, np.repeat(last, n))

    def scan(self, texts: list[bytes]) -> list[dict[str, tuple[float, float, int]]]:
        """Per text: family -> (best probability, template share at it, number of windows).

        The texts are scored as one, line by line and paragraph by paragraph; no window crosses a paragraph.
        """
        found: list[dict[str, tuple[float, float, int]]] = [{} for _ in texts]
        h, line = tokens(b"\n\n".join(texts))
        if not len(h):
            return found
        # The line that each text begins with.
        begins = np.cumsum([0] + [t.count(b"\n") + 2 for t in texts[:-1]])
        seen: list[tuple[str, int, int]] = []
        part = paragraphs(line)
        self._score(h, line, line, begins, seen, found)
        # Joined lines, without what leads them; a paragraph of one line has been scored.
        keep = ~led(h, line)
        place = np.flatnonzero(keep)
        if len(place):
            self._score(h[keep], part[keep], line[keep], begins, seen, found, place)
        return found

    def _score(self, h: np.ndarray, unit: np.ndarray, line: np.ndarray, begins: np.ndarray, seen: list, found: list, place: np.ndarray | None = None) -> None:
        """Adds to ``found`` what windows within a unit hold; ``place``: words' places among all, given for joined lines."""
        model = self.model
        total = np.zeros((len(h) + 1, len(FAMILIES)), dtype=np.float64)
        counts = np.zeros(len(h) + 1, dtype=np.int64)
        for f in grams(h, unit):
            w = model.w[np.maximum(f, 0)] * (f >= 0)[:, None]
            total[1:] += np.cumsum(w, axis=0, dtype=np.float64)
            counts[1:] += np.cumsum(f >= 0)
        a, z = self.windows(unit)
        if place is not None:
            ends = np.flatnonzero(np.concatenate((unit[1:] != unit[:-1], [True])))
            several = line[ends[np.searchsorted(ends, a)]] != line[np.concatenate(([0], ends[:-1] + 1))[np.searchsorted(ends, a)]]
            a, z = a[several], z[several]
            if not len(a):
                return
        p = model.probabilities(total[z] - total[a], counts[z] - counts[a])
        best = p.argmax(axis=1)
        before: dict[str, list[np.ndarray]] = {}
        if place is not None:
            for family in {x[0] for x in seen}:
                spans = np.array(sorted(x[1:] for x in seen if x[0] == family))
                before[family] = [spans[:, 0], np.maximum.accumulate(spans[:, 1])]
        for i in np.flatnonzero((best != UNKNOWN) & (p.max(axis=1) >= SURE)).tolist():
            lo, hi = max(0, a[i] - WINDOW), z[i] + WINDOW  # a notice may reach beyond the window
            family, part = FAMILIES[best[i]], h[lo:hi][unit[lo:hi] == unit[a[i]]]
            pairs = set((part[:-1] * _PLACE[0] + part[1:] * _PLACE[1]).tolist()) if len(part) > 1 else set(part.tolist())
            share = max(_share(t, pairs) for t in self.templates[family])
            if share >= CONFIRMED:
                own = found[int(np.searchsorted(begins, line[a[i]], side="right")) - 1]
                old = own.get(family, (0.0, 0.0, 0))
                again = 0
                if place is None:
                    seen.append((family, int(a[i]), int(z[i])))
                elif family in before:
                    # The last line window that begins before this one ends must end before it begins.
                    k = int(np.searchsorted(before[family][0], place[z[i] - 1], side="right")) - 1
                    again = int(k >= 0 and before[family][1][k] > place[a[i]])
                own[family] = (*max(old[:2], (float(p[i, best[i]]), share)), old[2] + 1 - again)


_SCHEMA = "doc_id bigint, family string, probability double, template_share double, n_windows int"


def scanned(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, family, probability, template_share and n_windows for every licence family found in a document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w, model.b, model.heat))

    def run(batches):
        own = Classifier()
        own.w, own.b, own.heat = shared.value
        scanner = Scanner(own)
        for b in batches:
            rows = []
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in blocks(texts):
                rows += [(d, f, *x) for d, own in zip(ids[lo:hi], scanner.scan(texts[lo:hi])) for f, x in own.items()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), binary_of(F.col("text"))).mapInArrow(run, _SCHEMA)
