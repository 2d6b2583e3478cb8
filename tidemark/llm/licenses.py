"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Texts are lower-cased (A-Z) and cut at white space and ASCII punctuation. A
template of m word shingles is looked for in windows of 2m shingles that start
every m, so each full occurrence lies in one window whose Jaccard similarity
with the template is at least 0.5 if nothing in it repeats; one-row bands then
meet with probability 1 - 0.5^24 (more than 0.9999999). Windows that meet a
template are verified: the share of the template's shingles among them must
reach ``containment``. Whole texts are scanned.

Null and empty texts match nothing; a template without words is refused.
Repeated rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import U64, Hasher, hash_all, mix, shingles, text_bytes, text_chunks

WORDS, BANDS, CONTAINMENT = 3, 24, 0.8

# Public licence notices by SPDX identifier.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


def _hasher() -> Hasher:
    h = Hasher()
    for a, b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
        h.space[a : b + 1] = True
    return h


def _sets(hasher: Hasher, templates: dict[str, str]) -> list[tuple[str, np.ndarray]]:
    out = []
    for name, text in templates.items():
        _, _, h, _ = hasher.words(*text_bytes(pa.array([text], pa.string())))
        if not len(h):
            raise ValueError(f"template {name!r} has no words")
        out.append((name, np.unique(shingles(h, min(WORDS, len(h)))) if len(h) >= WORDS else np.array([hash_all(h)], U64)))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row a document and template found in it: matched windows, the first one's word, the best containment."""
    templates = dict(TEMPLATES if templates is None else templates)
    _sets(_hasher(), templates)

    def run(batches):
        hasher = _hasher()
        sets = _sets(hasher, templates)
        by_size: dict[int, list] = {}
        for name, s in sets:
            by_size.setdefault(len(s), []).append((name, s))
        seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for (ids,), data, offs in text_chunks(batches, [key], text):
            _, _, h, w = hasher.words(data, offs)
            s = shingles(h, WORDS)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(w))
            # shingles across texts are no template's; texts shorter than a shingle hold none
            whole = doc[: len(s)] == doc[len(h) - len(s) :] if len(s) else np.zeros(0, bool)
            at, s, owner = np.flatnonzero(whole), s[whole], doc[: len(s)][whole]
            if not len(s):
                continue
            first = np.searchsorted(owner, np.arange(len(offs)))
            found: dict[tuple[int, str], list] = {}
            for m, group in by_size.items():
                # blocks of m shingles from each text's start; a window is two neighbouring blocks
                counts = -(-np.diff(first) // m)
                base = np.cumsum(counts) - counts
                text_of = np.repeat(np.arange(len(counts)), counts)
                starts = first[text_of] + (np.arange(counts.sum()) - base[text_of]) * m
                joined = np.append(text_of[1:] == text_of[:-1], False)
                met = np.zeros((len(group), len(starts)), bool)
                for seed in seeds:
                    low = np.minimum.reduceat((s ^ seed) * U64(0x9E3779B97F4A7C15), starts)
                    both = low.copy()
                    both[:-1] = np.where(joined[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                    for k, (_, t) in enumerate(group):
                        met[k] |= both == ((t ^ seed) * U64(0x9E3779B97F4A7C15)).min()
                for k, (name, t) in enumerate(group):
                    for b in np.flatnonzero(met[k]).tolist():
                        a, z = int(starts[b]), min(int(starts[b]) + 2 * m, int(first[text_of[b] + 1]))
                        share = float(np.isin(t, s[a:z]).mean())
                        if share >= containment:
                            hit = found.setdefault((int(text_of[b]), name), [0, int(at[a] - w[text_of[b]]), 0.0])
                            hit[0] += 1
                            hit[1] = min(hit[1], int(at[a] - w[text_of[b]]))
                            hit[2] = max(hit[2], share)
            if found:
                rows = sorted(found.items())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0][0] for r in rows])), pa.array([r[0][1] for r in rows]), *(pa.array([r[1][j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], [key, "license", "n_windows", "first_word", "containment"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, license string, n_windows long, first_word long, containment double")
