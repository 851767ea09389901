"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies.

Templates are grouped in classes of size. For each class a text is cut into overlapping windows of as
many shingles as its largest template has; a window and a template that agree on a band are a
candidate. Then the share of the template's shingles that lie in the window and its
surroundings is counted exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_or_empty
from .words import alnum_hashes, mixed, shingle_hashes

# License notices and statements, as they are commonly written.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: Words of a shingle, and the share of a template's shingles that a match must hold.
SHINGLE, CONTAINED = 5, 0.8
#: The probability with which the bands must find a template that is contained just so, in the worst place.
FOUND = 0.999


def bands_for(size: int, window: int, stride: int, contained: float = CONTAINED, found: float = FOUND) -> int:
    """Bands of one row that find a template of `size` shingles with that probability, if just the least share of it is there.

    The best window misses at most half a stride of the template; bands of one row reach the probability
    with the fewest hashes, and what they find too much is verified anyway.
    """
    common = max(1, math.ceil(contained * size) - stride // 2)
    similar = common / (window + size - common)
    return 1 if similar >= 1 else math.ceil(math.log(1 - found) / math.log(1 - similar))


@dataclass(frozen=True)
class Window:
    """Windows for templates of up to `size` shingles: for each band a table of low bits and the templates by value."""

    size: int
    stride: int
    lookup: tuple[np.ndarray, ...]
    owners: tuple[dict[int, list[int]], ...]


@dataclass(frozen=True)
class Templates:
    names: list[str]
    shingles: list[np.ndarray]
    windows: list[Window]
    seeds: np.ndarray


def _size_class(n: int) -> int:
    """Up to four shingles a class of their own, as all must be there; then one for each doubling."""
    return n if n <= 4 else 4 + (n - 1).bit_length()


def _hashed(items: np.ndarray, seed: np.uint64) -> np.ndarray:
    return (((items ^ seed) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def compiled(templates: dict[str, list[str]], k: int = SHINGLE) -> Templates:
    """Shingles and windows for every template. A template of fewer than k words is one shingle of all of them."""
    names, sets = [], []
    for name, texts in templates.items():
        for text in texts:
            items = np.unique(shingle_hashes(alnum_hashes(text), k))
            if len(items):
                names.append(name)
                sets.append(items)
    plans = []
    for kind in sorted({_size_class(len(s)) for s in sets}):
        own = [j for j, s in enumerate(sets) if _size_class(len(s)) == kind]
        window = max(len(sets[j]) for j in own)
        stride = max(1, window // 4)
        plans.append((own, window, stride, max(bands_for(len(sets[j]), window, stride) for j in own)))
    seeds = mixed(np.arange(1, max((p[3] for p in plans), default=0) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    windows = []
    for own, window, stride, bands in plans:
        lookup, owners = [], []
        for seed in seeds[:bands]:
            table, by = np.zeros(1 << 16, bool), {}
            for j in own:
                value = int(_hashed(sets[j], seed).min())
                table[value & 0xFFFF] = True
                by.setdefault(value, []).append(j)
            lookup.append(table)
            owners.append(by)
        windows.append(Window(window, stride, tuple(lookup), tuple(owners)))
    return Templates(names, sets, windows, seeds)


def _minima(values: np.ndarray, size: int, stride: int) -> np.ndarray:
    """The minimum over each window of `size`, at every stride; the last window ends with the values."""
    n = len(values)
    if n <= size:
        return values.min(keepdims=True)
    reach, least = 1, values
    while reach < size:
        step = min(reach, size - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    out = least[::stride]
    return out if (n - size) % stride == 0 else np.append(out, least[-1])


#: Shingles of several texts that are looked through at once.
AT_ONCE = 1 << 16


def retrieved(items: np.ndarray, templates: Templates) -> set[tuple[int, int, int]]:
    """(template, first shingle of the window, its size): windows that share a band with a template."""
    found: set[tuple[int, int, int]] = set()
    for b, seed in enumerate(templates.seeds):
        values = _hashed(items, seed)
        for w in templates.windows:
            if b < len(w.owners):
                marks = _minima(values, w.size, w.stride)
                for at in np.flatnonzero(w.lookup[b][marks & np.uint32(0xFFFF)]).tolist():
                    for owner in w.owners[b].get(int(marks[at]), ()):
                        found.add((owner, min(at * w.stride, max(0, len(items) - w.size)), w.size))
    return found


def matches_of(texts: list[str], templates: Templates, contained: float = CONTAINED, k: int = SHINGLE) -> list[list[tuple[str, int, int, float]]]:
    """For each text (license, first word, end word, containment): the spans that hold one of a license's templates, overlapping ones as one.

    Texts are looked through one after another as one sequence; a window over two texts counts for both,
    and what it retrieves is verified inside each.
    """
    out: list[list] = []
    held: list[tuple[int, np.ndarray]] = []

    def emptied():
        if held:
            ends = np.cumsum([len(x) for _, x in held])
            each: list[set] = [set() for _ in held]
            if ends[-1]:
                for owner, start, size in retrieved(np.concatenate([x for _, x in held]), templates):
                    first, last = np.searchsorted(ends, (start, min(start + size, int(ends[-1])) - 1), side="right")
                    for t in range(int(first), int(last) + 1):
                        each[t].add((owner, start - int(ends[t]) + len(held[t][1]), size))
            for (n, items), found in zip(held, each, strict=True):
                out.append(_verified(items, n, found, templates, contained, k))
            held.clear()

    waiting = 0
    for text in texts:
        words = alnum_hashes(text)
        held.append((len(words), shingle_hashes(words, k)))
        waiting += len(held[-1][1])
        if waiting > AT_ONCE:
            emptied()
            waiting = 0
    emptied()
    return out


def _verified(items: np.ndarray, n_words: int, found: set[tuple[int, int, int]], templates: Templates, contained: float, k: int) -> list[tuple[str, int, int, float]]:
    spans: dict[str, list[tuple[int, int, float]]] = {}
    for owner, start, size in found:
        own = templates.shingles[owner]
        low, high = max(0, start - size // 2), max(0, start + size + size // 2 + 1)
        at = np.flatnonzero(np.isin(items[low:high], own)) + low
        share = len(np.intersect1d(items[low:high], own)) / len(own)
        if len(at) and share >= contained:
            spans.setdefault(templates.names[owner], []).append((int(at[0]), int(at[-1]) + min(k, n_words), share))
    out = []
    for name, some in spans.items():
        some.sort()
        start, end, best = some[0]
        for s, e, share in some[1:]:
            if s < end:
                end, best = max(end, e), max(best, share)
            else:
                out.append((name, start, end, best))
                start, end, best = s, e, share
        out.append((name, start, end, best))
    return sorted(out, key=lambda x: (x[1], x[0]))


def license_spans(df: DataFrame, templates: dict[str, list[str]] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_matches, licenses (names, sorted, comma-joined), spans (license:first word:end word:containment).

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Whole texts are
    scanned; null counts as empty and has no match. Repeated rows are repeated; other columns are not looked at.
    """
    ready = compiled(templates or TEMPLATES)

    def run(batches):
        for batch in batches:
            found = matches_of(batch.column(1).to_pylist(), ready, contained)
            names = [",".join(sorted({m[0] for m in some})) for some in found]
            spans = [",".join(f"{n}:{s}:{e}:{share:.4f}" for n, s, e, share in some) for some in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(some) for some in found], pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())], names=["id", "n_matches", "licenses", "spans"])

    out = df.select(df[id_col].cast("long").alias("id"), text_or_empty(df, text_col).alias("text"))
    return out.mapInArrow(run, "id long, n_matches long, licenses string, spans string").withColumnRenamed("id", id_col)
