"""License scan: templates found in text windows by MinHash bands, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrays import Words, fold_table, mix, owners, shingles, slices, text_bytes

SHINGLE = 5
MOST_TEMPLATES = 100_000

# Notices in the usual wording of each license.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _gnu(what: str, name: str, version: str) -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


def _gnu_only(what: str, name: str, version: str) -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of version {version} of the GNU {name} as published by the Free Software Foundation."


# Header notices of further licenses and versions.
TEMPLATES |= {
    "agpl-3.0": _gnu("program", "Affero General Public License", "3"),
    "gpl-1.0": _gnu("program", "General Public License", "1"),
    "gpl-2.0": _gnu("program", "General Public License", "2"),
    "gpl-2.0-only": _gnu_only("program", "General Public License", "2"),
    "gpl-3.0-only": _gnu_only("program", "General Public License", "3"),
    "lgpl-2.0": _gnu("library", "Library General Public License", "2"),
    "lgpl-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "lgpl-2.1-only": _gnu_only("library", "Lesser General Public License", "2.1"),
    "lgpl-3.0": _gnu("program", "Lesser General Public License", "3"),
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "boost-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/',
}
for _code, _kind in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version, _where in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES[f"cc-{_code}-{_version}"] = f"This work is licensed under a Creative Commons {_kind if _version == '4.0' else _kind.replace('NoDerivatives', 'NoDerivs')} {_version} {_where} License."

# Whole texts, by file name; those that differ from another one in a few places are made from it.
TEMPLATES |= {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files("corpusforge.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}
_NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
_NETWORK = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. """
_head, _tail = TEMPLATES["bsd-2-clause"].split("THIS SOFTWARE", 1)
TEMPLATES["bsd-3-clause"] = f"{_head}3. {_NO_ENDORSEMENT}THIS SOFTWARE{_tail}"
TEMPLATES["bsd-4-clause"] = f"{_head}3. {_ADVERTISING}4. {_NO_ENDORSEMENT}THIS SOFTWARE{_tail}"
_head, _tail = TEMPLATES["gpl-3.0-text"].split("13. Use with", 1)
_affero = lambda text: text.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL", "GNU AFFERO GENERAL")
TEMPLATES["agpl-3.0-text"] = _affero(_head) + _NETWORK + "14. Revised" + _affero(_tail.split("14. Revised", 1)[1])


@dataclass
class Class:
    """Templates of one shingle size and like length: windows of 3 * stride shingles, `bands` hashes, one a band."""

    shingle: int
    stride: int
    bands: int
    names: list[str]
    sets: list[np.ndarray]
    minima: np.ndarray


def bands_for(similarity: float, miss: float) -> int:
    """Bands of one hash so that a window of that similarity is missed with at most this probability."""
    return 1 if similarity >= 1 else ceil(log(miss) / log(1 - similarity))


def _multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _order(hashes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """Ranks of shingles under one hash function."""
    x = hashes * multiplier
    return x ^ (x >> np.uint64(32))


def prepare(templates: dict[str, str], threshold: float, miss: float) -> list[Class]:
    """Group templates by shingle size and length, and choose each group's windows and bands.

    A group of stride s takes templates of s + 1 to 2 * s shingles (1 and 2 for the least), so each lies
    whole in a window of 3 * s. The least similarity of such a window to a template it contains
    up to the threshold sets the number of bands.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]), fold_table(alphanumeric=True))
        size = min(SHINGLE, len(words.start))
        if size:
            found = np.unique(shingles(words.hashes(), words.first, size)[0])
            stride = 1
            while 2 * stride < len(found):
                stride *= 2
            groups.setdefault((size, stride), []).append((name, found))
    out = []
    for (size, stride), members in sorted(groups.items()):
        least = min(ceil(threshold * len(s) - 1e-9) / (3 * stride + len(s) - ceil(threshold * len(s) - 1e-9)) for _, s in members)
        bands = bands_for(least, miss)
        minima = np.array([[_order(s, m).min() for _, s in members] for m in _multipliers(bands)])
        out.append(Class(size, stride, bands, [n for n, _ in members], [s for _, s in members], minima))
    return out


def _candidates(found: np.ndarray, group: Class) -> tuple[np.ndarray, np.ndarray]:
    """(window, template) pairs that share a band; window w is shingles w * stride to (w + 3) * stride."""
    blocks = -(-len(found) // group.stride)
    padded = np.full(blocks * group.stride, found[-1] if len(found) else 0, np.uint64)
    padded[: len(found)] = found
    hits = []
    for multiplier, minima in zip(_multipliers(group.bands), group.minima):
        least = _order(padded, multiplier).reshape(blocks, group.stride).min(1)
        # A window shorter than three blocks stands at the end.
        tail = np.concatenate([least, np.full(2, np.iinfo(np.uint64).max, np.uint64)])
        window = np.minimum(np.minimum(tail[:-2], tail[1:-1]), tail[2:])
        order = np.argsort(minima, kind="stable")
        spot = np.searchsorted(minima[order], window)
        for w in np.flatnonzero(minima[order][np.minimum(spot, len(minima) - 1)] == window):
            at = spot[w]
            while at < len(minima) and minima[order[at]] == window[w]:
                hits.append((int(w), int(order[at])))
                at += 1
    pairs = np.unique(np.array(hits, np.int64).reshape(-1, 2), axis=0)
    return pairs[:, 0], pairs[:, 1]


def scan_texts(raw: np.ndarray, offsets: np.ndarray, classes: list[Class], threshold: float) -> list[tuple[int, str, float, int, int]]:
    """(text, template, containment, start, end in bytes of the text) of every place a template stands."""
    words = Words(raw, offsets, fold_table(alphanumeric=True))
    hashes = words.hashes()
    by_size = {size: shingles(hashes, words.first, size) for size in {c.shingle for c in classes}}
    out = []
    for group in classes:
        found, place = by_size[group.shingle]
        text = owners(words.first, place)
        spans: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for window, number in zip(*(x.tolist() for x in _candidates(found, group))):
            lo, hi = window * group.stride, min((window + 3) * group.stride, len(found))
            held = np.flatnonzero(np.isin(found[lo:hi], group.sets[number])) + lo
            for owner in np.unique(text[held]):
                own = held[text[held] == owner]
                share = len(np.unique(found[own])) / len(group.sets[number])
                if share >= threshold - 1e-9:
                    spans.setdefault((int(owner), number), []).append((int(own[0]), int(own[-1]), share))
        for (owner, number), places in spans.items():
            places.sort()
            joined = [list(places[0])]
            for first, last, share in places[1:]:
                if first <= joined[-1][1]:
                    joined[-1][1], joined[-1][2] = max(joined[-1][1], last), max(joined[-1][2], share)
                else:
                    joined.append([first, last, share])
            base = int(offsets[owner])
            for first, last, share in joined:
                out.append((owner, group.names[number], share, int(words.start[place[first]]) - base, int(words.end[place[last] + group.shingle - 1]) - base))
    return sorted(_best(out, {n: len(s) for c in classes for n, s in zip(c.names, c.sets)}), key=lambda r: (r[0], r[3], r[1]))


def _best(rows: list[tuple[int, str, float, int, int]], sizes: dict[str, int]) -> list[tuple[int, str, float, int, int]]:
    """Of places in a text that overlap by half of the shorter, the one with most shingles found, then the best contained."""
    kept: dict[int, list[tuple[int, str, float, int, int]]] = {}
    for row in sorted(rows, key=lambda r: (r[0], -round(r[2] * sizes[r[1]]), -r[2], r[1])):
        own = kept.setdefault(row[0], [])
        if all(2 * (min(row[4], o[4]) - max(row[3], o[3])) < min(row[4] - row[3], o[4] - o[3]) for o in own):
            own.append(row)
    return [row for own in kept.values() for row in own]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """Rows doc_id, license, containment, start_byte, end_byte for each place a template stands in a document.

    Words are letters and digits in lower case; shingles have five words, a shorter template is one
    shingle. Overlapping windows cover every text; a window that holds the share `threshold` of a
    template's distinct shingles is retrieved with probability 1 - `miss` at least, then checked exactly.
    Matching windows that share a shingle are one place. Where templates overlap (versions of one license,
    a notice inside a whole text) the one with most shingles found is reported. Nothing is shuffled; templates are a bounded
    list that travels with the code.

    Null, empty and wordless texts match nothing, nor do templates without a word. Null ids stay, repeated
    rows give their rows each, an empty table gives none, other columns are not looked at.
    """
    classes = prepare(TEMPLATES if templates is None else templates, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        for batch in slices(batches, most=2 << 20):
            found = scan_texts(*text_bytes(batch.column("text")), classes, threshold)
            ids = batch.column("doc_id").to_pylist()
            columns = list(zip(*((ids[r[0]], *r[1:]) for r in found))) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "containment", "start_byte", "end_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, containment double, start_byte long, end_byte long")
