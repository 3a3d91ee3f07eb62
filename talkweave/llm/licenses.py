"""License notices in texts: winnowed fingerprints of templates pick places, banded alignment measures them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .ragged import SLICE, Words, fold, text_slices

GRAM = 3              # words of a fingerprint
WINDOW = 4            # of so many neighbouring fingerprints the smallest is kept: a shared run of GRAM + WINDOW - 1 words is found
SHORT = 24            # templates of fewer words keep all their fingerprints, and so do the texts for them
COVERAGE = 0.8        # least share of a template's words that is matched
# Words that do not tell one license from another; all other words of a template of fewer than SHORT words must be in the place, and no others.
FILLERS = "this work is are was licensed released available distributed under the terms of license version v a an"
SLACK = 0.25          # width of the band, in template lengths

# The wording of public licenses' notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


@dataclass
class Templates:
    names: list[str]
    words: list[np.ndarray]
    gram: np.ndarray       # sorted fingerprints
    owner: np.ndarray      # template of each
    place: np.ndarray      # where in the template it stands
    every: np.ndarray      # whether it is one of a short template, looked for among all fingerprints of a text
    fillers: np.ndarray

    def tells(self, k: int, place: np.ndarray) -> bool:
        """Whether ``place`` has the words of a short template that tell it from others: all of them, in order, and no others."""
        own = self.words[k]
        return len(own) >= SHORT or np.array_equal(own[~np.isin(own, self.fillers)], place[~np.isin(place, self.fillers)])


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that are the smallest, the last among equals, of some ``window`` neighbouring hashes."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], 1))


def _split(texts: pa.Array, limit: int):
    for row, data, bounds in text_slices(pc.utf8_lower(texts), limit):
        yield row, data, bounds, Words(data, bounds, punctuation=False)


def read_templates(templates: dict[str, str]) -> Templates:
    names, words, parts = list(templates), [], []
    hashes = lambda text: np.concatenate([w.hash for *_, w in _split(pa.array([text]), 1 << 60)])
    for k, name in enumerate(names):
        own = hashes(templates[name])
        if len(own) < GRAM:
            raise ValueError(f"template {name} has fewer than {GRAM} words")
        grams = fold(own, GRAM)
        short = len(own) < SHORT
        place = np.arange(len(grams)) if short else winnow(grams)
        words.append(own)
        parts.append((grams[place], np.full(len(place), k), place, np.full(len(place), short)))
    gram, owner, place, every = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    return Templates(names, words, gram[order], owner[order], place[order], every[order], hashes(FILLERS))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matches, first, last + 1 in the text) of the best local alignment whose text position less template position stays
    within ``band`` of ``shift``. A match counts 1, a miss or gap -1; a template row is worked off at once."""
    width = 2 * band + 1
    best, found = 0, (0, 0, 0)
    score, start, match = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
    for i, word in enumerate(template):
        at = i + shift + np.arange(-band, band + 1)
        inside = (at >= 0) & (at < len(text))
        hit = inside & (text[np.clip(at, 0, len(text) - 1)] == word)
        fresh = score <= 0
        now = np.where(fresh, 0, score) + np.where(hit, 1, -1)
        begun = np.where(fresh, at, start)
        count = np.where(fresh, 0, match) + hit
        up = np.append(score[1:] - 1, -1)          # a template word without a partner
        better = up > now
        now, begun, count = np.where(better, up, now), np.where(better, np.append(start[1:], 0), begun), np.where(better, np.append(match[1:], 0), count)
        lead = np.maximum.accumulate(now + np.arange(width))      # text words without a partner
        source = np.maximum.accumulate(np.where(now + np.arange(width) == lead, np.arange(width), 0))
        now = np.where(inside, lead - np.arange(width), 0)
        begun, count = begun[source], count[source]
        score, start, match = now, begun, count
        k = int(np.argmax(score))
        if score[k] > best:
            best, found = int(score[k]), (int(match[k]), int(start[k]), int(at[k]) + 1)
    return found


def _candidates(words: Words, t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, template, shift) of places where a fingerprint of a text is one of a template; shift counts in the slice."""
    grams = fold(words.hash, GRAM)
    whole = words.doc[:len(grams)] == words.doc[GRAM - 1:] if len(grams) else np.empty(0, bool)
    at = np.minimum(np.searchsorted(t.gram, grams), len(t.gram) - 1)
    hit = np.flatnonzero((t.gram[at] == grams) & whole)
    if not len(hit):
        return hit, hit, hit
    docs = np.unique(words.doc[hit])
    first = np.searchsorted(words.doc, np.append(docs, words.docs))
    last = np.searchsorted(words.doc, docs, "right")
    kept = np.zeros(len(grams), bool)
    for lo, hi in zip(first[:-1], last, strict=True):
        if hi - lo >= GRAM:
            kept[lo + winnow(grams[lo:hi - GRAM + 1])] = True
    size = np.searchsorted(t.gram, grams[hit], "right") - np.searchsorted(t.gram, grams[hit])
    row = np.repeat(np.searchsorted(t.gram, grams[hit]), size) + np.arange(size.sum()) - np.repeat(np.append(0, size.cumsum())[:-1], size)
    pos = np.repeat(hit, size)
    use = t.every[row] | kept[pos]
    return words.doc[pos[use]], t.owner[row[use]], pos[use] - t.place[row[use]]


def _best(rows: list[tuple]) -> list[tuple]:
    """Of places (document, template, coverage, identity, first, last) that overlap one after the other, the best, the first among equals."""
    out: list[tuple] = []
    for r in sorted(set(rows), key=lambda r: (r[0], r[1], r[4], r[5])):
        if out and out[-1][:2] == r[:2] and r[4] < out[-1][5]:
            if r[2:4] > out[-1][2:4]:
                out[-1] = r
        else:
            out.append(r)
    return out


def _outdone(rows: list[tuple], short: list[bool]) -> list[tuple]:
    """Places without those of a short template that overlap a place of another with more coverage."""
    out, reach = [], []
    for r in sorted(rows, key=lambda r: (r[0], r[4])):
        reach = [x for x in reach if x[0] == r[0] and x[5] > r[4]]
        if short[r[1]]:
            if any(x[2] > r[2] for x in reach):
                continue
            worse = [x for x in reach if x[2] < r[2]]
            out, reach = [x for x in out if x not in worse] if worse else out, [x for x in reach if x not in worse]
            reach.append(r)
        out.append(r)
    return out


def _scanned(batches, held):
    t = held.value
    for batch in batches:
        for row, data, bounds, words in _split(batch.column("text"), SLICE):
            doc, owner, shift = _candidates(words, t)
            if not len(doc):
                continue
            edge = np.append(0, words.counts().cumsum())
            rows = []
            order = np.lexsort((shift, owner, doc))
            last = None
            for k in order:
                d, o, s = int(doc[k]), int(owner[k]), int(shift[k])
                band = max(2, int(SLACK * len(t.words[o])))
                if last and last[:2] == (d, o) and s - last[2] <= band:      # one place, one alignment
                    continue
                last = (d, o, s)
                text = words.hash[edge[d]:edge[d + 1]]
                match, lo, hi = align(t.words[o], text, s - int(edge[d]), 2 * band)
                if match >= COVERAGE * len(t.words[o]) and t.tells(o, text[lo:hi]):
                    rows.append((d, o, match / len(t.words[o]), match / max(1, hi - lo), lo, hi))
            rows = _outdone(_best(rows), [len(w) < SHORT for w in t.words])
            if not rows:
                continue
            begin, end = [], []
            for d, _, _, _, lo, hi in rows:
                a, b = int(words.start[edge[d] + lo]), int(words.end[edge[d] + hi - 1])
                text = data[bounds[d]:b]
                letters = np.append(0, ((text & 0xC0) != 0x80).cumsum())
                begin.append(int(letters[a - bounds[d]]))
                end.append(int(letters[b - bounds[d]]))
            yield pa.record_batch([batch.column("doc_id").take(pa.array([row + r[0] for r in rows])), pa.array([t.names[r[1]] for r in rows]),
                                   pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.int64()),
                                   pa.array([r[5] for r in rows], pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                                  names=["doc_id", "license", "coverage", "identity", "first_word", "last_word", "first_char", "last_char"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each place of a text that matches a template by COVERAGE of its words or more: doc_id, license, coverage
    (matched share of the template), identity (matched share of the place), and the place in words and in characters of
    the lower-cased text (ends excluded).

    A template of fewer than SHORT words also needs its telling words (name, version, NC, SA, ND) in the place, and no others.
    Words are runs of letters and digits in lower case. Of overlapping places of one template the best is reported; those
    of several templates are all reported, but of short ones only the best. Texts that are null, empty or shorter than three words hold no place; a
    repeated document is reported for each of its rows; an empty table gives an empty result. ``templates`` (name ->
    text, at least three words each) are broadcast: they are parameters, not data.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_templates(TEMPLATES if templates is None else templates))
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scanned, held=held), "doc_id long, license string, coverage double, identity double, first_word long, last_word long, first_char long, last_char long")
