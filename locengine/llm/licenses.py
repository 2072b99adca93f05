"""License scans by conditional compression.

A candidate block is the words around those that license notices use. Every template that has
nearly all its words in a block is confirmed on the words, whatever their case and spacing: it is
aligned with the block, the exact differences are listed, and it counts if nearly all its words
stand there in order and none that names the license or its version differs. The block in small
letters, with single spaces, is compressed alone and with each of these templates as a zstandard
raw dictionary. Of templates in one place the longest counts, then the one that saves most bytes
by its size. License texts are known by their titles and first sentences, those of BSD by clauses.

Null and empty texts have no license. Repeated rows are scanned one by one. Whole texts are
read; long ones have more blocks, not longer ones. Several notices in a text are all found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import product

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from locengine.llm.common import text_columns

# The wording of public licenses and of usual notices that refer to them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-4-Clause", "Licensed under the BSD 4-Clause License"),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain",
    ),
    # Titles and first sentences of license texts.
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ "
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    (
        "Apache-2.0",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution "
        "as defined by Sections 1 through 9 of this document",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "MPL-2.0",
        "\"Contributor\" means each individual or legal entity that creates, contributes to the "
        "creation of, or owns Covered Software",
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    (
        "GPL-2.0",
        "This General Public License applies to most of the Free Software Foundation's software "
        "and to any other program whose authors commit to using it",
    ),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "GPL-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds "
        "of works",
    ),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    (
        "LGPL-2.0",
        "This license, the Library General Public License, applies to some specially designated "
        "Free Software Foundation software, and to any other libraries whose authors decide to "
        "use it",
    ),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    (
        "LGPL-2.1",
        "This license, the Lesser General Public License, applies to some specially designated "
        "software packages--typically libraries--of the Free Software Foundation and other "
        "authors who decide to use it",
    ),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "LGPL-3.0",
        "This version of the GNU Lesser General Public License incorporates the terms and "
        "conditions of version 3 of the GNU General Public License",
    ),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    (
        "AGPL-3.0",
        "The GNU Affero General Public License is a free, copyleft license for software and "
        "other kinds of works",
    ),
    ("CC0-1.0", "CC0 1.0 Universal"),
]


def _gnu() -> list[tuple[str, str]]:
    """Notices of programs under the licenses of GNU, of one version or of later ones too."""
    out = []
    for name, kind, versions in (
        ("GPL", "General", ("2", "3")),
        ("LGPL", "Library General", ("2",)),
        ("LGPL", "Lesser General", ("2.1", "3")),
        ("AGPL", "Affero General", ("3",)),
    ):
        for v in versions:
            key = f"{name}-{v if '.' in v else v + '.0'}"
            terms = f"under the terms of the GNU {kind} Public License"
            issued = "as published by the Free Software Foundation"
            out += [
                (key, f"{terms} {issued}, either version {v} of the License, or (at your option) "
                 "any later version"),
                (key, f"{terms} {issued}, version {v} of the License"),
                (key, f"{terms} {issued}, version {v}"),
                (key, f"{terms} version {v} {issued}"),
                (key, f"licensed under the GNU {kind} Public License, version {v}"),
                (key, f"licensed under the GNU {kind} Public License v{v}"),
            ]
            if "." not in v:
                out.append((key, f"licensed under the GNU {kind} Public License v{v}.0"))
    return out


def _creative_commons() -> list[tuple[str, str]]:
    """Names written out, short names and addresses."""
    elements = {
        "SA": ["ShareAlike", "Share Alike"],
        "NC": ["NonCommercial", "Non Commercial"],
        "ND": ["NoDerivatives", "NoDerivs", "No Derivatives", "No Derivs", "No Derivative Works"],
    }
    out = []
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for chosen in ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND")):
            short = "-".join(("BY", *chosen))
            key = f"CC-{short}-{version}"
            out += [
                (key, f"Creative Commons {' '.join(('Attribution', *x))} {version}")
                for x in product(*(elements[e] for e in chosen))
            ]
            out.append((key, f"Licensed under CC {short} {version}"))
            out.append((key, f"creativecommons.org/licenses/{short}/{version}"))
    return out


TEMPLATES += [x for x in [*_gnu(), *_creative_commons()] if x not in TEMPLATES]
TEMPLATES += [
    (name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES})
]
# Which license of BSD a text with the common head is: the last of these that follow within words.
_BSD_HEAD, _BSD_WITHIN = "BSD-2-Clause", 300
_BSD_CLAUSES = [
    (
        "+BSD-3-Clause",
        "may be used to endorse or promote products derived from this software without specific "
        "prior written permission",
    ),
    (
        "+BSD-4-Clause",
        "All advertising materials mentioning features or use of this software must display the "
        "following acknowledgement",
    ),
]
_CUES = re.compile(
    r"licen[sc]|permission|advertising\W+materials|covered\W+software|creative\W*commons|redistribut|copyright|public\W+domain|\bcc\W*(?:by|0)\b"
    r"|\bgpl\b",
    re.IGNORECASE,
)
_WORD = re.compile(r"[\w.]*\w")
# Words that name a license, or its version: those must agree.
_NAMING = re.compile(
    r"(?:apache|mit|gnu|library|lesser|affero|general|cc|cc0|by|nc|nd|sa|bsd|mozilla|public|domain"
    r"|fee|sublicense|redistribution|unencumbered|attribution|sharealike|alike|noncommercial"
    r"|commercial|noderivatives|noderivs|derivatives?|derivs|v?\d.*|\d-clause|clause)$"
)
_BEFORE, _AFTER, _MOST = 40, 120, 800  # words
_DIFFERENCE = StructType(
    [StructField("template", StringType()), StructField("text", StringType())]
)
_FOUND = StructType(
    [
        StructField("license", StringType()),
        StructField("first", LongType()),
        StructField("after", LongType()),
        StructField("saved", DoubleType()),
        StructField("differences", ArrayType(_DIFFERENCE)),
    ]
)


def blocks(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words around cues; overlapping ones are merged up to a limit, then overlap."""
    out: list[list[int]] = []
    starts = [first for first, _ in places]
    for cue in _CUES.finditer(text):
        at = bisect_right(starts, cue.start()) - 1
        first, after = max(0, at - _BEFORE), min(len(places), at + _AFTER)
        if out and first <= out[-1][1] and after - out[-1][0] <= _MOST:
            out[-1][1] = after
        else:
            out.append([first, after])
    return [(a, b) for a, b in out]


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, share: float = 0.9):
        self.share = share
        self.alone = zstandard.ZstdCompressor(level=3)
        self.templates = []
        for name, wording in [*templates, *_BSD_CLAUSES]:
            raw = _plain(wording)
            words = [w.lower() for w in _WORD.findall(wording)]
            dictionary = zstandard.ZstdCompressionDict(
                raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            self.templates.append((name, words, len(raw), dictionary))

    def ranked(self, block: str, words: list[str]) -> list[tuple[float, str, list[str]]]:
        """Templates that may stand in the block, the longest first, then by saved share of bytes."""
        known = set(words)
        possible = [
            t for t in self.templates if sum(w in known for w in t[1]) >= self.share * len(t[1])
        ]
        if not possible:
            return []
        raw = _plain(block)
        plain = len(self.alone.compress(raw))
        out = []
        for name, template, size, dictionary in possible:
            coder = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
            out.append(((plain - len(coder.compress(raw))) / size, name, template))
        return sorted(out, key=_rank)

    def scan(self, text: str) -> list[dict]:
        """Confirmed notices by position; a word counts for one notice, the longest first."""
        if not _CUES.search(text):
            return []
        every = [m.span() for m in _WORD.finditer(text)]
        places = []
        for a, b in blocks(text, every):
            words = [text[x:y].lower() for x, y in every[a:b]]
            for ranked in self.ranked(text[every[a][0] : every[b - 1][1]], words):
                for first, after, differences in confirmed(ranked[2], words, self.share):
                    places.append((_rank(ranked), a + first, a + after, ranked, differences))
        taken: set[int] = set()
        found = []
        for _, first, after, (saved, name, template), differences in sorted(
            places, key=lambda x: x[:3]
        ):
            span = range(first, after)
            if taken.isdisjoint(span):
                taken.update(span)
                found.append((first, after, name, saved, template, differences))
        return self._notices(sorted(found, key=lambda x: x[0]), every)

    @staticmethod
    def _notices(found: list[tuple], every: list[tuple[int, int]]) -> list[dict]:
        """Found notices with spans in the text; clauses of BSD name and extend their head."""
        out: list[dict] = []
        head = -1  # place of the word that ended the head
        for first, after, name, saved, template, differences in found:
            if name.startswith("+"):
                if 0 <= head and first - head <= _BSD_WITHIN:
                    out[-1]["license"] = max(out[-1]["license"], name[1:])
                    out[-1]["after"] = every[after - 1][1]
                    out[-1]["differences"] += differences
                continue
            head = after if name == _BSD_HEAD and template[0] == "redistribution" else -1
            out.append(
                {
                    "license": name,
                    "first": every[first][0],
                    "after": every[after - 1][1],
                    "saved": float(saved),
                    "differences": differences,
                }
            )
        return out


def _rank(x: tuple[float, str, list[str]]) -> tuple:
    return -len(x[2]), -x[0], x[1]


def aligned(template: list[str], words: list[str], share: float):
    """The template's words that stand in order at the start of `words`, the end of the place
    and the differences; None unless enough stand there and no naming word differs."""
    if (Counter(template) & Counter(words)).total() < share * len(template):
        return None
    found = SequenceMatcher(None, template, words, autojunk=False)
    same = [m for m in found.get_matching_blocks() if m.size]
    matched = sum(m.size for m in same)
    if matched < share * len(template):
        return None
    after, differences = same[-1].b + same[-1].size, []
    for kind, i, j, k, m in found.get_opcodes():
        if kind == "equal" or k >= after and i == j:
            continue
        own, other = template[i:j], words[k : min(m, after)]
        if any(_NAMING.match(w) for w in [*own, *other]):
            return None
        differences.append({"template": " ".join(own), "text": " ".join(other)})
    return matched, after, differences


def confirmed(template: list[str], words: list[str], share: float = 0.9):
    """Places at which the template stands, with the exact differences of wording."""
    n = len(template)
    slack = max(2, n // 5)
    heads = set(template[: n - int(share * n) + 1])  # a place starts with one of them
    starts = [i for i, w in enumerate(words) if w in heads]
    past = 0
    for i, at in enumerate(starts):
        if at < past:
            continue
        # Of starts close to each other, the one with most words of the template and fewest others.
        near = [x for x in starts[i:] if x <= at + slack]
        tried = [(x, aligned(template, words[x : x + n + slack], share)) for x in near]
        good = [(2 * f[0] - f[1], -x, f) for x, f in tried if f]
        if good:
            _, x, (_, after, differences) = max(good, key=lambda g: g[:2])
            yield -x, after - x, differences
            past = after - x


@lru_cache(1)
def _scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with licenses (each with span in code points, saved share, differences) and
    license, the first one's name or null. Columns of the input with these names are replaced."""

    def compute(raws):
        scanner = _scanner()
        return [[scanner.scan(r.decode("utf-8", "replace")) if r else [] for r in raws]]

    made = text_columns(docs, text, [StructField("licenses", ArrayType(_FOUND))], compute)
    return made.withColumn("license", F.try_element_at("licenses", F.lit(1))["license"])
