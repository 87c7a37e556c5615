"""Licence recognition: sentences to known sentence identifiers, sequences of identifiers to ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import common

#: Sentences that a rule's next sentence may lie behind the one before.
GAP = 4

# Sentences of public licence texts and notices as they are commonly written.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-2": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-notice": "Licensed under CC0 1.0.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
#: rule: licence, its sentences in order. A rule of more sentences says more than one of fewer.
RULES = {
    "mit-text": ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    "mit-short": ("MIT", ["mit-grant", "mit-condition"]),
    "mit-titled": ("MIT", ["mit-title", "mit-grant"]),
    "mit-titled-2": ("MIT", ["mit-title-2", "mit-grant"]),
    "mit-notice": ("MIT", ["mit-notice"]),
    "mit-notice-2": ("MIT", ["mit-notice-2"]),
    "isc-text": ("ISC", ["isc-grant"]),
    "apache-header": ("Apache-2.0", ["apache-header", "apache-compliance", "apache-copy"]),
    "apache-header-short": ("Apache-2.0", ["apache-header", "apache-compliance"]),
    "apache-notice": ("Apache-2.0", ["apache-notice"]),
    "gpl3-header": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    "gpl3-header-short": ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    "gpl3-notice": ("GPL-3.0", ["gpl3-notice"]),
    "gpl2-notice": ("GPL-2.0", ["gpl2-notice"]),
    "bsd3-text": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "bsd2-text": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    "bsd-notice": ("BSD", ["bsd-notice"]),
    "cc-by-notice": ("CC-BY-4.0", ["cc-by-notice"]),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    "cc0-notice": ("CC0-1.0", ["cc0-notice"]),
    "mpl-notice": ("MPL-2.0", ["mpl-notice"]),
    "unlicense-notice": ("Unlicense", ["unlicense-notice"]),
    "reserved": ("Proprietary", ["reserved"]),
}

#: Known sentences part at a line's end or after one of these marks and white space.
BREAK = r"(?<=[.!?:;])[\x20\x09-\x0D]+|[\n\r]+"


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


@lru_cache
def known() -> tuple[tuple[str, str], ...]:
    """Normalised sentences and their identifiers. A known sentence that breaks itself is known by its parts: identifier/part."""
    out = []
    for name, text in SENTENCES.items():
        parts = [p for p in map(normal, re.split(BREAK, text)) if p]
        out.extend((p, name if len(parts) == 1 else f"{name}/{k}") for k, p in enumerate(parts))
    return tuple(out)


@lru_cache
def steps(rule: str) -> tuple[str, ...]:
    """The identifiers of a rule's sentences, those that break by their parts."""
    ids = [i for _, i in known()]
    return tuple(i for s in RULES[rule][1] for i in ids if i == s or i.startswith(f"{s}/"))


def match(hits: list[tuple[int, str]], gap: int = GAP) -> list[tuple[str, str, int, int]]:
    """Rules found in `hits` (position, identifier; ascending): licence, rule, first and last position.

    From each occurrence of a rule's first identifier the next ones are looked for, each at the nearest position, at most
    `gap` sentences on. A match within the span of one of a rule with more sentences is left out.
    """
    where: dict[str, list[int]] = {}
    for pos, ident in hits:
        where.setdefault(ident, []).append(pos)
    found = []
    for rule, (licence, _) in RULES.items():
        first, *rest = steps(rule)
        for start in where.get(first, ()):
            at = start
            for ident in rest:
                spots = where.get(ident, ())
                k = bisect_right(spots, at)
                if k == len(spots) or spots[k] > at + gap:
                    break
                at = spots[k]
            else:
                found.append((licence, rule, start, at))
    # by number of sentences: where its matches begin, ascending, and the furthest end up to each
    sized: dict[int, list[tuple[int, int]]] = {}
    for _, rule, start, end in found:
        sized.setdefault(len(steps(rule)), []).append((start, end))
    reach = {n: ([s for s, _ in sorted(v)], list(accumulate((e for _, e in sorted(v)), max))) for n, v in sized.items()}

    def inner(rule: str, start: int, end: int) -> bool:
        own = len(steps(rule))
        return any(n > own and (k := bisect_right(starts, start)) and ends[k - 1] >= end for n, (starts, ends) in reach.items())

    return sorted((x for x in found if not inner(*x[1:])), key=lambda x: (x[2], x[3], x[1]))


MATCH = pa.struct([("licence", pa.string()), ("rule", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
#: What stands before the text of a line in a comment.
PREFIX = re.compile(r"^[\x20\x09]*(?:(?:<!--|[/*#;%!>|:-]+|dnl\b|rem\b)[\x20\x09]*)+", re.I)
#: Sentences end within a line after one of these marks and white space, or at the line's end.
MARKED = re.compile(r"(?<=[.!?:;])[\x20\x09\x0B\x0C]+")
#: Bytes as `normal` takes them, but for runs of spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


@lru_cache
def _tables() -> tuple[dict[str, str], list[str]]:
    """Identifiers by normalised sentence, and the sentences in order."""
    ids = dict(known())
    return ids, sorted(ids)


def fragments(text: str) -> list[tuple[str, int]]:
    """The parts of lines between marks, normalised, and what ends each: 2 a mark, 1 a blank line, 0 a line feed. Comment prefixes are left out."""
    out: list[tuple[str, int]] = []
    for line in re.split("\r\n|\n|\r", text):
        parts = [x for x in MARKED.split(PREFIX.sub("", line)) if x.strip()]
        words = [(normal(x), 2 if x.rstrip()[-1] in ".!?:;" else 0) for x in parts]
        if not any(w for w, _ in words):
            if out:
                out[-1] = (out[-1][0], max(out[-1][1], 1))
            continue
        out.extend(words)
    return out


def sentence_hits(text: str) -> list[tuple[int, str]]:
    """position, identifier: the known sentences of a text, at their number among its sentences.

    Sentences end at marks and blank lines; single line feeds within one are spaces. A known sentence begins where a line or
    sentence does and ends where one does, so titles without a mark are found on a line of their own; the longest counts. A
    blank line may stand within a known sentence, as before the address in the Apache header.
    """
    ids, ordered = _tables()
    parts = fragments(text)
    hits, number, k, fresh = [], -1, 0, True
    while k < len(parts):
        now, best = "", None
        for j in range(k, len(parts)):
            now = f"{now} {parts[j][0]}".strip()
            at = bisect_left(ordered, now)
            if at == len(ordered) or not ordered[at].startswith(now):
                break
            if now in ids:
                best = j
                ident = ids[now]
            if parts[j][1] == 2:
                break
        if best is None:
            number += fresh
            fresh = parts[k][1] > 0
            k += 1
        else:
            number += 1
            hits.append((number, ident))
            k, fresh = best + 1, True
    return hits


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, n_sentences (known ones), licences (sorted, distinct), matches (licence, rule, first, last): one row for each row of `docs` (doc_id, text).

    Sentences of the whole text, wrapped over lines or not, are normalised (a-z and digits in lower case) and looked up in a
    fixed table; the identifiers of a document, in order, are matched against the rules. Nothing is exchanged.

    Null and empty texts, and texts without known sentences: 0 and empty arrays. Null doc_id and repeated rows: judged by
    their own text. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = [f" {p} ".encode() for p in _tables()[1]]
        for batch in batches:
            sizes, licences, matches = [], [], []
            for text in batch.column(1):
                raw = text.as_py() or ""
                hits: list[tuple[int, str]] = []
                found: list[tuple[str, str, int, int]] = []
                # known words in a row, wherever lines end; comment words are looked for only where there may be some
                flat = b" " + b" ".join(raw.encode().translate(PLAIN).split()) + b" "
                if any(p in flat for p in probes) or b" dnl " in flat or b" rem " in flat:
                    hits = sentence_hits(raw)
                    found = match(hits, gap)
                sizes.append(len(hits))
                licences.append(sorted({m[0] for m in found}))
                matches.append([dict(zip(("licence", "rule", "first", "last"), m)) for m in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(licences, pa.list_(pa.string())), pa.array(matches, pa.list_(MATCH))], names=["doc_id", "n_sentences", "licences", "matches"])

    schema = StructType.fromDDL("n_sentences long, licences array<string>, matches array<struct<licence: string, rule: string, first: int, last: int>>")
    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], *schema]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
