"""Tokenizing by a byte-level BPE file: whole texts at once, long ones in parts that no token and no pattern crosses."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken

#: Characters of a text that are encoded at once, about.
PART = 1 << 17

#: White space, and what some library takes for it; zero-width and control characters to be safe.
_SPACE = r"\x00-\x20\x7f\x85\xa0 ᠎ -‏ -  -⁤　﻿"
_CUT = re.compile(rf"(?<=[^{_SPACE}])(?= )")


class ByteUnits:
    """Ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # the printable stand-ins of bytes, in the order of the byte-level alphabet
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in model["added_tokens"]):
            raise ValueError("added tokens that take in or depend on their surroundings aren't known here")
        self.added = {s: array("I", [i]).tobytes() for s, i in special.items()}
        self.added_re = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        # ids are ordered as merges are, so ids serve as ranks
        self.engine = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max([*model["model"]["vocab"].values(), *special.values()]) + 1
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> bytes:
        return array("I", self.engine.encode_ordinary(text)).tobytes()

    def document(self, text: str) -> bytes:
        """The ids of a whole text in which the file's added tokens stand for themselves; what lies between is encoded apart."""
        if self.added_re is None or not (found := list(self.added_re.finditer(text))):
            return self.ids(text)
        out, at = [], 0
        for m in found:
            out += [self.ids(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self.ids(text[at:])])

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as ordinary text, added tokens included.

        No token and no part of the pattern holds a space after a character that isn't white space, so long texts are parted
        there, and what is encoded at once stays small.
        """
        out, at = [], 0
        while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            out.append(self.encode(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self.encode(text[at:])])


@lru_cache(maxsize=2)
def byte_units(path: str) -> ByteUnits:
    return ByteUnits(path)
