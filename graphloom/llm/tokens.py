"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

The vocabulary is a byte-level BPE file of the public tokenizers; both its forms (JSON and ranks)
give the same ids. White space only ever starts a token in such a vocabulary, so a text can be cut
before each space or newline that follows another character, and each distinct cut is encoded once
for a worker and remembered, up to a fixed number of cuts. Texts with other white space, or runs of
it, are encoded as they are. A text is first split at the vocabulary's added tokens, which have ids
of their own, as the tokenizers library does.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k"
END = 0
#: Cuts that a worker remembers: a fixed bound on its memory, not on what is encoded.
MEMO = 250_000
LONGEST_MEMO = 24
#: White space besides space and newline, as any of the libraries sees it.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY):
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo = Memo(self)
        with open(public_tokenizers.path(f"{vocabulary}.json")) as f:
            self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in json.load(f)["added_tokens"]}
        # The longest of several that begin at one place.
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def plain(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if self.marks is None or not (found := list(self.marks.finditer(text))):
            return self.between(text)
        out, at = [], 0
        for m in found:
            out += [self.between(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.between(text[at:])])

    def between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n", "") or text[-1:] in (" ", "\n") or OTHER_SPACE.search(text):
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.plain(first) + b"".join(map(self.memo.__getitem__, rest))


class Memo(dict):
    """Ids of cuts: a key stands for itself behind a space, or behind nothing if it starts with a newline."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, cut: str) -> bytes:
        ids = self.encoder.plain(cut if cut[0] == "\n" else " " + cut)
        if len(cut) <= LONGEST_MEMO and len(self) < MEMO:
            self[cut] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(vocabulary)


def document_ids(text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    """The ids of a text (null: empty) and the end id."""
    return encoder(vocabulary).ids(text or "") + END.to_bytes(4, "little")


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces behind a shorter first one."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]
