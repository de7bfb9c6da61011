"""Token ids of a public byte-level BPE vocabulary, fast over many texts.

Where a text has no two white-space characters in a row, none at its ends and none
but spaces and line feeds, no token crosses from a word into the space after it, and a
line feed is a token of its own. Such texts are cut into words; the words of a batch
that a bounded cache lacks are encoded together, a line feed between them, and the ids
parted at its token. Other texts are encoded whole, among them those that hold an added
token of the vocabulary's json (as ``<|endoftext|>``): it is a token wherever it occurs.
"""

from __future__ import annotations

import base64
import json
import re
from itertools import chain
from pathlib import Path

import numpy as np
import tiktoken

KEPT = 100_000
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]").search
_UNITS = re.compile(r" ?[^ \n]+|\n").findall


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain(text: str) -> bool:
    """May the text be encoded word by word?"""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE_SPACE(text))


def added(vocabulary: str) -> dict[str, int]:
    """Added tokens, of the json beside the rank file."""
    beside = Path(vocabulary).with_suffix(".json")
    found = json.loads(beside.read_text(encoding="utf-8"))["added_tokens"] if beside.exists() else []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError("added tokens that take in their surroundings are not known here")
    return {t["content"]: t["id"] for t in found}


class Encoder:
    def __init__(self, vocabulary: str):
        import public_tokenizers

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = added(vocabulary)
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self.encode = core.encode_ordinary
        self.encode_special = lambda text: core.encode(text, set(special))
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.feed = ranks[b"\n"]
        self.line = np.array([self.feed], "<u4").tobytes()
        self.cache: dict[str, bytes] = {}
        self.last: set[str] = set()

    def _learn(self, words: set[str]) -> list[str]:
        """Puts the words that the cache lacks into it, and tells which."""
        new = [w for w in words if w not in self.cache]
        if new:
            ids = np.array(self.encode("\n".join(new)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for w, z in zip(new, ends, strict=True):
                self.cache[w] = raw[4 * at : 4 * z]
                at = z + 1
        return new

    def _forget(self, new: list[str]) -> None:
        """Only words that two runs of texts in a row had to learn stay."""
        for w in new:
            if w not in self.last:
                del self.cache[w]
        self.last = set(new)
        if len(self.cache) > KEPT:
            self.cache.clear()

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        special = [self.special(t) is not None for t in texts]
        out = [None if plain(t) and not s else np.array((self.encode_special if s else self.encode)(t), "<u4").tobytes() for t, s in zip(texts, special, strict=True)]
        cut = [(i, _UNITS(t)) for i, t in enumerate(texts) if out[i] is None]
        for a in range(0, len(cut), 500):
            words = set(chain.from_iterable(u for _, u in cut[a : a + 500]))
            words.discard("\n")
            new = self._learn(words)
            self.cache["\n"] = self.line
            for i, units in cut[a : a + 500]:
                out[i] = b"".join(map(self.cache.__getitem__, units))
            self._forget(new)
        return out
