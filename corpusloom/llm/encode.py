"""Exact tokenisation with a bounded memory of word pieces, for workers that see the same words again and again."""

from __future__ import annotations

import os
import re
from typing import ClassVar

import numpy as np
import regex

#: Characters of which the word vocabulary's normaliser makes no more than their lower case: Basic Latin, Latin-1
#: and Latin Extended-A without the dotted capital I, whose lower case is two characters.
PLAIN = [chr(i) for i in (*range(0x80), *range(0xA0, 0x130), *range(0x131, 0x180))]


def _class(kind: str) -> str:
    return "".join(f"\\u{ord(c):04x}" for c in PLAIN if regex.match(kind, c))


#: The word vocabulary's splitting pattern over these characters: contractions, letters, single digits, the rest.
WORD_SPLIT = rf"'(?:s|t|re|ve|m|ll|d)|[{_class(r'\p{L}')}]+|[{_class(r'\p{N}')}]|[^{_class(r'[\s\p{L}\p{N}]')}]+"


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Ids of whole texts by the word vocabulary, as the library gives them without added special tokens.

    Texts with other than plain characters, or with a special token's string, go to the library whole.
    """

    _made: ClassVar[dict[str, WordEncoder]] = {}

    def __init__(self, path: str, most: int = 100_000):
        self.lib, self.most, self.known, self.older = library(path), most, {}, {}
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.other, self.split = re.compile(f"[^{''.join(f'\\u{ord(c):04x}' for c in PLAIN)}]"), re.compile(WORD_SPLIT)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each process and path."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Give up all words; the library stays loaded."""
        self.known, self.older = {}, {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str], at_once: int = 2000) -> list[bytes]:
        """Words are told apart by spaces, which spares a call for each."""
        out = []
        for k in range(0, len(words), at_once):
            part = words[k : k + at_once]
            e = self.lib.encode(" ".join(part), add_special_tokens=False)
            own = np.array(e.word_ids)
            cuts = (4 * np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])).tolist()
            ids = np.array(e.ids, "<u4").tobytes()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(part) + 1 else self._ids(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [None if self.other.search(x) or any(s in x for s in self.special) else self.split.findall(x.lower()) for x in texts]
        if len(self.known) > self.most:  # words in use move on to the new generation
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = set().union(*filter(None, split)).difference(known)
        moved = [w for w in fresh if w in older]
        known.update((w, older[w]) for w in moved)
        unknown = list(fresh.difference(moved))
        known.update(zip(unknown, self._words(unknown)))
        whole = iter(self._ids([x for x, ws in zip(texts, split) if ws is None]))
        return [next(whole) if ws is None else b"".join(map(known.__getitem__, ws)) for ws in split]
