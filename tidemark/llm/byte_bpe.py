"""Byte-level BPE of whole texts through the tokenizers library.

A text is cut before its single spaces, where the tokenizer's own pattern always cuts too, and each
word goes through the library once per worker: the ids of a text are the joined ids of its words.
Spaces beside other white space are the one case where that cut differs; the words that they join are
cut by the full pattern, together, and the rest of their text goes the usual way.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .word_cache import WordCache

# The pre-tokenizer pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the letters from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, extra = {}, 256
    for b in range(256):
        table[b] = chr(b) if b in own else chr(extra)
        extra += b not in own
    return table


# A space beside other white space can't be a cut; words that such spaces join, from a cut to the next.
_JOINED = re.compile(r"(?:^|(?<!\s) (?!\s))[^ ]*(?:(?: (?=\s)|(?<=\s) )[^ ]*)+")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_WHITE_ASCII = [c for c in _WHITE if c < "\x80"]


def _joins_words(text: str) -> bool:
    """Whether some space of the text stands beside other white space."""
    if "  " in text:
        return True
    found = (c for c in (_WHITE_ASCII if text.isascii() else _WHITE) if c in text)
    return any(c + " " in text or " " + c in text for c in found)


class WordEncoder:
    """Whole texts -> ids. Words not met before go to the library together: two letters that take part
    in no merge part their pieces and the words, so every piece is encoded by itself; a word that
    holds one of the two is encoded alone."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model = Tokenizer(whole.model)
        self.letters = _byte_letters()
        self.special = [(t.content, i) for i, t in whole.get_added_tokens_decoder().items()]
        merged = set("".join("".join(m) for m in json.loads(whole.to_str())["model"]["merges"]))
        free = [b for b in range(32) if self.letters[b] not in merged and not chr(b).isspace()][:2]
        self.piece_mark, self.word_mark = map(chr, free)
        self.piece_id, self.word_id = (whole.token_to_id(self.letters[b]) for b in free)
        self.find = regex.compile(PATTERN).findall
        # the same pattern for words that are parted by marks: a mark ends a word as the text's end does
        mark = self.word_mark
        marked = PATTERN.replace(r"\p{N}]+", rf"\p{{N}}{mark}]+").replace(r"(?!\S)", rf"(?![^\s{mark}])")
        self.find_marked = regex.compile(f"{mark}|{marked}").findall
        self.cache = WordCache(self._words, mark_first=True, vocabulary=whole.get_vocab_size())

    def _letters(self, text: str) -> str:
        return text.encode("utf-8").decode("latin-1").translate(self.letters)

    def _alone(self, text: str) -> list[int]:
        return [i for p in self.find(text) for i in self.model.encode(self._letters(p), add_special_tokens=False).ids]

    def _words(self, words: list[bytes], first: list[bool]) -> list[list[int]]:
        """Ids of words, each with the space before it unless it begins a text."""
        texts = [w.decode() if f else " " + w.decode() for w, f in zip(words, first, strict=True)]
        odd = {i: self._alone(t) for i, t in enumerate(texts) if self.piece_mark in t or self.word_mark in t}
        if odd:
            texts = ["" if i in odd else t for i, t in enumerate(texts)]
        joined = []
        for at in range(0, len(texts), 256):
            pieces = self.find_marked(self.word_mark.join(texts[at : at + 256]) + self.word_mark)
            joined.append(self._letters(self.piece_mark.join(pieces)))
        ids: list[int] = []
        for encoded in self.model.encode_batch_fast(joined, add_special_tokens=False):
            ids += encoded.ids
        flat = np.array(ids, np.int64)
        flat = flat[flat != self.piece_id]
        ends = np.flatnonzero(flat == self.word_id)
        ends -= np.arange(len(ends))
        kept = flat[flat != self.word_id].tolist()
        out = [kept[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i, own in odd.items():
            out[i] = own
        return out

    def _parts(self, text: str) -> list[tuple[bytes, bool] | list[int]]:
        """The text as parts for the word cache, and ids of what can't go there."""
        for content, token in self.special:
            if content in text:
                inner = [x for p in text.split(content) for x in (*self._parts(p), [token])]
                return inner[:-1]
        out: list[tuple[bytes, bool] | list[int]] = []
        at = 0
        if _joins_words(text):
            for found in _JOINED.finditer(text):
                if found.start() > at:
                    out.append((text[at + (at > 0) : found.start()].encode("utf-8"), at == 0))
                out.append(self._alone(found[0]))
                at = found.end()
        if at < len(text):
            out.append((text[at + (at > 0) :].encode("utf-8"), at == 0))
        return out

    def ids_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; null counts as empty."""
        parts = [self._parts(t or "") for t in texts]
        cached = iter(self.cache.encode_parts([x for p in parts for x in p if isinstance(x, tuple)]))
        out = []
        for p in parts:
            ids = [next(cached) if isinstance(x, tuple) else np.array(x, self.cache.dtype) for x in p]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.empty(0, self.cache.dtype))
        return out

    def packed_many(self, texts: list[str | None]) -> list[bytes]:
        """The same, as little-endian unsigned 32-bit integers."""
        return [ids.astype("<u4").tobytes() for ids in self.ids_many(texts)]

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_many([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    return WordEncoder(path)
