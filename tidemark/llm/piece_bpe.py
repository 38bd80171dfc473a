"""SentencePiece BPE by a table of each prefix's last token.

A string has one BPE encoding, and so has every prefix of it; each has one last token. Going left
to right, the pieces that end at a position come from an Aho-Corasick automaton over the vocabulary;
a piece is the last token of the prefix if it starts the string or if it can follow the last token
of the shorter prefix before it, which is so when the two pieces' joined characters encode to exactly
these two. The ids are then read from the end backwards. Characters outside the vocabulary never
merge, so they cut the string and become byte pieces.

Pieces hold the space mark only at their front, so runs up to the next mark are encoded apart and
kept, once per worker. ``decode`` is the library's.

Defined results: a null text is an empty one and has only its begin and end ids; rows that repeat are
encoded as rows of their own; a null doc_id is carried along; texts of any length are encoded whole,
half a megabyte at a time; an empty table gives no row; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches
from .word_cache import WordCache

MARK = "▁"
CACHED_PAIRS = 500_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixTable:
    """Whole texts -> ids, by the tables of last tokens of their words."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = WordCache(self._words, mark_first=False, vocabulary=sp.get_piece_size())
        ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in ordinary}
        self.rank = {p: (-sp.get_score(i), i) for p, i in pieces.items()}
        self.text = {i: p for p, i in pieces.items()}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = {p for p in pieces if len(p) == 1}
        # a piece is only ever produced if its own characters merge to it
        self.automaton = ahocorasick.Automaton()
        for p, i in pieces.items():
            if len(p) == 1 or self._merge(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.normal = sp.normalize("  a  b ") == f"{MARK}{MARK}{MARK}a{MARK}{MARK}b{MARK}"

    def _merge(self, text: str) -> list[str]:
        """Merges of a short string, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            best = min(((r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1]))), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        left, right = self.text[a], self.text[b]
        fits = self.pairs[a, b] = self._merge(left + right) == [left, right]
        return fits

    def _known_run(self, text: str) -> list[int]:
        """Ids of a run of vocabulary characters, through the table of last tokens."""
        n = len(text)
        last = [0] * n
        length = [0] * n
        pairs = self.pairs
        for end, (size, token) in self.automaton.iter(text):
            if length[end]:
                continue
            begin = end - size
            if begin < 0:
                fits = True
            else:
                before = last[begin]
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self._compatible(before, token)
            if fits:
                last[end], length[end] = token, size
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= length[at]
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        run = ""
        for c in text:
            if c in self.known:
                run += c
                continue
            out += self._known_run(run) if run else []
            out += [self.byte[b] for b in c.encode("utf-8")]
            run = ""
        return out + self._known_run(run) if run else out

    def _words(self, words: list[bytes], first: list[bool]) -> list[list[int]]:
        known = self.known.issuperset
        out = []
        for w in words:
            text = MARK + w.decode()
            out.append(self._known_run(text) if known(text) else self._ids(text))
        return out

    def _whole(self, text: str) -> list[int] | None:
        """Ids of a text whose words can't be parted at single spaces; None for others."""
        if not text:
            return []
        if not self.normal or MARK in text or "\0" in text:
            text = self.library.normalize(text)
        elif "  " in text or text[0] == " " or text[-1] == " ":
            text = MARK + text.replace(" ", MARK)
        else:
            return None
        # a run of marks belongs to the word after it
        out, pending = [], ""
        for word in text.split(MARK)[1:] if text.startswith(MARK) else [text]:
            pending += MARK
            if word:
                out += self._ids(pending + word)
                pending = ""
        return out + self._ids(pending) if pending else out

    def ids_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts without begin and end; null counts as empty."""
        out = [self._whole(t or "") for t in texts]
        plain = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(plain, self.cache.encode_parts([(texts[i].encode("utf-8"), True) for i in plain]), strict=True):
            out[i] = ids.tolist()
        return out

    def encode(self, text: str | None) -> list[int]:
        return [self.library.bos_id(), *self.ids_many([text])[0], self.library.eos_id()]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def table(path: str) -> PrefixTable:
    """One table per worker process."""
    return PrefixTable(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: number of ids, digest of the ids, digest of the decoded text. No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        pieces = table(model)
        begin, end = pieces.library.bos_id(), pieces.library.eos_id()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for found in pieces.ids_many(part.column(1).to_pylist()):
                    ids = [begin, *found, end]
                    packed = np.array(ids, "<u4").tobytes()
                    rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(pieces.decode(ids).encode("utf-8")).hexdigest()))
                n, ids, back = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(lean(run), ENCODED)
