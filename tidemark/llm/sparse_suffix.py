"""Repeated passages by a sparse suffix array over word positions.

Every stretch of ``min_words`` words has a least run of ``gram`` words (by hash, leftmost of equals):
its minimiser. The suffixes that start at minimisers are retained; a suffix owns the neighbouring
stretches whose minimiser it is, and their words are its own text. Equal stretches have equal
minimisers at the same place in them, so a stretch's copies are found among the suffixes that begin
with the same gram.

The suffixes are sorted by gram and by a 128-bit digest of their own text, and neighbours are compared.
Own texts that are alike (the inside of a passage that stands in several places) are repeats as a whole:
one row each. What is left, one suffix for each different own text of a gram, is compared by words:
suffixes are sorted by their words, word for word to the right, then word for word to the left, and
those that stay neighbours over all the words of a stretch share it. Each gives its repeated stretches as
intervals, and the intervals of a document are joined: the union of repeated stretches is exactly the
set of passages of min_words or more words that occur in two documents. Passages that a document repeats
in itself (``within``) are found the same way among its own suffixes, where the document is read.

The first sort is a range sort whose ties are cut by document and position, so a passage that stands
in a third of the documents is spread over many tasks; what meets at the edges of tasks is settled from
two rows a task. Grams with more than ``most`` different own texts go another exact way: a row for
each of their stretches, and a group-by of the stretches' digests.

Words are runs of other than ASCII white space; the white space between them doesn't matter. They are
compared themselves, but for whole own texts, and stretches of the other way, which are the same if
their 128-bit BLAKE2 digests are.

Defined results: null and short texts have no passage; rows alike in doc_id and text are one document; of
a passage that documents share, the occurrences in the least document (by doc_id) are the first, those in
others the later ones; of one that a document repeats in itself, the first is that which begins first
(only with ``within``, and in rows of their own, marked so); a null doc_id (or -2^63) sorts first; texts of any length are read
whole, CHUNK stretches at a time; an empty table gives no row; further columns are carried along by
``remove_repeats`` and not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Workspace, free_name, lean, materialise, skew_safe_lookup, small_batches
from .words import Words

CHUNK = 1 << 16  # stretches of a long text that are looked at together
NO_ID = -(1 << 63)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SUFFIX = ["gram", "d1", "d2", "rid", "text_key", "start", "head", "count"]
_SUFFIX_TYPES = "gram long, d1 long, d2 long, rid long, text_key long, start long, head short, count int"
_INTERVAL = "rid long, text_key long, start_word long, end_word long, later boolean"
_FIRST_WITHIN, _LATER_WITHIN = -1, -2  # as head: a document's own repeat, words start .. start + count, on its way
BYTES = 8 << 20  # of own texts that are compared together


@dataclass(frozen=True)
class Passages:
    min_words: int = 50
    gram: int = 12
    most: int = 4096
    within: bool = True  # passages that a document only repeats in itself count too


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _digests(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128-bit digests, as two integers each, of the words first .. last."""
    cuts = map(slice, words.starts[first].tolist(), words.ends[last].tolist())
    raw = b"".join(hashlib.blake2b(words.raw[c], digest_size=16).digest() for c in cuts)
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def suffixes(text: str | None, cfg: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Retained suffixes of a text: (gram, d1, d2) and (start, head, count): first word of the first of its
    stretches, words before the suffix in it, and number of its stretches."""
    keys, places = [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.int64)]
    low = np.uint64((1 << 20) - 1)
    split = text.encode("utf-8").split() if text else []
    for at in range(0, len(split) - cfg.min_words + 1, CHUNK):
        words = Words(split[at : at + CHUNK + cfg.min_words - 1])
        h = words.runs(cfg.gram)
        ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = (_sliding_min(ranked, cfg.min_words - cfg.gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        count = np.diff(np.append(first, len(least)))
        suffix = least[first]
        digests = _digests(words, first, first + count + cfg.min_words - 2)
        keys.append(np.column_stack([h[suffix].view(np.int64), digests]))
        places.append(np.column_stack([first + at, suffix - first, count]))
    return np.concatenate(keys), np.concatenate(places)


def _stretches_of_one(text: str, at: np.ndarray, grams, start, head, count, twin, cfg: Passages) -> list[tuple[int, int, bool]]:
    """The repeated stretches of the suffixes ``at`` of one text: hashes of the stretches propose, their words
    decide. Where hashes are wrong, words alone do, as between documents."""
    import pyarrow as pa

    split = text.encode("utf-8").split()
    code = pa.array(split, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    sums = np.cumsum(count[at])
    place = np.arange(sums[-1]) + np.repeat(start[at] - sums + count[at], count[at])
    of = np.repeat(at, count[at])
    order = np.lexsort((place, h := Words(split).runs(cfg.min_words)[place]))
    place, of, h = place[order], of[order], h[order]
    leads = np.append(True, h[1:] != h[:-1])
    lead = np.maximum.accumulate(np.where(leads, np.arange(len(h)), 0))
    copy = np.flatnonzero(~leads)
    windows = np.lib.stride_tricks.sliding_window_view(code, cfg.min_words)
    if all((windows[place[c]] == windows[place[lead[c]]]).all() for c in np.array_split(copy, 1 + len(copy) // 4096)):
        repeated = twin[of] | (np.bincount(lead, minlength=len(h))[lead] > 1)
        marks = np.sort(place[repeated & ~leads]), np.sort(place[repeated & leads])
        found = []
        for marked, later in zip(marks, (True, False), strict=True):
            if len(marked):
                cut = np.flatnonzero(np.diff(marked) != 1)
                begin, end = marked[np.append(0, cut + 1)], marked[np.append(cut, len(marked) - 1)] + cfg.min_words
                found += [(s, e, later) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
        return found
    at = at[np.lexsort((start[at], grams[at]))]
    size = count[at] + cfg.min_words - 1
    ends = np.cumsum(size)
    cells = np.arange(ends[-1]) + np.repeat(start[at] - ends + size, size)
    row, begin, upto, later = share_stretches(grams[at], np.arange(len(at)), head[at], count[at], twin[at], code[cells], np.append(0, ends), cfg)
    return list(zip((start[at][row] + begin).tolist(), (start[at][row] + upto).tolist(), later.tolist(), strict=True))


def own_repeats(text: str, keys: np.ndarray, places: np.ndarray, cfg: Passages) -> list[tuple[int, int, bool]]:
    """(first word, end, later) of passages that a text repeats in itself. Its suffixes are compared as those
    of several documents are: own texts that are alike are repeats as a whole, and of each different one of
    a gram the first is compared by words."""
    order = np.lexsort((places[:, 0], keys[:, 2], keys[:, 1], keys[:, 0]))
    key, (start, head, count) = keys[order], places[order].T
    same = key[1:] == key[:-1]
    old_class, old_gram = np.append(False, same.all(axis=1)), np.append(False, same[:, 0])
    if not old_gram.any():
        return []
    first = ~old_class
    twin = first & np.append(old_class[1:], False)
    grams = np.cumsum(~old_gram) - 1
    shared = first & (np.bincount(grams, weights=first)[grams] > 1)
    end = start + count + cfg.min_words - 1
    whole = old_class | (twin & ~shared)
    found = list(zip(start[whole].tolist(), end[whole].tolist(), old_class[whole].tolist(), strict=True))
    if shared.any():
        found += _stretches_of_one(text, np.flatnonzero(shared), grams, start, head, count, twin, cfg)
    out: list[tuple[int, int, bool]] = []
    for s, e, is_later in sorted(found, key=lambda r: (r[2], r[0], r[1])):
        if out and out[-1][2] == is_later and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), is_later)
        else:
            out.append((s, e, is_later))
    return out


def _referred(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, text_key: what tells documents apart; neither is null."""
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(rid.alias("rid"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def _retained(keyed: DataFrame, cfg: Passages) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(2).to_pylist()
                found = [suffixes(t, cfg) for t in texts]
                if cfg.within:
                    found = [_with_own(t, *f, cfg) for t, f in zip(texts, found, strict=True)]
                row = pa.array(np.repeat(np.arange(len(found)), [len(p) for _, p in found]))
                key, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                cols = [pa.array(np.ascontiguousarray(key[:, k])) for k in range(3)]
                cols += [part.column(0).take(row), part.column(1).take(row), pa.array(np.ascontiguousarray(place[:, 0]))]
                cols += [pa.array(place[:, 1].astype(np.int16)), pa.array(place[:, 2].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, _SUFFIX)

    return keyed.mapInArrow(lean(run), _SUFFIX_TYPES)


def _with_own(text: str | None, keys: np.ndarray, places: np.ndarray, cfg: Passages) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes, and the text's own repeats in rows that pass by what compares suffixes."""
    own = own_repeats(text, keys, places, cfg) if len(keys) > 1 else []
    if not own:
        return keys, places
    rows = np.array([(s, _LATER_WITHIN if later else _FIRST_WITHIN, e - s) for s, e, later in own], np.int64)
    spread = np.zeros((len(rows), 3), np.int64)
    spread[:, 0] = keys[np.arange(len(rows)) % len(keys), 0]  # any task may have them
    return np.concatenate([keys, spread]), np.concatenate([places, rows])


class _Neighbours:
    """Compares sorted suffixes with their neighbours, a batch at a time. Of a class (one gram and digest)
    the rows of its first document are held, at most that text's own, until it is known whether other
    documents have it too (twin), and whether its gram has other classes (shared)."""

    def __init__(self) -> None:
        self.last: np.ndarray | None = None  # the row before the next batch
        self.held: list[np.ndarray] = []  # rows of the last class' first document
        self.twin = self.shared = False
        self.edge = True  # no class has been given out yet

    def take(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, flags: first, twin, shared, edge) that are settled. rows: a row each, as _SUFFIX."""
        own = rows[:, 6] < 0
        if own.any():
            yield rows[own], np.zeros((int(own.sum()), 4), bool)
            rows = rows[~own]
            if not len(rows):
                return
        before = np.vstack([rows[:1] if self.last is None else self.last[None], rows[:-1]])
        same = rows == before
        if self.last is None:
            same[0] = False
        new = ~same.all(axis=1)
        rows, same = rows[new], same[new]
        if not len(rows):
            return
        self.last = rows[-1]
        new_class, new_gram = ~same[:, :3].all(axis=1), ~same[:, 0]
        number = np.cumsum(new_class)  # 0: the held class goes on
        first = np.flatnonzero(new_class)
        document = np.vstack([self.held[0][:1, 3:5] if self.held else np.zeros((1, 2), np.int64), rows[first, 3:5]])
        own = (rows[:, 3:5] == document[number]).all(axis=1)
        if not own.all():
            yield rows[~own], np.zeros((int((~own).sum()), 4), bool)
        twins = np.bincount(number[~own], minlength=len(first) + 1) > 0
        if self.held:
            self.twin |= bool(twins[0])
            goes_on = own & (number == 0)
            if goes_on.any():
                self.held.append(rows[goes_on])
        if not len(first):
            return
        if self.held:
            self.shared |= not new_gram[first[0]]
            yield from self.settle(False)
        shared = ~new_gram[first]
        shared[:-1] |= ~new_gram[first[1:]]
        shared, edge = np.concatenate(([False], shared)), np.zeros(len(first) + 1, bool)
        edge[1] = self.edge and len(first) > 1  # the first class of all is given out whatever it is
        given = twins | shared | edge
        given[[0, -1]] = False
        at = np.flatnonzero(own & given[number])
        if len(at):
            of = number[at]
            yield rows[at], np.column_stack([np.ones(len(at), bool), twins[of], shared[of], edge[of]])
        self.edge &= len(first) == 1
        self.held, self.twin, self.shared = [rows[own & (number == len(first))]], bool(twins[-1]), bool(shared[-1])

    def settle(self, end: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held and (end or self.edge or self.twin or self.shared):
            rows = np.vstack(self.held)
            yield rows, np.tile([True, self.twin, self.shared, end or self.edge], (len(rows), 1))
            self.edge = False


def _compared(retained: DataFrame, keep) -> DataFrame:
    """Suffixes that share a gram or a digest: _SUFFIX, first (of its class' first document), twin (other
    documents have its class), shared (its gram has other classes)."""
    types = f"{_SUFFIX_TYPES}, first boolean, twin boolean, shared boolean, edge boolean, part int"

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), _Neighbours()

        def given(rows: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(6)]
            cols += [pa.array(rows[:, 6].astype(np.int16)), pa.array(rows[:, 7].astype(np.int32))]
            cols += [pa.array(np.ascontiguousarray(flags[:, k])) for k in range(4)] + [pa.array(np.full(len(rows), part, np.int32))]
            return pa.RecordBatch.from_arrays(cols, [*_SUFFIX, "first", "twin", "shared", "edge", "part"])

        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(len(_SUFFIX))])
                for out in state.take(rows):
                    yield given(*out)
        for out in state.settle(True):
            yield given(*out)

    order = ["gram", "d1", "d2", "rid", "text_key", "start"]
    dealt = retained.select(*_SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)
    marked = keep(dealt.mapInArrow(lean(run), types), "suffixes")
    # the first and last class of each task, two rows a task: here classes and grams may go on
    where = ["part", "gram", "d1", "d2"]
    ends = marked.filter("edge").groupBy(*where).agg(F.min("rid").alias("rid"), F.min_by("text_key", F.struct("rid", "text_key")).alias("text_key"), F.max("twin").alias("twin"), F.max("shared").alias("shared"))
    edges = [r.asDict() for r in ends.orderBy("part", "gram", "d1", "d2").collect()]
    for _, same_gram in groupby(edges, key=lambda r: r["gram"]):
        classes = [list(rows) for _, rows in groupby(same_gram, key=lambda r: (r["d1"], r["d2"]))]
        shared = len(classes) > 1 or any(r["shared"] for r in classes[0])
        for rows in classes:
            document = (rows[0]["rid"], rows[0]["text_key"])
            twin = any(r["twin"] or (r["rid"], r["text_key"]) != document for r in rows)
            for r in rows:
                r |= {"rid": document[0], "text_key": document[1], "twin": twin, "shared": shared}
    settled = [(r["part"], r["gram"], r["d1"], r["d2"], r["rid"], r["text_key"], r["twin"], r["shared"]) for r in edges]
    kinds = "part int, gram long, d1 long, d2 long, first_rid long, first_key long, is_twin boolean, is_shared boolean"
    met = F.broadcast(marked.sparkSession.createDataFrame(settled, kinds))
    at_edges = marked.filter("edge").drop("first", "twin", "shared").join(met, where)
    at_edges = at_edges.withColumn("first", (F.col("rid") == F.col("first_rid")) & (F.col("text_key") == F.col("first_key")))
    at_edges = at_edges.select(*_SUFFIX, "first", F.col("is_twin").alias("twin"), F.col("is_shared").alias("shared"))
    return marked.filter("not edge").select(*at_edges.columns).union(at_edges)


def _names(rows: np.ndarray, before: np.ndarray, code: np.ndarray) -> np.ndarray:
    """New names for rows: equal where the names before and the next words are equal; -1 for others."""
    out = np.full(len(before), -1, np.int64)
    if len(rows):
        out[rows] = np.unique(before[rows] * (int(code.max()) + 1) + code, return_inverse=True)[1]
    return out


def share_stretches(gram: np.ndarray, document: np.ndarray, head: np.ndarray, count: np.ndarray, twin: np.ndarray, code: np.ndarray, begin: np.ndarray, cfg: Passages) -> tuple[np.ndarray, ...]:
    """(row, first stretch, end, later) of the repeated stretches of some suffixes. rows stand in the
    order of documents within a gram; code: a number for each word, equal where the words are, row after
    row; begin: where each row's words begin in it, and its length."""
    n, least, reach = len(gram), cfg.min_words, cfg.min_words - cfg.gram
    suffix = begin[:-1] + head
    right = {0: np.unique(gram, return_inverse=True)[1]}
    for k in range(least):
        rows = np.flatnonzero((suffix + k < begin[1:]) & (right[k] >= 0))
        right[k + 1] = _names(rows, right[k], code[suffix[rows] + k])
        if k < least - reach:
            del right[k]  # no stretch ends so near
    left, found = np.zeros(n, np.int64), [np.empty((0, 3), np.int64)]
    for o in range(reach + 1):
        if o:
            rows = np.flatnonzero((head >= o) & (left >= 0))
            left = _names(rows, left, code[suffix[rows] - o])
        rows = np.flatnonzero((head >= o) & (head - count < o))  # whose stretches have o words before the suffix
        if not len(rows):
            continue
        name = right[least - o][rows] * n + left[rows]
        order = np.argsort(name, kind="stable")
        group = np.concatenate(([0], np.cumsum(name[order][1:] != name[order][:-1])))
        first = document[rows[order[np.searchsorted(group, np.arange(group[-1] + 1))]]]
        later = np.empty(len(rows), bool)
        later[order] = document[rows[order]] != first[group]
        repeated = np.bincount(group, weights=later[order] | twin[rows[order]]) > 0
        at = order[repeated[group]]
        found.append(np.column_stack([rows[at], head[rows[at]] - o, later[at]]))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    if not len(every):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    step = np.diff(every, axis=0)
    cut = np.flatnonzero(np.concatenate(([True], (step[:, 0] != 0) | (step[:, 1] != 1) | (step[:, 2] != 0))))
    end = np.append(cut[1:], len(every)) - 1
    return every[cut, 0], every[cut, 1], every[end, 1] + least, every[cut, 2] > 0


SLOTS = 1 << 22


def _of_wanted(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of keyed that share a slot with a wanted document: a filter of fixed size, so that texts
    without a wanted suffix mostly aren't shuffled."""
    slot = F.pmod(F.xxhash64("rid", "text_key"), F.lit(SLOTS)).cast("int")
    taken = wanted.select(slot.alias("s")).distinct().toArrow().column(0).to_numpy()  # SLOTS rows at most
    mask = np.zeros(SLOTS, bool)
    mask[taken] = True
    sent = keyed.sparkSession.sparkContext.broadcast(np.packbits(mask))

    def run(batches) -> Iterator:
        import pyarrow as pa

        bits = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(3).to_numpy()])).select([0, 1, 2])

    return keyed.withColumn("slot", slot).mapInArrow(lean(run), "rid long, text_key long, text string")


def _own_texts(keyed: DataFrame, wanted: DataFrame, cfg: Passages) -> DataFrame:
    """wanted suffixes with their own words, joined by spaces."""
    rows = _of_wanted(keyed, wanted)
    texts = rows.groupBy("rid", "text_key").agg(F.first("text").alias("text"))  # rows alike are one document
    lists = wanted.groupBy("rid", "text_key").agg(F.collect_list(F.struct("gram", "start", "head", "count", "twin")).alias("wanted"))  # bounded by the text's length

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(3).flatten()
            fields = [rows.field(k) for k in range(5)]
            start, count = (fields[k].to_numpy() for k in (1, 3))
            ends = np.cumsum(batch.column(3).value_lengths().to_numpy().astype(np.int64))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            own: list[bytes] = []
            size = done = 0

            def given(upto: int) -> pa.RecordBatch:
                part, of = slice(done, upto), pa.array(doc[done:upto])
                cols = [batch.column(0).take(of), batch.column(1).take(of), *(f[part] for f in fields)]
                return pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.binary()).cast(pa.string())], ["rid", "text_key", "gram", "start", "head", "count", "twin", "own"])

            for k, text in enumerate(batch.column(2).to_pylist()):
                split = text.encode("utf-8").split()
                for r in range(int(ends[k - 1]) if k else 0, int(ends[k])):
                    own.append(b" ".join(split[start[r] : start[r] + count[r] + cfg.min_words - 1]))
                    size += len(own[-1])
                    if size > 4 << 20:
                        yield given(r + 1)
                        own.clear()
                        size, done = 0, r + 1
            if own:
                yield given(len(doc))

    joined = texts.join(lists.hint("merge"), ["rid", "text_key"]).select("rid", "text_key", "text", "wanted")
    return joined.mapInArrow(lean(run), "rid long, text_key long, gram long, start long, head short, count int, twin boolean, own string")


def _by_words(own: DataFrame, cfg: Passages) -> DataFrame:
    """Intervals of repeated stretches, comparing the suffixes of each gram by words. No gram has more than
    cfg.most rows, or more than BYTES of own texts in several rows."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def solve(table: pa.Table) -> pa.RecordBatch:
            cols = {c: table.column(c).combine_chunks() for c in table.column_names}
            gram, head, count, twin, start = (cols[c].to_numpy(zero_copy_only=False) for c in ("gram", "head", "count", "twin", "start"))
            pair = np.column_stack([cols[c].to_numpy() for c in ("rid", "text_key")])
            document = np.unique(pair.view("V16").ravel(), return_inverse=True)[1]
            words = pc.split_pattern(cols["own"], " ")
            code, begin = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), words.offsets.to_numpy().astype(np.int64)
            row, first, end, later = share_stretches(gram, document, head.astype(np.int64), count.astype(np.int64), twin, code, begin, cfg)
            taken = pa.array(row)
            return pa.RecordBatch.from_arrays([cols["rid"].take(taken), cols["text_key"].take(taken), pa.array(start[row] + first), pa.array(start[row] + end), pa.array(later.astype(bool))], ["rid", "text_key", "start_word", "end_word", "later"])

        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            gram = held.column("gram").to_numpy()
            # the last gram may go on in the next batch; it has at most cfg.most rows and BYTES of own texts
            keep = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
            if keep and (keep >= 4096 or held.nbytes >= BYTES):
                yield solve(held.slice(0, keep))
                held = held.slice(keep)
        if held is not None and held.num_rows:
            yield solve(held)

    dealt = own.repartition("gram").sortWithinPartitions("gram", "rid", "text_key", "start")
    return dealt.mapInArrow(lean(run), _INTERVAL)


def _by_digests(own: DataFrame, cfg: Passages, keep) -> DataFrame:
    """The same for grams with very many own texts: a row for each stretch, grouped by digest."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                count = part.column("count").to_numpy()
                digests = []
                for text, n in zip(part.column("own").to_pylist(), count.tolist(), strict=True):
                    first = np.arange(n)
                    digests.append(_digests(Words(text.encode("utf-8").split(b" ")), first, first + cfg.min_words - 1))
                row = np.repeat(np.arange(len(count)), count)
                within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                d, taken = np.concatenate(digests), pa.array(row)
                cols = [pa.array(np.ascontiguousarray(d[:, k])) for k in (0, 1)]
                cols += [part.column("rid").take(taken), part.column("text_key").take(taken), pa.array(part.column("start").to_numpy()[row] + within), part.column("twin").take(taken)]
                yield pa.RecordBatch.from_arrays(cols, ["d1", "d2", "rid", "text_key", "place", "twin"])

    rows = keep(own.mapInArrow(lean(run), "d1 long, d2 long, rid long, text_key long, place long, twin boolean"), "stretches")
    rows = rows.withColumn("digest", F.struct("d1", "d2")).drop("d1", "d2")
    document = F.struct("rid", "text_key")
    facts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(document).alias("least"), ((F.min(document) != F.max(document)) | F.max("twin")).alias("repeated"))
    joined = skew_safe_lookup(rows, keep(facts, "stretch-facts"), "digest", "copies", rows.count()).filter("repeated")
    later = document != F.col("least")
    runs = W.partitionBy("rid", "text_key", "later").orderBy("place")
    joined = joined.withColumn("later", later).withColumn("run", F.col("place") - F.row_number().over(runs))
    spans = joined.groupBy("rid", "text_key", "later", "run").agg(F.min("place").alias("start_word"), (F.max("place") + cfg.min_words).alias("end_word"))
    return spans.select("rid", "text_key", "start_word", "end_word", "later")


def _intervals(docs: DataFrame, cfg: Passages, id_col: str, text_col: str) -> DataFrame:
    """Row per passage: rid, text_key, start_word, end_word, later, within."""
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "passages")
    keyed = _referred(docs, id_col, text_col)
    compared = _compared(_retained(keyed, cfg), work.keep)
    end_word = (F.col("start") + F.col("count") + (cfg.min_words - 1)).alias("end_word")
    whole = compared.filter("head >= 0 and (not first or (twin and not shared))").select("rid", "text_key", F.col("start").alias("start_word"), end_word, (~F.col("first")).alias("later"))
    inside = compared.filter("head < 0").select(
        "rid", "text_key", F.col("start").alias("start_word"), (F.col("start") + F.col("count")).alias("end_word"), (F.col("head") == _LATER_WITHIN).alias("later"), F.lit(True).alias("within")
    )
    wanted = compared.filter("head >= 0 and first and shared")
    own = work.keep(_own_texts(keyed, wanted.drop("d1", "d2", "first", "shared"), cfg), "own-texts")
    sizes = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("own")).alias("bytes")).filter((F.col("n") > cfg.most) | ((F.col("bytes") > BYTES) & (F.col("n") > 1)))
    # more than cfg.most rows, or many bytes, of each such gram: few grams beside the rows, but their number grows with the data
    sizes = work.keep(sizes, "hot-grams")
    found = whole
    if sizes.first() is None:
        found = found.union(_by_words(own, cfg))
    else:
        found = found.union(_by_words(own.join(sizes, "gram", "left_anti"), cfg)).union(_by_digests(own.join(sizes, "gram", "left_semi"), cfg, work.keep))
    found = found.withColumn("within", F.lit(False)).unionByName(inside)
    kinds = ["rid", "text_key", "later", "within"]
    order = W.partitionBy(*kinds).orderBy("start_word", "end_word")
    so_far = F.max("end_word").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce(F.col("start_word") > so_far, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy(*kinds, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return work.result(spans.drop("island"), "spans")


def repeated_passages(docs: DataFrame, cfg: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per passage of a document that occurs again: doc_id, text_key, word span, first, and within (it
    occurs again in the document itself)."""
    spans = _intervals(docs, cfg, id_col, text_col)
    doc_id = F.when(F.col("rid") != NO_ID, F.col("rid")).alias("doc_id")
    return spans.select(doc_id, "text_key", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), (~F.col("later")).alias("first"), "within")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans, each with the white space behind it."""
    raw = text.encode("utf-8")
    begins = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for start, end in sorted(spans):
        start, end = max(start, at), max(end, at)
        out.append(raw[begins[at] if at else 0 : begins[start]])
        at = end
    out.append(raw[begins[at] if at else 0 :])
    return b"".join(out).decode("utf-8")


def remove_repeats(docs: DataFrame, cfg: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Documents without their later occurrences of passages; what is left without a word goes. The
    first occurrence of each passage stays where it is, and other texts stay as they are."""
    later = _intervals(docs, cfg, id_col, text_col).filter("later")
    one, key, spans = (free_name(docs, c) for c in ("cut_id", "cut_key", "cut_spans"))
    cuts = later.groupBy("rid", "text_key").agg(F.collect_list(F.struct("start_word", "end_word")).alias(spans))
    cuts = materialise(cuts.withColumnsRenamed({"rid": one, "text_key": key}), "cuts")
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    joined = docs.join(cuts.hint("merge"), (rid == F.col(one)) & (F.xxhash64(text_col) == F.col(key)), "left")

    @F.pandas_udf("string")
    def cut(texts, found):
        return texts.combine(found, lambda t, s: t if s is None else cut_words(t, [(x["start_word"], x["end_word"]) for x in s]))

    whole = joined.filter(F.col(spans).isNull())
    changed = joined.filter(F.col(spans).isNotNull()).withColumn(text_col, cut(text_col, spans))
    changed = changed.filter(F.length(F.trim(F.regexp_replace(text_col, r"[\x09-\x0D]", " "))) > 0)
    if length_col and length_col in docs.columns:
        changed = changed.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return whole.select(*docs.columns).unionByName(changed.select(*docs.columns))
