"""Prefix trie, semi-Markov field and vector codes against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, queries, span_crf, vector_codes

from ..conftest import SMALL, same


@pytest.mark.parametrize("name", ["op11_prefix_doubling_trie", "op13_vector_codes"])
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


# --- prefix trie -------------------------------------------------------------------------------------


def plain_trie(turns, rebuild):
    said = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()
    said = {c: [t[2:] for t in sorted(own, key=lambda t: (*t[:3], digest(t)))] for c, own in said.items()}
    if rebuild:
        first = {c: zlib.crc32(str(c).encode()) % 9 for c in said}
        said = {c: said.get(c - int(np.fmod(c, 5)), [])[: first[c]] + own[first[c] :] for c, own in said.items()}
    members = {}
    for c, own in sorted(said.items()):
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m != n and m[: len(n)] == n for m in below)]
        ends = ",".join(str(c) for c in convs if len(said[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 40), 1001, 1003]:
        if c == 10:
            continue  # 11 .. 14 lack what they begin with
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 17])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["hi", "hi", "", None, "é" * 40, f"{c}"])))
    rows += [(3, t, "user", "again") for t in range(70)]  # a long one
    rows += [(4, 0, "user", "hi"), (4, 0, "user", "hi"), (None, 1, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("rebuild", "block"), [(False, 8), (True, prefix_trie.BLOCK)])
def test_op11_equals_a_plain_tree(spark, monkeypatch, rebuild, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = dialogues(block)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit("x"), "part": F.lit(1), "at": F.lit(2)})
    conv = F.col("conv_id")
    splice = (conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8) if rebuild else None
    found = prefix_trie.prefix_trie(frame.repartition(5), splice)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_trie(rows, rebuild)


def test_op11_names_go_on_over_tasks(spark):
    """One first turn that all conversations share lies in many tasks and has one name."""
    rows = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    [leaf] = prefix_trie.prefix_trie(rows.repartition(8)).filter("depth = 1").collect()
    assert (leaf.n_convs, leaf.n_leaves, leaf.saved_tokens) == (3000, 1, 2999 * 5)
    assert leaf.ends_sha256 == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert prefix_trie.prefix_trie(rows.limit(0)).count() == 0


# --- semi-Markov field -------------------------------------------------------------------------------


def plain_spans(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in m[0] if d.isdigit()]
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        if 12 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_op12_patterns_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789 .-+()@ab_%\n\t  é") for _ in range(rng.randint(0, 60)))
        assert span_crf.base_spans(text) == plain_spans(text), text
    for text in ("a@b.co.@x.y", "1.2.3.4.5", "4111 1111-1111 1111", "+1 (743) 555-3824", "9" * 5000 + ".1.1.1", "a" * 100_000 + "@", "1" * 100_000, "٣٣٣"):
        assert span_crf.base_spans(text) == (plain_spans(text) if len(text) < 9000 and "9999" not in text else [])


def every_segmentation(size, first, length, scores, pairs):
    """(score, segments) of all segmentations."""
    def go(at, label):
        if at == size:
            yield 0.0, ()
            return
        for s, rest in go(at + 1, span_crf.NONE):
            yield s + pairs[label][span_crf.NONE], rest
        for c in (c for c in range(len(first)) if first[c] == at):
            for kind in range(span_crf.NONE):
                for s, rest in go(at + length[c], kind):
                    yield s + pairs[label][kind] + scores[c][kind], ((first[c], length[c], kind), *rest)

    return list(go(0, span_crf.NONE))


def random_weights(seed):
    rng = np.random.default_rng(seed)
    pairs = rng.normal(0, 1, (span_crf.NONE + 1,) * 2)
    pairs[-1, -1] = 0
    return span_crf.Weights(rng.normal(0, 0.5, (span_crf.NONE, span_crf.N_WEIGHTS)), pairs)


@pytest.mark.parametrize("seed", range(12))
def test_op12_best_segmentation_equals_all_of_them(seed):
    """segment() drops segments that can't take part; the best of all segmentations is found all the same."""
    cfg = span_crf.SpanField(longest=4)
    text = ["a1 +2", "x@y.z 1", "1 2-3 b4", "(5) 6.7"][seed % 4]
    weights, tokens = random_weights(seed), span_crf.Tokens()
    tokens.add(text, 0, len(text))
    first, length, features = span_crf.candidates(tokens, cfg)
    scores = weights.scores(features)
    ways = every_segmentation(len(tokens), first.tolist(), length.tolist(), scores.tolist(), weights.pairs.tolist())
    best = max(ways)[1]
    assert span_crf.segment(tokens, weights, cfg)[0] == [(tokens.start[f], tokens.end[f + n - 1], kind) for f, n, kind in best]


def test_op12_likelihood_sums_all_segmentations():
    cfg = span_crf.SpanField(longest=3)
    weights = random_weights(3)
    texts = [("to 1.2.3.4 x1", 3), ("+1 5@b.cd", 0), ("7", 0)]
    sample = span_crf.Sample(texts, cfg)
    want = 0.0
    for text, begin in texts:
        tokens = span_crf.Tokens()
        tokens.add(text, begin, len(text))
        first, length, features = span_crf.candidates(tokens, cfg)
        scores = weights.scores(features)
        ways = every_segmentation(len(tokens), first.tolist(), length.tolist(), scores.tolist(), weights.pairs.tolist())
        gold = [(s, e, k) for s, e, k in span_crf.base_spans(text)]
        named = lambda way, tokens=tokens: [(tokens.start[f], tokens.end[f + n - 1], k) for f, n, k in way]
        gold = [g for g in gold if any(g in named(w) for _, w in ways)]  # segments within the field's bounds
        want += np.log(sum(np.exp(s) for s, _ in ways)) - next(s for s, w in ways if named(w) == gold)
    loss, by_span, by_pair = sample.loss(weights)
    assert loss == pytest.approx(want)
    for slopes, part in ((by_span, 0), (by_pair, 1)):
        for k, c in itertools.product(range(2), (0, 3, 200)):
            if c >= slopes.shape[1]:
                continue
            around = []
            for step in (1e-5, -1e-5):
                parts = [weights.spans.copy(), weights.pairs.copy()]
                parts[part][k, c] += step
                around.append(sample.loss(span_crf.Weights(*parts))[0])
            assert (around[0] - around[1]) / 2e-5 == pytest.approx(slopes[k, c], abs=1e-4)


def test_op12_field_finds_what_it_never_saw(spark):
    """Fitted on half of the documents, the field alone finds the other half's spans and little else."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    cfg = span_crf.SpanField()
    seen = {}
    for text in texts[::2]:
        for begin, end in span_crf.regions(text):
            if end - begin < 300:
                seen[text[max(0, begin - 32) : end]] = min(32, begin)
    weights = span_crf.fit(sorted(seen.items()), cfg)
    hit = missed = more = 0
    for text in texts[1::2]:
        tokens = span_crf.Tokens()
        for begin, end in span_crf.regions(text):
            tokens.add(text, begin, end)
        found = {s for own in span_crf.segment(tokens, weights, cfg) for s in own}
        want = set(span_crf.base_spans(text))
        hit, missed, more = hit + len(found & want), missed + len(want - found), more + len(found - want)
    assert hit >= 20 and missed <= 0.1 * hit and more <= 0.2 * hit


def test_op12_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (-1, ""), (-2, "é 12 " * 5000 + "+1 (743) 555-3824"), (-2, "x@y.zz"), (-2, "x@y.zz")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumns({"spans": F.lit("mine"), "n_ip": F.lit(7)})
    texts = sorted((r.doc_id if r.doc_id is not None else -9, r.text or "") for r in docs.collect())
    found = sorted((r.doc_id if r.doc_id is not None else -9, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in span_crf.find(docs).collect())
    want = []
    for doc, text in texts:
        spans = plain_spans(text)
        written = ",".join(f"{span_crf.KINDS[k]}:{s}:{e}" for s, e, k in spans)
        want.append((doc, hashlib.sha256(written.encode()).hexdigest(), *(sum(k == kind for *_, k in spans) for kind in range(4))))
    assert found == sorted(want)
    for r in span_crf.find(docs).collect():
        spans = [(int(s), int(e), span_crf.KINDS.index(k)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda s: (s[0], s[2], s[1])) and len(spans) == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone
    assert span_crf.find(docs.limit(0)).count() == 0
    assert span_crf.find(docs.filter("doc_id = -1")).collect()[0].spans == ""
    cut = span_crf.redact(docs.filter("doc_id < 0"))
    assert cut.columns == docs.columns and sorted(r.text for r in cut.collect()) == ["", "<EMAIL>", "<EMAIL>", "é 12 " * 5000 + "<PHONE>"]


def test_op12_query_gives_each_document_once(spark):
    found = queries.op12_semi_markov_pii(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found.select("doc_id").distinct().count() == found.count() == docs.count()


# --- vector codes ------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = []
    for vec, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(1024 * float(x))) for x in v]
            if sum(x * x for x in whole) < 1 << 58:
                kept.append((vec, whole, label))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    packed = lambda v: b"".join(int(x).to_bytes(4, "little", signed=True) for x in v)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, packed(r[1])))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((apart(cut(v, p), c), k) for k, c in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        held = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assign(v)):
                held[p][k].append(cut(v, p))
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][k] for k, own in enumerate(held[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    coded = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v)), label) for i, v, label in kept]
    total = {}
    for *_, e, label in coded:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in coded), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


@pytest.mark.parametrize("entries", [256, 7])
def test_op13_equals_plain_rounds(spark, entries):
    rng = np.random.default_rng(entries)
    rows = [(int(i), rng.normal(0, 2, 8).round(3).tolist(), rng.choice(["a", "b", "null", None])) for i in range(90)]
    rows += [(90, None, "a"), (91, [1.0, None] * 4, "a"), (92, [float("nan")] * 8, "a"), (93, [float("inf")] * 8, None), (94, [1e300] * 8, None)]
    rows += [(95, [1.5, -2.0], "short"), (5, [0.25] * 8, "b"), (None, [0.5] * 8, "a"), (96, [0.5] * 8, "a"), (97, [0.5] * 8, "a"), (98, [], "none")]
    rows = [(i, v, None if label is None else str(label)) for i, v, label in rows]
    frame = vectors(spark, rows).withColumns({"code": F.lit("x"), "v": F.lit(1), "part": F.lit(2)}).repartition(5)
    found = vector_codes.compress(frame, vector_codes.VectorCodes(entries=entries))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_codes(rows, entries=entries)


def test_op13_no_vectors(spark):
    rows = vectors(spark, [(1, None, None), (2, [None], "a")])
    assert vector_codes.compress(rows).count() == vector_codes.compress(rows.limit(0)).count() == 0


def test_op13_codes_are_decoded(spark):
    rng = np.random.default_rng(1)
    rows = vectors(spark, [(i, rng.normal(0, 1, 8).tolist(), "a") for i in range(40)])
    cfg = vector_codes.VectorCodes(entries=256, rounds=2)
    packed = vector_codes.integer_vectors(rows, cfg, "vec_id", "embedding", "label")
    books = vector_codes.train_codebooks(packed, cfg)
    for r in vector_codes.decode(vector_codes.encode(packed, books), books).collect():
        own = [books[p, int(r.code[2 * p : 2 * p + 2], 16)] for p in range(4)]
        assert r.decoded == np.concatenate(own).tolist()
