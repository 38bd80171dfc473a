"""The llm operators against SQL or brute force, and their defined results for odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same
from tidemark.llm.shared import materialise
from tidemark.llm import chat_rotation, components, digest_index, nbsvm, packing, piece_bpe, pivot_search, queries, repair_codec, simhash, sparse_suffix, token_store, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASHES = ["fp", "digest", "kept", "copies", "score", "predicted", "held_out", "place", "hash", "shard", "stays_id", "cut_spans", "text_digest", "kept_id", "_id"]


def frame(spark, rows, clashes=True):
    """(doc_id, text) rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(c) for c in CLASHES}) if clashes else df


def thue_morse(n, a="a", b="b"):
    """Two words alike in every sum of powers mod 2^64 of their letters, but not alike."""
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join((a, b)[x] for x in word), "".join((b, a)[x] for x in word)


WORDS = [f"w{i}" for i in range(400)]


def odd_rows():
    rng = np.random.default_rng(0)
    prose = [" ".join(rng.choice(WORDS, 120)) for _ in range(6)]
    passage = " ".join(rng.choice(WORDS, 70))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, None), (None, prose[0]), (4, prose[0]), (4, prose[0]), (5, prose[0]), (6, prose[1]), (7, prose[1].upper()), (8, prose[2] + " " + passage)]
    rows += [(9, passage + " " + prose[3]), (10, prose[4] + " " + passage + " " + prose[5]), (11, passage + " x " + passage), (12, "Ünïcödé 日本語  two  spaces  <|endoftext|> \x00 🙂"), (13, "word " * 30_000)]
    return rows


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


def bpe_ids(text, end):
    from tokenizers import Tokenizer

    bpe_ids.library = getattr(bpe_ids, "library", None) or Tokenizer.from_file(BPE)
    return np.array([*bpe_ids.library.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_words_that_hash_alike_keep_their_own_ids():
    """Words are told apart by their bytes: op1, op7 and op10 give the libraries' ids."""
    import sentencepiece
    from tidemark.llm import byte_bpe

    rng = np.random.default_rng(12)
    signs = ["a", "b", "  ", "   ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "é", "日本", "<|endoftext|>", "12", "!", "'s", " the", "🙂", "ab" * 20, "\x00", "\x01"]
    rows = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(1500)]
    for n in (512, 1024, 2048, 4096):
        one, two = thue_morse(n)
        rows += [f"{one} {two}", f"x {two} y {one} {two}", f"in front{one} in front{two}", f"infront8{one} infront8{two}"]
    rows += ["word " * 200_000, "a  b " * 30_000, None, "", " ", "  "]
    encoder, pieces, sp = byte_bpe.WordEncoder(BPE), piece_bpe.PrefixTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text, ids, own in zip(rows, encoder.ids_many(rows), pieces.ids_many(rows), strict=True):
        assert bpe_ids(text, 0)[:-4] == ids.astype("<u4").tobytes()
        assert sp.encode(text or "") == list(own)


@pytest.mark.parametrize("odd", [False, True])
def test_op1_token_store(spark, odd):
    docs = frame(spark, odd_rows()) if odd else documents(spark)
    got = token_store.store_and_read(docs, token_store.TokenFormat(BPE)).orderBy("start").collect()
    want = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r, (_, text) in zip(got, want, strict=True):
        ids = bpe_ids(text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert token_store.store_and_read(docs.limit(0), token_store.TokenFormat(BPE)).count() == 0


def paying_pairs(symbols, least):
    """Pairs of neighbours that occur often enough without overlaps."""
    places = defaultdict(int)
    last = {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if last.get(pair, -2) != i - 1:
            places[pair] += 1
            last[pair] = i
        else:
            last[pair] = -2
    return [p for p, n in places.items() if n >= least]


@pytest.mark.parametrize("base", [300, 100_000])
def test_repair_grammar_expands_to_its_ids(base):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(1), np.zeros(999), rng.integers(0, 5, 4000), np.tile(rng.integers(0, base, 50), 80), rng.integers(base - 9, base, 3000)):
        g = repair_codec.compress(ids.astype(np.uint32), base)
        assert np.array_equal(g.decode(), ids)
        assert not paying_pairs(g.sequence.tolist(), repair_codec.MIN_COUNT)
        assert g.sizes.tolist() == [len(g.expand(np.array([base + k]))) for k in range(len(g.left))]
    with pytest.raises(ValueError):
        repair_codec.compress(np.array([base]), base)


@pytest.mark.parametrize("base", [300, 100_000])
def test_repair_files_give_any_range_of_their_ids(base):
    import io

    rng, whole, sink, shards = np.random.default_rng(4), [], io.BytesIO(), []
    for n in (500, 1, 0, 30_000):
        ids = (rng.integers(0, base, n) if n > 500 else np.tile(rng.integers(0, base, max(1, n // 10)), 10)[:n]).astype(np.uint32)
        shards.append((sink.tell(), len(whole)))
        repair_codec.write_shard(sink, [None, 7], np.array([n // 2, n - n // 2]), repair_codec.compress(ids, base))
        whole += ids.tolist()
    repair_codec.write_index(sink, shards)
    sink.seek(0)
    assert [i for _, _, g in repair_codec.read_shards(sink) for i in g.decode().tolist()] == whole
    for start, length in ((0, 30_501), (499, 3), (450, 500), (3400, 999), (30_400, 999), (99_999, 5), (10, 0), (1523, 2049)):
        assert repair_codec.read_range(sink, start, length).tolist() == whole[start : start + length]


def test_op1_random_access_to_written_files(spark):
    folder, docs = queries.token_store.shared_path(spark, "tokens"), documents(spark)
    files = token_store.write_tokens(docs, folder, token_store.TokenFormat(BPE, shard_ids=20_000)).collect()
    ids = np.frombuffer(b"".join(bpe_ids(t, 2) for _, t in sorted(texts(docs))), "<u4")
    begin = 0
    for f in files:
        for start in (0, f.ids // 3, max(0, f.ids - 70)):
            want = ids[begin + start : begin + min(f.ids, start + 1000)]
            assert np.array_equal(token_store.read_range(f.path, start, 1000), want)
        begin += f.ids


def test_op2_odd_rows(spark):
    docs = frame(spark, odd_rows())
    index = digest_index.DigestIndex(spark, "odd_index").create()
    got = index.ingest(docs)
    groups = defaultdict(list)
    for d, t in odd_rows():
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(d)
    for r in got.collect():
        ids = groups[r.digest.hex()]
        most = max((d for d in ids if d is not None), default=None)
        assert (r.keep_id, r.copies, r.kept) == (most, len(ids), r.doc_id == most)
    again = index.ingest(frame(spark, [(99, ""), (100, "new")])).collect()
    assert {r.doc_id: r.kept for r in again} == {99: False, 100: True}
    index.create()
    left = digest_index.deduplicate(docs, index)
    assert left.columns == docs.columns
    assert Counter((t or "") for _, t in texts(left)) == Counter({t or "" for _, t in odd_rows()})
    assert digest_index.deduplicate(docs.limit(0), index.create()).count() == 0
    index.drop()


@pytest.mark.parametrize("part_turns", [2, 1024])
def test_op3_odd_rows(spark, part_turns):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", None), (1, 1, "b", None), (1, None, None, ""), (None, 5, "a", "x"), (2, 3000, "a", "far"), (2, 0, "c", "near")]
    rows += [(3, None, "a", "same")] * 5 + [(3, 7, "b", "long " * 100_000), (3, 7, "a", "ties"), (3, 1 << 60, "b", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat_rotation.rotate(turns.withColumns({c: F.lit("x") for c in ("part", "lines", "pos", "salt")}), part_turns).collect()
    placed = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "unknown", r[3] or "")):
        placed[c].append((role or "unknown", text or ""))
    want = {}
    for c, said in placed.items():
        before = Counter()
        for part in range(-(-len(said) // part_turns)):
            own_part = said[part * part_turns : (part + 1) * part_turns]
            for speaker in {role for role, _ in said}:
                text, spans = "", []
                for role, body in own_part:
                    own = role == speaker
                    text += "<|assistant|>\n" if own else f"<|user name={role}|>\n"
                    start = len(text)
                    text += body + "<|end|>\n"
                    spans += [f"{start}-{len(text)}"] * own
                want[c, part, speaker] = (text, ",".join(spans), len(own_part), len(spans), before[speaker])
                before[speaker] += len(text)
    assert {(r.conv_id, r.part, r.participant): (r.rendered, r.spans, r.n_turns, r.own_turns, r.part_start) for r in got} == want and len(got) == len(want)
    assert chat_rotation.rotate(turns.limit(0)).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_op4_archives(spark, odd):
    import base64

    if odd:
        rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "x" * 50_000), (4, "u", "x" * 50_000), (4, "u", "x" * 50_000), (None, "u", "é"), (None, "u", None), (5, "u", "a\r\n\r\nb")]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("offset", F.lit("x"))
    else:
        pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = [(r.page_id, (r.html or "").encode()) for r in pages.select("page_id", "html").collect()]
    original = {}
    for page, payload in found:
        original[payload] = max((p for p in (page, original.get(payload)) if p is not None), default=None)
    want = []
    for page, payload in found:
        first = original[payload] == page
        want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", None if first else original[payload]))
    got = warc.deduplicate_archives(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert warc.deduplicate_archives(pages.limit(0)).count() == 0


def test_op4_records_have_ids_of_their_own_and_revisits_name_their_original(spark):
    rows = [(1, "u1", "x"), (2, "u2", "x"), (2, "u2", "x"), (3, None, "y"), (4, "u4", "y"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = warc.write_responses(pages, queries.token_store.shared_path(spark, "warc"))
    resolved = warc.resolve(warc.read_headers(spark, first))
    second = warc.write_deduplicated(resolved, queries.token_store.shared_path(spark, "warc"), 3)
    for manifest in (first, second):
        records = []
        for r in manifest.collect():
            with open(r.path.removeprefix("file://"), "rb") as source:
                records += [warc.parse_record(raw)[0] for _, _, raw in warc.read_archive(source)]
        ids = {f["WARC-Record-ID"]: f for f in records}
        assert len(ids) == len(rows)
        for f in records:
            if f["WARC-Type"] == "revisit":
                of = ids[f["WARC-Refers-To"]]
                assert of["WARC-Type"] == "response" and of["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
                assert f["WARC-Refers-To-Target-URI"] == of["WARC-Target-URI"] and f["WARC-Refers-To-Date"] == of["WARC-Date"]


def test_op5_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(300 + i, vectors[7].tolist()) for i in range(40)]
    rows += [(50, None), (400, [1.0, None]), (401, [float("nan")] * 8), (402, [float("inf")] * 8), (None, [1.0] * 8), (403, [0.0] * 8), (404, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("pivot", F.lit("x")).withColumn("v", F.lit("x"))
    got = defaultdict(list)
    for r in pivot_search.top_k(df, F.col("vec_id") % 50 == 0, pivot_search.PivotSearch(annulus=16, pivots=8, block=3)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    whole = [(i, np.pad(np.floor(256 * np.array(v)), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    assert set(got) == {i for i, _ in whole if i % 50 == 0}
    for i, q in whole:
        if i % 50 == 0:
            assert got[i] == [(s, c) for s, c in sorted(((int(q @ x), c) for c, x in whole if c != i), key=lambda p: (-p[0], p[1]))[:5]]
    assert pivot_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_op5_one_pivot_over_many_files_read_by_one_task(spark):
    rng = np.random.default_rng(6)
    # coordinates of many sizes: the files differ in size, and Spark reads the largest first
    vectors = rng.normal(size=(1200, 4)) * rng.choice([0.02, 1, 30], size=(1200, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        cfg = pivot_search.PivotSearch(pivots=1, sample=8, annulus=32)
        got = defaultdict(list)
        for r in pivot_search.top_k(df, F.col("vec_id") % 3 == 0, cfg).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.score, r.vec_id))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    whole = np.floor(256 * vectors)
    for q in range(0, 1200, 3):
        scores = whole @ whole[q]
        assert got[q] == sorted(((int(s), c) for c, s in enumerate(scores) if c != q), key=lambda p: (-p[0], p[1]))[:5]


def test_op5_reads_only_ranges_that_can_reach_the_floor():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(400, 3))
    x = np.floor(256 * x / np.sqrt((x * x).sum(axis=1))[:, None])  # of one length: near in angle is near
    radius2 = float((x * x).sum(axis=1).max())
    pivots = pivot_search._spread_pivots(pivot_search._lift(x[:100], radius2), 6)
    d = pivot_search._distances(pivot_search._lift(x, radius2), pivots)
    near = d.argmin(axis=1)
    own = d[np.arange(400), near]
    read = {}
    for k in (1, 20):
        inside = 0
        for at in range(0, 400, 5):
            q = x[np.lexsort((own, near))[at : at + 5]]
            scores = q @ x.T
            floor = np.partition(scores[:, :100], 100 - k, axis=1)[:, -k]
            low, high = pivot_search.needed_ranges(q, floor, pivot_search._distances(np.column_stack([q, np.zeros(len(q))]), pivots), radius2)
            kept = (own >= low[near]) & (own <= high[near])
            assert not ((scores >= floor[:, None]) & ~kept[None]).any()
            inside += kept.sum()
        read[k] = inside
    assert read[1] < read[20] < 80 * 400 and read[1] < 0.5 * 80 * 400


def test_op5_large_numbers(spark):
    rows = [(i, [float((i * 7919) % 1009 + 1) * 2.0**12, float(i % 13) + 0.25, -1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [[int(256 * x // 1) for x in v] for _, v in rows]
    got = defaultdict(list)
    for r in pivot_search.top_k(df, F.col("vec_id") % 10 == 0, pivot_search.PivotSearch(block=4)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 60, 10):
        scores = sorted(((sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q), key=lambda p: (-p[0], p[1]))[:5]
        assert got[q] == scores
    # vectors that are too long for scores of 64 bits take no part, and stop nothing
    far = spark.createDataFrame([(1, [1e30]), (2, [1.0]), (3, [-2.0]), (4, [2.0**23]), (5, [-(2.0**22) * 1.9])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in pivot_search.top_k(far, F.lit(True)).collect()) == [(a, b) for a in (2, 3, 5) for b in (2, 3, 5) if a != b]
    assert pivot_search.top_k(far.limit(1), F.lit(True)).count() == 0


def test_op6_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = nbsvm.classify(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    order = got["score"].rank()
    up = got["quality"] == 1
    assert (order[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum()) > 0.95


def plain_features(text):
    """The n-grams of a text as tuples."""
    import re

    raw = text.encode()
    tokens = [(m.start(), m.group(), m.lastindex) for m in re.finditer(rb"([A-Za-z\x80-\xff]+)|([0-9]+)|([!-/:-@\[-`{-\x7f]+)", raw)]
    words = [w for _, w, _ in tokens]
    shapes = []
    for i, (at, w, kind) in enumerate(tokens):
        upper = sum(65 <= b <= 90 for b in w)
        case = 0 if not upper else 1 if upper == 1 else 2 if upper == len(w) else 3
        again = (i > 0 and words[i - 1] == w) + 2 * (i > 1 and words[i - 2] == w)
        glued = at > 0 and raw[at - 1] not in b" \n"
        shapes.append(w if kind == 3 else (kind, case, min(len(w), 15), again, glued))
    out = {("word", w) for w in words} | {("words", *p) for p in zip(words, words[1:], strict=False)}
    for n in (1, 2, 3):
        out |= {("shapes", *p) for p in zip(*(shapes[k:] for k in range(n)), strict=False)}
    return out


def test_op6_indicators_are_the_n_grams(spark):
    for _, text in texts(documents(spark))[:60]:
        want, got = plain_features(text or ""), nbsvm.indicators(text, 1 << 30)
        assert len(got) == len(want)  # so many buckets that none is shared


def test_op6_fit_equals_plain_dual_coordinate_descent():
    """The same steps in plain Python, over dictionaries."""
    import math

    rng = np.random.default_rng(15)
    y = np.where(rng.random(90) < 0.4, 1, -1)
    rows = [np.unique(rng.choice(40, 8) + (10 if s > 0 else 0)).astype(np.uint32) for s in y]
    cfg = nbsvm.NbSvm(buckets=64, epochs=30)
    model = nbsvm.fit(rows, y, cfg)
    train = [i for i in range(90) if i % 5 != 4]
    counts = {s: {b: cfg.alpha for b in range(64)} for s in (1, -1)}
    for i in train:
        for b in rows[i].tolist():
            counts[y[i]][b] += 1
    total = {s: sum(counts[s].values()) for s in counts}
    ratio = {b: math.log(counts[1][b] / total[1] / (counts[-1][b] / total[-1])) for b in range(64)}
    vectors = {i: {b: ratio[b] / math.sqrt(len(rows[i])) for b in rows[i].tolist()} for i in train}
    cost = {s: 0.5 / (sum(y[i] == s for i in train) / len(train)) for s in (1, -1)}
    w, bias, dual, order = dict.fromkeys(range(64), 0.0), 0.0, dict.fromkeys(train, 0.0), np.random.default_rng(17)
    for _ in range(cfg.epochs):
        most = 0.0
        for i in order.permutation(np.array(train)).tolist():
            gradient = y[i] * (sum(w[b] * v for b, v in vectors[i].items()) + bias) - 1
            new = min(max(dual[i] - gradient / (sum(v * v for v in vectors[i].values()) + 1), 0.0), cost[y[i]])
            change, dual[i] = new - dual[i], new
            for b, v in vectors[i].items():
                w[b] += change * y[i] * v
            bias += change * y[i]
            most = max(most, abs(change))
        if most < 1e-3:
            break
    assert np.allclose(model.weights, [w[b] * ratio[b] for b in range(64)]) and model.bias == pytest.approx(bias)
    margins = {i: bias + sum(w[b] * ratio[b] for b in rows[i].tolist()) / math.sqrt(len(rows[i])) for i in range(90)}
    for i, m in margins.items():
        assert model.score(rows[i]) == pytest.approx(1 / (1 + math.exp(-(model.slope * m + model.shift))))


def test_op6_bounds_the_sample(spark, monkeypatch):
    docs = frame(spark, [(i, f"word{i} " * (i + 1) + "x y z") for i in range(40)] * 3, clashes=False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(nbsvm, "fit", lambda rows, y, cfg, real=nbsvm.fit: seen.append(rows) or real(rows, y, cfg))
    for cfg in (nbsvm.NbSvm(max_rows=10), nbsvm.NbSvm(max_indicators=60), nbsvm.NbSvm()):
        assert nbsvm.classify(docs, labels, cfg).count() == 120
    few, small, every = seen
    assert len(few) <= 10 and 0 < len(small) < len(every) and sum(map(len, small)) <= 60 < sum(map(len, every)) and len(every) > 20


def test_op6_odd_rows(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, None, 0), (None, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = nbsvm.classify(docs, known).select("doc_id", "held_out", "score", "predicted").collect()
        assert len(got) == len(odd_rows())
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
            assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
    assert nbsvm.classify(docs.limit(0), labels).count() == 0
    assert nbsvm.accept(docs, labels).columns == docs.columns


@pytest.mark.parametrize("odd", [False, True])
def test_op7_equals_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(spark, odd_rows()) if odd else documents(spark)
    want = []
    for d, t in texts(docs):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = piece_bpe.encode_documents(docs, PIECES)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert piece_bpe.encode_documents(docs.limit(0), PIECES).count() == 0


def brute_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(ids, fps, bits):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        least[root(i)].append(d)
    return [min((d for d in least[root(i)] if d is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("odd", [False, True])
def test_op8_equals_all_pairs(spark, odd):
    docs = frame(spark, odd_rows()) if odd else documents(spark)
    rows = texts(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], brute_components([d for d, _ in rows], fps, 4), strict=True))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    stays = {d for d, _, c in want if d == c and d is not None}
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    assert Counter(texts(left)) == Counter((d, t) for d, t in rows if d is None or d in stays)


def test_op8_links_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 40).tolist()
    fps += [f ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False)) for f in fps for _ in range(8)]
    df = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.links(df, block=4)).collect()}
    fps = sorted(set(fps))
    assert [got.get(f, f) for f in fps] == brute_components(fps, fps, 4)


def brute_alike(rows):
    """Least doc_id of each row's group, groups linked by five-word Jaccard >= 0.8."""
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for g, (d, _) in zip(group, rows, strict=True):
        least[g].append(d)
    return [min((d for d in least[g] if d is not None), default=None) for g in group]


@pytest.mark.parametrize("kind", ["table", "odd", "groups"])
def test_near_stage_equals_all_pairs_by_jaccard(spark, kind):
    import corpus_pipeline
    from tidemark.llm import jaccard_join

    if kind == "table":
        docs = documents(spark)
    elif kind == "odd":
        docs = frame(spark, odd_rows())
    else:  # copies on both sides of 0.8 and chains, in one large group and small ones
        rng, rows = np.random.default_rng(8), []
        for n in (60, 12, 12, 5):
            base = rng.choice(WORDS, 150)
            for _ in range(n):
                copy = base.copy()
                copy[rng.choice(150, rng.integers(0, 7), replace=False)] = "other"
                rows.append((len(rows), " ".join(copy)))
        docs = frame(spark, rows)
    rows = texts(docs)
    want = brute_alike(rows)
    got = jaccard_join.near_duplicates(docs, cfg=jaccard_join.Alike(block=8, sample=20))
    assert Counter(map(tuple, got.collect())) == Counter(zip([d for d, _ in rows], want, strict=True))
    if kind == "odd":
        left = corpus_pipeline.near(spark, docs, SMALL)
        assert left.columns == docs.columns
        assert Counter(texts(left)) == Counter(r for r in rows if r[0] is None or r[0] in set(want))


def brute_passages(rows, least=50):
    """Spans of first and later occurrences of every stretch of ``least`` words that two documents have."""
    seen = defaultdict(list)
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (t or "").encode().split()
        for i in range(len(words) - least + 1):
            seen[tuple(words[i : i + least])].append((d, i))
    out = set()
    for later in (False, True):
        marks = defaultdict(set)
        for places in seen.values():
            for d, i in places if len({d for d, _ in places}) > 1 else []:
                if later == (d != places[0][0]):
                    marks[d].add(i)
        for d, starts in marks.items():
            begin = end = None
            for i in sorted(starts):
                if end is not None and i <= end:
                    end = i + least
                    continue
                if end is not None:
                    out.add((d, begin, end, not later))
                begin, end = i, i + least
            out.add((d, begin, end, not later))
    return out


def brute_within(rows, least=50):
    """The same of stretches that a document has in two places, by place."""
    out = []
    for d, t in set(rows):
        words, seen = (t or "").encode().split(), defaultdict(list)
        for i in range(len(words) - least + 1):
            seen[tuple(words[i : i + least])].append(i)
        for later in (False, True):
            starts = sorted(i for places in seen.values() if len(places) > 1 for i in (places[1:] if later else places[:1]))
            begin = end = None
            for i in starts:
                if end is None or i > end:
                    if end is not None:
                        out.append((d, begin, end, not later))
                    begin = i
                end = i + least
            if end is not None:
                out.append((d, begin, end, not later))
    return out


def all_passages(rows, within=True):
    """(doc_id, start, end, first, within), each as often as it occurs."""
    return Counter((*p, False) for p in brute_passages(rows)) + Counter((*p, True) for p in brute_within(rows) if within)


def found_passages(got):
    return Counter((r.doc_id, r.start_word, r.end_word, r.first, r.within) for r in got.collect())


def passage_rows():
    """Passages in many surroundings, on both sides of 50 words, with words that sums of powers confuse."""
    rng, rows = np.random.default_rng(9), []
    some = lambda n: rng.choice(WORDS, n).tolist()
    shared = [some(n) for n in (49, 50, 51, 64, 75, 120)]
    for k in range(60):
        a, b = shared[k % 6], shared[(k // 6) % 6]
        cut = int(rng.integers(0, 30))
        rows.append((k, " ".join([*some(int(rng.integers(0, 40))), *a[cut:], *some(int(rng.integers(0, 3))), *b[: len(b) - cut], *some(20)])))
    one, two = thue_morse(2048)
    rows += [(70, " ".join([one, *shared[5][:49], two])), (71, " ".join([two, *shared[5][:49], one])), (72, " ".join([one, *shared[5][:49], one]))]
    rows += [(73, " ".join([one, two] * 40)), (74, " ".join([two, one] * 40)), (75, " ".join(["a"] * 300)), (77, " ".join(["c"] * 300)), (76, " ".join(["a"] * 60 + ["b"] * 60 + ["a"] * 60))]
    rows += [(80 + k, " ".join([f"u{k}", *shared[3], f"v{k}"])) for k in range(30)]  # a gram with many own texts
    return rows


def cut_by_brute_force(rows, within=True):
    """Texts without the later occurrences of passages, by splitting at words."""
    import re

    later = defaultdict(set)
    for d, start, end, first, _ in all_passages(rows, within):
        if not first:
            later[d] |= set(range(start, end))
    out = []
    for d, t in rows:
        parts = re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "")
        at = -1 if parts and not parts[0].strip(" \t\n\x0b\x0c\r") else 0
        left = "".join(p for k, p in enumerate(parts) if k + at not in later[d])
        if not later[d]:
            out.append((d, t))
        elif left.strip(" \t\n\x0b\x0c\r"):
            out.append((d, left))
    return Counter(out)


@pytest.mark.parametrize(("kind", "within"), [("table", True), ("odd", True), ("passages", True), ("passages", False), ("passages in hot grams", True), ("passages of many bytes", False)])
def test_op9_equals_all_stretches(spark, monkeypatch, kind, within):
    if kind == "passages of many bytes":
        monkeypatch.setattr(sparse_suffix, "BYTES", 20_000)
    if kind == "table":
        docs = documents(spark)
    elif kind == "odd":
        docs = frame(spark, [r for r in odd_rows() if r[0] != 13] + [(13, "word " * 3000)])
    else:
        docs = frame(spark, passage_rows()).repartition(7)
    rows, cfg = texts(docs), sparse_suffix.Passages(most=5 if kind == "passages in hot grams" else 4096, within=within)
    assert found_passages(sparse_suffix.repeated_passages(docs, cfg)) == all_passages(rows, within)
    if kind != "odd":  # there rows with one doc_id differ
        left = sparse_suffix.remove_repeats(docs, cfg, length_col=None)
        assert left.columns == docs.columns
        assert Counter(texts(left)) == cut_by_brute_force(rows, within)
    assert sparse_suffix.repeated_passages(docs.limit(0)).count() == 0


def test_op9_neighbours_over_the_edges_of_tasks(spark):
    """One passage in every document: its suffixes go on over many tasks."""
    rng = np.random.default_rng(10)
    body = rng.choice(WORDS, 90).tolist()
    rows = [(k, " ".join([*rng.choice(WORDS, 5), *body, *rng.choice(WORDS, 5)])) for k in range(200)]
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = found_passages(sparse_suffix.repeated_passages(frame(spark, rows)))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == all_passages(rows)


def test_long_words_are_kept_by_their_bytes():
    """Words of 100 KB are encoded and not kept; shorter ones are, up to a bound in bytes."""
    import resource

    from tidemark.llm import word_cache

    cache = word_cache.WordCache(lambda words, first: [[len(w) % 7] * (len(w) // 4) for w in words], False, 1000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for k in range(2000):
        word = b"%06d" % k * 17_000
        [ids] = cache.encode_parts([(b"a " + word + b" b", True)])
        assert len(ids) == len(word) // 4 and len(cache.long) == cache.long_bytes == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    for k in range(60_000):
        cache.encode_parts([(b"%010d" % k * 100, True)])
    assert 0 < cache.long_bytes <= word_cache.LONG_BYTES and cache.long_bytes == sum(len(w) + i.nbytes + 300 for (w, _), i in cache.long.items())
    word = next(iter(cache.long))[0]
    assert cache.encode_parts([(word, True)])[0].tolist() == [len(word) % 7] * (len(word) // 4)


def test_op9_repeats_of_one_text_equal_all_stretches(monkeypatch):
    """Chunks, long words, one word over and over, runs that sums of powers confuse."""
    rng, cfg = np.random.default_rng(12), sparse_suffix.Passages()
    body, one = rng.choice(WORDS, 160).tolist(), thue_morse(2048)[0]
    confused = thue_morse(64)
    odd = [*body, *confused[0].split(), "x" * 30_000, *confused[1].split(), *body[:90], *body[20:], "y\0", *body[:49], "y", *body[:51]]
    for chunk in (1 << 16, 64):
        monkeypatch.setattr(sparse_suffix, "CHUNK", chunk)
        for text in (" ".join(body + body), " ".join(["a"] * 500), " ".join(odd), f"{one} {one} z {one}", " ".join(body), ""):
            found = sparse_suffix.own_repeats(text, *sparse_suffix.suffixes(text, cfg), cfg)
            assert Counter((1, s, e, not later) for s, e, later in found) == Counter(brute_within([(1, text)]))
    monkeypatch.setattr(sparse_suffix.Words, "runs", lambda self, size, real=sparse_suffix.Words.runs: real(self, size) // np.uint64(1 if size < 50 else 1 << 62))
    found = sparse_suffix.own_repeats(" ".join(odd), *sparse_suffix.suffixes(" ".join(odd), cfg), cfg)
    assert Counter((1, s, e, not later) for s, e, later in found) == Counter(brute_within([(1, " ".join(odd))]))


def test_op9_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sparse_suffix, "CHUNK", 64)
    rng = np.random.default_rng(11)
    body = rng.choice(WORDS, 700).tolist()
    for text in (" ".join(body + body), " ".join(["a"] * 500), " ".join(body)):
        key, place = sparse_suffix.suffixes(text, sparse_suffix.Passages())
        assert place[:, 2].sum() == len(text.split()) - 49  # every stretch has its suffix
        assert len(key) == len(place)


def test_op9_cuts_words_and_the_space_behind():
    assert sparse_suffix.cut_words("a  b c\nd ", [(1, 3)]) == "a  d "
    assert sparse_suffix.cut_words("é b", [(0, 1)]) == "b"
    assert sparse_suffix.cut_words("a b c", [(0, 2), (1, 3)]) == ""


@pytest.mark.parametrize("odd", [False, True])
def test_op10_packs_every_id_once(spark, odd):
    docs = frame(spark, odd_rows()) if odd else documents(spark)
    got = packing.pack(docs, packing.Packing(BPE)).toPandas()
    want = Counter()
    for d, t in texts(docs):
        ids = bpe_ids(t, 1)
        n = len(ids) // 4
        whole = n - n % 2048
        cuts = [*range(0, whole, 2048), *range(whole, n, 512), n]
        want.update((-1 if d is None else d, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n) for a, b in zip(cuts, cuts[1:], strict=False))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, got.fillna({"doc_id": -1})[kept].astype(int).to_numpy().tolist())) == want
    loads = []
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        loads.append(rows["length"].sum())
    assert max(loads) <= 2048 and len(loads) <= -(-sum(loads) // 2048) + max(1, len(loads) // 50)
    assert packing.pack(docs.limit(0), packing.Packing(BPE)).count() == 0


def plain_differencing(sizes, k):
    """Loads of the windows: partial partitions as lists, the two with the largest spread are merged."""
    parts = [(s, i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    number = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, a), (_, _, b), *parts = parts
        loads = sorted((x + y for x, y in zip(a, b[::-1], strict=True)), reverse=True)
        loads = [x - loads[-1] for x in loads]
        parts.append((loads[0], number, loads))
        number += 1
    return [x - min(parts[0][2]) for x in parts[0][2]]


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_op10_differencing_equals_a_plain_one(k):
    rng = np.random.default_rng(16)
    for n in (k, 13, 40):
        sizes = rng.integers(1, 500, n)
        window = packing.difference(sizes, k)
        loads = np.sort(np.bincount(window, weights=sizes, minlength=k))[::-1]
        assert (loads - loads[-1]).astype(int).tolist() == plain_differencing(sizes.tolist(), k)


def test_op10_bundles_tiny_pieces():
    sizes = np.concatenate([np.ones(50_000, np.int64), np.full(30, 500), np.full(9, 128)])
    bundle = packing.bundles(sizes, 128)
    loads = np.bincount(bundle, weights=sizes)
    assert loads.max() == 500 and len(loads) < 500 and (loads[bundle[:50_000]] < 256).all()
    window, k = packing.pack_shard(sizes, 2048)
    assert np.bincount(window, weights=sizes).max() <= 2048 and k <= -(-sizes.sum() // 2048) + 2


def test_op10_differencing_balances():
    sizes = np.random.default_rng(5).integers(1, 512, 500)
    window, k = packing.pack_shard(sizes, 2048)
    loads = np.bincount(window, weights=sizes, minlength=k)
    assert loads.max() <= 2048 and loads.max() - loads.min() <= 64


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "passages", "packed"]
    docs = documents(spark)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SMALL)
        if name == "quality":
            good = {r.doc_id for r in nbsvm.classify(now, labels).filter("predicted = 1").collect()}
            assert sorted(texts(after)) == sorted(r for r in texts(now) if r[0] in good)
        elif name == "exact":
            want = {}
            for d, t in texts(now):
                want[t] = max(d, want.get(t, d))
            assert {(t, d) for d, t in texts(after)} == set(want.items())
        elif name == "near":
            assert {d for d, _ in texts(after)} == set(brute_alike(texts(now)))
        elif name == "passages":
            assert Counter(texts(after)) == cut_by_brute_force(texts(now))
        if name != "packed":
            assert after.columns == docs.columns
            now = materialise(after, "stage")
        else:
            pieces = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after.collect()]
            ids = {d: bpe_ids(t, 1) for d, t in texts(now)}
            assert sum(p[2] for p in pieces) == sum(len(x) // 4 for x in ids.values())
            assert all(zlib.crc32(ids[d][4 * a : 4 * (a + n)]) == crc and total == len(ids[d]) // 4 for d, a, n, crc, total in pieces)
    ran = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert Counter(ran) == Counter(pieces)


def test_stages_take_odd_rows_and_no_rows(spark):
    import corpus_pipeline

    docs = frame(spark, odd_rows()).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    want = {"exact": len({t or "" for _, t in odd_rows()}), "packed": None}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name == "packed":
            tokens = Counter()
            for r in after.collect():
                tokens[r.doc_id] += r.length
            want_ids = Counter()
            for d, t in odd_rows():
                want_ids[d] += len(bpe_ids(t, 1)) // 4
            assert tokens == want_ids
        else:
            assert after.columns == docs.columns
            if name != "passages":  # which cuts texts
                assert not set(texts(after)) - set(odd_rows())
        if want.get(name):
            assert after.count() == want[name]
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_near_stage_checks_what_the_ring_proposes(spark, monkeypatch):
    """The ring links fingerprints first; of its links only those alike enough by their sets count."""
    import corpus_pipeline
    from tidemark.llm import jaccard_join, simhash

    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    far = [f"v{i}" for i in range(90)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, " ".join(far[:45]))], "doc_id long, text string")
    proposed = []

    def ring(distinct, keep):
        found = real(distinct, keep=keep)
        proposed.append(distinct.count())
        prints = [r.fp for r in distinct.collect()]
        every = [(a, b) for a in prints for b in prints if a < b]  # all pairs, most of them wrong
        return found.unionByName(spark.createDataFrame(every, "a long, b long"))

    real = simhash.links
    monkeypatch.setattr(simhash, "links", ring)
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert proposed == [5] and kept == {1, 3, 4, 5}
    sets = jaccard_join.shingle_sets([" ".join(words), " ".join(near)], 5)
    assert bin(jaccard_join._print(sets[0]) ^ jaccard_join._print(sets[1])).count("1") <= 12


def test_ring_gives_the_near_stage_all_pairs_within_its_bits(spark):
    """Not only links that connect them: a pair counts though its ends are linked to others, or not alike to these."""
    from tidemark.llm import jaccard_join

    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 30).tolist()
    fps += [f ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for f in fps for _ in range(7)]
    blank = bytes(jaccard_join.BITS // 8)
    rows = [(i, f, i if i % 5 else 0, 40, blank) for i, f in enumerate(fps)]
    facts = spark.createDataFrame(rows, "cls long, fp long, comp long, size int, bits binary")
    cfg = jaccard_join.Alike(block=4)
    keyed = jaccard_join._ring_elements(facts, simhash.ring_keys)
    got = jaccard_join._tile_pairs(jaccard_join._tiled(keyed, facts, cfg), cfg, False, simhash.MAX_BITS)
    want = {(i, j) for j in range(len(fps)) for i in range(j) if rows[i][2] != rows[j][2] and (fps[i] ^ fps[j]).bit_count() <= 4}
    assert len(want) > 400 and {tuple(r) for r in got.collect()} == want
    forest = simhash.links(facts.select("fp").distinct()).count()
    assert forest < len(want)  # what the stage compared before
