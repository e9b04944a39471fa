"""Vector search and dedup, packing, sharding, WARC, tokens and languages against brute force."""

import base64
import gzip
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumen.llm import cover_tree, embed_dedup, entry, langid, packing, sharding, warc, wfst
from vellumen.llm.common import byte_column

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int, score string, id long, `group` string"


def vectors(seed=1, n=150, width=6):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=width) * r.choice([0, 0.02, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(r.integers(3)), "s", 1, "g"))
    odd = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [float("nan")] * width, [float("inf")] * width, [1e30] * width, [3e38] * width, [1.0] * (width + 1), [1e-40] * width]
    rows += [(n + i, v, 1, None, None, None) for i, v in enumerate(odd)]
    rows += [(n + 50, rows[0][1], None, "s", 1, "g"), (None, rows[0][1], rows[0][2], "s", 1, "g"), rows[4], rows[4], (n + 60, rows[4][1], rows[4][2], "s", 1, "g")]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, value in (("DATA", 40), ("QUERIES", 7), ("LEAF", 2), ("CHUNK", 2), ("FIRST", 9), ("PRODUCTS", 20), ("SAMPLE", 60)):
            monkeypatch.setattr(cover_tree, name, value)
    rows = vectors()
    found = cover_tree.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, k=5).collect()
    data = {}
    for i, v, *_ in rows:
        if i is not None and usable(v):
            data[i] = min(data.get(i, v), v)
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in data.items()}
    want = []
    for q, x in whole.items():
        if q % 5 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in whole.items() if i != q and len(y) == len(x))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert Counter(map(tuple, found)) == Counter(want)


def test_cover_tree_holds_its_promises():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(300, 4)), np.repeat(r.normal(size=(3, 4)), 40, axis=0)])
    tree = cover_tree.CoverTree(x)
    assert sorted(tree.points) == list(range(len(x)))
    for node in range(len(tree.centre)):
        own = tree.points[tree.start[node] : tree.stop[node]]
        assert np.linalg.norm(x[own] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-12
        children = range(tree.child[node], tree.last[node])
        assert sum(tree.stop[c] - tree.start[c] for c in children) in (0, len(own))


def test_dual_tree_prunes_what_can_be_pruned():
    """Products of nodes and points against those of brute force: few where vectors lie in clusters, hardly more where they don't."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 16)) * 100
    near = np.floor(np.repeat(centres, 60, axis=0) + r.normal(size=(3600, 16)) * 4)
    far = np.floor(r.normal(size=(2000, 64)) * 100)
    for x, most in ((near, 0.25), (far, 1.1)):
        ids = np.arange(len(x))
        q = ids % 50 == 0
        run = cover_tree.DualTreeSearch(cover_tree.CoverTree(x[q]), ids[q], cover_tree.CoverTree(x), ids, 5)
        best = run.run()
        for i, found in zip(ids[q], best, strict=True):
            want = sorted((-int(s), int(j)) for j, s in enumerate(x @ x[i]) if j != i)[:5]
            assert found == want
        assert run.work < most * q.sum() * len(x)


def test_blocks_that_cannot_hold_better_ones_are_not_searched():
    space = cover_tree.Space({2: np.array([[0.0, 1.0], [100.0, 0.0], [-100.0, 0.0]])})
    space.measure([{"width": 2, "cell": c, "far": 1.0, "n": 10, "asked": 5} for c in range(3)])
    assert space.first(2, 1) == 1
    tops = space.tops(2, 1)
    assert tops[1] >= 101 * 101 and tops[2] < 0 and abs(tops[0]) < 300


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("tile", "least"), [(2048, 0.98), (10, 0.9), (7, -0.5)])
def test_embedding_near_duplicates(spark, monkeypatch, tile, least):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = vectors(2)
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), least=least).collect()
    assert len(found) == len(rows)
    linkable = [(n, r) for n, r in enumerate(rows) if r[0] is not None and r[2] is not None and usable(r[1]) and any(r[1]) and 1e-290 < sum(x * x for x in r[1]) < 1e290]
    pairs = []
    for n, a in linkable:
        for m, b in linkable:
            if n < m and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    pairs.append((n, m))
    links = Counter(n for p in pairs for n in p)
    roots = components([(rows[a][0], rows[b][0]) for a, b in pairs], {r[0] for r in rows if r[0] is not None})
    want = Counter((r[0], links[n], roots.get(r[0]), r[0] is not None and roots[r[0]] == r[0]) for n, r in enumerate(rows))
    assert Counter(map(tuple, found)) == want


def test_an_id_with_several_vectors_and_labels(spark):
    """Ids tell rows apart no more than nothing does: links are those of the rows' own vectors and labels."""
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a"), (5, [1.0, 1.0], "a"), (5, [1.0, 1.0], "b"), (6, [1.0, 1.01], "b"), (7, [1.0, 1.01], "a"), (5, [1.0, 1.0], "a")]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 2, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 5, False), (5, 2, 5, True)]
    assert Counter(map(tuple, found)) == Counter(want)


DOCS = "doc_id long, text string, ids string, piece string, offset string, _part int, shard int"


def documents(n=80):
    r = random.Random(4)
    al = ["the ", "don't", " 'll", "É", "é", "<|startoftext|>", "<|ENDOFTEXT|>", "\n", "İ", "中文", " 12,3", "word. ", "naïve ", "\x00", "▁", "…", "tion", "😀"]
    rows = [(i, "".join(r.choice(al) for _ in range(r.choice([0, 3, 60, 900])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "a b " * 9000), (None, "x y"), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", 1, 2) for i, t in rows], DOCS)


def test_pieces_and_packing(spark):
    rows = documents()
    tool = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256, k, len(part), np.array(part, "<u4").tobytes()] += 1
    pieces = packing.pieces(frame(spark, rows).repartition(3), WORDS, capacity=256)
    assert Counter((*r[:4], bytes(r[4])) for r in pieces.collect()) == want
    placed = packing.pack(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), capacity=256).collect()
    assert Counter(r["length"] for r in placed) == Counter(w[3] for w in want.elements())
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(r["length"] for r in placed) / 256) * 1.02 + 2
    unique = pieces.where("doc_id > 3")
    whole = packing.sequences(unique, packing.pack(unique.drop("ids"), capacity=256)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(w[3] for w in want.elements() if w[0] is not None and w[0] > 3)


def fewest(lengths, capacity):
    """The least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_plan_is_sound_and_the_reduction_exact():
    r = random.Random(5)
    for _ in range(300):
        capacity = r.choice([7, 10, 20])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        counts = Counter(lengths)
        left = Counter(counts)
        fixed = packing.reduced(left, capacity)
        used = Counter(n for s, times in fixed for n in s for _ in range(times))
        assert used + left == counts and all(sum(s) <= capacity for s, _ in fixed)
        assert sum(times for _, times in fixed) + fewest(list(left.elements()), capacity) == fewest(lengths, capacity)
        bins, ranks = defaultdict(list), defaultdict(list)
        for length, a, b, sequence, offset in packing.plan(counts, capacity):
            ranks[length].append((a, b))
            for k in range(a, b):
                bins[sequence + k - a].append((offset, length))
        for length, n in counts.items():
            assert sorted(k for a, b in ranks[length] for k in range(a, b)) == list(range(n))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= fewest(lengths, capacity) + 1
    big = packing.plan({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(big) < 200_000


def test_another_tokenizer_gets_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "the cat  sat"), (2, ""), (3, None)]
    tool = Tokenizer.from_file(path)
    found = {r["doc_id"]: bytes(r["ids"]) for r in packing.pieces(frame(spark, rows), path).collect()}
    assert found == {i: np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in rows}


def test_sharding(spark):
    rows = documents()
    tree = sharding.topology(16)
    found = sharding.assign(frame(spark, rows), tree, sharding.grown(tree), rows_per_part=10).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in found)
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        order = [((-1 if r["doc_id"] is None else r["doc_id"]), r["size"], r["text_crc32"]) for r in sorted(part, key=lambda r: r["slot"])]
        assert order == sorted(order)
    assert sharding.assign(frame(spark, []), tree).count() == 0


def test_sharding_weights_and_movement(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    uneven = [sharding.Shard("a", "a0", 0, 3.0), sharding.Shard("a", "a1", 1, 1.0), sharding.Shard("b", "b0", 2, 2.0), sharding.Shard("b", "b0", 3, 0.0)]
    heavier = [*uneven[:2], sharding.Shard("b", "b0", 2, 4.0), uneven[3]]
    rows = keys.select(sharding.place(F.col("k"), uneven).alias("s"), sharding.place(F.col("k"), heavier).alias("t")).collect()
    n = Counter(r["s"] for r in rows)
    assert abs(n[0] / 20000 - 0.5) < 0.02 and abs(n[1] / 20000 - 1 / 6) < 0.02 and abs(n[2] / 20000 - 1 / 3) < 0.02 and not n[3]
    assert all(r["s"] == r["t"] or r["t"] == 2 for r in rows)
    with pytest.raises(ValueError):
        sharding.place(F.lit("k"), [])


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "same"), (2, "http://b/", "same"), (0, None, "other"), (3, "http://c/\nx", None), (4, "u", ""), (None, "n", "same"), (5, "v", "é" * 70000), (5, "v", "é" * 70000), (6, "r", "\r\n\r\nWARC/1.1\r\n"), (7, "w", "é" * 70000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, first int").repartition(3)
    folder = f"file://{tmp_path}/archive"
    for least in (0, 5):
        index = warc.write(df, folder, least)
        found = warc.read(index, folder).collect()
        first = {}
        for i, _, h in pages:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        want = Counter()
        for i, _, h in pages:
            data = (h or "").encode()
            revisit = len(data) >= least and i != first[h or ""]
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None, None if revisit else data] += 1
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found) == want
        some = warc.read(index.where("page_id % 2 = 1"), folder).collect()
        assert {r["page_id"] for r in some} == {1, 3, 5, 7}
    files = list((tmp_path / "archive").iterdir())
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files if f.stat().st_size)
    assert warc.read(warc.write(df.limit(0), folder), folder).count() == 0


def test_ranges_join_neighbours(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 5)
    monkeypatch.setattr(warc, "READ", 30)
    assert list(warc.ranges([0, 10, 18, 40, 60], [10, 5, 10, 10, 50])) == [(0, 28, [0, 1, 2]), (40, 10, [3]), (60, 50, [4])]


def test_a_damaged_record_is_noticed():
    member, _ = warc.record(1, "http://a/", b"payload", None, False, "1970-01-01T00:00:00Z")
    data = gzip.decompress(member).replace(b"payload", b"paylo4d")
    with pytest.raises(ValueError):
        warc.parsed(gzip.compress(data))


def test_sentencepiece(spark):
    rows = documents()
    tool = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = wfst.encode(frame(spark, rows).repartition(2), PIECES)
    found = wfst.decode(encoded.select("doc_id", "n_tokens", "ids"), PIECES).collect()
    want = Counter((i, tuple(tool.encode(t or "")), tool.decode(tool.encode(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["text"]) for r in found) == want
    plain = {i: t or "" for i, t in rows if i is not None and "▁" not in (t or "")}
    assert all(r["text"] == plain[r["doc_id"]] for r in found if r["doc_id"] in plain)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3 | 2) + varint(len(value)) + value


def a_model(pieces, kind, fallback=True, charsmap=b"", prefix=1, squeeze=0, escape=1):
    """A model file with given pieces (text, score, type)."""
    head = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in (*head, *pieces))
    spec = field(3, kind) + field(35, int(fallback))
    return body + field(2, spec) + field(3, field(1, b"made") + (field(2, charsmap) if charsmap else b"") + field(3, prefix) + field(4, squeeze) + field(5, escape))


def merges(r, alphabet, n, blank="▁"):
    """Pieces of a BPE model: the letters, and pieces made of two earlier ones; some letters are in longer pieces only."""
    made = [*alphabet, blank]
    for _ in range(n):
        p = r.choice(made) + r.choice(made)
        if len(p) < 9 and p not in made:
            made.append(p)
    gone = set(alphabet[-2:])
    return [(p, -float(i), 1) for i, p in enumerate(made) if p not in gone]


UNIGRAM_PIECES = [(p, s, 1) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -4.5), ("bb", -5.25), ("▁ab", -6.0), ("aab", -6.75), ("fi", -7.5), ("1", -6.125), ("ガ", -8.0))]


def nfkc():
    """The character map that the library has for its usual normaliser."""
    model = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return dict(wfst.fields(dict(wfst.fields(model))[3]))[2]


def model_cases():
    r = random.Random(16)
    bpe = merges(r, list("abcdefé1"), 60)
    users = [("ab", 0.0, 4), ("abc", 0.0, 4), ("c▁", 0.0, 4), ("ﬁ", 0.0, 4)]
    others = [p for p in bpe if p[0] not in {u[0] for u in users}]
    unused = [(p, s, 5 if len(p) > 2 and k % 3 == 0 else t) for k, (p, s, t) in enumerate(bpe)]
    yield "unigram", a_model(UNIGRAM_PIECES, 1)
    yield "unigram without fallback", a_model(UNIGRAM_PIECES, 1, fallback=False)
    yield "unigram with a map", a_model(UNIGRAM_PIECES, 1, charsmap=nfkc(), squeeze=1)
    yield "unigram with users' pieces", a_model([*UNIGRAM_PIECES, ("ba", 0.0, 4), ("a▁b", 0.0, 4)], 1)
    yield "bpe", a_model(bpe, 2)
    yield "bpe without fallback", a_model(bpe, 2, fallback=False)
    yield "bpe with a map", a_model(bpe, 2, charsmap=nfkc(), squeeze=1)
    yield "bpe with a map, blanks stay", a_model(bpe, 2, charsmap=nfkc(), squeeze=0)
    yield "bpe without a prefix", a_model(bpe, 2, prefix=0, squeeze=1)
    yield "bpe with users' pieces", a_model([*others, *users], 2)
    yield "bpe with users' pieces and a map", a_model([*others, *users], 2, charsmap=nfkc(), squeeze=1)
    yield "bpe with unused pieces", a_model(unused, 2)
    yield "bpe of plain blanks", a_model(merges(r, list("abcdefé1"), 60, " "), 2, escape=0)


def model_texts():
    r = random.Random(17)
    parts = [*"aabbccdefé1", "ab", "abc", " ", " ", "  ", "▁", "ﬁ", "①", "ｶﾞ", "㈱", "\u00a0", "\t", "\u200b", "x", "中文", "\x01", "😀", "e\u0301"]
    return ["", " ", "   ", "▁", "\u200b", " \t "] + ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)]


@pytest.mark.parametrize(("name", "model"), list(model_cases()), ids=[n for n, _ in model_cases()])
def test_compiled_models_encode_and_decode_as_the_library(tmp_path, name, model):
    (tmp_path / "m").write_bytes(model)
    tool = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = model_texts()
    coder = wfst.Codec(str(tmp_path / "m"))
    ids, at = coder.encode(*byte_column(pa.array(texts)))
    decoded = coder.decode(ids, at)
    for n, text in enumerate(texts):
        want = tool.encode(text)
        assert ids[at[n] : at[n + 1]].tolist() == want, (name, text)
        assert coder.fst.encode(text) == want
        assert decoded[n].decode() == tool.decode(want), (name, text)


@pytest.mark.parametrize("seed", range(6))
def test_one_path_of_a_bpe_model_is_finite(seed):
    """Of all paths through each text and each of its beginnings one is finite: what merging leaves. Ties among scores included."""
    r = random.Random(30 + seed)
    pieces = merges(r, list("abc"), 40)
    if seed % 2:
        pieces = [(p, float(round(s / 7)), t) for p, s, t in pieces]
    fst = wfst.Transducer(a_model(pieces, 2))
    names = {s: i for i, s in enumerate(fst.symbols) if s and (len(s) == 1 or s in fst.merges.whole)}

    def paths(text):
        """Sequences of symbols with finite arcs that spell the text."""
        out, todo = [], [((), 0)]
        while todo:
            path, at = todo.pop()
            if at == len(text):
                out.append(path)
            for stop in range(at + 1, len(text) + 1):
                symbol = names.get(text[at:stop])
                if symbol is not None and (not path or fst.merges.arc(path[-1], symbol) == 0.0):
                    todo.append(((*path, symbol), stop))
        return out

    for _ in range(150):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 11)))
        found = paths(text)
        assert len(found) == 1 and [fst.symbols[i] for i in found[0]] == fst.merges.merged(text), text
        assert fst.shortest(text) == [i for s in found[0] for i in fst.emits[s]]


def test_decoding_any_ids_as_the_library(tmp_path):
    r = random.Random(18)
    for name, model in model_cases():
        (tmp_path / "m").write_bytes(model)
        tool = sentencepiece.SentencePieceProcessor(model_proto=model)
        coder = wfst.Codec(str(tmp_path / "m"))
        for _ in range(150):
            ids = [r.choice([0, 1, 2, r.randrange(len(tool)), len(tool) - 1 - r.randrange(9)]) for _ in range(r.randint(0, 6))]
            assert coder.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == tool.decode(ids), (name, ids)


def test_shortest_path_by_hand():
    """The composed machine of a small model, written out, against the compiled one."""
    fst = wfst.Transducer(a_model(UNIGRAM_PIECES, 1))
    score = {p: s for p, s, t in UNIGRAM_PIECES}
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice("aab  ") for _ in range(r.randint(0, 9)))
        full = fst.normalised(text)
        best = {0: 0.0}
        for e in range(1, len(full) + 1):
            best[e] = max(best[s] + score.get(full[s:e], -1e9) for s in range(e))
        ids = fst.encode(text)
        assert "".join(fst.pieces[i] for i in ids) == full
        assert sum(fst.scores[i] for i in ids) == pytest.approx(best[len(full)])
    assert [fst.pieces[i] for i in fst.encode("é")] == ["▁", "<0xC3>", "<0xA9>"]
    # Every path of a BPE model, weighed: one is finite, and it is the library's.
    model = a_model(merges(r, list("abc"), 12), 2)
    fst, tool = wfst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)

    def paths(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            symbol = next((i for i in fst.lexicon.accepts if i >= 0 and fst.symbols[i] == text[:n]), None)
            if symbol is not None:
                yield from ([symbol, *rest] for rest in paths(text[n:]))

    for _ in range(60):
        text = "".join(r.choice("abc ") for _ in range(r.randint(1, 6)))
        finite = [p for p in paths(fst.normalised(text)) if sum(fst.merges.arc(a, b) for a, b in zip(p, p[1:], strict=False)) == 0]
        assert len(finite) == 1 and [i for s in finite[0] for i in fst.emits[s]] == tool.encode(text)


def test_models_that_are_not_compiled_are_refused():
    model = a_model(UNIGRAM_PIECES, 1)
    for more in (field(2, field(3, 3)), field(2, field(24, 1)), field(5, field(2, b"map"))):
        with pytest.raises(ValueError):
            wfst.Transducer(model + more)


LANGUAGES = {"en": "the cat sat on that mat and it was there with this", "de": "der hund und die katze ist nicht auf dem großen haus", "fr": "le chat est dans la maison et les enfants où très"}


def labelled(n=240):
    r = random.Random(7)
    rows = []
    for i in range(n):
        lang = r.choice(list(LANGUAGES))
        rows.append((i, " ".join(r.choice(LANGUAGES[lang].split()) for _ in range(r.randint(5, 60))), lang, f"host{i % 4}", 0))
    return rows


def test_language_id(spark):
    rows = labelled()
    odd = [(1000, None, None, None, 0), (1001, "", "en", "host1", 0), (1002, "1234 !!!", None, "host1", 0), (None, "the cat sat on that mat", None, "host1", 0), (1003, "zq xv kj qp " * 30, None, "host2", 0), (5, *rows[5][1:]), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs.where("doc_id < 1000 AND doc_id % 2 = 0"), per_language=60)
    found = langid.documents(docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    held = {i: lang for i, _, lang, *_ in rows if i % 2}
    assert np.mean([r["language"] == held[r["doc_id"]] for r in found if r["doc_id"] in held]) == 1
    by = {r["doc_id"]: r for r in found}
    assert not any(by[i]["accepted"] for i in (1000, 1001, 1002, 1003)) and by[None]["language"] == "en"
    assert all(r["accepted"] for r in found if r["doc_id"] in held)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.documents(none).count() == 0
    assert langid.corpus(none, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert cover_tree.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    assert wfst.decode(wfst.encode(frame(spark, []), PIECES), PIECES).count() == 0
    assert packing.pack(packing.pieces(frame(spark, []), WORDS).drop("ids")).count() == 0
    bare = spark.createDataFrame([(1, "text", None, None, 0)], none.schema)
    assert [r["language"] for r in langid.documents(bare).collect()] == ["und"]


def test_language_scores_by_hand():
    raw, at = byte_column(pa.array(["The  cat!", None, "É"]))
    slots, count = langid.trigrams(raw, at)
    padded = [b" the  cat  ", b"", " É ".encode()]
    want = [[(b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32 >> 16 for i in range(len(b) - 2) if b[i : i + 3] != b"   "] for b in padded]
    assert count.tolist() == [len(w) for w in want] and slots.tolist() == [s for w in want for s in w]


def test_declared_language_and_host_weigh_in(spark):
    rows = labelled(120)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), per_language=40)
    pages = [(i, f"https://{lang}.example.{'de' if lang == 'de' else 'org'}/x", f'<html lang="{lang}-XX"><script>no</script><p>{t}</p>') for i, t, lang, *_ in rows]
    pages += [(900 + k, f"https://{lang}.example.{'de' if lang == 'de' else 'org'}/y", f"<html lang={lang}><b>est it</b>") for k, lang in enumerate(("en", "fr"))]
    found = {r["page_id"]: r["language"] for r in langid.pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert (found[900], found[901]) == ("en", "fr")
    host = spark.createDataFrame([("HTTPS://u@A.b.Example.org:80/p?q", '<HTML dir=x LANG = "DE-at">'), ("x", "<p lang=fr>"), (None, None)], "u string, m string")
    got = host.select(*langid.host_parts(F.col("u")), langid.declared_language(F.col("m"))).collect()
    assert [tuple(g) for g in got] == [("a.b.example.org", "example.org", "org", "de"), (None, None, None, None), (None, None, None, None)]


def fused(model, rows, evidence=60, smoothing=5.0, noise=1e-6):
    """Posteriors worked out row by row: (id, text, declared, host, domain, suffix) to (id, language, confidence, n, accepted)."""
    langs = range(len(model.languages))
    weights = model.weights
    seen = []
    for _, text, *_ in rows:
        padded = b" " + bytes(langid.FOLD[np.frombuffer((text or "").encode(), np.uint8)]) + b" " if text else b""
        slots = [(padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % 2**32 >> 16 for i in range(len(padded) - 2) if padded[i : i + 3] != b"   "]
        n = len(slots)
        scale = min(n, evidence) / max(n, 1)
        ll = [scale * math.fsum(float(weights[s, i]) for s in slots) for i in langs] + [-n * math.log(langid.SLOTS) * scale]
        ll = [x - max(ll) for x in ll]
        p = [math.exp(x) for x in ll[:-1]]
        seen.append((n, ll, [round(1e6 * x / sum(p)) / 1e6 if n else 0.0 for x in p]))
    out = []
    for k, (i, _, *keys) in enumerate(rows):
        n, ll, _ = seen[k]

        def others(column):
            """Sums over the other rows with the same value there."""
            mine = [m for m, r in enumerate(rows) if m != k and (column is None or (keys[column] is not None and r[2 + column] == keys[column]))]
            return [sum(seen[m][2][j] for m in mine) for j in langs]

        top = others(None)
        prior = [(x + 1) / (sum(top) + len(langs)) for x in top]
        for column in (2, 1):  # domain, then host
            level = others(column)
            prior = [(x + smoothing * p) / (sum(level) + smoothing) for x, p in zip(level, prior, strict=True)]
        scores = [x + math.log(p) for x, p in zip(ll, prior, strict=False)]
        none = ll[-1] + math.log(noise)
        for column in (0, 3):  # declared, suffix
            if keys[column] is not None:
                level = others(column)
                marginal = (sum(level) + 0.5) / (sum(top) + 1)
                scores = [s + math.log((x + smoothing * marginal) / (t + smoothing)) for s, x, t in zip(scores, level, top, strict=True)]
                none += math.log(marginal)
        scores.append(none)
        best = scores.index(max(scores))
        name = [*model.languages, "und"][best] if n else "und"
        out.append((i, name, 1 / sum(math.exp(s - max(scores)) for s in scores) if n else 0.0, n, name != "und"))
    return out


@pytest.mark.parametrize("frequent", [1 << 16, 3])
def test_the_posterior_by_brute_force(spark, monkeypatch, frequent):
    """Documents and pages with every kind of evidence, and with none of some, against the formula row by row."""
    from vellumen.llm import common

    monkeypatch.setattr(common, "FREQUENT", frequent)
    monkeypatch.setattr(common, "SALTS", 4)
    rows = [*labelled(40), (50, None, None, None, 0), (51, "", "en", "host1", 0), (52, "!!", None, "host1", 0), (53, "est le zq", None, None, 0), (3, *labelled(40)[3][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.train(docs.where("lang IS NOT NULL"), per_language=8)
    pages = [(k, f"https://{lang}{k % 2}.example.{'de' if lang == 'de' else 'org'}/x" if k % 5 else None, f'<html{f" lang={lang}" if k % 3 else ""}><p>{t[: 9 + k]}</p>') for k, (_, t, lang, *_) in enumerate(labelled(30))]
    found = langid.corpus(docs, spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    every = [(i, t, None, s, None, None) for i, t, _, s, _ in rows]
    for k, url, html in pages:
        host = url.split("/")[2] if url else None
        every.append((-1 - k, " " + " " + html[html.index("<p>") + 3 : -4] + " ", html[11:13] if "lang" in html[:12] else None, host, ".".join(host.split(".")[-2:]) if host else None, host.split(".")[-1] if host else None))
    want = fused(model, every)
    key = lambda r: (r[0], r[3])
    for got, (i, name, confidence, n, accepted) in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert (got["doc_id"], got["language"], got["n_trigrams"], got["accepted"]) == (i, name, n, accepted)
        assert got["confidence"] == pytest.approx(confidence, abs=2e-6)


def test_every_language_is_learned_or_the_table_refused(spark):
    rows = [(f"text number {i} of {lang}", lang) for lang, n in (("a", 5), ("b", 3), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert langid.train(frame, languages=3).languages == ("a", "b", "c")
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.train(frame, languages=2)


def test_two_hundred_languages(spark):
    """The work is in proportion to the languages: 2000 texts in 200 of them, within a minute, as by the formula row by row."""
    r = random.Random(4)
    words = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(30)] for _ in range(200)]
    rows = [(i, " ".join(r.choices(words[i % 200], k=r.choice([2, 3, 40]))), f"l{i % 200:03}", f"h{i % 37}", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    began = time.monotonic()
    model = langid.train(docs, per_language=8)
    found = {x["doc_id"]: x for x in langid.documents(docs, model).collect()}
    assert time.monotonic() - began < 60
    assert len(model.languages) == 200 and np.mean([found[i]["language"] == lang for i, _, lang, *_ in rows]) > 0.98
    few = rows[:60]
    got = {x["doc_id"]: x for x in langid.documents(docs.where("doc_id < 60"), model).collect()}
    for i, name, confidence, n, accepted in fused(model, [(i, t, None, s, None, None) for i, t, _, s, _ in few]):
        assert (got[i]["language"], got[i]["n_trigrams"], got[i]["accepted"]) == (name, n, accepted)
        assert got[i]["confidence"] == pytest.approx(confidence, abs=2e-6)


def test_training_takes_a_copied_text_once(spark):
    rows = [("the same text", "en")] * 400 + [(f"quite different words {i}", "en") for i in range(40)]
    model, other = (langid.train(spark.createDataFrame(x, "text string, lang string"), per_language=60) for x in (rows, sorted(set(rows))))
    assert model.languages == ("en",) and (model.weights == other.weights).all()


def test_embeddings_of_any_scale(spark):
    rows = [(i, [3.0 * s, 4.0 * s], 0) for i, s in enumerate([1.0, 1e-160, 1e160, 5e-324, 4e307])] + [(9, [4e307, -3e307], 0)]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {i: (4, 0) for i in range(5)} | {9: (0, 9)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    rows = [(i, t + " " + " ".join("".join(r.choice("aeiotn") for _ in range(7)) for _ in range(30)), lang, s, 0) for i, t, lang, s, _ in labelled(60)]
    passage = " ".join("passage" + str(k) for k in range(60))
    rows += [(100 + k, rows[0][1], "en", "host0", 0) for k in range(3)] + [rows[1], rows[1], (None, rows[2][1], "en", "host0", 0)] + [(200 + k, rows[k][1] + passage, "en", "host0", 0) for k in range(2)] + [(300, "1234", None, None, 0), (301, "", None, "x", 0), (302, None, None, "x", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert not {300, 301, 302} & set(seen["language_id"]) and set(range(60)) <= set(seen["language_id"])
    assert set(seen["simhash_near_dedup"]) & {0, 100, 101, 102} == {0}
    assert spark.read.parquet(f"{tmp_path}/simhash_near_dedup").where("doc_id = 1").count() == 1 and None not in seen["simhash_near_dedup"]
    assert "passage30" not in seen["suffix_array_dedup"].get(200, "")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in packed} == set(seen["suffix_array_dedup"])


def test_pipeline_keeps_other_columns_whatever_their_names(spark):
    import corpus_pipeline

    names = ["_key", "_n", "_text", "kept", "n_bytes", "n_removed", "n_spans", "row", "id", "gone", "key", "out", "fingerprint", "component", "node", "accepted", "language", "a.b", "first"]
    rows = [(i, t, lang, s, 0, *(f"{n} of {i}" for n in names)) for i, t, lang, s, _ in labelled(30)] + [(None, None, None, None, None, *names)]
    schema = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in names)])
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        found = out.collect()
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in found if r["doc_id"] is not None for n in names)
        assert len({r["doc_id"] for r in found}) > 20
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 31
    assert [stage(spark, docs.limit(0), "").count() for _, stage in corpus_pipeline.STAGES] == [0, 0, 0, 0]


def test_pipeline_stage_by_stage_against_brute_force(spark, tmp_path):
    """Every stage's rows, worked out plainly from what the one before it kept."""
    import corpus_pipeline
    from tests.llm.test_text_dedup import brute_components, five_word_similarity

    r = random.Random(23)
    word = lambda: "".join(r.choice("aeiourstn") for _ in range(r.randint(3, 9)))
    base = [(i, f"{t} {' '.join(word() for _ in range(60))}", lang, s, 0) for i, t, lang, s, _ in labelled(50)]
    passage = " ".join(word() for _ in range(60))
    rows = list(base)
    for k in range(12):  # near copies, exact copies, a passage in some, and noise
        words = base[k][1].split()
        words[r.randrange(len(words))] = word()
        rows.append((100 + k, " ".join(words), "en", "host1", 0))
    rows += [(200 + k, base[k][1], "en", "host0", 0) for k in range(5)] + [(300 + k, base[20 + k][1] + " " + passage, "en", "x", 0) for k in range(4)]
    rows += [(400, "1234 !!", None, None, 0), (401, None, None, None, 0), (402, "", "en", "x", 0), (403, "zq xv kj qp " * 30, None, "x", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {i: t for i, t, *_ in rows}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    told = {i: ok for i, _, _, _, ok in fused(model, [(i, t, None, s, None, None) for i, t, _, s, _ in rows])}
    first = {i: t for i, t in texts.items() if told[i]}
    assert kept["language_id"] == first and not {400, 401, 402, 403} & set(first) and set(range(50)) <= set(first)
    pairs = [(a, b) for a in first for b in first if a < b and five_word_similarity(first[a], first[b]) >= 0.8]
    roots = brute_components(pairs, first)
    second = {i: t for i, t in first.items() if roots[i] == i}
    assert kept["simhash_near_dedup"] == second and len(second) < len(first) - 12
    raw, times = {i: t.encode() for i, t in second.items()}, Counter()
    for b in raw.values():
        times.update(b[p : p + 200] for p in range(len(b) - 199))
    third = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        third[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode()  # ASCII, so characters stay whole
    assert kept["suffix_array_dedup"] == third and third != second
    tool = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in third.items():
        ids = [*tool.encode(t, add_special_tokens=False).ids, 0]
        want[i, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in packed) == want
    sequences = defaultdict(list)
    for p in packed:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert all(sum(n for _, n in parts) <= 2048 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] for parts in sequences.values())
    assert len(sequences) == math.ceil(sum(w[3] for w in want) / 2048)


def test_entry_has_a_query_for_each_operator():
    names = list(entry.queries())
    assert [next(n for n in names if n.startswith(f"op{i}_")) for i in range(1, 11)]
    assert set(entry.oracle_sql()) <= set(names)
