"""Substring, suffix and SimHash deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellumen.llm import simhash, suffix_dedup, superkmer
from vellumen.llm.common import connected_components, deltas, summed

SCHEMA = "doc_id long, text string, batch string, key string, kind int, u long, payload string"


def frame(spark, rows):
    """Documents, with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "b", "k", 1, 2, None) for i, t in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_texts(seed, n=60, alphabet=6, longest=40):
    r = random.Random(seed)
    vocabulary = ["a", "bb", "é", "中文", "d\x00d", "x" * 50][:alphabet]
    rows = []
    for i in range(n):
        rows.append((i, r.choice(["", " ", "\n"]) + r.choice([" ", "\t", "  \n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, longest)))))
    rows += [(n + i, rows[r.randrange(n)][1]) for i in range(10)]
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \n\t"), (None, rows[3][1]), (None, None), (5, rows[7][1]), (5, rows[5][1]), (5, rows[5][1])]
    rows.append((n + 30, "a bb " * 3000))  # very long, with a period
    return rows


def brute_windows(rows, window):
    least = {}
    big = 2**63 - 1
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            least[g] = min(least.get(g, big), big if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < (big if i is None else i):
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("seed", "window", "alphabet"), [(1, 13, 2), (2, 4, 4), (3, 1, 6)])
def test_superkmer_windows(spark, seed, window, alphabet):
    rows = some_texts(seed, alphabet=alphabet)
    found = superkmer.drop_repeated_windows(frame(spark, rows).repartition(3), window=window)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_text"]
    assert Counter(map(tuple, found.collect())) == Counter(brute_windows(rows, window))


def test_superkmer_with_many_buckets_and_batches(spark, monkeypatch):
    rows = some_texts(4, n=80, alphabet=3)
    monkeypatch.setattr(superkmer, "SLICE", 300)
    monkeypatch.setattr(superkmer, "BUCKET", 500)
    monkeypatch.setattr(superkmer, "RUN", 3)
    assert Counter(map(tuple, superkmer.drop_repeated_windows(frame(spark, rows), window=5).collect())) == Counter(brute_windows(rows, 5))


def test_count_windows_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(superkmer, "rolled", lambda codes, width: np.zeros(len(codes) - width + 1, np.uint64))
    parts = [{"strings": b"a b c\nb c d", "least": deltas(np.array([1, 2])), "most": deltas(np.array([1, 2]))}, {"strings": b"x b c", "least": deltas(np.array([3])), "most": deltas(np.array([3]))}]
    first, second = superkmer.count_windows(parts, 2)
    assert first.T.tolist() == [[1, 0, 1, 1]]
    assert second.T.tolist() == [[0, 1, 1, 1]]


def brute_bytes(rows, length):
    times = Counter()
    for _, t in rows:
        b = (t or "").encode()
        times.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("seed", "length", "alphabet"), [(1, 200, 2), (2, 20, 4), (3, 3, 6)])
def test_suffix_dedup(spark, seed, length, alphabet):
    rows = some_texts(seed, alphabet=alphabet)
    found = suffix_dedup.drop_repeated_bytes(frame(spark, rows).repartition(3), length=length)
    assert Counter((*r[:4], bytes(r[4])) for r in found.collect()) == Counter(brute_bytes(rows, length))


def test_suffix_dedup_with_many_buckets_and_batches(spark, monkeypatch):
    rows = some_texts(5, n=80, alphabet=3)
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 2000)
    found = suffix_dedup.drop_repeated_bytes(frame(spark, rows), length=30)
    assert Counter((*r[:4], bytes(r[4])) for r in found.collect()) == Counter(brute_bytes(rows, 30))


def test_suffix_dedup_keeps_whole_characters_and_columns(spark):
    rows = [(1, "é" * 20 + "x"), (2, "中文" + "é" * 20), (3, "plain")]
    found = suffix_dedup.drop_repeated_bytes(frame(spark, rows), length=9, keep=("payload", "kind"), whole_characters=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in found] == ["x", "中文", "plain"]
    assert found[0]["kind"] == 1 and found[0]["payload"] is None


def test_suffix_order_is_right_even_when_hashes_collide(monkeypatch):
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(60)]
    size = np.array([len(s) for s in strings])
    start = np.cumsum(size) - size
    total = np.concatenate([np.full(n, n) for n in (1, 20, 39)])
    place = np.concatenate([np.arange(n) for n in (1, 20, 39)])
    local = np.arange(size.sum()) - np.repeat(start, size)
    suffixes = suffix_dedup.Suffixes(np.frombuffer(b"".join(strings), np.uint8), local, start, size)

    def right():
        order, shared = suffixes.order(place, total)
        for a, b in ((0, 1), (1, 21), (21, 60)):
            group = [strings[i] for i in order[a:b]]
            assert group == sorted(strings[a:b])
            for k in range(1, len(group)):
                assert shared[a + k] == len(__import__("os").path.commonprefix(group[k - 1 : k + 1]))

    right()
    monkeypatch.setattr(suffix_dedup.Suffixes, "hashed", lambda self, x, length: np.zeros(len(x), np.uint64))
    right()


def brute_fingerprint(text, shingle=4):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints(spark):
    rows = [*some_texts(6), (900, "The CAT sat ÉT on"), (901, "Xx")]
    found = simhash.fingerprints(frame(spark, rows)).collect()
    assert Counter((r[0], r[1] & (2**64 - 1)) for r in found) == Counter((i, brute_fingerprint(t)) for i, t in rows)


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (4, 2), (3, 4), (0, 1)])
def test_near_duplicates(spark, radius, segments):
    r = random.Random(radius)
    prints = {i: r.getrandbits(64) for i in range(40)}
    for i in range(40, 200):
        near = prints[r.randrange(i)]
        for b in r.sample(range(64), r.randint(0, 6)):
            near ^= 1 << b
        prints[i] = near
    signed = [(i, p - 2**64 if p >> 63 else p) for i, p in prints.items()] + [(None, 7), (7, 5), (7, 5)]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    found = simhash.near_duplicates(df, radius=radius, segments=segments).collect()
    assert len(found) == len(signed)
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius]
    want = brute_components(pairs, prints)
    assert {r["doc_id"]: r["component_id"] for r in found if r["fingerprint"] not in (5, 7)} == want
    assert [r["component_id"] for r in found if r["fingerprint"] == 7] == [None if radius == 0 else r["component_id"] for r in found if r["fingerprint"] == 7]


def test_near_duplicates_link_rows_without_an_id(spark):
    rows = [(5, 0), (None, 0b1111), (9, 0b11111111), (None, -1), (None, -1)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fingerprint long")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter({(5, 5): 1, (None, 5): 1, (9, 5): 1, (None, None): 2})


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 50)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert Counter((x["node"], x["component"]) for x in found) == Counter(brute_components(edges, nodes).items())
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert superkmer.drop_repeated_windows(none).count() == 0
    assert suffix_dedup.drop_repeated_bytes(none).count() == 0
    assert simhash.near_duplicates(simhash.fingerprints(none)).count() == 0


def test_differences_round_trip():
    for x in ([], [0], [5, 3, 9], [2**63 - 1, -(2**63), 7]):
        assert (summed(deltas(np.array(x, np.int64))) == np.array(x, np.int64)).all()


def test_queries_give_digests(spark, tmp_path):
    rows = some_texts(8, alphabet=2)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows if i is not None], "doc_id long, text string, lang string, source string, n_chars long").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    from vellumen.llm import entry

    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r for r in entry.op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert {i: (found[i]["n_words"], found[i]["kept_sha256"]) for i in found} == {i: (n, hashlib.sha256(t.encode()).hexdigest()) for i, n, _, t in brute_windows(docs, 13)}
    found = {r["doc_id"]: r["kept_sha256"] for r in entry.op9_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.sha256(t).hexdigest() for i, _, _, _, t in brute_bytes(docs, 200)}
    prints = {i: brute_fingerprint(t) for i, t in docs}
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = brute_components(pairs, prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.op4_simhash_near_dedup(spark, str(tmp_path)).collect()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_written_tables_can_be_cleared(spark):
    from vellumen.llm import common

    kept = common.materialize(spark.range(3).toDF("x"))
    assert kept.count() == 3
    common.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])


def test_frames_that_may_change_are_written_before_two_readings(spark, tmp_path):
    from vellumen.llm.routed import repeatable

    frame(spark, [(1, "a"), (2, "b")]).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    plain = docs.where("doc_id > 0").select("doc_id", "text")
    assert repeatable(plain) is plain
    for other in (docs.repartition(2), docs.withColumn("x", F.rand()), docs.groupBy("doc_id").count()):
        assert repeatable(other) is not other


def five_word_similarity(a, b):
    a, b = ({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set() for w in (words_of(a.lower()), words_of(b.lower())))
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("tile", [512, 4])
def test_pipeline_finds_all_near_copies(spark, monkeypatch, tile):
    import corpus_pipeline
    from vellumen.llm import near_copies

    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "FEW", 10)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeioustnr") for _ in range(6))
    texts = {}
    for i in range(0, 200, 10):
        base = [word() for _ in range(r.choice([3, 8, 60, 150]))]
        texts[i] = " ".join(base)
        for k in range(1, 10):  # of each family some pairs are alike and some aren't
            copy = list(base)
            for p in r.sample(range(len(copy)), min(len(copy), r.randint(0, 5))):
                copy[p] = word()
            texts[i + k] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    pairs = [(a, b) for a in texts for b in texts if a < b and five_word_similarity(texts[a], texts[b]) >= 0.8]
    want = brute_components(pairs, texts)
    assert any(brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b]) and bin(brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).count("1") > 4 for a, b in pairs)
    found = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(x["doc_id"] for x in found) == sorted(i for i in texts if want[i] == i)


def test_pipeline_keeps_one_of_like_rows_without_an_id(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:-1], "other"])
    rows = [(1, " ".join(base)), (None, near), (None, "nobody has an id here"), (None, "nobody has an id here"), (None, "nobody has an ID  here")]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"].lower().split()[0]) for r in found) == [(0, "nobody"), (1, "w0")]


def test_pipeline_keeps_unrelated_texts_of_one_id(spark):
    import corpus_pipeline

    rows = [(7, "one text about this"), (7, "quite another thing altogether"), (7, "quite another  thing altogether"), (8, "ONE text about this"), (7, "one text about this")]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"], r["text"].split()[0]) for r in found) == [(7, "one"), (7, "quite")]


def test_components_deal_hubs_over_tasks(spark, monkeypatch):
    from vellumen.llm import common

    monkeypatch.setattr(common, "FREQUENT", 3)
    monkeypatch.setattr(common, "SALTS", 4)
    r = random.Random(13)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(7, i) for i in range(300, 500)] + [(i, 900) for i in range(600, 700)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    found = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert Counter((x["node"], x["component"]) for x in found) == Counter(brute_components(edges, nodes).items())


def test_a_common_pair_of_words_makes_no_large_bucket(spark, tmp_path):
    """Half of the windows hold one pair of words: its bucket would get them all if it were ever a minimiser."""
    from vellumen.llm.common import Words, byte_column
    from vellumen.llm.routed import ranks

    r = random.Random(14)
    rows = [(i, " ".join("common pair" if k % 2 else f"w{r.randrange(3000)} x{r.randrange(3000)}" for k in range(80))) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert Counter(map(tuple, superkmer.drop_repeated_windows(docs, window=13).collect())) == Counter(brute_windows(rows, 13))
    found = suffix_dedup.drop_repeated_bytes(docs, length=60)
    assert Counter((*x[:4], bytes(x[4])) for x in found.collect()) == Counter(brute_bytes(rows, 60))
    # Grams of three words with the pair inside are as rare as others; single pairs aren't.
    for gram, hot in ((2, 0.02), (3, 0.02)):
        monkey, superkmer.GRAM = superkmer.GRAM, gram
        try:
            classes = ranks(docs, "text", 1, 1 << 20, lambda raw, at: superkmer.gram_hashes(Words(raw, at), gram))
            raw, at = byte_column(pa.array([t for _, t in rows]))
            _, count, least = superkmer.super_kmers(Words(raw, at), 13, classes)
        finally:
            superkmer.GRAM = monkey
        load = Counter()
        for n, m in zip(count.tolist(), least.tolist(), strict=True):
            load[m] += n
        assert max(load.values()) < hot * sum(load.values())


def test_texts_of_ten_words_and_a_common_passage(spark, tmp_path, monkeypatch):
    """Every short gram is hot: windows go by long grams, so that no bucket gets more than a few hundredths of them."""
    from vellumen.llm import routed
    from vellumen.llm.common import Words, byte_column

    monkeypatch.setattr(routed, "HOT", 20)
    monkeypatch.setattr(routed, "HOT_MEANS", 0)
    r = random.Random(15)
    ten = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    passage = " ".join(f"passage{k % 7} of{k % 3}" for k in range(30))
    rows = [(i, " ".join([*r.choices(ten, k=r.randint(20, 120)), *([passage] if i % 3 == 0 else []), *r.choices(ten, k=20)])) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(superkmer, "BUCKET", 4000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 4000)
    assert Counter(map(tuple, superkmer.drop_repeated_windows(docs, window=13).collect())) == Counter(brute_windows(rows, 13))
    found = suffix_dedup.drop_repeated_bytes(docs, length=90)
    assert Counter((*x[:4], bytes(x[4])) for x in found.collect()) == Counter(brute_bytes(rows, 90))

    raw, at = byte_column(pa.array([t for _, t in rows]))
    words = Words(raw, at)

    def largest(hot):
        """The share of the distinct strings' windows that the largest bucket gets, for words and for bytes."""
        monkeypatch.setattr(routed, "HOT", 20 if hot else 1 << 40)
        out = []
        for slots, cut in ((routed.ranks(docs, "text", 1, 1 << 20, lambda b, a: superkmer.gram_hashes(Words(b, a), 3)), lambda c: superkmer.super_kmers(words, 13, c)), (routed.ranks(docs, "text", 1, 1 << 20, lambda b, a: suffix_dedup.gram_hashes(b, 16)), lambda c: [x for i, x in enumerate(suffix_dedup.anchored_strings(raw, at, 90, c)) if i != 2])):
            first, count, name = cut(slots)
            load, seen = Counter(), set()
            for f, n, m in zip(first.tolist(), count.tolist(), name.tolist(), strict=True):
                key = (m, n, raw[f : f + n + 89].tobytes() if len(out) else words.buf[words.start[f] : words.end[f + n + 11]].tobytes())
                if key not in seen:  # a string goes to its bucket once a batch
                    seen.add(key)
                    load[m] += n
            out.append(max(load.values()) / sum(load.values()))
        return out

    for split, whole in zip(largest(True), largest(False), strict=True):
        assert split < 0.03 and split <= whole


def test_dense_groups_give_a_forest(spark):
    """Thousands of fingerprints around one: linked, with far fewer rows than links."""
    r = random.Random(19)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 3000:
        near = base
        for b in r.sample(range(64), r.randint(1, 3)):
            near ^= 1 << b
        prints.add(near)
    others = {r.getrandbits(64) for _ in range(50)}
    signed = [(i, p - 2**64 if p >> 63 else p) for i, p in enumerate([*sorted(prints), *sorted(others)])]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    edges = simhash.links(df.select("fingerprint"))
    assert edges.count() < 0.15 * 3000 * 2999 / 2
    found = simhash.near_duplicates(df).collect()
    assert Counter(x["component_id"] for x in found) == Counter({0: 3000}) + Counter(range(3000, 3050))


@pytest.mark.parametrize(("radius", "segments"), [(4, 3), (4, 2)])
def test_dense_keys_link_the_same(spark, monkeypatch, radius, segments):
    monkeypatch.setattr(simhash, "DENSE", 2)
    monkeypatch.setattr(simhash, "TILE", 5)
    monkeypatch.setattr(simhash, "ROWS", 3)
    test_near_duplicates.__wrapped__(spark, radius, segments) if hasattr(test_near_duplicates, "__wrapped__") else test_near_duplicates(spark, radius, segments)


def test_tables_that_nothing_reads_are_deleted(spark):
    import os

    from vellumen.llm import common

    def tables():
        path = common.scratch_dir(spark).removeprefix("file:") + "/tables"
        return set(os.listdir(path)) if os.path.isdir(path) else set()

    kept = common.materialize(spark.range(3).toDF("x"))
    gone = common.materialize(spark.range(3).toDF("x"))
    common.discard(gone, spark.range(1))
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0])
    before = tables()
    found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"))
    assert found.count() == 41 and len(tables() - before) == 1


def test_near_copies_are_candidates_by_simhash():
    import numpy as np

    from vellumen.llm import near_copies

    r = np.random.default_rng(5)
    assert not hasattr(near_copies, "bands")  # min-hash took the place of the method that the stage is named for
    # Against a count bit by bit, also of sets of more than 255 hashes.
    sets_ = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 255, 256, 700)]
    at = np.append(0, np.cumsum([len(x) for x in sets_]))
    found = simhash.long_fingerprints(np.concatenate(sets_), at, 3)
    for x, row in zip(sets_, found, strict=True):
        each = np.array([simhash.long_fingerprints(h[None], np.array([0, 1]), 3)[0] for h in x])
        ones = np.array([[(int(w) >> b) & 1 for w in e for b in range(64)] for e in each]).sum(0)
        assert [2 * n > len(x) for n in ones.tolist()] == [bool((int(w) >> b) & 1) for w in row for b in range(64)]
    # Pairs at a similarity of 0.8, of small and large sets: all agree in a segment, and lie near enough.
    for common, own, other in ((4, 0, 1), (8, 1, 1), (32, 0, 8), (40, 5, 5), (160, 20, 20)):
        sides = []
        for _ in range(40):
            h = r.integers(0, 1 << 63, common + own + other, dtype=np.uint64)
            sides += [np.sort(h[: common + own]), np.sort(np.append(h[:common], h[common + own :]))]
        lists = near_copies.prints(np.concatenate(sides), np.append(0, np.cumsum([len(x) for x in sides])), 18).to_pylist()
        for a, b in zip(lists[::2], lists[1::2], strict=True):
            apart = [((x ^ y) & ((1 << 64) - 1)) for x, y in zip(a, b, strict=False)]
            assert any((x >> (18 * j)) & ((1 << 18) - 1) == 0 for x in apart for j in range(3))
            assert apart[0].bit_count() <= near_copies.RADIUS and sum(x.bit_count() for x in apart[: near_copies.CHECKED]) <= near_copies.APART


@pytest.mark.parametrize("most", [1 << 16, 64])
def test_candidates_of_a_large_group_are_a_forest(spark, monkeypatch, most):
    import numpy as np

    from vellumen.llm import near_copies

    monkeypatch.setattr(near_copies, "MOST", most)  # 64: groups are dealt into tiles
    r = np.random.default_rng(8)
    base, rows, family = r.integers(0, 1 << 63, 120, dtype=np.uint64), [], {}
    for i in range(400):  # copies of one set, each with other hashes of its own, and sets that are like nothing
        h = np.append(base[: 120 - i % 7], r.integers(0, 1 << 63, i % 7 + 1, dtype=np.uint64)) if i < 300 else r.integers(0, 1 << 63, 100, dtype=np.uint64)
        words = near_copies.prints(np.sort(h), np.array([0, len(h)]), 8)[0].as_py()
        rows.append((i, words))
        family[words[0]] = i < 300
    sets_ = spark.createDataFrame(rows, "node long, print array<long>")
    found = [tuple(x) for x in near_copies.candidates(sets_, 8).collect()]
    assert len(found) < (300 * 30 if most > 64 else 44850)  # all pairs of the family; a pair of tiles has a forest of its own
    want = brute_components(found, family)
    assert len({want[x] for x in family if family[x]}) == 1
    assert all(want[x] == x for x in family if not family[x])


def test_near_fingerprints_join_what_all_pairs_join():
    import numpy as np

    from vellumen.llm import near_copies

    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, (3, near_copies.CHECKED), dtype=np.uint64)
    words = r.integers(0, 1 << 63, (700, near_copies.CHECKED), dtype=np.uint64)
    for i in range(600):  # two loose families, of which just some pairs are near
        words[i] = base[i % 2] ^ (r.integers(0, 1 << 63, near_copies.CHECKED, dtype=np.uint64) & r.integers(0, 1 << 63, near_copies.CHECKED, dtype=np.uint64))
    apart = np.bitwise_count(words[:, None] ^ words[None]).astype(int)
    good = (apart[:, :, 0] <= near_copies.RADIUS) & (apart.sum(2) <= near_copies.APART)
    pairs = [(a, b) for a, b in np.argwhere(good).tolist() if a < b]
    found = [(a, b) for i, j in near_copies.near(words) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert pairs and all(good[a, b] for a, b in found)
    assert brute_components(found, range(700)) == brute_components(pairs, range(700))
    close = np.repeat(base[:1], 2000, 0)
    assert sum(len(i) for i, _ in near_copies.near(close)) == 2000
