"""Mixing, fill-in-the-middle and Merkle manifests against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumen.llm import fim, merkle, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, at int, `group` string, level int, digest binary"


def some_docs(seed, n=60, words=12):
    r = random.Random(seed)
    alphabet = ["a", "é", "語", "😀", "́", "<", "P>", "<S", "ab", "x\ty", "\n"]
    rows = []
    for i in range(n):
        text = " ".join("".join(r.choices(alphabet, k=r.randint(1, 4))) for _ in range(r.randint(0, words)))
        rows.append((i, text, r.choice(["de", "en", "fr", None]), r.choice(["a", "é", "z", "😀", "￿", "hot", "hot", "hot", None]), r.choice([None, len(text)])))
    rows += [(n, None, "en", "a", 1), (n + 1, "", None, None, None), (None, "no id", "en", "hot", 2), (None, None, None, None, None), rows[3], rows[3], (7, "another text under 7", "de", "a", 4), (n + 2, "word " * 300, "lone", "only", 5), (n + 3, " \t\n", "de", "blank", 3), (n + 4, "a <M> in it", "de", "a", 9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "g", 2, b"d") for r in rows], DOCS)


# ---- fill-in-the-middle


def brute_fim(doc_id, text, units):
    text = text or ""
    parts = units(text)
    n = len(parts)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


UNITS = {
    "code_points": (fim.CODE_POINTS, list),
    "words": (fim.WORDS, lambda t: [x for x in re.split(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", t) if t]),
    "lines": (fim.LINES, lambda t: [x for x in re.split(r"(?<=\n)(?=.)", t, flags=re.S) if t]),
}


@pytest.mark.parametrize("chunk", [4, 7, 1 << 16])
@pytest.mark.parametrize("unit", sorted(UNITS))
def test_fill_in_middle(spark, chunk, unit):
    rows = some_docs(3)
    found = fim.rearranged(frame(spark, rows), UNITS[unit][0], chunk=chunk)
    want = Counter((i, *brute_fim(i, t, UNITS[unit][1])) for i, t, *_ in rows)
    assert Counter(map(tuple, found.collect())) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t, *_ in rows)


def test_chunks_overlap_by_a_character(spark):
    """No chunk splits a character, and each but the first begins with the last character of the one before."""
    text = "aé語😀" * 9
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").cast("binary").alias("raw"), F.octet_length("t").cast("long").alias("size"))
    row = row.withColumn("spans", fim.overlapping(F.col("raw"), fim.begins(F.col("raw"), F.col("size"), 5)))
    pieces = row.select(F.transform("spans", lambda s: fim.piece(F.col("raw"), s))).first()[0]
    assert pieces[0] + "".join(p[1:] for p in pieces[1:]) == text
    assert all(a[-1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False)) and len(pieces) > 10


# ---- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n_chars = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)))


def climb(nodes):
    """(root, proof of each node: the sibling at each level, or None, and whether it is to the left)."""
    places, proofs = [[k] for k in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        for j, members in enumerate(places):
            sibling = nodes[j ^ 1] if j ^ 1 < len(nodes) else None
            for k in members:
                proofs[k].append((sibling, j % 2 == 1))
        nodes = [sha(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
        places = [sum(places[j : j + 2], []) for j in range(0, len(places), 2)]
    return nodes[0], proofs


def fold(digest, proof):
    for sibling, left in proof:
        digest = sha(*(x for x in ((sibling, digest) if left else (digest, sibling)) if x is not None))
    return digest


def brute_manifest(rows, changed):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[lang] = (own, *climb([leaf(r) for r in own]))
    root, over = climb([made[x][1] for x in langs])
    out = []
    for lang, tops in zip(langs, over, strict=True):
        own, subroot, proofs = made[lang]
        for row, proof in zip(own, proofs, strict=True):
            path = [*proof, *tops]
            out.append((row[0], leaf(row), subroot, root, sha(*(s for s, _ in path if s)), fold(leaf(changed(row)), path)))
    return out


@pytest.mark.parametrize(("n", "step"), [(60, 1), (60, 2), (60, 6), (5, 6), (300, 3)])
def test_manifest(spark, n, step):
    rows = some_docs(n, n)
    bad = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    changed = lambda r: (*r[:4], r[4] + 1 if bad(r) and r[4] is not None else r[4])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(frame(spark, rows), tampered, step=step)
    found = found.select("doc_id", *(merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")), merkle.proof_digest(F.col("path")), merkle.hexed(merkle.folded(F.col("changed_leaf"), F.col("path"))))
    want = brute_manifest(rows, changed)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    assert {w[3] == w[5] for w in want} == {True, False}


def test_no_node_is_asked_for_by_many(spark, monkeypatch):
    """The rows that ask for a node are bounded by a round's levels, though half of all leaves have the same sibling at the top."""
    asked = []
    kind = type(spark.range(1))
    join = kind.join

    def counted(self, other, on=None, how=None):
        if on == ["group", "level", "sibling"]:
            asked.append(self.groupBy(*on).count().agg(F.max("count")).first()[0])
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", counted)
    rows = [(i, "t", "en", "s", 1) for i in range(500)]
    assert merkle.manifest(frame(spark, rows), step=3).count() == 500
    assert len(asked) == 3 + 1 and max(x or 0 for x in asked) <= 4


# ---- mixing


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by handing out the excess again and again."""
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while free and left > 1e-9:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in free)
        free = {s for s in free if target[s] < most * sizes[s]}
        target = {s: min(t, most * sizes[s]) for s, t in target.items()}
    return sizes, target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rows = some_docs(seed, 120)
    mix = mixing.mixed(frame(spark, rows)).collect()
    sizes, target = brute_mix(rows)
    assert Counter((r["doc_id"], r["size"]) for r in mixing.by_document(mixing.mixed(frame(spark, rows))).collect()) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
    taken, by_row = Counter(), Counter()
    for r in mix:
        taken[r["source"]] += r["taken"]
        by_row[r["row"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert all(by_row[r["row"]] <= 2 * r["size"] for r in mix)
    assert all(target[s] - 1 - 1e-6 < taken[s] <= target[s] + 1e-6 for s in sizes)
    # The mix is one gapless run of words, by time, and each source's words follow its schedule.
    used = sorted((r for r in mix if r["taken"]), key=lambda r: r["start"])
    assert [r["position"] for r in used] == sorted(r["position"] for r in used)
    at = 0
    for r in used:
        assert r["start"] == at
        at += r["taken"]
    place = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    due = Counter()
    for r in used:
        schedule = mixing.CURRICULUM[place[r["source"]] % len(mixing.CURRICULUM)]
        assert integral(schedule, r["position"]) == pytest.approx(due[r["source"]] / target[r["source"]], abs=1e-9)
        due[r["source"]] += r["taken"]


def integral(schedule, t):
    area = lambda end: sum((min(b, end) - a) * (u + u + (v - u) * (min(b, end) - a) / (b - a)) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:], strict=False) if end > a)
    return area(t) / area(1.0)


def test_mix_is_the_same_again(spark):
    rows = some_docs(5, 80)
    first = mixing.by_document(mixing.mixed(frame(spark, rows)))
    again = mixing.by_document(mixing.mixed(frame(spark, rows[::-1]).repartition(7)))
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, again.collect()))


def test_a_source_in_many_ranges(spark, monkeypatch):
    rows = [(i, "w " * (i % 5), "en", "hot" if i % 4 else "cold", 1) for i in range(400)]
    want = Counter(map(tuple, mixing.by_document(mixing.mixed(frame(spark, rows))).collect()))
    ranged = mixing.ranged
    monkeypatch.setattr(mixing, "ranged", lambda r, g, o, per_range=0: ranged(r, g, o, 9))
    assert Counter(map(tuple, mixing.by_document(mixing.mixed(frame(spark, rows))).collect())) == want


def test_targets_when_every_source_is_full(spark):
    rows = spark.createDataFrame([("-a", 10), ("-b", 0), ("-c", 5)], "source string, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(rows, (3, 1, 2), 2.0, 2).collect()} == {"-a": 20.0, "-b": 0.0, "-c": 10.0}
    assert {r["source"]: r["target"] for r in mixing.targets(rows, (1,), 1.0, 2).collect()} == {"-a": 7.5, "-b": 0.0, "-c": 7.5}


@pytest.mark.parametrize("bad", [((0.0, 1.0),), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (0.9, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, math.nan), (1.0, 1.0))])
def test_schedules_are_checked(bad):
    with pytest.raises(ValueError):
        mixing.segments(bad)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert fim.rearranged(empty).count() == merkle.manifest(empty).count() == mixing.mixed(empty).count() == 0
