"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import LOWER, Words, byte_column, connected_components, flat, joined, materialize, mixed, slices, spread

#: Bytes of text that a task works on at a time.
SLICE = 1 << 19
#: Entries of a segment's value up to which lookups are joined with them one by one; rows of a tile beyond, and rows compared at a time.
DENSE, TILE, ROWS = 64, 2048, 256

LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def shingle_hashes(raw: np.ndarray, at: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of the texts raw[at[i]:at[i+1]], shingles of each text)."""
    words = Words(LOWER[raw], at)
    n = np.diff(words.first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.repeat(words.first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    last = begin + np.repeat(np.minimum(n, shingle), count) - 1
    buf, digest = words.buf.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(buf[s:e], seed) for s, e in zip(words.start[begin].tolist(), words.end[last].tolist(), strict=True)), np.uint64, len(begin)), count


def simhash(raw: np.ndarray, at: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """A fingerprint for each text raw[at[i]:at[i+1]]; zero where it has no word."""
    h, count = shingle_hashes(raw, at, shingle, seed)
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > count[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def long_fingerprints(h: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of `words` 64-bit words for the sets of hashes h[at[i]:at[i+1]], none empty: each word is voted on by the hashes as mixed for it."""
    count = np.diff(at)
    pieces = -(-count // 255)  # a byte counts to 255
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(at[:-1], pieces) + 255 * spread(np.zeros(len(count), np.int64), pieces)
    seeds, lanes = mixed(np.arange(1, 2 * words + 1, dtype=np.uint64)), np.uint64(0x0101010101010101)
    out, bits = np.zeros((len(count), words), np.uint64), np.zeros((len(count), 8, 8), np.uint8)
    for w in range(words):
        x = (h ^ seeds[2 * w]) * (seeds[2 * w + 1] | np.uint64(1))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        for b in range(8):
            ones = np.add.reduceat((x >> np.uint64(b)) & lanes, begin).view(np.uint8).reshape(-1, 8)
            if len(begin) > len(count):
                ones = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
            bits[:, :, b] = 2 * ones.astype(np.int64) > count[:, None]
        out[:, w] = np.packbits(bits, axis=2, bitorder="little").reshape(len(count), 8).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint as a long, columns in `keep`) for each row.

    A-Z is put in lower case; words are runs of anything but ASCII white space; a shingle's
    hash is XXH64 of its words joined by one space. Repeats count. A text with fewer words is
    one shingle; a null, empty or blank text has fingerprint zero.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType()), *(docs.schema[c] for c in keep)])
    picked = docs.select(F.col(text_col).alias("_text"), id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE):
            found = simhash(*byte_column(part.column(0)), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found), *part.columns[2:]], names=schema.names)

    return picked.mapInArrow(run, schema)


def ball(value, width: int, radius: int):
    """Column: the numbers that a segment of `width` bits reaches by flipping at most `radius` bits.

    At radius 1 only zero bits are set: of two segments one bit apart, just one has a zero there.
    """
    masks = [0, *(sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r))]
    flips = F.array(*(F.lit(m).cast("long") for m in masks))
    if radius == 1:
        flips = F.filter(flips, lambda m: value.bitwiseAND(m) == 0)
    return F.transform(flips, lambda m: value.bitwiseXOR(m)) if radius else F.array(value)


def links(classes: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """(u, v) for distinct fingerprints at most `radius` bits apart, or what they amount to: a forest that joins the same ones.

    The 64 bits are cut into segments. Two fingerprints within the radius agree in some
    segment up to radius // segments flipped bits, so each looks up that small ball around
    each of its segments in the table of the others' segments, and whole distances are verified.
    Where many have one value of a segment, as a large group of near copies has, its entries and
    lookups are dealt into tiles, and each pair of tiles gives a forest back, not its links.
    """
    cuts = [64 * i // segments for i in range(segments + 1)]

    def numbered(segment: int):
        return lambda x: x * segments + segment

    def keys(around: int):
        found = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            value = F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long"))
            found.append(F.transform(ball(value, b - a, around), numbered(i)))
        return F.explode(F.concat(*found)).alias("key")

    table = classes.select(keys(0), F.col("fingerprint").alias("there"))
    probe = classes.select(keys(radius // segments), F.col("fingerprint").alias("here"))
    return met(table, probe, radius)


def met(table: DataFrame, probe: DataFrame, radius: int) -> DataFrame:
    """links() of the fingerprints `here` of the lookups (key, here) with those `there` of the entries (key, there)."""
    dense = materialize(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE))
    near = F.bit_count(F.col("here").bitwiseXOR(F.col("there"))) <= radius
    ends = [f("here", "there").alias(n) for f, n in ((F.least, "u"), (F.greatest, "v"))]
    if dense.isEmpty():
        return probe.join(table, "key").where((F.col("here") != F.col("there")) & near).select(*ends).distinct()
    thin = table.join(dense, "key", "left_anti")
    few = probe.join(thin, "key").where((F.col("here") != F.col("there")) & near).select(*ends).distinct()
    asked = materialize(probe.join(dense.select("key"), "key"))
    about = materialize(dense.join(asked.groupBy("key").agg(F.count("*").alias("m")), "key").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.ceil(F.col("m") / TILE).cast("int").alias("others")))
    dealt = lambda rows, value, own, other: rows.join(about, "key").select("key", F.pmod(F.xxhash64(value), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.lit(value == "here").alias("asks"), F.col(value).alias("fingerprint"))
    both = dealt(table, "there", "tiles", "others").unionByName(dealt(asked, "here", "others", "tiles"))
    many = both.groupBy("key", "tiles", "others").applyInArrow(lambda t: forest(t, radius), LINKS)
    return few.unionByName(many)


def forest(group: pa.Table, radius: int) -> pa.Table:
    """(u, v): what a tile of entries of a segment's value and a tile of its lookups link, as each fingerprint's smallest."""
    asks = group["asks"].to_numpy(zero_copy_only=False)
    prints = group["fingerprint"].to_numpy()
    ids, place = np.unique(prints, return_inverse=True)
    here, there, root = place[asks], place[~asks], ids.copy()
    bits = ids.view(np.uint64)
    for start in range(0, len(here), ROWS):
        rows = here[start : start + ROWS]
        i, j = np.nonzero(np.bitwise_count(bits[rows][:, None] ^ bits[there]) <= radius)
        joined(root, ids, rows[i], there[j])
    root = flat(root, ids)
    some = np.flatnonzero(root != ids)
    return pa.table({"u": root[some], "v": ids[some]})


#: Classes from which on two segments make less work than three: fewer chance candidates for larger balls.
MANY = 1 << 26


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", radius: int = 4, segments: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id, other columns); component_id: the smallest id that links of at most `radius` differing bits reach.

    Equal fingerprints are one class, so copies never meet in pairs. Rows with a null id
    link like others but don't name a component, which is null where no row has an id;
    repeated rows stay. segments: into how many a fingerprint
    is cut, which finds the same links with other work; by default three, or two from MANY
    classes on.
    """
    prints = materialize(prints)
    classes = materialize(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    cut = segments or (3 if classes.count() < MANY else 2)
    found = connected_components(links(classes.select("fingerprint"), radius, cut))
    rooted = materialize(classes.join(found, classes["fingerprint"] == found["node"], "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")))
    # Written, so that Spark can split a large component where it is joined.
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    roots = rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    others = [c for c in prints.columns if c not in (id_col, "fingerprint")]
    return prints.join(roots, "fingerprint").select(id_col, "fingerprint", "component_id", *others)
