"""Packing of documents into token sequences: dominance reduction, then best fit, on counts of lengths."""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from vellumen.llm.common import LOWER, SPACE, byte_column, dictionary, materialize, slices, spread

#: Bytes of text that a task works on at a time, segments that a worker remembers, and texts encoded in one call.
SLICE, REMEMBERED, CALL = 2 << 20, 300_000, 2048

#: Kinds of bytes: white space, letters, other ASCII, and parts of longer characters.
KIND = np.full(256, 2, np.uint8)
KIND[SPACE], KIND[128:] = 0, 3
KIND[[*range(65, 91), *range(97, 123)]] = 1

# The normaliser and pre-tokeniser under which a text's ids are its segments' ids on end.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENISER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """A tokenizer with the ids of segments it has met; a worker keeps one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        self.parted = told["normalizer"] == NORMALISER and told["pre_tokenizer"] == PRE_TOKENISER and not told["model"].get("dropout")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.edges = array("I"), array("q", [0])

    def add(self, ids) -> None:
        self.flat.extend(ids)
        self.edges.append(len(self.flat))

    def remember(self, segments: list[bytes]) -> np.ndarray:
        """Numbers of the segments, encoding those that are new."""
        if len(self.known) + len(segments) > REMEMBERED:
            self.forget()
        known, rest = self.known, []
        tokenize = self.model.tokenize
        out = np.empty(len(segments), np.int64)
        for i, segment in enumerate(segments):
            at = known.get(segment)
            if at is None:
                if segment.isalpha() and segment.islower():  # bytes: ASCII letters alone
                    at = known[segment] = len(known)
                    self.add([t.id for t in tokenize(segment.decode())])
                else:
                    rest.append(i)
                    continue
            out[i] = at
        for cut in range(0, len(rest), CALL):
            part = rest[cut : cut + CALL]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([segments[i].decode() for i in part], add_special_tokens=False), strict=True):
                at = known.get(segments[i])
                if at is None:
                    at = known[segments[i]] = len(known)
                    self.add(e.ids)
                out[i] = at
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(path: str, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts on end, where each text's ids begin), as the tokenizer gives them, without special tokens.

    A tokenizer that lowers case, drops white space and parts letters from other ASCII
    characters gives a text the ids of its segments on end; each distinct segment is then
    encoded once. Words with an apostrophe, which may hold a contraction, or with the start
    of a special token stay whole. Any other tokenizer gets whole texts.
    """
    tool = encoder(path)
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    if not tool.parted:
        text = raw.tobytes()
        ids = [tool.tokenizer.encode(text[s:e].decode(), add_special_tokens=False).ids for s, e in zip(at.tolist(), at[1:].tolist(), strict=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.append(0, np.cumsum([len(x) for x in ids]))
    kind = KIND[raw]
    blank = kind == 0
    cut = blank.copy()
    cut[at[:-1][at[:-1] < len(raw)]] = True
    word = np.cumsum(cut, dtype=np.int32)
    special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
    whole = np.zeros(int(word[-1]) + 1, bool)
    whole[word[special]] = True
    keep_case = whole[word] if len(special) else None
    whole[word[raw == 0x27]] = True
    turn = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1  # a letter beside other ASCII
    turn = turn[(kind[turn] != 0) & (kind[turn] != 3) & (kind[turn - 1] != 0) & (kind[turn - 1] != 3)]
    cut[turn[~whole[word[turn]]]] = True
    buf = LOWER[raw]
    buf[blank] = 0x20
    if keep_case is not None:
        buf[keep_case & ~blank] = raw[keep_case & ~blank]
    begin = np.append(np.flatnonzero(cut), len(raw))
    codes, distinct = dictionary(buf, begin)
    numbers = tool.remember([w.lstrip(b" ") for w in distinct.to_pylist()])
    edges = np.frombuffer(tool.edges, np.int64)
    first, size = edges[numbers], edges[numbers + 1] - edges[numbers]
    count = size[codes]
    ids = np.frombuffer(tool.flat, np.uint32)[spread(first[codes], count)] if len(tool.flat) else np.zeros(0, np.uint32)
    del edges  # an array that is looked at can't grow
    return ids, np.append(0, np.cumsum(count))[np.searchsorted(begin, at)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids) of each text's tokens and the end token, cut at the capacity.

    ids: little-endian unsigned 32-bit numbers. Only a text with more than `capacity` tokens
    is cut; a null text is empty and so has the end token alone.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE):
            ids, begin = token_ids(tokenizer, *byte_column(part.column(1)))
            begin = begin + np.arange(len(begin))
            ends = begin[1:] - 1
            full = np.full(begin[-1], end_id, np.uint32)
            inside = np.ones(len(full), bool)
            inside[ends] = False
            full[inside] = ids
            total = np.diff(begin)
            n = -(-total // capacity)
            row, piece = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            # Pieces lie on end, as the documents do.
            blob = full.astype("<u4").view(np.uint8)
            offsets = 4 * np.append(0, np.cumsum(length))
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Bins:
    """Kinds of bins with the number of each: so the work depends on the capacity alone, not on the rows.

    A bin's content is a chain (length, items, rest of the chain).
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.kinds: dict[int, list[list]] = {}
        self.spaces: list[int] = []

    def add(self, room: int, content: tuple, n: int) -> None:
        if room not in self.kinds:
            self.kinds[room] = []
            self.spaces.insert(bisect_left(self.spaces, room), room)
        self.kinds[room].append([content, n])

    def take(self, length: int) -> tuple[int, tuple, int] | None:
        """A kind of bin with the least room that holds the length."""
        i = bisect_left(self.spaces, length)
        if i == len(self.spaces):
            return None
        room = self.spaces[i]
        content, n = self.kinds[room].pop()
        if not self.kinds[room]:
            del self.kinds[room], self.spaces[i]
        return room, content, n


def reduced(counts: Counter, capacity: int) -> list[tuple[tuple, int]]:
    """Takes from the counts those sets of lengths that some best packing has; returns (set, times).

    For the longest length left, with room r beside it (Martello and Toth, 1990):
    - nothing fits: it is alone;
    - a length of just r is there, or no two others fit together: the longest that fits
      dominates every other choice, as it can change places with it;
    - no three others fit: the longest that fits and the longest b beside it, if no pair's
      smaller length exceeds b.
    """
    fixed: list[tuple[tuple, int]] = []
    lengths = sorted(n for n in counts if counts[n])

    def largest(most: int, *, without: tuple = ()) -> int | None:
        i = bisect_left(lengths, most + 1) - 1
        while i >= 0 and counts[lengths[i]] <= without.count(lengths[i]):
            i -= 1
        return lengths[i] if i >= 0 else None

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for n in lengths:
            out += [n] * min(k - len(out), counts[n] - (n == without))
            if len(out) >= k:
                break
        return out

    for top in reversed(list(lengths)):
        while counts[top]:
            room = capacity - top
            low = smallest(3, top)
            if not low or low[0] > room:
                chosen = (top,)
            else:
                first = largest(room, without=(top,))
                one = first == room or len(low) < 2 or low[0] + low[1] > room
                two = len(low) < 3 or sum(low) > room
                if one:
                    chosen = (top, first)
                elif two:
                    # The longest beside the first, and the largest smaller length of any pair: at most half the room.
                    second = largest(room - first, without=(top, first))
                    half = largest(room // 2, without=(top,))
                    while half is not None and largest(room - half, without=(top, half)) is None:
                        half = largest(half - 1, without=(top,))
                    if second is None or half is None or second < half:
                        break
                    chosen = (top, first, second)
                else:
                    break
            # Taking lengths away only makes the rules easier to meet, so a set repeats while it lasts.
            use = Counter(chosen)
            times = min(counts[n] // k for n, k in use.items())
            for n, k in use.items():
                counts[n] -= k * times
            fixed.append((chosen, times))
        lengths = [n for n in lengths if counts[n]]
    return fixed


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where items of each length go, by rank.

    Dominance reduction, then best fit over the rest from the longest down. Bins of one
    content are one kind; a length makes at most two kinds more, so there are at most about
    three times `capacity` kinds, whatever the number of rows.
    """
    left = Counter({n: c for n, c in counts.items() if c})
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    done = [(tuple(Counter(s).items()), n) for s, n in reduced(left, capacity)]
    bins = Bins(capacity)
    for length in sorted((n for n in left if left[n]), reverse=True):
        n = left[length]
        while n:
            got = bins.take(length)
            if got is None:
                each = min(n, capacity // length)
                times = n // each
                bins.add(capacity - each * length, ((length, each),), times)
                n -= each * times
                continue
            room, content, have = got
            each = min(n, room // length)
            times = min(have, n // each)
            bins.add(room - each * length, (*content, (length, each)), times)
            if have > times:
                bins.add(room, content, have - times)
            n -= each * times
    done += [(content, n) for kinds in bins.kinds.values() for content, n in kinds]
    out, rank, sequence = [], Counter(), 0
    for content, n in done:
        offset = 0
        for length, each in content:
            for _ in range(each):
                out.append((length, rank[length], rank[length] + n, sequence, offset))
                rank[length] += n
                offset += length
        sequence += n
    return out


def pack(items: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity; an offset begins where the last item ends.

    The driver sees how many items each length has, at most `capacity` numbers, and makes
    the plan; items find their place by their rank among those of their length, counted
    within the parts of a written table and summed up along the parts. Rows equal in the
    order's columns take their places in any order. Nulls sort first.
    """
    items = materialize(items.withColumn("_part", F.spark_partition_id()))
    tally = materialize(items.groupBy("length", "_part").agg(F.count("*").alias("_n")))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_part").orderBy(*order)
    ranked = items.withColumn("_at", F.row_number().over(within)).join(base, ["length", "_part"]).withColumn("_rank", (F.col("_base") + F.col("_at") - 1).cast("long"))
    names = [c for c in items.columns if c != "_part"]
    schema = T.StructType([*(items.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    edges = {int(n): (int(a), int(b)) for n, a, b in zip(*(lambda u: (u[0], u[1], u[1] + u[2]))(np.unique(table[:, 0], return_index=True, return_counts=True)), strict=True)}
    wide = int(table[:, 2].max(initial=0)) + 1
    keys = table[:, 0] * wide + table[:, 1] if capacity * wide < 2**62 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            if keys is not None:
                row = np.searchsorted(keys, length * wide + rank, side="right") - 1
            else:
                row = np.fromiter((a + np.searchsorted(table[a:b, 1], r, side="right") - 1 for (a, b), r in ((edges[n], r) for n, r in zip(length.tolist(), rank.tolist(), strict=True))), np.int64, len(rank))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(table[row, 3] + rank - table[row, 1]), pa.array(table[row, 4])], names=schema.names)

    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def sequences(pieces_: DataFrame, placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids) with each sequence's tokens on end; a sequence has at most `capacity` of them."""
    both = pieces_.select(id_col, "piece", "ids").join(placed.select(id_col, "piece", "sequence_id", "offset"), [id_col, "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

