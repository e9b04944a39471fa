"""Removal of byte strings that occur more than once, by hash-compared suffix sorting."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumen.llm.common import byte_column, deltas, mixed, sliding_min, spread, stretches, summed, text_bytes
from vellumen.llm.routed import HOTTEST, ranks, repeatable, through_buckets
from vellumen.llm.superkmer import rolled

#: Bytes of text in a batch, and of strings that a bucket should get.
SLICE, BUCKET = 2 << 20, 4 << 20
#: Bytes of an anchor, and of one of windows whose short grams are all hot.
GRAM, LONG = 16, 64
#: A scrambled number for each byte, and the odd base of the prefix hashes.
NOISE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95


class Suffixes:
    """Suffixes buf[start:start+size] compared by prefix polynomial hashes.

    local: place of each byte in its string, so that powers of the base stay few.
    """

    def __init__(self, buf: np.ndarray, local: np.ndarray, start: np.ndarray, size: np.ndarray):
        most, inverse = int(local.max(initial=0)) + 2, pow(BASE, -1, 2**64)
        up, down = np.empty(most, np.uint64), np.empty(most, np.uint64)
        a = b = 1
        for i in range(most):
            up[i], down[i], a, b = a, b, a * BASE % 2**64, b * inverse % 2**64
        self.buf, self.start, self.size = buf, start, size
        self.prefix = np.append(np.uint64(0), np.cumsum(NOISE[buf] * up[local], dtype=np.uint64))
        self.down = down[np.append(local, 0)[start]]

    def hashed(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = self.start[x]
        return (self.prefix[at + length] - self.prefix[at]) * self.down[x]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes x and y: a binary search over hashed prefixes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashed(x, middle) == self.hashed(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        inside = (n < self.size[x]) & (n < self.size[y])
        last = len(self.buf) - 1
        return np.where(inside, self.buf[np.minimum(self.start[x] + n, last)] < self.buf[np.minimum(self.start[y] + n, last)], n < self.size[y])

    def order(self, place: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes sorted in each group, common prefix of each with the one before it, -1 for a group's first).

        Suffixes lie by group; place: number in the group, total: size of the group. A
        bottom-up mergesort, all groups at once: each suffix of a left run finds its place
        in the right run by binary search.
        """
        now, step = np.arange(len(place)), 1
        while (total > step).any():
            inner = place % (2 * step)
            merged = place - inner + step < total
            left = np.flatnonzero(merged & (inner < step))
            right = left - inner[left] + step
            low, high = np.zeros(len(left), np.int64), np.minimum(step, total[left] - (place[left] - inner[left] + step))
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                before = self.less(now[right[open_] + middle], now[left[open_]])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            new, free = now.copy(), merged.copy()
            new[left + low] = now[left]
            free[left + low] = False
            new[free] = now[merged & (inner >= step)]
            now, step = new, 2 * step
        shared = np.append(-1, self.common(now[:-1], now[1:])) if len(now) else np.zeros(0, np.int64)
        shared[place == 0] = -1
        if not self.verified(now, shared):
            return self.exact_order(now, place)
        return now, shared

    def verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether the bytes bear out each neighbour's common prefix and order: hashes may collide."""
        y = np.flatnonzero(shared >= 0)
        a, b, n = order[y - 1], order[y], shared[y]
        if not (self.buf[spread(self.start[a], n)] == self.buf[spread(self.start[b], n)]).all():
            return False
        ends = n == self.size[a]
        more = ~ends & (n < self.size[b])
        return bool((ends | more).all() and (self.buf[self.start[a[more]] + n[more]] < self.buf[self.start[b[more]] + n[more]]).all())

    def exact_order(self, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = self.buf.tobytes()
        text = lambda i: raw[self.start[i] : self.start[i] + self.size[i]]
        out, shared = [], []
        for _, members in groupby(zip(np.cumsum(place == 0).tolist(), order.tolist(), strict=True), key=lambda m: m[0]):
            before = None
            for i in sorted((i for _, i in members), key=text):
                here = text(i)
                shared.append(-1 if before is None else next((k for k, (c, d) in enumerate(zip(before, here, strict=False)) if c != d), min(len(before), len(here))))
                out.append(i)
                before = here
        return np.array(out, np.int64), np.array(shared, np.int64)


def shared_windows(strings: list[bytes], anchor: np.ndarray, length: int) -> np.ndarray:
    """(string, first window, windows) of runs of windows of `length` bytes that occur in two of the strings.

    anchor: place of each string's anchor, which lies in all its windows. Two equal windows
    hold one anchor at one place; so with the anchors' right sides sorted, and the left
    sides, read backwards, too, a window is known by the stretch of neighbours that share
    enough to its right and the stretch that share enough to its left.
    """
    gram = min(GRAM, length)
    numbers: dict[bytes, int] = {}
    group = np.fromiter((numbers.setdefault(s[a : a + gram], len(numbers)) for s, a in zip(strings, anchor.tolist(), strict=True)), np.int64, len(strings))
    members = np.bincount(group)
    some = np.flatnonzero(members[group] > 1)
    if not len(some):
        return np.zeros((3, 0), np.int64)
    some = some[np.argsort(group[some], kind="stable")]
    anchor, chosen = anchor[some], [strings[i] for i in some.tolist()]
    size = np.fromiter(map(len, chosen), np.int64, len(chosen))
    buf = np.frombuffer(b"".join(chosen), np.uint8)
    begin = np.cumsum(size) - size
    total = members[group[some]]
    first = np.flatnonzero(np.append(True, group[some][1:] != group[some][:-1]))
    place = np.arange(len(some)) - np.repeat(first, np.diff(np.append(first, len(some))))
    local = np.arange(len(buf), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    sides = []
    for b, at, start, extent in ((buf, local, begin + anchor, size - anchor), (buf[::-1], (np.repeat(size.astype(np.int32), size) - 1 - local)[::-1], len(buf) - begin - anchor, anchor)):
        order, common = Suffixes(np.ascontiguousarray(b), at, start, extent).order(place, total)
        most = np.empty(len(order), np.int64)
        most[order] = np.maximum(common, np.append(common[1:], -1))
        sides.append((order, common, most))
    (right, right_common, most_right), (left, left_common, most_left) = sides
    own, last = anchor, size
    flags = np.zeros((len(some), int(own.max()) + 1), bool)
    for a in range(flags.shape[1]):
        has = np.flatnonzero((a <= own) & (own - a + length <= last) & (most_right >= length - a) & (most_left >= a))
        if len(has) < 2:
            continue
        r, le = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
        r[right] = np.cumsum(right_common < length - a)
        le[left] = np.cumsum(left_common < a)
        key = r[has] * (len(some) + 1) + le[has]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = has[count[which] > 1]
        flags[twice, own[twice] - a] = True
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
    rows, at = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return np.stack([some[rows], at, stop - at])


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each `gram` bytes on end; those that cross documents have one, too."""
    return mixed(rolled(NOISE[raw], gram)) if len(raw) >= gram else np.zeros(0, np.uint64)


def anchored_strings(raw: np.ndarray, at: np.ndarray, length: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place, anchor's hash) of runs of windows with one anchor.

    A window's anchor is, of its grams of the rarest class, the leftmost with the least hash,
    which depends on the window's bytes and the classes alone. Where all of them are hot, it is
    the leftmost of the longer grams with the least hash.
    """
    gram = min(GRAM, length)
    count = np.maximum(np.diff(at) - length + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(raw, gram)
    ranked = classes[(hashes & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    ranked |= (hashes >> np.uint64(40)) << np.uint64(32)
    ranked |= np.arange(len(hashes), dtype=np.uint64)
    best = sliding_min(ranked, length - gram + 1)
    del ranked
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = spread(at[:-1], count)
    hot = (best >> np.uint64(56) == HOTTEST)[windows] if gram < length else np.zeros(len(windows), bool)
    own, named = place[windows], hashes
    if hot.any():
        long = min(LONG, length)
        named = gram_hashes(raw, long)
        ranked = named >> np.uint64(32) << np.uint64(32) | np.arange(len(named), dtype=np.uint64)
        own = np.where(hot, (sliding_min(ranked, length - long + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[windows], own)
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (hot[1:] != hot[:-1])))
    name = hashes[own[first]]
    name[hot[first]] = named[own[first][hot[first]]]
    return windows[first], np.diff(np.append(first, len(own))), own[first], name


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """Removes every byte in a string of `length` bytes that starts at any second place too.

    Returns (id, columns in `keep`, n_bytes, n_removed, n_spans, kept) for each row, kept being
    the remaining bytes; with whole_characters no part of a character is removed, and kept is
    a string. Places in one document count as well as in others, overlaps too; strings don't
    cross documents and are judged on the input. A null text is empty. Repeated ids, null ids
    and repeated rows are documents of their own. Other columns are not read.
    """
    names = [id_col, *keep]
    if {"n_bytes", "n_removed", "n_spans", "kept"} & set(names):
        raise ValueError("a kept column has the name of a result")
    picked = repeatable(docs.select(docs[text_col].alias("text"), *(docs[c].alias(f"c{i}") for i, c in enumerate(names))))
    size = text_bytes(docs.sparkSession, picked, "text")
    buckets = max(1, 3 * size // BUCKET)
    classes = ranks(picked, "text", size, SLICE, lambda raw, at: gram_hashes(raw, min(GRAM, length)))
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*(docs.schema[c] for c in names), *longs, T.StructField("kept", T.StringType() if whole_characters else T.BinaryType())])

    def split(part: pa.RecordBatch):
        raw, at = byte_column(part.column(0))
        first, count, anchor, hashed = anchored_strings(raw, at, length, classes)
        text, seen = raw.tobytes(), {}
        entry = np.fromiter((seen.setdefault(text[s:e], len(seen)) for s, e in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)), np.int64, len(first))
        bucket, where = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        bucket[entry] = (hashed % np.uint64(buckets)).astype(np.int64)
        where[entry] = anchor - first
        times, order, strings = np.bincount(entry, minlength=len(seen)), np.argsort(bucket, kind="stable"), list(seen)
        parts = {}
        for a, b in stretches(bucket[order]):
            these = order[a:b]
            chosen = [strings[i] for i in these]
            parts[int(bucket[these[0]])] = {"bytes": b"".join(chosen), "size": np.fromiter(map(len, chosen), np.int32, len(chosen)), "anchor": where[these].astype(np.int32), "times": np.minimum(times[these], 2).astype(np.int8), "entry": deltas(these)}
        return parts, {"rows": part.columns[1:], "raw": text, "at": at, "runs": (deltas(first), deltas(entry))}

    def bucket(parts: list) -> list:
        seen: dict[bytes, int] = {}
        which, anchor = [], []
        for p in parts:
            stop = np.cumsum(p["size"]).tolist()
            for s, e, a in zip([0, *stop], stop, p["anchor"].tolist(), strict=False):
                k = seen.setdefault(p["bytes"][s:e], len(seen))
                if k == len(anchor):
                    anchor.append(a)
                which.append(k)
        which, strings = np.array(which, np.int64), list(seen)
        times = np.bincount(which, weights=np.concatenate([p["times"] for p in parts]), minlength=len(strings))
        found = shared_windows(strings, np.array(anchor, np.int64), length)
        found = found[:, times[found[0]] < 2]
        # A string that itself occurs twice has no window that doesn't.
        whole = np.flatnonzero(times > 1)
        windows = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
        found = np.concatenate([found, np.stack([whole, np.zeros(len(whole), np.int64), windows[whole]])], axis=1)
        found = found[:, np.argsort(found[0], kind="stable")]
        answers, edge = [], 0
        for p in parts:
            entry = summed(p["entry"])
            mine = which[edge : edge + len(entry)]
            edge += len(mine)
            a, b = np.searchsorted(found[0], mine), np.searchsorted(found[0], mine, side="right")
            answers.append(np.vstack([np.repeat(entry, b - a), found[1:, spread(a, b - a)]]).astype(np.int32) if (b > a).any() else None)
        return answers

    def settle(state, answers: list) -> pa.RecordBatch:
        raw, at = np.frombuffer(state["raw"], np.uint8), state["at"]
        gone = np.zeros(len(raw), bool)
        if answers:
            entry, offset, count = np.concatenate(answers, axis=1)
            first, holder = map(summed, state["runs"])
            order = np.argsort(holder, kind="stable")
            a, b = np.searchsorted(holder[order], entry), np.searchsorted(holder[order], entry, side="right")
            begin, of = first[order[spread(a, b - a)]], np.repeat(np.arange(len(entry)), b - a)
            mark = np.zeros(len(raw) + 1, np.int32)
            np.add.at(mark, begin + offset[of], 1)
            np.add.at(mark, begin + offset[of] + count[of] + length - 1, -1)
            gone = np.cumsum(mark)[:-1] > 0
        if whole_characters and len(gone):
            heads = np.flatnonzero((raw & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(raw))))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        opens[heads] = gone[heads]
        spans, removed = (np.diff(np.append(0, np.cumsum(x))[at]) for x in (opens, gone))
        text = raw[~gone].tobytes()
        stop = (at - np.append(0, np.cumsum(removed))).tolist()
        kept = pa.array([text[s:e] for s, e in zip(stop, stop[1:], strict=False)], pa.binary())
        if whole_characters:
            kept = kept.cast(pa.string())
        return pa.RecordBatch.from_arrays([*state["rows"], pa.array(np.diff(at)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), kept], names=schema.names)

    return through_buckets(picked, picked.columns, "text", SLICE, split, bucket, settle, schema)

