"""Removal of word windows that an earlier document has, by super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumen.llm.common import Words, byte_column, deltas, dictionary, mixed, sliding_min, spread, stretches, summed, text_bytes
from vellumen.llm.routed import HOTTEST, ranks, repeatable, through_buckets

#: Bytes of text in a batch, and of packed strings that a bucket should get.
SLICE, BUCKET = 8 << 20, 16 << 20
#: Windows in a super-k-mer at most; longer runs go as several.
RUN = 64
#: Words of a minimiser, and of one of windows whose short grams are all hot.
GRAM, LONG = 3, 9
#: Ranks rows without an id behind all others.
NO_ID = np.iinfo(np.int64).max


def rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each window of `width` codes."""
    out, have, power = None, 0, codes
    step, scale = 1, np.uint64(0x9E3779B97F4A7C15)
    while True:
        if width & step:
            if out is None:
                out, have = power, step
            else:
                m = len(codes) - have - step + 1
                out, have = out[:m] * scale + power[have : have + m], have + step
        if have == width:
            return out
        power = power[:-step] * scale + power[step:]
        step, scale = 2 * step, np.uint64(int(scale) ** 2 % 2**64)


def gram_hashes(words: Words, gram: int) -> np.ndarray:
    """A hash for each `gram` words on end; grams that cross documents have one, too."""
    if len(words) < gram:
        return np.zeros(0, np.uint64)
    codes, distinct = words.encoded()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    return mixed(rolled(hashes[codes], gram))


def super_kmers(words: Words, window: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of each run of windows that share a minimiser.

    A window's minimiser is its gram of the rarest class, of those the one with the least hash.
    Where all of its grams are hot it is the longer gram with the least hash: texts of a few
    common words spread over as many buckets as they have long grams.
    """
    count = np.maximum(np.diff(words.first) - window + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(GRAM, window)
    hashes = gram_hashes(words, gram)
    ranked = hashes >> np.uint64(8)
    ranked |= classes[(hashes & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
    least = sliding_min(ranked, window - gram + 1)
    hot = least >> np.uint64(56) == HOTTEST
    if hot.any() and gram < window:
        long = min(LONG, window)
        least = np.where(hot, sliding_min(gram_hashes(words, long) >> np.uint64(8), window - long + 1) | np.uint64(HOTTEST << 56), least)
    begin = np.zeros(len(least) + 1, bool)
    valid = np.zeros(len(least), bool)
    valid[spread(words.first[:-1], count)] = True
    begin[1:-1] = least[1:] != least[:-1]
    begin[:-1] |= np.diff(valid, prepend=False)
    begin[0] = True
    first = np.flatnonzero(begin[:-1])
    first = first[valid[first]]
    # A run ends where the next begins or where its document has no more windows.
    stop = np.append(np.flatnonzero(begin[:-1]), len(least))
    last = stop[np.searchsorted(stop, first, side="right")]
    parts = -(-(last - first) // RUN)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + part * RUN
    return starts, np.minimum(np.repeat(last, parts) - starts, RUN), mixed(least[starts])


def count_windows(parts: list, window: int) -> list:
    """For each batch's strings: (string, first window, windows, least id) of runs whose windows all
    start in a document with that least id, where some document of the string has a larger one."""
    lengths = [len(p["least"]) for p in parts]
    low, high = (np.concatenate([summed(p[k]) for p in parts]) for k in ("least", "most"))
    buf = np.frombuffer(b"".join(p["strings"] + b"\n" for p in parts), np.uint8).copy()
    breaks = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    string_end = np.flatnonzero(buf[breaks] == 0x0A)  # number of each string's last word
    buf[breaks] = 0x20
    codes, distinct = dictionary(buf, np.append(0, breaks + 1))
    first = np.append(0, string_end[:-1] + 1)
    count = string_end - first + 1 - window + 1
    at, string = spread(first, count), np.repeat(np.arange(len(first)), count)
    noise = mixed(np.arange(1, len(distinct) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = rolled(noise[codes], window)[at]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    # Equal hashes are compared word by word with the first of their group.
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    twin = np.flatnonzero(~new)
    a, b = at[order[twin]], at[order[head[twin]]]
    if not all((codes[a + i] == codes[b + i]).all() for i in range(window)):
        order = np.lexsort([codes[at + i] for i in range(window - 1, -1, -1)])
        new = np.append(True, np.zeros(len(order) - 1, bool))
        for i in range(window):
            c = codes[at[order] + i]
            new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[string[order]], starts), np.diff(np.append(starts, len(order))))
    hit = np.flatnonzero(least < high[string])
    if not len(hit):
        return [None] * len(parts)
    run = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (string[hit][1:] != string[hit][:-1]) | (least[hit][1:] != least[hit][:-1])))
    size = np.diff(np.append(run, len(hit)))
    where = hit[run]
    found = np.stack([string[where], at[where] - first[string[where]], size, least[where]])
    edges = np.append(0, np.cumsum(lengths))
    cut = np.searchsorted(found[0], edges)
    return [None if cut[i] == cut[i + 1] else (found[:, cut[i] : cut[i + 1]] - np.array([[edges[i]], [0], [0], [0]])) for i in range(len(parts))]


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Removes every word in a window of words that also starts in a document with a smaller id.

    Returns (id, n_words, n_removed, kept_text), a row for each row; kept words are joined by
    one space. Words are runs of anything but ASCII white space, compared as they are; a null
    text has none. Windows are judged on the input. Rows with the same id don't remove each
    other's words; a row with a null id ranks behind all others. Other columns are not read.

    Consecutive windows of a batch with one minimiser travel as one string, once a batch, to
    the minimiser's bucket; there a sort puts equal windows together, and the hash it sorts by
    is compared word by word. Which windows are repeats returns to the batches. Minimisers
    are rare grams before common ones, by counts over all rows.
    """
    docs = repeatable(docs.select(id_col, text_col))
    size = text_bytes(docs.sparkSession, docs, text_col)
    buckets = max(1, 3 * size // BUCKET)
    classes = ranks(docs, text_col, size, SLICE, lambda raw, at: gram_hashes(Words(raw, at), min(GRAM, window)))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def split(part: pa.RecordBatch):
        ids, text = part.column(0), part.column(1)
        words = Words(*byte_column(text))
        first, count, least = super_kmers(words, window, classes)
        rank = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        owner = np.searchsorted(words.first, first, side="right") - 1
        raw, seen = words.buf.tobytes(), {}
        entry = np.fromiter((seen.setdefault(raw[s:e], len(seen)) for s, e in zip(words.start[first].tolist(), words.end[first + count + window - 2].tolist(), strict=True)), np.int64, len(first))
        low, high, bucket = np.full(len(seen), NO_ID), np.full(len(seen), np.iinfo(np.int64).min), np.zeros(len(seen), np.int64)
        np.minimum.at(low, entry, rank[owner])
        np.maximum.at(high, entry, rank[owner])
        bucket[entry] = (least % np.uint64(buckets)).astype(np.int64)
        order, strings = np.argsort(bucket, kind="stable"), list(seen)
        parts = {}
        for a, b in stretches(bucket[order]):
            these = order[a:b]
            parts[int(bucket[these[0]])] = {"strings": b"\n".join([strings[i] for i in these]), "least": deltas(low[these]), "most": deltas(high[these]), "entry": deltas(these)}
        return parts, {"ids": ids, "raw": raw, "first": words.first, "runs": (deltas(first), deltas(entry))}

    def bucket(parts: list) -> list:
        return [None if a is None else np.vstack([summed(p["entry"])[a[0]], a[1:]]) for p, a in zip(parts, count_windows(parts, window), strict=True)]

    def settle(state, answers: list) -> pa.RecordBatch:
        buf, at = np.frombuffer(state["raw"], np.uint8), state["first"]
        end = np.flatnonzero(buf == 0x20) + 1
        size = np.diff(end, prepend=0)
        gone = np.zeros(len(end), bool)
        if answers:
            entry, offset, count, least = np.concatenate(answers, axis=1)
            rank = state["ids"].cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            first, holder = map(summed, state["runs"])
            order = np.argsort(holder, kind="stable")
            a, b = np.searchsorted(holder[order], entry), np.searchsorted(holder[order], entry, side="right")
            run, of = first[order[spread(a, b - a)]], np.repeat(np.arange(len(entry)), b - a)
            late = rank[np.searchsorted(at, run, side="right") - 1] > least[of]
            run, of = run[late], of[late]
            mark = np.zeros(len(end) + 1, np.int64)
            np.add.at(mark, run + offset[of], 1)
            np.add.at(mark, run + offset[of] + count[of] + window - 1, -1)
            gone = np.cumsum(mark)[:-1] > 0
        removed = np.append(0, np.cumsum(gone))[at]
        kept = buf[np.repeat(~gone, size)]
        stop = np.append(0, np.cumsum(np.where(gone, 0, size)))[at]
        text, stop = kept.tobytes(), stop.tolist()
        texts = pa.array([text[s : e - 1] if e > s else b"" for s, e in zip(stop, stop[1:], strict=False)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([state["ids"], pa.array(np.diff(at)), pa.array(np.diff(removed)), texts], names=schema.names)

    return through_buckets(docs, [id_col, text_col], text_col, SLICE, split, bucket, settle, schema)
