"""Language identification by fusing text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import byte_column, dealt_join, materialize, slices

SLICE = 1 << 20
#: Rows whose evidence is fused at a time.
FUSED = 512
#: Slots of the trigram table.
SLOTS = 1 << 16
UNKNOWN = "und"

#: Bytes with A-Z in lower case and all other ASCII as a space.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    """Log probabilities of trigram slots for each language, in the languages' order.

    As a language has few of the slots, it has those, their values, and one value for all others.
    """

    languages: tuple[str, ...]
    slots: tuple[np.ndarray, ...]
    values: tuple[np.ndarray, ...]
    others: tuple[float, ...]

    def of(self, i: int) -> np.ndarray:
        """The values of all slots for a language."""
        out = np.full(SLOTS, self.others[i], np.float32)
        out[self.slots[i]] = self.values[i]
        return out

    @property
    def weights(self) -> np.ndarray:
        """All of it: slots x languages."""
        return np.stack([self.of(i) for i in range(len(self.languages))], axis=1) if self.languages else np.empty((SLOTS, 0), np.float32)


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the trigrams, trigrams of each text): of folded bytes with a space at either end, not of spaces alone."""
    full = np.diff(at) > 0
    raw = np.insert(raw, np.concatenate([at[:-1][full], at[1:][full]]), 0x20)
    at = at + 2 * np.append(0, np.cumsum(full))
    b = FOLD[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    good = code != 0x202020
    edge = at[1:-1]
    for back in (1, 2):
        good[edge[(edge >= back) & (edge - back < len(good))] - back] = False
    before = np.append(0, np.cumsum(good))
    count = np.diff(before[np.minimum(at, len(good))])
    return ((code[good] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), count


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 500, languages: int = 1000) -> Model:
    """Trigram probabilities from about `per_language` distinct texts of each language, and no more: by the hash of the text.

    The sample is bounded by that parameter. All of a chosen text counts. Rows with a null text
    or language don't. Counting is distributed; the driver gets a number for each trigram slot
    that a language has, and so does each worker: a table with more than `languages` languages
    is refused with a ValueError, as nothing else bounds the model, and none is left out.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    hashed = F.xxhash64("text")
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", hashed).distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(languages + 1).collect()}
    if not sizes:
        return Model((), (), (), ())
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages; a model of more needs a higher bound")
    # Hashes that twice as many texts as needed lie below; so few meet in the window's tasks.
    share = labelled.sparkSession.createDataFrame([(lang, min(1.0, (2 * per_language + 50) / n)) for lang, n in sizes.items()], "lang string, share double")
    few = rows.join(F.broadcast(share), "lang").where(F.abs(hashed.cast("double")) <= F.col("share") * 2.0**63).select("text", "lang").distinct()
    sample = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "text"))).where(F.col("_n") <= per_language)
    counted = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in set(langs):
                slots, _ = trigrams(*byte_column(batch.column(0).filter(pa.array(langs == lang))))
                total[lang] = total.get(lang, 0) + np.bincount(slots, minlength=SLOTS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=counted.names)

    found = sample.select("text", "lang").mapInArrow(count, counted).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(found["lang"].unique()))
    by = {lang: part for lang, part in found.groupby("lang")}
    slots = tuple(by[lang]["slot"].to_numpy(np.int32) for lang in names)
    counts = [by[lang]["n"].to_numpy() + 0.1 for lang in names]
    whole = [n.sum() + 0.1 * (SLOTS - len(n)) for n in counts]
    return Model(names, slots, tuple(np.log(n / t).astype(np.float32) for n, t in zip(counts, whole, strict=True)), tuple(float(np.float32(np.log(0.1 / t))) for t in whole))


def text_scores(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities for each text and language, and for noise last; trigrams of each text)."""
    slots, count = trigrams(raw, at)
    out = np.zeros((len(count), len(model.languages) + 1))
    full = np.flatnonzero(count)
    if len(full):
        starts = (np.cumsum(count) - count)[full]
        for i in range(len(model.languages)):
            out[full, i] = np.add.reduceat(model.of(i)[slots], starts, dtype=np.float64)
    out[:, -1] = -count * np.log(SLOTS)
    return out, count


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address: the whole name, its last two labels, the last one."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def declared_language(markup: Column) -> Column:
    """The language that an html tag declares, without region, or null."""
    return F.nullif(F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1)), F.lit(""))


def visible(markup: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    return F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def identify(rows: DataFrame, model: Model, id_col: str, text: Column, declared: Column | None = None, host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, also: tuple[str, ...] = (), evidence: int = 60, smoothing: float = 5.0, noise: float = 1e-6) -> DataFrame:
    """(id, language, confidence, n_trigrams, accepted, columns in `also`) for each row.

    The posterior is the product of
    - the text's likelihood, over its whole length but with the weight of at most
      `evidence` trigrams, as neighbours are not independent;
    - a prior from the host, smoothed towards its domain, and that towards all rows: at each
      level the summed text posteriors of the other rows, plus `smoothing` times the level above;
    - how often rows of each language declare this language, and have this address suffix,
      by the same sums; missing evidence has no weight.
    Noise, which draws every trigram slot alike, has the fixed prior `noise`; where it wins, or
    where a text (null, empty, no letters) has no trigram, the language is "und" and accepted
    is false. Ties go to the language that sorts first. Repeated rows and ids are rows of
    their own; a null id stays.
    """
    results = (id_col, "language", "confidence", "n_trigrams", "accepted")
    if set(also) & set(results):
        raise ValueError("a column of `also` has the name of a result")
    names = ["_id", "_text", "_declared", "_host", "_domain", "_suffix"] + ["_also"] * bool(also)
    none = F.lit(None).cast("string")
    picked = rows.select(F.col(id_col).alias("_id"), text.alias("_text"), *(c.alias(n) if c is not None else none.alias(n) for c, n in zip((declared, host, domain, suffix), names[2:6], strict=True)), *([F.struct(*also).alias("_also")] if also else []))
    kept = ["_also.*"] if also else []
    kinds = [picked.schema[n] for n in names if n != "_text"]
    some = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("p", T.LongType())]))
    schema = T.StructType([*kinds, T.StructField("_n", T.LongType()), T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_p", some)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE):
            found, count = text_scores(model, *byte_column(part.column(1)))
            found *= (np.minimum(count, evidence) / np.maximum(count, 1))[:, None]
            found -= found.max(axis=1, keepdims=True)
            row, i = np.nonzero(p := millionths(found, count))
            pairs = pa.StructArray.from_arrays([pa.array(i.astype(np.int32)), pa.array(p[row, i])], ["i", "p"])
            sums = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32)), pairs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != 1), pa.array(count), lists, sums], names=schema.names)

    scored = materialize(picked.mapInArrow(run, schema))
    n_rows = scored.count()
    size = len(model.languages)
    if not size:
        return scored.select(F.col("_id").alias(id_col), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.col("_n").alias("n_trigrams"), F.lit(False).alias("accepted"), *kept)
    # A row's posteriors by its text alone are few; sums are of those, with the number of rows at the end.
    with_count = F.inline(F.concat("_p", F.array(F.struct(F.lit(size).alias("i"), F.lit(1).cast("long").alias("p")))))
    everything = np.zeros(size + 1)
    for r in scored.select(with_count).groupBy("i").agg(F.sum("p").alias("p")).collect():  # a number a language
        everything[r["i"]] = r["p"]
    rowed = scored.drop("_p")
    for tag in ("host", "domain", "declared", "suffix"):
        column = f"_{tag}"
        summed = scored.where(F.col(column).isNotNull()).select(column, with_count).groupBy(column, "i").agg(F.sum("p").alias("p"))
        facts = summed.groupBy(column).agg(F.collect_list(F.struct("i", "p")).alias(f"{tag}_sums"), F.max(F.when(F.col("i") == size, F.col("p"))).alias("n"))
        rowed = dealt_join(rowed, facts, column, n_rows, ("_id", "_n", "_ll"), "left")
    ready = rowed.select("_id", *names[6:], "_n", "_ll", *(F.coalesce(f"{t}_sums", F.array().cast(some)).alias(f"{t}_sums") for t in ("host", "domain", "declared", "suffix")), *(F.col(f"_{t}").isNotNull().alias(f"has_{t}") for t in ("declared", "suffix")))
    shape = T.StructType([ready.schema[n] for n in ("_id", *names[6:])] + [T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_trigrams", T.LongType())])
    labels = np.array([*model.languages, UNKNOWN], object)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FUSED):
                part = batch.slice(start, FUSED)
                column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                count = column["_n"].to_numpy()
                scores = fused(column, count, everything[:size], smoothing, noise)
                best, most = scores.argmax(axis=1), scores.max(axis=1, keepdims=True)
                chosen = np.where(count == 0, UNKNOWN, labels[best])
                sure = np.where(count == 0, 0.0, np.round(1 / np.exp(scores - most).sum(axis=1), 9))
                yield pa.RecordBatch.from_arrays([*(column[n] for n in ("_id", *names[6:])), pa.array(chosen, pa.string()), pa.array(sure), pa.array(count)], names=shape.names)

    return ready.mapInArrow(fuse, shape).select(F.col("_id").alias(id_col), "language", "confidence", "n_trigrams", (F.col("language") != UNKNOWN).alias("accepted"), *kept)


def millionths(ll: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Posteriors by text alone, of scores whose last column is noise's, in millionths: whole numbers sum alike in any order."""
    raw = np.exp(ll[:, :-1])
    whole = raw.sum(axis=1, keepdims=True)
    out = np.rint(1e6 * np.divide(raw, whole, out=np.zeros_like(raw), where=whole > 0)).astype(np.int64)
    out[count == 0] = 0
    return out


def dense(sums: pa.ListArray, size: int) -> np.ndarray:
    """Lists of (i, p) as rows of a matrix, in whole units."""
    out = np.zeros((len(sums), size + 1))
    flat = sums.flatten()
    row = np.repeat(np.arange(len(sums)), np.diff(sums.offsets.to_numpy()))
    out[row, flat.field("i").to_numpy()] = flat.field("p").to_numpy()
    return out[:, :size] / 1e6


def fused(column: dict[str, pa.Array], count: np.ndarray, everything: np.ndarray, smoothing: float, noise: float) -> np.ndarray:
    """Log posteriors, but for a number a row, of each language and of noise."""
    size = len(everything)
    ll = column["_ll"].flatten().to_numpy().reshape(len(count), size + 1)
    own = millionths(ll, count) / 1e6
    others = lambda sums: np.maximum(sums - own, 0.0)  # noqa: E731  without the row itself
    top = others(everything / 1e6)
    prior = (top + 1) / (top.sum(axis=1, keepdims=True) + size)
    for tag in ("domain", "host"):
        level = others(dense(column[f"{tag}_sums"], size))
        prior = (level + smoothing * prior) / (level.sum(axis=1, keepdims=True) + smoothing)
    told, told_noise = np.zeros_like(top), np.zeros((len(count), 1))
    for tag in ("declared", "suffix"):
        there = column[f"has_{tag}"].to_numpy(zero_copy_only=False)[:, None]
        level = others(dense(column[f"{tag}_sums"], size))
        marginal = (level.sum(axis=1, keepdims=True) + 0.5) / (top.sum(axis=1, keepdims=True) + 1)
        told += np.where(there, np.log((level + smoothing * marginal) / (top + smoothing)), 0.0)
        told_noise += np.where(there, np.log(marginal), 0.0)
    return np.hstack([ll[:, :-1] + np.log(prior) + told, ll[:, -1:] + np.log(noise) + told_noise])


def documents(docs: DataFrame, model: Model | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """identify() for documents alone: source is the host, and markup in a text may declare a language.

    Without a model, one is trained on the labelled languages of the documents.
    """
    model = model or train(docs)
    return identify(docs, model, "doc_id", F.col("text"), declared=declared_language(F.col("text")), host=F.col("source"), also=also)


def pages(rows: DataFrame, model: Model) -> DataFrame:
    """identify() for web pages (page_id, url, html), by what is visible, the html tag and the address."""
    host, domain, suffix = host_parts(F.col("url"))
    return identify(rows, model, "page_id", visible(F.col("html")), declared_language(F.col("html")), host, domain, suffix)


def corpus(docs: DataFrame, pages_: DataFrame, model: Model | None = None) -> DataFrame:
    """identify() for documents and web pages together; a page's doc_id is -1 - page_id, so that they don't meet.

    Without a model, one is trained on the labelled languages of the documents.
    """
    model = model or train(docs)
    none = F.lit(None).cast("string")
    host, domain, suffix = host_parts(F.col("url"))
    both = docs.select("doc_id", F.col("text"), declared_language(F.col("text")).alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix")).unionByName(
        pages_.select((-1 - F.col("page_id")).alias("doc_id"), visible(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))
    )
    return identify(both, model, "doc_id", *map(F.col, ("text", "declared", "host", "domain", "suffix")))
