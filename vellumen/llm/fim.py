"""Fill-in-the-middle: texts cut at two random places, in overlapping chunks, with column functions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, about.
CHUNK = 1 << 16
#: The marks before prefix, suffix and middle; a text that has one stays plain.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ANY_MARK = "<[PSM]>"


@dataclass(frozen=True)
class Unit:
    """What texts are cut into: a boundary is told by the two characters that it lies between.

    count: how many boundaries are inside a piece of text. head: the piece up to one of them,
    by its number from 1.
    """

    count: Callable[[Column], Column]
    head: Callable[[Column, Column], Column]


def between(behind: str, ahead: str) -> Unit:
    """Boundaries between a character of one class and a character of another, as regular expressions of one character."""
    place = f"(?s)(?<={behind})(?={ahead})"
    return Unit(
        lambda piece: F.regexp_count(piece, F.lit(place)),
        lambda piece, k: F.array_join(F.slice(F.split(piece, place, -1), F.lit(1), k), ""),
    )


#: Any two characters have a boundary between them.
CODE_POINTS = Unit(lambda piece: F.char_length(piece) - 1, lambda piece, k: F.substring(piece, F.lit(1), k))
#: A word keeps the white space behind it.
WORDS = between(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")
LINES = between(r"\n", ".")


def inner(raw: Column, at: Column) -> Column:
    """Whether a byte, by its number from 0, is inside a character."""
    byte = F.substring(raw, at + 1, F.lit(1))
    return (byte >= F.lit(b"\x80")) & (byte <= F.lit(b"\xbf"))


def begins(raw: Column, size: Column, chunk: int) -> Column:
    """Where chunks of about `chunk` bytes begin, and the end of the text: characters aren't split."""
    skip = lambda at: F.when(~inner(raw, at), 0).when(~inner(raw, at + 1), 1).when(~inner(raw, at + 2), 2).otherwise(3)
    inside = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.floor((size - 1) / chunk), F.lit(1))), lambda c: F.least(size, c * chunk + skip(c * chunk)))
    return F.when(size == 0, F.array().cast("array<bigint>")).when(size <= chunk, F.array(F.lit(0).cast("long"), size)).otherwise(F.concat(F.array(F.lit(0).cast("long")), inside, F.array(size)))


def overlapping(raw: Column, ends: Column) -> Column:
    """(start, length) of each chunk with the one character before it: no pair of neighbours is missed or counted twice."""
    back = lambda at: F.when(at == 0, 0).when(~inner(raw, at - 1), 1).when(~inner(raw, at - 2), 2).when(~inner(raw, at - 3), 3).otherwise(4)
    starts = F.transform(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), lambda at: at - back(at))
    return F.transform(starts, lambda start, i: F.struct(start.alias("start"), (F.get(ends, i + 1) - start).alias("length")))


def piece(raw: Column, span: Column) -> Column:
    return F.substring(raw, (span["start"] + 1).cast("int"), span["length"].cast("int")).cast("string")


def routed(counts: Column, ranks: list[Column]) -> Column:
    """For each rank the chunk that has that boundary, and the boundaries before the chunk: one pass of prefix sums."""
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("chunk"), none.alias("before"), *(F.struct(none.alias("chunk"), none.alias("before")).alias(f"cut{i}") for i in range(len(ranks))))

    def step(acc: Column, n: Column) -> Column:
        here = lambda k: (k > acc["before"]) & (k <= acc["before"] + n)
        found = (F.when(here(k), F.struct(acc["chunk"].alias("chunk"), acc["before"].alias("before"))).otherwise(acc[f"cut{i}"]).alias(f"cut{i}") for i, k in enumerate(ranks))
        return F.struct((acc["chunk"] + 1).alias("chunk"), (acc["before"] + n).alias("before"), *found)

    return F.aggregate(counts, start, step)


def cut(docs: DataFrame, unit: Unit = CODE_POINTS, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", chunk: int = CHUNK) -> DataFrame:
    """(id, text, h, n, low, high, low_byte, high_byte) for each row: two random cuts of its text, as units and as bytes.

    h: the first four groups of 8 hexadecimal digits of the SHA-256 of seed and id. n: units of
    the text. low, high: the smaller and larger of h1 % (n + 1) and h2 % (n + 1).

    A text is taken in chunks that overlap by a character, so that each pair of neighbours lies
    in one chunk. Boundaries are counted chunk by chunk, sums of the counts tell which chunk
    has a cut, and that chunk alone is looked through for the place. All of it is within the row:
    no shuffle, and no more memory than a few chunks besides the text.
    A null text counts as empty, and a null id as the empty string; repeated rows and ids
    are rows of their own. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.array(*map(group, range(4))).alias("h"))
    rows = rows.withColumn("raw", F.col("text").cast("binary")).withColumn("size", F.octet_length("text").cast("long"))
    raw, size = F.col("raw"), F.col("size")
    rows = rows.withColumn("ends", begins(raw, size, chunk)).withColumn("spans", overlapping(raw, F.col("ends")))
    rows = rows.withColumn("counts", F.transform("spans", lambda span: unit.count(piece(raw, span)).cast("long")))
    rows = rows.withColumn("n", F.when(size > 0, F.aggregate("counts", F.lit(1).cast("long"), lambda a, n: a + n)).otherwise(0).cast("long"))
    draws = [F.col("h")[i] % (F.col("n") + 1) for i in range(2)]
    rows = rows.withColumn("low", F.least(*draws)).withColumn("high", F.greatest(*draws))
    rows = rows.withColumn("at", routed(F.col("counts"), [F.col("low"), F.col("high")]))

    def byte(k: Column, found: Column) -> Column:
        span = F.get("spans", found["chunk"].cast("int"))
        here = span["start"] + F.octet_length(unit.head(piece(raw, span), (k - found["before"]).cast("int")))
        return F.when(k == 0, 0).when(k == F.col("n"), size).otherwise(here).cast("long")

    return rows.select("id", "text", "raw", "h", "n", "low", "high", byte(F.col("low"), F.col("at.cut0")).alias("low_byte"), byte(F.col("high"), F.col("at.cut1")).alias("high_byte"))


def rearranged(docs: DataFrame, unit: Unit = CODE_POINTS, rate: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", chunk: int = CHUNK) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row, as cut() cuts it.

    rate % of the texts (by h3) are rearranged, spm % of them (by h4) as suffix, prefix,
    middle and the others as prefix, suffix, middle. Empty texts and those that contain a mark
    stay plain. prefix_chars and middle_chars are units, null if plain. restored() gives the
    text back. Edge cases are those of cut().
    """
    rows = cut(docs, unit, id_col, text_col, seed, chunk)
    plain = (F.col("text") == "") | F.col("text").rlike(ANY_MARK) | (F.col("h")[2] % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm"))
    part = lambda name, begin, end: F.substring(F.col("raw"), begin.cast("int") + 1, (end - begin).cast("int")).cast("string").alias(name)
    low, high = F.col("low_byte"), F.col("high_byte")
    rows = rows.withColumns({"prefix": part("prefix", F.lit(0), low), "middle": part("middle", low, high), "suffix": part("suffix", high, F.octet_length("raw"))})
    written = lambda *names: F.concat(*(x for n in names for x in (F.lit(MARKS[n]), F.col(n))))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", written("suffix", "prefix", "middle")).otherwise(written("prefix", "suffix", "middle"))
    units = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select(F.col("id").alias(id_col), "n", "form", units(F.col("low")).alias("prefix_chars"), units(F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output. No mark can arise where a mark and a text meet, so splitting at marks is exact."""
    parts = F.split(output, ANY_MARK, -1)  # nothing stands before the first mark
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
