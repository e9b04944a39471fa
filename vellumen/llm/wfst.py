"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumen.llm.common import byte_column, dictionary, slices, spread

#: Bytes of text that a task works on at a time; stretches and pairs of pieces that a worker remembers.
SLICE, REMEMBERED, PAIRS = 2 << 20, 250_000, 500_000
BLANK = "▁"

# Types of pieces and models in the model file's format.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0], at + size
        yield tag >> 3, value


INFINITY = float("inf")
#: The context of a text's begin, and of what follows a character that no piece has.
FREE = -1


def charsmap_rules(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(text, what it becomes) of a model's character map: a double array of 32-bit units, then the results, each ended by a zero."""
    size = int.from_bytes(data[:4], "little")
    units, results = np.frombuffer(data[4 : 4 + size], "<u4").tolist(), data[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    todo = [(offset(units[0]), b"")]
    while todo:
        base, key = todo.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            unit, longer = units[at], key + bytes([byte])
            below = at ^ offset(unit)
            if unit >> 8 & 1:  # a key ends here
                begin = units[below] & 0x7FFFFFFF
                yield longer, results[begin : results.index(0, begin)]
            todo.append((below, longer))


class Normaliser:
    """The normaliser as a transducer: states are the nodes of a trie of its rules' left sides.

    It reads the longest left side there is and writes the right one, or reads a character
    and writes it. arcs: for each state, the next one by byte. writes: what an accepting
    state writes. Symbols that users defined are rules that write themselves.
    """

    def __init__(self, charsmap: bytes, symbols: list[bytes], prefix: bool, squeeze: bool, escape: bool):
        self.prefix, self.squeeze, self.escape = prefix, squeeze, escape
        self.arcs: list[dict[int, int]] = [{}]
        self.writes: dict[int, bytes] = {}
        self.symbols = re.compile(b"|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))) if symbols else None
        for left, right in charsmap_rules(charsmap) if charsmap else ():
            state = 0
            for byte in left:
                if byte not in self.arcs[state]:
                    self.arcs[state][byte] = len(self.arcs)
                    self.arcs.append({})
                state = self.arcs[state][byte]
            self.writes[state] = right
        self.plain = not charsmap
        # Bytes at which no rule begins: a run of them is a loop on the start, written as it is.
        begins = {*self.arcs[0], *(s[0] for s in symbols), 0x20}
        self.idle = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in range(256) if b not in begins) + b"]+")

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(what is written, where reading goes on)."""
        if self.symbols is not None and (found := self.symbols.match(data, at)):
            return found[0], found.end()
        state, stop, best = 0, at, None
        while stop < len(data):
            state = self.arcs[state].get(data[stop], -1)
            if state < 0:
                break
            stop += 1
            if state in self.writes:
                best = self.writes[state], stop
        if best is not None:
            return best
        lead = data[at]
        stop = at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        return data[at:stop], stop

    def __call__(self, data: bytes) -> bytes:
        """The normalised text, in which blanks are still blanks."""
        if self.plain and not self.squeeze:
            return b" " + data if self.prefix and data else data
        out: list[bytes] = []
        at, blank = 0, self.squeeze  # blank: what comes next drops the blanks that it begins with
        if self.plain and self.symbols is None:
            out, at = [b" ".join(x for x in data.split(b" ") if x)], len(data)
        while at < len(data):
            if found := self.idle.match(data, at):
                written, at = found[0], found.end()
            else:
                written, at = self.step(data, at)
            if blank:
                written = written.lstrip(b" ")
            if written:
                out.append(written)
                blank = self.squeeze and written.endswith(b" ")
        text = b"".join(out)
        if self.squeeze:
            marks = (b" ", BLANK.encode()) if self.escape else (b" ",)
            while text.endswith(marks):
                text = text[: -len(marks[-1])] if text.endswith(marks[-1]) else text[:-1]
            if not text:
                return b""
        return (b" " if self.prefix and data else b"") + text


class Lexicon:
    """The pieces as a transducer: states are the nodes of a trie, arcs read a character.

    accepts: the symbol that an accepting state writes as it goes back to the start, or -1.
    """

    def __init__(self, pieces: dict[str, int]):
        self.arcs: list[dict[str, int]] = [{}]
        self.accepts = [-1]
        for piece, symbol in pieces.items():
            state = 0
            for char in piece:
                if char not in self.arcs[state]:
                    self.arcs[state][char] = len(self.arcs)
                    self.arcs.append({})
                    self.accepts.append(-1)
                state = self.arcs[state][char]
            self.accepts[state] = symbol


class Merges:
    """What a BPE model's merges allow, as an automaton: states are pieces, an arc leads to a piece that may follow.

    Its weight is nothing where merging the text of both pieces leaves just them, else
    infinity. Merging leaves a text's pieces as they are if and only if it leaves each
    neighbouring pair, so exactly one path through a text is finite: the one that merging
    finds. Arcs are compiled when they are first met.
    """

    def __init__(self, rank: dict[str, float], symbols: list[str]):
        self.rank, self.symbols = rank, symbols
        ordered = sorted(rank, key=lambda p: -rank[p])
        self.order = {p: i for i, p in enumerate(ordered)}
        self.tied = {x for p, q in zip(ordered, ordered[1:], strict=False) if rank[p] == rank[q] for x in (p, q)}
        self.split: dict[str, tuple[str, str]] = {}
        self.whole = {p for p in rank if len(p) == 1 or self.merged(p, self.split) == [p]}
        self.arcs: dict[tuple[int, int], float] = {}

    def merged(self, text: str, split: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Pieces that merging leaves: the neighbours with the best merged piece first, leftmost of equals.

        split: gets the two pieces that a text which becomes one piece was last made of.
        """
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            if split is not None and len(parts) == 2:
                split[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def arc(self, a: int, b: int) -> float:
        """The weight of the arc from piece a to piece b.

        Goes back in time through the pieces that met at the border: two that would have
        merged before either became part of a larger one, would not have ended so.
        """
        left, right = self.symbols[a], self.symbols[b]
        if left in self.tied or right in self.tied:
            apart = self.merged(left + right) == [left, right]
        else:
            apart, order, split, until = True, self.order, self.split, len(self.order)
            while True:
                if order.get(left + right, until) < until:
                    apart = False
                    break
                when_left = order[left] if len(left) > 1 else -1
                when_right = order[right] if len(right) > 1 else -1
                if when_left > when_right:
                    until, left = when_left, split[left][1]
                elif when_right >= 0:  # of equals, the left one merged first
                    until, right = when_right + 1, split[right][0]
                else:
                    break
        weight = self.arcs[a, b] = 0.0 if apart else INFINITY
        return weight


class Transducer:
    """A model, compiled: normaliser, pieces, byte fallback and, for BPE, merges.

    Composed with a text, its states are a place in the text and a context: the piece
    before it in a BPE model, nothing in a unigram model. An arc reads a piece and writes
    its ids; it weighs minus the piece's score, or what the merges say. A character that is
    no piece has an arc, too, which writes its bytes' ids, or the unknown id. Encoding is
    the shortest path in the tropical semiring: weights add up along a path, and the least
    sum counts.

    Unigram sums are kept as 32-bit numbers, as in the library. It sums over whole texts and
    this over stretches that no piece crosses, so paths that differ by less than such
    rounding may be taken differently.
    """

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, prefix, squeeze, escape, charsmap, self.unknown_text = UNIGRAM, True, True, True, b"", " ⁇ ".encode()
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                kind, self.unknown_text = spec.get(3, UNIGRAM), spec.get(44, self.unknown_text)
                if spec.get(24, 0):
                    raise ValueError("models that put white space behind words are not compiled")
            elif number == 3:
                spec = dict(fields(value))
                charsmap = spec.get(2, b"")
                prefix, squeeze, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
            elif number == 5 and dict(fields(value)).get(2, b""):
                raise ValueError("models that change decoded text are not compiled")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.bpe, self.blank = kind == BPE, BLANK if escape else " "
        self.unknown = self.types.index(UNK)
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        named = {t: {p: i for i, (p, u) in enumerate(zip(self.pieces, self.types, strict=True)) if u == t and p} for t in (NORMAL, USER, UNUSED)}
        self.user = named[USER]
        self.normaliser = Normaliser(charsmap, [p.encode() for p in self.user], prefix, squeeze, escape)
        self.symbols, self.emits = list(self.pieces), [(i,) for i in range(len(self.pieces))]
        self.alphabet = {c for p in (*named[NORMAL], *(named[UNUSED] if self.bpe else ())) for c in p}
        self.merges = None
        if self.bpe:
            merging = named[NORMAL] | named[UNUSED]
            for char in sorted(self.alphabet - set(merging)):  # characters that only longer pieces have
                merging[char] = len(self.symbols)
                self.symbols.append(char)
                self.emits.append(self.fallen_back(char))
            self.merges = Merges({p: self.scores[i] for p, i in merging.items() if i < len(self.pieces)}, self.symbols)
            for p in sorted(named[UNUSED], key=len):  # written as the parts they were made of
                if p in self.merges.split:
                    self.emits[named[UNUSED][p]] = tuple(i for part in self.merges.split[p] for i in self.emits[merging[part]])
            self.lexicon = Lexicon({p: i for p, i in merging.items() if i >= len(self.pieces) or p in self.merges.whole})
            self.split_user = re.compile("(" + "|".join(re.escape(p) for p in sorted(self.user, key=len, reverse=True)) + ")") if self.user else None
        else:
            self.lexicon = Lexicon(named[NORMAL] | named[USER])
            plain = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
            self.weights = [-s for s in self.scores]
            for p, i in self.user.items():  # so that they win
                self.weights[i] = 0.1 - len(p.encode()) * max(0.0, *plain)
            self.penalty = 10 - min(plain, default=0.0)
        # A stretch of text ends between two bytes that no piece holds side by side.
        self.joined = np.zeros((256, 256), bool)
        for p in (*self.lexicon_pieces(), *self.user):
            b = np.frombuffer(p.replace(self.blank, " ").encode(), np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # inside a character
        mark = BLANK.encode()
        self.joined[mark[-1], :] = self.joined[:, mark[0]] = True  # a blank that was written as its mark

    def lexicon_pieces(self) -> Iterator[str]:
        return (self.symbols[i] for i in self.lexicon.accepts if i >= 0)

    def fallen_back(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in char.encode()) if self.byte else (self.unknown,)

    def path(self, text: str) -> list[int]:
        """Ids on the shortest path through normalised text."""
        if self.bpe and self.split_user is not None:  # what users defined stays whole and merges with nothing
            out: list[int] = []
            for n, part in enumerate(self.split_user.split(text)):
                out += [self.user[part]] if n % 2 else self.shortest(part)
            return out
        return self.shortest(text)

    def shortest(self, text: str) -> list[int]:
        """Relaxes the arcs of the composed machine from place to place, as it has no cycles.

        One state a place is kept: a unigram model has no contexts, and of a BPE model's
        contexts of a place just one is finite. For a path to a place is finite where no two
        neighbours on it would have merged, which makes it what merging leaves of the text up
        to there, and that is one sequence. It weighs 0, which nothing undercuts, so an arc
        to a place that is reached already needs no weighing. Tests go through all paths.
        """
        n, arcs, accepts, bpe = len(text), self.lexicon.arcs, self.lexicon.accepts, self.bpe
        known, arc, weights = (self.merges.arcs.get, self.merges.arc, None) if bpe else (None, None, self.weights)
        cost, come = [INFINITY] * (n + 1), [0] * (n + 1)
        symbols = [FREE] * (n + 1)  # the last on the way, which is a BPE model's context
        cost[0] = 0.0
        for at in range(n):
            base = cost[at]
            if base == INFINITY:
                continue
            state, context, alone = 0, symbols[at], False
            for stop in range(at, n):
                state = arcs[state].get(text[stop])
                if state is None:
                    break
                symbol = accepts[state]
                if symbol < 0:
                    continue
                if stop == at:
                    alone = True
                there = stop + 1
                if bpe:
                    if cost[there] < INFINITY:
                        continue
                    weight = 0.0 if context < 0 else known((context, symbol))
                    if weight is None:
                        weight = arc(context, symbol)
                    total = base + weight
                else:
                    total = base + weights[symbol]
                if total < cost[there]:
                    cost[there], come[there], symbols[there] = total if bpe else float(np.float32(total)), at, symbol
            if not alone and (not bpe or text[at] not in self.alphabet):
                total = base if bpe else base + self.penalty
                if total < cost[at + 1]:
                    cost[at + 1], come[at + 1], symbols[at + 1] = total if bpe else float(np.float32(total)), at, FREE
        out: list[tuple[int, ...]] = []
        while n:
            out.append(self.emits[symbols[n]] if symbols[n] >= 0 else self.fallen_back(text[come[n] : n]))
            n = come[n]
        return [i for ids in reversed(out) for i in ids]

    def normalised(self, text: str) -> str:
        """The normaliser's output, with blanks as the pieces have them."""
        return self.normaliser(text.encode()).decode().replace(" ", self.blank)

    def encode(self, text: str) -> list[int]:
        ids = self.path(self.normalised(text))
        return ids if self.byte else [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != i]

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces on end, places): what decoding writes for each id."""
        spell = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else self.unknown_text if t == UNK else p.replace(BLANK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        return np.frombuffer(b"".join(spell), np.uint8), np.append(0, np.cumsum([len(s) for s in spell]))


class Codec:
    """A transducer with the paths of stretches it has met; a worker keeps one."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.fst = Transducer(f.read())
        self.letters, self.places = self.fst.spelled()
        self.control = np.array(self.fst.types) == CONTROL
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.edges = array("I"), array("q", [0])

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text's ids begin).

        Stretches that no piece crosses have paths of their own, and each distinct one is
        composed once.
        """
        fst = self.fst
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        if not fst.normaliser.plain or fst.normaliser.squeeze:
            text = raw.tobytes()
            texts = [fst.normaliser(text[s:e]) for s, e in zip(at.tolist(), at[1:].tolist(), strict=False)]
            raw, at = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
            if not len(raw):
                return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        elif fst.normaliser.prefix:
            full = np.diff(at) > 0
            raw = np.insert(raw, at[:-1][full], 0x20)
            at = at + np.append(0, np.cumsum(full))
        cut = np.append(True, ~fst.joined[raw[:-1], raw[1:]])
        cut[at[:-1][at[:-1] < len(raw)]] = True
        begin = np.append(np.flatnonzero(cut), len(raw))
        codes, distinct = dictionary(raw, begin)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        if fst.merges is not None and len(fst.merges.arcs) > PAIRS:
            fst.merges.arcs.clear()
        known, numbers = self.known, np.empty(len(distinct), np.int64)
        for i, stretch in enumerate(distinct.to_pylist()):
            n = known.get(stretch)
            if n is None:
                n = known[stretch] = len(known)
                self.flat.extend(fst.path(stretch.decode().replace(" ", fst.blank)))
                self.edges.append(len(self.flat))
            numbers[i] = n
        edges = np.frombuffer(self.edges, np.int64)
        first, size = edges[numbers], edges[numbers + 1] - edges[numbers]
        count = size[codes]
        ids = np.frombuffer(self.flat, np.uint32)[spread(first[codes], count)] if len(self.flat) else np.zeros(0, np.uint32)
        del edges  # an array that is looked at can't grow
        starts = np.append(0, np.cumsum(count))[np.searchsorted(begin, at)]
        if not fst.byte and len(ids):  # unknown ones on end are one
            again = np.append(False, (ids[1:] == fst.unknown) & (ids[:-1] == fst.unknown))
            again[starts[:-1][starts[:-1] < len(ids)]] = False
            starts = starts - np.append(0, np.cumsum(again))[starts]
            ids = ids[~again]
        return ids, starts

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Texts of the ids ids[at[i]:at[i+1]]; bytes that are no UTF-8 become U+FFFD each."""
        size = np.diff(self.places)[ids]
        text = self.letters[spread(self.places[ids], size)].tobytes()
        place = np.append(0, np.cumsum(size))
        fst, out = self.fst, []
        trimmed = fst.normaliser.prefix or fst.normaliser.squeeze
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            part = text[int(place[a]) : int(place[b])]
            if not part.isascii() and (self.control[ids[a:b]]).any():  # bytes on either side of a control piece are no character
                cuts = [a, *(np.flatnonzero(self.control[ids[a:b]]) + a).tolist(), b]
                part = b"".join(whole(text[int(place[x]) : int(place[y])]) for x, y in zip(cuts, cuts[1:], strict=False))
            while trimmed and a < b and fst.types[ids[a]] in (CONTROL, NORMAL, USER, UNUSED):
                # A blank in front of the first piece goes, or of each until there is text.
                if fst.types[ids[a]] != CONTROL:
                    if not fst.pieces[ids[a]].startswith(BLANK):
                        break
                    part = part[1:]
                    if not fst.normaliser.squeeze or size[a] > 1:
                        break
                a += 1
            out.append(part)
        return [whole(x) for x in out]


codecs.register_error("each", lambda e: ("\ufffd", e.start + 1))


def whole(data: bytes) -> bytes:
    """UTF-8, with U+FFFD for each byte that is none."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "each").encode()
    return data


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Little-endian unsigned 32-bit numbers of each stretch, as binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(4 * at)), pa.py_buffer(values.astype("<u4"))]).cast(pa.binary())


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns in `keep`, n_tokens, ids) for each row; ids are little-endian unsigned 32-bit numbers.

    A null or empty text has no tokens. Repeated rows stay. model: path of a model file on
    every worker.
    """
    names = [id_col, *keep]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    picked = docs.select(F.col(text_col).alias("_text"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", SLICE):
            ids, at = codec(model).encode(*byte_column(part.column(0)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(at)), blobs(ids, at)], names=schema.names)

    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds the text of the ids column; a null has none."""
    schema = T.StructType([*encoded.schema, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", SLICE):
            raw, at = byte_column(part.column(part.schema.get_field_index("ids")))
            texts = pa.array(codec(model).decode(np.frombuffer(raw.tobytes(), "<u4"), at // 4), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=schema.names)

    return encoded.mapInArrow(run, schema)
