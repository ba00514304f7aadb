"""Byte-level BPE encoding and decoding.

Pre-tokenisation without a regular expression: code points become symbols of a small automaton
(class table and the few characters ahead), each symbol is a function from state to state, and
the composition of these functions, which is associative, is scanned over blocks of the text in
parallel; the state before each character tells whether a slice starts there. Slices go through a
cache to pair merging by rank. Offsets of slices and of tokens are kept for decoding.

Null text encodes as the empty text, to no ids. Texts of any length are encoded whole. Unknown or
null ids are an error in decoding, as no encoder makes them."""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: White_Space of Unicode.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that form slices of their own after an apostrophe.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")

# Symbols: letter, number, other; an apostrophe before an ending of one or two letters; a space or
# other white space inside a run (or at the text's end), or as the last before something else.
L, N, O, A1, A2, SP_IN, SP_LAST, WS_IN, WS_LAST = range(9)
FIRST = 9  # added to the symbol of a text's first character
# States: nothing open; in letters, numbers, others, white space; after a space that joins what
# follows; one or two characters before the end of an ending.
NONE, IN_L, IN_N, IN_O, IN_W, JOIN, END1, END2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at the symbol."""
    if symbol >= FIRST:
        return _step(NONE, symbol - FIRST)[0], True
    if state in (END1, END2):
        return (NONE if state == END1 else END1), False
    kind = {L: IN_L, N: IN_N, O: IN_O}
    if symbol in kind:
        return kind[symbol], state not in (kind[symbol], JOIN)
    if symbol in (A1, A2):
        return (IN_O, False) if state in (IN_O, JOIN) else (END1 if symbol == A1 else END2, True)
    if symbol in (SP_IN, WS_IN):
        return IN_W, state != IN_W
    return (JOIN if symbol == SP_LAST else NONE), True


class Automaton:
    """The monoid of the symbols' functions: numbers for all compositions, and their table."""

    def __init__(self) -> None:
        symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(2 * FIRST)]
        known = {tuple(range(8)): 0}
        queue = [tuple(range(8))]
        for f in queue:
            for g in symbols:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.size = len(known)
        self.of_symbol = np.array([known[f] for f in symbols], np.uint16)
        self.apply = np.array(queue, np.uint8)  # function, state -> state
        self.then = np.array([[known[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint16).ravel()
        self.starts = np.array([[_step(s, x)[1] for x in range(2 * FIRST)] for s in range(8)], bool).ravel()

    def slice_starts(self, symbols: np.ndarray, block: int = 512) -> np.ndarray:
        """Whether a slice starts at each symbol. The first symbol must be a text's first."""
        n = len(symbols)
        wide = max(1, -(-n // block))
        f = np.zeros(wide * block, np.uint16)
        f[:n] = self.of_symbol[symbols]
        f = np.ascontiguousarray(f.reshape(wide, block).T)
        for j in range(1, block):  # composition within all blocks at once
            f[j] = self.then[f[j - 1] * np.uint16(self.size) + f[j]]
        entry = np.zeros(wide, np.uint8)
        state = 0
        for b, total in enumerate(f[-1].tolist()):  # one step a block
            entry[b] = state
            state = self.apply[total, state]
        before = np.empty((block, wide), np.uint8)
        before[0] = entry
        before[1:] = self.apply[f[:-1], entry[None, :]]
        return self.starts[before.T.ravel()[:n] * np.uint16(2 * FIRST) + symbols]


def _classes() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 other, 3 apostrophe, 4 space, 5 other white space."""
    kinds = {"L": 0, "N": 1}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 2) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[SPACES] = 5
    table[0x20], table[0x27] = 4, 3
    return table


class Slicer:
    """Cuts texts into the slices that are merged one by one."""

    def __init__(self) -> None:
        self.classes, self.automaton = _classes(), Automaton()
        self.base = np.array([L, N, O, O, SP_LAST, WS_LAST], np.uint8)

    def symbols(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        classes = self.classes[points]
        out = self.base[classes]
        n = len(out)
        # The last character of a text has nothing after it.
        ends = np.append(firsts[1:], n) - 1
        white = classes >= 4
        before_white = np.append(white[1:], True)
        before_white[ends] = True
        out[white & before_white] -= 1  # the _IN forms precede the _LAST forms
        at = np.flatnonzero(classes == 3)
        if len(at):
            padded = np.append(points, np.zeros(2, points.dtype))
            left = ends[np.searchsorted(firsts, at, "right") - 1] - at
            one, two = padded[at + 1], padded[at + 2]
            out[at[(left >= 1) & np.isin(one, [ord(c) for c in ENDINGS_1])]] = A1
            double = np.zeros(len(at), bool)
            for a, b in ENDINGS_2:
                double |= (one == ord(a)) & (two == ord(b))
            out[at[double & (left >= 2)]] = A2
        out[firsts] += FIRST
        return out

    def spans(self, texts: list[str]) -> Spans:
        joined, points, begins = join_texts(texts)
        firsts = begins[:-1][np.diff(begins) > 0]
        starts = np.flatnonzero(self.automaton.slice_starts(self.symbols(points, firsts))) if len(firsts) else np.zeros(0, np.int64)
        return Spans(joined, points, begins, starts, np.append(starts[1:], len(points)))


    def stretches(self, text: str) -> Iterator[str]:
        """A long text in parts of about STRETCH characters that begin where a slice starts. A slice start
        depends on what stands before it and on two characters after; what follows it doesn't depend on what stands
        before. White space before another character isn't cut off from it, as it would look like a text's end.
        Only a slice that is longer than a part makes the part longer."""
        at, size = 0, STRETCH
        while len(text) - at > size:
            spans = self.spans([text[at : at + size]])
            starts = spans.starts[(spans.starts > 0) & (spans.starts < size - 2)]
            white = self.classes[spans.points] >= 4
            starts = starts[~white[starts - 1] | white[starts]]
            if len(starts):
                yield text[at : at + int(starts[-1])]
                at, size = at + int(starts[-1]), STRETCH
            else:
                size *= 2
        yield text[at:]


def join_texts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, its code points, and where each text begins (and the last ends)."""
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


class Spans:
    """Stretches [starts, ends) of joined texts, in order, none across two texts."""

    def __init__(self, joined: str, points: np.ndarray, begins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.joined, self.points, self.begins, self.starts, self.ends = joined, points, begins, starts, ends
        at = np.searchsorted(starts, begins)
        self.counts = np.diff(at)

    def starts_in_text(self) -> np.ndarray:
        return self.starts - np.repeat(self.begins[:-1], self.counts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch the first eight and the next eight bytes of its UTF-8 form (little-endian, zeros after its
        end), and its length in bytes. For up to 16 bytes these three are the stretch itself."""
        data = self.joined.encode("utf-8", "surrogatepass")
        starts, ends = self.starts, self.ends
        if len(data) != len(self.points):
            p = self.points
            at = np.zeros(len(p) + 1, np.int64)
            np.cumsum(1 + (p > 0x7F).view(np.int8) + (p > 0x7FF).view(np.int8) + (p > 0xFFFF).view(np.int8), out=at[1:])
            starts, ends = at[starts], at[ends]
        n = ends - starts
        eight = np.ndarray((len(data) + 9,), "<u8", buffer=data + bytes(16), strides=(1,))
        return eight[starts] & _UPTO[np.minimum(n, 8)], eight[np.minimum(starts + 8, len(data) + 8)] & _UPTO[np.clip(n - 8, 0, 8)], n


#: Masks of the first 0 to 8 bytes.
_UPTO = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Merger:
    """Pair merging by rank: always the leftmost pair of the lowest rank. A pair's rank is that of its
    bytes, so the ranks are the only table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = [bytes([b]) for b in range(256)]

    def __call__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        rank_of, none = self.ranks.get, 1 << 60
        if (whole := rank_of(data)) is not None:
            return [whole]
        single = self.single
        parts = [single[b] for b in data]
        if len(parts) > 64:
            return self._long(parts)
        ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            merged = parts[i] + parts[i + 1]
            parts[i : i + 2] = [merged]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + merged, none)
            if i < len(ranks):
                ranks[i] = rank_of(merged + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap and links, for slices of any length. The heap holds rank * 2**32 + place."""
        import heapq
        from array import array

        n, rank_of = len(parts), self.ranks.get
        after, prior = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        after[-1] = -1
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank_of(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i] if parts[i] else -1  # a part that went into another is empty
            if j < 0 or rank_of(parts[i] + parts[j]) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = after[j]
            if after[j] >= 0:
                prior[after[j]] = i
                if (r := rank_of(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if prior[i] >= 0 and (r := rank_of(parts[prior[i]] + parts[i])) is not None:
                heapq.heappush(heap, r << 32 | prior[i])
        return [self.ranks[x] for x in parts if x]


class SliceCache:
    """stretch of text -> its row in a growing flat table of ids. Stretches of up to 16 bytes are found in an
    open-addressing table that holds them as two words and a length, all of which are compared; longer
    ones by a dict of the stretches themselves. So equal rows mean equal stretches.
    Emptied when full: it only saves work, so nothing depends on what is in it."""

    #: Characters of long stretches that may be kept.
    LONG_CHARS = 1 << 24

    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int = 20) -> None:
        self.merge, self.bits = merge, bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.low, self.high, self.size = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint8)  # size 0: an empty place
        self.row, self.long, self.long_chars = np.zeros(size, np.int32), {}, 0
        self.flat, self.used, self.rows_used = np.zeros(1 << 16, np.uint32), 0, 0
        self.first, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _place(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (low ^ n * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32)) ^ high) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, at = np.full(len(low), -1, np.int64), self._place(low, high, n)
        todo = np.arange(len(low))
        while len(todo):
            size = self.size[at]
            hit = (self.low[at] == low) & (self.high[at] == high) & (size == n)
            out[todo[hit]] = self.row[at[hit]]
            more = ~hit & (size != 0)
            todo, low, high, n, at = todo[more], low[more], high[more], n[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Put in stretches that aren't there, of equal ones one; return which."""
        out, todo, at = np.zeros(len(low), bool), np.arange(len(low)), self._place(low, high, n)
        while len(todo):
            free = self.size[at] == 0
            # of all that want a free place the last written has it; equal ones go with it
            self.row[at[free]] = rows[free]
            won = free & (self.row[at] == rows)
            self.low[at[won]], self.high[at[won]], self.size[at[won]] = low[won], high[won], n[won]
            out[todo[won]] = True
            more = ~((self.low[at] == low) & (self.high[at] == high) & (self.size[at] == n))
            todo, low, high, n, rows, at = todo[more], low[more], high[more], n[more], rows[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def rows(self, spans: Spans) -> np.ndarray:
        """The row of each stretch; what isn't there is merged and added."""
        low, high, n = spans.words()
        out = np.full(len(n), -1, np.int64)
        short = np.flatnonzero(n <= 16)
        long = np.flatnonzero(n > 16)
        if not len(long):
            short = slice(None)
        low, high, n = low[short], high[short], n[short].astype(np.uint64)
        found = self._find(low, high, n)
        missing = np.flatnonzero(found < 0)
        joined = spans.joined
        texts = [joined[a:b] for a, b in zip(spans.starts[long].tolist(), spans.ends[long].tolist())]
        new_long = list(dict.fromkeys(t for t in texts if t not in self.long))
        if len(missing) or new_long:
            chars = sum(map(len, new_long))
            if 2 * (self.rows_used + len(missing)) > len(self.size) or self.used > 1 << 28 or (self.long and self.long_chars + chars > self.LONG_CHARS):
                if self.rows_used:
                    self.clear()
                    return self.rows(spans)
                self.bits = max(self.bits, 2 + int(len(missing)).bit_length())  # one batch of more than fits
                self.clear()
            base = self.rows_used
            marks = np.arange(base, base + len(missing))  # for the time being
            won = missing[self._insert(low[missing], high[missing], n[missing], marks)]
            at = won if isinstance(short, slice) else short[won]
            new = [joined[a:b] for a, b in zip(spans.starts[at].tolist(), spans.ends[at].tolist())] + new_long
            ids, sizes = self.merge(new)
            total, rows = len(ids), np.arange(base, base + len(new))
            if base + len(new) > len(self.n):
                self.first, self.n = (np.concatenate([x, np.zeros(max(len(x), base + len(new)), np.int32)]) for x in (self.first, self.n))
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), self.used + total), np.uint32)])
            self.n[rows] = sizes
            self.first[rows] = self.used + np.cumsum(sizes) - sizes
            self.flat[self.used : self.used + total] = ids
            self.used, self.rows_used = self.used + total, base + len(new)
            self._number(low[won], high[won], n[won], rows[: len(won)])
            self.long.update(zip(new_long, rows[len(won) :].tolist()))
            self.long_chars += chars
            found[missing] = self._find(low[missing], high[missing], n[missing])
        out[short] = found
        out[long] = [self.long[t] for t in texts]
        return out

    def _number(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, rows: np.ndarray) -> None:
        """Give stretches that are there, all of them distinct, their rows."""
        at = self._place(low, high, n)
        while len(at):
            hit = (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == n)
            self.row[at[hit]] = rows[hit]
            low, high, n, rows, at = low[~hit], high[~hit], n[~hit], rows[~hit], (at[~hit] + 1) & ((1 << self.bits) - 1)

    def tokens(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches in order, and the number of ids of each."""
        first, n = self.first[rows].astype(np.int64), self.n[rows].astype(np.int64)
        return gather(self.flat, first, n), n


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for y in lists for x in y), np.uint32, int(sizes.sum())), sizes


def gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges flat[first : first + n], one after the other."""
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bits: int = 20) -> None:
        self.slicer, self.cache = Slicer(), SliceCache(merge, bits)

    @classmethod
    def of_ranks(cls, path: str) -> Encoder:
        merger = Merger(load_ranks(path))
        return cls(lambda new: flat_lists(list(map(merger, new))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, their number for each text, and for each slice its start in the text
        and the number of slices of each text. Long texts go through in stretches, so that the arrays made of them are
        bounded."""
        if max(map(len, texts), default=0) > 2 * STRETCH:
            parts = [self._long(t) for t in texts]
            return tuple(np.concatenate(x) for x in zip(*parts))
        return self._run(texts)

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        spans = self.slicer.spans(texts)
        ids, n = self.cache.tokens(self.cache.rows(spans))
        ends = np.append(0, np.cumsum(n))
        upto = np.append(0, np.cumsum(spans.counts))
        return ids, ends[upto[1:]] - ends[upto[:-1]], spans.starts_in_text(), spans.counts


    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, starts, at = [], [], 0
        for part in self.slicer.stretches(text):
            i, _, s, _ = self._run([part])
            ids.append(i)
            starts.append(s + at)
            at += len(part)
        return np.concatenate(ids), np.array([sum(map(len, ids))]), np.concatenate(starts), np.array([sum(map(len, starts))])


#: Characters of a long text that are worked on at once.
STRETCH = 500_000


def pieces(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """Texts in runs of about so many characters, which bounds the arrays made of them."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values.astype(np.int32)))


_encoders: dict[str, Encoder] = {}  # of this worker


class Decoder:
    """ids -> bytes, by the tokens' places in one buffer."""

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and the number of bytes of each id, whose running sum are the offsets."""
        return gather(self.flat, self.first[ids], self.n[ids]), self.n[ids]


_decoders: dict[str, Decoder] = {}


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """(key, ids array<int>, slice_starts array<int>, decoded binary): the ids of every row's whole
    text, where (code points) each slice starts (empty if offsets is false), and the bytes that the
    ids decode to (null if decoded is false; `decode` gives them for ids from elsewhere)."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = [key, "ids", "slice_starts", "decoded"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path], _decoders[path] = Encoder.of_ranks(path), Decoder(path)
        encoder, decoder = _encoders[path], _decoders[path]
        for b in it:
            done = 0
            for run in pieces([x or "" for x in b.column(1).to_pylist()]):
                ids, n, starts, counts = encoder.encode(run)
                if not offsets:
                    starts, counts = starts[:0], np.zeros_like(counts)
                upto = np.append(0, np.cumsum(n))
                data = pa.array(_parts(decoder, ids, upto) if decoded else [None] * len(run), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(run)), _lists(ids, n), _lists(starts, counts), data], names)
                done += len(run)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).transform(map_arrow, batches, f"`{key}` {kind}, ids array<int>, slice_starts array<int>, decoded binary")


def _parts(decoder: Decoder, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
    """The bytes of each of consecutive lists of ids; upto: ids before each list, and in all."""
    data, n = decoder(ids)
    places = np.append(0, np.cumsum(n))[upto].tolist()
    data = data.tobytes()
    return [data[x:y] for x, y in zip(places, places[1:])]


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for in a further column (binary, as any bytes are
    possible in a list of ids that isn't a whole text)."""
    path = path or public_tokenizers.path(VOCABULARY)
    columns = list(encoded.columns)
    at = columns.index(ids)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + [f"`{name}` binary"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _decoders:
            _decoders[path] = Decoder(path)
        for b in it:
            col = b.column(at)
            flat, upto = col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            rows: list[bytes] = []
            begin = 0
            while begin < len(col):  # runs of about a million ids
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + 1_000_000)))
                end = min(end, len(col))
                rows += _parts(_decoders[path], flat[upto[begin] : upto[end]], upto[begin : end + 1] - upto[begin])
                begin = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.binary())], [*columns, name])

    return encoded.transform(map_arrow, batches, schema)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
