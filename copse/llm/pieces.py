"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, put, quoted

#: The white-space marker, and the kinds of pieces in a model file (fixed values).
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How much less than the least score an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker remembers, and their longest.
MEMO, MEMO_CHARS = 100_000, 32
#: Chunks that go through the trie together.
BATCH = 4096


def _fields(data: bytes):
    """(number, value) for each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


class DoubleArray:
    """A trie in two arrays: from state s by code c to t = base[s] + c, if check[t] is s."""

    def __init__(self, keys: dict[tuple[int, ...], int]):
        """keys: code sequences (codes from 1) and their values."""
        size = 1 << 12
        self.base, self.check, self.value = (np.full(size, -1, np.int32) for _ in range(3))
        order = sorted(keys)
        self.check[0], free = 0, 1
        todo = [(0, 0, len(order), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            if len(order[low]) == depth:
                self.value[state] = keys[order[low]]
                low += 1
            groups, at = [], low
            while at < high:
                code, end = order[at][depth], at
                while end < high and order[end][depth] == code:
                    end += 1
                groups.append((code, at, end))
                at = end
            if not groups:
                continue
            codes = np.array([g[0] for g in groups])
            base = max(0, free - int(codes[0]))
            while True:
                self._grow(base + int(codes[-1]) + 1)
                if (self.check[base + codes] < 0).all():
                    break
                base += 1
            self.base[state] = base
            self.check[base + codes] = state
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            todo += [(base + c, a, b, depth + 1) for c, a, b in groups]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            for name in ("base", "check", "value"):
                setattr(self, name, np.concatenate([getattr(self, name), np.full(more, -1, np.int32)]))


class CharacterMap:
    """The normalisation rules of a model file: a trie of 32-bit units, then the texts that it leads to.

    A unit holds a label (or, as a leaf, the place of a text), whether it has a leaf, and an offset.
    """

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]
        self.known: dict[str, bool] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, int] | None:
        """The end of the longest key that starts there and the place of its text."""
        units, found = self.units, None
        offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        place = offset(units[0])
        for end in range(at, len(raw)):
            place ^= raw[end]
            if place >= len(units) or units[place] & 0x800000FF != raw[end]:
                break
            unit = units[place]
            place ^= offset(unit)
            if unit >> 8 & 1:
                found = (end + 1, units[place] & 0x7FFFFFFF)
        return found

    def _starts(self, char: str) -> bool:
        if char not in self.known:
            raw, place = char.encode("utf-8", "surrogatepass"), (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
            place ^= raw[0]
            self.known[char] = self.longest(raw, 0) is not None or place < len(self.units) and self.units[place] & 0x800000FF == raw[0]
        return self.known[char]

    def apply(self, text: str) -> str:
        if not any(map(self._starts, set(text))):
            return text
        raw, at, out = text.encode("utf-8", "surrogatepass"), 0, bytearray()
        while at < len(raw):
            found = self.longest(raw, at)
            if found:
                at, place = found
                out += self.texts[place : self.texts.index(0, place)]
            else:
                n = 1
                while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                    n += 1
                out += raw[at : at + n]
                at += n
        return out.decode("utf-8", "surrogatepass")


class Pieces:
    """A vocabulary of pieces with log scores.

    A model file of any piece algorithm serves; its scores are taken as unigram log scores and added up in
    double precision.  A space becomes the marker, and one marker comes before the text where the model says
    so.  Where the model has normalisation rules or takes out extra spaces, texts are normalised first, and
    decoding gives the normalised text; else white space stays as it is, and a marker character of the text
    itself goes to bytes, so that decoding gives the text back.
    """

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, self.to_bytes, self.map, self.squeeze = True, False, None, True
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                self.to_bytes = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self._build()

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as file:
            return cls(file.read())

    def _build(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        texts = {self.pieces[i].replace(MARK, " "): i for i in reversed(usable)}
        self.codes = {c: n for n, c in enumerate(sorted({c for t in texts for c in t}), 1)}
        trie = DoubleArray({tuple(self.codes[c] for c in t): i for t, i in texts.items() if t})
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        normal = [self.scores[i] for i, k in enumerate(self.kinds) if k == NORMAL]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.raw = [
            b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        # No piece goes on from another character to a space: then a text falls apart before spaces.
        apart = not any(" " in t.lstrip(" ") for t in texts)
        breaks = "".join(re.escape(c) for c in "\n\r\t" if c not in self.codes)
        self.chunks = re.compile(rf" *[^ {breaks}]+| +|[{breaks or ' '}]") if apart else re.compile(r"(?s).+")
        self.memo: dict[str, bytes] = {}
        self.longest = max(map(len, texts), default=1)
        self.arrays = (np.array([ord(c) for c in self.codes], np.uint32), np.array(list(self.codes.values())), *(x.astype(np.int64) for x in (trie.base, trie.check, trie.value)))
        self.score_array = np.array(self.scores, float)

    def normalised(self, text: str | None) -> str | None:
        """The text by the model's rules: mapped characters, and single spaces within."""
        if not text:
            return text
        text = self.map.apply(text) if self.map else text
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def viterbi(self, text: str) -> list[int]:
        """Ids of the pieces of the best path; of equal paths, the one whose last pieces are longest."""
        n, codes, base, check, value, scores = len(text), self.codes, self.base, self.check, self.value, self.scores
        best, back, size = [None] * (n + 1), [None] * (n + 1), len(check)
        best[0] = 0.0
        of = [codes.get(c, 0) for c in text]
        for start in range(n):
            here, state, end, single = best[start], 0, start, False
            while end < n:
                code = of[end]
                to = base[state] + code
                if not code or base[state] < 0 or to >= size or check[to] != state:
                    break
                state, end = to, end + 1
                piece = value[state]
                if piece >= 0:
                    single = single or end == start + 1
                    score = here + scores[piece]
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, (start, piece)
            if not single:
                score = here + self.unknown_score
                if best[start + 1] is None or score > best[start + 1]:
                    best[start + 1], back[start + 1] = score, (start, -1)
        out, end = [], n
        while end:
            start, piece = back[end]
            if piece >= 0:
                out.append(piece)
            elif self.to_bytes:
                out += [self.bytes_[b] for b in reversed(text[start].encode())]
            else:
                out.append(self.unknown)
            end = start
        return out[::-1]

    def viterbi_many(self, texts: list[str]) -> list[bytes]:
        """viterbi() of each text (none empty) as int32 in a row; the steps run over all texts at once."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        flat = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(texts[i]) for i in order])
        points, code_of, base, check, value = self.arrays
        found = np.searchsorted(points, flat)
        codes = np.where(points[np.minimum(found, len(points) - 1)] == flat, code_of[np.minimum(found, len(points) - 1)], 0)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        ends = np.repeat(starts + sizes, sizes)
        # Matches of each length from each place, all places together.
        score = np.full((self.longest + 1, len(flat)), -np.inf)
        piece = np.full((self.longest + 1, len(flat)), -1, np.int32)
        at, state = np.arange(len(flat)), np.zeros(len(flat), np.int64)
        for length in range(1, self.longest + 1):
            inside = at + length <= ends[at]
            at, state = at[inside], state[inside]
            code = codes[at + length - 1]
            to = base[state] + code
            good = (code > 0) & (base[state] >= 0) & (to < len(check))
            good[good] = check[to[good]] == state[good]
            at, state = at[good], to[good]
            if not len(at):
                break
            got = value[state]
            hit = got >= 0
            piece[length, at[hit]] = got[hit]
            score[length, at[hit]] = self.score_array[got[hit]]
        alone = piece[1] < 0
        score[1, alone] = self.unknown_score
        # The best path to each place, place by place of all texts; the longest last piece wins ties.
        width = int(sizes[0])
        best = np.full((width + 1, len(texts)), -np.inf)
        best[0] = 0.0
        took = np.zeros((width + 1, len(texts)), np.int64)
        live = len(texts)
        for end in range(1, width + 1):
            while sizes[live - 1] < end:
                live -= 1
            for length in range(min(end, self.longest), 0, -1):
                value_ = best[end - length, :live] + score[length, starts[:live] + end - length]
                more = value_ > best[end, :live]
                best[end, :live][more] = value_[more]
                took[end, :live][more] = length
        back, rows, columns = sizes.copy(), np.arange(len(texts)), []
        kept = np.full((width, len(texts)), -2, np.int32)  # filled from the end
        odd = np.zeros(len(texts), bool)
        for step in range(width):
            live_ = rows[back > 0]
            if not len(live_):
                break
            length = took[back[live_], live_]
            got = piece[length, starts[live_] + back[live_] - length]
            odd[live_[got < 0]] = True
            kept[width - 1 - step, live_] = got
            back[live_] -= length
        out = [b""] * len(texts)
        table, first = np.ascontiguousarray(kept.T), (kept.T == -2).sum(1)
        for row, i in enumerate(order):
            out[i] = np.array(self.viterbi(texts[i]), np.int32).tobytes() if odd[row] else table[row, first[row] :].tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as int32 in a row; nothing for an empty text or null."""
        memo, split = self.memo, self.chunks.findall
        texts = map(self.normalised, texts)
        parts = [split(" " + t if self.prefix else t) if t else [] for t in texts]
        new = [c for c in set().union(*parts) if c not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(set().union(*parts))
        short = sorted((c for c in new if len(c) <= MEMO_CHARS), key=len)
        known = memo if len(new) <= MEMO else {}
        for low in range(0, len(short), BATCH):
            some = short[low : low + BATCH]
            known.update(zip(some, self.viterbi_many(some), strict=True))
        known = known | {c: np.array(self.viterbi(c), np.int32).tobytes() for c in new if len(c) > MEMO_CHARS} if len(short) < len(new) else known
        return [b"".join([known[c] for c in p]) for p in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids])
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


def shared(spark: SparkSession, path: str):
    """The vocabulary of the file at path (read by the driver), broadcast; its size is the file's."""
    return spark.sparkContext.broadcast(Pieces.load(path))


def encoded(text: Column, pieces) -> Column:
    """Ids as array<int>: none for an empty text, null for null.  pieces: from shared()."""

    def of(texts: pa.Array) -> pa.Array:
        own, ids, ends = pieces.value, bytearray(), [0]
        for low in range(0, len(texts), 128):
            for got in own.encode_all(texts.slice(low, 128).to_pylist()):
                ids += got
                ends.append(len(ids) // 4)
        values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=texts.is_null())

    return F.arrow_udf(of, "array<int>")(text)


def decoded(ids: Column, pieces) -> Column:
    """The text of an array of ids; null for null."""

    def of(lists: pa.Array) -> pa.Array:
        own, flat, ends = pieces.value, lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        return pa.array([own.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())

    return F.arrow_udf(of, "string")(ids)


def tokenized(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with ids and n_ids; columns of df with these names are replaced.

    A null text has null ids and no count of them (0); an empty one has none.  Each row stands alone.
    """
    rows = df.drop(*[c for c in df.columns if c.lower() in ("ids", "n_ids") and c != text_col])
    out = pinned(rows, "ids", encoded(F.col(quoted(text_col)), shared(df.sparkSession, path)))  # encoded once
    return put(out, n_ids=F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).cast("long"))
