"""The numbers of rng.u() in arrays, for Arrow batches in tasks: an MD5 of many short texts that end in a whole number."""

from __future__ import annotations

import math

import numpy as np

_ROTATE = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed at once, whose words stay in a processor's cache.
AT_ONCE = 8192


def _steps(state: list[np.ndarray], words: list, last: bool) -> list[np.ndarray]:
    """The state after a block of 16 words, arrays or numbers; last: only its first word is right, which step 60 gives."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[g]
        if isinstance(word, int):
            np.add(f, np.uint32((_ADD[i] + word) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(_ADD[i]), out=f)
            np.add(f, word, out=f)
        np.left_shift(f, np.uint32(_ROTATE[i]), out=t)
        np.right_shift(f, np.uint32(32 - _ROTATE[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return [state[0] + b] if last else [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


class Leads:
    """Texts before the number, told apart by their places in the list."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        width = max(4, -(-int(self.sizes.max(initial=0)) // 4) * 4)
        packed = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), "<u4")
        self.words = np.ascontiguousarray(packed.reshape(len(raw), width // 4).T)  # a row for each word

    def heads(self, which: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The first 32 bits of the MD5 of the text at which and a number, 0 or more, for each of both arrays."""
        out = np.empty(len(numbers), np.uint32)
        for i in range(0, len(numbers), AT_ONCE):
            some, x = which[i : i + AT_ONCE], numbers[i : i + AT_ONCE]
            digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), x, "right") + 1
            out[i : i + AT_ONCE] = self._heads(some, x, self.sizes[some], digits)
        return out

    def _heads(self, which: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """heads() of a few; texts of any length are hashed together if they have as many blocks."""
        blocks = (sizes + digits + 8) // 64 + 1
        most, out = int(blocks.max(initial=1)), np.empty(len(which), np.uint32)
        if len(which) and most > blocks.min():
            for b in range(1, most + 1):
                if len(rows := np.flatnonzero(blocks == b)):
                    out[rows] = self._heads(which[rows], numbers[rows], sizes[rows], digits[rows])
            return out
        used = int((sizes + digits).max(initial=0)) // 4 + 1
        words = np.zeros((used, len(which)), np.uint32)
        shapes = sizes * 32 + digits
        kinds = np.flatnonzero(np.bincount(shapes))
        for s in kinds:
            rows = np.flatnonzero(shapes == s) if len(kinds) > 1 else slice(None)
            self._fill(words, rows, which[rows], numbers[rows], *divmod(int(s), 32))
        block = [words[j] if j < used else 0 for j in range(16 * most)]
        block[-2] = ((sizes + digits) * 8).astype(np.uint32) if len(kinds) > 1 else int(sizes[0] + digits[0]) * 8 if len(which) else 0
        state = [np.full(len(which), s, np.uint32) for s in _START]
        for b in range(most):
            state = _steps(state, block[16 * b : 16 * b + 16], b == most - 1)
        return state[0].byteswap()

    def _fill(self, words: np.ndarray, rows: np.ndarray | slice, which: np.ndarray, numbers: np.ndarray, size: int, digits: int) -> None:
        """The words of texts of one size and numbers of one length."""
        own = [self.words[j][which] if j < -(-size // 4) else np.zeros(len(which), np.uint32) for j in range((size + digits) // 4 + 1)]
        x = numbers.astype(np.uint32 if digits < 10 else np.uint64)
        for p in range(size + digits - 1, size - 1, -1):
            rest = x // x.dtype.type(10)
            own[p // 4] |= ((x - rest * x.dtype.type(10)).astype(np.uint32) + np.uint32(48)) << np.uint32(p % 4 * 8)
            x = rest
        own[-1] |= np.uint32(0x80 << (size + digits) % 4 * 8)
        for j, w in enumerate(own):
            words[j][rows] = w
