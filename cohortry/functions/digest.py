"""Numbers from md5, many at once: ``ranking.md5_number`` of texts that differ in a trailing number only."""

from __future__ import annotations

import hashlib

import numpy as np

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [np.array([int(abs(np.sin(i + 1)) * 2**32)], np.uint32) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = [np.array([v], np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a text that md5 takes in one block.
_ROOM = 55


class Numbered:
    """md5 numbers of prefixes followed by each of the decimal numbers ``first`` to ``last`` (exclusive), all of as many digits."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.n, self.width = first, last - first, len(str(first))
        at = np.arange(first, last)
        self.digits = np.stack([(at // 10**k % 10 + 48).astype(np.uint8) for k in range(self.width - 1, -1, -1)], axis=1)
        self.words: dict[int, dict[int, np.ndarray]] = {}

    def of(self, prefixes: list[bytes]) -> np.ndarray:
        """A row for each of ``prefixes``, which are equally long."""
        length = len(prefixes[0])
        size = length + self.width
        if size > _ROOM:
            return np.array([[int.from_bytes(hashlib.md5(b"%s%d" % (p, self.first + k)).digest()[:4], "big") for k in range(self.n)] for p in prefixes], np.uint32)
        rest = bytes(self.width) + b"\x80" + bytes(_ROOM - size) + (8 * size).to_bytes(8, "little")
        fixed = np.frombuffer(b"".join(p + rest for p in prefixes), "<u4").reshape(-1, 16)
        if length not in self.words:
            low, high = length // 4, (size - 1) // 4 + 1
            room = np.zeros((self.n, 4 * (high - low)), np.uint8)
            room[:, length - 4 * low : size - 4 * low] = self.digits
            own = room.view("<u4")
            self.words[length] = {low + k: np.ascontiguousarray(own[:, k]) for k in range(high - low)}
        moving = self.words[length]
        words = [moving[k] | fixed[:, k : k + 1] if k in moving else fixed[:, k : k + 1] for k in range(16)]
        a, b, c, d, mixed, turned, spare = np.empty((7, len(prefixes), self.n), np.uint32)
        for row, v in zip((a, b, c, d), _START, strict=True):
            row[:] = v
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=mixed)
                np.bitwise_and(mixed, b, out=mixed)
                np.bitwise_xor(mixed, d, out=mixed)
            elif i < 32:
                np.bitwise_xor(b, c, out=mixed)
                np.bitwise_and(mixed, d, out=mixed)
                np.bitwise_xor(mixed, c, out=mixed)
            elif i < 48:
                np.bitwise_xor(b, c, out=mixed)
                np.bitwise_xor(mixed, d, out=mixed)
            else:
                np.invert(d, out=mixed)
                np.bitwise_or(mixed, b, out=mixed)
                np.bitwise_xor(mixed, c, out=mixed)
            word = words[_WORD[i]]
            np.add(a, mixed, out=a)
            if word.shape[1] == 1:
                np.add(a, word + _ADDED[i], out=a)
            else:
                np.add(a, word, out=a)
                np.add(a, _ADDED[i], out=a)
            np.left_shift(a, _TURNS[i], out=turned)
            np.right_shift(a, 32 - _TURNS[i], out=spare)
            np.bitwise_or(turned, spare, out=turned)
            np.add(turned, b, out=turned)
            a, b, c, d, turned = d, turned, b, c, a
        return (a + _START[0]).byteswap()


def numbered(first: int, last: int, most: int = 16384) -> list[Numbered]:
    """``Numbered`` parts of ``first`` to ``last`` (exclusive), of at most ``most`` numbers each, in order."""
    out = []
    while first < last:
        end = min(last, first + most, 10 ** len(str(first)))
        out.append(Numbered(first, end))
        first = end
    return out
