"""Raw deflate with every free choice fixed, so that equal parts are compressed to equal bytes anywhere.

The stream is blocks of fixed Huffman codes (RFC 1951), each begun once ``BLOCK`` bytes or more of input
have gone into the one before, and an empty last block.  A match is looked for among the latest
``LINKS`` positions whose second and third byte agree in their low ``KEY_BITS`` bits, at less than
``WINDOW`` bytes back; the longest counts, of equal ones the nearest, and is taken at once.
"""

from __future__ import annotations

from collections import defaultdict

WINDOW, BLOCK, LINKS, KEY_BITS, SHORTEST, LONGEST = 1 << 15, 1 << 16, 128, 15, 3, 258
_END_OF_BLOCK = 256


def _turned(code: int, bits: int) -> int:
    """A code's bits in the order they are written, first bit lowest."""
    return int(f"{code:0{bits}b}"[::-1], 2)


def _symbol(n: int) -> tuple[int, int]:
    """The fixed code of a literal, end or length symbol, turned, and its bits."""
    for least, first, bits in ((280, 0b11000000, 8), (256, 0, 7), (144, 0b110010000, 9), (0, 0b00110000, 8)):
        if n >= least:
            return _turned(first + n - least, bits), bits
    raise ValueError(n)


def _steps(first: int, plain: int, each: int, stop: int) -> list[tuple[int, int]]:
    """(base, extra bits) of codes: ``plain`` ones without extra bits, then ``each`` for every number of them."""
    out, base, extra = [], first, 0
    while base <= stop:
        for _ in range(each if extra else plain):
            out.append((base, extra))
            base += 1 << extra
        extra += 1
    return out


_SYMBOLS = [_symbol(n) for n in range(288)]
# Lengths 3 to 257 by rule and 258 alone; distances 1 to 32768.
_LENGTHS = [*_steps(3, 8, 4, 257)[:28], (LONGEST, 0)]
_DISTANCES = _steps(1, 4, 2, WINDOW)
_OF_LENGTH = {n: max(i for i, (base, _) in enumerate(_LENGTHS) if base <= n) for n in range(SHORTEST, LONGEST + 1)}


class _Stream:
    """Bits, written from the lowest of a byte on."""

    def __init__(self):
        self.done, self.held, self.width = bytearray(), 0, 0

    def put(self, value: int, width: int) -> None:
        self.held |= value << self.width
        self.width += width
        if self.width >= 512:
            whole = self.width >> 3
            self.done += (self.held & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.held >>= 8 * whole
            self.width -= 8 * whole

    def symbol(self, n: int) -> None:
        self.put(*_SYMBOLS[n])

    def close(self) -> bytes:
        return bytes(self.done + self.held.to_bytes(-(-self.width // 8), "little"))


def _alike(data: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from two places on are equal, ``most`` at most."""
    if data[a : a + most] == data[b : b + most]:
        return most
    low, high = 0, most  # equal up to low, not up to high
    while high - low > 1:
        middle = (low + high) // 2
        if data[a + low : a + middle] == data[b + low : b + middle]:
            low = middle
        else:
            high = middle
    return low


def _best_match(data: bytes, at: int, earlier: list[int]) -> tuple[int, int]:
    """Length and distance of the match to take; ``earlier`` are the places of its key in order."""
    most, length, distance = min(LONGEST, len(data) - at), 0, 0
    for place in reversed(earlier[-LINKS:]):
        if place <= at - WINDOW or length == most:
            break
        if data[place + length] == data[at + length] and (found := _alike(data, place, at, most)) > length:
            length, distance = found, at - place
    return length, distance


def deflate(data: bytes) -> bytes:
    """``data`` as a raw deflate stream."""
    out, places = _Stream(), defaultdict(list)
    mask, at, begun = (1 << KEY_BITS) - 1, 0, 0
    keys = [(data[i + 1] << 8 | data[i + 2]) & mask for i in range(len(data) - 2)]
    if data:
        out.put(0b010, 3)  # not the last block; fixed codes
    while at < len(data):
        if at - begun >= BLOCK:
            out.symbol(_END_OF_BLOCK)
            out.put(0b010, 3)
            begun = at
        length, distance = _best_match(data, at, places[keys[at]]) if at < len(keys) else (0, 0)
        if length >= SHORTEST:
            code = _OF_LENGTH[length]
            out.symbol(257 + code)
            out.put(length - _LENGTHS[code][0], _LENGTHS[code][1])
            code = max(i for i, (base, _) in enumerate(_DISTANCES) if base <= distance)
            out.put(_turned(code, 5), 5)
            out.put(distance - _DISTANCES[code][0], _DISTANCES[code][1])
        else:
            length = 1
            out.symbol(data[at])
        for i in range(at, min(at + length, len(keys))):
            places[keys[i]].append(i)
        at += length
    if data:
        out.symbol(_END_OF_BLOCK)
    out.put(0b011, 3)
    out.symbol(_END_OF_BLOCK)
    return out.close()
