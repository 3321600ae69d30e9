"""Pieces of texts as 64-bit hashes: all places of a batch of texts at once, and the bit set that lets few of them by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a piece: a literal is found by pieces of the greatest width that is not above its own length.
WIDTHS = (16, 8, 4, 2, 1)
#: Bytes of text that are looked through at once.
SEGMENT = 1 << 18
#: Bits that a piece sets in a bit set, taken from its hash at these shifts.
SHIFTS = (0, 12, 25, 37)

MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins; the end of the last one closes the list."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), bounds


def _words(data: np.ndarray) -> np.ndarray:
    """From every place eight bytes as one number, with zeros past the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data), np.uint64)
    for k in range(min(8, len(data))):
        out[k::8] = np.frombuffer(padded, "<u8", len(out[k::8]), k)
    return out


def _hashes(words: np.ndarray, later: np.ndarray | None, width: int) -> np.ndarray:
    """Hashes of the pieces whose first eight bytes are in `words` and, of those of 16 bytes, the others in `later`."""
    if width < 8:
        x = words & np.uint64((1 << 8 * width) - 1)
    else:
        x = words.copy() if later is None else (words * MIX[0]) ^ later
    x += np.uint64(width)
    for m in MIX[1:]:
        x ^= x >> np.uint64(31)
        x *= m
    x ^= x >> np.uint64(32)
    return x


def literal_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(number of the literal, width, hash)` of pieces side by side that cover each literal; the last one may overlap the one before."""
    sizes, parts = np.diff(bounds), []
    for width, above in zip(WIDTHS, (np.inf, *WIDTHS)):
        mine = np.nonzero((sizes >= width) & (sizes < above))[0]
        counts = -(-sizes[mine] // width)
        rows = np.repeat(mine, counts)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = bounds[rows] + np.minimum(nth * width, sizes[rows] - width)
        cut = np.zeros((len(rows), max(width, 8)), np.uint8)
        cut[:, :width] = data[at[:, None] + np.arange(width)]
        words = cut.view("<u8")
        parts.append((rows, np.full(len(rows), width), _hashes(words[:, 0], words[:, 1] if width > 8 else None, width)))
    return tuple(np.concatenate(p) for p in zip(*parts))


def held_pieces(data: np.ndarray, bounds: np.ndarray, widths: list[int], bits: np.ndarray):
    """Batches of `(number of the text, hash)` of the pieces that the bit set lets by, each once per text and segment."""
    first, last = int(bounds[0]), int(bounds[-1])
    for begin in range(first, last, SEGMENT):
        words = _words(data[begin : min(last, begin + SEGMENT + max(widths) - 1)])
        for width in widths:
            count = min(len(words) - width + 1, SEGMENT)
            if count <= 0:
                continue
            found = _hashes(words[:count], words[8 : 8 + count] if width > 8 else None, width)
            at = np.nonzero(_is_set(bits, found, SHIFTS[0]))[0]
            for shift in SHIFTS[1:]:
                at = at[_is_set(bits, found[at], shift)]
            row = np.searchsorted(bounds, at + begin, "right") - 1
            inside = at + begin + width <= bounds[row + 1]
            row, piece = row[inside], found[at[inside]]
            order = np.lexsort((piece, row))
            row, piece = row[order], piece[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
            if len(row):
                yield row[new], piece[new]


def places(hashes, n_bits: int, shift: int):
    """The bits that pieces set, of a power of two of them."""
    return (hashes >> np.uint64(shift)) & np.uint64(n_bits - 1)


def _is_set(bits: np.ndarray, hashes: np.ndarray, shift: int) -> np.ndarray:
    at = places(hashes, len(bits) * 8, shift)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


class PieceIndex:
    """Numbers of literals by the piece that each is found by, held by a task that looks through texts."""

    def __init__(self, pieces: np.ndarray, numbers: np.ndarray, widths: list[int], n_bits: int):
        order = np.argsort(pieces, kind="stable")
        self.pieces, self.first = np.unique(pieces[order], return_index=True)
        self.counts = np.diff(np.append(self.first, len(order)))
        self.numbers, self.widths = numbers[order], widths
        self.bits = np.zeros(n_bits // 8, np.uint8)
        for shift in SHIFTS:
            at = places(self.pieces, n_bits, shift)
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def held(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`(number of the text, number of the literal)` where the text has the literal's piece; a pair may come twice."""
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, piece in held_pieces(*flat(column), self.widths, self.bits):
            at = np.minimum(np.searchsorted(self.pieces, piece), len(self.pieces) - 1)
            same = self.pieces[at] == piece
            row, at = row[same], at[same]
            n = self.counts[at]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows.append(np.repeat(row, n))
            numbers.append(self.numbers[np.repeat(self.first[at], n) + nth])
        return np.concatenate(rows), np.concatenate(numbers)
