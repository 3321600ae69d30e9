"""Byte signatures in bodies: an index of short pieces finds where one may be, all its bytes decide."""

from __future__ import annotations

import numpy as np

#: Bytes of a piece at most, and of a body that are looked through at once.
PIECE, SEGMENT = 4, 1 << 20


def _anchor(mask: bytes, value: bytes) -> tuple[int, int]:
    """(place, width) of the piece that a signature is found by: whole bytes in a row, not all alike if that can be; width 0 without any."""
    best = (0, False, 0, 0)
    for at in range(len(mask)):
        width = next((k for k in range(min(PIECE, len(mask) - at)) if mask[at + k] != 255), min(PIECE, len(mask) - at))
        best = max(best, (width, len(set(value[at : at + width])) > 1, -at, at))
    return best[3], best[0]


class Signatures:
    """(name, value, mask) of many signatures; a byte fits where it agrees with the value in the bits of the mask."""

    def __init__(self, rows):
        self.rows, by_width = [], {}
        for name, value, mask in rows:
            if not value:
                continue
            mask = (mask or b"\xff" * len(value))[: len(value)].ljust(len(value), b"\xff")
            at, width = _anchor(mask, value)
            by_width.setdefault(width, []).append((int.from_bytes(value[at : at + width], "little"), len(self.rows), at))
            masks = np.frombuffer(mask, np.uint8)
            self.rows.append((name, np.frombuffer(value, np.uint8) & masks, masks))
        self.widths = []
        for width, pieces in sorted(by_width.items()):
            pieces.sort()
            keys = np.array([p[0] for p in pieces], np.uint32)
            self.widths.append((width, keys, np.array([p[1] for p in pieces]), np.array([p[2] for p in pieces])))

    def places(self, body: bytes):
        """(number of the signature, start) of every place where one fits, overlapping ones too."""
        data = np.frombuffer(body, np.uint8)
        for begin in range(0, len(data), SEGMENT):
            for width, keys, owners, shifts in self.widths:
                part = data[begin : begin + SEGMENT + max(width, 1) - 1]
                count = len(part) - max(width, 1) + 1
                if count <= 0:
                    continue
                windows = np.zeros(count, np.uint32)
                for k in range(width):
                    windows |= part[k : k + count].astype(np.uint32) << np.uint32(8 * k)
                first, last = np.searchsorted(keys, windows), np.searchsorted(keys, windows, "right")
                hit = np.nonzero(last > first)[0]
                copies = (last - first)[hit]
                spot = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                entry = np.repeat(first[hit], copies) + spot
                owner, start = owners[entry], begin + np.repeat(hit, copies) - shifts[entry]
                order = np.argsort(owner, kind="stable")
                owner, start = owner[order], start[order]
                cuts = np.nonzero(np.diff(owner))[0] + 1
                for group, starts in zip(np.split(owner, cuts), np.split(start, cuts)):
                    if len(group):
                        yield group[0], self._fitting(data, starts, *self.rows[group[0]][1:])

    @staticmethod
    def _fitting(data, starts, value, mask):
        starts = starts[(starts >= 0) & (starts + len(value) <= len(data))]
        for k in range(len(value)):
            starts = starts[(data[starts + k] & mask[k]) == value[k]]
        return starts

    def occurrences(self, body: bytes):
        """(name, offset) of every occurrence from the left, those of one signature not overlapping."""
        found: dict = {}
        for owner, starts in self.places(body):
            found.setdefault(owner, []).append(starts)
        for owner, parts in sorted(found.items()):
            name, value, _ = self.rows[owner]
            end = 0
            for start in np.concatenate(parts).tolist():
                if start >= end:
                    end = start + len(value)
                    yield name, start
