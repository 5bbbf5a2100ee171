"""Word shingles of whole texts as 64-bit numbers, for many texts at once."""

from __future__ import annotations

#: Bytes hashed in one go. A cut falls between words only.
PIECE = 1 << 18
#: Odd multipliers that mix bits.
_A, _B, _C, _D = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9


def mix(h):
    """Spreads what differs in any bit over all bits; changes ``h`` in place."""
    import numpy as np

    for shift, factor in ((30, _D), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


class Shingler:
    """Words are runs of bytes other than ASCII white space, with A-Z in lower case."""

    def __init__(self, size: int = 3):
        import numpy as np

        self.np, self.size = np, size
        self.space = np.zeros(256, dtype=bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_A))
        self.powers(PIECE + 1)

    def powers(self, n: int) -> None:
        np = self.np
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B, dtype=np.uint64)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(_B, -1, 1 << 64), dtype=np.uint64)]))

    def words(self, raw: bytes):
        """Start and hash of each word."""
        np = self.np
        starts, hashes, at = [], [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            if end < len(raw):
                cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut > at:
                    end = cut
                else:  # one endless word: up to where it ends
                    later = [raw.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
                    end = min([i for i in later if i >= 0], default=len(raw))
                    if end - at >= len(self.up):
                        self.powers(end - at + 1)
            b = np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at)
            edge = np.diff(np.concatenate([[True], self.space[b], [True]]).astype(np.int8))
            first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            total = np.concatenate([[np.uint64(0)], np.cumsum(self.values[b] * self.up[: len(b)])])
            starts.append(first + at)
            hashes.append(mix((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64)))
            at = end
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def sets(self, texts: list[str | None]) -> list:
        """For each text its sorted distinct shingles. Fewer words than a shingle has: all of them as one; none: nothing."""
        np, size = self.np, self.size
        raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        starts, h = self.words(b"\n".join(raws))
        bounds = np.searchsorted(starts, offsets)
        # Shingles of all texts in one row; those that reach over the end of a text are left out below.
        n = max(0, len(h) - size + 1)
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            whole += h[j : j + n] * np.uint64((_A + 2 * j * _C) % (1 << 64))
        mix(whole)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(whole[a : b - size + 1]))
            elif b > a:
                short = np.array([b - a], dtype=np.uint64) * np.uint64(_C)
                for j in range(b - a):
                    short = short + h[a + j : a + j + 1] * np.uint64((_A + 2 * j * _C) % (1 << 64))
                out.append(mix(short))
            else:
                out.append(whole[:0])
        return out
