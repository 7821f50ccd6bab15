"""Word shingles of whole texts as 64-bit hashes, worked out for many texts at once in numpy.

Words are runs of bytes outside {0x20, 0x09-0x0D}, with A-Z lower-cased; no other character changes. White space and
A-Z are single bytes in UTF-8, so bytes and characters give the same words.
"""

from __future__ import annotations

WORDS = 5
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64

_tables: dict = {}


def _mixed(x):
    """A bijection of 64-bit values that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    """Powers of the base and of its inverse, kept for the largest n so far."""
    import numpy as np

    if "up" not in _tables or len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            out = np.empty(n, np.uint64)
            out[0] = 1
            have = 1
            while have < n:
                step = np.uint64(pow(base, have, 2**64))
                more = min(have, n - have)
                out[have : have + more] = out[:more] * step
                have += more
            _tables[name] = out
    if "byte" not in _tables:
        codes = np.arange(256, dtype=np.uint64)
        lower = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
        _tables["byte"] = _mixed(lower * np.uint64(_MUL[0]) + np.uint64(1))
        gap = np.zeros(256, bool)
        gap[[0x20, *range(0x09, 0x0E)]] = True
        _tables["gap"] = gap
    return _tables["up"], _tables["down"], _tables["byte"], _tables["gap"]


def word_hashes(data, ends):
    """`data`: bytes of texts, each followed by one blank; `ends`: where each text's blank stands.

    Gives the words' hashes in order and, for each text, the number of the first word after it."""
    import numpy as np

    up, down, byte, gap = _powers(len(data) + 1)
    blank = gap[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
    hashes = _mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(_MUL[1]))
    return hashes, np.searchsorted(starts, ends)


def joined(column):
    """Bytes of an Arrow string column (nulls empty), one blank after each, and where the blanks stand."""
    import numpy as np
    import pyarrow as pa

    values = column.cast(pa.large_binary()).to_pylist()
    parts = [v or b"" for v in values]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return data, np.cumsum(sizes + 1) - 1


def shingle_sets(column, words: int = WORDS):
    """For each text of an Arrow column the sorted distinct 64-bit hashes of its shingles.

    A text with fewer words, but one at least, has its whole sequence as its only shingle."""
    import numpy as np

    data, ends = joined(column)
    hashes, upto = word_hashes(data, ends)
    n = len(hashes)
    if n >= words:
        rolled = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            rolled += _mixed(hashes[k : n - words + 1 + k] + np.uint64(_MUL[k % 5])) * np.uint64(_MUL[k % 5] | 1)
        rolled = _mixed(rolled)
    out, first = [], 0
    for last in upto.tolist():
        count = last - first
        if count >= words:
            out.append(np.unique(rolled[first : last - words + 1]))
        elif count:
            total = np.uint64(count)
            for h in hashes[first:last]:
                total = _mixed(np.array([total * np.uint64(_MUL[2]) + h], np.uint64))[0]
            out.append(np.array([total], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        first = last
    return out
