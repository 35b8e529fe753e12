"""Words of a text: NFKC, without invisible characters, lower case, runs of letters and digits; and hashes of runs of words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Soft hyphen, zero-width space, non-joiner, joiner, byte order mark.
INVISIBLE = re.compile("[\u00ad\u200b-\u200d\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a multiply-xor-shift finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Words -> 64-bit hashes that are the same in every process; keeps a bounded number of words."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def hashes(self, tokens: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for t in tokens:
            h = known.get(t)
            if h is None:
                h = known[t] = xxh3_64_intdigest(t)
            out.append(h)
        return np.array(out, np.uint64)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    return out
