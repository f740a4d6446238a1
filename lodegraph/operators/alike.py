"""Which text of a block is most like another one: ratios are told by counts of letters first, and remembered by the worker."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Texts of either side that a worker remembers pairs of: at most 16 MB of a byte each.
REMEMBER = 4096
#: Counters that letters share; a pair that is not compared yet (no pair has more than 200 characters in common).
PLACES, UNKNOWN = 64, 255


def _counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") % PLACES
    return np.bincount(codes, minlength=PLACES).astype(np.uint8)


def matched(a: str, b: str) -> int:
    """How many characters ``SequenceMatcher`` matches: those of the longest common block, the first of equals in ``a`` and then in ``b``,
    and those of the parts before and behind it."""
    if len(b) >= 200:  # there it leaves out frequent characters
        return sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        at = i = k = 0
        while i + k < len(a):
            if a[i : i + k + 1] in b:
                at, k = i, k + 1
            else:
                i += 1
        if k:
            j = b.find(a[at : at + k])
            total += k
            todo += [x for x in ((a[:at], b[:j]), (a[at + k :], b[j + k :])) if x[0] and x[1]]
    return total


class Memo:
    """How many characters of two texts match, as ``SequenceMatcher`` counts them in the first 200 of each, for pairs met so far."""

    def __init__(self) -> None:
        self.rows, self.columns = {}, {}
        self.matches = np.full((REMEMBER, REMEMBER), UNKNOWN, np.uint8)
        self.texts, self.sizes, self.counts = [""] * REMEMBER, np.zeros(REMEMBER, np.int64), np.zeros((REMEMBER, PLACES), np.uint8)

    def places(self, texts: list[str]) -> np.ndarray:
        """The columns of a block's texts, ``REMEMBER`` at most; what was given before may be forgotten."""
        new = dict.fromkeys(texts).keys() - self.columns.keys()
        if len(self.columns) + len(new) > REMEMBER:
            self.columns, new = {}, set(texts)
            self.matches.fill(UNKNOWN)
        for t in new:
            at = self.columns[t] = len(self.columns)
            self.texts[at], self.sizes[at], self.counts[at] = t, len(t), _counts(t)
        return np.array([self.columns[t] for t in texts], np.int64)

    def row(self, text: str) -> int:
        if text not in self.rows and len(self.rows) == REMEMBER:
            self.rows = {}
            self.matches.fill(UNKNOWN)
        return self.rows.setdefault(text, len(self.rows))


_memo: Memo | None = None


class Block:
    """Texts in the order in which equals are chosen; ``best`` finds the first that scores most for another text."""

    def __init__(self, texts: list[str | None]) -> None:
        global _memo
        _memo = _memo or Memo()
        texts = [(t or "")[:200] for t in texts]
        self.at = _memo.places(texts)
        self.sizes, self.counts = _memo.sizes[self.at], _memo.counts[self.at]

    def _match(self, text: str, row: int, column: int) -> int:
        if _memo.matches[row, column] == UNKNOWN:
            _memo.matches[row, column] = matched(text, _memo.texts[column])
        return int(_memo.matches[row, column])

    def best(self, text: str | None, least: float, score, free: np.ndarray | None = None) -> tuple[int, float] | None:
        """(place, score) of the first of the texts that score most, if that is ``least`` at least; of those that are ``free``.

        ``score`` makes scores of ratios and the places they are of, and never falls where a ratio rises. Pairs are compared in the order
        of what they can score, until that is less than what one has.
        """
        text = (text or "")[:200]
        row, both = _memo.row(text), np.maximum(self.sizes + len(text), 1)
        known = _memo.matches[row, self.at].astype(np.int64)
        new = known == UNKNOWN
        most = score(2.0 * np.where(new, np.minimum(self.counts, _counts(text)).sum(1), known) / both, slice(None))
        if free is not None:
            most = np.where(free, most, -1.0)
        held = np.where(new, -1.0, most)
        top = max(least, held.max(initial=-1.0))
        rest = np.flatnonzero(new & (most >= top))
        for k in rest[np.argsort(-most[rest], kind="stable")]:
            if most[k] < top:
                break
            held[k] = score(2.0 * self._match(text, row, int(self.at[k])) / both[k], k)
            top = max(top, held[k])
        k = int(held.argmax()) if len(held) else 0
        return (k, float(held[k])) if len(held) and held[k] >= least else None
