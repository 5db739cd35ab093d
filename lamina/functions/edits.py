"""Edit distances by bit vectors."""

from __future__ import annotations

from collections.abc import Iterator


class Myers:
    """Least edit distance of a pattern to a substring of a text. The columns
    of the dynamic programme are bit vectors; Python's integers have any width."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distances(self, text: str, anchored: bool = False) -> Iterator[int]:
        """Least distance to any substring that ends at each place in turn, or to
        the whole text so far if ``anchored``."""
        full, top = (1 << self.length) - 1, 1 << self.length - 1
        up, down, score = full, 0, self.length
        for c in text:
            eq = self.masks.get(c, 0)
            vertical = eq | down
            diagonal = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1 | anchored) & full  # a match may begin anywhere: no cost enters from above
            minus = (minus << 1) & full
            up = minus | (full & ~(vertical | plus))
            down = plus & vertical
            yield score

    def distance(self, text: str) -> int:
        score = self.length
        for score in self.distances(text, anchored=True):
            pass
        return score


def near(a: str, b: str) -> bool:
    """Whether the least Levenshtein distance of the shorter to a window of its length in
    the longer is under a quarter of that length.

    No window that ends at a place is nearer than the nearest substring that ends
    there, and a window's distance changes by two at most from one place to the next:
    so few windows are compared themselves."""
    short, long_ = sorted((a, b), key=len)
    n, pattern, wait = len(short), Myers(short), 0
    for end, least in enumerate(pattern.distances(long_), 1):
        if end >= n and end >= wait and 4 * least < n:
            own = pattern.distance(long_[end - n : end])
            if 4 * own < n:
                return True
            wait = end + (4 * own - n) // 8 + 1
    return False


def nearest(reference: str, text: str) -> tuple[str, int] | None:
    """The window of the reference's length in ``text`` with the least Levenshtein distance,
    the first of equals, and the distance; None if the text is shorter.

    Only windows whose end has a nearer substring than the best so far are compared, and
    none that a distance change of two a place can't have brought under it."""
    n = len(reference)
    if n > len(text):
        return None
    if not n:
        return "", 0
    pattern = Myers(reference)
    best, at, wait = pattern.distance(text[:n]), n, n + 1
    for end, least in enumerate(pattern.distances(text), 1):
        if end >= wait and least < best:
            own = pattern.distance(text[end - n : end])
            if own < best:
                best, at = own, end
            wait = end + (own - best) // 2 + 1
    return text[at - n : at], best
