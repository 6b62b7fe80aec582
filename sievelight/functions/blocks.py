"""Matching blocks of two texts (A31, E10), with plain searches for substrings instead of a table of all pairs of places."""

from __future__ import annotations


def _longest(x: str, y: str, most: int) -> str:
    """The first in x of the longest substrings of x, up to most characters, that y has too."""
    found = ""
    while len(found) < most:
        k = (len(found) + most + 1) // 2
        grams = {y[p : p + k] for p in range(len(y) - k + 1)}
        hit = next((g for g in (x[p : p + k] for p in range(len(x) - k + 1)) if g in grams), None)
        if hit is None:
            most = k - 1
        else:
            found = hit
    return found


def matched_size(a: str, b: str) -> int:
    """Characters of a in the matching blocks of difflib's SequenceMatcher without junk: the longest common substring, of
    equal ones the first in a and then in b, and so on before and behind it.

    Common substrings have no character that b lacks, so they lie within the runs between those. If b has the longest run
    as a whole, which is the rule where b is an edited a, that is the substring; else its length is found by bisection.
    """
    gone = sorted(set(a) - set(b))
    for c in gone[1:]:
        a = a.replace(c, gone[0])
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        s = max(x.split(gone[0]), key=len) if gone else x
        if s not in y:
            s = _longest(x, y, min(len(s), len(y)))
        n = len(s)
        if n:
            i, j = x.find(s), y.find(s)
            total += n
            if i and j:
                todo.append((x[:i], y[:j]))
            if i + n < len(x) and j + n < len(y):
                todo.append((x[i + n :], y[j + n :]))
    return total
