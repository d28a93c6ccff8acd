"""Slow, plain versions that operators are held against."""

from __future__ import annotations

import re
from collections import Counter

#: A Han or Kana character is a word; any other word is a run of word characters.
_ALONE = "\u3041-\u30ff\u3400-\u9fff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|(?:(?![{_ALONE}])\w)+")


def word_list(text) -> list[str]:
    return [w for w in _WORD.findall((text or "").lower()) if len(w) > 1 or w.isalnum() or w == "_"]


def shingles(text, length: int = 5) -> set:
    """The set of runs of so many words; of all words if there are fewer."""
    found = word_list(text)
    return {tuple(found[i : i + length]) for i in range(max(1, len(found) - length + 1))} if found else set()


def linked_pairs(texts: list, threshold: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of places whose texts are equal or alike to the threshold, from a plain inverted index."""
    sets, index, pairs = [shingles(t) for t in texts], {}, []
    for j, own in enumerate(sets):
        shared = Counter(i for x in own for i in index.get(x, ()))
        pairs += [(i, j) for i, n in shared.items() if n >= threshold * (len(sets[i]) + len(own) - n) - 1e-9]
        pairs += [(i, j) for i in range(j) if not own and not sets[i] and (texts[i] or "") == (texts[j] or "")]
        for x in own:
            index.setdefault(x, []).append(j)
    return pairs


def water_fill(sizes: dict, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, left * weight[s] / total if s in open_ else 0.0) for s in order}
        for s in over:
            capped[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(capped.values())


def connected(pairs) -> dict:
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}
