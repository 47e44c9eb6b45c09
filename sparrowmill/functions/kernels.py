"""Text metrics of one pair of texts, for use inside Arrow tasks."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np


def ngrams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[k:] for k in range(n)), strict=False))


def bleu4(hypothesis: str, reference: str) -> float:
    h, r = hypothesis.split(), reference.split()
    logs = 0.0
    for n in range(1, 5):
        mine = ngrams(h, n)
        hit = sum((mine & ngrams(r, n)).values())
        if not hit:
            return 0.0
        logs += math.log(hit / sum(mine.values()))
    return min(1.0, math.exp(1 - len(r) / len(h))) * math.exp(logs / 4)


def rouge_n(hypothesis: str, reference: str, n: int) -> float:
    h, r = ngrams(hypothesis.split(), n), ngrams(reference.split(), n)
    hit = sum((h & r).values())
    return 2 * hit / (sum(h.values()) + sum(r.values())) if hit else 0.0


def common_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by rows of running maxima."""
    codes: dict[str, int] = {}
    y = np.array([codes.setdefault(w, len(codes)) for w in b], np.int64)
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        step = np.where(y == codes.get(w, -1), row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], step))
    return int(row[-1])


def rouge_l(hypothesis: str, reference: str) -> float:
    h, r = hypothesis.split(), reference.split()
    n = common_length(h, r) if h and r else 0
    return 2 * n / (len(h) + len(r)) if n else 0.0
