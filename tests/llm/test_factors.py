"""Factors of the relative parse are the longest ones that any source gives."""

import random

import numpy as np
import pytest

from corpusloom.llm.rlz import LEFT, WINDOW, Block


def level(stretches):
    """(words, words before the anchor) of stretches as a part receives them; each is a document that starts at word 0."""
    texts = [" ".join(w).encode() + b" " for w, _ in stretches]
    n = len(texts)
    return {
        "data": np.frombuffer(b"".join(texts), np.uint8), "bytes": np.array([len(t) for t in texts], np.uint32), "lead": np.array([k for _, k in stretches], np.uint16),
        "doc": np.arange(n, dtype=np.int64), "start": np.zeros(n, np.int64), "many": np.zeros(n, np.uint8),
    }


def agreement(a, b, x):
    """Words that two stretches agree on from x words before their anchors on."""
    (u, i), (v, j) = a, b
    n = 0
    while i - x + n < len(u) and j - x + n < len(v) and u[i - x + n] == v[j - x + n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_factors_are_the_longest(seed):
    r = random.Random(seed)
    base = [f"w{k}" for k in range(LEFT + WINDOW)]
    stretches = []
    for _ in range(r.choice((2, 14, 60))):
        lead = r.randint(20, LEFT)
        words = base[LEFT - lead : LEFT + r.randint(20, WINDOW)]
        for _ in range(r.randint(0, 2)):  # agree with others up to some word
            k = r.randrange(len(words))
            if abs(k - lead) > 5:
                words = words[:k] + [f"x{r.randint(0, 3)}"] + words[k + 1 :]
        stretches.append((words, lead))
    found = 0
    for docs, start, length in Block([level(stretches)]).factors():
        for d, at, n in zip(docs.tolist(), start.tolist(), length.tolist(), strict=True):
            x = stretches[d][1] - at
            best = max(agreement(stretches[d], o, x) for k, o in enumerate(stretches) if k != d and o[1] >= x)
            assert n == best >= WINDOW
            found += 1
    assert found or seed
