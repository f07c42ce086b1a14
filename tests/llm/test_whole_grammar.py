"""Re-Pair goes on until no pair of a block is frequent."""

import numpy as np
import pytest

from tidemark.llm import repair


def frequent(seq, end, least):
    """Pairs that occur least times without overlap, counted one by one."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True)):
        if end not in pair and last.get(pair, -2) < i - 1:
            counts[pair], last[pair] = counts.get(pair, 0) + 1, i
    return {p for p, n in counts.items() if n >= least}


def blocks():
    rng = np.random.default_rng(4)
    yield "copies", np.tile(np.r_[rng.integers(3, 40_000, 999), 2], 300)
    yield "ascending copies", np.tile(np.r_[np.arange(3, 1002), 2], 300)
    yield "prefixes", np.concatenate([np.r_[np.arange(3, 3 + k), 2] for k in range(1, 400)])
    yield "one id", np.r_[np.full(5000, 7), 2]
    yield "skewed", np.r_[np.minimum(rng.zipf(1.3, 60_000) + 2, 5000), 2]
    yield "large ids", np.tile(np.r_[rng.integers(3, 1 << 31, 40), 2], 50)
    yield "short", np.array([2])


@pytest.mark.parametrize("name,ids", list(blocks()))
def test_no_frequent_pair_is_left(name, ids):
    ids = ids.astype("<u4")
    _, rules, seq = repair.compress(ids, 2)
    assert not frequent(seq, 2, repair.LEAST)
    assert not (rules == 2).any()
    sizes = np.diff(np.r_[-1, np.flatnonzero(ids == 2)])
    assert (repair.Block(repair.pack(ids, sizes, 2)).all_ids() == ids).all()


def test_copies_become_one_nonterminal():
    ids = np.tile(np.r_[np.random.default_rng(5).integers(3, 40_000, 1000), 2], 1000).astype("<u4")
    _, _, seq = repair.compress(ids, 2)
    assert len(seq) == 2 * 1000
