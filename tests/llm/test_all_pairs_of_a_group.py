"""Similar windows in one group beyond the nearest neighbours of the two orders, against all pairs."""

import numpy as np

from parcelspark.llm import near_passages as N
from parcelspark.llm.common import powers
from parcelspark.llm.suffixes import Extensions, covered_lengths, merge_sorted
from parcelspark.llm.words import BYTE_BASE

SIZE = 46


def _contexts(rng, preamble, n):
    """Word rows around one anchor: a common preamble, random words, and copies of other rows with one or two other words."""
    made = []
    for _ in range(n):
        if made and rng.random() < 0.4:
            words = made[rng.integers(len(made))].copy()
            words[rng.integers(0, len(words), rng.integers(1, 3))] = rng.integers(1, 1 << 62)
        else:
            left, cut = preamble.copy(), rng.integers(0, 45)
            left[:cut] = rng.integers(1, 1 << 62, cut)
            words = np.r_[left, rng.integers(1, 1 << 62, 50)]
        words[45:50] = np.arange(7, 12)
        made.append(words)
    return made


def _links(node, pairs):
    a, b = np.array(sorted(pairs)).reshape(-1, 2).T
    return N._joined(np.arange(node.max() + 1), node[a], node[b]).tolist()


def test_group_finds_the_windows_and_classes_of_all_pairs():
    rng = np.random.default_rng(1)
    preamble = rng.integers(1, 1 << 62, 45)
    sizes = [3, 60, 9, 150]
    words = [w for n in sizes for w in _contexts(rng, preamble, n)]
    owner = np.concatenate([rng.integers(0, n, n) for n in sizes])
    groups = np.repeat(np.arange(len(sizes)), sizes)
    tokens = [N.window_hashes(w.astype(np.uint64), 5) for w in words]
    data, lengths = np.concatenate(tokens), np.array([len(t) for t in tokens])
    before = np.full(len(words), 45)
    anchor, after = np.cumsum(lengths) - lengths + before, np.minimum(lengths - before, SIZE)
    up_down = powers(BYTE_BASE, len(data) + 10)
    at = np.cumsum(sizes) - sizes
    start_of, size_of = np.repeat(at, sizes), np.repeat(sizes, sizes)
    orders = [
        merge_sorted(Extensions(data, up_down), anchor, after, start_of, size_of)[0],
        merge_sorted(Extensions(data[::-1].copy(), up_down), len(data) - anchor, before, start_of, size_of)[0]]
    exact = covered_lengths(data, anchor, before, after, groups, SIZE, up_down, owner)
    found = N.similar_neighbours(data, anchor, before, after, groups, orders, SIZE, 0.8, owner, exact)
    least, most, partner = found[:3]

    similar = N.Similar(data, anchor, before, after, SIZE, 0.8)
    want_least, want_most, pairs = np.full(len(words), SIZE), np.full(len(words), -1), set()
    for i in range(len(words)):
        others = np.flatnonzero((groups == groups[i]) & (owner != owner[i]))
        a, b, low, high = similar.hits(np.full(len(others), i), others)
        pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
        want_least[i], want_most[i] = low.min(initial=SIZE), high.max(initial=-1)
    got_most = np.maximum(most, exact[1])
    got_least = np.minimum(np.where(most < 0, SIZE, least), np.where(exact[1] < 0, SIZE, exact[0]))
    assert got_most.tolist() == want_most.tolist() and got_least.tolist() == want_least.tolist()
    node = np.unique(np.rec.fromarrays([groups, owner]), return_inverse=True)[1]
    mine = {(i, int(j)) for with_ in (exact[2], partner) for i, j in enumerate(with_) if j >= 0}
    if len(found) > 3:
        mine |= set(zip(found[3][0].tolist(), found[3][3].tolist(), strict=True))
    assert mine <= pairs
    assert _links(node, mine) == _links(node, pairs)
