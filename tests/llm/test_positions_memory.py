import numpy as np

from tokenloom.llm import phrases as P


def test_positions_take_32_bits_and_sums_go_round():
    rng = np.random.default_rng(1)
    key, at = rng.integers(0, 4000, 50_000), np.sort(rng.choice(30_000_000, 50_000, replace=False))
    distinct, lengths, steps = P._lists(key, at)
    which, position = P._positions(lengths, steps)
    order = np.argsort(key, kind="stable")
    assert P._unpacked(steps).sum(dtype=np.int64) > 1 << 32
    assert (distinct[which] == key[order]).all() and (position == at[order]).all()
    assert which.itemsize == position.itemsize == 4
