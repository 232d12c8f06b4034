"""Blocks lose no pair within the limit and let few others pass."""

import numpy as np

from arborlight.llm import embedding_dedup as E


def test_candidates_hold_every_link_and_few_others():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x[1000:1500] = x[:500] + rng.normal(size=(500, 64)) * rng.uniform(0, 0.45, size=(500, 1))
    unit = E._unit(x)
    limit = 2 - 2 * 0.93 + 1e-9
    rot = (unit @ E.rotation(64, 11)).astype(np.float32)
    near = E.candidates(rot, rot, E.blocks(64, 8), limit)
    cos = unit @ unit.T
    assert near[cos >= 0.93].all() and (cos >= 0.93).sum() > 1500
    assert near[:1000, :1000].mean() < 0.005  # of pairs without relation, as the share of a block is seldom met


def test_each_pair_is_met_once():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16))
    x[300:] = x[:400] + rng.normal(size=(400, 16)) * 0.05
    unit = E._unit(x)
    rot, spans = (unit @ E.rotation(16, 1)).astype(np.float32), E.blocks(16, 8)
    got = [(int(a), int(b)) for aa, bb in E._pairs(unit, unit, rot, rot, True, spans, 0.14, 0.93) for a, b in zip(aa, bb, strict=True)]
    cos = unit @ unit.T
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(700) for j in range(i + 1, 700) if cos[i, j] >= 0.93}
