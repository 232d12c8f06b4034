"""Apportionment against the highest quotients in exact fractions, ties and hard cases included."""

import random
from fractions import Fraction

from arborlight.llm import mixing


def by_quotients(votes, seats):
    won, live = [0] * len(votes), [k for k, v in enumerate(votes) if v and v > 0]
    for _ in range(seats if live else 0):
        k = max(live, key=lambda k: (Fraction(votes[k], 2 * won[k] + 1), -k))
        won[k] += 1
    return won


def test_ties_and_hard_cases(spark):
    rng = random.Random(3)
    cases = [([7, 1, 7, 1], 167), ([1, 65, 5, 20, 1, 2, 1, 15, 3, 1, 5, 1, 1, 1], 62), ([0, None, 0], 5), ([5], 0), ([10**15, 1, 10**15 + 1], 301), ([3, 3, 3], 7), ([-1, 4], 3)]
    cases += [([rng.choice([0, 1, 1, 2, 3, 5, 5, 15, 20, 65, 1000]) for _ in range(rng.randint(1, 14))], rng.randint(0, 120)) for _ in range(500)]
    rows = [(g, k, v, n) for g, (votes, n) in enumerate(cases) for k, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, k int, v long, n long")
    got: dict = {}
    for r in mixing._apportion(df, df["v"], df["n"], ["g"], "k").collect():
        got.setdefault(r.g, {})[r.k] = r.seats
    for g, (votes, n) in enumerate(cases):
        assert [got[g][k] for k in range(len(votes))] == by_quotients(votes, n), (votes, n)


def test_null_keys_come_last_and_null_groups_count(spark):
    df = spark.createDataFrame([(None, "a", 1, 1), (None, None, 1, 1), ("x", None, 2, 3), ("x", "b", 2, 3)], "g string, k string, v long, n long")
    got = {(r.g, r.k): r.seats for r in mixing._apportion(df, df["v"], df["n"], ["g"], "k").collect()}
    assert got == {(None, "a"): 1, (None, None): 0, ("x", None): 1, ("x", "b"): 2}


def test_votes_are_the_targets_in_whole_numbers(spark):
    df = spark.createDataFrame([("a", 10, 1), ("b", 1001, 2), ("c", 50, 3), ("d", 0, 1)], "source string, source_size long, weight int")
    got = mixing.targets(df).collect()
    whole, all_ = sum(r.votes for r in got), sum(r.target for r in got)
    assert all(abs(r.target - r.votes * all_ / whole) < 1e-9 * all_ for r in got) and abs(all_ - 1061) < 1e-6
