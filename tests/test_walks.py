"""Walks by plain loops: circles, pages that can't be read, caps, ties, nulls."""

import random

import pytest

from fieldloom.operators import walks


def hunted(start, links, pages, hops, most):
    seen, cur = {start}, start
    if pages.get(start):
        return cur, True, 0
    for n in range(hops):
        targets = {}
        for page, seq, target in links:
            if page == cur and target not in seen:
                targets[target] = min(seq, targets.get(target, seq))
        step = None
        for target in sorted(targets, key=lambda t: (targets[t], t))[:most]:
            seen.add(target)
            if target not in pages:
                continue
            if pages[target]:
                return target, True, n + 1
            step = target if step is None else step
        if step is None:
            return cur, False, n
        cur = step
    return cur, False, hops


@pytest.mark.parametrize("seed", range(2))
def test_hunt(spark, seed):
    rnd = random.Random(seed)
    pages = {i: rnd.random() < 0.05 for i in range(60) if rnd.random() < 0.8}
    links = [(rnd.randrange(60), rnd.randrange(6), rnd.randrange(70)) for _ in range(250)]
    frames = [spark.createDataFrame([(i,) for i in range(60)], "start long"), spark.createDataFrame(links, "page long, seq int, target long"), spark.createDataFrame([(p, w if w else None) for p, w in pages.items()], "page long, wanted boolean")]
    got = {r.start: (r.page, r.found, r.hops) for r in walks.hunt(*frames, hops=3, most=3).collect()}
    assert got == {i: hunted(i, links, pages, 3, 3) for i in range(60)}
    assert any(f and h > 1 for _, f, h in got.values())


def test_follow(spark):
    pointers = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (7, 8), (8, 7), (9, 9), (10, 12), (10, 11), (13, None)]
    starts = spark.createDataFrame([(i,) for i in [*range(1, 15), None]], "start long")
    got = {r.start: (r.page, r.hops) for r in walks.follow(starts, spark.createDataFrame(pointers, "page long, target long"), 4).collect()}
    assert got[1] == (5, 4) and got[4] == (6, 2) and got[7] == (7, 4) and got[9] == (9, 4) and got[10] == (11, 1)
    assert got[13] == (13, 0) and got[14] == (14, 0) and got[None] == (None, 0)
