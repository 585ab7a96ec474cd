"""Components of links, few in one task, many in rounds, against a search."""

import random

import pytest


@pytest.mark.parametrize("one_task", [True, False])
def test_components_of_few_and_of_many_links(spark, monkeypatch, one_task):
    from regiolith.llm import components as c

    if not one_task:
        monkeypatch.setattr(c, "ONE_TASK", 0)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100 - i, 101 - i) for i in range(0, 30, 2)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(2**62, -5)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [] if v in want else [v]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = v
                todo += near[x]
    jobs = []
    was = c.cut
    monkeypatch.setattr(c, "cut", lambda df: jobs.append(1) or was(df))
    got = c.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert not one_task or len(jobs) == 1
