"""Accumulation by contraction against plain topological order."""

from collections import defaultdict

import numpy as np
import pytest

from rillwise.operators import network

SCHEMA = "pipe_id int, up_node int, down_node int, length_m double"


def by_hand(edges):
    """Pipe by pipe in topological order; pipes of loops keep what reached them."""
    own = {p: [l * network.STRIP_M, l] for p, _, _, l in edges}
    leave, wait = defaultdict(list), {p: sum(d == u for _, _, d, _ in edges) if u is not None else 0 for p, u, _, _ in edges}
    for p, u, _, _ in edges:
        leave[u].append(p)
    length, down = {e[0]: e[3] for e in edges}, {e[0]: e[2] for e in edges}
    ready = [p for p, n in wait.items() if n == 0]
    while ready:
        p = ready.pop()
        below = leave[down[p]] if down[p] is not None else []
        for q in below:
            own[q][0] += own[p][0] / len(below)
            own[q][1] = max(own[q][1], own[p][1] + length[q])
            wait[q] -= 1
            if wait[q] == 0:
                ready.append(q)
    return own


def check(spark, edges):
    got = {r["pipe_id"]: (r["area_m2"], r["path_m"]) for r in network.accumulate(spark.createDataFrame(edges, SCHEMA)).collect()}
    want = by_hand(edges)
    assert got.keys() == want.keys()
    for p, (area, path) in want.items():
        assert got[p] == (pytest.approx(area), pytest.approx(path)), p


@pytest.mark.parametrize("seed", range(3))
def test_random_networks_with_splits_and_loops(spark, seed):
    rng, edges = np.random.default_rng(seed), []
    for k in range(160):
        a, b = sorted(rng.integers(0, 90, 2).tolist())
        edges.append((len(edges), a, b + (a == b), float(rng.integers(1, 50))))
    edges += [(len(edges) + i, 100 + i, 101 + i, 5.0) for i in range(30)]  # a chain
    edges += [(300, 89, 80, 7.0), (301, 130, 130, 3.0), (302, 400, 401, 1.0), (303, 401, 400, 2.0), (304, 30, 400, 4.0), (305, 401, 402, 6.0), (306, None, 5, 8.0), (307, 9, None, 9.0)]
    check(spark, edges)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """10,000 pipes in a row, and 3,000 in a row with a side pipe at each."""
    rounds, saved = [], network.saved
    monkeypatch.setattr(network, "saved", lambda df, name: rounds.append(name) or saved(df, name))
    n = 10_000
    chain = [(int(i), int(i), int(i) + 1, 1.0) for i in np.random.default_rng(1).permutation(n)]
    comb = [(20_000 + i, 20_000 + i, 20_001 + i, 2.0) for i in range(3000)] + [(30_000 + i, 30_000 + i, 20_000 + i, 1.0) for i in range(3000)]
    got = {r["pipe_id"]: (r["area_m2"], r["path_m"]) for r in network.accumulate(spark.createDataFrame([*chain, *comb], SCHEMA)).collect()}
    assert rounds.count("nodes") <= 20
    assert all(got[i] == ((i + 1) * network.STRIP_M, i + 1.0) for i in range(n))
    assert all(got[20_000 + i] == ((3 * i + 3) * network.STRIP_M, 2.0 * i + 3) for i in range(3000))
