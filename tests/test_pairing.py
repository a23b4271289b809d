import random

import numpy as np
from brute import FAR as NONE, least_weight

from pairloom.operators.components import label
from pairloom.operators.pairing import FAR, pair_up


def _case(rng, n, span, rim_shift, no_rim):
    points = np.unique(rng.integers(0, span, (n, 2)), axis=0)
    n = len(points)
    d = 2 * np.abs(points[:, None] - points[None]).sum(-1)
    rim = np.full(n, FAR) if no_rim else 2 * (points[:, 0] + 1) + rim_shift
    return n, d, rim


def test_least_weight_on_random_groups():
    rng = np.random.default_rng(7)
    rings = 0
    for turn in range(1500):
        n, d, rim = _case(rng, int(rng.integers(1, 12)), (6, 12, 30)[turn % 3], (0, 10, 40)[turn % 3], turn % 5 == 0)
        i, j = np.triu_indices(n, 1)
        if turn % 2:
            near = d[i, j] < np.minimum(rim[i] + rim[j], FAR)
            i, j = i[near], j[near]
        done, pairs, group = pair_up(rim, i, j, d[i, j])
        want = least_weight(range(n), {(a, b): int(d[a, b]) for a in range(n) for b in range(n)}, {a: min(int(rim[a]), NONE) for a in range(n)})
        assert done == (want is not None)
        rings += group.next_id > n
        if not done:
            continue
        assert sum(int(rim[a]) if b < 0 else int(d[a, b]) for a, b in pairs) == want
        assert sorted([a for a, _ in pairs] + [b for _, b in pairs if b >= 0]) == list(range(n))
        # The regions prove the optimum: they never overlap outside a common ring.
        assert all(group.cover[a] + group.cover[b] <= d[a, b] or group.top[a] == group.top[b] for a, b in zip(i, j))
        times = [t for t, _ in group.events]
        assert times == sorted(times)
    assert rings > 50


def test_odd_ring_with_far_boundary():
    # Three mutually near hits, a boundary only far away: a ring must form first.
    done, pairs, group = pair_up([100, 102, 104], [0, 0, 1], [1, 2, 2], [4, 4, 4])
    assert done and sum(b < 0 for _, b in pairs) == 1
    assert group.next_id == 4
    assert min(t for t, _ in group.events) == 2


def test_single_edge_without_boundary_has_no_pairing():
    done, pairs, _ = pair_up([FAR], [], [], [])
    assert not done and pairs == []


def test_horizon_stops_growth():
    done, _, group = pair_up([50, 50], [0], [1], [20], horizon=4)
    assert not done and group.now == 4 and group.most.tolist() == [4, 4]


def test_labels_of_many_groups():
    group, node, root = label(np.array([0, 0, 1, 1]), np.array([5, 3, 5, 9]), np.array([3, 1, 9, 7]))
    assert dict(zip(zip(group.tolist(), node.tolist()), root.tolist())) == {
        (0, 1): 1, (0, 3): 1, (0, 5): 1, (1, 5): 5, (1, 7): 5, (1, 9): 5,
    }


def test_groups_of_one_and_two_hits_need_no_search():
    from pairloom.operators import matching as M

    rng = random.Random(23)
    far = int(M.FAR)
    rows, cuts = [], [0]
    for k in range(600):
        low, high = sorted(rng.sample(range(90), 2))
        rims = [rng.choice([far, 0, *range(2, 24, 2)]) for _ in range(2)]
        part = [(low, M.RIM, rims[0], 1)]
        if k % 3:
            part += [(high, M.RIM, rims[1], 2), (low, high, rng.randrange(1, 30), 4 + k % 4)]
        rows += part
        cuts.append(len(rows))
    u, v, d, m = (np.array(x, np.int64) for x in zip(*rows))
    starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
    one, two = M._plain_groups(starts, ends, u, v, d, None)
    assert one.sum() > 100 and two.sum() > 80 and not (one & two).any()
    for mask, make in ((one, M._single_hits), (two, M._single_pairs)):
        got = [c.to_pylist() for c in make(starts[mask], u, d, m)]
        for k, (a, b) in enumerate(zip(starts[mask], ends[mask])):
            want = M._one_group(u[a:b], v[a:b], d[a:b], m[a:b], None)
            assert [c[k] for c in got] == [np.asarray(x).tolist() for x in want]
    assert not M._plain_groups(starts, ends, u, v, d, 0)[1].any()
