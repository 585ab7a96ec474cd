"""Combinatorial problems on one small graph at a time, for use in grouped functions.

Functions take edges as (src, dst, w) tuples with hashable nodes.  Exact searches
are exponential at worst and meant for tens of nodes, as their problems are.
"""

from __future__ import annotations

from collections import deque
from itertools import combinations

import numpy as np

Edge = tuple


def _nodes(edges: list[Edge]) -> list:
    return sorted({v for e in edges for v in e[:2]})


def _near(edges: list[Edge]) -> dict:
    out: dict = {v: set() for v in _nodes(edges)}
    for e in edges:
        if e[0] != e[1]:
            out[e[0]].add(e[1])
            out[e[1]].add(e[0])
    return out


def max_flow(edges: list[Edge], source, sink) -> tuple[float, dict[int, float], set]:
    """The value, the flow by edge number, and the nodes on the source's side of a least cut (shortest augmenting paths)."""
    out: dict = {}
    ends, left = [], []
    for e in edges:
        for a, b, w in ((e[0], e[1], float(e[2])), (e[1], e[0], 0.0)):
            out.setdefault(a, []).append(len(ends))
            ends.append(b)
            left.append(w)
    total = 0.0
    while True:
        came, queue = {source: -1}, deque([source])
        while queue and sink not in came:
            v = queue.popleft()
            for k in out.get(v, ()):
                if left[k] > 1e-12 and ends[k] not in came:
                    came[ends[k]] = k
                    queue.append(ends[k])
        if sink not in came:
            return total, {i: left[2 * i + 1] for i in range(len(edges))}, set(came)
        path, v = [], sink
        while came[v] >= 0:
            path.append(came[v])
            v = ends[came[v] ^ 1]
        push = min(left[k] for k in path)
        for k in path:
            left[k] -= push
            left[k ^ 1] += push
        total += push


def min_cut(edges: list[Edge], source, sink) -> list[int]:
    """Numbers of the edges that a least cut takes."""
    side = max_flow(edges, source, sink)[2]
    return [i for i, e in enumerate(edges) if e[0] in side and e[1] not in side]


def max_matching(edges: list[Edge]) -> list[int]:
    """Edge numbers of a heaviest matching, by branching on the node of least degree."""
    best: tuple[float, list[int]] = (0.0, [])
    order = [i for i, e in enumerate(edges) if e[0] != e[1]]

    def search(left: list[int], weight: float, own: list[int]) -> None:
        nonlocal best
        if weight > best[0] + 1e-12:
            best = (weight, own)
        if not left or weight + sum(sorted((edges[i][2] for i in left), reverse=True)[: len(_nodes([edges[i] for i in left])) // 2]) <= best[0] + 1e-12:
            return
        count: dict = {}
        for i in left:
            for v in edges[i][:2]:
                count[v] = count.get(v, 0) + 1
        v = min(count, key=lambda x: (count[x], x))
        for i in [i for i in left if v in edges[i][:2]]:
            ends = set(edges[i][:2])
            search([k for k in left if not ends & set(edges[k][:2])], weight + edges[i][2], [*own, i])
        search([k for k in left if v not in edges[k][:2]], weight, own)

    search(order, 0.0, [])
    return sorted(best[1])


def max_stable_set(edges: list[Edge], weight: dict | None = None) -> list:
    """A heaviest set of nodes without an edge between them."""
    near = _near(edges)
    w = weight or dict.fromkeys(near, 1.0)

    def search(left: frozenset) -> tuple[float, tuple]:
        if not left:
            return 0.0, ()
        v = max(left, key=lambda x: (len(near[x] & left), x))
        if not near[v] & left:
            return sum(w[x] for x in left), tuple(left)
        a = search(left - {v} - near[v])
        a = (a[0] + w[v], (*a[1], v))
        b = search(left - {v})
        return a if a[0] >= b[0] else b

    return sorted(search(frozenset(near))[1])


def max_clique(edges: list[Edge], weight: dict | None = None) -> list:
    near = _near(edges)
    other = [(a, b, 1) for a, b in combinations(sorted(near), 2) if b not in near[a]]
    lonely = set(near) - {v for e in other for v in e[:2]}
    return sorted({*max_stable_set(other, weight), *lonely})


def vertex_cover(edges: list[Edge]) -> list:
    near = _near(edges)
    stable = set(max_stable_set(edges))
    return sorted(set(near) - stable)


def edge_cover(edges: list[Edge]) -> list[int]:
    """Fewest edges that touch every node: a largest matching, and any edge for each node left."""
    matched = max_matching([(a, b, 1.0) for a, b, *_ in edges])
    seen = {v for i in matched for v in edges[i][:2]}
    out = list(matched)
    for i, e in enumerate(edges):
        if e[0] != e[1] and not {*e[:2]} <= seen and ((e[0] not in seen) or (e[1] not in seen)):
            out.append(i)
            seen |= {*e[:2]}
    return sorted(out)


def _fewest(near: dict) -> list:
    """Fewest keys such that every other one is near one of them, by branching on the key with least choice."""
    cover = {v: {v, *u} for v, u in near.items()}
    most = max(map(len, cover.values()), default=0)

    def search(left: frozenset, own: tuple, k: int) -> tuple | None:
        if not left:
            return own
        if len(left) > k * most:
            return None
        v = min(left, key=lambda x: (len(cover[x]), x))
        return next((found for u in sorted(cover[v]) if (found := search(left - cover[u], (*own, u), k - 1)) is not None), None)

    return sorted(next(found for k in range(len(near) + 1) if (found := search(frozenset(near), (), k)) is not None))


def absorbing_nodes(edges: list[Edge]) -> list:
    """Fewest nodes such that every other one has a neighbour among them."""
    return _fewest(_near(edges))


def absorbing_edges(edges: list[Edge]) -> list[int]:
    """Fewest edges such that every other one shares a node with one of them."""
    return _fewest({i: {k for k, f in enumerate(edges) if k != i and {*e[:2]} & {*f[:2]}} for i, e in enumerate(edges)})


def colour_nodes(edges: list[Edge]) -> dict:
    """Colours from 1, fewest."""
    near = _near(edges)
    order = sorted(near, key=lambda v: (-len(near[v]), v))

    def search(i: int, own: dict, k: int) -> dict | None:
        if i == len(order):
            return own
        used = {own[x] for x in near[order[i]] if x in own}
        for c in range(1, min(k, max(own.values(), default=0) + 1) + 1):
            if c not in used and (found := search(i + 1, {**own, order[i]: c}, k)):
                return found
        return None

    for k in range(1, len(order) + 1):
        if found := search(0, {}, k):
            return found
    return {}


def colour_edges(edges: list[Edge]) -> dict[int, int]:
    """Colours by edge number: largest matchings, one after the other."""
    left, out, colour = list(range(len(edges))), {}, 0
    while left:
        colour += 1
        own = max_matching([(*edges[i][:2], 1.0) for i in left]) or [0]
        for k in own:
            out[left[k]] = colour
        left = [x for k, x in enumerate(left) if k not in set(own)]
    return out


def two_hop_colours(near: dict) -> dict:
    """Greedy colours such that nodes two steps apart differ: a schedule of nodes to update at once."""
    out: dict = {}
    for v in sorted(near):
        used = {out[x] for u in near[v] for x in (*near[u], u) if x in out and x != v}
        out[v] = next(c for c in range(len(near) + 1) if c not in used)
    return out


def euler_walk(edges: list[Edge]) -> list[int]:
    """Edge numbers of a walk over all edges; empty if there is none (walks joined at their nodes)."""
    at: dict = {}
    for i, e in enumerate(edges):
        at.setdefault(e[0], []).append(i)
        at.setdefault(e[1], []).append(i)
    odd = sorted(v for v in at if len(at[v]) % 2)
    if not edges or len(odd) > 2:
        return []
    used, stack, out = set(), [((odd or sorted(at))[0], None)], []
    while stack:
        v, came = stack[-1]
        while at[v] and at[v][-1] in used:
            at[v].pop()
        if at[v]:
            i = at[v].pop()
            used.add(i)
            stack.append((edges[i][1] if edges[i][0] == v else edges[i][0], i))
        else:
            stack.pop()
            if came is not None:
                out.append(came)
    return out[::-1] if len(out) == len(edges) else []


def spanning_tree(edges: list[Edge]) -> list[int]:
    """Edge numbers of a least spanning forest, earlier edges first among equals."""
    root: dict = {v: v for v in _nodes(edges)}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for i in sorted(range(len(edges)), key=lambda i: (edges[i][2], i)):
        a, b = find(edges[i][0]), find(edges[i][1])
        if a != b:
            root[a] = b
            out.append(i)
    return out


def cycle_basis(edges: list[Edge]) -> list[list[int]]:
    """Edge numbers of the cycle that each edge outside a spanning forest closes."""
    tree = spanning_tree([(a, b, 1.0) for a, b, *_ in edges])
    near: dict = {}
    for i in tree:
        near.setdefault(edges[i][0], []).append((edges[i][1], i))
        near.setdefault(edges[i][1], []).append((edges[i][0], i))
    out = []
    for i in sorted(set(range(len(edges))) - set(tree)):
        came, queue = {edges[i][0]: None}, deque([edges[i][0]])
        while queue:
            v = queue.popleft()
            for u, k in near.get(v, ()):
                if u not in came:
                    came[u] = (v, k)
                    queue.append(u)
        path, v = [i], edges[i][1]
        while came.get(v) is not None:
            path.append(came[v][1])
            v = came[v][0]
        out.append(path)
    return out


def cocycle_basis(edges: list[Edge]) -> list[list[int]]:
    """For each edge of a spanning forest, the edges between the parts that it holds together."""
    tree, out = spanning_tree([(a, b, 1.0) for a, b, *_ in edges]), []
    for gone in tree:
        near: dict = {}
        for i in tree:
            if i != gone:
                near.setdefault(edges[i][0], []).append(edges[i][1])
                near.setdefault(edges[i][1], []).append(edges[i][0])
        side, queue = {edges[gone][0]}, [edges[gone][0]]
        while queue:
            for u in near.get(queue.pop(), ()):
                if u not in side:
                    side.add(u)
                    queue.append(u)
        out.append([i for i, e in enumerate(edges) if (e[0] in side) != (e[1] in side)])
    return out


def isomorphism(a: list[Edge], b: list[Edge]) -> dict | None:
    """A map of a's nodes to b's that keeps undirected edges, if there is one."""
    na, nb = _near(a), _near(b)
    if sorted(map(len, na.values())) != sorted(map(len, nb.values())):
        return None
    order = sorted(na, key=lambda v: (-len(na[v]), v))

    def search(i: int, own: dict) -> dict | None:
        if i == len(order):
            return own
        v = order[i]
        for u in sorted(nb):
            if u not in own.values() and len(nb[u]) == len(na[v]) and all((own[x] in nb[u]) == (x in na[v]) for x in own):
                if (found := search(i + 1, {**own, v: u})) is not None:
                    return found
        return None

    return search(0, {})


def shortest_tour(weight: dict[tuple, float]) -> list:
    """The cheapest closed tour of all nodes (subsets that paths from the first node reach, by dynamic programming); empty if there is none.

    On graphs of bounded width the subsets reached are few; on complete ones they are all, for a dozen nodes.
    """
    nodes = sorted({v for e in weight for v in e})
    if len(nodes) < 2:
        return nodes
    near: dict = {v: {} for v in nodes}
    for (a, b), w in weight.items():
        near[a][b] = w
        near[b][a] = weight.get((b, a), w)
    first = nodes[0]
    best = {(frozenset([v]), v): (w, None) for v, w in near[first].items() if v != first}
    layer = best
    for _ in nodes[2:]:
        layer, old = {}, layer
        for (own, u), (d, _) in old.items():
            for v, w in near[u].items():
                if v != first and v not in own:
                    key = (own | {v}, v)
                    layer[key] = min(layer.get(key, (d + w, u)), (d + w, u))
        best |= layer
    ends = [(d + near[v][first], v) for (_, v), (d, _) in layer.items() if first in near[v]]
    if not ends:
        return []
    own, tour, v = frozenset(nodes[1:]), [], min(ends)[1]
    while v is not None:
        tour.append(v)
        v, own = best[own, v][1], own - {v}
    return [first, *tour[::-1]]


def vertex_path(edges: list[Edge], weight: dict, source, sink) -> tuple[float, list]:
    """The path of least node weights, ends included."""
    import heapq

    out: dict = {}
    for e in edges:
        out.setdefault(e[0], []).append(e[1])
    queue, done = [(weight[source], [source])], set()
    while queue:
        d, path = heapq.heappop(queue)
        if path[-1] == sink:
            return d, path
        if path[-1] not in done:
            done.add(path[-1])
            for u in out.get(path[-1], ()):
                heapq.heappush(queue, (d + weight[u], [*path, u]))
    return float("inf"), []


def segments(n: int, edges: list[Edge], k: float, least: int = 1) -> list[int]:
    """Regions of nodes 0..n-1 merged along light edges: an edge joins two regions if it is no heavier than either's heaviest so far plus k over its size; then regions under least join a neighbour."""
    root, size, limit = list(range(n)), [1] * n, [float(k)] * n

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    order = sorted(edges, key=lambda e: e[2])
    for small in (False, True):
        for a, b, w, *_ in order:
            a, b = find(a), find(b)
            if a != b and (min(size[a], size[b]) < least if small else w <= limit[a] and w <= limit[b]):
                root[b] = a
                size[a] += size[b]
                limit[a] = w + k / size[a]
    return [find(v) for v in range(n)]


def merge_hierarchy(sizes: list[float], edges: dict[tuple[int, int], float], similarity) -> list[tuple[int, int, int, float]]:
    """Greedy grouping: (parent, child, child, similarity), the most similar neighbours first; similarity(a, b, old) gives a merged region's to another."""
    alive, near, out = dict(enumerate(sizes)), {tuple(sorted(e)): s for e, s in edges.items()}, []
    new = len(sizes)
    while near:
        (a, b), s = max(near.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        out.append((new, a, b, s))
        others = {v for e in near for v in e if {a, b} & set(e)} - {a, b}
        near = {e: x for e, x in near.items() if not {a, b} & set(e)}
        alive[new] = alive.pop(a) + alive.pop(b)
        for v in others:
            near[v, new] = similarity(alive[v], alive[new], sum(sizes))
        new += 1
    return out


def segment_chains(weight: np.ndarray, k: float) -> np.ndarray:
    """segments() of many chains of one length: weight[g, i] is that of the edge of g's nodes i and i + 1; returns [g, node]."""
    many, n = len(weight), weight.shape[1] + 1
    row, name = np.arange(many), np.tile(np.arange(n), (many, 1))
    size, limit = np.ones((many, n), np.int64), np.full((many, n), float(k))
    for at in np.argsort(weight, axis=1, kind="stable").T:
        a, b, w = name[row, at], name[row, at + 1], weight[row, at]
        good = np.flatnonzero((w <= limit[row, a]) & (w <= limit[row, b]))
        a, b = a[good], b[good]
        name[good] = np.where(name[good] == b[:, None], a[:, None], name[good])
        size[good, a] += size[good, b]
        limit[good, a] = w[good] + k / size[good, a]
    return name


def merge_chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merge_hierarchy() of many chains of one length, the smallest neighbours first: (parent, child, child), each [g, merge]; sizes[g, i] are those of g's nodes."""
    many, n = sizes.shape
    row, size, name = np.arange(many), sizes.astype(float), np.tile(np.arange(n, dtype=np.int32), (many, 1))
    whole = np.array([sum(x) for x in size.tolist()])[:, None]
    out = np.zeros((3, many, n - 1), np.int32)
    for step in range(n - 1):
        with np.errstate(invalid="ignore", divide="ignore"):
            like = 1 - (size[:, :-1] + size[:, 1:]) / whole
        low, high = np.minimum(name[:, :-1], name[:, 1:]), np.maximum(name[:, :-1], name[:, 1:])
        first = np.where(like == like.max(axis=1, keepdims=True), low.astype(np.int64) * 2 * n + high, 4 * n * n)
        at = first.argmin(axis=1)
        out[0, :, step], out[1, :, step], out[2, :, step] = n + step, low[row, at], high[row, at]
        size[row, at] += size[row, at + 1]
        name[row, at] = n + step
        rest = np.arange(n - step - 1) + (np.arange(n - step - 1) > at[:, None])
        size, name = np.take_along_axis(size, rest, axis=1), np.take_along_axis(name, rest, axis=1)
    return out[0], out[1], out[2]


def _last(ends: list[tuple]) -> list[set]:
    """The nodes that no edge after each edge touches."""
    last = {v: i for i, e in enumerate(ends) for v in e[:2]}
    return [{v for v in e[:2] if last[v] == i} for i, e in enumerate(ends)]


def heaviest_matchings(ends: list[tuple], weight: np.ndarray) -> np.ndarray:
    """The weight of max_matching() of many graphs with the same edges; weight: [graph, edge].

    Edges are taken up one after the other; what is kept is the best for every set
    of matched nodes among those that have edges to come, few where these are.
    """
    best = {frozenset(): np.zeros(len(weight))}
    for i, (e, gone) in enumerate(zip(ends, _last(ends))):
        new: dict = {}
        for own, value in best.items():
            ways = [(own, value)]
            if e[0] != e[1] and not own & {*e}:
                ways.append((own | {*e}, value + weight[:, i]))
            for key, v in ways:
                key -= gone
                new[key] = np.maximum(new[key], v) if key in new else v
        best = new
    return best[frozenset()]


def least_cuts(ends: list[tuple], weight: np.ndarray, source, sink) -> np.ndarray:
    """The weight of min_cut(), which is the value of max_flow(), of many graphs with the same edges; weight: [graph, edge], none negative.

    Like heaviest_matchings(), by the sides of the nodes that have edges to come.
    """
    best: dict = {(): np.zeros(len(weight))}
    for i, ((a, b), gone) in enumerate(zip(ends, _last(ends))):
        new: dict = {}
        for key, value in best.items():
            known = dict(key)
            for p in [known[a]] if a in known else [True] if a == source else [False] if a == sink else [True, False]:
                for q in [p] if a == b else [known[b]] if b in known else [True] if b == source else [False] if b == sink else [True, False]:
                    side = tuple(sorted((v, x) for v, x in (known | {a: p, b: q}).items() if v not in gone))
                    v = value + weight[:, i] if p and not q else value
                    new[side] = np.minimum(new[side], v) if side in new else v
        best = new
    return best[()]
