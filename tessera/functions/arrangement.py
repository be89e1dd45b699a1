"""The arrangement of the line segments of one tile, on integers.

Coordinates count from the tile's lower left corner. Its borders lie at 0 and at ``size``
(even), and everything else has odd coordinates, so no segment runs along a border; a segment
that was cut there ends on it. All predicates are exact: a product of two coordinates stays far
below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

#: Pairs of segments that are compared at once.
BLOCK = 1 << 20
#: Largest tile, so that products of differences are exact.
LARGEST = 1 << 24
#: Segments that are arranged at once; fewer where at least ``DEEP`` areas lie over each other, since small parts there lie wholly inside.
MOST, MOST_DEEP, DEEP = 128, 16, 8
#: Shortest side of a part that is divided further.
SHORTEST = 64


def _cross(ax, ay, bx, by, px, py):
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def merged(segments: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment once, from its lesser end to its greater, with the sum of its signed weights; none of sum 0."""
    back = (segments[:, 0] > segments[:, 2]) | ((segments[:, 0] == segments[:, 2]) & (segments[:, 1] > segments[:, 3]))
    segments = np.where(back[:, None], segments[:, [2, 3, 0, 1]], segments)
    weights = np.where(back[:, None], -weights, weights)
    real = (segments[:, :2] != segments[:, 2:]).any(axis=1)
    unique, at = np.unique(segments[real], axis=0, return_inverse=True)
    sums = np.zeros((len(unique), weights.shape[1]), np.int64)
    np.add.at(sums, at.ravel(), weights[real])
    used = (sums != 0).any(axis=1)
    return unique[used], sums[used]


def near_pairs(segments: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of segments whose boxes meet, in blocks: a sweep over x in each of some bands of y."""
    y0, y1 = np.minimum(segments[:, 1], segments[:, 3]), np.maximum(segments[:, 1], segments[:, 3])
    if not len(segments):
        return
    height = int(y1.max()) // max(1, min(256, int(len(segments) ** 0.5) // 4)) + 1
    low, high = y0 // height, y1 // height
    owner = np.repeat(np.arange(len(segments)), high - low + 1)
    band = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    left, right = segments[owner, 0], segments[owner, 2]
    wide = int(segments[:, 2].max()) + 1
    order = np.argsort(band * wide + left, kind="stable")
    owner, band, left, right = owner[order], band[order], left[order], right[order]
    later = np.searchsorted(band * wide + left, band * wide + right, side="right") - np.arange(len(owner)) - 1
    ends = np.cumsum(later)
    first = 0
    while first < len(owner):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, side="right")))
        counts = later[first:last]
        a = np.repeat(np.arange(first, last), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        i, j = owner[a], owner[b]
        meets = (y0[i] <= y1[j]) & (y0[j] <= y1[i]) & (band[a] == np.maximum(low[i], low[j]))  # each pair in the first band of both
        yield i[meets], j[meets]
        first = last


def _odd(x: np.ndarray) -> np.ndarray:
    return 2 * np.floor(x / 2).astype(np.int64) + 1


def _cuts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments meet: indices of segments and the points to cut them at, none of them their ends."""
    which, points = [], []

    def add(k, px, py):
        inner = ~(((px == s[k, 0]) & (py == s[k, 1])) | ((px == s[k, 2]) & (py == s[k, 3])))
        which.append(k[inner])
        points.append(np.stack([px[inner], py[inner]], axis=1))

    for i, j in near_pairs(s):
        a, b = s[i], s[j]
        d1, d2 = _cross(*a.T, b[:, 0], b[:, 1]), _cross(*a.T, b[:, 2], b[:, 3])
        d3, d4 = _cross(*b.T, a[:, 0], a[:, 1]), _cross(*b.T, a[:, 2], a[:, 3])
        proper = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
        t = d3[proper] / (d3[proper] - d4[proper])
        px = _odd(a[proper, 0] + t * (a[proper, 2] - a[proper, 0]))
        py = _odd(a[proper, 1] + t * (a[proper, 3] - a[proper, 1]))
        add(i[proper], px, py)
        add(j[proper], px, py)
        for d, k, line, x, y in ((d1, i, a, b[:, 0], b[:, 1]), (d2, i, a, b[:, 2], b[:, 3]), (d3, j, b, a[:, 0], a[:, 1]), (d4, j, b, a[:, 2], a[:, 3])):
            on = (d == 0) & (x >= line[:, 0]) & (x <= line[:, 2]) & (y >= np.minimum(line[:, 1], line[:, 3])) & (y <= np.maximum(line[:, 1], line[:, 3]))
            add(k[on], x[on], y[on])
    return (np.concatenate(which), np.concatenate(points)) if which else (np.zeros(0, np.int64), np.zeros((0, 2), np.int64))


def _routed(s: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All grid points that segments pass so near that they are rounded to them: of ``points`` and of all ends."""
    found = np.concatenate([points, s[:, :2], s[:, 2:]])
    found = np.unique(found[(found % 2 == 1).all(axis=1)], axis=0)
    y0, y1 = np.minimum(s[:, 1], s[:, 3]) - 1, np.maximum(s[:, 1], s[:, 3]) + 1
    height, wide = int(y1.max()) // max(1, min(256, int(len(s) ** 0.5) // 4)) + 1, int(s[:, 2].max()) + 3
    place = (found[:, 1] // height) * wide + found[:, 0]
    order = np.argsort(place, kind="stable")
    found, place = found[order], place[order]
    low, high = np.maximum(y0, 0) // height, y1 // height
    owner = np.repeat(np.arange(len(s)), high - low + 1)
    band = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    begin = np.searchsorted(place, band * wide + np.maximum(s[owner, 0] - 1, 0))
    counts = np.searchsorted(place, band * wide + s[owner, 2] + 1, side="right") - begin
    ends, first, which, cuts = np.cumsum(counts), 0, [], []
    while first < len(owner):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, side="right")))
        n = counts[first:last]
        k = np.repeat(owner[first:last], n)
        at = np.repeat(begin[first:last], n) + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        x, y = found[at].T
        line = s[k]
        hit = (y >= y0[k]) & (y <= y1[k]) & (np.abs(_cross(*line.T, x, y)) < np.abs(line[:, 2] - line[:, 0]) + np.abs(line[:, 3] - line[:, 1]))
        hit &= ~(((x == line[:, 0]) & (y == line[:, 1])) | ((x == line[:, 2]) & (y == line[:, 3])))
        which.append(k[hit])
        cuts.append(found[at[hit]])
        first = last
    return np.concatenate(which), np.concatenate(cuts)


def arranged(segments: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The same weighted chains as segments that meet in their ends alone.

    Crossings are rounded to the grid, and each segment is led through all the rounded points that
    it passes within the rounding (snap rounding), so that bending it makes no new crossings. What
    ties of rounding leave is cut in further rounds.
    """
    s, w = merged(segments, weights)
    for _ in range(rounds):
        k, points = _cuts(s)
        if not len(k):
            return s, w
        more, near = _routed(s, points)
        k, points = np.concatenate([k, more]), np.concatenate([points, near])
        along = (points[:, 0] - s[k, 0]) * (s[k, 2] - s[k, 0]) + (points[:, 1] - s[k, 1]) * (s[k, 3] - s[k, 1])
        order = np.lexsort((points[:, 1], points[:, 0], along, k))
        k, points = k[order], points[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (points[1:] != points[:-1]).any(axis=1)
        k, points = k[new], points[new]
        cut = np.unique(k)
        owner = np.concatenate([cut, k, cut])
        chain = np.concatenate([s[cut, :2], points, s[cut, 2:]])
        place = np.concatenate([np.zeros(len(cut), np.int64), np.arange(1, len(k) + 1), np.full(len(cut), len(k) + 1)])
        order = np.lexsort((place, owner))
        owner, chain = owner[order], chain[order]
        joined = owner[1:] == owner[:-1]
        parts = np.concatenate([chain[:-1], chain[1:]], axis=1)[joined]
        whole = np.setdiff1d(np.arange(len(s)), cut)
        s, w = merged(np.concatenate([s[whole], parts]), np.concatenate([w[whole], w[owner[1:][joined]]]))
    raise RuntimeError("segments still cross after rounding many times")


def sides(s: np.ndarray, w: np.ndarray, corner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers right and left of each arranged segment, one for each weight.

    A segment has its weight more on its left than on its right, so around a point one segment's
    sides tell those of all others. One segment of each connected part is looked up by a walk
    (``_walked``), and what it tells is handed on along the segments.
    """
    n = len(s)
    points = np.concatenate([s[:, :2], s[:, 2:]])
    ids, vertex = np.unique(points[:, 0] * (LARGEST + 1) + points[:, 1], return_inverse=True)
    dx, dy = s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]
    angle = np.arctan2(np.concatenate([dy, -dy]), np.concatenate([dx, -dx]))
    at_right = (points[:, 0] % 2 == 0) & (points[:, 0] > 0)
    angle[at_right] %= 2 * np.pi  # so that one begins to turn outside of the tile
    order = np.lexsort((angle, vertex))
    outward = np.concatenate([w, -w])
    turned = np.cumsum(outward[order], axis=0) - outward[order]
    starts = np.searchsorted(vertex[order], np.arange(len(ids)))
    offset = np.empty_like(outward)
    offset[order] = turned - turned[starts][vertex[order]]
    # Right of what leaves a vertex: the vertex's own number plus the offset.
    step = offset[:n] + w - offset[n:]
    base = np.zeros((len(ids), w.shape[1]), np.int64)
    part = np.full(len(ids), -1, np.int64)
    links = [[] for _ in range(len(ids))]
    for u, v, d in zip(vertex[:n].tolist(), vertex[n:].tolist(), step.tolist(), strict=True):
        links[u].append((v, d, 1))
        links[v].append((u, d, -1))
    seeds = []
    values = base.tolist()
    parts = part.tolist()
    for k, u in enumerate(vertex[:n].tolist()):
        if parts[u] >= 0:
            continue
        parts[u] = len(seeds)
        seeds.append(k)
        todo = [u]
        while todo:
            a = todo.pop()
            own = values[a]
            for b, d, sign in links[a]:
                if parts[b] < 0:
                    parts[b] = parts[u]
                    values[b] = [x + sign * y for x, y in zip(own, d, strict=True)]
                    todo.append(b)
    base, part = np.array(values, np.int64), np.array(parts, np.int64)
    relative = base[vertex[:n]] + offset[:n]
    right = relative + (_walked(s, w, corner, np.array(seeds)) - relative[seeds])[part[vertex[:n]]]
    return right, right + w


def _walked(s: np.ndarray, w: np.ndarray, corner: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Winding numbers right of the segments ``asked``.

    From the tile's corner, whose numbers are ``corner``, one walks along the lower border and
    then up to the right of the segment's middle, and counts what one crosses.
    """
    up = s[:, 3] > s[:, 1]
    low = np.where(up, s[:, 1], s[:, 3]) == 0
    at = np.where(up, s[:, 0], s[:, 2])[low]
    crossed = np.where(up[low, None], -w[low], w[low])  # walking to the right, against what goes up
    order = np.argsort(at, kind="stable")
    at, crossed = at[order], np.concatenate([np.zeros((1, w.shape[1]), np.int64), np.cumsum(crossed[order], axis=0)])
    mx, my = s[asked, 0] + s[asked, 2], s[asked, 1] + s[asked, 3]  # twice the middle
    below = corner + crossed[np.searchsorted(2 * at, mx, side="right")]
    flat = np.flatnonzero(s[:, 0] != s[:, 2])
    t, tw = s[flat], w[flat]
    step = max(1, BLOCK // max(1, len(flat)))
    for first in range(0, len(asked), step):
        x, y = mx[first : first + step, None], my[first : first + step, None]
        covers = (2 * t[None, :, 0] <= x) & (x < 2 * t[None, :, 2])
        under = covers & (_cross(2 * t[None, :, 0], 2 * t[None, :, 1], 2 * t[None, :, 2], 2 * t[None, :, 3], x, y) > 0)
        below[first : first + step] += under.astype(np.int64) @ tw
    # What goes right lies below its left side; what goes up has the walk's end on its right.
    return below


def boundary(segments: np.ndarray, weights: np.ndarray, corner: np.ndarray, keep) -> np.ndarray:
    """Directed segments that have what ``keep`` (of winding numbers) holds on their left, and not on their right."""
    s, w = arranged(segments, weights)
    if not len(s):
        return s
    right, left = sides(s, w, corner)
    inner_right, inner_left = keep(right), keep(left)
    forth, back = s[inner_left & ~inner_right], s[inner_right & ~inner_left]
    return np.concatenate([forth, back[:, [2, 3, 0, 1]]])


def _undecided(s: np.ndarray, w: np.ndarray, corner: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """The segments that can change what ``keep`` says within a part of a tile; none if it says the same throughout.

    A walk crosses a segment once, so no winding number is further from the corner's than the sum
    of the weights. ``keep`` asks of each number only whether it is positive.
    """
    reach = np.abs(w).sum(axis=0)
    inside, outside = corner - reach > 0, corner + reach <= 0
    kept = keep(np.array(list(product(*[(1,) if i else (0,) if o else (0, 1) for i, o in zip(inside, outside, strict=True)]))))
    if kept.all() or not kept.any():
        return s[:0], w[:0]
    w = np.where(inside | outside, 0, w)
    used = (w != 0).any(axis=1)
    return s[used], w[used]


def _halves(s: np.ndarray, w: np.ndarray, at: int, width: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Segments before and after ``at`` of their first coordinate, cut there, and what a walk along the border to ``at`` crosses.

    ``width`` is the extent of the second coordinate. What crosses the border away from it counts
    positive.
    """
    back = s[:, 0] > s[:, 2]
    s, w = np.where(back[:, None], s[:, [2, 3, 0, 1]], s), np.where(back[:, None], -w, w)
    before, after = s[:, 2] < at, s[:, 0] > at
    across = ~(before | after)
    t, tw = s[across], w[across]
    v = np.clip(_odd(t[:, 1] + (t[:, 3] - t[:, 1]) * ((at - t[:, 0]) / (t[:, 2] - t[:, 0]))), 1, width - 1)
    line = np.full(len(t), at)
    first = np.concatenate([s[before], np.stack([t[:, 0], t[:, 1], line, v], axis=1)]), np.concatenate([w[before], tw])
    second = np.concatenate([s[after], np.stack([line, v, t[:, 2], t[:, 3]], axis=1)]) - np.array([at, 0, at, 0]), np.concatenate([w[after], tw])
    return first, second, first[1][first[0][:, 1] == 0].sum(axis=0) - first[1][first[0][:, 3] == 0].sum(axis=0)


def divided(segments: np.ndarray, weights: np.ndarray, corner: np.ndarray, size: int, keep) -> np.ndarray:
    """``boundary`` of a tile of side ``size``, which is halved until its parts hold few segments.

    A part that lies wholly inside or outside is done without looking for crossings, so where
    areas lie thickly over each other the work grows with the segments and not with their
    crossings. Lines between parts have even coordinates, and no point but cuts lies on them.
    """
    found, todo = [], [(*merged(segments, weights), np.asarray(corner), 0, 0, size, size)]
    while todo:
        s, w, corner, x, y, wide, high = todo.pop()
        s, w = _undecided(s, w, corner, keep)
        if len(s) <= (MOST if corner.max() < DEEP else MOST_DEEP) or max(wide, high) < SHORTEST:
            if len(s):
                found.append(boundary(s, w, corner, keep) + np.array([x, y, x, y]))
        elif wide >= high:
            at = wide // 4 * 2
            left, right, crossed = _halves(s, w, at, high)
            todo += [(*left, corner, x, y, at, high), (*right, corner - crossed, x + at, y, wide - at, high)]
        else:
            at, turn = high // 4 * 2, [1, 0, 3, 2]
            (low, lw), (top, tw), crossed = _halves(s[:, turn], w, at, wide)
            todo += [(low[:, turn], lw, corner, x, y, wide, at), (top[:, turn], tw, corner + crossed, x, y + at, wide, high - at)]
    return np.concatenate(found) if found else np.zeros((0, 4), np.int64)


def straightened(path: np.ndarray) -> np.ndarray:
    """The path without inner points that only the division of its tile made, where they lie on a straight line."""
    a, p, b = path[:-2], path[1:-1], path[2:]
    made = (p % 2 == 0).any(axis=1) & (_cross(*a.T, *b.T, *p.T) == 0)
    return path[np.r_[True, ~made, True]] if len(path) > 2 else path


def chains(segments: np.ndarray, size: int) -> list[np.ndarray]:
    """Directed segments joined into paths between the tile's borders, and into rings that don't reach them.

    Where several paths pass through a point each goes on along the one that leaves the least
    inside between them, so that areas which touch in a point stay apart.
    """
    if not len(segments):
        return []
    starts: dict[tuple[int, int], list[int]] = {}
    for n, (x, y) in enumerate(segments[:, :2].tolist()):
        starts.setdefault((x, y), []).append(n)
    angle = np.arctan2(segments[:, 3] - segments[:, 1], segments[:, 2] - segments[:, 0])
    border = ((segments[:, 2:] == 0) | (segments[:, 2:] == size)).any(axis=1)
    following = np.full(len(segments), -1, np.int64)
    for n, (x, y) in enumerate(segments[:, 2:].tolist()):
        if not border[n]:
            out = starts[x, y]
            back = angle[n] + np.pi
            following[n] = out[0] if len(out) == 1 else min(out, key=lambda k: (back - angle[k]) % (2 * np.pi) or 2 * np.pi)
    led = np.zeros(len(segments), bool)
    led[following[following >= 0]] = True
    done = np.zeros(len(segments), bool)
    paths = []
    for n in [*np.flatnonzero(~led).tolist(), *range(len(segments))]:
        if done[n]:
            continue
        path = [segments[n, :2]]
        while n >= 0 and not done[n]:
            done[n] = True
            path.append(segments[n, 2:])
            n = int(following[n])
        paths.append(np.array(path))
    return paths
