"""Areas, borders and lengths of overlaid polygons by a sweep over vertical slabs, in numpy."""

import numpy as np


def edges_of(polygons: list[np.ndarray]) -> np.ndarray:
    """(n, 6): x1, y1, x2, y2, direction and polygon of all edges that are not vertical, left to right; rings may be open or closed."""
    out = []
    for k, ring in enumerate(polygons):
        ring = ring if np.array_equal(ring[0], ring[-1]) else np.vstack([ring, ring[:1]])
        e = np.hstack([ring[:-1], ring[1:], np.ones((len(ring) - 1, 1)), np.full((len(ring) - 1, 1), k)])
        e = e[e[:, 0] != e[:, 2]]
        back = e[:, 0] > e[:, 2]
        e[back] = e[back][:, [2, 3, 0, 1, 4, 5]] * [1, 1, 1, 1, -1, 1]
        out.append(e)
    return np.vstack(out) if out else np.zeros((0, 6))


def layered(layers: list[list[np.ndarray]]) -> np.ndarray:
    """(n, 7): the edges of several layers of polygons; the polygons are numbered through, and the last column is the layer."""
    out, offset = [], 0
    for k, polygons in enumerate(layers):
        e = edges_of(polygons)
        e[:, 5] += offset
        offset += len(polygons)
        out.append(np.column_stack([e, np.full(len(e), k)]))
    return np.vstack(out) if out else np.zeros((0, 7))


def exchanged(low: np.ndarray, high: np.ndarray) -> list[float]:
    """The shares of a slab's width at which edges cross that stand in order `low` at its left side and at heights `high` at its right one."""
    out, order = [], []
    for j in range(len(low)):
        at = len(order)
        while at and high[order[at - 1]] > high[j] + 1e-12:  # each edge that it passes crosses it
            i = order[at - 1]
            gap, past = low[j] - low[i], high[i] - high[j]
            out.append(gap / (gap + past))
            at -= 1
        order.insert(at, j)
    return out


def swept(edges: np.ndarray, n_layers: int, inside, winding: bool = False):
    """(x0, x1, pieces) of each slab that a vertical line sweeps; a piece is (edge below, edge above, its lower and upper y at x0 and at x1).

    edges: rows of x1, y1, x2, y2, direction, polygon, layer. Slabs end where an edge begins or ends, or two cross. The line keeps the edges it cuts
    in order from below; only edges that exchange places between a slab's sides are looked at as a pair. A polygon is filled by parity, or, with
    `winding`, where it winds around at all; a layer is covered where any of its polygons is. inside(covered): covered has a flag for each layer.
    """
    if not len(edges):
        return
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    begin, end = np.round(edges[:, 0], 9), np.round(edges[:, 2], 9)
    slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])
    polygon, layer, turn = edges[:, 5].astype(int).tolist(), edges[:, 6].astype(int).tolist(), edges[:, 4].astype(int).tolist()
    xs = np.unique(np.concatenate((begin, end)))
    height = lambda at, x: edges[at, 1] + slope[at] * (x - edges[at, 0])
    on, taken = np.zeros(0, int), 0
    for x0, x1 in zip(xs, xs[1:], strict=False):
        to = int(np.searchsorted(begin, x0, side="right"))
        on = np.concatenate((on[end[on] >= x1], np.arange(taken, to)[end[taken:to] >= x1]))
        taken = to
        if x1 - x0 < 1e-9 or not len(on):
            continue
        low, high = height(on, x0), height(on, x1)
        order = np.lexsort((high, low))
        on, low, high = on[order], low[order], high[order]
        cuts = [x0, x1]
        if np.any(np.diff(high) < -1e-12):
            cuts = np.unique(np.round([x0, x1, *(x0 + (x1 - x0) * np.array(exchanged(low.tolist(), high.tolist())))], 9))
        for left, right in zip(cuts, cuts[1:], strict=False):
            if right - left < 1e-9:
                continue
            mid, a, b = height(on, (left + right) / 2), height(on, left), height(on, right)
            line = np.argsort(mid, kind="stable")
            place = {int(e): j for j, e in enumerate(on)}
            state: dict[int, int] = {}
            counts, open_at, pieces = [0] * n_layers, -1, []
            for j in line.tolist():
                e = on[j]
                p = polygon[e]
                before = state.get(p, 0)
                after = before + turn[e] if winding else 1 - before
                state[p] = after
                if bool(after) != bool(before):
                    counts[layer[e]] += 1 if after else -1
                covered = inside([c > 0 for c in counts])
                if covered and open_at < 0:
                    open_at = j
                    if pieces and abs(pieces[-1][3] - a[j]) < 1e-9 and abs(pieces[-1][5] - b[j]) < 1e-9:  # what touches is one piece
                        open_at = place[pieces.pop()[0]]
                elif not covered and open_at >= 0:
                    if mid[j] > mid[open_at]:
                        pieces.append((int(on[open_at]), int(e), a[open_at], a[j], b[open_at], b[j]))
                    open_at = -1
            if pieces:
                yield float(left), float(right), pieces


def slabs(layers: list[list[np.ndarray]], inside) -> list[tuple[float, float, list[tuple[float, float, float, float]]]]:
    """(x0, x1, trapezoids) of each slab; a trapezoid has its lower and upper y at x0 and at x1. See swept."""
    return [(x0, x1, [piece[2:] for piece in pieces]) for x0, x1, pieces in swept(layered(layers), len(layers), inside)]


def area_of(slab: tuple) -> float:
    x0, x1, pieces = slab
    return (x1 - x0) * sum((b - a) + (d - c) for _, _, a, b, c, d in pieces) / 2


def dissolved(polygons: list[np.ndarray], winding: bool = True) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(outer ring, holes) of each part of the union of polygons, which may cross themselves; outer rings turn left, holes right.

    The union's border is read off the sweep: the edge below a piece forwards, that above it backwards, as far as it stays a border, and of a slab's
    sides what the next slab does not continue. Where borders touch in a point they stay apart.
    """
    return dissolved_edges(layered([polygons]), winding)


def dissolved_edges(edges: np.ndarray, winding: bool = True) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """dissolved for edges of one layer, as `swept` takes them."""
    starts: dict[tuple, list] = {}
    running: dict[tuple, tuple] = {}

    def border(p, q):
        if p != q:
            starts.setdefault(p, []).append(q)

    def flush(keep):
        for key in [k for k in running if k not in keep]:
            a, b = running.pop(key)
            border(a, b) if key[1] else border(b, a)

    slab = list(swept(edges, 1, lambda on: on[0], winding))
    for before, after in zip([None, *slab], [*slab, None], strict=True):
        if before and after and after[0] - before[1] > 1e-9:
            sides = [(before, None), (None, after)]
        else:
            sides = [(before, after)]
        for left, right in sides:
            x = round(left[1] if left else right[0], 9)
            ends = [y for piece in left[2] for y in piece[4:6]] if left else []
            begins = [y for piece in right[2] for y in piece[2:4]] if right else []
            level = levels([*ends, *begins])
            spans = [sorted(level[y] for y in ys) for ys in (ends, begins)]
            for y0, y1 in zip(rows := sorted(set(spans[0] + spans[1])), rows[1:], strict=False):
                covered = [bool(sum(y <= y0 for y in side) % 2) for side in spans]
                if covered[0] and not covered[1]:
                    border((x, y0), (x, y1))
                elif covered[1] and not covered[0]:
                    border((x, y1), (x, y0))
            if left:
                for below, above, _, _, c, d in left[2]:
                    for key, y in (((below, True), c), ((above, False), d)):
                        running[key] = (running[key][0], (x, level[y]))
            now = {}
            for below, above, a, b, _, _ in right[2] if right else []:
                now[below, True], now[above, False] = (x, level[a]), (x, level[b])
            flush({k for k in now if k in running and running[k][1] == now[k]})
            for key, p in now.items():
                running.setdefault(key, (p, p))
    return nested(traced(starts))


def levels(heights: list[float], near: float = 1e-6) -> dict[float, float]:
    """For each height the one it counts as: those that lie close together are one."""
    out: dict[float, float] = {}
    last = at = None
    for y in sorted(set(heights)):
        if last is None or y - last > near:
            at = round(float(y), 9) + 0.0
        out[y], last = at, y
    return out


def traced(starts: dict[tuple, list]) -> list[np.ndarray]:
    """The rings of directed edges (from each point to others); where several leave a point, the one furthest to the left goes on. Points within straight lines go."""
    rings = []
    for first in sorted(starts):
        while starts[first]:
            ring, at = [first], starts[first].pop()
            while at != first:
                ways, (px, py) = starts[at], ring[-1]
                ring.append(at)
                if len(ways) > 1:
                    dx, dy = at[0] - px, at[1] - py
                    turn = lambda q, dx=dx, dy=dy, at=at: np.arctan2(dx * (q[1] - at[1]) - dy * (q[0] - at[0]), dx * (q[0] - at[0]) + dy * (q[1] - at[1]))
                    ways.sort(key=turn)
                at = ways.pop()
            p = np.array(ring)
            while len(p) > 2:
                d, e = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
                bend = np.abs(d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) > 1e-9 * np.maximum(1.0, np.hypot(*d.T) * np.hypot(*e.T))
                if bend.all():
                    break
                p = p[bend]
            if len(p) > 2:
                rings.append(p)
    return rings


def crossed(rings: np.ndarray, near: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(clear, i, j, point) of open rings (ring, point, axis): where the edges i < j of a ring cross, both 0 where none do.

    Rings are clear if their edges cross once at most and no corner comes `near` an edge that it doesn't end.
    """
    n = rings.shape[1]
    a, b, k = rings, np.roll(rings, -1, 1), np.arange(n)
    d = b - a
    w, long = a[:, :, None] - a[:, None], (d * d).sum(-1)
    t = np.clip((w * d[:, None]).sum(-1) / np.where(long > 0, long, 1)[:, None], 0, 1)
    far = ((w - t[..., None] * d[:, None]) ** 2).sum(-1)
    own = (k[:, None] == k) | (k[:, None] == (k + 1) % n)
    clear = (own | (far > near * near)).all((1, 2))
    i, j = np.triu_indices(n, 2)
    i, j = i[j - i < n - 1], j[j - i < n - 1]  # the last edge ends where the first begins
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    one, two = side(a[:, j], b[:, j], a[:, i]), side(a[:, j], b[:, j], b[:, i])
    hit = (one * two < 0) & (side(a[:, i], b[:, i], a[:, j]) * side(a[:, i], b[:, i], b[:, j]) < 0)
    first, last, at = np.zeros(len(rings), int), np.zeros(len(rings), int), np.zeros((len(rings), 2))
    rows, which = np.nonzero(hit)
    first[rows], last[rows] = i[which], j[which]
    at[rows] = a[rows, i[which]] + d[rows, i[which]] * (one[rows, which] / (one[rows, which] - two[rows, which]))[:, None]
    return clear & (hit.sum(1) <= 1), first, last, at


def turned(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rings, area, bends) of open rings (ring, point, axis): made to turn left, from their first corner by x and y on; areas are signed as the rings were.

    Corners are rounded as `dissolved` does; bends tells rings of which no corner lies within a straight line.
    """
    r = np.round(rings, 9) + 0.0
    n = r.shape[1]
    start = np.argmin(np.where(r[..., 0] == r[..., 0].min(1, keepdims=True), r[..., 1], np.inf), 1)
    x, y = np.moveaxis(r - r[:, :1], -1, 0)
    area = (x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1) / 2
    step = np.where(area < 0, -1, 1)
    r = np.take_along_axis(r, ((start[:, None] + step[:, None] * np.arange(n)) % n)[..., None], 1)
    d, e = r - np.roll(r, 1, 1), np.roll(r, -1, 1) - r
    bend = np.abs(d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]) > 1e-9 * np.maximum(1.0, np.hypot(d[..., 0], d[..., 1]) * np.hypot(e[..., 0], e[..., 1]))
    return r, area, bend.all(1)


def plain_parts(rings: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(which, outer rings, areas) of open rings (ring, point, axis) that are clear: those of which no tuple tells are left to `dissolved`.

    A ring that doesn't cross itself is one part. One that crosses itself once is two loops that meet in that point: side by side, turning to either side,
    they are two parts, the smaller first; if both turn to one side, one holds the other and is the only part. outer rings: one array (ring, point, axis) for each
    part; areas: (ring, part).
    """
    clear, i, j, at = crossed(rings)
    out = []
    for one, two in np.unique(np.stack((i, j), 1)[clear], axis=0):
        which = np.flatnonzero(clear & (i == one) & (j == two))
        r = rings[which]
        if one == two:
            ring, area, bends = turned(r)
            out.append((which[bends], [ring[bends]], np.abs(area[bends, None])))
            continue
        x = at[which, None]
        (a, aa, af), (b, ba, bf) = turned(np.concatenate((x, r[:, one + 1 : two + 1]), 1)), turned(np.concatenate((x, r[:, two + 1 :], r[:, : one + 1]), 1))
        ok, apart, size_a, size_b = af & bf, (aa < 0) != (ba < 0), np.abs(aa), np.abs(ba)
        before = (size_a < size_b) | (size_a == size_b) & ((a[:, 0, 0] < b[:, 0, 0]) | (a[:, 0, 0] == b[:, 0, 0]) & (a[:, 0, 1] <= b[:, 0, 1]))
        for those, parts, sizes in (
            (ok & apart & before, [a, b], [size_a, size_b]), (ok & apart & ~before, [b, a], [size_b, size_a]),
            (ok & ~apart & (size_a >= size_b), [a], [size_a]), (ok & ~apart & (size_a < size_b), [b], [size_b]),
        ):
            out.append((which[those], [p[those] for p in parts], np.stack([s[those] for s in sizes], 1)))
    return [o for o in out if len(o[0])]


def turned_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def nested(rings: list[np.ndarray]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Rings that turn left, each with the rings that turn right within it (and within no smaller one)."""
    outer = sorted((r for r in rings if turned_area(r) > 0), key=turned_area)
    held: list[list[np.ndarray]] = [[] for _ in outer]
    for hole in (r for r in rings if turned_area(r) < 0):
        middle = (hole[0] + hole[1]) / 2
        for k, ring in enumerate(outer):
            if turned_area(ring) > -turned_area(hole) and holds(ring, *middle):
                held[k].append(hole)
                break
    return list(zip(outer, held, strict=True))


def overlay_area(layers: list[list[np.ndarray]], inside) -> float:
    return float(sum(map(area_of, swept(layered(layers), len(layers), inside))))


def union_area(polygons: list[np.ndarray]) -> float:
    return overlay_area([polygons], lambda on: on[0])


def line_inside(line: np.ndarray, polygons: list[np.ndarray]) -> float:
    """The length of a line within the union of polygons: cut at all crossings, pieces count if their middle is inside."""
    total = 0.0
    for p, q in zip(line[:-1], line[1:], strict=True):
        cuts = [0.0, 1.0]
        d = q - p
        for ring in polygons:
            ring = ring if np.array_equal(ring[0], ring[-1]) else np.vstack([ring, ring[:1]])
            a, e = ring[:-1], ring[1:] - ring[:-1]
            det = d[0] * e[:, 1] - d[1] * e[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((a[:, 0] - p[0]) * e[:, 1] - (a[:, 1] - p[1]) * e[:, 0]) / det
                u = ((a[:, 0] - p[0]) * d[1] - (a[:, 1] - p[1]) * d[0]) / det
            cuts += t[np.isfinite(t) & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)].tolist()
        cuts = np.unique(cuts)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if any(holds(ring, *(p + d * (a + b) / 2)) for ring in polygons):
                total += (b - a) * float(np.hypot(*d))
    return total


def holds(ring: np.ndarray, x: float, y: float) -> bool:
    """Whether a ring, open or closed, holds a point; its border counts."""
    ring = ring if np.array_equal(ring[0], ring[-1]) else np.vstack([ring, ring[:1]])
    a, b = ring[:-1], ring[1:]
    d = b - a
    n = (d**2).sum(axis=1)
    t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / np.where(n > 0, n, 1), 0, 1)
    if np.any(np.hypot(a[:, 0] + t * d[:, 0] - x, a[:, 1] + t * d[:, 1] - y) <= 1e-9):
        return True
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = d[:, 0] * (y - a[:, 1]) / d[:, 1] + a[:, 0]
    return bool(np.sum(over & (x < at)) % 2)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points, counter-clockwise, without collinear points."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(order):
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def rectangle(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(centre, unit vector along the long side, long side, short side) of the least-area rectangle around points, by the hull's edges."""
    h = hull(np.asarray(points, float))
    if len(h) < 3:
        d = h[-1] - h[0]
        n = float(np.hypot(*d))
        return (h[0] + h[-1]) / 2, d / n if n else np.array([1.0, 0.0]), n, 0.0
    best = None
    for e in np.roll(h, -1, axis=0) - h:
        u = e / np.hypot(*e)
        v = np.array([-u[1], u[0]])
        along, across = h @ u, h @ v
        w, t = float(np.ptp(along)), float(np.ptp(across))
        if best is None or w * t < best[0] - 1e-12:
            centre = u * (along.max() + along.min()) / 2 + v * (across.max() + across.min()) / 2
            best = (w * t, centre, u if w >= t else v, max(w, t), min(w, t))
    return best[1:]


def corridor(ring: np.ndarray, reach: float) -> np.ndarray | None:
    """A strip as wide as a ring's rectangle, prolonged by `reach` past both ends of its longer axis; none where it has no width or length."""
    centre, u, long, short = rectangle(ring)
    if not long or not short:
        return None
    a, b = u * (long / 2 + reach), np.array([-u[1], u[0]]) * short / 2
    return np.array([centre - a - b, centre + a - b, centre + a + b, centre - a + b])


def capsule(p: np.ndarray, q: np.ndarray, radius: float, steps: int = 8) -> np.ndarray:
    """The ring around a segment at a distance: half circles of 2 * steps edges at both ends."""
    at = np.arctan2(*(q - p)[::-1]) if np.any(q != p) else 0.0
    turn = np.linspace(-np.pi / 2, np.pi / 2, 2 * steps + 1)
    arc = lambda c, by: c + radius * np.column_stack((np.cos(turn + at + by), np.sin(turn + at + by)))
    return np.vstack((arc(q, 0.0), arc(p, np.pi)))


def buffered(line: np.ndarray, radius: float, steps: int = 8) -> list[np.ndarray]:
    """Rings whose union is the ground within `radius` of a line: one for each segment."""
    line = np.asarray(line, float)
    return [capsule(p, q, radius, steps) for p, q in zip(line[:-1], line[1:], strict=True)] if len(line) > 1 else [capsule(line[0], line[0], radius, steps)]


def inset(ring: np.ndarray, by: float) -> np.ndarray:
    """A convex counter-clockwise ring moved inwards: cut by each edge's line, moved; empty if nothing is left."""
    out = ring
    for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        n = np.array([p[1] - q[1], q[0] - p[0]]) / np.hypot(*(q - p))
        side = (out - p) @ n - by
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0):
                kept.append(out[i] + (out[j] - out[i]) * side[i] / (side[i] - side[j]))
        out = np.array(kept).reshape(-1, 2)
        if len(out) < 3:
            return np.zeros((0, 2))
    return out


def covers_line(cells: np.ndarray, p: np.ndarray, q: np.ndarray, slack: float = 1e-7) -> bool:
    """Whether a segment lies in the union of trapezoids (rows x0, x1, a0, b0, a1, b1 that don't overlap), borders included."""
    if p[0] > q[0]:
        p, q = q, p
    x0, x1, a0, b0, a1, b1 = cells.T
    if q[0] - p[0] <= slack:
        here = (x0 <= p[0] + slack) & (x1 >= p[0] - slack)
        share = np.clip((p[0] - x0[here]) / (x1 - x0)[here], 0, 1)
        low, high = a0[here] + (a1 - a0)[here] * share, b0[here] + (b1 - b0)[here] * share
        at, end, met = min(p[1], q[1]), max(p[1], q[1]), False
        for i in np.argsort(low):
            if low[i] > at + slack:
                break
            if high[i] >= at - slack:
                at, met = max(at, high[i]), True
        return bool(met and at >= end - slack)
    here = (x1 > p[0]) & (x0 < q[0])
    x0, x1, a0, b0, a1, b1 = cells[here].T
    left, right = np.maximum(x0, p[0]), np.minimum(x1, q[0])
    y = lambda x: p[1] + (q[1] - p[1]) * (x - p[0]) / (q[0] - p[0])
    edge = lambda v0, v1, x: v0 + (v1 - v0) * (x - x0) / (x1 - x0)
    begin, end = np.zeros(len(x0)), np.ones(len(x0))
    for s, t in ((y(left) - edge(a0, a1, left), y(right) - edge(a0, a1, right)), (edge(b0, b1, left) - y(left), edge(b0, b1, right) - y(right))):
        s, t = s + slack, t + slack  # the part on which the line between s and t is not below zero
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = s / (s - t)
        begin = np.where(s < 0, np.where(t < 0, 2.0, np.maximum(begin, cut)), begin)
        end = np.where((t < 0) & (s >= 0), np.minimum(end, cut), end)
    return bool(np.sum(np.maximum(end - begin, 0) * (right - left)) >= q[0] - p[0] - slack * (1 + len(x0)))
