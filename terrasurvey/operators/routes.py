"""Walking networks and inspection routes: trapezoid cells, shortest paths between terminals, tours, and their checks."""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel
from ..sources.shared import spread, stored
from .ordered import first_entry
from .overlay import passable_cells
from .spatial import cells as grid_cells


CELLS = "site long, cell long, x0 double, x1 double, a0 double, b0 double, a1 double, b1 double"


def walkable_cells(areas: DataFrame, passable: list[str], blocked: list[str], clearance: float = 0.0, study: str | None = None) -> DataFrame:
    """(site, cell, x0, x1, a0, b0, a1, b1): the trapezoids of each site's passable area without its blocked one.

    areas: site, label, ring (array of [x, y]). A cell is convex: between its ends x0 and x1 it reaches from a to b. Blocked shapes keep walkers
    `clearance` metres away; with `study`, only ground within shapes of that label counts, on sites that have any. A site of very many edges
    is swept in columns.
    """

    def around(batches):
        for rows in batches:
            rings = [kernel.buffered(np.vstack([r, r[:1]]), clearance) for r in (np.array([list(p) for p in r]) for r in rows["ring"])]
            yield pd.DataFrame({"site": np.repeat(rows["site"].to_numpy(), [len(r) for r in rings]), "layer": 1, "ring": [c.tolist() for r in rings for c in r]})

    layer = F.when(F.col("label").isin(passable), 0).when(F.col("label").isin(blocked), 1).when(F.col("label") == F.lit(study), 2)
    shapes = areas.select("site", layer.alias("layer"), "ring").where("layer is not null")
    if clearance:
        shapes = shapes.unionByName(shapes.where("layer = 1").select("site", "ring").mapInPandas(around, "site long, layer int, ring array<array<double>>"))
    # a site without a study area is studied everywhere
    free = areas.groupBy("site").agg(F.max(F.when(F.col("label") == F.lit(study), 1).otherwise(0)).alias("studied")) if study else None
    points = F.transform("ring", lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    shapes = shapes.withColumn("ring", points).withColumn("shape", F.monotonically_increasing_id())
    if free is None:
        return passable_cells(shapes, ["site"], lambda on: on[0] and not on[1], 3).select(*[c.split()[0] for c in CELLS.split(", ")])
    both = shapes.join(free, "site")
    some = passable_cells(both.where("studied = 1").drop("studied"), ["site"], lambda on: on[0] and not on[1] and on[2], 3)
    every = passable_cells(both.where("studied = 0").drop("studied"), ["site"], lambda on: on[0] and not on[1], 3)
    return some.unionByName(every).select(*[c.split()[0] for c in CELLS.split(", ")])


def node(x, y):
    return F.named_struct(F.lit("x"), F.round(x, 6), F.lit("y"), F.round(y, 6))


def cell_nodes(cells: DataFrame) -> DataFrame:
    """(site, cell, node, middle): each cell's middle, and the middles of the portals that it shares with cells of the next slab."""
    middle = node((F.col("x0") + F.col("x1")) / 2, (F.col("a0") + F.col("b0") + F.col("a1") + F.col("b1")) / 4)
    left = cells.select("site", F.col("cell").alias("c1"), F.round("x1", 9).alias("x"), F.col("a1").alias("lo1"), F.col("b1").alias("hi1"), middle.alias("m1"))
    right = cells.select("site", F.col("cell").alias("c2"), F.round("x0", 9).alias("x"), F.col("a0").alias("lo2"), F.col("b0").alias("hi2"), middle.alias("m2"))
    shared = left.join(right, ["site", "x"]).withColumn("lo", F.greatest("lo1", "lo2")).withColumn("hi", F.least("hi1", "hi2")).where("hi - lo > 1e-7")
    sides = F.explode(F.array(F.struct(F.col("c1").alias("cell"), F.col("m1").alias("m")), F.struct(F.col("c2").alias("cell"), F.col("m2").alias("m"))))
    portals = shared.select("site", node(F.col("x"), (F.col("lo") + F.col("hi")) / 2).alias("node"), sides.alias("s"))
    return portals.select("site", "s.cell", "node", F.col("s.m").alias("middle")).distinct().union(cells.select("site", "cell", middle.alias("node"), middle.alias("middle")))


def apart(a: str, b: str):
    return F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))


def network(cells: DataFrame) -> DataFrame:
    """(site, a, b, length): edges from each cell's middle to the portals it shares with cells of the next slab. Nodes are struct<x, y>."""
    nodes = cell_nodes(cells).where("node != middle")
    return nodes.select("site", F.col("middle").alias("a"), F.col("node").alias("b"), apart("middle", "node").alias("length")).distinct()


def attached(cells: DataFrame, terminals: DataFrame, slack: float = 1e-7, nudge: float = 1e-6, grid: float = 16.0) -> DataFrame:
    """(site, terminal, a, b, length): edges that join terminals (site, terminal, x, y) to the nodes of the cells they lie in, and to each other there.

    A cell holds a terminal within `slack`, which must never bridge a gap. A terminal that is outside all cells by less than that moves `nudge`
    towards the middle of its cell, but the start (terminal 0) never moves. One that no cell holds is an error. Terminals and cells meet in squares
    of `grid` metres, so that a terminal is held against the cells around it only.
    """
    x, y = F.col("x"), F.col("y")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x0")) / (F.col("x1") - F.col("x0"))))
    low, high = F.col("a0") + (F.col("a1") - F.col("a0")) * share, F.col("b0") + (F.col("b1") - F.col("b0")) * share
    within = lambda by: x.between(F.col("x0") - by, F.col("x1") + by) & y.between(low - by, high + by)
    middles = cell_nodes(cells).where("node = middle").select("site", "cell", "middle")
    squares = lambda low, high: F.explode(grid_cells(low - slack, high + slack, grid))
    around = cells.withColumn("_cx", squares(F.col("x0"), F.col("x1"))).withColumn("_cy", squares(F.least("a0", "a1"), F.greatest("b0", "b1")))
    placed = terminals.withColumn("_cx", F.floor(x / grid).cast("long")).withColumn("_cy", F.floor(y / grid).cast("long"))
    near = placed.join(around, ["site", "_cx", "_cy"]).drop("_cx", "_cy").where(within(slack)).withColumn("inside", within(0.0)).join(middles, ["site", "cell"])
    gap = F.hypot(F.col("middle.x") - x, F.col("middle.y") - y)
    part = F.when(F.col("inside") | (F.col("terminal") == 0) | (gap == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), nudge / gap))
    moved = near.select("site", "cell", "terminal", "inside", "x", "y", (x + (F.col("middle.x") - x) * part).alias("mx"), (y + (F.col("middle.y") - y) * part).alias("my"))
    one = Window.partitionBy("site", "terminal")
    stays, nearest = F.max("inside").over(one), one.orderBy("cell")
    held = moved.select("site", "cell", "terminal", *[F.when(stays, F.col(c)).otherwise(F.first(f"m{c}").over(nearest)).alias(f"a{c}") for c in "xy"])
    held = held.select("site", "cell", "terminal", F.named_struct(F.lit("x"), F.col("ax"), F.lit("y"), F.col("ay")).alias("at"))
    other = cell_nodes(cells).select("site", "cell", F.col("node").alias("b")).union(held.select("site", "cell", F.col("at").alias("b")))
    links = held.join(other, ["site", "cell"]).where("at != b").select("site", "terminal", F.col("at").alias("a"), "b", apart("at", "b").alias("length")).distinct()
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("a terminal lies in no cell"))).alias(c)
    return terminals.select("site", "terminal").join(links, ["site", "terminal"], "left").select("site", "terminal", known("a"), known("b"), "length")


def with_terminals(cells: DataFrame, terminals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, terminals): the network with the terminals as nodes of their own, and where these are."""
    links = stored(attached(cells, terminals))
    edges = network(cells).union(links.drop("terminal"))
    return edges, links.select("site", "terminal", F.col("a.x").alias("x"), F.col("a.y").alias("y")).distinct()


def shortest(edges: dict, start) -> dict:
    """Distances from one node (Dijkstra)."""
    best, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        d, u = heapq.heappop(queue)
        if d > best[u]:
            continue
        for v, w in edges.get(u, ()):
            if d + w < best.get(v, np.inf):
                best[v] = d + w
                heapq.heappush(queue, (d + w, v))
    return best


def path_lengths(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(site, source, target, metres) of the shortest paths between a site's terminals (site, terminal, x, y), which are nodes of it (see with_terminals).

    A network belongs to one site; its terminals are capped (at most 201), as a tour's are.
    """

    def run(key, graph: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        nodes: dict = {}
        links: dict = {}
        for r in graph.itertuples():
            a, b = (nodes.setdefault((p["x"], p["y"]), len(nodes)) for p in (r.a, r.b))
            links.setdefault(a, []).append((b, r.length))
            links.setdefault(b, []).append((a, r.length))
        out = []
        if nodes and len(ends):
            if len(ends) > 201:
                raise ValueError("more than 200 targets and a start")
            at = [(t.terminal, nodes.get((t.x, t.y))) for t in ends.itertuples()]
            if any(i is None for _, i in at):
                raise ValueError(f"a terminal of site {key[0]} is no node of its network")
            for source, i in at:
                reach = shortest(links, i)
                out += [(key[0], source, target, reach[j]) for target, j in at if j in reach and target != source]
        return pd.DataFrame(out, columns=["site", "source", "target", "metres"])

    return edges.groupBy("site").cogroup(terminals.groupBy("site")).applyInPandas(run, "site long, source long, target long, metres double")


def length_of(order: list[int], distance: np.ndarray) -> float:
    return float(distance[order, [*order[1:], order[0]]].sum())


def neighbours(d: np.ndarray, most: int = 10) -> np.ndarray:
    """Of each stop the nearest others."""
    return np.argsort(d + np.diag(np.full(len(d), np.inf)), axis=1, kind="stable")[:, : min(most, len(d) - 1)]


def settled(order: np.ndarray, d: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """A closed tour after the best of all reversals of a part and moves of up to three stops that join a stop to a near one, as long as one shortens it."""
    n = len(order)
    near = neighbours(d) if near is None else near
    at = np.arange(n)
    while True:
        before, after = np.roll(order, 1), np.roll(order, -1)
        place = np.empty(n, int)
        place[order] = at
        # a reversal of the stops from i to j joins before[i] with order[j], and order[i] with after[j]
        i = np.repeat(at, near.shape[1])
        best, move = 1e-9, None
        for j in (place[near[before]].ravel(), place[near[order]].ravel() - 1):
            ok = (i > 0) & (j > i)
            p, q = i[ok], j[ok]
            gain = d[before[p], order[p]] + d[order[q], after[q]] - d[before[p], order[q]] - d[order[p], after[q]]
            k = int(np.argmax(gain)) if len(gain) else -1
            if k >= 0 and gain[k] > best:
                best, move = gain[k], ("turn", int(p[k]), int(q[k]))
        for m in (1, 2, 3):
            if n - m < 3:
                continue
            first = np.arange(1, n - m + 1)  # the start stays
            last = first + m - 1
            beyond = order[(last + 1) % n]
            saved = (d[order[first - 1], order[first]] + d[order[last], beyond] - d[order[first - 1], beyond])[:, None]
            for flip in (False, True):
                head, tail = (order[last], order[first]) if flip else (order[first], order[last])
                gap = np.hstack([place[near[head]], (place[near[tail]] - 1) % n])  # between a stop and the next one
                cost = d[order[gap], head[:, None]] + d[tail[:, None], after[gap]] - d[order[gap], after[gap]]
                worth = np.where((gap >= first[:, None] - 1) & (gap <= last[:, None]), -np.inf, saved - cost)
                k = int(np.argmax(worth))
                if worth.flat[k] > best + 1e-12:
                    r, c = divmod(k, gap.shape[1])
                    best, move = worth.flat[k], ("move", int(first[r]), m, int(gap[r, c]), flip)
        if move is None:
            return order
        if move[0] == "turn":
            order = order.copy()
            order[move[1] : move[2] + 1] = order[move[1] : move[2] + 1][::-1]
        else:
            _, a, m, gap, flip = move
            part = order[a : a + m][::-1] if flip else order[a : a + m]
            rest = np.delete(order, np.arange(a, a + m))
            gap = gap if gap < a else gap - m
            order = np.concatenate((rest[: gap + 1], part, rest[gap + 1 :]))


def tour(distance: np.ndarray, rounds: int = 150, share: float = 1.0) -> tuple[list[int], float, float]:
    """(order, length, nearest-neighbour length) of a closed tour from node 0: nearest neighbour, local search, and guided local search.

    Once no move shortens the tour, those of its edges that are long for the penalties they have get one more, lengths plus penalties are
    searched again, and the shortest tour of all rounds counts; `share` of a mean edge is a penalty's weight. Distances are the same both ways.
    """
    n = len(distance)
    order, left = [0], set(range(1, n))
    while left:
        k = min(left, key=lambda j: (distance[order[-1], j], j))
        order.append(k)
        left.remove(k)
    base = length_of(order, distance)
    if n < 4:
        return order, base, base
    near = neighbours(distance)
    now = settled(np.array(order), distance, near)
    best, least = now, length_of(now.tolist(), distance)
    penalties, weight = np.zeros((n, n)), share * least / n
    for _ in range(rounds):
        a, b = now, np.roll(now, -1)
        worth = distance[a, b] / (1 + penalties[a, b])
        worst = np.flatnonzero(worth >= worth.max() - 1e-12)
        penalties[a[worst], b[worst]] += 1
        penalties[b[worst], a[worst]] = penalties[a[worst], b[worst]]
        now = settled(now, distance + weight * penalties, near)
        found = settled(now, distance, near)
        size = length_of(found.tolist(), distance)
        if size < least - 1e-9:
            best, least = found, size
    return best.tolist(), least, base


def tours(lengths: DataFrame, start: int = 0) -> DataFrame:
    """(site, stop_order, terminal, length_m, baseline_m): each site's closed tour over the terminals that its start reaches; never longer than the baseline."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        reach = sorted(set(rows.loc[rows["source"] == start, "target"]))
        names = [start, *reach]
        at = {t: i for i, t in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        np.fill_diagonal(d, 0)
        for r in rows.itertuples():
            if r.source in at and r.target in at:
                d[at[r.source], at[r.target]] = round(r.metres, 3)
        order, best, base = tour(d)
        return pd.DataFrame({"site": rows["site"].iloc[0], "stop_order": range(len(order)), "terminal": [names[i] for i in order], "length_m": best, "baseline_m": base})

    return lengths.groupBy("site").applyInPandas(run, "site long, stop_order int, terminal long, length_m double, baseline_m double")


def expanded(edges: DataFrame, legs: DataFrame, cells: DataFrame, ahead: int = 100) -> DataFrame:
    """(site, leg, points, metres): the path of each leg (site, leg, a, b) between two nodes, with shortcuts.

    The shortest path's nodes are followed; from each one the farthest of the next `ahead` nodes is taken to which a straight line stays on
    walkable ground, borders included. Legs without a path are an error.
    """
    both = edges.select("site", F.lit(-1).cast("long").alias("leg"), "a", "b", "length").union(legs.select("site", "leg", "a", "b", F.lit(0.0).alias("length")))

    def run(key, rows: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        at = lambda p: (p["x"], p["y"])
        for r in rows[rows["leg"] < 0].itertuples():
            links.setdefault(at(r.a), []).append((at(r.b), r.length))
            links.setdefault(at(r.b), []).append((at(r.a), r.length))
        shape, out = ground[["x0", "x1", "a0", "b0", "a1", "b1"]].to_numpy(), []
        reach: dict = {}
        for r in rows[rows["leg"] >= 0].sort_values("leg").itertuples():
            a, b = at(r.a), at(r.b)
            if a not in reach:
                reach[a] = shortest(links, a)
            if b not in reach[a]:
                raise ValueError("a leg has no path")
            path = [b]
            while path[-1] != a:  # back along the distances
                path.append(min(links[path[-1]], key=lambda e: (reach[a].get(e[0], np.inf) + e[1], e[0]))[0])
            path, short = path[::-1], [a]
            i = 0
            while i < len(path) - 1:
                end = min(i + ahead, len(path) - 1)
                while end > i + 1 and not kernel.covers_line(shape, np.array(path[i]), np.array(path[end])):
                    end -= 1
                short.append(path[end])
                i = end
            metres = float(sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(short, short[1:], strict=False)))
            out.append((key[0], r.leg, [{"x": x, "y": y} for x, y in short], metres))
        return pd.DataFrame(out, columns=["site", "leg", "points", "metres"])

    ground = cells.toDF(*cells.columns)  # columns of their own: edges come from the same cells
    return both.groupBy("site").cogroup(ground.groupBy("site")).applyInPandas(run, "site long, leg long, points array<struct<x:double,y:double>>, metres double")


def legs_of(stops: DataFrame, places: DataFrame) -> DataFrame:
    """(site, leg, a, b) of closed tours (site, stop_order, terminal): from each stop to the next, and from the last one back to the first."""
    at = stops.join(places.select("site", "terminal", F.struct("x", "y").alias("a")), ["site", "terminal"])
    order = Window.partitionBy("site").orderBy("stop_order")
    first = F.first("a").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return at.select("site", F.col("stop_order").cast("long").alias("leg"), "a", F.coalesce(F.lead("a").over(order), first).alias("b")).where("a != b")


def route_lines(paths: DataFrame) -> DataFrame:
    """(site, points, length_m): the legs' points one after the other, each place once in a row."""
    both = paths.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("leg", "points"))).alias("legs"), F.sum("metres").alias("length_m"))
    joined = F.flatten(F.transform("legs", lambda x, i: F.when(i == 0, x["points"]).otherwise(F.slice(x["points"], 2, F.size(x["points"])))))
    return both.select("site", joined.alias("points"), "length_m")


def planned(ground: DataFrame, terminals: DataFrame, permitted: DataFrame, radius: float = 2.0) -> DataFrame:
    """(site, points, length_m, baseline_m, outside_m, stops): each site's route, checked, with its stops (stop_order, terminal, distance_m) in the order met.

    ground: walkable cells; terminals: site, terminal (0 is the start), x, y; permitted: site, ring, all that may be walked on. Terminals are attached to their
    cells, the tour over the paths between them is expanded with shortcuts, and a stop counts where the route first comes within `radius` of it, also on the way
    to another one. A route that leaves permitted ground, or misses a terminal that its start reaches, is an error.
    """
    edges, places = with_terminals(ground, terminals)
    order = stored(tours(path_lengths(edges, places)))
    lines = stored(route_lines(expanded(edges, legs_of(order, places), ground)))
    path = lines.select(F.col("site").alias("route_id"), F.posexplode("points").alias("at", "p")).select("route_id", "at", "p.x", "p.y")
    goals = order.where("terminal <> 0").select("site", "terminal").join(places, ["site", "terminal"])
    met = first_entry(path, goals.select(F.col("site").alias("route_id"), F.col("terminal").alias("target_id"), "x", "y"), radius)
    met = goals.select("site", "terminal").join(met.select(F.col("route_id").alias("site"), F.col("target_id").alias("terminal"), "distance_m"), ["site", "terminal"], "left")
    missed = F.when(F.col("distance_m").isNull(), F.raise_error(F.concat(F.lit("a stop is missed: "), F.col("terminal").cast("string"))).cast("double")).otherwise(F.col("distance_m"))
    met = met.withColumn("distance_m", missed).withColumn("stop_order", F.row_number().over(Window.partitionBy("site").orderBy("distance_m", "terminal")))
    stops = met.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("stop_order", "terminal", "distance_m"))).alias("stops"))
    beyond = outside(lines.select("site", F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("line")), permitted)
    checked = F.when(F.col("outside_m") > 1e-6, F.raise_error(F.lit("the route leaves permitted ground")).cast("double")).otherwise(F.col("outside_m"))
    base = order.groupBy("site").agg(F.max("baseline_m").alias("baseline_m"))
    whole = lines.join(beyond.select("site", checked.alias("outside_m")), "site").join(base, "site").join(stops, "site", "left")
    return whole.select("site", "points", "length_m", "baseline_m", "outside_m", "stops")


def road_areas(lines: DataFrame, polygons: DataFrame, half_width: float = 1.5) -> DataFrame:
    """(site, label, ring): roads as passages: the ground within half_width of lines (site, line), and polygons (site, ring) as they are."""

    def run(batches):
        for rows in batches:
            out = [(site, ring.tolist()) for site, line in zip(rows["site"], rows["line"], strict=True) for ring in kernel.buffered(np.array([list(p) for p in line]), half_width)]
            yield pd.DataFrame(out, columns=["site", "ring"])

    wide = lines.select("site", "line").mapInPandas(run, "site long, ring array<array<double>>")
    return wide.unionByName(polygons.select("site", "ring")).select("site", F.lit("passage").alias("label"), "ring")


def corridors(strips: DataFrame, reach: float = 10.0) -> DataFrame:
    """(site, label, ring): strips (site, ring) prolonged by `reach` past both ends, as wide as they are, whatever their direction."""

    def run(batches):
        for rows in batches:
            out = [(site, kernel.corridor(np.array([list(p) for p in ring]), reach)) for site, ring in zip(rows["site"], rows["ring"], strict=True)]
            yield pd.DataFrame([(site, ring.tolist()) for site, ring in out if ring is not None], columns=["site", "ring"])

    # strips are few bytes and much work, so they are dealt to all tasks
    return spread(strips.select("site", "ring"), "site").mapInPandas(run, "site long, ring array<array<double>>").select("site", F.lit("passage").alias("label"), "ring")


def cells_with_access(areas: DataFrame, roads: DataFrame, strips: DataFrame, passable: list[str], blocked: list[str], reach: float = 10.0, most: int = 100_000) -> DataFrame:
    """Walkable cells of areas with roads and prolonged strips as further passages; sites that get more than `most` cells are made without the strips."""
    whole = stored(walkable_cells(areas.unionByName(roads).unionByName(corridors(strips, reach)), passable, blocked))
    heavy = whole.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") > most).select("site")
    less = walkable_cells(areas.unionByName(roads).join(heavy, "site", "left_semi"), passable, blocked)
    return whole.join(heavy, "site", "left_anti").unionByName(less)


def headland_areas(blocks: DataFrame, rows: DataFrame, overlap: float = 0.25) -> DataFrame:
    """(site, label, ring): the ground of each block (site, ring) between its border and the hull of its rows (site, line), as passages.

    The hull is taken `overlap` smaller, so that headlands reach the lanes' ends. A block with fewer than two rows, with rows that leave it or that
    lie on one line is an error.
    """

    def run(key, block: pd.DataFrame, axes: pd.DataFrame) -> pd.DataFrame:
        out = []
        points = [np.array([list(p) for p in line]) for line in axes["line"]]
        for ring in block["ring"]:
            ring = np.array([list(p) for p in ring])
            if len(points) < 2:
                raise ValueError(f"block {key[0]} needs two rows")
            ground = np.array([(x0, x1, *t) for x0, x1, pieces in kernel.slabs([[ring]], lambda on: on[0]) for t in [(a0, b0, a1, b1) for a0, b0, a1, b1 in pieces]])
            if not all(kernel.covers_line(ground, p, q) for line in points for p, q in zip(line[:-1], line[1:], strict=True)):
                raise ValueError(f"rows leave block {key[0]}")
            foot = kernel.hull(np.vstack(points))
            if len(foot) < 3:
                raise ValueError(f"the rows of block {key[0]} lie on one line")
            inner = kernel.inset(foot, overlap)
            for x0, x1, pieces in kernel.slabs([[ring], [inner] if len(inner) else []], lambda on: on[0] and not on[1]):
                out += [(key[0], [[x0, a0], [x1, a1], [x1, b1], [x0, b0]]) for a0, b0, a1, b1 in pieces]
        return pd.DataFrame(out, columns=["site", "ring"])

    found = blocks.groupBy("site").cogroup(rows.groupBy("site")).applyInPandas(run, "site long, ring array<array<double>>")
    return found.select("site", F.lit("passage").alias("label"), "ring")


def outside(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """(site, length_m, outside_m) of each site's line (site, line) against its rings (site, ring)."""

    def run(key, line: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
        polygons = [np.array([list(p) for p in r]) for r in rings["ring"]]
        out = []
        for p in line["line"]:
            points = np.array([list(q) for q in p])
            whole = float(np.hypot(*np.diff(points, axis=0).T).sum())
            out.append((key[0], whole, whole - kernel.line_inside(points, polygons)))
        return pd.DataFrame(out, columns=["site", "length_m", "outside_m"])

    return lines.groupBy("site").cogroup(areas.groupBy("site")).applyInPandas(run, "site long, length_m double, outside_m double")


def snapped_start(start: DataFrame, nodes: DataFrame, most: float = 5.0) -> DataFrame:
    """(site, x, y, connector_m): the network's node nearest to each start; an error beyond `most` metres. They meet in squares of `most` metres."""
    x, y = F.col("x"), F.col("y")
    d = F.hypot(x - F.col("nx"), y - F.col("ny"))
    squares = lambda c: F.explode(grid_cells(c - most, c + most, most))
    around = start.withColumn("_cx", squares(x)).withColumn("_cy", squares(y))
    placed = nodes.select("site", x.alias("nx"), y.alias("ny"), F.floor(x / most).cast("long").alias("_cx"), F.floor(y / most).cast("long").alias("_cy"))
    best = around.join(placed, ["site", "_cx", "_cy"]).groupBy("site").agg(F.min(F.struct(d.alias("d"), "nx", "ny")).alias("b"))
    far = F.raise_error(F.lit("the start is too far from the network")).cast("double")
    return start.select("site").join(best, "site", "left").select("site", F.col("b.nx").alias("x"), F.col("b.ny").alias("y"), F.when(F.col("b.d") <= most, F.col("b.d")).otherwise(far).alias("connector_m"))


def shifted_stops(stops: DataFrame, connector: DataFrame) -> DataFrame:
    """Stops with their distances moved on by the connector that leads to the start."""
    return stops.join(connector.select("site", "connector_m"), "site").withColumn("distance_m", F.col("distance_m") + F.col("connector_m")).drop("connector_m")


def unique_ids(*sets: DataFrame) -> DataFrame:
    """The ids of all sets, or an error if one occurs twice."""
    both = sets[0].select("id")
    for s in sets[1:]:
        both = both.unionByName(s.select("id"))
    n = F.count("*").over(Window.partitionBy("id"))
    return both.select(F.when(n == 1, F.col("id")).otherwise(F.raise_error(F.lit("an id occurs twice")).cast("long")).alias("id"))
