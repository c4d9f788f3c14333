"""Graph traversals: level by level, each level a join of the frontier with the edges and an anti-join with what is known.

Edges are (src, dst). All start points of a call go through one loop, keyed by their own name, so many cost as many
levels as one. No level is collected; a hub's edges are joined in parts where the engine finds them skewed.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import settled


#: Levels after which the union of levels is written as one table.
LEVELS = 32
#: Edges of a graph that one task takes at once, numbers all; a larger one is first made smaller by all tasks.
FEW = 1 << 20
#: Edges a node in the part of a dense graph that is looked at first: enough for most of a component to hang together.
SHARE = 3


class BudgetExceeded(Exception):
    """A traversal met more nodes than it may; nothing partial is returned."""


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 20, max_nodes: int | None = None, ready: bool = False) -> DataFrame:
    """(seed, sym, depth): least depth of each node from each seed; a seed is at depth 0. seeds: (seed, sym).

    Levels up to max_depth are wanted; with None, all there are. ready: the edges are written already and are walked as
    they are; the few that repeat cost a row each and change nothing, as each level is made distinct.
    """
    return _walk(edges.select("src", "dst") if ready else settled(edges.select("src", "dst").distinct()), settled(seeds.select("seed", "sym", F.lit(0).alias("depth")).distinct()), max_depth, max_nodes)


def _walk(edges: DataFrame, known: DataFrame, max_depth: int | None, max_nodes: int | None = None) -> DataFrame:
    """reach over edges and from start points that are written."""
    frontier = known
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.join(edges, frontier["sym"] == edges["src"]).select("seed", F.col("dst").alias("sym")).distinct()
        new = new.join(known.select("seed", "sym"), ["seed", "sym"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = settled(new)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % LEVELS == 0:
            known = settled(known)
        if max_nodes is not None and known.count() > max_nodes:
            raise BudgetExceeded(f"more than {max_nodes} nodes at depth {depth}")
    return known


def reach_from(edges: DataFrame, sources: DataFrame, max_depth: int | None = 20, ready: bool = False) -> DataFrame:
    """(sym, depth) from a set of sources (sym) taken together."""
    return reach(edges, sources.select(F.lit(0).alias("seed"), "sym"), max_depth, ready=ready).select("sym", "depth")


def reach_by(edges: DataFrame, into: DataFrame, out: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, sym, depth): reach, all levels, where a step is an edge, or a way (src, node) into a node and one (node, dst) out of it.

    A node is gone through once for a seed, when it is first met: later it leads nowhere sooner.
    """
    edges, into, out = settled(edges.select("src", "dst").distinct()), settled(into), settled(out)
    known = settled(seeds.select("seed", "sym", F.lit(0).alias("depth")).distinct())
    frontier, met = known, None
    for depth in count(1):
        nodes = frontier.join(into, frontier["sym"] == into["src"]).select("seed", "node").distinct()
        nodes = settled(nodes if met is None else nodes.join(met, ["seed", "node"], "left_anti"))
        met = nodes if met is None else met.unionByName(nodes)
        new = frontier.join(edges, frontier["sym"] == edges["src"]).select("seed", F.col("dst").alias("sym"))
        new = new.unionByName(nodes.join(out, "node").select("seed", F.col("dst").alias("sym"))).distinct()
        frontier = settled(new.join(known.select("seed", "sym"), ["seed", "sym"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % LEVELS == 0:
            known, met = settled(known), settled(met)
    return known


def roots(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Members (sym) that no edge enters."""
    return members.select("sym").join(edges.select(F.col("dst").alias("sym")), "sym", "left_anti").distinct()


def seeds_reach(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """(seed, hit): whether any of a seed's symbols reaches a target."""
    known = reach(edges, seeds, max_depth)
    hit = known.join(targets.select("sym").distinct(), "sym", "left_semi").select("seed").distinct().withColumn("hit", F.lit(True))
    return seeds.select("seed").distinct().join(hit, "seed", "left").select("seed", F.coalesce("hit", F.lit(False)).alias("hit"))


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int | None = 20) -> list[str]:
    """A shortest path by least predecessors, empty if there is none; a start is never its own goal.

    Only the path comes to the driver: a symbol for each level back.
    """
    known = reach_from(edges, edges.sparkSession.createDataFrame([(start,)], "sym string"), max_depth)
    if start == goal:
        return []
    found = known.where(F.col("sym") == goal).first()
    if found is None:
        return []
    path = [goal]
    for depth in range(found["depth"] - 1, -1, -1):
        before = edges.where(F.col("dst") == path[0]).join(known.where(F.col("depth") == depth), F.col("src") == F.col("sym"))
        path.insert(0, before.agg(F.min("src")).first()[0])
    return path


def carried(edges: DataFrame, seeds: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """(sym, depth, loops, via): least depth, with the loop nesting and handoff tag of the least edge of that depth.

    edges: (src, dst, in_loop, tag, line). Inherited: loops adds one at each looped edge, a tag stays once met.
    """
    edges = settled(edges)
    known = settled(seeds.select("sym", F.lit(0).alias("depth"), F.lit(0).alias("loops"), F.lit(None).cast("string").alias("via")).distinct())
    frontier = known
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["sym"] == edges["src"])
        best = step.groupBy("dst").agg(F.min(F.struct(F.col("src"), F.col("line"), (F.col("loops") + F.col("in_loop").cast("int")).alias("loops"), F.coalesce("via", "tag").alias("via"))).alias("b"))
        new = best.join(known.select(F.col("sym").alias("dst")), "dst", "left_anti")
        frontier = settled(new.select(F.col("dst").alias("sym"), F.lit(depth).alias("depth"), F.col("b.loops").alias("loops"), F.col("b.via").alias("via")))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def nearest(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, sym, depth, origin): for each label (seed) the least number of steps from a node to a source (seed, sym) of
    it, and the least such source. One row a label and node: what many start points reach isn't listed for each of them."""
    edges = settled(edges.select("src", "dst").distinct())
    known = settled(sources.select("seed", "sym", F.lit(0).alias("depth"), F.col("sym").alias("origin")).distinct())
    frontier = known
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.join(edges, frontier["sym"] == edges["dst"]).groupBy("seed", F.col("src").alias("sym")).agg(F.min("origin").alias("origin"))
        new = new.join(known.select("seed", "sym"), ["seed", "sym"], "left_anti")
        frontier = settled(new.select("seed", "sym", F.lit(depth).alias("depth"), "origin"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % LEVELS == 0:
            known = settled(known)
    return known


def _coded(edges: DataFrame, symbols: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sym, id) and edges of ids: symbols by 64-bit hashes, which move and compare cheaper; no two symbols share one.

    symbols (sym): where it is known which there are, so that they needn't be gathered from the edges' ends.
    """
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    symbols = (ends.select(F.explode(F.array("src", "dst")).alias("sym")) if symbols is None else symbols).distinct()
    for salt in count():
        code = lambda c: F.xxhash64(F.lit(salt), c)  # noqa: B023, E731
        names = settled(symbols.select("sym", code("sym").alias("id")))
        if names.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return names, settled(ends.select(code("src").alias("src"), code("dst").alias("dst")).distinct())


def _components(batches):
    """(sym, scc) of all nodes of a graph (src, dst) of at most FEW edges: Tarjan's walk, with a stack of its own."""
    import numpy as np
    import pyarrow as pa

    table = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not table:
        return
    src, dst = (np.concatenate(x) for x in zip(*table))
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d, n = at[: len(src)], at[len(src):], len(ids)
    below = d[np.argsort(s, kind="stable")].tolist()
    first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))]).tolist()
    # 0: not met; n + 1: in a component already.
    met, low, place, scc, held, clock = [0] * n, [0] * n, first[:n], [0] * n, [], 0
    for root in range(n):
        if met[root]:
            continue
        way = [root]
        while way:
            v = way[-1]
            if not met[v]:
                clock += 1
                met[v] = low[v] = clock
                held.append(v)
            if place[v] < first[v + 1]:
                w = below[place[v]]
                place[v] += 1
                if not met[w]:
                    way.append(w)
                elif met[w] <= n and met[w] < low[v]:
                    low[v] = met[w]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == met[v]:
                while True:
                    w = held.pop()
                    scc[w], met[w] = v, n + 1
                    if w == v:
                        break
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[np.asarray(scc)])], ["sym", "scc"])


def _coloured(left: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """A round of colouring: (sym, scc) of some components, and the edges within colours; other edges are on no cycle.

    Each node takes the least id that leads to it; a node that is its own colour and what leads to it within that colour
    are a component. Only nodes whose colour has changed pass it on. With least, no more is done when so few nodes still
    change, and as many steps back: then what is found are parts of components, and the edges mean nothing.
    """
    colour = settled(left.select(F.explode(F.array("src", "dst")).alias("sym")).distinct().select("sym", F.col("sym").alias("colour")))
    moved = colour
    for rounds in count(1):
        led = left.join(moved, F.col("src") == F.col("sym")).groupBy("dst").agg(F.min("colour").alias("led"))
        new = settled(colour.join(led, F.col("sym") == F.col("dst"), "left").select("sym", F.least("colour", "led").alias("colour"), F.coalesce(F.col("led") < F.col("colour"), F.lit(False)).alias("moved")))
        colour, moved = new.select("sym", "colour"), settled(new.where("moved").select("sym", "colour"))
        if moved.count() <= least:
            break
    ends = left.join(colour.select(F.col("sym").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("sym").alias("dst"), F.col("colour").alias("b")), "dst")
    same = settled(ends.where("a = b").select("src", "dst"))
    starts = settled(colour.where("sym = colour").select(F.col("sym").alias("seed"), "sym", F.lit(0).alias("depth")))
    return settled(_walk(reversed_edges(same), starts, rounds if least else None).select("sym", F.col("seed").alias("scc"))), same


def _in_one(left: DataFrame) -> DataFrame:
    return settled(left.repartition(1).mapInArrow(_components, "sym long, scc long"))


def _folded(left: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """A dense graph of ids, its nodes folded to components that a part of its edges shows already; and these, (sym, scc)
    of two nodes or more, scc one of them, each fold's by itself.

    Components of some of the edges lie within those of all, so that most of a large one is one node before all edges are
    gone through: that is done once a fold, not once a round. The part is told by hashes; nothing is left out, as what it
    doesn't show is left in the graph that is returned.
    """
    folds: list[DataFrame] = []
    while True:
        size, nodes = left.agg(F.count(F.lit(1)), F.approx_count_distinct("src")).first()
        part = max(SHARE * nodes, min(FEW, size // 4))
        if size <= FEW or part * 3 > size * 2:
            return left, folds
        some = settled(left.where(F.pmod(F.xxhash64(F.lit(len(folds)), "dst", "src"), F.lit(1 << 20)) < F.lit((part << 20) // size)))
        found = _in_one(some) if some.count() <= FEW else _coloured(some, max(1, nodes // 64))[0]
        found = settled(found.join(found.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "scc", "left_semi").select("sym", "scc"))
        if found.isEmpty():
            return left, folds
        ends = left
        for c in ("src", "dst"):
            ends = ends.join(found.select(F.col("sym").alias(c), F.col("scc").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c))
        left = settled(ends.where("src <> dst").select("src", "dst").distinct())
        folds.append(found)
        # Each fold has to pay for the pass that it takes.
        if left.count() * 2 > size:
            return left, folds


def _strong(left: DataFrame) -> DataFrame:
    """(sym, scc) of the nodes on a cycle of a graph of ids, scc being any id for each component.

    A dense graph is folded first. Then, in rounds, what has no way in or out goes, and the rest is coloured. As soon as no
    more than FEW edges are left, one task takes them, so that the last small rounds don't each cost jobs.
    """
    loops = left.where("src = dst").select(F.col("src").alias("sym"))
    left, folds = _folded(left)
    out, thorough = None, False
    add = lambda more: more if out is None else out.unionByName(more)
    while True:
        size = left.count()
        while size > FEW:
            ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = settled(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
            before, size = size, left.count()
            # Next to nothing goes: the rest is colour's to part, unless that parted little before.
            if before - size <= (0 if thorough else before // 64):
                break
        if size <= FEW:
            if size:
                out = add(_in_one(left))
            break
        found, same = _coloured(left)
        out = add(found)
        gone = found.select("sym")
        left = settled(same.join(gone.select(F.col("sym").alias("src")), "src", "left_anti").join(gone.select(F.col("sym").alias("dst")), "dst", "left_anti"))
        thorough = left.count() * 2 > size
    for fold in reversed(folds):
        if out is None:
            out = fold
            continue
        # What holds of the node that stood for a component holds of all its nodes, itself included.
        whole = out.select(F.col("sym").alias("scc"), F.col("scc").alias("of"))
        out = fold.join(whole, "scc", "left").select("sym", F.coalesce("of", "scc").alias("scc")).unionByName(out.join(fold.select("sym"), "sym", "left_anti").select("sym", "scc"))
    if out is None:
        return left.select(F.col("src").alias("sym"), F.col("dst").alias("scc"))
    many = out.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    # One node by itself is on a cycle only if it calls itself.
    kept = out.join(many, "scc").join(loops.withColumn("itself", F.lit(True)), "sym", "left").where("n > 1 or itself")
    return settled(kept.select("sym", "scc"))


def strong(edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(sym, scc): the nodes on a cycle, with the least symbol of their strongly connected component.

    No node's reach is listed, so that the work grows with the edges, not with the pairs of nodes. symbols (sym): all ends
    of edges, and maybe more, where they are known.
    """
    names, left = _coded(edges, symbols)
    found = settled(_strong(left).select(F.col("sym").alias("id"), F.col("scc").alias("of")).join(names, "id").select("sym", "of"))
    return settled(found.join(found.groupBy("of").agg(F.min("sym").alias("scc")), "of").select("sym", "scc"))


def cycles(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(cycle, sym): the strongly connected components that hold a marked edge (src, dst); cycle is their least symbol."""
    scc = strong(edges)
    closed = marked.select("src", "dst").distinct().join(scc.select(F.col("sym").alias("src"), "scc"), "src").join(scc.select(F.col("sym").alias("dst"), F.col("scc").alias("of_dst")), "dst")
    held = closed.where("scc = of_dst").select("scc").distinct()
    return scc.join(held, "scc", "left_semi").select(F.col("scc").alias("cycle"), "sym")


def longest_chain(anchors: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(sym, degree, next): weight of a node plus the most that a successor has, and the least such successor, so that a
    chain can be followed; -1 and no next for what is on, or leads into, a cycle.

    anchors: (sym, weight). edges: between anchors. What is on no cycle is a finite chain, so values settle; more rounds
    than the given number raise, and nothing partial is returned.
    """
    names, left = _coded(edges)
    looped = _strong(left).select(F.lit(0).alias("seed"), "sym", F.lit(0).alias("depth"))
    ends = settled(_walk(reversed_edges(left), settled(looped.distinct()), None).select("sym"))
    free = left.join(ends.select(F.col("sym").alias("src")), "src", "left_anti")
    named = lambda c: names.select(F.col("id").alias(c), F.col("sym").alias(f"_{c}"))
    free = settled(free.join(named("src"), "src").join(named("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    endless = settled(ends.withColumnRenamed("sym", "id").join(names, "id").select("sym"))
    value = settled(anchors.select("sym", F.col("weight").cast("long").alias("degree"), F.lit(None).cast("string").alias("next")))
    # Only what has successors on no cycle can have another value than its weight.
    heads = settled(anchors.join(free.select(F.col("src").alias("sym")).distinct(), "sym", "left_semi").select("sym", "weight"))
    known = value.join(free.select(F.col("dst").alias("sym")).distinct(), "sym", "left_semi").unionByName(value.join(heads, "sym", "left_semi").select(*value.columns)).distinct()
    known = settled(known.select("sym", "degree", "next"))
    for _ in count() if rounds is None else range(rounds):
        best = free.join(known.select(F.col("sym").alias("dst"), "degree"), "dst").groupBy("src").agg(F.min(F.struct((-F.col("degree")).alias("less"), F.col("dst"))).alias("b"))
        better = best.join(heads, F.col("sym") == F.col("src")).select("sym", (F.col("weight") - F.col("b.less")).cast("long").alias("most"), F.col("b.dst").alias("via"))
        after = known.join(better, "sym", "left").select("sym", F.coalesce("most", "degree").alias("degree"), F.coalesce("via", "next").alias("next"), F.coalesce((F.col("most") != F.col("degree")) | ~F.col("via").eqNullSafe(F.col("next")), F.lit(False)).alias("moved"))
        after = settled(after)
        known = after.select("sym", "degree", "next")
        if after.where("moved").isEmpty():
            break
    else:
        raise BudgetExceeded(f"degrees did not settle in {rounds} rounds")
    better = known.join(heads.select("sym"), "sym", "left_semi").select("sym", F.col("degree").alias("most"), F.col("next").alias("via"))
    value = value.join(better, "sym", "left").select("sym", F.coalesce("most", "degree").alias("degree"), F.col("via").alias("next"))
    ends = endless.withColumn("endless", F.lit(True))
    return value.join(ends, "sym", "left").select("sym", F.when(F.col("endless"), F.lit(-1).cast("long")).otherwise(F.col("degree")).alias("degree"), F.when(F.col("endless").isNull(), F.col("next")).alias("next"))


def numbered(symbols: DataFrame) -> DataFrame:
    """(sym, id): symbols numbered from 0 without gaps, each part by itself."""
    rows = settled(symbols.select("sym", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    # A row for each part of the table.
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    base, seen = [], 0
    for p, n in sizes:
        base += [F.lit(p), F.lit(seen)]
        seen += n
    return rows.select("sym", (F.create_map(*base)[part] + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id")) if base else rows.select("sym", F.col("m").cast("int").alias("id"))


def _preorder(root: int, max_depth: int, max_nodes: int | None):
    """Expands in pre-order from (id, children) in Arrow batches; holds four bytes a call, and no more of the tree than its way down."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, sizes, parts = [], [], []
        for b in batches:
            lists = b.column(1)
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            sizes.append(np.diff(lists.offsets.to_numpy()))
            parts.append(lists.flatten().to_numpy(zero_copy_only=False))
        whole = lambda xs, kind: np.concatenate(xs).astype(kind, copy=False) if xs else np.empty(0, kind)
        own, size, below = whole(ids, np.int64), whole(sizes, np.int64), whole(parts, np.int32)
        del ids, sizes, parts
        n = int(max(own.max(initial=root), below.max(initial=root), root)) + 1
        start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        upto = np.cumsum(size)
        start[own], end[own] = upto - size, upto
        done = bytearray(n)
        rows, count = ([], [], [], [], []), 0
        names = ("node", "parent", "id", "depth", "truncated")
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names)
        # Each frame: the next child, the last, and the number of its node; the first holds the root alone.
        frames, first = [[0, 1, -1]], True
        while frames:
            top = frames[-1]
            if top[0] == top[1]:
                frames.pop()
                continue
            sym = root if first else int(below[top[0]])
            first = False
            top[0] += 1
            depth = len(frames) - 1
            lo, hi = int(start[sym]), int(end[sym])
            why = "" if lo == hi else "AlreadyExpanded" if done[sym] else "DepthCapped" if depth >= max_depth else "BudgetCapped" if max_nodes is not None and count >= max_nodes else ""
            for column, value in zip(rows, (count, top[2], sym, depth, why)):
                column.append(value)
            if lo != hi and not why:
                done[sym] = 1
                frames.append([lo, hi, count])
            count += 1
            if len(rows[0]) == 100_000:
                yield batch()
                for column in rows:
                    column.clear()
        if rows[0]:
            yield batch()

    return run


def tree_rows(edges: DataFrame, root: str, max_depth: int = 50, max_nodes: int | None = None) -> DataFrame:
    """(node, parent, sym, depth, truncated), numbered in pre-order; a symbol is expanded once, children by line and name.

    What is expanded where depends on all that was before, so one task does it, over numbers; everything else, the reach,
    the order of children and the names, is done by all. No limit on nodes unless one is given: then a larger reach raises.
    """
    known = settled(reach(edges, edges.sparkSession.createDataFrame([(0, root)], "seed int, sym string"), max_depth, max_nodes).select("sym"))
    ids = settled(numbered(known))
    part = edges.select("src", "line", "dst").distinct().join(ids.select(F.col("sym").alias("src"), F.col("id").alias("of")), "src")
    # A call from the last level leads to what isn't in reach; its caller isn't expanded, but shown as cut.
    part = part.join(ids.select(F.col("sym").alias("dst"), "id"), "dst", "left")
    below = F.transform(F.array_sort(F.collect_list(F.struct("line", "dst", F.coalesce("id", F.lit(0)).alias("id")))), lambda x: x["id"])
    children = part.groupBy("of").agg(below.alias("below")).repartition(1)
    first = ids.where(F.col("sym") == root).first()["id"]
    rows = settled(children.mapInArrow(_preorder(first, max_depth, max_nodes), "node long, parent long, id int, depth long, truncated string"))
    return rows.join(ids, "id").select("node", "parent", "sym", "depth", "truncated")


def call_tree(edges: DataFrame, root: str, max_depth: int = 50, max_nodes: int | None = 50_000) -> list[tuple[int, int, str, int, str]]:
    """tree_rows for a user to read, on the driver."""
    return [tuple(r) for r in tree_rows(edges, root, max_depth, max_nodes).orderBy("node").toLocalIterator()]


def one_hop(calls: DataFrame, dispatch: DataFrame, seeds: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """(sym, dispatched, depth): what sources (sym) reach if a member that dispatch has chosen isn't dispatched again.

    How a member was reached is part of what is known: one that is both called and dispatched to has two rows.
    """
    steps = calls.select("src", "dst", F.lit(False).alias("to"), F.lit(None).cast("boolean").alias("only"))
    steps = settled(steps.unionByName(dispatch.select("src", "dst", F.lit(True).alias("to"), F.lit(False).alias("only"))).distinct())
    known = settled(seeds.select("sym", F.lit(False).alias("dispatched"), F.lit(0).alias("depth")).distinct())
    frontier = known
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.join(steps, (frontier["sym"] == steps["src"]) & (F.col("only").isNull() | ~F.col("dispatched")))
        new = new.select(F.col("dst").alias("sym"), F.col("to").alias("dispatched")).distinct()
        frontier = settled(new.join(known.select("sym", "dispatched"), ["sym", "dispatched"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known
