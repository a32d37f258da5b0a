"""Prerequisite graphs: edges are rows (src, dst), src requires dst.

Rounds go on until nothing is new; a number of hops is a bound only where a caller gives one.  Before rounds that
follow edges to any depth, chains are contracted (at once, or after SHALLOW rounds that did not end): a node with one edge in and one out
is passed over by pointers that double their reach each round, so that a chain or a ring of n nodes takes log n rounds.  What is left takes as many rounds as
its longest way has nodes with several edges.  Each round's rows are written in the shared folder: plans stay small, and a lost
executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rounds that are tried without contracting chains first, which takes about as many.
SHALLOW = 16
#: Rounds in which heights are found before pairs are searched; what is not known by then is searched without them.
DEEP = 2 * SHALLOW
#: Stands for a height that is not known: that of nodes which lead to a cycle, or are too high.
UNKNOWN = 1 << 62


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, node, depth: the nodes within `hops` edges of each start (column node), at their least depth."""
    frontier = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    found = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return found


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).distinct()


def paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """path (an array of nodes) of each simple path of 1 to `hops` edges from the starts.

    For few starts and hops: paths may be as many as edges of a node to the power of the hops.
    """
    now = starts.select(F.array("node").alias("path"))
    found = None
    for _ in range(hops):
        now = cut(now.join(edges, F.element_at("path", -1) == edges.src).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        found = now if found is None else found.unionByName(now)
    return found


def _ends(edges: DataFrame) -> DataFrame:
    """node, at, steps, low: for inner nodes (node, at: the next one), the first node that is not inner, and the least node passed.

    Nodes of a ring of inner nodes alone have no such end: their `at` is null, and `low` is the ring's least node.  Each round joins all
    nodes with themselves: merged, as tables of numbers that are small in files would go through the driver each time.
    """
    now = cut(edges.select("node", "at", F.lit(1).cast("long").alias("steps"), F.col("node").alias("low"), F.lit(False).alias("done")))
    state = None
    while True:
        jump = now.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.col("low").alias("least"))
        step = now.join(jump.hint("merge"), "at", "left").select("node", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", "least").alias("low"), F.col("to").isNull().alias("done"))
        now = cut(step)
        # Rounds resolve some of a chain as long as any of it is open; after that, only the least nodes of rings spread.
        seen = now.agg(F.count(F.when(~F.col("done"), 1)).alias("open"), F.sum(F.when(~F.col("done"), F.xxhash64("node", "low").cast("decimal(38,0)"))).alias("lows")).first()
        if seen["open"] == 0 or seen == state:
            return now.select("node", F.when(F.col("done"), F.col("at")).alias("at"), "steps", "low")
        state = seen


def contracted(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst, length) between nodes that are no inner ones, and inner nodes: node, head, tail, to_tail, ring.

    Inner are nodes with one edge in and one out, but those of `keep` (column node).  A chain of inner nodes becomes a link from its head to its
    tail.  Nodes of a ring of inner nodes alone have neither: `ring` is its least node.  Edges are distinct.
    """
    edges = edges.select("src", "dst")
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("src").alias("before"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.first("dst").alias("after"))
    inner = into.join(out.hint("merge"), "node").where("i = 1 AND o = 1 AND before <> node").select("node", "before", "after")
    if keep is not None:
        inner = inner.join(keep.select("node").distinct(), "node", "left_anti")
    inner = cut(inner)
    if inner.isEmpty():
        return edges.withColumn("length", F.lit(1).cast("long")), inner.select("node", F.col("node").alias("head"), F.col("node").alias("tail"), F.lit(1).cast("long").alias("to_tail"), F.col("node").alias("ring"))
    tails = _ends(inner.select("node", F.col("after").alias("at")))
    heads = _ends(inner.select("node", F.col("before").alias("at"))).select("node", F.col("at").alias("head"))
    passed = cut(tails.join(heads.hint("merge"), "node").select("node", "head", F.col("at").alias("tail"), F.col("steps").alias("to_tail"), F.when(F.col("at").isNull(), F.col("low")).alias("ring")))
    first = passed.select(F.col("node").alias("dst"), "tail", "to_tail")
    links = edges.join(passed.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(first.hint("merge"), "dst", "left")
    return cut(links.select("src", F.coalesce("tail", "dst").alias("dst"), (F.coalesce("to_tail", F.lit(0)) + 1).alias("length"))), passed


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that nothing leads to or that lead nowhere, over and over: what is left lies on cycles or between them."""
    size = edges.count()
    while size:
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _painted(edges: DataFrame) -> DataFrame:
    """node, colour: the greatest node from which each one can be reached."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = cut(nodes.withColumn("colour", F.col("node")))
    moved = colours
    while True:
        best = edges.join(moved, edges.src == moved.node).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("better"))
        step = cut(colours.join(best, "node", "left").select("node", F.greatest("colour", "better").alias("colour"), (F.col("better") > F.col("colour")).alias("new")))
        moved = step.where("new").select("node", "colour")
        colours = step.select("node", "colour")
        if moved.isEmpty():
            return colours


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes that lie on cycles; others are components of their own.

    Chains are contracted and ends trimmed.  Each round paints all that is left with the greatest node before it; what leads back to
    that node inside a colour is its component, and goes.
    """
    edges = cut(edges.select("src", "dst").distinct())
    links, inner = contracted(edges.where("src <> dst"))
    named = inner.where("ring IS NOT NULL").select("node", F.col("ring").alias("root"))
    loops = edges.where("src = dst").select("src").unionByName(links.where("src = dst").select("src")).select(F.col("src").alias("node")).distinct()
    core, found = cut(links.where("src <> dst").select("src", "dst").distinct()), None
    while True:
        core = _trimmed(core)
        if core.isEmpty():
            break
        colours = _painted(core)
        of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias("c_" + end))  # noqa: E731, B023
        inside = cut(core.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
        back = new = cut(colours.where("node = colour").select("node", F.col("colour").alias("root")))
        while True:
            step = inside.join(new, inside.dst == new.node).select(F.col("src").alias("node"), "root").distinct()
            new = cut(step.join(back.select("node"), "node", "left_anti"))
            if new.isEmpty():
                break
            back = back.unionByName(new)
        back = cut(back)
        found = back if found is None else found.unionByName(back)
        gone = back.select("node")
        core = cut(core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    roots = loops.withColumn("root", F.col("node"))
    if found is not None:
        sizes = found.groupBy("root").agg(F.count("*").alias("n"))
        large = found.join(sizes.where("n > 1"), "root").select("node", "root")
        roots = large.unionByName(roots.join(large.select("node"), "node", "left_anti"))
    roots = cut(roots)
    # A chain between two nodes of a component, or from a node back to itself, belongs to it.
    ends = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias("r_" + end))
    chains = inner.join(ends("head"), "head").join(ends("tail"), "tail").where("r_head = r_tail").select("node", F.col("r_head").alias("root"))
    every = cut(roots.unionByName(chains).unionByName(named))
    return every.join(every.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: all that each start (column node) leads to, itself included."""
    starts, edges = cut(starts.select("node").distinct()), edges.select("src", "dst").distinct()
    own = starts.select(F.col("node").alias("start"), "node")
    found, whole = _spread(edges, own, SHALLOW)
    if whole:
        return found
    links, inner = contracted(edges, starts)
    found, _ = _spread(links, own, None)
    return found.unionByName(found.join(inner.select("head", F.col("node").alias("passed")), F.col("node") == F.col("head")).select("start", F.col("passed").alias("node")))


def _spread(links: DataFrame, found: DataFrame, rounds: int | None) -> tuple[DataFrame, bool]:
    """start and node of all that links lead to, and whether the rounds were enough."""
    new, n = found, 0
    while rounds is None or n < rounds:
        step = new.join(links, new.node == links.src).select("start", F.col("dst").alias("node")).distinct()
        new, n = cut(step.join(found, ["start", "node"], "left_anti")), n + 1
        if new.isEmpty():
            return found, True
        found = found.unionByName(new)
    return found, False


def connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (begin, goal) whose begin leads to the goal.

    Searches from both sides at once: a pair goes on while both have something new and have not met.  A way only leads down from heights
    that are known, so that neither side leaves the heights between begin and goal, and pairs without any between them are not searched.
    """
    pairs = cut(pairs.select("begin", "goal").distinct())
    ends = pairs.select(F.explode(F.array("begin", "goal")).alias("node")).distinct()
    links, _ = contracted(edges.select("src", "dst").distinct(), ends)
    links = cut(links)
    heights, _ = _peeled(links, ends.unionByName(links.select(F.explode(F.array("src", "dst")).alias("node"))).distinct(), DEEP)

    def high(rows: DataFrame, end: str, name: str) -> DataFrame:
        return rows.join(heights.select(F.col("node").alias(end), F.col("level").alias(name)), end, "left").withColumn(name, F.coalesce(name, F.lit(UNKNOWN)))

    links = cut(high(high(links.select("src", "dst"), "src", "h_src"), "dst", "h_dst"))
    pair = ["begin", "goal", "h_begin", "h_goal"]
    key = [*pair, "node"]
    pairs = cut(high(high(pairs, "begin", "h_begin"), "goal", "h_goal").where(f"begin = goal OR h_begin > h_goal OR h_begin = {UNKNOWN}"))
    down = f"dst = goal OR h_dst > h_goal OR h_dst = {UNKNOWN}"
    up = f"src = begin OR h_src < h_begin OR h_begin = {UNKNOWN}"
    ahead = new_ahead = pairs.withColumn("node", F.col("begin"))
    behind = new_behind = pairs.withColumn("node", F.col("goal"))
    met = pairs.where("begin = goal")
    said = lambda rows, a, b, m: rows.select(*pair, F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("m"))
    while True:
        new_ahead = cut(new_ahead.join(links, new_ahead.node == links.src).where(down).select(*pair, F.col("dst").alias("node")).distinct().join(ahead, key, "left_anti"))
        ahead = ahead.unionByName(new_ahead)
        new_behind = cut(new_behind.join(links, new_behind.node == links.dst).where(up).select(*pair, F.col("src").alias("node")).distinct().join(behind, key, "left_anti"))
        hits = said(new_ahead.join(behind, key, "left_semi"), 0, 0, 1).unionByName(said(new_behind.join(ahead, key, "left_semi"), 0, 0, 1))
        behind = behind.unionByName(new_behind)
        state = said(new_ahead, 1, 0, 0).unionByName(said(new_behind, 0, 1, 0)).unionByName(hits).groupBy(*pair).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("m").alias("m"))
        state = cut(state)
        met = met.unionByName(state.where("m = 1").select(*pair))
        both = state.where("a = 1 AND b = 1 AND m = 0").select(*pair)
        if both.isEmpty():
            return met.select("begin", "goal").distinct()
        new_ahead, new_behind = (x.join(both, pair, "left_semi").select(*key) for x in (new_ahead, new_behind))


def closes_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges (src, dst) with is_cycle: whether dst leads to src already, or is src."""
    back = connected(edges, proposed.select(F.col("dst").alias("begin"), F.col("src").alias("goal"))).select(F.col("goal").alias("src"), F.col("begin").alias("dst"), F.lit(True).alias("hit"))
    return proposed.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("is_cycle"))


def _peeled(links: DataFrame, nodes: DataFrame, rounds: int | None) -> tuple[DataFrame, bool]:
    """node, level of the nodes (distinct, all ends of links among them) whose links (src, dst, length) all told their levels within so many rounds, and whether no more would follow.

    All that a node with a level leads to has one, and a lesser one.
    """
    needs = links.groupBy("src").agg(F.count("*").alias("need"))
    links = cut(links.join(needs, "src"))
    state = cut(nodes.join(needs.withColumnRenamed("src", "node"), "node", "left").select("node", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("got"), F.coalesce("need", F.lit(0)).alias("need")))
    new = state.where("need = 0")
    done, partial, n = new.select("node", "level"), state.where("need < 0"), 0
    while not new.isEmpty():
        if n == rounds:
            return cut(done), False
        n += 1
        told = links.join(new.select("node", "level"), F.col("dst") == F.col("node")).select(F.col("src").alias("node"), (F.col("level") + F.col("length")).alias("level"), F.lit(1).cast("long").alias("got"), "need")
        state = cut(partial.unionByName(told).groupBy("node").agg(F.max("level").alias("level"), F.sum("got").alias("got"), F.max("need").alias("need")))
        new, partial = state.where("got = need"), state.where("got < need")
        done = done.unionByName(new.select("node", "level"))
    return cut(done), True


def _settled(edges: DataFrame, nodes: DataFrame, rounds: int | None = SHALLOW) -> tuple[DataFrame, bool]:
    """node, level of the nodes whose levels follow from nodes without prerequisites; and whether these are all nodes.

    A node's level is known once all its links have told theirs; chains are contracted where some rounds are not enough.
    """
    if rounds is None:
        links, inner = contracted(edges)
    else:
        links, inner = edges.withColumn("length", F.lit(1).cast("long")), None
    every = nodes.unionByName(links.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    every = cut(every if inner is None else every.join(inner.select("node"), "node", "left_anti"))
    done, whole = _peeled(links, every, rounds)
    if not whole:
        return _settled(edges, nodes, None)
    total = every.count()
    if inner is None:
        return done, done.count() == total
    inner_levels = inner.join(done.withColumnRenamed("node", "tail"), "tail").select("node", (F.col("level") + F.col("to_tail")).alias("level"))
    return done.unionByName(inner_levels), done.count() == total and inner.where("ring IS NOT NULL").isEmpty()


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level, on_cycle: edges on the longest way to a node without prerequisites; nodes of one cycle share a level.

    Where there are cycles, components are single nodes, and edges inside them do not count.
    """
    edges, nodes = cut(edges.select("src", "dst").distinct()), cut(nodes.select("node").distinct())
    found, whole = _settled(edges, nodes)
    if whole:
        return nodes.join(found, "node").withColumn("on_cycle", F.lit(False))
    of = cut(strongly_connected(edges))
    part = lambda end: of.select(F.col("node").alias(end), F.col("component").alias("c_" + end))
    joined = edges.join(part("src"), "src", "left").join(part("dst"), "dst", "left")
    joined = cut(joined.select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst")).where("src <> dst").distinct())
    known = cut(nodes.join(of, "node", "left").select("node", F.coalesce("component", "node").alias("of"), F.col("component").isNotNull().alias("on_cycle")))
    found, _ = _settled(joined, known.select(F.col("of").alias("node")))
    return known.join(found.withColumnRenamed("node", "of"), "of").select("node", "level", "on_cycle")


def shortest(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """node, distance over undirected edges from one start."""
    spark = edges.sparkSession
    return reach(undirected(edges), spark.createDataFrame([(start,)], "node long"), hops).select("node", F.col("depth").alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that undirected edges (src, dst, each in both directions) lead to.

    Each round takes the least label of all neighbours, then the label of that label, so that rounds grow with the logarithm of a
    component's width.
    """
    edges = cut(edges.select("src", "dst").distinct())
    labels = cut(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        seen = edges.join(labels, edges.dst == labels.node).groupBy("src").agg(F.min("component").alias("least"))
        step = labels.join(seen, labels.node == seen.src).select("node", F.least("component", "least").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = cut(step.join(jump, "component", "left").select("node", F.least("component", "next").alias("component"), "before"))
        if step.where("component <> before").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")


def clusters(edges: DataFrame, tags: DataFrame, most: int = 20, least: float = 0.6) -> DataFrame:
    """node, component (the least node of its cluster) of edges (src, dst, strength) and tags (chunk, concept).

    Seeds are the nodes with more neighbours than each of theirs (of equal ones, the lesser number).  A seed looks at the `most` nodes with
    most ways of one or two edges to it, and takes those whose similarity reaches `least`: nearness, more for a strong edge and for
    chunks that name both.  Clusters that share a node are one.  Ways are counted before they are shuffled by seed, and each task keeps a seed's first.
    """
    both = cut(undirected(edges))
    strong = undirected(edges.where("strength = 'STRONG'")).select(F.col("src").alias("seed"), F.col("dst").alias("other"), F.lit(True).alias("strong"))
    degrees = cut(both.groupBy("src").agg(F.count("*").alias("degree")))
    rank = F.struct("degree", -F.col("src"))
    ranked = both.join(degrees.select(F.col("src").alias("dst"), F.struct("degree", -F.col("src")).alias("theirs")), "dst").groupBy("src").agg(F.max("theirs").alias("theirs"))
    seeds = cut(degrees.join(ranked, "src").where(rank > F.col("theirs")).select(F.col("src").alias("seed")))
    one = both.join(seeds, both.src == seeds.seed).select("seed", F.col("dst").alias("other"))
    two = one.join(both, F.col("other") == F.col("src")).where("dst <> seed").select("seed", F.col("dst").alias("other"))
    ways = one.withColumn("d", F.lit(1)).unionByName(two.withColumn("d", F.lit(2))).groupBy("seed", "other").agg(F.min("d").alias("d"), F.count("*").alias("ways"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("ways"), "other"))
    near = cut(ways.withColumn("place", place).where(F.col("place") <= most).select("seed", "other", "d"))
    own = near.join(tags.select(F.col("concept").alias("seed"), "chunk"), "seed")
    shared = own.join(tags.select(F.col("concept").alias("other"), "chunk"), ["other", "chunk"]).groupBy("seed", "other").agg(F.count("*").alias("shared"))
    rows = near.join(shared, ["seed", "other"], "left").join(strong, ["seed", "other"], "left")
    score = 1 / (1 + F.col("d")) * F.when(F.col("strong"), 1.2).otherwise(1.0) * (1 + F.least(F.lit(0.5), 0.1 * F.coalesce("shared", F.lit(0))))
    pairs = rows.where(F.round(F.least(F.lit(1.0), score), 6) >= least).select(F.col("seed").alias("src"), F.col("other").alias("dst"))
    return components(undirected(pairs))
