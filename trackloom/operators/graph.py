"""Operators on the track graph.

A graph is two DataFrames. nodes: node_id, born_f, died_f, born_t, died_t,
components (the ids that were merged into it). edges: src, dst, tags (pairs of
the original ids that it stands for). Operators that simplify return a new
(nodes, edges); a merge is always a table (old, new) that ``condense`` applies
at once. Fixpoints are driven by counts and cut their lineage with files in the
shared checkpoint folder.

nodes may have more columns (``LOOSE``, see ``operators.loose``): then edges are
only those that a simplification may follow, and more_in and more_out count a
node's others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.lineage import cut

Graph = tuple[DataFrame, DataFrame]
#: Where a node begins and ends on the lines of its kinds, and its edges that aren't rows.
LOOSE = ("first_kind", "first_at", "last_kind", "last_at", "more_in", "more_out")
MAX_ROUNDS = 64
MAX_WALK = 100_000  # steps of a walk along edges; one that doesn't end by then is an error


def make_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Nodes with components and edges with tags where they have none yet."""
    if "components" not in nodes.columns:
        nodes = nodes.withColumn("components", F.array("node_id"))
    if "tags" not in edges.columns:
        edges = edges.withColumn("tags", F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))))
    return nodes.select("node_id", "born_f", "died_f", "born_t", "died_t", "components", *[c for c in LOOSE if c in nodes.columns]), edges.select("src", "dst", "tags")


def lifespan_f() -> Column:
    return F.col("died_f") - F.col("born_f") + 1


def lifespan_t() -> Column:
    return F.col("died_t") - F.col("born_t")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node_id, n_in, n_out of each node with an edge; those of ``nodes`` that aren't rows count, too."""
    ends = edges.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    if nodes is not None and "more_in" in nodes.columns:
        ends = ends.unionAll(nodes.where("more_in > 0 or more_out > 0").select("node_id", "more_in", "more_out"))
    return ends.groupBy("node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges, nodes), "node_id", "left").na.fill(0, ["n_in", "n_out"])


def degree_histogram(nodes: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    d = with_degrees(nodes, edges)
    return d.groupBy(F.least("n_in", F.lit(most)).alias("n_in"), F.least("n_out", F.lit(most)).alias("n_out")).agg(F.count("*").alias("n"))


def condense(graph: Graph, mapping: DataFrame, recalculate_life: bool = True) -> Graph:
    """Merges nodes by mapping (old, new); new nodes must exist.

    Lives become the union's (or stay those of the new node), components and tags
    are united, edges inside a merged node go. A merged node of a loose graph begins
    like the new node, and ends like the old one that mapping calls last, if any.
    """
    nodes, edges = graph
    loose = "more_in" in nodes.columns
    m = mapping.where("old != new").select("old", "new", *(["last"] if loose else [])).distinct()
    named = nodes.join(m, nodes["node_id"] == m["old"], "left").withColumn("to", F.coalesce("new", "node_id"))
    own = F.col("to") == F.col("node_id")
    life = lambda f, c: f(c) if recalculate_life else F.max(F.when(own, F.col(c)))
    merged = named.groupBy("to").agg(
        life(F.min, "born_f").alias("born_f"), life(F.max, "died_f").alias("died_f"), life(F.min, "born_t").alias("born_t"), life(F.max, "died_t").alias("died_t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("components")))).alias("components"),
        *([F.max_by(F.struct("first_kind", "first_at"), own).alias("_first"), F.max_by(F.struct("last_kind", "last_at"), F.when(F.col("last"), 2).otherwise(own.cast("int"))).alias("_last"), F.sum("more_in").alias("more_in"), F.sum("more_out").alias("more_out")] if loose else []),
    ).withColumnRenamed("to", "node_id")
    if loose:
        merged = merged.select("node_id", "born_f", "died_f", "born_t", "died_t", "components", "_first.*", "_last.*", "more_in", "more_out")
    heads, tails = (m.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")) for c in ("src", "dst"))
    moved = edges.join(heads, "src", "left").join(tails, "dst", "left").select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "tags").where("src != dst")
    return merged, moved.groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


def settle(graph: Graph) -> Graph:
    return cut(graph[0]), cut(graph[1])


def path_heads(links: DataFrame) -> DataFrame:
    """old, new: for links (child, parent), where each child has one parent, the child and the head of its path.

    Pointer jumping: as many rounds as the logarithm of the longest path.
    """
    now = cut(links.select("child", "parent"))
    for _ in range(MAX_ROUNDS):
        up = now.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        after = cut(now.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        moved = not after.where("moved").isEmpty()
        now = after.drop("moved")
        if not moved:
            return now.select(F.col("child").alias("old"), F.col("parent").alias("new"))
    raise RuntimeError("links form a cycle")


def along_paths(links: DataFrame) -> DataFrame:
    """``path_heads``, and whether the child is the last of its path."""
    on = links.select(F.col("parent").alias("old"), F.lit(False).alias("_on")).distinct()
    return path_heads(links).join(on, "old", "left").select("old", "new", F.coalesce("_on", F.lit(True)).alias("last"))


def chain_links(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """child, parent: edges whose source has no other successor and whose target no other predecessor."""
    d = degrees(edges, nodes)
    only_out, only_in = d.where("n_out = 1").select(F.col("node_id").alias("src")), d.where("n_in = 1").select(F.col("node_id").alias("dst"))
    return edges.join(only_out, "src", "left_semi").join(only_in, "dst", "left_semi").select(F.col("dst").alias("child"), F.col("src").alias("parent"))


def contract_chains(graph: Graph) -> Graph:
    """Every maximal chain becomes its head."""
    links = cut(chain_links(graph[1], graph[0]))
    return graph if links.isEmpty() else condense(graph, along_paths(links))


def offshoots(graph: Graph, longest: float) -> DataFrame:
    """old, new: nodes with one predecessor, no successor and a life of at most ``longest`` frames, and that predecessor."""
    nodes, edges = graph
    short = with_degrees(nodes, edges).where((F.col("n_in") == 1) & (F.col("n_out") == 0) & (lifespan_f() <= longest)).select(F.col("node_id").alias("dst"))
    return edges.join(short, "dst", "left_semi").select(F.col("dst").alias("old"), F.col("src").alias("new"))


def remove_offshoots(graph: Graph, longest: float) -> Graph:
    """Short dead ends join their predecessor, which keeps its own life. Ends that this lays bare stay."""
    found = cut(offshoots(graph, longest))
    return graph if found.isEmpty() else condense(graph, found.withColumn("last", F.lit(False)), recalculate_life=False)


def split_joins(graph: Graph) -> DataFrame:
    """a, b, c, d of each a -> {b, c} -> d where no other edge touches b and c, leaves a or enters d; with their lives."""
    nodes, edges = graph
    d = degrees(edges, nodes)
    middle = d.where("n_in = 1 and n_out = 1").select("node_id")
    arms = edges.select(F.col("src").alias("a"), F.col("dst").alias("node_id")).join(middle, "node_id").join(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("d")), "node_id")
    arms = arms.join(nodes.select("node_id", lifespan_f().alias("life")), "node_id")
    pairs = arms.groupBy("a", "d").agg(F.count("*").alias("n"), F.min("node_id").alias("b"), F.max("node_id").alias("c"), F.max("life").alias("longest"), F.avg("life").alias("mean_life")).where("n = 2").drop("n")
    pairs = pairs.join(d.where("n_out = 2").select(F.col("node_id").alias("a")), "a", "left_semi").join(d.where("n_in = 2").select(F.col("node_id").alias("d")), "d", "left_semi")
    life = nodes.select("node_id", lifespan_f().alias("life"))
    return pairs.join(life.toDF("a", "life_a"), "a").join(life.toDF("d", "life_d"), "d")


def disjoint_first(motifs: DataFrame) -> DataFrame:
    """Of motifs that share an end (the a of one is the d of another), those without a higher a beside them."""
    ups = motifs.select(F.col("d").alias("a"), F.col("a").alias("other"))  # motifs that end where this one starts
    downs = motifs.select(F.col("a").alias("d"), F.col("a").alias("other"))  # motifs that start where this one ends
    above = motifs.join(ups, "a").where("other > a").select("a").union(motifs.join(downs, "d").where("other > a").select("a"))
    return motifs.join(above.distinct(), "a", "left_anti")


def remove_split_joins(graph: Graph, max_frames: float | None = None, max_relative: float | None = None, after: Callable[[Graph], Graph] = settle) -> Graph:
    """a absorbs b, c and d of each short split that joins again, until none is left (highest a first).

    Short: the longer arm lives at most ``max_frames``; or the mean life of the
    arms is at most ``max_relative`` times that of a and d. after: what is done after
    each turn, if not only ``settle``; the graph is stored already then.
    """
    graph = settle(graph) if after is settle else graph
    for _ in range(MAX_ROUNDS):
        found = split_joins(graph)
        if max_frames is not None:
            found = found.where(F.col("longest") <= max_frames)
        if max_relative is not None:
            found = found.where(2 * F.col("mean_life") <= max_relative * (F.col("life_a") + F.col("life_d")))
        found = cut(found)
        if found.isEmpty():
            return graph
        chosen = cut(disjoint_first(found))  # never empty: the highest a of all is in it
        mapping = chosen.select(F.explode(F.array("b", "c", "d")).alias("old"), F.col("a").alias("new"), "d").withColumn("last", F.col("old") == F.col("d"))
        graph = after(condense(graph, mapping))
    raise RuntimeError(f"splits are left after {MAX_ROUNDS} rounds")


def untangle(graph: Graph, collisions: DataFrame) -> Graph:
    """collisions (collision, parent, child): the collision node goes, and each parent goes on as its child."""
    nodes, edges = graph
    gone = collisions.select("collision").distinct()
    nodes = nodes.join(gone, nodes["node_id"] == gone["collision"], "left_anti")
    edges = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
    return condense((nodes, edges), along_paths(collisions.select(F.col("child"), F.col("parent"))))


def relinked(graph: Graph, collisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after collisions (collision, parent, child) as ``untangle``, but an edge joins each pair and nothing is merged.

    nodes has collisions: the dissolved nodes that a parent went through, sorted; empty for others.
    """
    nodes, edges = graph
    gone = collisions.select("collision").distinct()
    through = collisions.groupBy(F.col("parent").alias("node_id")).agg(F.array_sort(F.collect_set("collision")).alias("collisions"))
    nodes = nodes.join(gone, nodes["node_id"] == gone["collision"], "left_anti").join(through, "node_id", "left")
    left = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")
    pair = F.array(F.struct(F.col("parent").alias("a"), F.col("child").alias("b")))
    new = collisions.select(F.col("parent").alias("src"), F.col("child").alias("dst"), pair.alias("tags")).distinct()
    both = left.unionByName(new).groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    return nodes.withColumn("collisions", F.coalesce("collisions", F.array().cast(through.schema["collisions"].dataType))), both


def absorbable(graph: Graph, longest: float, down: bool = True) -> DataFrame:
    """child, parent: nodes that live at most ``longest`` frames and have one predecessor (``down``; else one successor), and that."""
    nodes, edges = graph
    near, away = ("dst", "src") if down else ("src", "dst")
    short = with_degrees(nodes, edges).where((F.col("n_in" if down else "n_out") == 1) & (lifespan_f() <= longest)).select(F.col("node_id").alias(near))
    return edges.join(short, near, "left_semi").select(F.col(near).alias("child"), F.col(away).alias("parent"))


def assimilate(graph: Graph, longest: float) -> Graph:
    """Short nodes join their only predecessor, until none does; then those left join their only successor.

    A node that joins lives in the one it joins, with all its parts and edges, so
    that others may have one neighbour less afterwards; what that lays bare joins
    in the next round. In a round every node has one neighbour to join at most, and
    chains of joining nodes go to the head of the chain: there is nothing to settle
    between them. A node with several neighbours on that side stays.
    """
    graph = settle(make_graph(*graph))
    for down in (True, False):
        for _ in range(MAX_WALK):
            links = cut(absorbable(graph, longest, down))
            if links.isEmpty():
                break
            graph = settle(condense(graph, path_heads(links)))
        else:
            raise RuntimeError("no end of joining")
    return graph


def bridge_gaps(graph: Graph, pairs: DataFrame) -> Graph:
    """pairs (node1, node2): node1 goes on as node2, though no edge joins them; bridged nodes may be bridged on."""
    return condense(graph, along_paths(cut(pairs.select(F.col("node2").alias("child"), F.col("node1").alias("parent")))))


def greedy_matching(pairs: DataFrame, left: str = "node1", right: str = "node2", score: str = "score") -> DataFrame:
    """One-to-one pairs as taken by rising (score, left, right): the pairs that are the least at both ends are taken, theirs go, again.

    That is the sequential greedy result; pairs whose turn has come are taken all at once.
    """
    rest = cut(pairs.select(left, right, score).where(F.col(score).isNotNull()).distinct())
    taken = []
    for _ in range(MAX_WALK):
        best_l = rest.groupBy(left).agg(F.min(F.struct(score, right)).alias("m")).select(left, F.col(f"m.{right}").alias(right))
        best_r = rest.groupBy(right).agg(F.min(F.struct(score, left)).alias("m")).select(right, f"m.{left}", f"m.{score}")
        now = cut(best_r.join(best_l, [left, right]).select(left, right, score))  # a pair that is the least at both its ends
        if now.isEmpty():
            return reduce(DataFrame.unionAll, taken, now)
        taken.append(now)
        rest = cut(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
    raise RuntimeError("no end of matching")


def suspected_collisions(graph: Graph, threshold: float = 2) -> DataFrame:
    """node_id of two-in-two-out nodes whose parents' and children's mean lives are both over ``threshold`` times their own."""
    nodes, edges = graph
    life = nodes.select("node_id", lifespan_f().alias("life"))
    parents = edges.join(life, F.col("src") == F.col("node_id")).groupBy(F.col("dst").alias("node_id")).agg(F.avg("life").alias("before"))
    children = edges.join(life, F.col("dst") == F.col("node_id")).groupBy(F.col("src").alias("node_id")).agg(F.avg("life").alias("after"))
    two = with_degrees(nodes, edges).where("n_in = 2 and n_out = 2").select("node_id", lifespan_f().alias("own"))
    return two.join(parents, "node_id").join(children, "node_id").where((F.col("before") > threshold * F.col("own")) & (F.col("after") > threshold * F.col("own"))).select("node_id")


def time_based_collisions(graph: Graph, min_duration: float, factor: float) -> DataFrame:
    """node_id of nodes that alone link their parents to their children, live at least ``min_duration`` and less than ``factor`` times the shortest of both."""
    nodes, edges = graph
    life = with_degrees(nodes, edges).select("node_id", lifespan_f().alias("life"), "n_in", "n_out")
    p = edges.join(life, F.col("src") == F.col("node_id")).groupBy(F.col("dst").alias("node_id")).agg(F.min("life").alias("before"), F.bool_and(F.col("n_out") == 1).alias("only_p"))
    s = edges.join(life, F.col("dst") == F.col("node_id")).groupBy(F.col("src").alias("node_id")).agg(F.min("life").alias("after"), F.bool_and(F.col("n_in") == 1).alias("only_s"))
    out = life.join(p, "node_id").join(s, "node_id").where("only_p and only_s")
    return out.where((F.col("life") >= min_duration) & (F.col("life") < factor * F.col("after")) & (F.col("life") < factor * F.col("before"))).select("node_id")


def acausal_edges(graph: Graph, limit: float) -> DataFrame:
    """src, dst of edges whose target was born more than ``limit`` frames before the source died."""
    nodes, edges = graph
    a, b = nodes.select(F.col("node_id").alias("src"), "died_f"), nodes.select(F.col("node_id").alias("dst"), "born_f")
    return edges.join(a, "src").join(b, "dst").where(F.col("born_f") - F.col("died_f") < -limit).select("src", "dst")


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int | None, up: bool = True, down: bool = True) -> DataFrame:
    """start, node_id, distance: the nodes within ``hops`` edges of each start, or all that can be reached; edges are followed down, up or both ways."""
    step = []
    if down:
        step.append(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")))
    if up:
        step.append(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("next")))
    step = (step[0] if len(step) == 1 else step[0].unionAll(step[1])).distinct()
    front = cut(starts.select(F.col("node_id").alias("start"), "node_id").distinct())
    found = front.withColumn("distance", F.lit(0))
    for k in range(1, (MAX_WALK if hops is None else hops) + 1):
        front = cut(front.join(step, "node_id").select("start", F.col("next").alias("node_id")).distinct().join(found, ["start", "node_id"], "left_anti"))
        if front.isEmpty():
            return found
        found = cut(found.unionAll(front.withColumn("distance", F.lit(k))))
    if hops is None:
        raise RuntimeError(f"no end of the walk after {MAX_WALK} steps")
    return found


def family_tree(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node_id of all ancestors and descendants, and the start itself."""
    down, up = neighbourhood(edges, starts, None, up=False), neighbourhood(edges, starts, None, down=False)
    return down.select("start", "node_id").union(up.select("start", "node_id")).distinct()


def object_counts(graph: Graph, areas: DataFrame, movers: DataFrame) -> DataFrame:
    """node_id, count (in halves) of the objects that a node stands for.

    Movers count one. Counts flow to successors in proportion to their areas once
    all predecessors of a node are known, level by level; what stays unknown gets
    a count by its area against the movers' mean and deviation.
    """
    nodes, edges = graph
    size = nodes.select("node_id").join(areas.select("node_id", "area"), "node_id", "left")
    one = movers.select("node_id").distinct()
    stats = size.join(one, "node_id").agg(F.avg("area").alias("mean"), F.stddev_pop("area").alias("std"))
    links = edges.select("src", "dst").join(size.select(F.col("node_id").alias("dst"), F.coalesce("area", F.lit(0.0)).alias("area")), "dst")
    w = Window.partitionBy("src")
    share = F.when(F.sum("area").over(w) == 0, 1 / F.count("*").over(w)).otherwise(F.try_divide(F.col("area"), F.sum("area").over(w)))
    links = links.withColumn("share", share).join(one.toDF("dst"), "dst", "left_anti")
    links = cut(links.withColumn("n_in", F.count("*").over(Window.partitionBy("dst"))))
    known = cut(one.withColumn("count", F.lit(1.0)))
    pending = links
    for _ in range(MAX_WALK):
        ready = pending.join(known.select(F.col("node_id").alias("src"), "count"), "src").groupBy("dst", "n_in").agg(F.count("*").alias("n"), F.sum(F.col("count") * F.col("share")).alias("count")).where("n = n_in")
        ready = cut(ready.select(F.col("dst").alias("node_id"), "count"))
        if ready.isEmpty():
            break
        known = cut(known.unionAll(ready))
        pending = cut(pending.join(ready.select(F.col("node_id").alias("dst")), "dst", "left_anti"))
    else:
        raise RuntimeError(f"counts still flow after {MAX_WALK} levels")
    steps = F.ceil(F.greatest(F.lit(0.0), F.try_divide(F.col("area") - (F.col("mean") - F.col("std") / 2), F.col("std") / 2)))
    by_area = F.when(F.col("area").isNull(), 1.0).otherwise(0.5 + 0.5 * F.coalesce(steps, F.lit(0)))
    out = size.join(known, "node_id", "left").crossJoin(F.broadcast(stats))  # one row
    count = F.when(F.coalesce("count", F.lit(0.0)) == 0, by_area).otherwise(F.col("count"))
    return out.select("node_id", (F.floor(count / 0.5) * 0.5).alias("count"))


def changed(graph: Graph, step: Callable[[Graph], Graph], after: Callable[[Graph], Graph] = settle) -> Graph:
    """``step`` of a stored graph, stored; a graph that stays as it is isn't stored twice."""
    out = step(graph)
    return graph if out is graph else after(out)


def simplify(graph: Graph, longest_split: float, relative_split: float, longest_offshoot: float, after: Callable[[Graph], Graph] = settle) -> Graph:
    """The cleaning sequence: chains, absolute and relative split-joins, offshoots, chains again."""
    stored = lambda graph: after(graph)
    graph = changed(settle(graph), contract_chains, stored)
    graph = remove_split_joins(graph, max_frames=longest_split, after=stored)
    graph = remove_split_joins(graph, max_relative=relative_split, after=stored)
    graph = changed(graph, lambda x: remove_offshoots(x, longest_offshoot), stored)
    return changed(graph, contract_chains, stored)


Gaps = DataFrame | Callable[[DataFrame, DataFrame], DataFrame]


def open_pairs(graph: Graph, gaps: Gaps) -> DataFrame:
    """node1, node2, score of the gaps (of original ids) between nodes of today: the first without successor, the second without predecessor and born later; of gaps of one pair the least score.

    gaps: the gaps, or a function that makes them from the ids (node1; node2) that they may lie between.
    """
    parts = with_degrees(*graph).where("n_in = 0 or n_out = 0").select(F.explode("components").alias("part"), "node_id", "born_f", "died_f", "n_in", "n_out")
    ends = parts.where("n_out = 0").select(F.col("part").alias("node1"), F.col("node_id").alias("a"), "died_f")
    starts = parts.where("n_in = 0").select(F.col("part").alias("node2"), F.col("node_id").alias("b"), "born_f")
    if callable(gaps):
        ends, starts = cut(ends), cut(starts)
        gaps = gaps(ends.select("node1"), starts.select("node2"))
    found = gaps.join(ends, "node1").join(starts, "node2").where("a != b AND born_f > died_f")
    return found.groupBy(F.col("a").alias("node1"), F.col("b").alias("node2")).agg(F.min("score").alias("score"))


def resolved_collisions(graph: Graph, pairs: DataFrame) -> DataFrame:
    """collision, parent, child, by today's ids, of the collisions that can be dissolved now.

    pairs: (collision, parent, child) of original ids, two of a collision. A pair
    stands for the nodes that its parts are in. A collision is dissolved if its
    node has two predecessors and two successors, which its pairs link one to one,
    and no other such collision is beside it (of neighbours only the one with the
    smallest id goes in this turn).
    """
    nodes, edges = graph
    parts = cut(nodes.select(F.explode("components").alias("part"), "node_id"))
    named = pairs.select("collision", "parent", "child")
    for c in ("collision", "parent", "child"):
        named = named.join(parts.select(F.col("part").alias(c), F.col("node_id").alias(f"_{c}")), c).drop(c)
    named = named.toDF("collision", "parent", "child").distinct()
    named = named.join(edges.select(F.col("src").alias("parent"), F.col("dst").alias("collision")), ["parent", "collision"], "left_semi").join(edges.select(F.col("src").alias("collision"), F.col("dst").alias("child")), ["collision", "child"], "left_semi")
    two = with_degrees(nodes, edges).where("n_in = 2 and n_out = 2").select(F.col("node_id").alias("collision"))
    whole = named.groupBy("collision").agg(F.count("*").alias("n"), F.countDistinct("parent").alias("p"), F.countDistinct("child").alias("c")).where("n = 2 and p = 2 and c = 2").select("collision")
    ready = cut(whole.join(two, "collision", "left_semi"))
    near = edges.join(ready.toDF("src"), "src", "left_semi").join(ready.toDF("dst"), "dst", "left_semi")
    later = near.select(F.greatest("src", "dst").alias("collision")).distinct()
    return named.join(ready, "collision", "left_semi").join(later, "collision", "left_anti").select("collision", "parent", "child")


def untangle_all(graph: Graph, pairs: DataFrame) -> Graph:
    """Collisions dissolved turn by turn, until none of ``pairs`` can be; of pairs with one child or one parent in a turn those of the collision with the smallest hash go first."""
    for _ in range(MAX_WALK):
        found = cut(resolved_collisions(graph, pairs))
        if found.isEmpty():
            return graph
        turn = F.struct(F.xxhash64("collision").alias("hash"), "collision")  # in no order along chains of collisions: few turns
        first = lambda c: found.groupBy(c).agg(F.min(turn).alias("first"))  # noqa: B023, E731
        late = found.join(first("parent"), "parent").where(turn > F.col("first")).select("collision").union(found.join(first("child"), "child").where(turn > F.col("first")).select("collision")).distinct()
        graph = settle(untangle(graph, cut(found.join(late, "collision", "left_anti"))))
    raise RuntimeError("no end of collisions")


def n_nodes_and_edges(graph: Graph) -> tuple[int, int]:
    hidden = graph[0].agg(F.sum("more_out")).first()[0] or 0 if "more_out" in graph[0].columns else 0
    return graph[0].count(), graph[1].count() + hidden


def solve(graph: Graph, longest_split: float, relative_split: float, longest_offshoot: float, gaps: Gaps | None = None, collisions: DataFrame | None = None, max_rounds: int = 100, after: Callable[[Graph], Graph] = settle, anew: Callable[[Graph], Graph] = settle) -> Graph:
    """``simplify``, then collisions and gaps, until neither nodes nor edges get fewer.

    collisions: (collision, parent, child) of original ids, dissolved where that
    can be; gaps: (node1, node2, score) of original ids (see ``open_pairs``), bridged
    with the least scores first. after, anew: what is done after each step, and
    after gaps. Collisions are not for loose graphs.
    """
    graph = settle(make_graph(*graph))
    if collisions is not None and "more_in" in graph[0].columns:
        raise ValueError("a loose graph lacks edges of collisions")
    size = n_nodes_and_edges(graph)
    for _ in range(max_rounds):
        graph = simplify(graph, longest_split, relative_split, longest_offshoot, after)
        if collisions is not None:
            graph = untangle_all(graph, collisions)
        if gaps is not None:
            pairs = greedy_matching(open_pairs(graph, gaps))
            graph = graph if pairs.isEmpty() else anew(bridge_gaps(graph, pairs))
        was, size = size, n_nodes_and_edges(graph)
        if was == size:
            return graph
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
