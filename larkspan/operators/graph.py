"""Graph analytics over edge tables: reach, flow, cycles, dead nodes, layers, interval joins, edge diffs.

Traversals are loops of frontier joins. Each round's frontier is written to the
shared scratch folder, so a lost executor never replays the rounds before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from larkspan.session import materialize

TEST_DEPTH, FLOW_DEPTH, FLOW_EDGES, LINES_KEPT = 3, 6, 60, 20
#: Intervals of up to 2**LEAST_LEVEL are filed together.
LEAST_LEVEL = 4
#: Cells of a reach sketch as a power of two, and the standard error of what it estimates.
SKETCH_BITS = 11
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def collapse(edges: DataFrame, by: list[str], line: str, keep: int = LINES_KEPT) -> DataFrame:
    """One row for each edge: how often it occurs and its first ``keep`` lines."""
    w = Window.partitionBy(*by).orderBy(line)
    ranked = edges.withColumn("_rn", F.row_number().over(w))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("count"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= keep, F.col(line)))).alias("lines"))


def resolvable(edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(edges whose two ends exist, the other edges)."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    ok = edges.join(n, F.col(source) == F.col("_n"), "left_semi").join(n, F.col(target) == F.col("_n"), "left_semi")
    return ok, edges.join(ok.select(source, target).distinct(), [source, target], "left_anti")


def bfs(edges: DataFrame, seeds: DataFrame, source: str, target: str, max_depth: int | None = None, stop_at: DataFrame | None = None) -> DataFrame:
    """(node, depth): the least number of edges from any seed; ``stop_at`` nodes are reached but not passed through."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    front = materialize(seeds.toDF("node").distinct().withColumn("depth", F.lit(0)), "front")
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        go = front if stop_at is None else front.join(stop_at.toDF("node"), "node", "left_anti")
        new = go.join(e, go["node"] == e["s"]).select(F.col("t").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        front = materialize(new, "front")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def flow(edges: DataFrame, entry, source: str, target: str, max_depth: int = FLOW_DEPTH, max_edges: int = FLOW_EDGES) -> DataFrame:
    """(hop, caller, callee, place) of the calls reached from ``entry``, in breadth-first order with callees sorted."""
    e = edges.select(F.col(source).alias("caller"), F.col(target).alias("callee")).distinct()
    reach = bfs(edges, e.sparkSession.createDataFrame([(entry,)], ["node"]), source, target, max_depth - 1)
    out = e.join(reach.select(F.col("node").alias("caller"), F.col("depth")), "caller").withColumn("hop", F.col("depth") + 1)
    w = Window.orderBy("hop", "caller", "callee")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_edges).select("hop", "caller", "callee", "place")


def reach_counts(edges: DataFrame, source: str, target: str, max_depth: int, seeds: DataFrame | None = None) -> DataFrame:
    """(node, reach): how many other nodes each node, or each of ``seeds`` (node), reaches within ``max_depth`` edges; none, no row."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s <> t").distinct()
    front = materialize(e if seeds is None else e.join(seeds.toDF("s").distinct(), "s", "left_semi"), "pairs")
    seen = front
    for _ in range(max_depth - 1):
        new = front.join(e.toDF("m", "n"), F.col("t") == F.col("m")).select("s", F.col("n").alias("t")).where("s <> t").distinct().join(seen, ["s", "t"], "left_anti")
        front = materialize(new, "pairs")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("reach"))


def reach_estimates(edges: DataFrame, source: str, target: str, max_depth: int, seeds: DataFrame) -> DataFrame:
    """(node, estimate) of the reach of ``seeds``, without listing what they reach.

    A node's sketch holds what it reaches within so many edges, itself included; each round unites the sketches of its
    targets, so a round moves one sketch of 2**SKETCH_BITS bytes at most for each edge.
    """
    e = materialize(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s <> t").distinct(), "edges")
    own = e.select(F.explode(F.array("s", "t")).alias("node")).distinct().groupBy("node").agg(F.hll_sketch_agg("node", SKETCH_BITS).alias("sketch"))
    own = materialize(own, "sketches")
    reach = own
    for depth in range(max_depth):
        use = e if depth < max_depth - 1 else e.join(seeds.toDF("s").distinct(), "s", "left_semi")
        came = use.join(reach, F.col("t") == F.col("node")).select(F.col("s").alias("node"), "sketch")
        reach = materialize(own.union(came).groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch")), "sketches")
    return seeds.toDF("node").distinct().join(reach, "node").select("node", (F.hll_sketch_estimate("sketch") - 1).alias("estimate"))


def entry_points(
    edges: DataFrame, nodes: DataFrame, node: str, source: str, target: str, declared: Column, min_reach: int = 3, most: int = 40, depth: int = FLOW_DEPTH,
) -> DataFrame:
    """Declared entries; else the ``most`` nodes nothing calls that reach enough, by reach.

    Only the declared nodes and those roots are followed whose estimated reach is within six standard errors of the last place.
    """
    called = edges.where(F.col(source) != F.col(target)).select(F.col(target).alias(node)).distinct()
    free = materialize(nodes.where(~declared).join(called, node, "left_anti").select(node).distinct(), "roots")
    if free.limit(most + 1).count() > most:
        guess = materialize(reach_estimates(edges, source, target, depth, free), "estimates")
        last = guess.orderBy(F.col("estimate").desc()).limit(most).agg(F.min("estimate")).first()[0] or 0
        free = guess.where(F.col("estimate") >= last * (1 - 6 * SKETCH_ERROR) / (1 + 6 * SKETCH_ERROR)).select(F.col("node").alias(node))
    known = materialize(nodes.where(declared).select(node), "declared")
    reach = reach_counts(edges, source, target, depth, known.select(node).union(free)).withColumnRenamed("node", node)
    roots = free.join(reach, node).where(F.col("reach") >= min_reach).orderBy(F.col("reach").desc(), node).limit(most).select(node, "reach", F.lit("root").alias("reason"))
    named = known.join(reach, node, "left").select(node, F.coalesce("reach", F.lit(0).cast("long")).alias("reach"), F.lit("declared").alias("reason"))
    return named.union(roots)


def trim(edges: DataFrame) -> DataFrame:
    """``edges`` (s, t) without those that no cycle can use: sources and sinks are taken away until none is left."""
    left = materialize(edges, "trim")
    while True:
        ins, outs = left.select(F.col("t").alias("n")).distinct(), left.select(F.col("s").alias("n")).distinct()
        kept = materialize(left.join(ins, F.col("s") == F.col("n"), "left_semi").join(outs, F.col("t") == F.col("n"), "left_semi"), "trim")
        if kept.count() == left.count():
            return kept
        left = kept


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """The least colour that reaches each node: minima travel along edges until nothing changes."""
    while True:
        came = edges.join(colours, F.col("s") == F.col("node")).select(F.col("t").alias("node"), "colour")
        new = materialize(colours.union(came).groupBy("node").agg(F.min("colour").alias("colour")), "colours")
        if not new.exceptAll(colours).limit(1).count():
            return new
        colours = new


def contract_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Take out all nodes with one edge in and one edge out, in a number of rounds logarithmic in the longest chain of them.

    ``edges`` (s, t) are distinct and without loops. Returns the edges that are
    left, with one for each chain between the nodes at its ends; the chains
    (last, a, b) by their last node and those ends; their nodes (node, last);
    and (node, component) of the cycles that consist of such nodes alone. Pointers
    to what follows are doubled each round, with the least name passed on the way.
    """
    outs, ins = edges.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("o"), F.min("t").alias("next")), edges.groupBy(F.col("t").alias("node")).agg(F.count("*").alias("i"))
    inner = materialize(outs.join(ins, "node").where("o = 1 AND i = 1").select("node", "next"), "inner")
    names = inner.select(F.col("node").alias("next"), F.lit(True).alias("more"))
    # done: the pointer has left the chain; last: its last node so far; least: the least name up to there
    start = inner.join(names, "next", "left").select("node", "next", F.col("more").isNull().alias("done"), F.col("node").alias("last"), F.col("node").alias("least"))
    jump, seen = materialize(start, "jumps"), None
    while True:
        n, mins = jump.where("NOT done").agg(F.count("*"), F.bit_xor(F.xxhash64("node", "least"))).first()
        if not n or (n, mins) == seen:  # what is left goes round and has met all names
            break
        seen = (n, mins)
        to = jump.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("done").alias("done2"), F.col("last").alias("last2"), F.col("least").alias("least2"))
        on = jump.where("NOT done").join(to, "next").select(
            "node", F.col("next2").alias("next"), F.col("done2").alias("done"), F.col("last2").alias("last"), F.least("least", "least2").alias("least"))
        jump = materialize(jump.where("done").union(on), "jumps")
    of = jump.where("done").select("node", "last", F.col("next").alias("b"))
    entry = edges.join(inner.select(F.col("node").alias("s")), "s", "left_anti").join(of.withColumnRenamed("node", "t"), "t")
    chains = materialize(entry.select("last", F.col("s").alias("a"), "b"), "chains")
    gone = inner.select("node")
    rest = edges.join(gone, F.col("s") == F.col("node"), "left_anti").join(gone, F.col("t") == F.col("node"), "left_anti")
    rest = materialize(rest.union(chains.where("a <> b").select("a", "b")).distinct(), "contracted")
    return rest, chains, of.select("node", "last"), jump.where("NOT done").select("node", F.col("least").alias("component"))


def strong_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more, and of single nodes with a self-loop.

    Chains of nodes with one edge in and one out are contracted and what no
    cycle can use is trimmed, in turn until they take less than a tenth; so long
    chains, closed or not, take a logarithmic number of rounds. What is left is
    coloured forward by the least node that reaches each; a colour's component
    is what reaches its root backward within the colour, and what is settled is
    taken out and the rest is done again. Then chains whose two ends are in one
    component are put back. A component is named by its least node.
    """
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    loops = e.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("component"))
    rest, levels, found = materialize(e.where("s <> t"), "edges"), [], None
    before = rest.count()
    while before:
        rest, chains, nodes, cycles = contract_chains(rest)
        levels.append((chains, nodes))
        found = cycles if found is None else found.union(cycles)
        rest = trim(rest)
        now = rest.count()
        if 10 * now > 9 * before:
            break
        before = now
    while rest.limit(1).count():
        nodes = rest.select(F.col("s").alias("node")).union(rest.select("t")).distinct()
        colour = _spread(rest, materialize(nodes.withColumn("colour", F.col("node")), "colours"))
        a, b = colour.toDF("s", "cs"), colour.toDF("t", "ct")
        inside = materialize(rest.join(a, "s").join(b, "t").where("cs = ct").select("s", "t", F.col("cs").alias("colour")), "inside")
        back = materialize(colour.where("node = colour"), "back")
        seen = back
        while True:
            step = back.join(inside, (F.col("node") == F.col("t")) & (back["colour"] == inside["colour"])).select(F.col("s").alias("node"), inside["colour"])
            back = materialize(step.distinct().join(seen, ["node", "colour"], "left_anti"), "back")
            if not back.limit(1).count():
                break
            seen = seen.union(back)
        seen = materialize(seen, "scc")
        found = seen.select("node", F.col("colour").alias("component")).union(found)
        gone = seen.select("node")
        rest = trim(rest.join(gone, F.col("s") == F.col("node"), "left_anti").join(gone, F.col("t") == F.col("node"), "left_anti"))
    if found is None:
        return loops
    for chains, nodes in reversed(levels):
        found = materialize(found, "found")
        # a chain that comes back to the node it left makes a component of that node, if it has none
        alone = chains.where("a = b").select(F.col("a").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        found = found.union(alone.select("node", F.col("node").alias("component")))
        ends = chains.join(found.toDF("a", "ca"), "a").join(found.toDF("b", "cb"), "b").where("ca = cb").select("last", F.col("ca").alias("component"))
        found = found.union(nodes.join(ends, "last").select("node", "component"))
    found = materialize(found, "found")
    names = found.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("name")).where("n > 1").select("component", "name")
    big = found.join(names, "component").select("node", F.col("name").alias("component"))
    return big.union(loops.join(big.select("node"), "node", "left_anti"))


def closing_chains(edges: DataFrame, added: DataFrame, source: str, target: str, max_depth: int = 20) -> DataFrame:
    """(source, target, chain) of the ``added`` edges (source, target) that close a cycle: the shortest path back, from target to source.

    Of several shortest paths the one whose names come first. All edges are
    followed together: a front holds, for every added edge and node, the first
    path of its length, and goes on from nodes that the edge has not reached
    before, until its source is reached or ``max_depth`` edges are used.
    """
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s <> t").distinct()
    front = added.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b").distinct()
    front = materialize(front.withColumns({"node": F.col("b"), "path": F.array("b")}), "chains")
    seen, found = front.select("a", "b", "node"), front.limit(0)
    for _ in range(max_depth):
        step = front.join(e, F.col("node") == F.col("s")).select("a", "b", F.col("t").alias("node"), F.concat("path", F.array("t")).alias("path"))
        new = step.groupBy("a", "b", "node").agg(F.min("path").alias("path")).join(seen, ["a", "b", "node"], "left_anti")
        new = materialize(new, "chains")
        if new.isEmpty():
            break
        found, seen = found.union(new.where("node = a")), seen.union(new.select("a", "b", "node"))
        closed = new.where("node = a").select("a", "b")
        front = new.join(closed, ["a", "b"], "left_anti")
    return found.select(F.col("a").alias(source), F.col("b").alias(target), F.col("path").alias("chain"))


def closing_chain(edges: DataFrame, source: str, target: str, start, end, max_depth: int = 20) -> list:
    """The shortest path from ``start`` to ``end``, least names first; empty if there is none. Bounded by ``max_depth``."""
    if start == end:
        return [start]
    kind = edges.schema[source].dataType
    one = edges.sparkSession.createDataFrame([(end, start)], StructType([StructField(source, kind), StructField(target, kind)]))
    row = closing_chains(edges, one, source, target, max_depth).first()
    return row["chain"] if row else []


def dead_nodes(nodes: DataFrame, calls: DataFrame, node: str, source: str, target: str, is_test: Column, exempt: Column) -> DataFrame:
    """(node, verdict): ``unused`` where nothing else calls it, ``test_only`` where only tests do.

    ``is_test`` is over the columns of ``nodes``; a node's call of itself is no use.
    """
    callers = calls.where(F.col(source) != F.col(target)).join(nodes.select(F.col(node).alias(source), is_test.alias("_t")), source)
    use = callers.groupBy(F.col(target).alias(node)).agg(F.bool_and("_t").alias("_only"))
    out = nodes.where(~exempt & ~is_test).join(use, node, "left")
    verdict = F.when(F.col("_only").isNull(), "unused").when(F.col("_only"), "test_only")
    return out.select(node, verdict.alias("verdict")).where("verdict IS NOT NULL")


def assign_layer(items: DataFrame, rules: DataFrame, key: str, matches: Column) -> DataFrame:
    """(key, layer, ordinal): the first layer in declared order whose rule matches; null where none does.

    ``rules`` (ordinal, layer, ...) is configuration; the join condition is ``matches``.
    """
    hit = items.join(rules, matches).groupBy(key).agg(F.min(F.struct("ordinal", "layer")).alias("_l"))
    return items.select(key).join(hit, key, "left").select(key, F.col("_l.layer").alias("layer"), F.col("_l.ordinal").alias("ordinal"))


def layer_calls(calls: DataFrame, layers: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """(from_layer, to_layer, direction, calls) of calls that cross layers; ``up`` goes from a later layer to an earlier one."""
    s = layers.select(F.col(key).alias(source), F.col("layer").alias("from_layer"), F.col("ordinal").alias("_so"))
    t = layers.select(F.col(key).alias(target), F.col("layer").alias("to_layer"), F.col("ordinal").alias("_to"))
    out = calls.join(s, source).join(t, target).where(F.col("_so") != F.col("_to"))
    return out.groupBy("from_layer", "to_layer", F.when(F.col("_so") > F.col("_to"), "up").otherwise("down").alias("direction")).agg(F.count("*").alias("calls"))


def layer_violations(calls: DataFrame, layers: DataFrame, names: DataFrame, source: str, target: str, key: str, name: str) -> DataFrame:
    """Calls that go up, to callees whose name is unique."""
    unique = names.groupBy(name).agg(F.min(key).alias(target), F.count("*").alias("_n")).where("_n = 1").select(target)
    s = layers.select(F.col(key).alias(source), F.col("ordinal").alias("_so"))
    t = layers.select(F.col(key).alias(target), F.col("ordinal").alias("_to"))
    return calls.join(s, source).join(t, target).where(F.col("_so") > F.col("_to")).join(unique, target, "left_semi").select(source, target)


def _level(start: str, end: str) -> Column:
    """Bits of the width of the least cell of 2**level that is at least as wide as the interval."""
    more = F.greatest(F.col(start), F.col(end)).cast("long") - F.col(start).cast("long")
    return F.greatest(F.lit(LEAST_LEVEL), F.when(more == 0, 0).otherwise(F.length(F.bin(more))))


def _levels(df: DataFrame) -> Column:
    """The levels of ``df``'s intervals, at most 64 of them, as an array."""
    found = df.select("_level").where("_level IS NOT NULL").distinct().collect()
    return F.array(*[F.lit(r[0]) for r in sorted(found)]).cast("array<int>")


def interval_join(left: DataFrame, right: DataFrame, by: str, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Rows of the two sides that overlap within ``by``, each pair once; ranges are inclusive, a null end meets nothing.

    Cells of level k are 2**k wide. An interval lies in one or two cells of its own level, the least that is as wide
    as it is, and a pair meets at the level of the wider one: rows wait at their own level and ask at those above it that the other
    side has. A long interval therefore costs as many rows as a short one or fewer, and covers at least a quarter of what
    it is compared with on average. Of two common cells the one where the later of the two begins gives the pair.
    Runs a job a side for the levels.
    """
    (ls, le), (rs, re) = left_range, right_range
    one, two = left.withColumn("_level", _level(ls, le)), right.withColumn("_level", _level(rs, re))
    on_left, on_right = _levels(one), _levels(two)

    def spread(df: DataFrame, a: str, b: str, wait: bool, others: Column, above_own) -> DataFrame:
        # turn 0: the left side waits, so equal levels meet there alone
        own = F.array(F.struct(F.lit(0 if wait else 1).alias("turn"), F.col("_level").alias("level")))
        above = F.transform(F.filter(others, above_own), lambda k: F.struct(F.lit(1 if wait else 0).alias("turn"), k.alias("level")))
        at = df.withColumn("_at", F.explode(F.concat(own, above))).drop("_level")
        cell = lambda c: F.expr(f"shiftright(CAST({c} AS BIGINT), _at.level)")
        return at.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(f"`{a}`"), cell(f"greatest(`{a}`, `{b}`)")))))

    waits = spread(one, ls, le, True, on_right, lambda k: k > F.col("_level"))
    asks = spread(two, rs, re, False, on_left, lambda k: k >= F.col("_level"))
    hit = waits.join(asks, [by, "_at", "_cell"])
    later = F.expr(f"shiftright(CAST(greatest(`{ls}`, `{rs}`) AS BIGINT), _at.level)")
    return hit.where((F.col(rs) <= F.col(le)) & (F.col(re) >= F.col(ls)) & (later == F.col("_cell"))).drop("_at", "_cell")


def innermost(items: DataFrame, path: str, start: str, end: str, key: str) -> DataFrame:
    """Rows whose interval strictly contains no other row's of the same path, by one pass over ends in order."""
    w = Window.partitionBy(path).orderBy(F.col(start).desc(), F.col(end), key).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(end).over(w)
    return items.withColumn("_e", least).where(F.col("_e").isNull() | (F.col("_e") > F.col(end))).drop("_e")


def focus(edges: DataFrame, source: str, target: str, node) -> DataFrame:
    """Edges at one node, with the direction."""
    n = F.lit(node)
    return edges.where((F.col(source) == n) | (F.col(target) == n)).withColumn(
        "direction", F.when((F.col(source) == n) & (F.col(target) == n), "self").when(F.col(source) == n, "out").otherwise("in"))


def overlay(snapshot: DataFrame, working: DataFrame, changed: DataFrame, path: str) -> DataFrame:
    """Rows of the working copy for changed paths, of the snapshot for the rest."""
    return snapshot.join(changed.select(path).distinct(), path, "left_anti").unionByName(working)


def edge_changes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Edges on one side only, as (…, change)."""
    a, b = old.select(*by).distinct(), new.select(*by).distinct()
    return b.join(a, by, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, by, "left_anti").withColumn("change", F.lit("removed")))


def flow_stamp(reach: DataFrame, by: str, anchor: str, digest: str) -> DataFrame:
    """Digest of everything a flow reaches, whatever the order it was found in."""
    lines = F.array_sort(F.collect_list(F.concat_ws("=", anchor, digest)))
    return reach.groupBy(by).agg(F.substring(F.sha1(F.array_join(lines, "\n")), 1, 12).alias("stamp"))


def closest_names(wanted: str, names: list[str], least: float = 0.6, most: int = 3) -> list[str]:
    """Names most like ``wanted`` by matching blocks, best first."""
    import difflib

    return difflib.get_close_matches(wanted, sorted(set(names)), n=most, cutoff=least)


def symbol_lookup(symbols: DataFrame, wanted: str, name: str = "name", key: str = "id", path: str | None = None) -> DataFrame:
    """Exact id or name, else the last segment of the name; optionally below a path suffix."""
    s = symbols if path is None else symbols.where(F.col("path").endswith(path))
    tail = F.substring_index(F.col(name), ".", -1)
    place = F.when((F.col(key) == wanted) | (F.col(name) == wanted), 0).when(tail == wanted.rsplit(".", 1)[-1], 1)
    hits = s.withColumn("_p", place).where("_p IS NOT NULL")
    return hits.withColumn("_m", F.min("_p").over(Window.partitionBy())).where("_p = _m").drop("_p", "_m")


def affected_tests(symbols: DataFrame, calls: DataFrame, imports: DataFrame, changes: DataFrame, is_test: Column, depth: int = TEST_DEPTH) -> DataFrame:
    """(path, reason, distance): test files that changes reach, by calls within ``depth`` and by imports.

    ``symbols`` (id, path, start_line, end_line), ``calls`` (source, target ids),
    ``imports`` (source, target paths), ``changes`` (path, line; a null line is the
    whole file). The innermost changed function counts where lines are known.
    """
    lines = changes.where("line IS NOT NULL").withColumn("line_end", F.col("line"))
    hit = interval_join(symbols, lines, "path", ("start_line", "end_line"), ("line", "line_end")).select("id", "path", "start_line", "end_line").distinct()
    whole = symbols.join(changes.where("line IS NULL").select("path").distinct(), "path", "left_semi").select("id")
    seeds = innermost(hit, "path", "start_line", "end_line", "id").select("id").union(whole).distinct()
    reached = bfs(calls, seeds, "target", "source", depth)
    tests = symbols.where(is_test)
    by_call = tests.join(reached, F.col("id") == F.col("node")).groupBy("path").agg(F.min("depth").alias("distance")).withColumn("reason", F.lit("calls"))
    files = bfs(imports, changes.select("path").distinct(), "target", "source")
    by_import = tests.select("path").distinct().join(files, F.col("path") == F.col("node")).select("path", F.col("depth").alias("distance"), F.when(F.col("depth") == 0, "changed").otherwise("imports").alias("reason"))
    both = by_call.select("path", "reason", "distance").union(by_import.select("path", "reason", "distance"))
    order = F.when(F.col("reason") == "changed", 0).when(F.col("reason") == "calls", 1).otherwise(2)
    w = Window.partitionBy("path").orderBy(order, "distance")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# Names of files that decide how all code is built or tested, as patterns, by what reads them.
BUILD_NAMES = (
    "package(-lock)?\\.json", "npm-shrinkwrap\\.json", "yarn\\.lock", "pnpm-(lock|workspace)\\.yaml", "bun\\.lockb?",
    "[tj]sconfig[^/]*\\.json", "(babel|jest|vite|vitest)\\.config\\.[^/]+", "\\.babelrc", "\\.mocharc[^/]*",
    "pyproject\\.toml", "setup\\.(py|cfg)", "(tox|pytest)\\.ini", "[\\w.-]*requirements[^/]*\\.txt", "(poetry|uv)\\.lock", "Pipfile(\\.lock)?",
    "go\\.(mod|sum|work|work\\.sum)", "[Cc]argo\\.(toml|lock)",
    "pom\\.xml", "(build|settings)\\.gradle(\\.kts)?", "gradle\\.properties",
    "\\.env[^/]*", "Dockerfile", "Makefile",
)
# Folders and names of files that only decide where code is built, or say something about the repository.
PIPELINE_FOLDERS = ("\\.github", "\\.gitlab", "\\.circleci", "\\.buildkite")
PIPELINE_NAMES = (
    "\\.gitlab-ci\\.ya?ml", "azure-pipelines\\.ya?ml", "bitbucket-pipelines\\.ya?ml", "\\.travis\\.ya?ml", "Jenkinsfile",
    "\\.gitignore", "\\.gitattributes", "\\.editorconfig", "\\.mailmap", "\\.npmignore", "CODEOWNERS", "LICENSE(\\.[^/]*)?",
)
BUILD_FILES = f"(^|/)({'|'.join(BUILD_NAMES)})$"
PIPELINE_FILES = f"(^|/)({'|'.join(PIPELINE_FOLDERS)})/|(^|/)({'|'.join(PIPELINE_NAMES)})$"


def run_all_reasons(changes: DataFrame, analysed: DataFrame, kind: Column) -> DataFrame:
    """(path, reason): changed files for which every test has to run.

    ``configuration`` files say how code is built or tested; ``not analysed`` is
    code (``kind`` of the path) that the import graph (``analysed`` paths) does not know, so
    nothing tells which tests reach it.
    """
    paths = changes.select("path").distinct().where(~F.col("path").rlike(PIPELINE_FILES))
    known = analysed.select("path").distinct().withColumn("_known", F.lit(True))
    reason = F.when(F.col("path").rlike(BUILD_FILES), "configuration").when((kind == "code") & F.col("_known").isNull(), "not analysed")
    return paths.join(known, "path", "left").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def fixture_tests(changes: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, fixtures): tests in or below the folder of a changed ``conftest.py``, with the deepest such file."""
    folders = changes.where(F.substring_index("path", "/", -1) == "conftest.py").select(
        F.col("path").alias("fixtures"), F.regexp_replace("path", "/?conftest\\.py$", "").alias("_folder")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = tests.select("path", F.explode(above).alias("_folder")).join(folders, "_folder")
    return found.groupBy("path").agg(F.max_by("fixtures", F.length("_folder")).alias("fixtures"))


def removed_callers(old: DataFrame, new: DataFrame, sites: DataFrame, name: str, where: str) -> DataFrame:
    """Call sites of functions that are gone: names on the old side only, matched by their last segment."""
    gone = old.select(name).distinct().join(new.select(name).distinct(), name, "left_anti").select(name, F.substring_index(name, ".", -1).alias("_short"))
    return sites.join(gone, F.substring_index(sites["callee"], ".", -1) == F.col("_short")).select(name, where).distinct()


def changed_signatures(old: DataFrame, new: DataFrame, name: str, digest: str) -> DataFrame:
    """Names defined once on either side whose digests differ."""
    def once(df, out):
        return df.groupBy(name).agg(F.count("*").alias("_n"), F.first(digest).alias(out)).where("_n = 1").drop("_n")

    return once(old, "before").join(once(new, "after"), name).where(F.col("before") != F.col("after"))


def stale_marks(marks: DataFrame, current: DataFrame, key: str, stamps: list[str]) -> DataFrame:
    """(key, status): missing, or the first of ``stamps`` that differs from the current one (nulls are equal to nulls)."""
    c = current.select(key, *[F.col(s).alias(f"_{s}") for s in stamps], F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing")
    for s in stamps:
        status = status.when(~F.col(s).eqNullSafe(F.col(f"_{s}")), s)
    return marks.join(c, key, "left").select(key, status.alias("status")).where("status IS NOT NULL")


def added_dead(old: DataFrame, new: DataFrame, dead: DataFrame, name: str) -> DataFrame:
    """Functions that ``new`` has beyond ``old`` and that nothing calls (``dead``)."""
    return new.join(old.select(name).distinct(), name, "left_anti").join(dead.select(name).distinct(), name, "left_semi")
