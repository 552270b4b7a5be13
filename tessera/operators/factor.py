"""Fill-reducing orders, and the elimination tree and size of a Cholesky factor.

Orders from other programs differ in their numbers; these keep the contract of an order: a permutation that lowers fill.
"""

from __future__ import annotations

import heapq
import math
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, drop, shared_dir
from tessera.operators.ordering import adjacency, dense_number

#: Entries that one task joins to an elimination tree at a time, and rows of which a stretch of them takes all or none.
STRETCH, BLOCK = 250_000, 64
#: Nodes, edges and members of elements that one task eliminates by itself.
PIECE = 250_000


def nested_dissection(points: DataFrame, edges: DataFrame, leaf: int = 32) -> DataFrame:
    """old_id, new_id by recursive coordinate bisection, for every level all parts at once.

    A part is halved at the median of its longer side (its rank is exact to one in ten thousand); nodes of the lower half with an edge to the upper one
    are the separator and come behind both.
    """
    pairs = cut(adjacency(edges))
    n = max(1, points.count())
    state = points.select("id", "x", "y", F.lit("").alias("path"), F.lit(False).alias("fixed"))
    for level in range(max(0, math.ceil(math.log2(n / leaf)))):
        # a row for each part, from partial aggregates: no task sees a whole part
        spans = [(F.max(c) - F.min(c)).alias(f"{c}_span") for c in "xy"]
        middles = [F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_half") for c in "xy"]
        parts = state.filter("not fixed").groupBy("path").agg(*spans, *middles)
        upper = F.when(F.col("x_span") >= F.col("y_span"), F.col("x") > F.col("x_half")).otherwise(F.col("y") > F.col("y_half"))
        half = state.filter("not fixed").join(parts, "path").select("id", "x", "y", "path", upper.alias("upper"))
        side = half.select("id", "path", "upper")
        over = pairs.join(side.select(F.col("id").alias("row"), F.col("path").alias("p"), F.col("upper").alias("u")), "row").join(side.select(F.col("id").alias("col"), F.col("path").alias("q"), F.col("upper").alias("v")), "col")
        cut_ = over.filter("p = q and not u and v").select(F.col("row").alias("id"), F.lit(True).alias("on")).distinct()
        step = F.when(F.coalesce("on", F.lit(False)), "2").when(F.col("upper"), "1").otherwise("0")
        moved = half.join(cut_, "id", "left").select("id", "x", "y", F.concat("path", step).alias("path"), F.coalesce("on", F.lit(False)).alias("fixed"))
        state = cut(moved.union(state.filter("fixed")), instead=[state])
    return dense_number(state.withColumnRenamed("id", "old_id"), ["path", "old_id"], "new_id").select("old_id", "new_id")


def _least_first(rows: pd.DataFrame) -> pd.DataFrame:
    """Eliminates the free nodes of a piece, each time one of about the least degree: its (kind, a, b) before and after.

    Kind 0 is a node a and whether it is free (before), or an eliminated node and its place (after); 1 an edge; 2 an element a and its
    member b. Degrees are bounds: edges, the new element, and what other elements have outside it. Elements
    inside the new one go, and free nodes that are left with nothing but it follow at once.
    """
    piece = int(rows["piece"].iloc[0])
    table = {kind: list(zip(t["a"].tolist(), t["b"].tolist(), strict=True)) for kind, t in rows.groupby("kind")}
    free = {a for a, b in table.get(0, []) if b}
    near: dict[int, set] = {a: set() for a, _ in table.get(0, [])}
    of: dict[int, set] = {a: set() for a in near}
    members: dict[int, set] = {}
    for a, b in table.get(1, []):
        near[a].add(b)
    for e, a in table.get(2, []):
        of[a].add(e)
        members.setdefault(e, set()).add(a)
    degree = {v: len(near[v]) + sum(len(members[e]) - 1 for e in of[v]) for v in free}
    queue = [(d, v) for v, d in degree.items()]
    heapq.heapify(queue)
    order = []
    while queue:
        d, p = heapq.heappop(queue)
        if degree.get(p) != d:
            continue
        around = near.pop(p).union(*[members[e] for e in of[p]]) - {p}
        taken = of.pop(p)
        for e in taken:
            del members[e]
        del degree[p]
        order.append(p)
        outside: dict[int, int] = {}
        for v in around:
            of[v] -= taken
            for e in of[v]:
                outside[e] = outside.get(e, len(members[e])) - 1
        inside = {e for e, n in outside.items() if not n}
        for e in inside:
            del members[e]
        follow = set()
        for v in around:
            of[v] -= inside
            near[v] = near[v] - around
            near[v].discard(p)
            if v in free and not of[v] and not near[v]:
                follow.add(v)
        for v in sorted(follow):
            order.append(v)
            del near[v], of[v], degree[v]
        around -= follow
        if around:
            members[p] = around
        for v in around:
            if v in free:
                degree[v] = min(len(near[v]) + len(around) - 1 + sum(outside[e] for e in of[v]), degree[v] + len(around) - 1)
                heapq.heappush(queue, (degree[v], v))
            of[v].add(p)
    out = [(0, v, i) for i, v in enumerate(order)] + [(1, a, b) for a, others in near.items() for b in others] + [(2, e, v) for e, of_it in members.items() for v in of_it]
    return pd.DataFrame(out, columns=["kind", "a", "b"], dtype="int64").assign(piece=piece).astype({"kind": "int32"})[["piece", "kind", "a", "b"]]


def _pieces(nodes: DataFrame, near: DataFrame, member: DataFrame, entries: int, most: int) -> DataFrame:
    """id, piece: parts of the graph that hang together, of about an eighth of ``most`` entries each and no more than about that.

    A node begins in one of its elements, or by itself. In each round parts whose hash is the greatest among their neighbours take
    these in, until parts are few enough; parts that have grown too large are dealt by hashes.
    """
    own = member.groupBy(F.col("u").alias("id")).agg(F.max(F.struct(F.xxhash64("e").alias("h"), "e")).alias("own"))
    label = cut(nodes.join(own.hint("merge"), "id", "left").select("id", F.coalesce("own.e", "id").alias("piece")))
    at = lambda c: label.select(F.col("id").alias(c), F.col("piece").alias(f"{c}_at")).hint("merge")
    edge = near.join(at("u"), "u").join(at("w"), "w").select(F.col("u_at").alias("a"), F.col("w_at").alias("b"))
    tie = member.join(at("u"), "u").select(F.col("e").alias("a"), F.col("u_at").alias("b"))
    links = cut(edge.union(tie).union(tie.select("b", "a")).filter("a <> b").distinct())
    count, turn = label.select("piece").distinct().count(), 0
    while count * most > 8 * entries:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731  used before the turn changes
        centres = links.groupBy("a").agg(F.max(rank("b")).alias("best")).filter(F.col("best") < rank("a")).select(F.col("a").alias("b"))
        into = cut(links.join(centres.hint("merge"), "b").groupBy("a").agg(F.max(rank("b")).alias("best")).select("a", F.col("best.v").alias("into")))
        to = lambda c: into.select(F.col("a").alias(c), F.col("into").alias(f"{c}_into")).hint("merge")  # noqa: B023, E731
        label = cut(label.join(to("piece"), "piece", "left").select("id", F.coalesce("piece_into", "piece").alias("piece")), instead=[label])
        moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_into", "a").alias("a"), F.coalesce("b_into", "b").alias("b"))
        links = cut(moved.filter("a <> b").distinct(), instead=[links])
        drop(into)
        before, count, turn = count, label.select("piece").distinct().count(), turn + 1
        if count > 0.95 * before:
            break
    drop(links)
    load = nodes.select("id").union(near.select("u")).union(member.select("u")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    held = label.join(load.hint("merge"), "id").groupBy("piece").agg(F.ceil(F.sum("n") / most).alias("shares")).filter("shares > 1")
    share = F.xxhash64("piece", F.pmod(F.xxhash64("id"), F.col("shares")))
    return cut(label.join(held.hint("merge"), "piece", "left").select("id", F.when(F.col("shares") > 1, share).otherwise(F.col("piece")).alias("piece")), instead=[label])


def _in_pieces(near: DataFrame, member: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eliminates, a task for each piece, the nodes whose edges and elements lie inside it: the eliminated (id, after, place), and the edges and members left."""
    at = lambda c: pieces.select(F.col("id").alias(c), F.col("piece").alias(f"{c}_at")).hint("merge")
    edge = cut(near.join(at("u"), "u").join(at("w"), "w").select("u", "w", "u_at", (F.col("u_at") == F.col("w_at")).alias("inner")))
    tie = member.join(at("u"), "u")
    ends = tie.groupBy("e").agg((F.min("u_at") == F.max("u_at")).alias("inner"))
    tie = cut(tie.join(ends.hint("merge"), "e").select("e", "u", "u_at", "inner"))
    bound = edge.filter("not inner").select("u").union(tie.filter("not inner").select("u")).distinct()
    kind = lambda k: F.lit(k).alias("kind")
    rows = pieces.join(bound.select(F.col("u").alias("id"), F.lit(0).cast("long").alias("free")).hint("merge"), "id", "left").select("piece", kind(0), F.col("id").alias("a"), F.coalesce("free", F.lit(1).cast("long")).alias("b"))
    rows = rows.union(edge.filter("inner").select("u_at", kind(1), "u", "w")).union(tie.filter("inner").select("u_at", kind(2), "e", "u"))
    out = cut(rows.groupBy("piece").applyInPandas(_least_first, "piece long, kind int, a long, b long"))
    gone = out.filter("kind = 0").select(F.col("a").alias("id"), F.col("piece").alias("after"), F.col("b").cast("int").alias("place"))
    left = cut(out.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("w")).union(edge.filter("not inner").select("u", "w")))
    held = cut(out.filter("kind = 2").select(F.col("a").alias("e"), F.col("b").alias("u")).union(tie.filter("not inner").select("e", "u")))
    return cut(gone, instead=[edge, tie, out]), left, held


def _independent(nodes: DataFrame, near: DataFrame, member: DataFrame, slack: float, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eliminates nodes of about the least degree that are not neighbours: the eliminated (id, after, place), and the edges and members left.

    Of the nodes whose bound is within ``slack`` of the least, those go that come first (by bound, a hash, id) among their edges and in all
    their elements. Edges inside a new element go, and nodes that are left with nothing but it follow its node at
    once, as they add no fill. Least keys of edges and elements are found by grouping; no pairs of members are made.
    """
    sizes = member.groupBy("e").agg((F.count(F.lit(1)) - 1).alias("others"))
    joined = member.join(sizes.hint("merge"), "e").groupBy(F.col("u").alias("id")).agg(F.sum("others").alias("in_elements"))
    linked = near.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("in_edges"))
    bound = F.coalesce("in_edges", F.lit(0)) + F.coalesce("in_elements", F.lit(0))
    degrees = cut(nodes.join(linked.hint("merge"), "id", "left").join(joined.hint("merge"), "id", "left").select("id", bound.alias("degree")))
    least = degrees.agg(F.min("degree")).first()[0]
    ready = degrees.filter(F.col("degree") <= slack * least).select("id", F.struct("degree", F.xxhash64("id", F.lit(turn)).alias("h"), "id").alias("key"))
    first = member.join(ready.withColumnRenamed("id", "u").hint("merge"), "u").groupBy("e").agg(F.min("key").alias("first"))
    among = member.join(first.hint("merge"), "e").groupBy(F.col("u").alias("id")).agg(F.min("first").alias("in_elements"))
    beside = near.join(ready.withColumnRenamed("id", "w").hint("merge"), "w").groupBy(F.col("u").alias("id")).agg(F.min("key").alias("in_edges"))
    before = lambda c: F.coalesce(F.col(c) < F.col("key"), F.lit(False))
    chosen = cut(ready.join(among.hint("merge"), "id", "left").join(beside.hint("merge"), "id", "left").filter(~before("in_elements") & ~before("in_edges")).select("id"))
    at = lambda c: chosen.select(F.col("id").alias(c)).hint("merge")
    taken_in = member.join(at("u"), "u").select("e", F.col("u").alias("by"))
    moved = member.join(taken_in.hint("merge"), "e", "left").select(F.coalesce("by", "e").alias("e"), "u")
    grown = cut(moved.union(near.join(at("u"), "u").select(F.col("u").alias("e"), F.col("w").alias("u"))).join(at("u"), "u", "left_anti").distinct())
    fresh = grown.join(at("e"), "e", "left_semi")
    kept = near.join(at("u"), "u", "left_anti").join(at("w"), "w", "left_anti").select("u", "w")
    inside = kept.join(fresh.hint("merge"), "u").join(fresh.select("e", F.col("u").alias("w")).hint("merge"), ["e", "w"]).select("u", "w").distinct()
    left = cut(kept.join(inside.hint("merge"), ["u", "w"], "left_anti"))
    only = grown.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e")).filter("n = 1").join(at("e"), "e", "left_semi").join(left.hint("merge"), "u", "left_anti")
    gone = cut(chosen.select("id", F.col("id").alias("after"), F.lit(0).alias("place")).union(only.select("u", "e", F.lit(1))))
    held = cut(grown.join(gone.select(F.col("id").alias("u")).hint("merge"), "u", "left_anti").select("e", "u"), instead=[degrees, chosen, grown])
    return gone, left, held


def minimum_degree(edges: DataFrame, slack: float = 1.5, most: int = PIECE) -> DataFrame:
    """old_id, new_id: nodes of about the least degree are eliminated first, piece by piece.

    An eliminated node stays as an element, the set of nodes it joins, instead of the edges among them; an element takes in those
    that its node was in, so the tables (edges u, w and members e, u) never grow. The graph is cut into pieces of at most about ``most``
    entries. A task for each piece eliminates the nodes that have no neighbour outside; what is left, the pieces' borders, is cut
    into pieces anew, until it is one piece. Where pieces have next to no inside, a round over the whole graph takes
    nodes that are not neighbours (see _independent).
    """
    spark = edges.sparkSession
    edges = cut(edges.select("row", "col"))  # stencils that are still to be found are found once
    nodes = cut(edges.select(F.col("row").alias("id")).union(edges.select("col")).distinct())
    near = cut(adjacency(edges).select(F.col("row").alias("u"), F.col("col").alias("w")))
    member = cut(spark.createDataFrame([], "e long, u long"))
    done, turn, stuck = f"{shared_dir(spark)}/eliminated-{uuid.uuid4().hex}", 0, False
    while n := nodes.count():
        entries = n + near.count() + member.count()
        if entries > most and stuck:
            gone, left, held = _independent(nodes, near, member, slack, turn)
            stuck = turn % 8 > 0  # borders may be fewer after some rounds
        else:
            pieces = _pieces(nodes, near, member, entries, most) if entries > most else cut(nodes.select("id", F.lit(0).cast("long").alias("piece")))
            gone, left, held = _in_pieces(near, member, pieces)
            drop(pieces)
            stuck = 10 * gone.count() < n
        gone.write.parquet(f"{done}/turn={turn}")
        rest = nodes.join(gone.select("id").hint("merge"), "id", "left_anti")
        nodes, near, member, turn = cut(rest, instead=[nodes, near, member, gone]), left, held, turn + 1
    if not turn:
        return spark.createDataFrame([], "old_id long, new_id long")
    order = spark.read.schema("id long, after long, place int, turn int").parquet(done)
    return dense_number(order.withColumnRenamed("id", "old_id"), ["turn", "after", "place", "old_id"], "new_id").select("old_id", "new_id")


def _climbed(entries: pd.DataFrame) -> pd.DataFrame:
    """node, parent, top: of each node in a stretch of entries (i, j), its parent and the topmost of its ancestors, where the stretch tells one.

    Row by row, each entry goes up to the root of what is joined so far, which gets the row's node as its parent; the nodes it passed
    point there from then on.
    """
    parent, above = {}, {}
    rows = entries.sort_values(["i", "j"])
    for i, j in zip(rows["i"].tolist(), rows["j"].tolist(), strict=True):
        while j != i:
            at = above.get(j)
            above[j] = i
            if at is None:
                parent[j] = i
                break
            j = at
    top = {}
    for node in sorted(above, reverse=True):  # an ancestor is greater than its node
        top[node] = top.get(above[node], above[node])
    return pd.DataFrame({"node": list(top), "parent": [parent[v] for v in top], "top": list(top.values())}, dtype="int64")


def _stretches(lower: DataFrame, most: int) -> list[int]:
    """Rows at which stretches of about ``most`` entries end, from the counts of blocks of rows."""
    blocks = lower.groupBy(F.floor(F.col("i") / BLOCK).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    ends, held = [], 0
    for block, n in sorted(map(tuple, blocks.collect())):
        if held and held + n > most:
            ends.append(block * BLOCK)
            held = 0
        held += n
    return [*ends, (block + 1) * BLOCK] if held else []


def elimination_tree(lower: DataFrame, most: int = STRETCH) -> DataFrame:
    """node, parent of the elimination tree of a pattern (i, j), i > j; roots have no row.

    An entry says that i is an ancestor of j. Rows are taken in order, in stretches of about ``most`` entries (a stretch never cuts
    a block of ``BLOCK`` rows). One task joins a stretch; then the entries of all later rows move up to the topmost ancestor that is known of their
    nodes, where many become one. So no task holds more than a stretch, and the rounds are as many as there are stretches,
    whatever the depth of the tree.
    """
    entries = cut(lower.select("i", "j").distinct())
    ends = _stretches(entries, most)
    found: list[DataFrame] = []
    for turn, end in enumerate(ends):
        stretch = entries.filter(F.col("i") < end).withColumn("stretch", F.lit(turn)).groupBy("stretch").applyInPandas(_climbed, "node long, parent long, top long")
        found.append(cut(stretch))
        if turn + 1 < len(ends):
            moved = entries.filter(F.col("i") >= end).join(found[-1].select(F.col("node").alias("j"), "top"), "j", "left")
            entries = cut(moved.select("i", F.coalesce("top", "j").alias("j")).distinct(), instead=[entries])
    drop(entries)
    none = lower.sparkSession.createDataFrame([], "node long, parent long")
    return cut(reduce(DataFrame.union, [t.select("node", "parent") for t in found], none), instead=found)


def _toured(nodes: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """node, depth (1 for roots), at: the place of each of n nodes on a tour of its forest that enters a node before all below it.

    The tour is a list of steps, into each node (2 * node) and out of it again (2 * node + 1). Steps are numbered from the
    end by doubling: each round, a step adds what the step it points to has and points to where that one does.
    """
    root = F.lit(n).cast("long")
    forest = cut(nodes.join(tree, "node", "left").select("node", F.coalesce("parent", root).alias("parent")))
    numbered = cut(dense_number(forest, ["parent", "node"], "g"))  # brothers stand side by side, however many a parent has
    after = numbered.select((F.col("g") - 1).alias("g"), F.col("node").alias("brother"), F.col("parent").alias("of"))
    first = forest.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    linked = numbered.join(after, "g", "left").join(first, "node", "left")
    into, out = F.col("node") * 2, F.col("node") * 2 + 1
    brother = F.when(F.col("of") == F.col("parent"), F.col("brother") * 2)
    leave = F.coalesce(brother, F.when(F.col("parent") < root, F.col("parent") * 2 + 1))
    one = F.lit(1).cast("long")
    steps = linked.select(into.alias("step"), F.coalesce(F.col("child") * 2, out).alias("to"), one.alias("left"), one.alias("down"))
    steps = cut(steps.union(linked.select(out, leave, one, -one)), instead=[forest, numbered])
    for _ in range((2 * n - 1).bit_length()):
        beyond = steps.select(F.col("step").alias("to"), F.col("to").alias("to_"), F.col("left").alias("left_"), F.col("down").alias("down_"))
        added = [(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("left", "down")]
        steps = cut(steps.join(beyond, "to", "left").select("step", F.col("to_").alias("to"), *added), instead=[steps])
    entered = steps.filter("step % 2 = 0")
    return cut(entered.select((F.col("step") / 2).cast("long").alias("node"), (1 - F.col("down")).alias("depth"), (2 * n - F.col("left")).alias("at")), instead=[steps])


def factor_rows(edges: DataFrame, order: DataFrame) -> DataFrame:
    """row, nonzeros: the entries (diagonal included) in each row of the Cholesky factor of the symmetrised graph in an order.

    A row's pattern is what lies on the paths of the elimination tree from its entries up to its own node. Entries of a row are met in the
    order of a tour of the tree: each adds the path up to where it meets the one before, whose depth is one less than
    the least depth on the tour between them. Least depths come from blocks of powers of two, of which a stretch takes a few. Rows
    of any length are dealt over tasks; the factor itself is never made.
    """
    order = cut(order)
    new = lambda c: order.select(F.col("old_id").alias(c), F.col("new_id").alias(f"n_{c}"))
    lower = cut(adjacency(edges).join(new("row"), "row").join(new("col"), "col").filter("n_col < n_row").select(F.col("n_row").alias("i"), F.col("n_col").alias("j")))
    nodes = order.select(F.col("new_id").alias("node"))
    n = nodes.count()
    if not n:
        return nodes.select(F.col("node").alias("row"), F.col("node").alias("nonzeros"))
    places = _toured(nodes, elimination_tree(lower), n)
    entry = places.select(F.col("node").alias("j"), "depth", "at")
    own = places.select(F.col("node").alias("i"), F.col("depth").alias("top"))
    met = cut(dense_number(lower.join(entry, "j").join(own, "i"), ["i", "at"], "g"))
    ahead = met.select((F.col("g") + 1).alias("g"), F.col("i").alias("i_"), F.col("at").alias("at_"))
    both = met.join(ahead, "g", "left").select("g", "i", "depth", "top", F.when(F.col("i") == F.col("i_"), F.col("at_") + 1).alias("a"), (F.col("at") + 1).alias("b"))
    levels = (2 * n).bit_length()
    low, high = "shiftright(a + shiftleft(1L, k) - 1, k)", "shiftright(b, k)"
    ends = f"array(named_struct('k', k, 'block', if({low} < {high} and {low} % 2 = 1, {low}, null)), named_struct('k', k, 'block', if({low} < {high} and {high} % 2 = 1, {high} - 1, null)))"
    stretch = F.expr(f"filter(flatten(transform(sequence(0, {levels}), k -> {ends})), s -> s.block is not null)")
    blocks = places.select("depth", F.explode(F.expr(f"transform(sequence(0, {levels}), k -> named_struct('k', k, 'block', shiftright(at, k)))")).alias("s"))
    least = blocks.groupBy("s.k", "s.block").agg(F.min("depth").alias("least"))
    asked = both.filter("a is not null").select("g", F.explode(stretch).alias("s")).select("g", "s.k", "s.block")
    meets = asked.join(least, ["k", "block"]).groupBy("g").agg((F.min("least") - 1).alias("meet"))
    sizes = both.join(meets, "g", "left").groupBy(F.col("i").alias("row")).agg(F.sum(F.col("depth") - F.coalesce("meet", "top")).alias("below"))
    return nodes.withColumnRenamed("node", "row").join(sizes, "row", "left").select("row", (1 + F.coalesce("below", F.lit(0))).cast("long").alias("nonzeros"))


def factor_nonzeros(edges: DataFrame, order: DataFrame) -> DataFrame:
    """One row: the nonzeros of the Cholesky factor (diagonal included) of the symmetrised graph in an order."""
    return factor_rows(edges, order).agg(F.coalesce(F.sum("nonzeros"), F.lit(0)).alias("nonzeros"))
