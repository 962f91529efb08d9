"""Graphs: reachability, compelled edges, token universes, coarsening, floor sweeps, acyclicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwright.storage import Rounds


def reachable(edges: DataFrame, src: str, dst: str, max_rounds: int = 64) -> DataFrame:
    """All (a, b) with a path from a to b, by doubling: each round joins the relation with itself and is written."""
    rounds = Rounds(edges.sparkSession, "reachable")
    known = rounds.settle(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    n = known.count()
    for _ in range(max_rounds):
        onward = known.select(F.col("a").alias("b"), F.col("b").alias("c"))
        known = rounds.settle(known.unionByName(known.join(onward, "b").select("a", F.col("c").alias("b"))).distinct())
        now = known.count()
        if now == n:
            return known
        n = now
    raise RuntimeError("reachability did not settle")


def v_structures(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, c, b), a < b: both lead to c and no edge joins them."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s <> d").distinct()
    left, right = e.select(F.col("s").alias("a"), F.col("d").alias("c")), e.select(F.col("s").alias("b"), F.col("d").alias("c"))
    pairs = left.join(right, "c").filter("a < b")
    joined = e.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct()
    return pairs.join(joined, ["a", "b"], "left_anti").select("a", "c", "b")


def compelled(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 1000) -> DataFrame:
    """(src, dst, compelled) of each edge of an acyclic graph: whether its direction is the same in every graph that implies the same
    independences.

    Edges of unshielded colliders are compelled; the rest is closed under Meek's orientation rules (1995), each a join over the
    edges that are directed (D) and those that are not yet (U): x - y becomes x -> y if (1) some z -> x isn't joined to y, (2) some
    x -> z -> y, (3) two unjoined z, w with x - z -> y and x - w -> y, (4) some x - z -> w -> y with x joined to w and z not joined
    to y. All that a round finds is added at once; rounds are written.
    """
    rounds = Rounds(edges.sparkSession, "compelled")
    e = rounds.settle(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s <> d").distinct())
    joined = e.unionByName(e.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct()
    apart = lambda df, a, b: df.join(joined.select(F.col("s").alias(a), F.col("d").alias(b)), [a, b], "left_anti")
    v = v_structures(e, "s", "d")
    fixed = v.select(F.col("a").alias("s"), F.col("c").alias("d")).unionByName(v.select(F.col("b").alias("s"), F.col("c").alias("d"))).distinct()
    state = Rounds(edges.sparkSession, "compelled")
    now = state.settle(e.join(fixed.withColumn("fixed", F.lit(True)), ["s", "d"], "left").select("s", "d", F.coalesce("fixed", F.lit(False)).alias("fixed")))
    n = -1
    for _ in range(max_rounds):
        count = now.filter("fixed").count()
        if count == n:
            return now.select(F.col("s").alias(src), F.col("d").alias(dst), F.col("fixed").alias("compelled"))
        n = count
        d, open_ = now.filter("fixed").select("s", "d"), now.filter("NOT fixed").select("s", "d")
        u = open_.select(F.col("s").alias("x"), F.col("d").alias("y")).unionByName(open_.select(F.col("d").alias("x"), F.col("s").alias("y")))
        arc = lambda a, b: d.select(F.col("s").alias(a), F.col("d").alias(b))
        line = lambda a, b: u.select(F.col("x").alias(a), F.col("y").alias(b))
        first = apart(u.join(arc("z", "x"), "x").filter("z <> y"), "z", "y")
        second = u.join(arc("x", "z"), "x").join(arc("z", "y"), ["z", "y"])
        spokes = u.join(line("x", "z"), "x").join(arc("z", "y"), ["z", "y"])
        third = apart(spokes.join(spokes.withColumnRenamed("z", "w"), ["x", "y"]).filter("z < w"), "z", "w")
        onward = u.join(line("x", "z"), "x").filter("z <> y").join(arc("z", "w"), "z").join(arc("w", "y"), ["w", "y"])
        fourth = apart(onward.join(joined.select(F.col("s").alias("x"), F.col("d").alias("w")), ["x", "w"], "left_semi"), "z", "y")
        found = first.select("x", "y").unionByName(second.select("x", "y")).unionByName(third.select("x", "y")).unionByName(fourth.select("x", "y")).distinct()
        now = state.settle(now.join(found.select(F.col("x").alias("s"), F.col("y").alias("d"), F.lit(True).alias("new")), ["s", "d"], "left").select("s", "d", (F.col("fixed") | F.coalesce("new", F.lit(False))).alias("fixed")))
    raise RuntimeError("orientation did not settle")


def token_universe(tokens: DataFrame, support: DataFrame) -> DataFrame:
    """Ordered pairs of tokens of supported operation pairs. ``tokens``: token, op; ``support``: op_a, op_b."""
    a, b = (tokens.filter("op is not null").select(F.col("op").alias(f"op_{x}"), F.col("token").alias(f"t_{x}")) for x in "ab")
    one = support.join(a, "op_a").join(b, "op_b").select(F.col("t_a").alias("src"), F.col("t_b").alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def op_of(token: Column) -> Column:
    """The operation of a token 'op:outcome'; state tokens have none."""
    return F.when(~token.startswith("state:"), F.split(token, ":")[0].cast("int"))


def supported(edges: DataFrame, support: DataFrame, a: str, b: str) -> DataFrame:
    """Token edges whose operations can occur together, in either order; state tokens always can, tokens of one operation never."""
    x, y = op_of(F.col(a)), op_of(F.col(b))
    named = edges.withColumns({"__x": F.least(x, y), "__y": F.greatest(x, y), "__state": x.isNull() | y.isNull()})
    pairs = support.select(F.least("op_a", "op_b").alias("__x"), F.greatest("op_a", "op_b").alias("__y")).distinct()
    between = named.filter("NOT __state AND __x <> __y").join(pairs, ["__x", "__y"], "left_semi")
    return between.unionByName(named.filter("__state")).drop("__x", "__y", "__state")


def state_universe(state_tokens: DataFrame, tokens: DataFrame, directed: DataFrame) -> DataFrame:
    """Pairs of a state token and every token of the operations that its variable reaches in the target. ``state_tokens``: token."""
    variable = lambda c: F.split(F.col(c), "=")[0]
    reached = directed.filter(F.col("src").startswith("state:")).select(variable("src").alias("var"), op_of(F.col("dst")).alias("op")).distinct()
    sources = state_tokens.select(F.col("token").alias("src"), variable("token").alias("var"))
    return sources.join(reached, "var").join(tokens.select("op", F.col("token").alias("dst")), "op").select("src", "dst").distinct()


def strongest(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per pair: the greatest strength with what it came through; of equal ones the first in ``order``."""
    best = F.max_by(F.struct("strength", "via"), F.struct(F.col("strength"), -F.col(order)))
    return edges.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.strength", "m.via")


def shared_causes(members: DataFrame) -> DataFrame:
    """(a, b, strength, via): pairs of tokens that one hidden variable moves. ``members``: latent, token, delta (one entry for each value
    of the latent); a pair's strength under a latent is the greatest over its values of the smaller of both deltas, and the strongest
    latent counts."""
    a, b = members.select("latent", F.col("token").alias("a"), F.col("delta").alias("da")), members.select("latent", F.col("token").alias("b"), F.col("delta").alias("db"))
    both = a.join(b, "latent").filter("a < b").withColumn("strength", F.array_max(F.zip_with("da", "db", lambda x, y: F.least(x, y))))
    best = F.max_by("latent", F.struct(F.col("strength"), F.col("latent")))
    return both.groupBy("a", "b").agg(F.max("strength").alias("strength"), best.alias("via")).filter("strength > 0")


def coarsen_bidirected(edges: DataFrame, groups: DataFrame, node: str, group: str) -> DataFrame:
    """Bidirected edges between groups, the smaller group first, with the greatest strength."""
    x, y = (groups.select(F.col(node).alias(k), F.col(group).alias(f"{k}_group")) for k in ("a", "b"))
    out = edges.join(x, "a").join(y, "b").select(F.least("a_group", "b_group").alias("a"), F.greatest("a_group", "b_group").alias("b"), "strength").filter("a <> b")
    return out.groupBy("a", "b").agg(F.max("strength").alias("strength"))


def group_key(level: str, op: Column, service: Column) -> Column:
    """The node that a token's operation becomes: 'op:<id>' or 'svc:<service>'."""
    return F.concat(F.lit("op:"), op.cast("string")) if level == "op" else F.concat(F.lit("svc:"), service.cast("string"))


def topology_prior(calls: DataFrame) -> DataFrame:
    """Call edges turned round: an effect goes from the callee to its caller. ``calls``: caller, callee."""
    return calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")).filter("src <> dst").distinct()


def coarsen(edges: DataFrame, groups: DataFrame, node: str, group: str) -> DataFrame:
    """Edges between groups with the greatest strength; edges inside a group go. ``edges``: src, dst, strength."""
    s, d = (groups.select(F.col(node).alias(x), F.col(group).alias(f"{x}_group")) for x in ("src", "dst"))
    out = edges.join(s, "src").join(d, "dst").filter("src_group <> dst_group")
    return out.groupBy("src_group", "dst_group").agg(F.max("strength").alias("strength"))


def floor_sweep(edges: DataFrame, floors: list[float], src: str, dst: str, strength: str) -> DataFrame:
    """Edges, touched nodes and density at each floor. The floors are few and constant; each edge meets those it reaches."""
    at = edges.withColumn("floor", F.explode(F.filter(F.array(*map(F.lit, floors)), lambda f: F.col(strength) >= f)))
    nodes = at.select("floor", F.explode(F.array(F.col(src), F.col(dst))).alias("n")).groupBy("floor").agg(F.countDistinct("n").alias("nodes"))
    counts = at.groupBy("floor").agg(F.count(F.lit(1)).alias("edges")).join(nodes, "floor")
    return counts.withColumn("density", F.try_divide(F.col("edges").cast("double"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")))


def floor_sensitivity(edges: DataFrame, floors: list[float], src: str, dst: str, strength: str) -> DataFrame:
    """``floor_sweep`` with whether the edges of each floor are free of cycles. Floors are few; each is peeled on its own."""
    spark = edges.sparkSession
    flags = spark.createDataFrame([(float(f), is_acyclic(edges.filter(F.col(strength) >= f), src, dst)) for f in floors], "floor double, acyclic boolean")
    return flags.join(floor_sweep(edges, floors, src, dst, strength), "floor", "left").select("floor", "acyclic", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "nodes")), "density")


def is_acyclic(edges: DataFrame, src: str, dst: str) -> bool:
    """Edges from a node that none leads into, or into one that none leaves, are taken away until no such edge is left; a rest is a
    cycle. Rounds are at most half the longest path, and each is written."""
    rounds = Rounds(edges.sparkSession, "acyclic")
    e = rounds.settle(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    n = e.count()
    while n:
        inner = e.join(e.select(F.col("d").alias("s")).distinct(), "s", "left_semi")
        e = rounds.settle(inner.join(e.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "d"))
        now = e.count()
        if now == n:
            return False
        n = now
    return True


def co_occurring(members: DataFrame, row: str, item: str) -> DataFrame:
    """Unordered pairs of items of one row, distinct over all rows."""
    m = members.select(row, item).distinct()
    a, b = m.select(row, F.col(item).alias("a")), m.select(row, F.col(item).alias("b"))
    return a.join(b, row).filter("a < b").select("a", "b").distinct()


def changed_edges(before: DataFrame, after: DataFrame, keys: list[str], strength: str, floor: float) -> DataFrame:
    """Edges whose strength differs between two regimes, and whether they cross the floor."""
    b, a = before.select(*keys, F.col(strength).alias("before")), after.select(*keys, F.col(strength).alias("after"))
    both = b.join(a, keys, "full_outer").select(*keys, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return both.filter("before <> after").withColumn("flips", (F.col("before") >= floor) != (F.col("after") >= floor))
