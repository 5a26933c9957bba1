"""References between typed nodes: ``nodes(node, type, name, value)``, ``edges(src, dst, role)``.

An edge leads from a node to one of its sources.  Chains are followed by doubling: each round joins what is known of
chains with itself, so a chain of n hops takes log n rounds.  Closures go outwards by frontiers, of which each round
keeps only what was not reached before; neither has a limit of depth, and no path is ever enumerated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import keep

#: Rounds of a closure after which its parts are written as one.
PARTS = 16


def sources(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == F.lit(node)).select("dst", "role")


def fan_out(edges: DataFrame) -> DataFrame:
    """How many nodes use a node."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("sinks"))


def owned(edges: DataFrame) -> DataFrame:
    """Edges whose source is used by nothing else."""
    single = fan_out(edges).where("sinks = 1").select(F.col("node").alias("dst"))
    return edges.join(single, "dst", "left_semi")


def primary_source(edges: DataFrame) -> DataFrame:
    """One hop along references."""
    return edges.where("role = 'ref'").select(F.col("src").alias("node"), F.col("dst").alias("target"))


def dereferenced(edges: DataFrame) -> DataFrame:
    """``node``, ``final``, ``hops``: where each node's chain of references ends; null for a chain that runs in a circle."""
    hop = keep(primary_source(edges).distinct(), "hops")
    start = hop.select("node").distinct()
    inner = hop.select(F.col("node").alias("target")).distinct()
    one = hop.withColumn("hops", F.lit(1).cast("long"))
    # chains that have ended, and chains of 2 ** k hops that go on
    ended, going = keep(one.join(inner, "target", "left_anti").select("node", "target", "hops"), "ended"), keep(one.join(inner, "target", "left_semi").select("node", "target", "hops"), "going")
    longest, reach = start.count(), 1
    while reach <= longest and not going.isEmpty():
        first = going.select("node", F.col("target").alias("at"), F.col("hops").alias("h"))

        def then(rest: DataFrame) -> DataFrame:
            rest = rest.select(F.col("node").alias("at"), "target", "hops")
            return first.join(rest, "at").select("node", "target", (F.col("h") + F.col("hops")).alias("hops")).distinct()

        ended, going = keep(ended.unionByName(then(ended)), "ended"), keep(then(going), "going")
        reach *= 2
    return start.join(ended, "node", "left").select("node", F.col("target").alias("final"), F.col("hops").cast("int").alias("hops"))


def closure(edges: DataFrame, start: DataFrame, up: bool = True) -> DataFrame:
    """``origin``, ``node``, ``depth``: what is reached from ``start(node)``: its users (``up``) or its sources, at their least depth."""
    a, b = ("dst", "src") if up else ("src", "dst")
    link = keep(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "links")
    origin = F.col("node").alias("origin")
    frontier = keep(start.where("node IS NOT NULL").select(origin, "node", F.lit(0).alias("depth")).distinct(), "reached")
    reached, parts = frontier, 1
    while not frontier.isEmpty():
        step = frontier.join(link, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = keep(step.join(reached.select("origin", "node"), ["origin", "node"], "left_anti"), "reached")
        reached, parts = reached.unionByName(frontier), parts + 1
        if parts == PARTS:
            reached, parts = keep(reached, "reached"), 1
    return reached.where("depth > 0")


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """What has to be computed again when ``changed(node)`` change."""
    return closure(edges, changed, True)


def type_closure(types: DataFrame) -> DataFrame:
    """``type``, ``base``: every type with itself and all it derives from; ``types(type, base)``."""
    direct = types.where("base IS NOT NULL").select(F.col("type").alias("src"), F.col("base").alias("dst"))
    start = types.select(F.col("type").alias("node")).distinct()
    up = closure(direct, start, False).select(F.col("origin").alias("type"), F.col("node").alias("base"))
    return up.unionByName(start.select(F.col("node").alias("type"), F.col("node").alias("base")))


def of_type(nodes: DataFrame, types: DataFrame, wanted: str) -> DataFrame:
    """The live nodes of a type or one derived from it."""
    return nodes.join(type_closure(types).where(F.col("base") == wanted).select("type"), "type", "left_semi")


def candidates(nodes: DataFrame, types: DataFrame, wanted: str, initial) -> DataFrame:
    """What a slot may hold: its present value first, then the nodes of its type."""
    rank = F.when(F.col("node") == F.lit(initial), 0).otherwise(1)
    return of_type(nodes, types, wanted).withColumn("rank", rank).orderBy("rank", "node")


def assign(slots: DataFrame, values: DataFrame, types: DataFrame) -> DataFrame:
    """``slots(slot, expected)`` with ``values(slot, node, type)``; an error for a value of another type."""
    ok = type_closure(types).select("type", F.col("base").alias("expected"), F.lit(True).alias("fits"))
    joined = slots.join(values, "slot").join(ok, ["type", "expected"], "left")
    return joined.withColumn("fits", F.when(F.col("fits"), True).otherwise(F.raise_error(F.lit("wrong type")).cast("boolean")))


def evaluated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with the value at the end of its references, its own if it has none."""
    values = nodes.select(F.col("node").alias("final"), F.col("value").alias("far"))
    far = dereferenced(edges).join(values, "final", "left").select("node", "final", "far")
    return nodes.join(far, "node", "left").select("node", F.when(F.col("far").isNotNull() | F.col("final").isNotNull(), F.col("far")).otherwise(F.col("value")).alias("value"))


def find_or_add(tree: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The tree with the rows of ``wanted`` that it lacks."""
    return tree.unionByName(wanted.join(tree, keys, "left_anti"))


def wrapped(objects: DataFrame, kinds: dict[str, str], default: str = "object") -> DataFrame:
    """``objects(kind, ...)`` with the node ``type`` that their kind is wrapped in."""
    got = F.lit(default)
    for kind, to in kinds.items():
        got = F.when(F.col("kind") == kind, to).otherwise(got)
    return objects.withColumn("type", got)


def sorted_set(table: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """The distinct rows with ``low <= key < high`` (either end may be open) in order: head, tail and sub sets."""
    got = table.distinct()
    got = got if low is None else got.where(F.col(key) >= F.lit(low))
    got = got if high is None else got.where(F.col(key) < F.lit(high))
    return got.orderBy(key)


def set_ends(table: DataFrame, keys: list[str], key: str) -> DataFrame:
    """First and last of each set, and how many there are."""
    return table.groupBy(*keys).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count_distinct(key).alias("size"))


def list_edit(items, at, op: str, item=None):
    """A list after ``insert``, ``remove`` or ``set`` at 0-based place ``at``; unchanged where there is no such place."""
    before, after = F.slice(items, 1, at), lambda k: F.slice(items, at + k, F.greatest(F.size(items) - at, F.lit(0)))
    if op == "insert":
        return F.when((at >= 0) & (at <= F.size(items)), F.concat(before, F.array(item), after(1))).otherwise(items)
    inside = (at >= 0) & (at < F.size(items))
    return F.when(inside, F.concat(before, after(2)) if op == "remove" else F.concat(before, F.array(item), after(2))).otherwise(items)
