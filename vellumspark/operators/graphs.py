"""Walks over small graphs: containment, support files and reviewed redirects.

Each step is one join of the frontier with the edges; the frontier is written to the cluster's
checkpoint folder between steps, so plans do not grow with depth.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.sources.shared import written

MAX_HOPS, MAX_VISITED = 8, 1000
#: Frontiers that are merged into one table of what is seen.
MERGED = 16


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node and depth (of the shortest way) of all that ``roots`` (node) reach over (src, dst). Each
    step writes its frontier only; what is seen is the union of the frontiers."""
    e = written(edges.select("src", "dst").where("dst is not null").distinct())
    front = written(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = front, 0
    while not front.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
        if depth % MERGED == 0:  # plans stay short on long ways
            seen = written(seen)
    return seen


def missing_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to nodes that are not there."""
    return edges.select(F.col("dst").alias("node")).where("node is not null").distinct().join(nodes.select("node"), "node", "left_anti")


def on_cycles(containers: DataFrame) -> DataFrame:
    """Members of container cycles in (id, container_id), by pointer doubling: after as many
    doublings as the table's size has bits, whoever still has an ancestor leads into a cycle, and
    is on it if it is its own ancestor."""
    up = written(containers.where("container_id is not null").select(F.col("id").alias("a"), F.col("container_id").alias("b")))
    n, span = up.count(), 1
    hop = up
    while span <= n and not hop.isEmpty():
        hop = written(hop.alias("x").join(hop.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")))
        span *= 2
    return hop.select(F.col("b").alias("id")).distinct()


def redirect_walk(starts: DataFrame, observed: DataFrame, reviewed: DataFrame, max_hops: int = MAX_HOPS, max_visited: int = MAX_VISITED) -> DataFrame:
    """url and depth of what is requested: an observed edge (src, dst) is followed only if it is
    reviewed with exactly these ends, at most ``max_hops`` deep, and the first ``max_visited`` by
    depth and url."""
    allowed = observed.select("src", "dst").join(reviewed.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    out = reach(allowed, starts.select(F.col("url").alias("node")), max_hops)
    return out.select(F.col("node").alias("url"), "depth").orderBy("depth", "url").limit(max_visited)


def edge_flags(observed: DataFrame, reviewed: DataFrame, requested: DataFrame) -> DataFrame:
    """Observed edges with whether they are reviewed, and whether their target was requested."""
    r = reviewed.select("src", "dst").distinct().withColumn("reviewed", F.lit(True))
    q = requested.select(F.col("url").alias("dst")).distinct().withColumn("requested", F.lit(True))
    return observed.join(r, ["src", "dst"], "left").join(q, "dst", "left").select("src", "dst", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("requested", F.lit(False)).alias("requested"))


def completed_by_redirects(requests: DataFrame, flags: DataFrame) -> DataFrame:
    """For each invocation, whether every URL it asked for has an edge that is reviewed and requested."""
    done = flags.where("reviewed and requested").select(F.col("src").alias("url")).distinct().withColumn("_done", F.lit(True))
    return requests.join(done, "url", "left").groupBy("invocation").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("completed"))


def rule_problems(rules: DataFrame, hosts: list[str]) -> DataFrame:
    """Redirect rules (src, dst) that are unusable: equal ends, foreign hosts, several targets or repeats."""
    from vellumspark.functions.urls import host

    n = rules.groupBy("src").agg(F.count_distinct("dst").alias("targets"), F.count("*").alias("rows"))
    j = rules.distinct().join(n, "src")
    problem = F.when(F.col("src") == F.col("dst"), "equal ends").when(~host(F.col("src")).isin(hosts) | ~host(F.col("dst")).isin(hosts), "foreign host").when(F.col("targets") > 1, "several targets").when(F.col("rows") > 1, "repeated")
    return j.select("src", "dst", problem.alias("problem")).where("problem is not null")
