"""Themes by clustering: an adaptive radius, density clusters, merging under a size cap, a merge tree, and refinement.

Posts are vectors; no label is given.  ``vectors`` has (scope, vec_id, v) with
unit vectors, an id in one scope; ``members`` has (scope, vec_id, cluster), a
cluster named by its smallest vector and noise by -1.  Steps that depend on an
order (merging, the tree) go in rounds: a pair that is the best one left for both
its sides can be decided at once, whatever happens elsewhere, so all such pairs
of a round are decided together and the result is that of one pair at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import Operator, operator, rounded
from narravane.functions.scratch import written
from narravane.operators.components import components
from narravane.operators.vectors import Neighbours

# Neighbours of a core; the radius for small sets and its bounds, for embeddings and for term weights.
KTH, FEW = 3, 4
RADIUS = {True: ("35e-2", "22e-2", "42e-2"), False: ("55e-2", "35e-2", "68e-2")}
# When density clusters give way to k-means; posts and clusters of it.
LEAST_CLUSTERS, MOST_NOISE, KMEANS_POSTS, KMEANS_MOST = 2, 0.55, 25, 6
# Cosine of sure merges and of those of related themes with their least score; posts of a merged theme.
SURE, RELATED, RELATED_SCORE, CAP, CAP_LEAST, CAP_SHARE = 0.93, 0.82, 0.28, 48, 12, 0.32
# Members from which a cluster is refined, first and last; where the merge tree stops; least theme.
REFINE, REFINE_LAST, TREE_STOP, LEAST_THEME = 8, 12, 0.5, 2


def radius(neural: bool = True) -> Operator:
    """The radius of each scope: the 75th percentile of the distances (scope, distance, n) to the third neighbour, within bounds."""
    default, low, high = RADIUS[neural]

    def text(d) -> str:
        middle = "percentile(distance, 75e-2, n)" if d.name == "spark" else "quantile_cont(distance, 75e-2)"
        total = "sum(n)" if d.name == "spark" else "count(*)"
        return f"SELECT scope, CASE WHEN {total} < {FEW} THEN {default} ELSE {rounded(f'least({high}, greatest({low}, {middle}))', 6)} END AS eps FROM distances GROUP BY scope"

    return Operator(text, "distances", doc=radius.__doc__)


def knn(vectors: DataFrame) -> DataFrame:
    """(scope, vec_id, distance): the distance of each vector to its third nearest other one; null in smaller scopes."""
    found = Neighbours(vectors)
    return _each(vectors, found.reps, found.nearest(KTH), "distance")


#: DuckDB text for ``knn``: all pairs of a scope.
KNN_SQL = f"""
WITH p AS (SELECT a.scope, a.vec_id, b.vec_id AS other, floor((1e0 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))) * 1e6 + 5e-1) / 1e6 AS distance FROM vectors a JOIN vectors b ON a.scope = b.scope AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, vec_id ORDER BY distance, other) AS k FROM p)
SELECT v.scope, v.vec_id, r.distance FROM vectors v LEFT JOIN r ON r.scope = v.scope AND r.vec_id = v.vec_id AND r.k = {KTH}"""


#: Equal vectors from which their rows are found without a shuffle; others of a class meet in one place.
COPIES = 1000


def _each(vectors: DataFrame, reps: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``values`` (scope, rep, column) for each vector; copies of one vector stay where they are if there are many."""
    known = reps.select("scope", "rep", "n", "v").join(values.select("scope", "rep", column), ["scope", "rep"]).select("scope", "v", "n", column)
    # at most one class for each thousand vectors
    many = F.broadcast(known.where(F.col("n") >= COPIES).drop("n"))
    rest = vectors.join(many, ["scope", "v"], "left_anti").join(known.where(F.col("n") < COPIES).drop("n"), ["scope", "v"])
    return rest.select("scope", "vec_id", column).unionByName(vectors.join(many, ["scope", "v"]).select("scope", "vec_id", column))


def density_clusters(vectors: DataFrame, neural: bool = True) -> DataFrame:
    """Density clusters with two points to a core, by the adaptive radius of each scope."""
    found = Neighbours(vectors)
    near = found.nearest(KTH)
    eps = written(radius(neural)(near))
    linked = components(found.links(eps).select("a", "b"))
    named = found.reps.join(linked, F.col("rep") == F.col("node"), "left")
    # copies are within any radius of each other
    cluster = F.coalesce("component", F.when(F.col("n") > 1, F.col("rep")), F.lit(-1))
    return _each(vectors, found.reps, named.select("scope", "rep", cluster.alias("cluster")), "cluster")


#: DuckDB text for ``density_clusters`` over ``vectors`` and their ``radii`` (scope, eps): all pairs, and their closure.
DENSITY_SQL = """
WITH RECURSIVE near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.scope = b.scope AND a.vec_id <> b.vec_id JOIN radii r ON r.scope = a.scope
  WHERE floor((1e0 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))) * 1e6 + 5e-1) / 1e6 <= r.eps),
reach(node, other) AS (SELECT a, a FROM near UNION SELECT r.node, n.b FROM reach r JOIN near n ON r.other = n.a),
named AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node)
SELECT v.scope, v.vec_id, coalesce(n.cluster, -1) AS cluster FROM vectors v LEFT JOIN named n ON n.node = v.vec_id"""


def kmeans_clusters(vectors: DataFrame) -> DataFrame:
    """Clusters of k-means, one for each 25 posts but two to six; what density clusters fall back to."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    k = 1 if n < 3 else min(KMEANS_MOST, max(2, n // KMEANS_POSTS))
    rows = written(vectors.select("scope", "vec_id", array_to_vector("v").alias("features")))
    if k == 1:
        return rows.select("scope", "vec_id", F.lit(0).alias("k")).transform(_named)
    return KMeans(k=k, seed=42, featuresCol="features", predictionCol="k").fit(rows).transform(rows).transform(_named)


def _named(rows: DataFrame) -> DataFrame:
    names = rows.groupBy("scope", "k").agg(F.min("vec_id").alias("cluster"))
    return rows.join(names, ["scope", "k"]).select("scope", "vec_id", "cluster")


def first_clusters(vectors: DataFrame, neural: bool = True) -> tuple[DataFrame, str]:
    """Clusters of one scope and the method that gave them: density, or k-means if that finds one cluster or mostly noise."""
    n = vectors.count()
    if n < 3:
        return vectors.select("scope", "vec_id", F.lit(0)).toDF("scope", "vec_id", "k").transform(_named), "single"
    found = written(density_clusters(vectors, neural))
    clusters, noise = found.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))), F.count_if(F.col("cluster") < 0)).first()
    if clusters < LEAST_CLUSTERS or noise / n > MOST_NOISE:
        return kmeans_clusters(vectors), "kmeans"
    return found, "density"


def centroids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, size, v): the unit centroid of each cluster but noise."""
    flat = members.where("cluster >= 0").join(vectors.select("vec_id", "v"), "vec_id").select("cluster", F.posexplode("v").alias("i", "x"))
    means = flat.groupBy("cluster", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("size"))
    whole = means.groupBy("cluster").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return whole.select("cluster", "size", F.expr("transform(v, x -> IF(norm > 1e-9, x.m / norm, x.m))").alias("v"))


def size_cap(posts: int) -> int:
    """Posts that a merged theme may have."""
    return CAP if posts <= 0 else min(CAP, max(CAP_LEAST, int(posts * CAP_SHARE)))


def merge_pairs(centres: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(l, r, cosine), l < r: pairs of clusters that may merge: very near ones, and near ones of ``related`` themes (a, b, related, score)."""
    found = Neighbours(centres.select(F.lit(0).alias("scope"), F.col("cluster").alias("vec_id"), "v"), alike=False)
    limit = centres.sparkSession.createDataFrame([(0, round(1 - (SURE if related is None else RELATED), 6))], "scope int, eps double")
    pairs = found.within(limit).select(F.col("a").alias("l"), F.col("b").alias("r"), F.expr("round(1 - distance, 6)").alias("cosine"))
    if related is None:
        return pairs
    why = related.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "related", "score")
    return pairs.join(why, ["l", "r"], "left").where((F.col("cosine") >= SURE) | (F.col("related") & (F.col("score") >= RELATED_SCORE))).select("l", "r", "cosine")


def greedy_merges(pairs: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """(cluster, into): clusters after merging pair by pair, best cosine first, none beyond ``cap`` posts.

    ``pairs`` has (l, r, cosine), ``sizes`` (cluster, size).  A pair joins the groups that its clusters are in by then.
    Equal cosines go by (l, r).  A pair is decided in the first round in which it is the best one left for both groups:
    all pairs that could have changed either of them are decided by then.
    """
    groups = written(sizes.select("cluster", "size", F.col("cluster").alias("into")))
    order = F.struct((-F.col("cosine")).alias("far"), "l", "r")
    left = written(pairs.select(order.alias("order"), F.col("l").alias("x"), F.col("r").alias("y")))
    while not left.isEmpty():
        first = left.select("order", F.explode(F.array("x", "y")).alias("group")).groupBy("group").agg(F.min("order").alias("first"))
        of = lambda z: first.select(F.col("group").alias(z), F.col("first").alias("first_" + z))  # noqa: B023, E731
        sure = left.join(of("x"), "x").join(of("y"), "y").where("order = first_x AND order = first_y").select("order", "x", "y")
        posts = groups.groupBy("into").agg(F.sum("size").alias("posts"))
        size = lambda z: posts.select(F.col("into").alias(z), F.col("posts").alias("posts_" + z))  # noqa: B023, E731
        decided = written(sure.join(size("x"), "x").join(size("y"), "y").withColumn("merges", F.col("posts_x") + F.col("posts_y") <= cap))
        moved = decided.where("merges").select(F.col("y").alias("old"), F.col("x").alias("new"))
        moves = lambda c: moved.select(F.col("old").alias(c), F.col("new").alias("new_" + c))  # noqa: B023, E731
        groups = written(groups.join(moves("into"), "into", "left").select("cluster", "size", F.coalesce("new_into", "into").alias("into")))
        rest = left.join(decided.select("order"), "order", "left_anti").join(moves("x"), "x", "left").join(moves("y"), "y", "left")
        left = written(rest.select("order", F.coalesce("new_x", "x").alias("x"), F.coalesce("new_y", "y").alias("y")).where("x <> y"))
    least = groups.groupBy("into").agg(F.min("cluster").alias("least"))
    return groups.join(least, "into").select("cluster", F.col("least").alias("into"))


#: DuckDB text for ``greedy_merges`` over ``pairs``, ``sizes`` and ``cap`` (cap): one pair after the other.
GREEDY_SQL = """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, l, r) AS k FROM pairs),
s(k, cluster, size, grp) AS (
  SELECT CAST(0 AS BIGINT), cluster, size, cluster FROM sizes
  UNION ALL
  SELECT q.k + 1, q.cluster, q.size, CASE WHEN q.grp = q.gr AND q.gl <> q.gr AND q.nl + q.nr <= (SELECT cap FROM cap) THEN q.gl ELSE q.grp END
  FROM (SELECT w.*, sum(CASE WHEN grp = gl THEN size ELSE 0 END) OVER () AS nl, sum(CASE WHEN grp = gr THEN size ELSE 0 END) OVER () AS nr
        FROM (SELECT s.*, max(CASE WHEN s.cluster = o.l THEN s.grp END) OVER () AS gl, max(CASE WHEN s.cluster = o.r THEN s.grp END) OVER () AS gr FROM s JOIN o ON o.k = s.k + 1) w) q)
SELECT cluster, min(cluster) OVER (PARTITION BY grp) AS "into" FROM s WHERE k = (SELECT count(*) FROM o)"""


def merge_similar(vectors: DataFrame, members: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """``members`` after merging clusters with near centroids, up to a cap by the number of posts."""
    centres = written(centroids(vectors, members))
    into = greedy_merges(merge_pairs(centres, related), centres.select("cluster", "size"), size_cap(members.count()))
    return _moved(members, into)


def _moved(members: DataFrame, into: DataFrame) -> DataFrame:
    """Members of clusters that go ``into`` others, named by their smallest vector again."""
    moved = members.join(into.withColumnRenamed("into", "to"), "cluster", "left").select("scope", "vec_id", F.coalesce("to", "cluster").alias("k"))
    names = moved.where("k >= 0").groupBy("k").agg(F.min("vec_id").alias("cluster"))
    return moved.join(names, "k", "left").select("scope", "vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def inner_vectors(vectors: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """The vectors of clusters with ``least`` members or more, each cluster a scope."""
    large = members.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("cluster")
    return members.join(large, "cluster").join(vectors.select("vec_id", "v"), "vec_id").select(F.col("cluster").alias("scope"), "vec_id", "v")


@operator("members", "inner_clusters")
def split_clusters(d):
    """Members after large clusters are replaced by their inner clusters (scope, vec_id, cluster), if there are two of them.

    The first inner cluster keeps the name, and what is noise inside stays with it.
    """
    return f"""
    WITH c AS (SELECT scope, count(DISTINCT cluster) AS k, min(cluster) AS first FROM inner_clusters WHERE cluster >= 0 GROUP BY scope),
    m AS (SELECT m.scope, m.vec_id, CASE WHEN c.k >= 2 AND i.cluster >= 0 AND i.cluster <> c.first THEN i.cluster ELSE m.cluster END AS cluster, coalesce(c.k >= 2 AND i.cluster >= 0 AND i.cluster <> c.first, false) AS own
          FROM members m LEFT JOIN inner_clusters i ON i.vec_id = m.vec_id LEFT JOIN c ON c.scope = m.cluster),
    n AS (SELECT cluster AS k, own AS o, min(vec_id) AS least FROM m WHERE cluster >= 0 GROUP BY cluster, own)
    SELECT m.scope, m.vec_id, coalesce(n.least, -1) AS cluster FROM m LEFT JOIN n ON n.k = m.cluster AND n.o = m.own"""


def refined(vectors: DataFrame, members: DataFrame, least: int, neural: bool = True) -> DataFrame:
    """Members after large clusters were clustered again, each by a radius of its own."""
    inner = inner_vectors(vectors, members, least)
    return split_clusters(members, written(density_clusters(inner, neural)))


def must_linked(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members after all posts of a must-link group (group_id, post_id) went to the cluster most of them are in, ties to the smaller one.

    A group of noise alone, of two posts or more, becomes a cluster.
    """
    held = members.join(groups.select("group_id", F.col("post_id").alias("vec_id")).distinct(), "vec_id")
    several = held.groupBy("group_id").agg(F.count(F.lit(1)).alias("posts"), F.min("vec_id").alias("least")).where("posts > 1")
    votes = held.where("cluster >= 0").groupBy("group_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster")).alias("best"))
    target = several.join(best, "group_id", "left").select("group_id", F.coalesce("best.cluster", "least").alias("to"))
    moved = held.join(target, "group_id").groupBy("vec_id").agg(F.min("to").alias("to"))
    out = members.join(moved, "vec_id", "left").select("scope", "vec_id", F.coalesce("to", "cluster").alias("cluster"))
    return _moved(out, out.select("cluster", F.col("cluster").alias("into")).limit(0))


#: Rank of merged nodes, behind all clusters.
_LATE = 1 << 62


def merge_tree(centres: DataFrame) -> DataFrame:
    """(node, lft, rgt, similarity, size, step): how clusters merge, the nearest pair first, down to a cosine of 0.5.

    ``centres`` has (cluster, size, v), each with a name from 0 on.  A merge is the node -1 - step, with the unit sum of
    both centroids as its own.  Pairs without a positive cosine can't matter: a node is no nearer to a third one than
    its parts are, if neither of them is on that one's side.  In a round, pairs that are the best one for both sides are
    merged together, best first, until some merge has made a node that is nearer to another one than the next pair is.
    """
    spark = centres.sparkSession
    nodes = written(centres.selectExpr("CAST(cluster AS LONG) AS node", "CAST(cluster AS LONG) AS rnk", "size", "v"))
    found = Neighbours(nodes.select(F.lit(0).alias("scope"), F.col("node").alias("vec_id"), "v"), alike=False)
    near = found.within(spark.createDataFrame([(0, 1.0)], "scope int, eps double"))
    pairs = written(_ranked_pairs(near.select(F.col("a").alias("x"), F.col("b").alias("y"), F.expr("round(1 - distance, 6)").alias("s")), nodes))
    out, step = None, 0
    while True:
        first = pairs.select("order", F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.min("order").alias("first"))
        of = lambda z: first.select(F.col("node").alias(z), F.col("first").alias("first_" + z))  # noqa: B023, E731
        mutual = pairs.join(of("x"), "x").join(of("y"), "y").where("order = first_x AND order = first_y").where(F.col("s") >= TREE_STOP).select("order", "s", "x", "y")
        mutual = written(_with_vectors(mutual, nodes))
        if mutual.isEmpty():
            break
        owner = written(mutual.select("order", F.explode(F.array("x", "y")).alias("node")))
        # the best pair whose sides no mutual pair takes
        free = pairs.join(owner.select(F.col("node").alias("x")), "x", "left_anti").join(owner.select(F.col("node").alias("y")), "y", "left_anti").agg(F.min("order").alias("free"))
        risk = _nearest_to_new(pairs, nodes, mutual, owner)
        # a row for each merge of the round
        seen = mutual.join(risk, "order", "left").crossJoin(F.broadcast(free))
        seen = seen.selectExpr("*", "row_number() OVER (ORDER BY order) - 1 AS k", "max(risk) OVER (ORDER BY order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
        seen = seen.withColumn("stops", (F.col("k") > 0) & (~(F.col("s") >= F.coalesce("before", F.lit(-2.0))) | F.coalesce(F.col("order") > F.col("free"), F.lit(False))))
        done = written(seen.selectExpr("*", "count_if(stops) OVER (ORDER BY order) AS stopped").where("stopped = 0").select("k", "s", "x", "y", "v", "size"))
        merges = done.selectExpr(f"-1L - {step} - k AS node", "x AS lft", "y AS rgt", "s AS similarity", "size", f"CAST({step} + k AS LONG) AS step", "v")
        merges = written(merges)
        out = merges.drop("v") if out is None else out.unionByName(merges.drop("v"))
        step += merges.count()
        moved = merges.select(F.explode(F.array("lft", "rgt")).alias("old"), F.col("node").alias("new"))
        gone = moved.select(F.col("old").alias("node"))
        nodes = written(nodes.join(gone, "node", "left_anti").unionByName(merges.selectExpr("node", f"{_LATE}L + step AS rnk", "size", "v")))
        side = lambda c: moved.select(F.col("old").alias(c), F.col("new").alias("new_" + c))  # noqa: B023, E731
        mapped = pairs.join(side("x"), "x", "left").join(side("y"), "y", "left")
        kept = mapped.where("new_x IS NULL AND new_y IS NULL").select("x", "y", "s")
        fresh = mapped.where("new_x IS NOT NULL OR new_y IS NOT NULL").select(F.coalesce("new_x", "x").alias("x"), F.coalesce("new_y", "y").alias("y")).where("x <> y")
        fresh = fresh.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        at = lambda c: nodes.select(F.col("node").alias(c), F.col("v").alias("v" + c))  # noqa: B023, E731
        fresh = fresh.join(at("x"), "x").join(at("y"), "y").select("x", "y", _cosine("vx", "vy").alias("s")).where("s > 0")
        pairs = written(_ranked_pairs(kept.unionByName(fresh), nodes))
    if out is None:
        return spark.createDataFrame([], "node long, lft long, rgt long, similarity double, size long, step long")
    return out.select("node", "lft", "rgt", F.expr(rounded("similarity")).alias("similarity"), "size", "step")


def _cosine(a: str, b: str):
    return F.expr(f"round(aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (s, v) -> s + v), 6)")


def _ranked_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, y, s, order) with the side of the smaller rank first; by ``order`` the nearest pair comes first."""
    rank = lambda c: nodes.select(F.col("node").alias(c), F.col("rnk").alias("r" + c))
    both = pairs.join(rank("x"), "x").join(rank("y"), "y")
    turned = F.col("rx") > F.col("ry")
    x, y = F.when(turned, F.col("y")).otherwise(F.col("x")), F.when(turned, F.col("x")).otherwise(F.col("y"))
    return both.select(x.alias("x"), y.alias("y"), "s", F.struct((-F.col("s")).alias("far"), F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).alias("order"))


def _with_vectors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with the unit sum ``v`` of both vectors, and ``size``, the posts of both."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("v").alias("v" + c), F.col("size").alias("n" + c))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("sum", F.expr("zip_with(vx, vy, (p, q) -> p + q)"))
    both = both.withColumn("norm", F.expr("sqrt(aggregate(sum, 0D, (s, v) -> s + v * v))"))
    return both.select(*pairs.columns, F.expr("IF(norm > 1e-9, transform(sum, q -> q / norm), sum)").alias("v"), (F.col("nx") + F.col("ny")).alias("size"))


def _nearest_to_new(pairs: DataFrame, nodes: DataFrame, mutual: DataFrame, owner: DataFrame) -> DataFrame:
    """(order, risk): how near the node of each mutual pair would be to any other node, old or new."""
    both = pairs.select("x", "y").unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    mine = both.join(owner.select(F.col("node").alias("x"), F.col("order").alias("mine")), "x")
    near = mine.join(owner.select(F.col("node").alias("y"), F.col("order").alias("other")), "y", "left").where("other IS NULL OR other <> mine")
    new = lambda z: mutual.select(F.col("order").alias(z), F.col("v").alias("v_" + z))
    old = near.select("mine", F.col("y").alias("node")).distinct().join(nodes.select("node", "v"), "node").join(new("mine"), "mine").select("mine", _cosine("v_mine", "v").alias("s"))
    news = near.where("other IS NOT NULL").select("mine", "other").distinct().join(new("mine"), "mine").join(new("other"), "other").select("mine", _cosine("v_mine", "v_other").alias("s"))
    return old.unionByName(news).groupBy(F.col("mine").alias("order")).agg(F.max("s").alias("risk"))


#: DuckDB text for ``merge_tree`` over ``centres``: one pair after the other; the unit sum's cosines follow from those of its parts.
TREE_SQL = f"""
WITH RECURSIVE base AS (SELECT a.cluster AS x, b.cluster AS y, CAST(a.cluster AS HUGEINT) AS rx, CAST(b.cluster AS HUGEINT) AS ry, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS s FROM centres a JOIN centres b ON a.cluster < b.cluster),
r(step, x, y, rx, ry, s) AS (
  SELECT CAST(0 AS BIGINT), CAST(x AS BIGINT), CAST(y AS BIGINT), rx, ry, s FROM base
  UNION ALL
  SELECT step + 1, nx, ny, nrx, nry, CASE WHEN fresh THEN sum(s) / sqrt(2 + 2 * max(bs)) ELSE max(s) END
  FROM (SELECT *, CASE WHEN fresh THEN CASE WHEN x IN (bx, by_) THEN y ELSE x END ELSE x END AS nx, CASE WHEN fresh THEN -1 - step ELSE y END AS ny,
               CASE WHEN fresh THEN CASE WHEN x IN (bx, by_) THEN ry ELSE rx END ELSE rx END AS nrx, CASE WHEN fresh THEN CAST({_LATE} AS HUGEINT) + step ELSE ry END AS nry
        FROM (SELECT *, x IN (bx, by_) OR y IN (bx, by_) AS fresh
              FROM (SELECT *, first_value(x) OVER w AS bx, first_value(y) OVER w AS by_, first_value(s) OVER w AS bs FROM r WINDOW w AS (ORDER BY floor(s * 1e6 + 5e-1) DESC, rx, ry ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) b) c
        WHERE floor(bs * 1e6 + 5e-1) >= {int(TREE_STOP * 1e6)} AND NOT (x = bx AND y = by_)) d
  GROUP BY step, nx, ny, nrx, nry, fresh),
best AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY floor(s * 1e6 + 5e-1) DESC, rx, ry) AS k FROM r),
tree AS (SELECT -1 - step AS node, x AS lft, y AS rgt, s, step FROM best WHERE k = 1 AND floor(s * 1e6 + 5e-1) >= {int(TREE_STOP * 1e6)}),
down AS (SELECT node, lft AS part FROM tree UNION ALL SELECT node, rgt FROM tree UNION ALL SELECT d.node, unnest([t.lft, t.rgt]) FROM down d JOIN tree t ON t.node = d.part)
SELECT t.node, t.lft, t.rgt, {rounded("floor(t.s * 1e6 + 5e-1) / 1e6")} AS similarity, CAST((SELECT sum(c.size) FROM down d JOIN centres c ON c.cluster = d.part WHERE d.node = t.node) AS BIGINT) AS size, t.step FROM tree t"""


def themes(vectors: DataFrame, groups: DataFrame | None = None, related=None, neural: bool = True) -> tuple[DataFrame, str]:
    """(vec_id, theme) of posts that are in a theme of two posts or more, and how it was found.

    ``vectors`` has one scope.  ``groups`` (group_id, post_id) must stay together; ``related`` gives, for members, the
    pairs of themes whose texts are related: (a, b, related, score).
    """
    found, method = first_clusters(vectors, neural)
    state = written(found)
    if vectors.count() >= 3:
        state = written(merge_similar(vectors, state))
        state = written(refined(vectors, state, REFINE, neural))
        if groups is not None:
            state = written(merge_similar(vectors, written(must_linked(state, groups))))
            method += "+must_link"
        before = _clusters(state)
        state = written(merge_similar(vectors, state, related(state) if related else None))
        merged = _clusters(state)
        state = written(refined(vectors, state, REFINE_LAST, neural))
        method += "+related_merge" * (merged < before) + "+split" * (_clusters(state) > merged)
    large = state.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= LEAST_THEME).select("cluster")
    return state.join(large, "cluster").select("vec_id", F.col("cluster").alias("theme")), method


def _clusters(members: DataFrame) -> int:
    return members.where("cluster >= 0").select("cluster").distinct().count()
