"""Themes in embedding space: neighbours, density clusters, cohesion, purity, and Spark ML models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravane.functions.dialect import operator, rounded
from narravane.operators.components import components
from narravane.operators.vectors import Neighbours

#: Cosine distance up to which two vectors are neighbours.
EPS = "7e-1"


def _divided(array: str, by: str) -> str:
    """Spark text for an array divided by a number of its row; inside a lambda the number would be worked out for each element."""
    return f"zip_with({array}, array_repeat({by}, size({array})), (x, y) -> CAST(x AS DOUBLE) / y)"


@operator("embeddings")
def unit_vectors(d):
    """Vectors scaled to unit length."""
    scaled = _divided("embedding", "sqrt(s)") if d.name == "spark" else "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(s))"
    return f"WITH n AS (SELECT vec_id, label, embedding, {d.dot('embedding', 'embedding')} AS s FROM embeddings) SELECT vec_id, label, {scaled} AS v FROM n WHERE s > 0"


@operator("units")
def lifted_vectors(d):
    """Unit vectors with themes in them: each is moved towards an axis of its label, of a pair of labels, and of a part of it.

    The given embeddings are noise around the origin; so there is something to find, from the same rows.
    """
    i = "i" if d.name == "spark" else "i - 1"
    moved = f"x + CASE WHEN {i} = label THEN 1e0 WHEN {i} = 10 + {d.div('label', '2')} THEN 6e-1 WHEN {i} = 20 + vec_id % 3 + 3 * (label % 2) THEN 6e-1 ELSE 0e0 END"
    each = (lambda body, array: f"transform({array}, (x, i) -> {body})") if d.name == "spark" else (lambda body, array: f"list_transform({array}, lambda x, i: {body})")
    scaled = _divided("w", "size") if d.name == "spark" else each("x / size", "w")
    return f"WITH m AS (SELECT vec_id, label, {each(moved, 'v')} AS w FROM units), n AS (SELECT vec_id, label, w, sqrt({d.dot('w', 'w')}) AS size FROM m) SELECT CAST(0 AS BIGINT) AS scope, vec_id, label, {scaled} AS v FROM n"


@operator("units")
def neighbours(d):
    """Ordered pairs of the same label whose cosine distance is at most the radius."""
    return f"WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, {d.dot('a.v', 'b.v')} AS cosine FROM units a JOIN units b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT a, b, {rounded('cosine', 6)} AS cosine FROM p WHERE 1e0 - cosine <= {EPS}"


def _by_label(units: DataFrame) -> tuple[Neighbours, DataFrame]:
    """The vectors of each label by blocks, and the radius of each label."""
    found = Neighbours(units.selectExpr("label AS scope", "vec_id", "v"), alike=False)
    return found, found.reps.select("scope").distinct().withColumn("eps", F.lit(float(EPS)))


def near_vectors(units: DataFrame) -> DataFrame:
    """What ``neighbours`` gives; the vectors of a label are compared as matrices, block by block."""
    found, limit = _by_label(units)
    return found.cosines(limit).select("a", "b", "cosine")


def density_clusters(units: DataFrame) -> DataFrame:
    """(vec_id, cluster): with two points to a core, density clusters are the components of the neighbour graph; links that span it are enough."""
    found, limit = _by_label(units)
    return components(found.links(limit, lambda dots, eps: 1.0 - dots <= eps).select("a", "b")).toDF("vec_id", "cluster")


#: DuckDB text for ``density_clusters`` over ``pairs``, those of ``neighbours``.
CLUSTERS_SQL = """
WITH RECURSIVE l AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(node, other) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a)
SELECT node AS vec_id, min(other) AS cluster FROM r GROUP BY node"""


@operator("units")
def cohesion(d):
    """Mean cosine of a label's vectors to its unit centroid."""
    explode = "posexplode(v) AS (i, x)" if d.name == "spark" else None
    flat = f"SELECT vec_id, label, {explode} FROM units" if explode else "SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM units"
    return f"""
    WITH f AS ({flat}), c AS (SELECT label, i, avg(x) AS m FROM f GROUP BY label, i), l AS (SELECT label, sqrt(sum(m * m)) AS size FROM c GROUP BY label),
    k AS (SELECT f.vec_id, f.label, sum(f.x * c.m) / max(l.size) AS cosine FROM f JOIN c ON f.label = c.label AND f.i = c.i JOIN l ON f.label = l.label GROUP BY f.vec_id, f.label)
    SELECT label, count(*) AS n, {rounded("avg(cosine)", 5)} AS cohesion FROM k GROUP BY label"""


@operator("units")
def davies_bouldin(d):
    """Davies-Bouldin index of the labels, by Euclidean distance."""
    flat = "SELECT vec_id, label, posexplode(v) AS (i, x) FROM units" if d.name == "spark" else "SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM units"
    return f"""
    WITH f AS ({flat}), c AS (SELECT label, i, avg(x) AS m FROM f GROUP BY label, i),
    e AS (SELECT f.vec_id, f.label, sqrt(sum((f.x - c.m) * (f.x - c.m))) AS dist FROM f JOIN c ON f.label = c.label AND f.i = c.i GROUP BY f.vec_id, f.label),
    s AS (SELECT label, avg(dist) AS spread FROM e GROUP BY label),
    g AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS apart FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
    r AS (SELECT g.la, max((x.spread + y.spread) / g.apart) AS worst FROM g JOIN s x ON g.la = x.label JOIN s y ON g.lb = y.label GROUP BY g.la)
    SELECT {rounded("avg(worst)", 5)} AS davies_bouldin, count(*) AS labels FROM r"""


@operator("clusters", "units")
def purity(d):
    """Share of the dominant label in each cluster; pure from 0.67."""
    return f"""
    WITH k AS (SELECT c.cluster, u.label, count(*) AS n FROM clusters c JOIN units u ON c.vec_id = u.vec_id GROUP BY c.cluster, u.label)
    SELECT cluster, CAST(sum(n) AS BIGINT) AS size, {rounded("CAST(max(n) AS DOUBLE) / sum(n)")} AS purity, CAST(max(n) AS DOUBLE) / sum(n) >= 67e-2 AS pure FROM k GROUP BY cluster"""


@operator("posts")
def author_entropy(d):
    """Entropy of the authors of a narrative, scaled by the log of their number."""
    return f"""
    WITH a AS (SELECT narrative, author_id, count(*) AS n FROM posts GROUP BY narrative, author_id), t AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY narrative) AS p FROM a)
    SELECT narrative, count(*) AS authors, {rounded("CASE WHEN count(*) < 2 THEN 0e0 ELSE -sum(p * log2(p)) / log2(count(*)) END")} AS entropy FROM t GROUP BY narrative"""


def kmeans(embeddings: DataFrame, k: int = 6, seed: int = 1) -> DataFrame:
    """(vec_id, label, cluster) by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = embeddings.select("vec_id", "label", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select("vec_id", "label", "cluster")


def silhouette(embeddings: DataFrame, k: int = 6, seed: int = 1) -> DataFrame:
    """(silhouette) of the k-means clusters, by cosine."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    clusters = kmeans(embeddings, k, seed).join(embeddings.select("vec_id", array_to_vector("embedding").alias("features")), "vec_id")
    value = ClusteringEvaluator(predictionCol="cluster", distanceMeasure="cosine").evaluate(clusters)
    return embeddings.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def centroid_map(embeddings: DataFrame) -> DataFrame:
    """(label, x, y): the centroids of the labels on two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    flat = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))  # one value a dimension
    vectors = centroids.select("label", array_to_vector("v").alias("features"))
    xy = PCA(k=2, inputCol="features", outputCol="xy").fit(vectors).transform(vectors)
    return xy.select("label", vector_to_array("xy").alias("xy")).select("label", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
