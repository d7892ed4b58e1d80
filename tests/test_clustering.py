"""Found themes against sequential twins over all pairs, on data in which each case occurs."""

import numpy as np
import pytest
from narravane.operators import clustering, themes, vectors
from narravane.operators.components import components
from narravane.operators.vectors import Neighbours
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "PER_CENTRE", 24)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(rng, groups=6, each=25, noise=20, spread=0.35, dim=12):
    """Groups around axes, in two near halves each, some equal vectors, and noise."""
    rows = []
    for g in range(groups):
        for i in range(each):
            rows.append(np.eye(dim)[g] + 0.5 * np.eye(dim)[g + 6 if i % 2 else g] + rng.normal(size=dim) * spread * (0.25 if g % 2 else 0.6))
    rows += list(rng.normal(size=(noise, dim)))
    x = unit(np.array(rows))
    x[3:6] = x[3]
    x[-1] = x[-2]
    return x[rng.permutation(len(x))]


def frame(spark, x, scope=None):
    rows = [(int(scope[i]) if scope is not None else 0, i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "scope long, vec_id long, v array<double>").repartition(3)


def dist(x, y):
    return np.floor((1 - x @ y.T) * 1e6 + 0.5) / 1e6


def far(x, scope):
    d = dist(x, x)
    d[scope[:, None] != scope] = np.inf
    np.fill_diagonal(d, np.inf)
    return d


def closure(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def twin_radius(d):
    if len(d) < 4:
        return 0.35
    return float(np.floor(np.clip(np.percentile(np.sort(d, axis=1)[:, 2], 75), 0.22, 0.42) * 1e6 + 0.5) / 1e6)


def twin_density(x):
    """Cluster of each row, -1 for noise."""
    d = far(x, np.zeros(len(x)))
    near = d <= twin_radius(d)
    names = closure(len(x), list(zip(*np.nonzero(near), strict=True)))
    return np.array([c if near[i].any() else -1 for i, c in enumerate(names)])


def twin_centroids(x, labels):
    out = {}
    for c in sorted(set(labels.tolist()) - {-1}):
        m = x[labels == c].mean(axis=0)
        out[c] = m / np.linalg.norm(m)
    return out


def twin_greedy(pairs, sizes, cap):
    group, size = {c: c for c in sizes}, dict(sizes)
    for _, left, right in sorted((-s, a, b) for a, b, s in pairs):
        a, b = group[left], group[right]
        if a != b and size[a] + size[b] <= cap:
            size[a] += size[b]
            group = {c: a if g == b else g for c, g in group.items()}
    return {c: min(k for k in group if group[k] == g) for c, g in group.items()}


def twin_merge(x, labels, sure=0.93):
    centres = twin_centroids(x, labels)
    names = list(centres)
    pairs = [(a, b, round(float(centres[a] @ centres[b]), 6)) for i, a in enumerate(names) for b in names[i + 1 :] if centres[a] @ centres[b] >= sure]
    into = twin_greedy(pairs, {c: int((labels == c).sum()) for c in names}, clustering.size_cap(len(labels)))
    return renamed(np.array([into.get(c, -1) for c in labels.tolist()]))


def renamed(labels):
    return np.array([-1 if c < 0 else int(np.flatnonzero(labels == c)[0]) for c in labels.tolist()])


def twin_refine(x, labels, least):
    out, fresh = labels.copy(), 10_000
    for c in sorted(set(labels.tolist()) - {-1}):
        mine = np.flatnonzero(labels == c)
        if len(mine) < least:
            continue
        inner = twin_density(x[mine])
        kinds = sorted(set(inner.tolist()) - {-1})
        for kind in kinds[1:]:
            out[mine[inner == kind]] = fresh
            fresh += 1
    return renamed(out)


def twin_tree(centres, sizes):
    """(left, right, cosine, size) of each merge; merged nodes are named -1, -2 and so on."""
    nodes = [(c, v, sizes[c]) for c, v in sorted(centres.items())]
    out = []
    while len(nodes) > 1:
        s, i, j = max(((round(float(nodes[i][1] @ nodes[j][1]), 6), -i, -j) for i in range(len(nodes)) for j in range(i + 1, len(nodes))))
        if s < 0.5:
            break
        a, b = nodes[-i], nodes[-j]
        out.append((a[0], b[0], s, a[2] + b[2]))
        v = a[1] + b[1]
        nodes = [n for n in nodes if n[0] not in (a[0], b[0])] + [(-len(out), v / np.linalg.norm(v), a[2] + b[2])]
    return out


def members(spark, labels, scope=0):
    return spark.createDataFrame([(scope, i, int(c)) for i, c in enumerate(labels)], "scope long, vec_id long, cluster long")


def labels_of(df, n):
    out = np.full(n, -2)
    for r in df.collect():
        out[r.vec_id] = r.cluster
    return out


@pytest.mark.parametrize("seed", [1])
def test_neighbours_equal_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    x = planted(rng)
    scope = np.array([0 if i % 3 else 1 for i in range(len(x))])
    scope[:2] = 7  # a scope without three neighbours
    d = far(x, scope)
    found = Neighbours(frame(spark, x, scope))
    got = {r.vec_id: r.distance for r in clustering.knn(frame(spark, x, scope)).collect()}
    want = np.sort(d, axis=1)[:, 2]
    assert len(got) == len(x) and all(got[i] is None if np.isinf(w) else got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))
    limit = spark.createDataFrame([(0, 0.1), (1, 0.3), (7, 2.0)], "scope long, eps double")
    eps = np.array([{0: 0.1, 1: 0.3, 7: 2.0}[s] for s in scope])
    reps = {r.rep for r in found.reps.collect()}
    near = {(i, j) for i in reps for j in reps if i < j and d[i, j] <= eps[i]}
    assert {(r.a, r.b) for r in found.within(limit).collect()} == near and len(near) > 50
    links = found.links(limit)
    linked = {r.node: r.component for r in components(links.select("a", "b")).collect()}
    names = closure(len(x), near)
    assert linked == {i: names[i] for i in {k for p in near for k in p}} and links.count() < len(near)
    assert len(found.centres) > 3


def test_cells_that_are_far_apart_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CENTRE", 5)
    rng = np.random.default_rng(3)
    x = unit(np.repeat(np.eye(12), 30, axis=0) + rng.normal(size=(360, 12)) * 0.02)
    found = Neighbours(frame(spark, x))
    all_pairs = (n := found.placed.select("block").distinct().count()) * (n + 1) // 2
    assert found._met(spark.createDataFrame([(0, 0.05)], "scope long, eps double")).count() < all_pairs / 3
    d = far(x, np.zeros(360))
    got = {r.rep: r.distance for r in found.nearest(3).collect()}
    assert all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(np.sort(d, axis=1)[:, 2]))


def test_a_dense_group_gives_few_links(spark):
    """A third of all vectors within the radius of each other: links stay in proportion to vectors and blocks."""
    rng = np.random.default_rng(4)
    x = unit(np.vstack((np.eye(12)[0] + rng.normal(size=(150, 12)) * 0.01, rng.normal(size=(300, 12)))))
    found = Neighbours(frame(spark, x))
    links = found.links(spark.createDataFrame([(0, 0.1)], "scope long, eps double")).count()
    blocks = found.placed.select("block").distinct().count()
    assert links < 2 * 450 + 16 * blocks * blocks < 150 * 149 / 2 + 16 * blocks * blocks


@pytest.mark.parametrize("seed", [5])
def test_density_clusters_and_refinement(spark, seed):
    rng = np.random.default_rng(seed)
    x = planted(rng)
    got = labels_of(clustering.density_clusters(frame(spark, x)), len(x))
    assert got.tolist() == twin_density(x).tolist() and len(set(got.tolist())) > 4 and -1 in got
    given = renamed(np.array([i % 4 for i in range(len(x))]))
    split = labels_of(clustering.refined(frame(spark, x), members(spark, given), 8), len(x))
    want = twin_refine(x, given, 8)
    assert split.tolist() == want.tolist() and len(set(want.tolist())) > 4


@pytest.mark.parametrize("n", [2, 3])
def test_few_vectors(spark, n):
    x = unit(np.eye(4)[np.arange(n) % 4] + 0.1)
    found, method = clustering.first_clusters(frame(spark, x))
    got = labels_of(found, n)
    assert got.tolist() == ([0] * n if n < 3 else got.tolist()) and method == ("single" if n < 3 else "kmeans")
    assert clustering.knn(frame(spark, x)).count() == n
    assert clustering.density_clusters(frame(spark, x).limit(0)).count() == 0


def test_noise_falls_back_to_kmeans(spark):
    x = unit(np.random.default_rng(7).normal(size=(80, 30)))
    found, method = clustering.first_clusters(frame(spark, x))
    assert method == "kmeans" and 2 <= len({r.cluster for r in found.collect()}) <= 3


@pytest.mark.parametrize("seed", [0])
def test_greedy_merges_equal_one_pair_at_a_time(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {c: int(rng.integers(1, 9)) for c in range(0, 60, 2)}
    pairs = [(a, b, float(rng.integers(930, 960)) / 1000) for a in sizes for b in sizes if a < b and rng.random() < 0.2]
    got = clustering.greedy_merges(spark.createDataFrame(pairs, "l long, r long, cosine double"), spark.createDataFrame(list(sizes.items()), "cluster long, size long"), 20)
    want = twin_greedy(pairs, sizes, 20)
    assert {r.cluster: r["into"] for r in got.collect()} == want and 3 < len(set(want.values())) < 25


def test_merging_with_a_cap_and_with_related_texts(spark):
    rng = np.random.default_rng(8)
    x = planted(rng, spread=0.2)
    parts = renamed(np.array([int(np.argmax(v[:6])) * 10 + i % 4 for i, v in enumerate(x)]))
    got = labels_of(clustering.merge_similar(frame(spark, x), members(spark, parts)), len(x))
    want = twin_merge(x, parts)
    assert got.tolist() == want.tolist() and len(set(want.tolist())) < len(set(parts.tolist())) - 3
    # related themes merge from 0.82 on; the others need 0.93
    v = unit(np.array([[1, 0, 0], [1, 0.1, 0], [0.9, 0.5, 0], [0.88, 0.52, 0.03], [0, 0.2, 1.0]]))
    labels = np.arange(5)
    related = spark.createDataFrame([(2, 0, True, 0.3), (3, 1, True, 0.2), (4, 1, True, 1.0)], "a long, b long, related boolean, score double")
    merged = labels_of(clustering.merge_similar(frame(spark, v), members(spark, labels), related), 5)
    assert merged.tolist() == [0, 0, 0, 0, 4]
    assert labels_of(clustering.merge_similar(frame(spark, v), members(spark, labels)), 5).tolist() == [0, 0, 2, 2, 4]


@pytest.mark.parametrize("seed", [0])
def test_merge_tree_equals_one_merge_at_a_time(spark, seed):
    rng = np.random.default_rng(20 + seed)
    base = unit(rng.normal(size=(5, 6)))
    centres = {3 * i: v for i, v in enumerate(unit(np.vstack([base[k % 5] + rng.normal(size=6) * 0.35 for k in range(26)])))}
    sizes = {c: int(rng.integers(1, 9)) for c in centres}
    rows = [(c, sizes[c], v.tolist()) for c, v in centres.items()]
    got = sorted(clustering.merge_tree(spark.createDataFrame(rows, "cluster long, size long, v array<double>")).collect(), key=lambda r: r.step)
    want = twin_tree(centres, sizes)
    assert [(r.lft, r.rgt, r.size) for r in got] == [(a, b, n) for a, b, _, n in want] and len(want) > 12
    assert [r.similarity for r in got] == pytest.approx([s for _, _, s, _ in want], abs=1e-4)
    assert [r.node for r in got] == [-1 - r.step for r in got] and min(r.similarity for r in got) >= 0.5
    assert any(b.similarity > a.similarity for a, b in zip(got, got[1:], strict=False)) or seed  # a merge may be nearer than the one before


def test_merge_tree_of_far_and_of_no_clusters(spark):
    schema = "cluster long, size long, v array<double>"
    assert clustering.merge_tree(spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0])], schema)).count() == 0
    assert clustering.merge_tree(spark.createDataFrame([], schema)).count() == 0


def test_must_link_groups(spark):
    labels = np.array([0, 0, 2, 2, 2, -1, -1, -1, -1])
    groups = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5), ("b", 6), ("c", 7), ("d", 0), ("d", 8), ("d", 99)], "group_id string, post_id long")
    got = labels_of(clustering.must_linked(members(spark, labels), groups), 9)
    # post 1 goes to the cluster of 2 and 3, two posts of noise become a cluster, one post alone doesn't, 8 follows 0
    assert got.tolist() == [0, 1, 1, 1, 1, 5, 5, -1, 0]


def test_the_whole_way_equals_its_twin(spark):
    rng = np.random.default_rng(9)
    x = planted(rng)
    found, method = clustering.themes(frame(spark, x))
    got = np.full(len(x), -1)
    for r in found.collect():
        got[r.vec_id] = r.theme
    state = twin_refine(x, twin_merge(x, twin_density(x)), 8)
    state = twin_refine(x, twin_merge(x, state), 12)
    assert method.startswith("density") and got.tolist() == state.tolist()
    assert found.select(F.count_distinct("theme")).first()[0] > 3


def bodies(plan):
    """The texts of all lambdas in a plan."""
    out, at = [], plan.find("lambdafunction(")
    while at >= 0:
        end, depth = at + len("lambdafunction("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        out.append(plan[at:end])
        at = plan.find("lambdafunction(", at + 1)
    return out


def test_lengths_are_worked_out_once_for_a_vector(spark):
    """Inside a lambda a length is worked out again for each element, and lengths in lengths to the fourth power."""
    rows = [(i, i % 4, [float((i * k) % 7 + 1) for k in range(40)]) for i in range(20)]
    units = themes.unit_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    lifted = themes.lifted_vectors(units)
    found = bodies(lifted._jdf.queryExecution().optimizedPlan().toString())
    assert found and not [b for b in found if "aggregate(" in b]
    for r in lifted.collect():
        assert abs(sum(x * x for x in r.v) - 1) < 1e-9


def test_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    """Where no cell can be dropped, each vector goes once to each block: cells share blocks, which are few."""
    monkeypatch.setattr(vectors, "BLOCK", 32768)
    x = unit(np.random.default_rng(9).normal(size=(1200, 16)))
    found = Neighbours(frame(spark, x))
    assert len(found.centres) > 20 and 2 <= found.placed.select("block").distinct().count() <= 4
    got = {r.rep: r.distance for r in found.nearest(3).collect()}
    assert all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(np.sort(far(x, np.zeros(1200)), axis=1)[:, 2]))


def test_values_reach_many_copies_without_a_shuffle_of_them(spark, monkeypatch):
    monkeypatch.setattr(clustering, "COPIES", 4)
    x = unit(np.random.default_rng(2).normal(size=(9, 5)))[[0] * 6 + [1] * 2 + list(range(2, 9))]
    got = {r.vec_id: r.distance for r in clustering.knn(frame(spark, x)).collect()}
    want = np.sort(far(x, np.zeros(len(x))), axis=1)[:, 2]
    assert len(got) == len(x) and all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))


def test_neighbours_of_a_label_equal_the_text(spark):
    """By blocks as by the text, with null labels, equal vectors and repeated ids; spanning links give the same clusters."""
    x = np.random.default_rng(6).normal(size=(150, 6))
    x[7] = x[8]
    rows = [(0 if i == 1 else i, None if i % 29 == 5 else i % 3, v.tolist()) for i, v in enumerate(x)]
    units = themes.unit_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    want = themes.neighbours(units)
    got = themes.near_vectors(units)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    linked = {tuple(r) for r in components(want.select("a", "b")).collect()}
    assert {tuple(r) for r in themes.density_clusters(units).collect()} == linked and len(linked) > 100
