"""Near-duplicate vectors against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probspark.llm import embedding_dedup as E
from probspark.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, kept int, cell string"


def brute(rows):
    x = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        v = np.array(v, np.float32).astype(float)
        x[i] = (label, len(v), v / np.linalg.norm(v))
    near = {i: {j for j in x if j != i and x[i][:2] == x[j][:2] and x[i][2] @ x[j][2] >= 0.98} for i in x}
    root = {i: i for i in x}
    for _ in x:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in x}
    return {i: (len(near.get(i, ())), root.get(i, i)) for i, *_ in rows if i is not None}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for label in (0, 1):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 14)):
                out.append(((centre + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.3])).tolist(), label))
    same = rng.normal(size=16).tolist()
    out += [(same, 0)] * 5 + [(same, 1), (same, None), (None, 0), ([], 0), ([0.0] * 16, 0), ([1.0, None] * 8, 0), ([float("nan")] * 16, 0), ([float("inf")] * 16, 0)]
    out += [(same[:8], 0), ([2 * v for v in same], 0), ([1e30 * v for v in same], 0), ([1e-30 * v for v in same], 0)]
    ids = rng.permutation(1000)[: len(out)]
    return [(int(i), v, label, 1, "x") for i, (v, label) in zip(ids, out, strict=True)]


@pytest.mark.parametrize("most", [1500, 20])
def test_links_match_all_pairs(spark, rows, most):
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), most=most, least_recall=1.0).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_near_copy_group_stays_whole(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.03).tolist(), 1, 0, "") for i in range(150)] + [(200 + i, rng.normal(size=16).tolist(), 1, 0, "") for i in range(100)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), most=30).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_tight_shard_counts_its_core_and_searches_the_rest_in_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [(i, (unit(centre) + 0.012 * rng.normal(size=16)).tolist(), 1, 0, "") for i in range(400)]
    rows += [(1000 + i, (unit(centre) + 0.05 * rng.normal(size=16)).tolist(), 1, 0, "") for i in range(120)]
    rows += [(2000 + i, rows[i][1], 1, 0, "") for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = E.near_duplicates(frame, most=60).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    shards = E.cluster_shards(frame.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit("a").alias("cell")), 60)
    assert shards.filter("core").count() > 300


@pytest.mark.parametrize("most", [40, 1500])
def test_a_poor_graph_is_noticed_and_the_result_still_right(spark, rows, most, monkeypatch):
    monkeypatch.setattr(E, "robust_graph", lambda x, degree, candidates: [np.zeros(0, np.int64) for _ in x])
    monkeypatch.setattr(E, "ENTRIES", 1)
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA), most=most).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert {r.audit_recall for r in got} == {1.0}


def test_blocks_name_cells_alike_in_any_order_of_pivots():
    rng = np.random.default_rng(2)
    heads, member = rng.normal(size=(6, 16)), rng.normal(size=(3, 16))
    heads[3] = heads[2] + 0.01

    def split(order):
        x = np.concatenate([heads[order], member])
        table = {"rep": [-1] * 6 + [7, 8, 9], "copies": [0] * 6 + [1] * 3, "embedding": x.tolist(), "cell": ["c"] * 9, "pivot": [True] * 6 + [False] * 3, "n": [*order, 16, 16, 16]}
        out = E._split(pa.table(table)).to_pydict()
        return sorted(zip(out["rep"], out["cell"], strict=True))

    assert split([0, 1, 2, 3, 4, 5]) == split([5, 3, 2, 0, 4, 1])


def test_odd_tables(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0, 0.0], 0, 0, ""), (4, [1.0, 0.0], 0, 0, ""), (4, [1.0, 0.0], 0, 0, "")]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0, -1), (4, 1, 4), (4, 1, 4)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 30)] + [(3, 3), (5, 6), (6, 5)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {k: 7 for k in range(7, 30)} | {3: 3, 5: 5, 6: 5}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def matrix_truth(x):
    """Links and classes of unit rows by all pairs."""
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (low == root).all():
            return near.sum(1), root
        root = low


def turned(rng, x, angle):
    """``x`` turned by ``angle`` in a direction of its own."""
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(-1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=-1, keepdims=True)
    return np.cos(angle) * x + np.sin(angle) * other


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.mark.parametrize("case", ["clumps", "tight group"])
def test_no_link_is_lost_or_counted_at_one_end(spark, case):
    rng = np.random.default_rng(6)
    if case == "clumps":  # pairs of clumps whose members are near to each other and just in range of the other clump's
        centres = unit(rng.normal(size=(25, 64)))
        ends = np.concatenate([centres, turned(rng, centres, 0.19)])
        x = np.concatenate([unit(np.repeat(ends, 60, axis=0) + 0.0004 * rng.normal(size=(3000, 64))), unit(rng.normal(size=(1500, 64)))])
    else:
        tight = unit(unit(rng.normal(size=64)) + 0.02 * rng.normal(size=(1400, 64)))
        heads = unit(rng.normal(size=(300, 64)))
        x = np.concatenate([tight, heads, turned(rng, heads, 0.195), unit(rng.normal(size=(3000, 64)))])
    x = x[rng.permutation(len(x))]
    links, classes = matrix_truth(x)
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.audit_recall, r.audit_way) for r in E.near_duplicates(frame).collect())
    assert [r[2] for r in got] == classes.tolist()
    assert [r[1] for r in got] == links.tolist()
    assert {r[4] for r in got} <= {"graph", "all pairs"} and {r[3] for r in got} == {1.0}


def test_audit_weighs_small_groups_like_large_ones(spark):
    """A large group found whole doesn't hide that small ones are not found."""
    rng = np.random.default_rng(7)
    x = np.concatenate([unit(unit(rng.normal(size=32)) + 0.01 * rng.normal(size=(300, 32))), np.repeat(unit(rng.normal(size=(30, 32))), 2, axis=0) + 0.001 * rng.normal(size=(60, 32))])
    groups = spark.createDataFrame([(i, 1, v, "a") for i, v in enumerate(x.tolist())], "rep long, copies long, embedding array<double>, cell string")
    links = spark.createDataFrame([(i, 299) for i in range(300)] + [(300, 1)], "rep long, links long")
    assert E.audited_recall(groups, links, 0.98) == 0.0
    assert E.audited_recall(groups, spark.createDataFrame([(i, 299 if i < 300 else 1) for i in range(360)], "rep long, links long"), 0.98) == 1.0


@pytest.mark.parametrize("width", [3, 64])
def test_a_vector_is_in_one_shard_and_every_link_meets_in_a_home(spark, width):
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=(900, width)))
    x = np.concatenate([x, turned(rng, x, rng.uniform(0.15, 0.2, size=(900, 1)))])
    groups = spark.createDataFrame([(i, 1, v, "a") for i, v in enumerate(x.tolist())], "rep long, copies long, embedding array<double>, cell string")
    shards = E.cluster_shards(groups, 300).collect()
    assert sorted(r.rep for r in shards) == list(range(len(x)))
    home, visits = {r.rep: r.home for r in shards}, {r.rep: set(r.visits) for r in shards}
    assert len(set(home.values())) > 6 and all(home[i] in visits[i] for i in home)
    near = np.argwhere(np.triu(x @ x.T >= 0.98, 1)).tolist()
    assert len(near) >= 800 and sum(home[a] != home[b] for a, b in near) > 50
    assert all(home[a] in visits[b] or home[b] in visits[a] for a, b in near)


@pytest.mark.parametrize("width", [3, 16])
def test_links_across_shards_count_once_at_both_ends(spark, width):
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(500, width)))
    x = np.concatenate([x, turned(rng, x, 0.19), turned(rng, x, 0.05)])
    links, classes = matrix_truth(x)
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.audit_way) for r in E.near_duplicates(frame, most=120).collect())
    assert [r[1] for r in got] == links.tolist()
    assert [r[2] for r in got] == classes.tolist()
    assert {r[3] for r in got} == {"graph"}
