import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.vectors import cosine, usable
from loomgraph.operators import activation, community, curvature, folds, fusion, graph, jobs, resolve, similarity
from loomgraph.operators.activation import Spread

EDGE = "seq bigint, uuid string, source_uuid string, target_uuid string, name string, fact string, group_id string"
NEAR = "group_id string, uuid string, neighbour string, name string, entity_type string, fact string, edge_name string"


def spread(spark, links, seeds, intent="WHAT", vectors=None, query=None, inhibited=True, **limits):
    near = spark.createDataFrame([("g", a, b, b, "", f"{a}{b}", n) for a, b, n in links], NEAR)
    queries = spark.createDataFrame([(1, "g", intent, query)], "query_id bigint, group_id string, intent string, embedding array<float>")
    entities = spark.createDataFrame([(k, v) for k, v in (vectors or {}).items()] or [("none", None)], "uuid string, embedding array<float>")
    first = spark.createDataFrame([(1, s) for s in seeds], "query_id bigint, uuid string")
    out = activation.spread(first, near, queries, entities, Spread(**{"width": 10, "hops": 1, "nodes": 50, "lambda2": 0.5} | limits))
    out = activation.inhibit(out) if inhibited else out
    return {r.uuid: round(r.activation, 6) for r in out.collect()}


def test_spreading(spark):
    assert spread(spark, [("alice", "bob", "")], ["alice"]) == {"bob": 1.5, "alice": 0.925}
    assert spread(spark, [("s1", "x", ""), ("s2", "x", "")], ["s1", "s2"]) == {"x": 3.0, "s1": 0.7, "s2": 0.7}
    assert spread(spark, [("a", "b", ""), ("b", "c", "")], ["a"]).get("c") is None
    assert spread(spark, [("a", "b", "")], []) == {}
    assert spread(spark, [("alice", "bob", ""), ("bob", "alice", "")], ["alice"], hops=3) == {"bob": 1.5, "alice": 0.925}
    assert len(spread(spark, [("c", f"x{i}", "") for i in range(10)], ["c"], hops=5, nodes=3, width=20)) <= 3
    assert len(spread(spark, [("c", f"x{i}", "") for i in range(5)], ["c"], width=2, inhibited=False)) == 6
    why = spread(spark, [("a", "e", "CAUSES")], ["a"], "WHY", inhibited=False)["e"]
    what = spread(spark, [("a", "e", "CAUSES")], ["a"], "WHAT", inhibited=False)["e"]
    assert (why, what) == (round(0.5 + math.e, 6), round(0.5 + math.exp(0.5), 6))
    got = spread(spark, [("alice", "tech", ""), ("alice", "other", "")], ["alice"], vectors={"tech": [1.0, 0.0], "other": [0.0, 1.0]}, query=[1.0, 0.0])
    assert got == {"tech": 1.074361, "alice": 0.988846, "other": 0.663846}


def test_defaults():
    assert Spread(0, 0, 0, 0, -1, -1).filled() == Spread(10, 5, 200, 0.5, 1.0, 0.5)
    assert Spread().filled() == Spread(10, 5, 200, 0.5, 1.0, 0.0)


def pairs(spark, edges):
    return spark.createDataFrame([("g", str(min(a, b)), str(max(a, b))) for a, b in edges], "group_id string, lo string, hi string")


@pytest.mark.parametrize(
    "edges, wanted",
    [
        ([(0, 1), (1, 2), (0, 2)], {("0", "1"): 0.5}),
        ([(0, 1), (0, 2), (0, 3), (0, 4)], {("0", "1"): 0.0}),
        ([(0, 1), (1, 2), (2, 3)], {("1", "2"): 0.0}),
        ([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], {("2", "3"): -2 / 3, ("0", "1"): 0.5}),
        ([(a, b) for a in range(4) for b in range(a)], {("0", "1"): 2 / 3}),
    ],
)
def test_curvature(spark, edges, wanted):
    got = {(r.source_uuid, r.target_uuid): r.curvature for r in curvature.curvatures(pairs(spark, edges)).collect()}
    for k, v in wanted.items():
        assert got[k] == pytest.approx(v)
    assert all(-2 <= v <= 1 for v in got.values())


def test_curvature_by_blocks_equals_all_costs(spark):
    rng = np.random.default_rng(5)
    links = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 40, (150, 2)).tolist() if a != b} | {(0, i) for i in range(1, 40, 2)}
    adjacent = {f"{i:02}": sorted({f"{y:02}" for x in links for y in x if i in x and y != i}) for i in range(40)}
    rows = [(g, f"{a:02}", f"{b:02}") for g in "gh" for a, b in links] + [("k", "a", "b"), ("k", "a", "b")]
    found = curvature.transports(spark.createDataFrame(rows, "group_id string, lo string, hi string"), work=3_000).collect()
    assert len(found) == 2 * len(links) + 1
    for r in found:
        if r.group_id == "k":
            assert (r.n0, r.n1, r.n2, r.n3, r.curvature) == (0, 1, 0, 0, 0.0)
            continue
        u, v = adjacent[r.lo], adjacent[r.hi]
        assert r.curvature == curvature.edge_curvature(u, v, adjacent)  # to the last bit
        costs = [0 if a == b else 1 if b in adjacent[a] else 2 if b in u or a in v else 3 for a in u for b in v]
        assert [r.n0, r.n1, r.n2, r.n3] == [costs.count(c) for c in range(4)]


def test_transport():
    assert curvature.greedy_transport(np.array([[0.0, 1], [1, 0]])) == 0
    assert curvature.greedy_transport(np.array([[1.0]])) == 1


def test_louvain(spark):
    edges = pairs(spark, [("alice", "bob"), ("bob", "carol"), ("alice", "carol"), ("dave", "eve")]).withColumn("weight", F.lit(1))
    nodes = spark.createDataFrame([("g", n) for n in ("alice", "bob", "carol", "dave", "eve", "zoe")] + [("h", "one")], "group_id string, uuid string")
    got = {r.uuid: r.community_id for r in community.louvain(edges, nodes).collect()}
    assert got["alice"] == got["bob"] == got["carol"] and got["dave"] == got["eve"] and len({got["alice"], got["dave"], got["zoe"]}) == 3 and "one" not in got
    cliques = [(f"{k}{i}", f"{k}{j}") for k in "abc" for i in range(5) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    weighted = pairs(spark, cliques).withColumn("weight", F.lit(1))
    found = community.louvain(weighted, weighted.select("group_id", F.explode(F.array("lo", "hi")).alias("uuid")).distinct())
    assert {frozenset(r.m) for r in found.groupBy("community_id").agg(F.collect_list("uuid").alias("m")).collect()} == {frozenset(f"{k}{i}" for i in range(5)) for k in "abc"}
    assert community.modularity(weighted, found).first().modularity > 0.5


def test_louvain_goes_on_until_nothing_merges(spark):
    rng = np.random.default_rng(3)
    links = [(f"{i:03}", f"{j:03}") for i in range(120) for j in range(i) if rng.random() < (0.35 if i % 4 == j % 4 else 0.03)]
    weighted = pairs(spark, links).withColumn("weight", F.lit(1))
    found = community.louvain(weighted, weighted.select("group_id", F.explode(F.array("lo", "hi")).alias("uuid")).distinct())
    of = {r.uuid: r.community_id for r in found.collect()}
    assert {frozenset(u for u in of if of[u] == c) for c in of.values()} == {frozenset(f"{i:03}" for i in range(k, 120, 4)) for k in range(4)}


def test_louvain_in_a_task_equals_joins(spark):
    rng = np.random.default_rng(8)
    links = [(g, f"{i:02}", f"{j:02}", int(rng.integers(1, 4))) for g in "ab" for i in range(40) for j in range(i) if rng.random() < (0.4 if i % 5 == j % 5 else 0.06)] + [("c", "x", "y", 1)]
    weighted = spark.createDataFrame(links, "group_id string, lo string, hi string, weight bigint")
    nodes = weighted.select("group_id", F.explode(F.array("lo", "hi")).alias("uuid")).distinct()
    of = lambda most: {tuple(r) for r in community.louvain(weighted, nodes, whole=most).collect()}
    found = of(10**6)
    assert len(found) == nodes.count() and found == of(0) == of(150)  # all in tasks, all by joins, by joins until few edges are left


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(300)] + [("z1", "z2")], "lo string, hi string")
    got = graph.components(chain).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {("0000", 301), ("z1", 2)}
    assert graph.components(chain.limit(0)).count() == 0


def test_neighbour_graph_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([("g" if i < 50 else "h", f"{i:02}", v.tolist()) for i, v in enumerate(x)] + [("g", "none", None)], "group_id string, id string, embedding array<float>")
    got = {(r.id, r.other): r["rank"] for r in similarity.nearest_neighbours(rows, 5, block=16).collect()}
    u = np.array([np.float32(v) for v in x], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for i in range(60):
        own = [j for j in range(60) if j != i and (j < 50) == (i < 50)]
        best = sorted(own, key=lambda j: (-round(float(u[i] @ u[j]), 12), j))[:5]
        assert {o for a, o in got if a == f"{i:02}"} == {f"{j:02}" for j in best}
    edges = similarity.mutual_edges(similarity.nearest_neighbours(rows, 5)).collect()
    assert all((e.source_uuid, e.target_uuid) in got and (e.target_uuid, e.source_uuid) in got for e in edges)
    old, new = rows.where("id < '40'"), rows.where("id >= '40' AND id <> 'none'")
    before = similarity.mutual_edges(similarity.nearest_neighbours(old, 5))
    after = similarity.append_mutual(old, new, before, 5)
    assert before.exceptAll(after).count() == 0 and after.count() > before.count()


def test_vectors_are_blocked_as_they_are(spark):
    rows = [("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0, None]), ("e", [float("inf"), 1.0]), ("f", [6.0, 8.0]), ("h", [4.0, 3.0]), ("i", [1.0]), ("j", []), ("k", None)]
    vectors = spark.createDataFrame([("g", *r) for r in rows], "group_id string, id string, embedding array<float>")
    near = similarity.nearest_neighbours(vectors, 5)
    assert {(r.id, r.other, r.score) for r in near.collect()} == {(a, b, 1.0 if {a, b} == {"a", "f"} else 0.96) for a in "afh" for b in "afh" if a != b}
    # What is written and shuffled is the vector as stored, not its doubles of length one.
    assert "array<double>" not in similarity._vectors(vectors)._jdf.queryExecution().optimizedPlan().schema().simpleString()
    assert "embedding" in similarity._vectors(vectors).columns


def test_cosine_rules(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r.c for r in rows.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    bad = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([float("inf"), 1.0],), ([1.0, None],), (None,), ([1.0],)], "v array<float>")
    assert [r.u for r in bad.select(usable(F.col("v"), 2).alias("u")).collect()] == [True, False, False, False, False, False, False]


def entity(uuid, name, kind, vector, seq=1, group="g"):
    return (seq, uuid, name, kind, group, None, vector, None, -1)


ENTITY = "seq bigint, uuid string, name string, entity_type string, group_id string, created_at timestamp, embedding array<float>, description string, community_id int"


def test_resolution(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    people = [entity("a", "Jonathan Harker", "person", v, 1), entity("b", "Harker Jonathan", "person", v, 2), entity("c", "Castle Dracula", "place", v, 3), entity("d", "Mozart", "person", v, 4), entity("e", "Bach", "person", v, 5), entity("f", "Jonathan Harker", "person", None, 6), entity("h", "Mina Jonathan Harker", "person", w, 7)]
    entities = spark.createDataFrame(people, ENTITY)
    members = resolve.clusters(resolve.candidate_pairs(entities))
    assert {(r.cluster, r.uuid) for r in members.collect()} == {("a", "a"), ("a", "b")}
    edges = spark.createDataFrame([(1, "1", "b", "c", "IN", "f", "g"), (2, "2", "b", "d", "KNOWS", "f", "g"), (3, "3", "a", "b", "KNOWS", "f", "g"), (4, "4", "a", "c", "IN", "f", "g")], EDGE)
    chosen = resolve.canonical(members, entities, edges)
    assert chosen.first().canonical == "b"
    moved = resolve.renames(members, chosen)
    assert {r.uuid for r in resolve.merge_edges(edges, moved).collect()} == {"1", "2"}
    assert {r.uuid for r in resolve.drop_merged(entities, moved).collect()} == set("bcdefh")
    links = spark.createDataFrame([("a", "x"), ("b", "x")], "entity_uuid string, episode_uuid string")
    assert resolve.relink_episodes(links, moved).count() == 1
    dry = resolve.summary(members, edges, links, True).first()
    assert (dry.clusters, dry.entities_merged) == (1, 0)


def test_upserts(spark):
    rows = [(1, "u1", "Alice", "Person", "g", None, None, "d1", -1), (2, "u2", "ALICE", "Place", "g", None, [1.0], "d2", -1), (3, "u3", "alice", "Person", "g", None, None, "d3", -1)]
    got = folds.upsert_entities(spark.createDataFrame(rows, ENTITY)).collect()
    assert len(got) == 1 and (got[0].uuid, got[0].description, got[0].embedding, got[0].entity_type) == ("u1", "d2", [1.0], "Person")
    schema = "seq bigint, uuid string, source_uuid string, target_uuid string, name string, fact string, group_id string, valid_at string, invalid_at string, episodes string, created_at timestamp, embedding array<float>"
    edges = spark.createDataFrame([(1, "e1", "a", "b", "K", "f1", "g", "2020", None, "[]", None, [1.0]), (2, "e2", "a", "b", "K", "f2", "g", "2021", None, "[]", None, None), (3, "e3", "a", "b", "L", "f3", "g", None, None, "[]", None, None)], schema)
    got = {r.name: r for r in folds.upsert_edges(edges).collect()}
    assert (got["K"].uuid, got["K"].fact, got["K"].valid_at, got["K"].embedding) == ("e1", "f2", "2020", None) and len(got) == 2


def test_queue(spark):
    schema = "id bigint, type string, payload string, status string, attempts int, max_attempts int, error string, not_before timestamp, created_at timestamp, updated_at timestamp"
    rows = spark.sql(
        """SELECT * FROM VALUES (1, 'ingest', '{"content":"c"}', 'processing', 2, 3, NULL, NULL, timestamp'2026-01-01 00:00:00', timestamp'2026-01-01 00:00:00'),
        (2, 'ingest', '{"con', 'processing', 0, 3, NULL, NULL, timestamp'2026-01-01 00:00:01', timestamp'2026-01-01 00:09:00'),
        (3, 'ingest', NULL, 'pending', 0, 3, NULL, timestamp'2027-01-01 00:00:00', timestamp'2026-01-01 00:00:02', NULL), (4, 'ingest', '', 'failed', 3, 3, 'x', NULL, NULL, NULL)"""
    ).toDF(*[c.split()[0] for c in schema.split(", ")])
    now = F.lit("2026-01-01 00:10:00").cast("timestamp")
    failed = {r.id: (r.status, r.attempts) for r in jobs.fail(rows, F.col("status") == "processing", F.lit("e"), now).collect()}
    assert failed == {1: ("failed", 3), 2: ("pending", 1), 3: ("pending", 0), 4: ("failed", 3)}
    assert [r.id for r in jobs.recover(rows, now).where("status = 'pending'").orderBy("id").collect()] == [1, 3]
    assert jobs.claim(rows, now).count() == 0
    assert [r.id for r in jobs.claim(jobs.requeue(rows, now), now).collect()] == [4]
    assert {r.status: r.n for r in jobs.stats(rows).collect()} == {"pending": 1, "processing": 2, "failed": 1, "done": 0}
    assert {r.id: r.content for r in jobs.payload(rows).collect()} == {1: "c", 2: None, 3: None, 4: None}


def test_fusion(spark):
    ranks = lambda *u: spark.createDataFrame([(1, x, i) for i, x in enumerate(u)], "query_id bigint, uuid string, rank int")
    got = {(r.kind, r.uuid): r.score for r in fusion.fuse({"edge_text": ranks("a", "b"), "edge_vector": ranks("b"), "episode_text": ranks("p"), "traversal": ranks("e")}).collect()}
    assert got == {("edge", "a"): 0.5, ("edge", "b"): pytest.approx(1 / 3 + 0.25), ("episode", "p"): 0.75, ("entity", "e"): 0.5}
    results = spark.createDataFrame([(1, 1, "edge", "a", "T", "body" * 10, 1.0, "s/session_2"), (1, 2, "edge", "b", "T", "x", 0.5, "s/session_1"), (1, 3, "episode", "c", "", "y", 0.1, None)], "query_id bigint, rank int, type string, uuid string, title string, body string, score double, source string")
    assert [r.uuid for r in fusion.within_budget(results, 11).orderBy("rank").collect()] == ["a"]
    assert {r.uuid for r in fusion.cut_weak(results).collect()} == {"a", "b"}
    decayed = {r.uuid: round(r.score, 6) for r in fusion.decay_by_session(results).collect()}
    assert decayed == {"a": 1.0, "b": round(0.5 * math.exp(-0.15), 6), "c": 0.1}
    assert '"type":"edge"' in fusion.as_json_lines(results).first().line


def test_neighbour_graph_is_kept_by_group(spark):
    rows = [("g", f"a{i}", [float(i == j) + 0.1 for j in range(4)]) for i in range(4)] + [("h", f"b{i}", [1.0, float(i), 0.0, 0.0]) for i in range(3)]
    vectors = spark.createDataFrame(rows, "group_id string, id string, embedding array<float>")
    whole = community.neighbour_graph(vectors, k=2)
    marked = spark.createDataFrame([("g", "x", "y", 4), ("h", "x", "y", 2)], whole.schema)
    again = {tuple(r) for r in community.neighbour_graph(vectors, marked, 2).collect()}
    assert {r for r in again if r[0] == "g"} == {("g", "x", "y", 4)}
    assert {r for r in again if r[0] == "h"} == {tuple(r) for r in whole.where("group_id = 'h'").collect()} != set()
    curved, found = community.neighbour_communities(whole)
    assert curved.count() == whole.count() and {r.uuid for r in found.collect()} == {u for r in whole.collect() for u in (r.source_uuid, r.target_uuid)}
