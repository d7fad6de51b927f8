"""Communities: Louvain by rounds of joins, listings and reports of facts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import curvature, folds, similarity
from loomgraph.session import cut_lineage

#: Edges of a group, both ways, up to which it is worked on in one task.
WHOLE = 1_000_000


def _proposals(inner: DataFrame, state: DataFrame, total: DataFrame, resolution: float) -> DataFrame:
    """state with to and up, the move from trial of the greatest gain (null if none gains), and its part of the modularity."""
    k = state.select("group_id", "node", "k", F.col("trial").alias("mine"))
    sizes = k.groupBy("group_id", F.col("mine").alias("c")).agg(F.sum("k").alias("tot"))
    links = inner.join(k.select("group_id", F.col("node").alias("d"), F.col("mine").alias("c")), ["group_id", "d"]).groupBy("group_id", F.col("s").alias("node"), "c").agg(F.sum("w").alias("w"))
    stay = k.select("group_id", "node", F.col("mine").alias("c"), F.lit(0.0).alias("w"))
    options = links.unionByName(stay).groupBy("group_id", "node", "c").agg(F.sum("w").alias("w"))
    options = options.join(k, ["group_id", "node"]).join(sizes, ["group_id", "c"]).join(total, "group_id")
    at_home = F.col("c") == F.col("mine")
    expected = lambda tot: resolution * F.col("k") * tot / F.col("m2")
    gain = F.col("w") - expected(F.col("tot") - F.when(at_home, F.col("k")).otherwise(0.0))
    best = options.groupBy("group_id", "node").agg(
        F.min(F.when(~at_home, F.struct((-F.round(gain, 9)).alias("g"), "c"))).alias("b"),
        F.max(F.when(at_home, F.round(gain, 9))).alias("home"),
        F.max(F.when(at_home, F.col("w") - expected(F.col("tot")))).alias("part"),
    )
    up = F.round(-F.col("b.g") - F.col("home"), 9)
    return state.join(best.select("group_id", "node", "part", F.when(up > 0, F.col("b.c")).alias("new_to"), F.when(up > 0, up).alias("new_up")), ["group_id", "node"])


def _next_trial(view: DataFrame, number: int) -> DataFrame:
    """The state after a round: trials that raised their group's modularity are taken, others taken back, and new moves chosen."""
    score = view.groupBy("group_id").agg(F.round(F.sum("part"), 9).alias("new_q"))
    grew = F.col("q").isNull() | (F.col("new_q") > F.col("q"))
    taken = lambda new, old: F.when(F.col("grew"), F.col(new)).otherwise(F.col(old))
    rows = view.join(score, "group_id").withColumn("grew", grew).select(
        "group_id", "node", "k", taken("trial", "com").alias("com"), taken("new_to", "to").alias("to"), taken("new_up", "up").alias("up"), taken("new_q", "q").alias("q"),
        F.when(F.col("grew"), F.greatest(F.col("one_in") / 2, F.lit(2))).otherwise(F.col("one_in") * 2).cast("int").alias("one_in"),
    )
    moves = rows.where("to IS NOT NULL")
    order = F.struct((-F.col("up")).alias("up"), F.col("node").alias("node"))
    first = moves.select("group_id", F.explode(F.array("com", "to")).alias("c"), order.alias("o")).groupBy("group_id", "c").agg(F.min("o").alias("o"))
    first = first.select("group_id", "c", F.col("o.node").alias("first"))
    left = first.select("group_id", F.col("c").alias("com"), F.col("first").alias("leaves"))
    right = first.select("group_id", F.col("c").alias("to"), F.col("first").alias("enters"))
    alone = F.coalesce((F.col("leaves") == F.col("node")) & (F.col("enters") == F.col("node")), F.lit(False))
    drawn = (F.col("one_in") <= 4) & (F.pmod(F.xxhash64("group_id", "node", F.lit(number)), F.col("one_in")) == 0)
    # 16: not even the moves apart from each other raised it, as their gain is lost in rounding.
    going = moves.where("one_in < 16").select("group_id").distinct().withColumn("going", F.lit(True))
    out = rows.join(left, ["group_id", "com"], "left").join(right, ["group_id", "to"], "left").join(going, "group_id", "left")
    trial = F.when(F.col("to").isNotNull() & (alone | drawn), F.col("to")).otherwise(F.col("com"))
    return out.select("group_id", "node", "k", "com", "to", "up", "q", "one_in", trial.alias("trial"), F.coalesce("going", F.lit(False)).alias("going"))


def _local_moves(edges: DataFrame, resolution: float) -> DataFrame:
    """(group_id, node, com): nodes move to the neighbouring community of the greatest gain until no move gains.

    In a round, half of the nodes that would gain move at once, drawn by hash, and with them the moves that
    are the best of both their communities. If that does not raise a group's modularity, the round is taken
    back for the group and a quarter is drawn, then none: moves that share no community add up, so the
    modularity grows with every round that counts and the rounds end. A group without a gaining move is left
    out of further rounds. edges are both ways.
    """
    degree = cut_lineage(edges.groupBy("group_id", F.col("s").alias("node")).agg(F.sum("w").alias("k")))
    total = cut_lineage(degree.groupBy("group_id").agg(F.sum("k").alias("m2")))
    inner = cut_lineage(edges.where("s <> d"))
    none = lambda kind: F.lit(None).cast(kind)
    state = degree.select("group_id", "node", "k", F.col("node").alias("com"), none("string").alias("to"), none("double").alias("up"), none("double").alias("q"), F.lit(2).alias("one_in"), F.col("node").alias("trial"))
    ended, number = [], 0
    while True:
        view = cut_lineage(_proposals(inner, state, total, resolution))
        after = cut_lineage(_next_trial(view, number))
        going = after.agg(F.count_if("going").alias("going"), F.count_if(~F.col("going")).alias("ended")).first()
        if going.ended or not going.going:
            ended.append(after.where("NOT going").select("group_id", "node", "com"))
        if not going.going:
            return reduce(DataFrame.unionByName, ended)
        if going.ended:
            groups = after.where("going").select("group_id").distinct()
            inner = cut_lineage(inner.join(groups, "group_id", "left_semi"))
        state, number = after.where("going").drop("going"), number + 1


def _draw(seeds: np.ndarray, number: int) -> np.ndarray:
    """xxhash64 of an int after what the seeds are hashes of, as Spark has it."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (seeds + p5 + np.uint64(4)) ^ (np.uint64(number) * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sum of w."""
    if not len(a):
        return a, b, w
    n = int(b.max()) + 1
    keys, of = np.unique(a * n + b, return_inverse=True)
    return keys // n, keys % n, np.bincount(of, w, len(keys))


def _settled(s: np.ndarray, d: np.ndarray, w: np.ndarray, seeds: np.ndarray, resolution: float) -> np.ndarray:
    """Of one group, _local_moves in the same rounds: the community of each number, its own for what has no edge."""
    n = len(seeds)
    node = np.unique(s)
    k = np.bincount(s, w, n)
    m2 = k.sum()
    inner = s != d
    s, d, w = s[inner], d[inner], w[inner]
    com, to, up, trial = np.arange(n), np.full(n, -1), np.zeros(n), np.arange(n)
    q, one_in, number = None, 2, 0
    while True:
        tot = np.bincount(trial[node], k[node], n)
        x, c, links = _summed(np.concatenate([s, node]), np.concatenate([trial[d], trial[node]]), np.concatenate([w, np.zeros(len(node))]))
        home = c == trial[x]
        gain = np.round(links - resolution * k[x] * (tot[c] - np.where(home, k[x], 0.0)) / m2, 9)
        part = links[home] - resolution * k[x[home]] * tot[c[home]] / m2
        at_home = np.zeros(n)
        at_home[x[home]] = gain[home]
        x, c, gain = x[~home], c[~home], gain[~home]
        best = np.lexsort((c, -gain, x))
        best = best[np.r_[True, x[best][1:] != x[best][:-1]]] if len(best) else best
        new_up = np.round(gain[best] - at_home[x[best]], 9)
        best, new_up = best[new_up > 0], new_up[new_up > 0]
        new_q = np.round(part.sum(), 9)
        if q is None or new_q > q:
            com, q, one_in = trial, new_q, max(one_in // 2, 2)
            to, up = np.full(n, -1), np.zeros(n)
            to[x[best]], up[x[best]] = c[best], new_up
        else:
            one_in *= 2
        moves = np.flatnonzero(to >= 0)
        if not len(moves) or one_in >= 16:
            return com
        ranked = moves[np.lexsort((moves, -up[moves]))][::-1]
        first = np.full(n, -1)
        both = np.concatenate([com[ranked], to[ranked]])
        order = np.argsort(np.tile(np.arange(len(ranked)), 2), kind="stable")  # the best move comes last and stays
        first[both[order]] = np.tile(ranked, 2)[order]
        going = (first[com[moves]] == moves) & (first[to[moves]] == moves)
        if one_in <= 4:
            going |= _draw(seeds[moves], number) % np.uint64(one_in) == 0
        trial = com.copy()
        trial[moves[going]] = to[moves[going]]
        number += 1


def _whole_group(resolution: float):
    """All levels of a group whose edges fit in a task."""

    def run(table: pa.Table) -> pa.Table:
        names = pc.unique(table["s"])
        names = names.take(pc.sort_indices(names))  # numbers in the order of uuids
        s, d = (pc.index_in(table[c], value_set=names).to_numpy().astype(np.int64) for c in ("s", "d"))
        seeds = np.zeros(len(names), np.uint64)
        seeds[s] = table["seed"].to_numpy().view(np.uint64)
        w, place = table["w"].to_numpy(), np.arange(len(names))
        while True:
            moved = _settled(s, d, w, seeds, resolution)
            if (moved == np.arange(len(names))).all():
                break
            place = moved[place]
            s, d, w = _summed(moved[s], moved[d], w)
        return pa.table({"group_id": table["group_id"].slice(0, 1).take(pa.array(np.zeros(len(names), np.int64))), "uuid": names, "to": names.take(pa.array(place))})

    return run


def louvain(weights: DataFrame, nodes: DataFrame, resolution: float = 1.0, whole: int = WHOLE) -> DataFrame:
    """(group_id, uuid, community_id) of weights (group_id, lo, hi, weight) and nodes (group_id, uuid).

    Communities of each group are numbered from 0 by size, then smallest member; isolated nodes are their
    own. Groups of fewer than two nodes get none. Levels go on until no community merges, moves within a
    level until none gains. A group of more than `whole` edges, both ways, is moved by joins and aggregations,
    level by level until its communities have fewer edges; then, or at once, all its rounds are the same
    ones in a task. Results depend neither on the order of rows nor on `whole`.
    """
    pairs = weights.select("group_id", F.col("lo").alias("s"), F.col("hi").alias("d"), F.col("weight").cast("double").alias("w"))
    edges = cut_lineage(pairs.unionByName(pairs.select("group_id", F.col("d").alias("s"), F.col("s").alias("d"), "w")))
    place = cut_lineage(nodes.select("group_id", "uuid").distinct().withColumn("com", F.col("uuid")))
    while True:
        large = cut_lineage(edges.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("group_id"))
        fitting = edges.join(F.broadcast(large), "group_id", "left_anti").withColumn("seed", F.xxhash64("group_id", "s"))  # one row a group
        settled = fitting.groupBy("group_id").applyInArrow(_whole_group(resolution), "group_id string, uuid string, to string")
        place = cut_lineage(place.join(settled.withColumnRenamed("uuid", "com"), ["group_id", "com"], "left").select("group_id", "uuid", F.coalesce("to", "com").alias("com")))
        if large.isEmpty():
            break
        edges = edges.join(F.broadcast(large), "group_id", "left_semi")
        moved = cut_lineage(_local_moves(edges, resolution))
        if moved.where("node <> com").isEmpty():
            break
        place = cut_lineage(place.join(moved.select("group_id", F.col("node").alias("com"), F.col("com").alias("up")), ["group_id", "com"], "left").select("group_id", "uuid", F.coalesce("up", "com").alias("com")))
        a, b = moved.select("group_id", F.col("node").alias("s"), F.col("com").alias("x")), moved.select("group_id", F.col("node").alias("d"), F.col("com").alias("y"))
        edges = cut_lineage(edges.join(a, ["group_id", "s"]).join(b, ["group_id", "d"]).groupBy("group_id", F.col("x").alias("s"), F.col("y").alias("d")).agg(F.sum("w").alias("w")))
    sizes = place.groupBy("group_id", "com").agg(F.count("*").alias("n"), F.min("uuid").alias("first"))
    big = nodes.select("group_id", "uuid").distinct().groupBy("group_id").agg(F.count("*").alias("n_nodes")).where("n_nodes >= 2").select("group_id")
    number = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "first")) - 1
    numbered = sizes.join(big, "group_id", "left_semi").withColumn("community_id", number)
    return place.join(numbered, ["group_id", "com"]).select("group_id", "uuid", "community_id")


def modularity(weights: DataFrame, assigned: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(group_id, modularity) of communities on a weighted graph."""
    a, b = assigned.select("group_id", F.col("uuid").alias("lo"), F.col("community_id").alias("x")), assigned.select("group_id", F.col("uuid").alias("hi"), F.col("community_id").alias("y"))
    e = weights.join(a, ["group_id", "lo"]).join(b, ["group_id", "hi"])
    total = e.groupBy("group_id").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = e.select("group_id", F.col("x").alias("c"), "weight").unionByName(e.select("group_id", F.col("y").alias("c"), "weight"))
    degree = ends.groupBy("group_id", "c").agg(F.sum("weight").alias("k"))
    squares = degree.groupBy("group_id").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.join(squares, "group_id").select("group_id", (F.col("inside") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def listing(entities: DataFrame, reports: DataFrame, least_members: int = 2) -> DataFrame:
    """(group_id, community_id, size, members, report): members by name; reports join on community and group."""
    own = entities.where("community_id >= 0").groupBy("group_id", "community_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("name")).alias("members"))
    joined = own.join(reports.select("group_id", "community_id", "report"), ["group_id", "community_id"], "left")
    return joined.withColumn("report", F.coalesce("report", F.lit(""))).where(F.col("size") >= least_members)


def report_inputs(entities: DataFrame, edges: DataFrame, least_people: int = 3, facts: int = 5) -> DataFrame:
    """(group_id, community_id, people, names, facts) of communities with enough members of type Person.

    names are all members' names in order; facts are the first `facts` by seq of edges that touch a member.
    """
    own = entities.where("community_id >= 0").select("group_id", "community_id", "uuid", "name", "entity_type")
    people = own.groupBy("group_id", "community_id").agg(F.count_if(F.col("entity_type") == "Person").alias("people"), F.array_sort(F.collect_list("name")).alias("names")).where(F.col("people") >= least_people)
    member = own.join(people.select("group_id", "community_id"), ["group_id", "community_id"], "left_semi").select("group_id", "community_id", F.col("uuid").alias("_end"))
    ends = edges.where("fact IS NOT NULL AND fact <> ''").select("group_id", "seq", "uuid", "fact", F.explode(F.array("source_uuid", "target_uuid")).alias("_end"))
    touching = ends.join(member, ["group_id", "_end"]).select("group_id", "community_id", "seq", "uuid", "fact").distinct()
    first = touching.withColumn("_n", F.row_number().over(Window.partitionBy("group_id", "community_id").orderBy("seq", "uuid"))).where(F.col("_n") <= facts)
    key = first.groupBy("group_id", "community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "fact"))), lambda x: x["fact"]).alias("facts"))
    return people.join(key, ["group_id", "community_id"], "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))


def reports(inputs: DataFrame) -> DataFrame:
    """(group_id, community_id, report) of inputs with a fact: the names, then the facts."""
    text = F.concat(F.lit("People: "), F.array_join("names", ", "), F.lit(". Key facts: "), F.array_join("facts", " "))
    return inputs.where(F.size("facts") > 0).select("group_id", "community_id", text.alias("report"))


def reports_of(stored: DataFrame, group_id: str, ids: list[int]) -> DataFrame:
    return stored.where((F.col("group_id") == group_id) & F.col("community_id").isin(ids) & (F.col("report") != "")).select("community_id", "report")


def community_of(entities: DataFrame) -> DataFrame:
    """(group_id, uuid, community_id), -1 for none."""
    return entities.select("group_id", "uuid", F.coalesce("community_id", F.lit(-1)).alias("community_id"))


def neighbour_graph(vectors: DataFrame, cached: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(group_id, source_uuid, target_uuid, n_vectors): the mutual nearest neighbours of vectors (group_id, id, embedding).

    Groups of which cached, an earlier result, has as many vectors are taken from it, the others are searched
    again and replace it.
    """
    sizes = cut_lineage(vectors.groupBy("group_id").agg(F.count("*").alias("n_vectors")))
    if cached is not None:
        fresh = cached.select("group_id", "n_vectors").distinct().join(sizes, ["group_id", "n_vectors"], "left_semi").select("group_id")
        vectors = vectors.join(fresh, "group_id", "left_anti")
    pairs = similarity.mutual_edges(cut_lineage(similarity.nearest_neighbours(vectors, k))).join(sizes, "group_id")
    return pairs if cached is None else folds.replace_group(cached.join(fresh, "group_id", "left_semi"), pairs)


def neighbour_communities(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(curvatures, communities) of a graph (group_id, source_uuid, target_uuid): communities are found with
    the curvature of its edges as weights."""
    simple = cut_lineage(pairs.select("group_id", F.col("source_uuid").alias("lo"), F.col("target_uuid").alias("hi")))
    curved = cut_lineage(curvature.curvatures(simple))
    nodes = simple.select("group_id", F.explode(F.array("lo", "hi")).alias("uuid")).distinct()
    return curved, louvain(curvature.weights(curved), nodes)
