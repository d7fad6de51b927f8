import itertools
import random
import string
import time

import duckdb  # noqa: F401
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import automata, leaks, markup, matches, names, neighbours, packing, scans, subjects, survivors

ENTITY = "seq bigint, uuid string, name string, entity_type string, group_id string, created_at timestamp, embedding array<float>, description string, a string, v string"
MATCH = "uuid_a string, uuid_b string, score double, created_at timestamp, uuid string, embedding array<float>"


def vec(*head, n=32):
    return [float(x) for x in head] + [0.0] * (n - len(head))


def entity(uuid, name="x", kind="person", group="g", at=None, v=None, text=None, seq=1):
    return (seq, uuid, name, kind, group, at, v, text, "clash", "clash")


def groups_by_union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("hops", [12, 1])
def test_groups_against_union_find(spark, hops):
    rng = random.Random(5)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"s{i:02}") for i in range(40)]
    pairs += [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(45)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + pairs[:9], "a string, b string")
    got = {r.uuid: r.group_uuid for r in matches.connected_groups(df, hops).collect()}
    assert got == groups_by_union_find([p for p in pairs if p[0] != p[1]])


def test_peel_takes_the_giant_component(spark):
    giant = [(0, i) for i in range(1, 50)] + [(i, i + 100) for i in range(1, 50)]
    small = [(1000 + 2 * i, 1001 + 2 * i) for i in range(20)]
    edges = spark.createDataFrame(giant + small, "s bigint, d bigint")
    rest, level = matches.peel(edges, 12)
    assert {tuple(r) for r in rest.collect()} == set(small) and {tuple(r) for r in level.collect()} == {(v, 0) for e in giant for v in e}
    rest, level = matches.peel(spark.createDataFrame([(i, i + 1) for i in range(20)], "s bigint, d bigint"), 3)
    assert level.count() == 5 and rest.count() == 16  # from 1, which is the first of degree two


def test_which_matches_count(spark):
    entities = spark.createDataFrame([entity(u, v=v) for u, v in {"a": vec(1), "b": vec(1, 0.1), "c": vec(0, 1), "d": None, "e": vec(1), "f": vec(1), "z": [1.0]}.items()] + [entity("a", v=vec(1), seq=9), entity(None)], ENTITY)
    rows = [("a", "b", None), ("c", "a", None), ("d", "a", None), ("e", "f", 0.9), ("f", "e", 0.1), ("e", "e", 1.0), ("e", "gone", 1.0), (None, "a", 1.0), ("c", "d", float("nan")), ("z", "a", None), ("c", "e", 0.89)]
    table = spark.createDataFrame([(*r, None, "u", None) for r in rows], MATCH)
    assert {tuple(r) for r in matches.accepted_pairs(table, entities).collect()} == {("a", "b"), ("e", "f")}
    assert {tuple(r) for r in matches.match_groups(table, entities).collect()} == {("a", "a"), ("a", "b"), ("e", "e"), ("e", "f")}
    assert matches.match_groups(table.limit(0), entities).count() == 0
    assert matches.match_groups(table, entities.limit(0)).count() == 0


LISTED = ("time", "uuid", "learned")


def test_survivors(spark):
    ts = lambda s: pd.Timestamp(s).to_pydatetime()
    rows = [
        entity("a", "Old", "Person", at=ts("2020-01-01"), text="first"), entity("b", " N/A ", "unknown", at=ts("2022-01-01"), text="second"),
        entity("c", "New", None, at=None, text=None), entity("d", "B", "t", at=None, text=""), entity("e", "A", "t", at=None, text="(no value)"),
        entity("f", "A", "t", at=ts("2020-01-01")), entity("g", "B", "t", at=ts("2021-01-01")),
    ]
    entities = spark.createDataFrame(rows + rows, ENTITY)
    groups = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e"), ("f", "f"), ("f", "g")], "group_uuid string, uuid string")
    got = {(r.group_uuid, r.field): r.uuid for r in survivors.field_sources(groups, entities, trust=LISTED).collect()}
    assert got == {("a", "name"): "a", ("a", "description"): "b", ("a", "entity_type"): "a", ("d", "name"): "d", ("d", "entity_type"): "d", ("f", "name"): "g", ("f", "entity_type"): "g"}
    # The dated group f teaches that B follows A; the undated group d holds both.
    assert {tuple(r) for r in survivors.learn_transitions(survivors.group_members(groups, entities)).collect()} == {("name", "a", "b"), ("description", "first", "second")}
    swapped = groups.where("group_uuid <> 'd'").unionByName(spark.createDataFrame([("d", "d"), ("d", "e")], "group_uuid string, uuid string"))
    chosen = {(r.group_uuid, r.field): r.uuid for r in survivors.field_sources(swapped, entities).collect()}
    assert chosen[("d", "name")] == "d"
    record = {r.group_uuid: r for r in survivors.surviving_records(groups, entities).collect()}
    assert (record["a"]["name"], record["a"].description, record["d"].description) == ("Old", "second", None)
    assert survivors.field_sources(groups.limit(0), entities, trust=LISTED).count() == 0
    assert survivors.field_sources(groups, entities.limit(0)).count() == 0


def test_currency_prefers_the_later_value(spark):
    ts = lambda s: pd.Timestamp(s).to_pydatetime()
    rows = [entity("a", "late", at=ts("2021-01-01")), entity("b", "early", at=ts("2020-01-01")), entity("c", "early"), entity("d", "late")]
    groups = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")], "group_uuid string, uuid string")
    got = {(r.group_uuid, r.field): r.uuid for r in survivors.field_sources(groups, spark.createDataFrame(rows, ENTITY)).collect()}
    assert got[("c", "name")] == "d"


def test_learned_order_over_steps_and_cycles(spark):
    steps = spark.createDataFrame([("name", a, b) for a, b in ["pq", "qr", "xy", "yz", "zx", "zw"]], "field string, earlier string, later string")
    tied = [("g1", "p", "1"), ("g1", "r", "2"), ("g2", "x", "2"), ("g2", "z", "1"), ("g3", "x", "1"), ("g3", "w", "2"), ("g4", "o", "2"), ("g4", "p", "1"), ("g5", "q", "3"), ("g5", "r", "4"), ("g5", "w", "9")]
    df = spark.createDataFrame([(g, "name", v, u) for g, v, u in tied], "group_uuid string, field string, value string, uuid string")
    got = {r.group_uuid: r.uuid for r in survivors.topological_latest(df, steps).collect()}
    # r follows p over q; x and z form a cycle; w follows the cycle; o and p, r and w are not ordered.
    assert got == {"g1": "2", "g2": "1", "g3": "2", "g4": "1", "g5": "4"}
    assert survivors.topological_latest(df.limit(0), steps).count() == 0 and survivors.topological_latest(df, steps.limit(0)).count() == 5


def test_listed_order_has_the_learned_edges_that_agree(spark, monkeypatch):
    steps = spark.createDataFrame([("name", a, b) for a, b in ["pq", "qr", "xy", "yx"]], "field string, earlier string, later string")
    tied = [("g1", "p", "1"), ("g1", "r", "2"), ("g2", "p", "4"), ("g2", "r", "3"), ("g2", "o", "5"), ("g3", "x", "6"), ("g3", "y", "7"), ("g4", "p", "8")]
    df = spark.createDataFrame([(g, "name", v, u) for g, v, u in tied], "group_uuid string, field string, value string, uuid string")
    edges = {(r.group_uuid, r.value, r.later, r.source) for r in survivors.currency_edges(df, steps, LISTED).collect()}
    # That r follows p contradicts the uuids of g1 and agrees with those of g2; x and y form a cycle.
    assert edges == {("g1", "r", "p", "uuid"), ("g2", "p", "r", "learned"), ("g2", "p", "r", "uuid"), ("g2", "o", "r", "uuid"), ("g3", "y", "x", "uuid")}
    assert {r.group_uuid: r.uuid for r in survivors.topological_latest(df, steps, LISTED).collect()} == {"g1": "1", "g2": "3", "g3": "6", "g4": "8"}
    edges = {(r.group_uuid, r.value, r.later, r.source) for r in survivors.currency_edges(df, steps).collect()}
    assert edges == {("g1", "p", "r", "learned"), ("g2", "p", "r", "learned"), ("g2", "o", "r", "uuid"), ("g3", "y", "x", "uuid")}
    # The listed order is learned and read off too.
    learnt, learn = [], survivors.learn_transitions
    monkeypatch.setattr(survivors, "learn_transitions", lambda *a: learnt.append(learn(*a)) or learnt[-1])
    ts = lambda s: pd.Timestamp(s).to_pydatetime()
    rows = [entity("a", "late", at=ts("2021-01-01")), entity("b", "early", at=ts("2020-01-01")), entity("c", "early"), entity("d", "late")]
    groups = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")], "group_uuid string, uuid string")
    got = {(r.group_uuid, r.field): r.uuid for r in survivors.field_sources(groups, spark.createDataFrame(rows, ENTITY), trust=LISTED).collect()}
    assert (got[("a", "name")], got[("c", "name")]) == ("a", "c") and {tuple(r) for r in learnt[0].collect()} == {("name", "early", "late")}


def test_values_are_made_plain_once(spark, monkeypatch):
    calls, make = [], survivors.plain_values
    monkeypatch.setattr(survivors, "plain_values", lambda *a: calls.append(a) or make(*a))
    ts = lambda s: pd.Timestamp(s).to_pydatetime()
    rows = [entity(f"{i:03}", None if 5 < i < 90 else "a" if i < 50 else "b", "t", at=ts("2020-01-01") + pd.Timedelta(days=i), text="x" if i % 2 else "y") for i in range(100)]
    rows += [entity("u", "\u00a0N /\tA ", "unknown" + "\t" * 40, at=ts("2022-01-01"), text="A  long text \n of more than the letters of a stand-in")]
    entities = spark.createDataFrame(rows, ENTITY)
    groups = entities.select(F.lit("000").alias("group_uuid"), "uuid")
    got = {(r.group_uuid, r.field): r.uuid for r in survivors.field_sources(groups, entities, trust=LISTED).collect()}
    assert got == {("000", "name"): "099", ("000", "entity_type"): "099", ("000", "description"): "u"} and len(calls) == 1
    # One group over all partitions, of which those between hold no name: b follows a over them.
    spread = survivors.learn_transitions(survivors.group_members(groups, entities).repartition(8)).collect()
    assert {tuple(r) for r in spread} == {("name", "a", "b"), ("description", "y", "x"), ("description", "x", "a long text of more than the letters of a stand-in")}


LINES = {
    "The compiler was deployed before anyone looked at the sched-": "broken_word",
    "uler.": None,
    "BAPOSADROX ANNUAL REPORT    199": "running_head",
    "Most questions about the unit test come back to tbe endpoint": "misread",
    "- 231 -": "page_number",
    "xviii": "page_number",
    "and the newer code is a self-": None,
    "made one. It took 17 weeks until the compiler was un†il done.": "misread",
}


def test_scans(spark):
    words = "the compiler was deployed before anyone looked at scheduler most questions about unit test come back to endpoint and newer code is one it took weeks until done a self made"
    clean = [(1, f"n{i}", f"{words}. {words}", "notes/x.md", "c") for i in range(20)]
    scanned = [(1, f"s{i}", "\n".join(LINES), f"scans/baposadrox_{i}.pdf", "c") for i in range(3)]
    odd = [(1, "e1", "", "scans/a_1.pdf", "c"), (1, "e2", None, "scans/a_2.pdf", "c"), (1, "e3", "word " * 40_000, "scans/a_3.pdf", "c"), (1, None, "x", None, "c"), (1, "e4", "\n\n-\n", None, "c")]
    episodes = spark.createDataFrame(clean + scanned + scanned[:1] + odd, "seq bigint, uuid string, content string, source string, heads string")
    got = {(r.uuid, r.line_no): r.kind for r in scans.scan_lines(episodes).collect()}
    wanted = {(f"s{i}", n): kind for i in range(3) for n, kind in enumerate(LINES.values()) if kind}
    assert got == wanted
    text = {r.uuid: r.text for r in scans.repaired_scans(episodes).collect()}["s0"]
    assert "scheduler." in text and "the endpoint" in text and "ANNUAL" not in text and "231" not in text and "until done" in text and "\n" not in text
    assert scans.scan_lines(episodes.limit(0)).count() == 0


def test_confusions_are_complete():
    vocabulary = {"modern": 5, "thread": 5, "before": 5, "window": 5, "clear": 5}
    trie = automata.build_trie(vocabulary)
    for word in vocabulary:
        for at, (printed, read) in itertools.product(range(len(word)), scans.CONFUSIONS):
            if word.startswith(printed, at):
                wrong = word[:at] + read + word[at + len(printed) :]
                if wrong not in vocabulary:
                    assert word in {w for w, _, _ in scans.confusable(trie, wrong)}, (word, wrong)


def test_candidates_meet_in_shards():
    rng = random.Random(7)
    vocabulary = sorted({"".join(rng.choice("acdehilmnrstuvw") for _ in range(rng.randrange(3, 11))) for _ in range(300)})
    trie = automata.build_trie(vocabulary)
    asked = set()
    for word in vocabulary[:25]:
        at, c = rng.randrange(len(word)), rng.choice("aeinrst")
        asked |= {word[:at] + c + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + word[at : at + 2][::-1] + word[at + 2 :]}
        for printed, read in scans.CONFUSIONS:
            wrong = word.replace(printed, read, 1)
            asked |= {wrong} | {wrong.replace(p, r, 1) for p, r in scans.CONFUSIONS if p in wrong}
    for wrong in sorted(w for w in asked if len(w) >= 3):
        for found, _, _ in scans.candidates(trie, wrong):
            assert set(scans.entry_keys(found)) & set(scans.query_keys(wrong)), (found, wrong)
        assert {w for w, tier, _ in scans.candidates(trie, wrong)} >= {w for w in vocabulary if 0 < edits(w, wrong) <= 1}


def test_neighbours_decide(spark):
    clean = [("say hello to the world", False)] * 3 + [("the house is near the river", False)] * 3 + [("the horse is fed", False)] * 9 + [("near the helm", False)] * 9
    scanned = [("say heljo to the wotld", True), ("the hovse is near", True)]
    records = spark.createDataFrame([(f"u{i}", t, s) for i, (t, s) in enumerate(clean + scanned)], "uuid string, content string, scanned boolean")
    asked = spark.createDataFrame([(w, False) for w in ("heljo", "wotld", "hovse", "helo")], "word string, cap boolean")
    contexts = spark.createDataFrame([("heljo", "say", "to"), ("wotld", "the", None), ("hovse", "the", "is"), ("helo", "x", "y")], "word string, before string, after string")
    got = {r.word: r.fix for r in scans.judge_words(asked, contexts, scans.vocabulary(records), records, scans.Sizes(records), {}).collect()}
    # Without two known neighbours an edit that is no confusion does not count; of house and horse the more frequent fits both.
    assert got == {"heljo": "hello", "wotld": None, "hovse": "horse", "helo": None}


def edits(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_trie_against_brute_force(spark):
    rng = random.Random(3)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(150)})
    trie = automata.build_trie(words)
    for w, most in itertools.product(words[:40], (1, 2, 3)):
        assert dict(automata.search(trie, w, most)) == {x: edits(w, x) for x in words if edits(w, x) <= most}
    cores = spark.createDataFrame([("g", "k", w) for w in words], "group_id string, kind string, core string")
    got = {(r.core, r.other) for r in names.trie_join(cores, shard_names=20).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and edits(a, b) <= 1}


def test_names(spark):
    rows = {
        "a": "Margaret Dedregazer", "b": "Dedregazer, Peggy", "c": "M. Dedregazer", "d": "MARGARET\u00a0 DEDREGAZER", "e": "Margaaret Dedregzaer", "f": "Rebecca Dedregazer",
        "h": "Mr Hebutradren", "i": "Hebutradren", "k": "unknown", "l": "", "m": None, "n": "thermal telescope", "o": "Rebecca Hebutradren",
    }
    entities = [entity(u, n, "person") for u, n in rows.items()] + [entity("x1", "Hotonebur Associates Corp", "ORG"), entity("x2", "Associates, Hotonebur", None), entity("x3", "Hotonébur Assoc. Corporation", "company"), entity("x4", "Hotonebur Foods Corp", "company"), entity("z1", "Margaret Dedregazer", "person", "other"), entity("z2", "Zero " * 5000, "person"), entity("z3", "Peggy Dedregazer", "person", None)]
    df = spark.createDataFrame(entities + entities[:2], ENTITY)
    got = {tuple(r) for r in names.name_pairs(df).collect()}
    same = [("a", "b", "d", "e"), ("h", "i", "o"), ("x1", "x2", "x3")]
    assert got == {p for s in same for p in itertools.combinations(s, 2)} | {(x, "c") for x in ("a", "b")} | {("c", "d"), ("c", "e")}
    assert names.name_pairs(df.limit(0)).count() == 0


def test_names_with_an_edit_that_doubles_a_letter(spark):
    sets = [("Wilhelmina Veretopex", "Wilhelmina Veetopex"), ("Thomas Gavetalam", "Thomas Gavetaam"), ("Mina Lepovovot", "Mina Lepovvoot"), ("Robert Daphelor", "Robert Dapehlor"), ("Hettie Tredrirogax", "Hettie Tredrrogax")]
    df = spark.createDataFrame([entity(f"{i}{j}", n) for i, s in enumerate(sets) for j, n in enumerate(s)] + [entity("far", "Thomas Gavetimor")], ENTITY)
    assert {tuple(r) for r in names.name_pairs(df).collect()} == {(f"{i}0", f"{i}1") for i in range(len(sets))}


def test_names_of_several_words_and_unlisted_given_names(spark):
    sets = [
        ("Blue Ridge Foods Inc", "Ridge, Blue Fds", "Blue Rigde Foods Ltd"), ("Procter & Gamble Co", "Gamble and Procter"), ("Ana Maria de la Cruz", "Cruz, Ana", "Ana Cruz"),
        ("Aarav Sharma", "Sharma, Aarav", "Asrav Sharma"), ("Kathrine Vusamamam", "Katherine Vusamamam", "Cathy Vusamamam"), ("Juan Carlos Alberto Perez Gomez", "Juan Gomez"),
        ("Anneliese Okonkwo", "Aneliese Okonkwo"),
    ]
    kinds = {0: "company", 1: "ORG"}
    rows = [entity(f"{i}{j}", n, kinds.get(i, "person")) for i, s in enumerate(sets) for j, n in enumerate(s) if n != "Asrav Sharma"]
    rows += [entity("32", "Asrav Sharma"), entity("33", "Aarav Sharma", None), entity("t1", "Medieval Register", None), entity("t2", "Medieval Register", "?"), entity("b1", "Blue Ridge Logistics", "company")]
    got = {tuple(r) for r in names.name_pairs(spark.createDataFrame(rows, ENTITY)).collect()}
    wanted = [tuple(f"{i}{j}" for j in range(len(s))) for i, s in enumerate(sets)]
    # A given name of under six letters may not differ, and capitalised words are no person by themselves.
    wanted[3] = ("30", "31", "33")
    assert got == {p for s in wanted for p in itertools.combinations(s, 2)}


def test_large_classes_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(names, "CLASS_BLOCK", 3)
    df = spark.createDataFrame([entity(f"{i:02}", "Margaret Dedregazer") for i in range(10)], ENTITY)
    assert sorted(tuple(r) for r in names.name_pairs(df).collect()) == list(itertools.combinations([f"{i:02}" for i in range(10)], 2))


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 32)), rng.normal(size=(500, 32))]).astype(np.float32)
    x[10:14] = x[9]
    rows = [(f"{i:05}", v.tolist(), "q") for i, v in enumerate(x)]
    bad = [("n1", None, "q"), ("n2", [], "q"), ("n3", [0.0] * 32, "q"), ("n4", [float("nan")] * 32, "q"), ("n5", [1.0], "q"), (None, x[0].tolist(), "q")]
    records = spark.createDataFrame(rows + rows[:50] + bad, "uuid string, embedding array<float>, query_id string")
    asked = list(range(0, 2000, 40)) + [9, 10]
    queries = spark.createDataFrame([(i, f"{i:05}") for i in asked] + [(9999, "n1"), (9998, "gone"), (None, "00001")], "query_id bigint, uuid string")
    got = {}
    for r in neighbours.nearest(spark, records, queries, 10).collect():
        got.setdefault(r.query_id, set()).add(r.uuid)
    u = neighbours.unit_rows(x)
    hits = 0
    for i in asked:
        s = np.round(u @ u[i], 9)
        s[i] = -2
        hits += len({f"{j:05}" for j in np.lexsort((np.arange(len(s)), -s))[:10]} & got[i])
        assert len(got[i]) == 10
    assert hits / (10 * len(asked)) >= 0.9 and set(got) == set(asked)
    few = neighbours.nearest(spark, records.where("uuid <= '00004'"), queries.where("query_id = 0"), 10)
    assert {r.uuid for r in few.collect()} == {"00001", "00002", "00003", "00004"}
    assert neighbours.nearest(spark, records.limit(0), queries).count() == 0
    assert neighbours.nearest(spark, records, queries.limit(0)).count() == 0


def test_probes_are_complete():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 32))
    for bits in (64, 40):
        model = neighbours.Codes(x, bits)
        block = neighbours.Block(model, np.arange(len(x)).astype(str).astype(object), x)
        for i, radius in itertools.product(range(0, 3_000, 300), (0, 1, 5, 9, 14, 22, 30)):
            far = np.bitwise_count(block.codes ^ block.codes[i])
            rows = block.probe(block.codes[i : i + 1], radius)
            assert set(np.flatnonzero(far <= radius)) <= set(rows)
    # Codes of close vectors are found in a small part of the rows.
    close = np.repeat(rng.normal(size=(300, 32)), 10, axis=0) + 0.05 * rng.normal(size=(3_000, 32))
    block = neighbours.Block(neighbours.Codes(close), np.arange(3_000).astype(str).astype(object), close)
    assert np.mean([len(block.probe(block.codes[i : i + 1], 8)) for i in range(0, 3_000, 100)]) < 0.05 * 3_000


def test_neighbours_of_evenly_spread_vectors_are_whole(spark):
    x = np.random.default_rng(6).normal(size=(4_000, 32)).astype(np.float32)
    records = spark.createDataFrame([(f"{i:04}", v.tolist()) for i, v in enumerate(x)], "uuid string, embedding array<float>")
    queries = spark.createDataFrame([(i, f"{i:04}") for i in range(400)], "query_id bigint, uuid string")
    s = np.round(neighbours.unit_rows(x[:400]) @ neighbours.unit_rows(x).T, 9)
    s[np.arange(400), np.arange(400)] = -2
    wanted = {(i, f"{j:04}") for i in range(400) for j in np.lexsort((np.arange(4_000), -s[i]))[:10]}
    assert {(r.query_id, r.uuid) for r in neighbours.nearest(spark, records, queries, 10).collect()} == wanted


def test_search_of_a_block_costs_little_more_than_its_products():
    rng = np.random.default_rng(8)
    even = rng.normal(size=(40_000, 32))
    close = np.repeat(rng.normal(size=(400, 32)), 100, axis=0) + 0.1 * rng.normal(size=even.shape)
    uuids, asked = np.array([f"{i:05}" for i in range(40_000)], object), np.arange(0, 40_000, 100)
    for x in (even, close):
        model = neighbours.Codes(x[::4])
        block = neighbours.Block(model, uuids, x)
        unit = neighbours.unit_rows(x)
        began = time.process_time()
        s = unit[asked] @ unit.T
        order = np.argpartition(-s, 11)[:, :11]
        products = time.process_time() - began
        floors = np.partition(unit[asked] @ unit[::4].T, -11)[:, -11]
        began = time.process_time()
        ids, rows, _ = block.best(asked, uuids[asked], unit[asked], model.encode(x[asked]), 10, floors)
        assert time.process_time() - began < products
        found = set(zip(ids.tolist(), rows.tolist(), strict=True))
        true = {(int(i), int(j)) for i, found_rows in zip(asked, order, strict=True) for j in found_rows if i != j}
        assert len(true & found) > 0.995 * len(true)
        # Queries found by buckets get the same rows and cosines as those compared with all rows.
        some = [i for i, f in enumerate(floors) if block.pays(model.within(f))]
        assert x is even or some


PAGE = """<html><body><div id=nav><a href=x>one</a> <a href=y>two</a> <a href=z>three</a></div>
<div><h2>Title</h2><p>Body text that runs on for a while so that it is dense with characters and few tags.</p><p>More of the body.</p></div></body></html>"""
CASES = [
    ("== Head ==\ntext", {("wiki", "heading")}), ("* [[one]]\n* [[two]]", {("wiki", "list")}), ("{{math|x^2}} here", {("wiki", "formula")}), ("{| class=t\n! a !! b\n|-\n| 1 || 2\n|}", {("wiki", "table")}),
    ("{{code|lang=x|1=\nSELECT a\nFROM b\n}}", {("wiki", "code")}), ("see [[Note|it]]", {("wiki", "none")}), ("## Head\ntext", {("markdown", "heading")}), ("Head\n======\ntext", {("markdown", "heading")}),
    ("- [x] one\n- two", {("markdown", "list")}), ("```py\nx = [1]\n```", {("markdown", "code")}), ("```math\nu^7\n```", {("markdown", "formula")}), ("hence $`z^3 = c`$ here", {("markdown", "formula")}),
    ("| a | b |\n|:---|---:|\n| 1 | 2 |", {("markdown", "table")}), ("a **bold** word", {("markdown", "none")}), ("a [link](x.md) to", {("markdown", "none")}), ("\\section{A} text", {("latex", "heading")}),
    ("\\begin{itemize}\n\\item a\n\\end{itemize}", {("latex", "list")}), ("\\begin{verbatim}\n# x\n\\end{verbatim}", {("latex", "code")}), ("\\[ x_1 \\leq k \\]", {("latex", "formula")}), ("\\begin{tabular}{lr}\na & 1 \\\\\n\\end{tabular}", {("latex", "table")}),
    ("we \\textbf{do} it~\\cite{a}", {("latex", "none")}), ("<h3 id='s'>A</h3> b", {("html", "heading")}), ("<ul><li>a\n<li>b</ul>", {("html", "list")}), ("<pre><code>x &lt; [1]</code></pre>", {("html", "code")}),
    ("<math><mi>x</mi></math>", {("html", "formula")}), ("<table border=0><tr><td>a</td></tr></table>", {("html", "table")}), ("a<br> b&nbsp;c", {("html", "none")}), (PAGE, {("html", "heading")}),
    ("It costs $12 to $18 per seat.", set()), ("Path C:\\data\\user_id holds it.", set()), ("The area is 17 * 7 * 2 units.", set()), ("--> call back, x^2 is only a label.", set()), ("while b < k and c > 23.", set()),
    ("Rated 4/5 (40 votes) | closed.", set()), ("Ported from C# to F# on day 46.", set()), ("# load\ndef f(x):\n    return [y for y in x]\nfor (int i = 0; i < 7; i++) {\n  g(i);\n}", set()), ("", set()), (None, set()), ("[08 January 2023]\nA: hi.\nB: no.", set()),
]


@pytest.mark.parametrize("text, wanted", CASES)
def test_markup(text, wanted):
    assert markup.scan_markup(text)[0] == wanted


def test_markup_operator(spark):
    rows = [(1, f"u{i}", t, "h") for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3] + [(1, "long", "<p>" + "text " * 60_000, "h"), (1, None, "<b>x</b>", "h"), (1, "open", "<div><ul><li>" * 300, "h")], "seq bigint, uuid string, content string, markup string")
    got = markup.markup_elements(df)
    assert got.count() == sum(len(w) for _, w in CASES) + 2
    texts = {r.uuid: r.text for r in markup.clean_markup(df).collect()}
    page = next(f"u{i}" for i, (t, _) in enumerate(CASES) if t is PAGE)
    assert "Body text" in texts[page] and "Title" in texts[page]
    assert markup.markup_elements(df.limit(0)).count() == 0


def test_density_prefers_text_to_links():
    root = markup.parse_html(PAGE)
    body = "".join(markup.render(n) for n in markup.body_nodes(root))
    assert "Body text" in body and "three" not in body


def test_blocks_in_thin_nodes_are_kept():
    body = "".join(f"<p>{'word ' * 80}</p>" for _ in range(5))
    for block, clean in (("<h2>Top</h2><table><tr><td>cell</td></tr></table>", ("## Top", "| cell |")), ("<ul><li>item</li></ul>", ("- item",)), ("<pre>x = 1</pre>", ("x = 1",)), ("<section><math><mi>y</mi></math></section>", ("$y$",))):
        text = markup.scan_markup(f"<html><body><div><a href=x>one</a></div><div>{block}</div><div>{body}</div></body></html>")[1]
        assert all(c in text for c in clean) and "word word" in text and "one" not in text
    table = f"<table>{'<tr><td>' + 'cell ' * 400 + '</td></tr>'}</table>"
    root = markup.parse_html("<div>\ue0000\ue001</div><p>short</p>", [markup.Block("html", "table", table, "x")])
    block = root.children[0].children[0]
    assert (block.block, block.tags, block.chars, root.children[0].chars) == (0, 3, 1999, 1999) and "cell cell" in markup.scan_markup(f"<div>{table}</div><p>short</p>")[1]


def test_elements_come_from_the_body():
    root = markup.parse_html("x \ue0001\ue001", [markup.Block("wiki", "code", "s", "c"), markup.Block("markdown", "list", "s", "- \ue0000\ue001")], False)
    assert [n.block for n in markup._below(root)] == [-1, 1, 0] and root.holds and root.chars == 3
    deep = "<div>" * 3_000 + "text of the page" + "</div>" * 3_000
    assert markup.scan_markup(deep) == ({("html", "none")}, "text of the page")
    assert markup.scan_markup("so $" + "a + b + " * 30 + "c$ holds")[0] == {("latex", "formula")}
    nested = "\\textbf{a \\emph{b \\texttt{c \\textit{d \\textsc{e}}}}}"
    assert markup.scan_markup(nested)[1] == "a b c d e"


def test_packing(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 90) for _ in range(600)] + [512, 100, 200, 1000, 0]
    counts = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(None, 5), (10_000, None)], "doc_id bigint, n_tokens bigint")
    windows = spark.createDataFrame([(1, 100), (2, 512), (3, 0), (None, None), (1, 100)], "window_id int, n_tokens int")
    for shard in (250_000, 100):
        rows = packing.pack_documents(counts, windows, shard).toPandas()
        assert set(rows.window_id) == {1, 2}
        for _, own in rows.groupby("window_id"):
            capacity = own.capacity.iloc[0]
            assert own.groupby("doc_id").n_tokens.sum().to_dict() == {i: s for i, s in enumerate(sizes) if s}
            assert own.groupby("window").n_tokens.sum().max() <= capacity
            split = own.groupby("doc_id").size()
            assert all(sizes[i] > capacity for i in split[split > 1].index)
            for _, w in own.groupby("window"):
                at = 0
                for r in w.sort_values("offset").itertuples():
                    assert r.offset >= at
                    at = r.offset + r.n_tokens
                assert at <= capacity
        room = packing.room_left(packing.pack_documents(counts, windows, shard)).collect()
        assert all(r.room == r.n_windows * r.capacity - r.n_tokens and r.n_windows <= 1.1 * r.n_tokens / r.capacity + 2 for r in room)
    assert packing.pack_documents(counts.limit(0), windows).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world", "s"), (2, "", "s"), (3, None, "s"), (4, "word " * 30_000, "s"), (1, "hello world", "s"), (None, "x", "s")], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 30_000 and len(got) == 4


def test_index_against_search():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(2, 6, 3000), [1], np.tile([2, 3, 4, 5, 2, 2, 3, 3, 4], 20), [1] * 40, np.full(300, 3)])
    built = leaks.Index(text)
    phrases = np.array([text[i : i + 6] for i in range(0, 2990, 7)] + [[5, 5, 5, 5, 5, 5], [3] * 6])
    for index in (built, leaks.Index.unpack(**built.pack())):
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 5) if (text[i : i + 6] == p).all()]
    order = leaks.suffix_order(text).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_short_questions_with_a_change(spark):
    words = [f"word{chr(97 + i)}" for i in range(15)]
    items = spark.createDataFrame([(1, None, " ".join(words[:12])), (2, None, " ".join(words[:5]))], "item_id bigint, passage string, question string")
    docs = [(1, words[:6] + ["changed"] + words[7:12]), (2, words[:6] + ["put"] + words[6:12]), (3, words[:2] + ["x"] + words[3:5]), (4, words[:5]), (5, words[:4] + ["x"] + words[5:9] + ["y"] + words[10:12])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.leaked_items(df, items).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 4)}
    # The stored index gives the same, whatever the blocks of items and the size of shards.
    index = spark.createDataFrame(leaks.index_shards(df.coalesce(1), 20).collect(), leaks.INDEX)
    assert index.count() > 1 and {tuple(r)[:2] for r in leaks.search_index(index, items, item_block=1).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 4)}


def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    passages = [[word() for _ in range(60)] for _ in range(4)]
    asks = [[word() for _ in range(18)] for _ in range(4)]
    opening = "Read it and answer with a short phrase taken from the text only. "
    items = spark.createDataFrame([(i, "s", " ".join(p), (opening if i != 3 else "") + " ".join(q) + "?", None, 1, "d") for i, (p, q) in enumerate(zip(passages, asks, strict=True))] + [(9, None, None, None, None, None, "d")], "item_id bigint, sample_id string, passage string, question string, answer string, category int, doc_id string")
    noise = lambda n: [word() for _ in range(n)]
    p = passages[0]
    changed = p[10:20] + ["changed"] + p[21:35]
    inserted = p[10:22] + ["put"] + p[22:34] + ["in"] + p[34:44]
    docs = {
        1: " ".join(noise(20) + p[10:32] + noise(20)), 2: " ".join(noise(20) + p[10:25] + noise(20)), 3: " ".join(noise(5) + changed + noise(5)), 4: " ".join(noise(5) + inserted + noise(5)),
        5: ",\n> ".join(p[5:40]).upper(), 6: " ".join(p).replace("a", "\u0430").replace("e", "e\u00ad"), 7: opening + " ".join(noise(30)), 8: "x " + " ".join(asks[1]), 9: " ".join(asks[1][:15]),
        10: "", 11: None, 12: " ".join(noise(30_000) + passages[2]), 13: '{"q": &quot;' + " ".join(asks[3]) + "&quot;}", 14: " ".join(w for pair in zip(p[:30], noise(30), strict=True) for w in pair), 15: "",
    }
    rows = spark.createDataFrame([(i, t, "i") for i, t in docs.items()], "doc_id bigint, text string, item_id string")
    got = {tuple(r) for r in leaks.leaked_items(rows, items).collect()}
    assert got == {(0, 1), (0, 3), (0, 4), (0, 5), (0, 6), (1, 8), (2, 12), (3, 13)}
    merged = leaks.removal_spans(leaks.leaked_spans(rows, items)).where("doc_id = 12").collect()
    assert [(r.first_word, r.end_word, r["items"]) for r in merged] == [(30_000, 30_060, [2])]
    assert leaks.leaked_items(rows.limit(0), items).count() == 0
    assert leaks.leaked_items(rows, items.limit(0)).count() == 0


def subject_corpus(n=240):
    rng = random.Random(6)
    vocabulary = {s: [f"{s}{w}" for w in ("ation", "ment", "ity", "ness", "ware", "ling")] for s in ("alpha", "beta", "gamma", "delta")}
    say = lambda s: f"The {rng.choice(vocabulary[s])} depends on the {rng.choice(vocabulary[s])} for {rng.randrange(9)} days."
    rows = []
    for i in range(n):
        own = rng.sample(sorted(vocabulary), rng.choice([1, 1, 2]))
        lines = [say(s) for s in own for _ in range(6)] + ["Nothing else was decided that day."] * 2 + [say(rng.choice(sorted(vocabulary)))]
        rng.shuffle(lines)
        rows.append((i, " ".join(lines), "notes/a.md", own))
    return rows


def test_subjects(spark):
    rows = subject_corpus()
    docs = spark.createDataFrame([(i, t, s, "x") for i, t, s, _ in rows] + [(900, "", None, "x"), (901, None, None, "x"), (902, "Nothing else was decided that day.", None, "x"), (903, "zz " * 50_000, "s", "x"), (0, rows[0][1], "notes/a.md", "x")], "doc_id bigint, text string, source string, subject string")
    labels = spark.createDataFrame([(i, s) for i, _, _, own in rows[:160] for s in own] + [(5000, "alpha"), (1, "unknown subject"), (None, "alpha")], "doc_id bigint, subject string")
    names_ = spark.createDataFrame([(s, i) for i, s in enumerate(("alpha", "beta", "gamma", "delta"))] + [(None, None)], "subject string, sort_no int")
    got = {}
    for r in subjects.document_subjects(docs, labels, names_).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == set(own) for i, _, _, own in rows[160:])
    assert right >= 0.9 * 80 and not set(got) & {900, 901, 902}
    assert subjects.document_subjects(docs, labels.limit(0), names_).count() == 0
    assert subjects.document_subjects(docs.limit(0), labels, names_).count() == 0


def test_subjects_of_long_texts(spark, monkeypatch):
    rows = subject_corpus(80)
    docs = spark.createDataFrame([(i, (t + "\n") * 20, s) for i, t, s, _ in rows], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, s) for i, _, _, own in rows[:60] for s in own], "doc_id bigint, subject string")
    names_ = spark.createDataFrame([(s, i) for i, s in enumerate(("alpha", "beta", "gamma", "delta"))], "subject string, sort_no int")
    assert docs.where(F.length("text") <= 5_000).isEmpty() and not subjects.document_subjects(docs, labels, names_).isEmpty()
    sizes = [len(t) for t in sorted((r.text for r in docs.collect()), key=len)]
    assert 2 <= subjects._first_by_hash(docs, 50, 3 * sizes[0]).count() <= 4
    assert subjects._first_by_hash(docs, 50, 1).count() == 2 and subjects._first_by_hash(docs, 50, 10**9).count() == 50


def test_sql_agrees(spark, small):
    import glob
    import os

    from loomgraph.llm.queries import QUERIES
    from loomgraph.llm.sql import ORACLE

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    for name, sql in ORACLE.items():
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(map(tuple, QUERIES[name](spark, small).select(columns).collect())) == sorted(result.fetchall())
    assert F is not None
