import math
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.latex import braced, latex_text, macros_of, tidy, with_inputs
from loomgraph.functions.model_output import clean_output, decode_edges, extracted_entities
from loomgraph.functions.porter import stem
from loomgraph.operators import evalqa, search_text


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    row = spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(expression.alias("r")).first()
    return row.r


@pytest.mark.parametrize("text, size, overlap", [("short", 1500, 150), ("abcdefghij", 6, 2), ("😀" * 6, 4, 1), ("", 6, 2), ("x" * 4001, 1500, 150)])
def test_chunks(spark, text, size, overlap):
    wanted, at = [], 0
    while True:
        wanted.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    assert one(spark, X.chunk_windows(F.col("t"), size, overlap), t=text) == wanted


def test_line_chunks(spark):
    assert one(spark, X.chunk_lines(F.col("t"), 20), t="short") == ["short"]
    assert one(spark, X.chunk_lines(F.col("t"), 10), t="aaaa\nbbbb\ncccccccccccccc\ndd") == ["aaaa\nbbbb", "cccccccccccccc", "dd"]


@pytest.mark.parametrize("p, g, f1, em", [("pottery", "pottery, camping, painting, swimming", 0.4, 0), ("7 May 2023.", "7 may 2023", 1, 1), ("went to the park", "went to park", 1, 1), ("The park", "park", 2 / 3, 0), ("", "x", 0, 0), ("", "", 0, 1)])
def test_scores(spark, p, g, f1, em):
    row = evalqa.scores(spark.createDataFrame([(p, g)], "prediction string, gold string")).first()
    assert (round(row.f1, 6), row.em) == (round(f1, 6), em)


def test_rollup(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0, -1.0), (1, 1.0, 0.0, 1.0), (9, 0.0, 0.0, 0.0)], "category int, f1 double, em double, judge double")
    got = {r.category: (r.n, r.avg_f1, r.n_judged, r.avg_judge) for r in evalqa.rollup(rows).collect()}
    assert got == {"single-hop": (2, 0.75, 1, 1.0), "cat-9": (1, 0.0, 1, 0.0), "overall": (3, 0.5, 2, 0.5)}


def test_intents_and_classes(spark):
    words = {"why did it": "WHY", "the reason": "WHY", "when was": "WHEN", "before noon": "WHEN", "who is": "ENTITY", "which person": "ENTITY", "tell me": "WHAT", "": "WHAT"}
    for text, wanted in words.items():
        assert one(spark, X.query_intent(F.col("t")), t=text) == wanted
    names = {"CAUSES": "causal", "RESULTS_IN": "causal", "LEADS_TO": "causal", "BORN_ON": "temporal", "OCCURRED_AT": "temporal", "KNOWS": "relational", "PART_OF": "relational", "WORKS_AT": "attributive", "IS_A": "attributive", "": "unknown"}
    for text, wanted in names.items():
        assert one(spark, X.edge_class(F.col("t")), t=text) == wanted
    assert one(spark, X.phi(F.lit("WHY"), F.lit("causal"))) == 1.0
    assert one(spark, X.phi(F.lit("WHAT"), F.lit("unknown"))) == 0.0


def test_small_functions(spark):
    assert one(spark, X.session_number(F.col("t")), t="conv/session_12/x") == 12
    assert one(spark, X.session_number(F.col("t")), t="session_x") == 0
    assert one(spark, X.temporal_tag(F.col("t")), t="conv/session_3") == "[session_3] "
    assert one(spark, X.approx_tokens(F.col("t")), t="abcde") == 2
    assert one(spark, X.ascii_lower(F.col("t")), t="MÜLLER") == "mÜller"
    assert one(spark, X.token_jaccard(F.col("a"), F.col("b")), a="Mr. Harker", b="Jonathan Harker") == pytest.approx(1 / 3)
    assert one(spark, X.flexible_int(F.col("t")), t='"3.0"') == 3
    assert one(spark, X.flexible_int(F.col("t")), t="null") == 0
    assert one(spark, X.flexible_string(F.col("t")), t="2024") == "2024"
    assert one(spark, X.flexible_string(F.col("t")), t='""') is None
    assert one(spark, X.is_refusal(F.col("t")), t=" I'm sorry, but") is True
    assert one(spark, X.is_hypothetical(F.col("t")), t="Would she go?") is True
    assert one(spark, X.entity_embedding_text(F.col("n"), F.col("k"), F.col("d")), n="Mina", k="Person", d="") == "A person named Mina"
    assert one(spark, X.in_skipped_folder(F.col("t")), t="a/.git/x") is True
    assert one(spark, X.in_skipped_folder(F.col("t")), t="a/b.md") is False
    assert one(spark, X.has_text_extension(F.col("t")), t="/a/B.MD") is True


@pytest.mark.parametrize("text, wanted", [("Caroline's job", "Caroline* OR job*"), ("", ""), ("4", "4*"), ("d 4", "4*"), ("α=0.05", "α005*")])
def test_compiled_queries(spark, text, wanted):
    assert one(spark, search_text.compiled_query(F.col("t")), t=text) == wanted


def test_stems():
    words = {"running": "run", "runners": "runner", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "formalize": "formal", "electricity": "electr", "agreed": "agre", "sky": "sky", "adoption": "adopt"}
    assert {w: stem(w) for w in words} == words


def test_full_text_golden_scores(spark):
    texts = ["Running shoes for runners", "The run was long", "Müller works at TechCorp", "caroline's job is yoga", "Cafe Café naive", "alpha beta gamma delta"]
    docs = spark.createDataFrame([(str(i), t, "g") for i, t in enumerate(texts)], "doc string, text string, group_id string")
    wanted = {"running": {"0": 0.8082066642, "1": 0.5877866649}, "runn": {"0": 1.2992829841}, "muller": {"2": 1.2992829841}, "Caroline": {"3": 1.1787309547}, "café": {"4": 1.9216286152}, "4": {}}
    queries = spark.createDataFrame([(i, q, "g") for i, q in enumerate(wanted)], "query_id bigint, text string, group_id string")
    got = {i: {} for i in range(len(wanted))}
    for r in search_text.bm25(docs, queries, 10).collect():
        got[r.query_id][r.doc] = r.score
    for i, scores in enumerate(wanted.values()):
        assert got[i] == pytest.approx(scores, abs=1e-8)
    assert search_text.bm25(docs, queries.withColumn("group_id", F.lit("other")), 10).count() == 0


def test_full_text_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(search_text, "DOCUMENTS", 3)
    monkeypatch.setattr(search_text, "QUERIES", 2)
    texts = ["runs a run", "The runner", "run, run_fast", "", None, "fast cars", "a run"] * 3
    docs = [(f"{i:02}", t, "gh"[i % 2]) for i, t in enumerate(texts)]
    asked = [(i, t, "ghk"[i % 3]) for i, t in enumerate(["run", "ru fast_run", "run run", "carsick", "cars of", "", "the a runs 7"])]
    words = {d: re.findall(r"[a-z0-9]+", (t or "").lower()) for d, t, _ in docs}
    mean = sum(map(len, words.values())) / len(docs)

    def score(term, doc):
        tf, n = sum(w.startswith(term) for w in words[doc]), sum(any(w.startswith(term) for w in own) for own in words.values())
        return max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[doc]) / mean))

    wanted = set()
    for q, text, group in asked:
        terms = [x for w in text.split() if len(w) > 1 or w.isdigit() for x in w.split("_")]
        scored = [(-round(sum(score(t, d) for t in terms), 9), d) for d, _, g in docs if g == group and any(w.startswith(t) for t in terms for w in words[d])]
        wanted |= {(q, d, -s, i) for i, (s, d) in enumerate(sorted(scored)[:4])}
    found = search_text.bm25(spark.createDataFrame(docs, "doc string, text string, group_id string"), spark.createDataFrame(asked, "query_id bigint, text string, group_id string"), 4, False)
    got = {tuple(r) for r in found.collect()}
    assert {(q, d, round(s, 8), i) for q, d, s, i in got} == {(q, d, round(s, 8), i) for q, d, s, i in wanted} and len(got) > 12


def test_model_output(spark):
    assert clean_output('<think>x</think>```json\n{"a": 1}\n```') == '{"a": 1}'
    assert clean_output("<think>never closed") == ""
    assert clean_output("so [1, 2] it is") == "[1, 2]"
    assert clean_output("plain words") == "plain words"
    assert clean_output(r'{"a": "\(x\)"}') == '{"a": "(x)"}'
    assert clean_output(None) is None
    edges = decode_edges('{"edges": [{"relation_type": "KNOWS", "source_entity_id": "0", "target_entity_id": 1.0, "fact": "f", "valid_at": 2024}, {"source_entity_id": 7, "target_entity_id": 0}]}', 2)
    assert edges == [{"relation_type": "KNOWS", "source_entity_id": 0, "target_entity_id": 1, "fact": "f", "valid_at": "2024", "invalid_at": None}]
    rows = spark.createDataFrame([('[{"name": "A"}, {"name": " "}]',), ('{"extracted_entities": [{"name": "B", "entity_type": "Person"}]}',), (None,)], "t string")
    got = [None if r.e is None else [x.name for x in r.e] for r in rows.select(extracted_entities(F.col("t")).alias("e")).collect()]
    assert got == [["A"], ["B"], None]


def test_latex():
    assert braced(r"{a{b}\}c} d", 0) == (r"a{b}\}c", 9) and braced("x {a}", 0) == ("", 0)
    assert with_inputs(r"x \input{a} \include{no}", {"a.tex": "A"}) == "x A "
    sources = [r"\newcommand{\sys}{\textbf{Loom}}", r"\renewcommand*{\sys}{Graph} \def\more{\sys{} too}"]
    assert macros_of(sources) == {"sys": "Graph", "more": r"\sys{} too"}
    assert latex_text(r"\sys{} and \sys, \more", {"m.sty": sources[0], "n.tex": sources[1]}) == "Graph and Graph, Graph too"
    assert latex_text(r"\loop x", {"m.sty": r"\def\loop{a \loop}"}) == "a  x"
    assert latex_text("x", stripper=lambda t: "own") == "own" and latex_text("x", stripper=lambda t: 1 / 0) == "x"
    assert latex_text(r"a \[ x \] b $$ y $$ c 5\% \label{k} \unknown[o]{kept}") == "a  b  c 5%  kept"
    assert latex_text(r"\title[s]{A \\ B \& C} \author{$^1$ D}" + "\n\\begin{document}e\\end{document}f") == "A \n B  &  C\nD\n\ne"
    text = latex_text("\\title{On \\textbf{Names}}\n\\begin{document}\n\\begin{table}x\\end{table} We \\emph{show} $x$ it~\\cite{a}.\n\\end{document}")
    assert text.startswith("On Names") and "We show  it." in text and "table" not in text
    assert tidy("see smith2024deeplearning , and\n\n\n\nthen") == "see  and\n\nthen"
    assert not re.search(r"[{}\\]", text)
