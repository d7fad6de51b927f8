import json
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.operators import evalqa, ingest
from loomgraph.plans import benchmark
from loomgraph.session import cut_lineage
from loomgraph.sources import conversations, files, providers
from loomgraph.sources.store import SpaceMismatch, Store
from loomgraph.streaming.worker import JOB, jobs_stream, run_worker


def test_walk(spark, tmp_path):
    long = "A line of text that is long enough to be kept as a chunk of its own."
    for name, data in {"a.md": long.encode(), "b.xyz": long.encode(), "c.txt": b"short", "d.txt": b"\xff\xfe" + long.encode(), ".git/e.md": long.encode(), "node_modules/f.md": long.encode(), "p/g.PY": long.encode(), "p/h.tex": b"\\begin{document}" + long.encode() + b"\\end{document}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    jobs = files.enqueue(spark, str(tmp_path), "g", source="here").collect()
    assert len(jobs) == 3 and {json.loads(j.payload)["source"] for j in jobs} == {"here"}
    assert files.enqueue(spark, str(tmp_path)).count() == 3


def test_cascade():
    assert files.cascade(lambda b: "", lambda b: " text ")(b"") == "text"
    with pytest.raises(ValueError):
        files.cascade(lambda b: None)(b"")
    assert files.joined_pages(["a", None, " ", "b"]) == "a\n\nb"


def test_conversations(spark, tmp_path):
    turn = lambda s, t, c=None: {"speaker": s, "dia_id": "D", "text": t, "blip_caption": c}
    sample = {"sample_id": "s", "conversation": {"speaker_a": "A", "session_1": [turn("A", "hi"), turn("B", "", "a cat")], "session_1_date_time": "1 May", "session_2": [turn("A", "yo")], "session_4": [turn("A", "lost")]}, "qa": [{"question": "q", "answer": 7, "category": 1}, {"question": "r", "adversarial_answer": "x", "category": 5}]}
    (tmp_path / "c.json").write_text(json.dumps([sample]))
    samples = conversations.read(spark, str(tmp_path / "c.json"))
    turns = conversations.turns(samples)
    assert sorted({r.session for r in turns.collect()}) == [1, 2]
    from loomgraph.operators.evalqa import render_sessions

    assert render_sessions(turns).where("session = 1").first().text == "[1 May]\nA: hi\nB: [image: a cat]"
    assert [r.gold for r in conversations.questions(samples).orderBy("question_no").collect()] == ["7", "x"]


def test_providers(spark):
    calls, waits = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise providers.TransportError(503)
        return "ok"

    assert providers.with_retries(busy, waits.append) == "ok" and waits == [2.0, 5.0]
    for status, tries in ((400, 1), (500, 4)):
        calls.clear()

        def broken(status=status):
            calls.append(1)
            raise providers.TransportError(status)

        with pytest.raises(providers.TransportError):
            providers.with_retries(broken, lambda _: None)
        assert len(calls) == tries
    assert providers.in_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], 2) == [[1.0], [2.0]]
    assert providers.judged_yes(" Yes.") and not providers.judged_yes("no")
    assert providers.double_page(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (200).to_bytes(4, "big") + (100).to_bytes(4, "big"))
    assert not providers.double_page(b"nothing")
    rows = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    assert [r.embedding is not None for r in providers.embed_column(rows, "t", providers.HashEmbedder(4)).collect()] == [True, False, False]
    blobs = spark.createDataFrame([(bytearray(providers.encode_vector([1.0, 2.0])),), (bytearray(b""),), (None,)], "b binary")
    assert [r.embedding for r in providers.decode_vectors(blobs, "b").collect()] == [[1.0, 2.0], None, None]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "space-a")
    store.write("t", spark.createDataFrame([(1, "g")], "x int, group_id string"))
    store.write("t", store.read("t").unionByName(spark.createDataFrame([(2, "h")], "x int, group_id string")))
    assert store.read("t").count() == 2
    with pytest.raises(SpaceMismatch):
        Store(spark, str(tmp_path / "s"), "space-b")


def job(n, content, group="g", source="s", status="pending", attempts=0, not_before=None):
    payload = content if content.startswith("{") else json.dumps({"content": content, "source": source, "group_id": group})
    return (n, "ingest", payload, status, attempts, 3, None, not_before, None, datetime(2026, 1, 1))


def test_worker(spark, tmp_path):
    spark.createDataFrame([job(1, "one"), job(2, '{"con'), job(3, "one")], JOB).write.parquet(str(tmp_path / "in"))
    got, drained = [], []
    for _ in range(2):  # the second run finds nothing new
        run_worker(jobs_stream(spark, str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), lambda: drained.append(1))
    assert sorted(r.id for r in got) == [1, 2, 3] and drained == [1]


def test_ingest(spark):
    class Failing:  # local, so that it travels to the executors by value
        def entities(self, text):
            if "broken" in text:
                raise ValueError("no reply")
            return providers.PatternExtractor().entities(text)

        def edges(self, names, text):
            return providers.PatternExtractor().edges(names, text)

    now = F.lit(datetime(2026, 6, 1))
    later = datetime(2026, 7, 1)
    rows = [
        job(1, "Ada Lovelace met Charles Babbage."), job(2, "then Charles Babbage wrote to Mary Somerville."), job(3, '{"cut'), job(4, "this is broken", attempts=2),
        job(5, "Too Early is not due.", not_before=later), job(6, "nothing in it"), job(7, "Ada Lovelace met Charles Babbage."), job(8, "Ada Lovelace lives here", group="h"), job(9, "Old Stuff", status="done"),
    ]
    queue = spark.createDataFrame(rows, JOB)
    after, g = ingest.ingest(queue, ingest.Graph.empty(spark), Failing(), providers.HashEmbedder(), now, wait=lambda _: None)
    states = {r.id: (r.status, r.attempts) for r in after.collect()}
    assert states == {1: ("done", 0), 2: ("done", 0), 3: ("pending", 1), 4: ("failed", 3), 5: ("pending", 0), 6: ("done", 0), 7: ("done", 0), 8: ("done", 0), 9: ("done", 0)}
    assert "no reply" in after.where("id = 4").first().error and after.where("id = 3").first().not_before > datetime(2026, 6, 1)
    assert sorted((r.group_id, r.name) for r in g.entities.collect()) == [("g", "Ada Lovelace"), ("g", "Charles Babbage"), ("g", "Mary Somerville"), ("h", "Ada Lovelace")]
    assert g.episodes.count() == 4 and g.edges.count() == 2 and g.links.count() == 5
    assert all(r.embedding and json.loads(r.episodes) for r in g.edges.collect())
    # The next batch finds the entities that are there, and a repeated one changes nothing.
    g = ingest.Graph(*[cut_lineage(t) for t in (g.episodes, g.entities, g.edges, g.links)])
    more = spark.createDataFrame([job(10, "Lovelace Ada and ada lovelace: Ada Lovelace saw Mary Somerville"), job(11, "Ada Lovelace met Charles Babbage.")], JOB)
    _, h = ingest.ingest(more, g, Failing(), providers.HashEmbedder(), now)
    assert {r.uuid for r in g.entities.collect()} == {r.uuid for r in h.entities.collect()}
    assert h.episodes.count() == 5 and h.edges.count() == 4  # the turned name is the same entity, so one is a loop
    empty, e = ingest.ingest(queue.limit(0), g, Failing(), providers.HashEmbedder(), now)
    assert empty.count() == 0 and e.entities.count() == g.entities.count()


def test_run_and_search(spark, tmp_path, capsys):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("Ada Lovelace met Charles Babbage in the calculating engine house of the old town.")
    store = ["--store", str(tmp_path / "store"), "--group", "g"]
    cli.main([*store, "run", str(tmp_path / "notes")])
    cli.main([*store, "search", "Charles", "Babbage"])
    assert "Ada Lovelace is followed by Charles Babbage" in capsys.readouterr().out
    for verb in (["status"], ["communities", "--knn"], ["communities", "--knn"], ["curvature", "--compute"], ["resolve"], ["search", "--format", "json", "engine"]):
        cli.main([*store, *verb])
    assert "done" in capsys.readouterr().out


def test_benchmark(spark, tmp_path):
    talk = {"session_1": [{"speaker": "Ann", "dia_id": "1", "text": "Ada Lovelace met Charles Babbage in May."}], "session_1_date_time": "1 May", "session_2": [{"speaker": "Bob", "dia_id": "2", "text": "The engine was painted green."}], "session_2_date_time": "2 May"}
    (tmp_path / "talk.json").write_text(json.dumps([{"sample_id": "s1", "conversation": talk, "qa": [{"question": "What colour was the engine painted?", "answer": "green", "category": 1}, {"question": "zzz", "answer": "none", "category": 2}]}]))
    samples = conversations.read(spark, str(tmp_path / "talk.json"))
    queue = benchmark.session_jobs(evalqa.render_sessions(conversations.turns(samples)))
    _, g = ingest.ingest(queue, ingest.Graph.empty(spark), providers.PatternExtractor(), providers.HashEmbedder(), F.current_timestamp())
    g = ingest.Graph(*[cut_lineage(t) for t in (g.episodes, g.entities, g.edges, g.links)])
    asked = conversations.questions(samples).select(F.concat_ws("/", "sample_id", "question_no").alias("query_id"), "question", "gold", "category", F.col("sample_id").alias("group_id"))
    model = providers.FirstFactAnswerer()
    got = {(r["mode"], r.category): r for r in benchmark.evaluate(g, asked, providers.HashEmbedder(), model, model).collect()}
    assert set(got) == {(m, c) for m in ("baseline", "graph") for c in ("single-hop", "multi-hop", "overall")}
    assert got["baseline", "overall"].n == 2 and got["baseline", "overall"].n_judged == 2


def test_pdf_cascade():
    def page(show, packed):
        body = b"BT /F1 12 Tf 72 700 Td " + show + b" ET"
        return b"1 0 obj << /Length 9 " + (b"/Filter /FlateDecode " if packed else b"") + b">>\nstream\n" + (zlib.compress(body) if packed else body) + b"\nendstream endobj\n"

    pdf = b"%PDF-1.4\n" + page(rb"(A \(short\) caf\351) Tj 0 -14 Td [(wo) -20 (rd) -300 (two)] TJ", True) + page(rb"<48 69> Tj", False)
    assert files.text_layer(pdf) == "A (short) caf\u00e9\nword two\n\nHi"
    assert files.text_layer(b"no pdf") is None and files.text_layer(b"%PDF-1.4\n" + page(rb"<0001000200030004> Tj", False)) is None

    def raster(content):
        if content == b"broken":
            raise ValueError
        return [b"p1", b"bad", b"p2"]

    class Model:
        def read(self, image, prompt):
            if image == b"bad":
                raise ValueError
            return "I cannot do that." if prompt == "read" and image == b"p2" else f"{image.decode()} by {prompt}"

    pictures = files.by_model(raster, Model(), "read", "look again")
    assert pictures(b"x") == "p1 by read\n\np2 by look again" and pictures(b"broken") is None
    read = files.cascade(files.text_layer, lambda c: None, pictures)
    assert read(pdf).startswith("A (short)") and read(b"%PDF-1.4 scan") == "p1 by read\n\np2 by look again"
    with pytest.raises(ValueError):
        files.cascade(files.text_layer)(b"broken")


def test_models_fail_by_row(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string")

    def call(text):
        if text == "bad":
            raise providers.TransportError(400)
        return text.upper()

    got = [tuple(r.m) for r in providers.apply_model(df, call, "m", "t", wait=lambda _: None).collect()]
    assert got == [("A", None), (None, "TransportError: status 400"), (None, None)]
