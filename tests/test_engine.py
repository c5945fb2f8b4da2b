import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.config import EngineConfig
from lexigrid.engine import Engine, Running
from lexigrid.operators import retrieval as R
from lexigrid.operators import upsert as U
from lexigrid.plugins import all_plugins, get_plugin
from lexigrid.sources import files, graph_store
from lexigrid.streaming import events as S
from lexigrid.streaming.ingest import ingest, run_to_table, watch
from lexigrid.streaming.jobs import furthest, track


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("in")
    (home / "a.txt").write_text("Ada Lovelace met Charles Babbage. Then Charles Babbage built the Engine.")
    (home / "b.md").write_text("# Title\nMary Somerville taught Ada Lovelace.\n## Part\nMore words here.")
    (home / "copy.txt").write_text("Ada Lovelace met Charles Babbage. Then Charles Babbage built the Engine.")
    (home / ".hidden").write_text("x")
    e = Engine(spark, str(tmp_path_factory.mktemp("graph")), EngineConfig(similarity_threshold=0.99))
    stats = e.run(str(home), clean_database=True)
    return e, stats, home


def test_run(graph):
    e, stats, home = graph
    assert stats["documents"] == 2 and stats["chunks"] == 3 and stats["entities"] > 2
    again = e.run(str(home))
    assert again == stats  # contents that are there already change nothing
    assert graph_store.violations(e.spark, e.folder).count() == 0


def test_answers_cite_chunks(graph):
    e, _, _ = graph
    out = e.answer("Charles Babbage Engine")
    assert out["citations"] and "Babbage" in out["citations"][0]["text_excerpt"]
    kinds = [x["type"] for x in e.stream("Charles Babbage")]
    assert kinds[-3:] == ["citation", "graph", "done"] and kinds[0] == "token"


def test_neighbours_context_schema(graph):
    e, _, _ = graph
    assert e.neighbours("Ada Lovelace", 1).count() >= 1
    assert e.search_entities("Ada Lovelace", 1).first()["name"] == "Ada Lovelace"
    doc_id = e.documents().first()["doc_id"]
    assert e.context(doc_id).first()["sample_chunks"]
    assert "RELATED_TO" in e.schema().first()["relationship_types"]


def test_lock(graph):
    e, _, home = graph
    free = e._lock()
    with pytest.raises(Running):
        e.run(str(home))
    free()


def test_reprocess_and_delete(graph):
    e, stats, _ = graph
    doc_id = e.documents().where("title = 'b'").first()["doc_id"]
    e.reprocess(doc_id)
    e.delete(doc_id)
    assert e.documents().count() == 1 and e.analytics().first()["chunks"] == 1


def test_a_table_outlives_a_crash_between_renames(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a")], "doc_id string, title string")
    graph_store.write(rows, str(tmp_path), "documents")
    (tmp_path / "documents").rename(tmp_path / "_documents.old")  # where a crash may leave it
    assert graph_store.read(spark, str(tmp_path), "documents").first()["title"] == "a"
    old = graph_store.read(spark, str(tmp_path), "documents")
    graph_store.write(old.unionByName(graph_store.conform(rows.selectExpr("'2' AS doc_id", "'b' AS title"), "documents")), str(tmp_path), "documents")
    assert graph_store.read(spark, str(tmp_path), "documents").count() == 2 and not (tmp_path / "_documents.old").exists()


def test_pruning_drops_small_components_but_no_documents(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    graph_store.write(spark.createDataFrame([(x,) for x in "abcdefxt"], "entity_id string"), e.folder, "entities")
    graph_store.write(spark.createDataFrame([("T", "TOPIC")], "id string, node_type string"), e.folder, "topics")
    edges = [("a", "b", "RELATED_TO", 1.0), ("c", "d", "RELATED_TO", 1.0), ("d", "e", "RELATED_TO", None), ("e", "f", "RELATED_TO", 0.001), ("t", "T", "IN_TOPIC", None), ("D", "C", "CONTAINS", None)]
    graph_store.write(spark.createDataFrame(edges, "src string, dst string, rel string, weight double"), e.folder, "edges")
    e.prune()
    # a and b are a pair, f hangs on a weak edge, x on none; the topic keeps t
    assert {r["entity_id"] for r in graph_store.read(spark, e.folder, "entities").collect()} == set("cdet")
    assert {(r["src"], r["dst"]) for r in graph_store.read(spark, e.folder, "edges").collect()} == {("c", "d"), ("d", "e"), ("t", "T"), ("D", "C")}


def test_the_last_row_of_a_key_wins_however_rows_are_spread(spark):
    new = spark.createDataFrame([(1, i, "v%d" % i, {"k": i}) for i in range(20)] + [(2, 0, None, None)], "id int, seq int, name string, props map<string,int>")
    old = spark.createDataFrame([(2, "kept")], "id int, name string")
    for n in (1, 7):
        got = {r["id"]: r["name"] for r in U.merge_nodes(old, new.repartition(n), "id", "seq").collect()}
        assert got == {1: "v19", 2: "kept"}
    free = {tuple(map(str, U.last_of_each(new.where("id = 1").repartition(n), "id").first())) for n in (1, 5)}
    assert len(free) == 1


def test_registry_and_plugins():
    assert files.get_parser("x/y.MD").name == "markdown" and files.get_parser("x.unknown").name == files.get_parser("plain").name == "text"
    assert "xlsx" in files.supported_extensions()
    assert "topics" in all_plugins()
    with pytest.raises(KeyError):
        get_plugin("none")


def test_missing_folder_is_empty(spark, tmp_path):
    assert files.scan_dir(spark, str(tmp_path / "none")).count() == 0
    assert files.scan_dir(spark, str(tmp_path)).count() == 0


def test_damaged_office_files_give_no_chunks(spark):
    bad = spark.createDataFrame([("d", bytearray(b"not a zip"))], "doc_id string, content binary")
    for name in ("docx", "pptx", "xlsx", "pdf", "image"):
        assert files.parse(name, bad).count() == 0


def test_graphml(spark, tmp_path):
    from xml.etree import ElementTree

    n = spark.createDataFrame([("a", "x < y", ["p"])], "id string, name string, tags array<string>")
    e = spark.createDataFrame([("a", "a", 0.5)], "src string, dst string, weight double")
    graph_store.export_graphml(n, e, str(tmp_path / "g"))
    text = "".join(p.read_text() for d in sorted((tmp_path / "g").iterdir()) for p in sorted(d.glob("part-*")))
    root = ElementTree.fromstring(text)
    assert [x.text for x in root.iter() if x.tag.endswith("data")] == ["x < y", '["p"]', "0.5"]


def test_entity_search_falls_back_to_names(spark):
    e = spark.createDataFrame([("1", "Ring", None)], "id string, name string, embedding array<float>")
    assert R.entity_search(e, [1.0, 0.0], "ring").count() == 1
    assert R.entity_search(e, None, "ring").count() == 1


def test_batch_topk_by_parts(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id long, embedding array<float>")
    q = v.withColumnRenamed("id", "query_id")
    a, b = ({tuple(r) for r in R.batch_topk(v, q, 2, most=m).collect()} for m in (1, 1 << 20))
    assert a == b and len(a) == 18


def test_nearest_keeps_memory_and_ties_in_bounds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 16)).astype(np.float32).astype(np.float64)
    x[::5] = x[0]  # many equal rows: the least ids win
    near = R.Nearest(x[:6000].astype(np.float32), 3)
    tracemalloc.start()
    for i in range(0, len(x), 6000):
        near.add(pa.array([f"{n:05}" for n in range(i, i + 6000)]), x[i : i + 6000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # one product of all queries and all rows of a batch takes 288 MB
    got: dict = {}
    for at, key, score in near.best():
        for a, b, c in zip(at.tolist(), key, score.tolist()):
            got.setdefault(a, []).append((b, c))
    for i in (0, 5, 7, 5999):
        s = np.cumsum(x[i] * x, axis=1)[:, -1] / (np.sqrt(np.cumsum(x[i] * x[i])[-1]) * np.sqrt(np.cumsum(x * x, axis=1)[:, -1]))
        assert got[i] == [(f"{n:05}", s[n]) for n in sorted(range(len(x)), key=lambda n: (-s[n], n))[:3]]


def test_trigrams_are_hashed_by_tables(monkeypatch):
    import zlib

    from lexigrid.operators.embed import hashed_trigrams

    texts = ["Some words, as they stand.", "", "é 漢字 \U0001f600", "x" * 5000]
    want = np.zeros((len(texts), 384), np.float32)
    for i, t in enumerate(texts):
        b = f" {t.lower()} ".encode()
        for j in range(len(b) - 2):
            h = zlib.crc32(b[j : j + 3])
            want[i, h % 384] += 1.0 if h >> 31 else -1.0
    n = np.linalg.norm(want, axis=1, keepdims=True)
    calls, crc32 = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda b: calls.append(1) or crc32(b))
    assert (hashed_trigrams()()(texts) == want / np.where(n == 0, 1, n)).all()
    assert len(calls) < 1000  # for the tables; one for each trigram before


def test_bm25_reads_documents_once(spark):
    texts = {1: "the cat sat on the mat", 2: "The dog", 3: "a cat and a dog and a cat", 4: "", 5: None, 6: "nothing here"}
    asked = {7: "Cat dog", 8: "mat the the", 9: "absent", 10: ""}
    words = {d: t.lower().split() for d, t in texts.items() if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, t in asked.items():
        scores = {}
        for term in set(t.lower().split()):
            have = [d for d, w in words.items() if term in w]
            for d in have:
                f = words[d].count(term)
                scores[d] = scores.get(d, 0) + math.log(1 + (len(words) - len(have) + 0.5) / (len(have) + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[d]) / mean))
        for r, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2], 1):
            want[q, d] = (round(s, 6), r)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = R.bm25(docs, spark.createDataFrame(list(asked.items()), "query_id long, text string"), 2)
    assert {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in out.collect()} == want
    assert "text#" not in out._jdf.queryExecution().optimizedPlan().toString()  # counts are made by then


def test_late_rows_are_dropped(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(0, [(1, "2024-01-01 00:10:00", 1, "a", 1.0)])
    put(1, [(2, "2024-01-01 05:00:00", 1, "a", 1.0)])
    put(2, [(5, "2024-01-01 06:00:00", 1, "a", 1.0)])
    put(3, [(3, "2024-01-01 00:20:00", 1, "a", 1.0), (4, "2024-01-01 09:00:00", 1, "a", 1.0)])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {str(r["start"]): r["n"] for r in run_to_table(S.tumbling(s)).collect()}
    assert out["2024-01-01 00:00:00"] == 1  # event 3 came after the watermark had passed its window


def test_stream_ingest(spark, tmp_path):
    spark.createDataFrame([("1", "one two"), ("2", "three")], "doc_id string, text string").repartition(2).write.parquet(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "graph"))
    ingest(watch(spark, str(tmp_path / "in")), e, str(tmp_path / "cp")).awaitTermination()
    assert e.analytics().first()["documents"] == 2 and e.analytics().first()["chunks"] == 2


def test_job_states_only_move_forward():
    assert furthest(["extracting"], "resolving") == "resolving"
    assert furthest(["done"], "error") == "done"
    assert furthest(["unknown"]) == "queued"


def test_job_stream_says_each_change_once_without_python(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "job_id long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, "extracting"), (1, "queued"), (2, "error"), (3, "what"), (4, None), (5, "done"), (5, "error")])
    put([(1, "extracting"), (1, "queued"), (2, "resolving"), (3, "queued"), (5, "error")])  # nothing new
    put([(1, "summarising"), (2, "done"), (4, "error"), (6, "queued")])
    stream = track(watch(spark, str(tmp_path / "in"), "job_id long, status string"))
    assert "InPandas" not in stream._jdf.queryExecution().analyzed().toString()
    got = sorted(tuple(r) for r in run_to_table(stream, "update").collect())
    first = [(1, "extracting", 0.1), (2, "error", 1.0), (3, "queued", 0.0), (4, "queued", 0.0), (5, "done", 1.0)]
    assert got == sorted([*first, (1, "summarising", 0.9), (2, "done", 1.0), (4, "error", 1.0), (6, "queued", 0.0)])
