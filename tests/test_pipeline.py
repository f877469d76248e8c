from __future__ import annotations

from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators.documents import project_documents
from cairn.plans.pipeline import Options, documents_of_folder, run_once, show_tables
from cairn.sources.files import write_pdf
from cairn.sources.storage import TableStore
from cairn.streaming.incremental import follow


def docs(spark, **texts):
    return project_documents(spark.createDataFrame(list(texts.items()), "uri string, text string"), F.col("uri"), F.col("text"))


SMALL = Options(window=20, overlap=5, batch=8)


def test_runs(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    first = run_once(store, docs(spark, a="x" * 50, b="short", c=""), "m", "1", options=SMALL, now_ms=1)
    assert (first["docs_new_or_changed"], first["chunks_new_or_changed"], first["embeddings_new"], first["noop_run"]) == (3, 5, 5, False)
    assert set(schemas.DOCS.fieldNames()) == set(store.read("delta_pdf_docs").columns)
    assert set(schemas.SNAPSHOT.fieldNames()) == set(store.read("retrieval_index_1").columns)
    again = run_once(store, docs(spark, a="x" * 50, b="short", c=""), "m", "1", options=SMALL, now_ms=2)
    assert again["noop_run"] and again["docs_skipped_ratio"] == 1.0 and store.exists("retrieval_index_2")
    # an edit that shortens: by default stale chunks stay, with prune they go
    edit = run_once(store, docs(spark, a="x" * 20, d="new"), "m", "1", options=SMALL, now_ms=3)
    assert (edit["docs_new_or_changed"], edit["embeddings_reused"]) == (2, 1)
    ids = lambda: store.read("delta_pdf_chunks").groupBy("docId").count().count()
    assert ids() == 3 and store.read("delta_pdf_docs").count() == 4
    before = store.read("delta_pdf_chunks").count()
    pruned = run_once(store, docs(spark, a="x" * 18), "m", "1", options=Options(window=20, overlap=5, prune=True), now_ms=4)
    after = store.read("delta_pdf_chunks")
    assert pruned["docs_new_or_changed"] == 1 and after.count() < before
    assert store.read("delta_embeddings").join(after, "chunkId", "left_anti").count() == 0
    # a new model embeds nothing of unchanged documents unless all chunks are in scope
    assert run_once(store, docs(spark, a="x" * 18), "m2", "1", options=SMALL, now_ms=5)["embeddings_new"] == 0
    all_ = run_once(store, docs(spark, a="x" * 18), "m2", "1", options=Options(window=20, overlap=5, embed_all=True), now_ms=6)
    assert all_["embeddings_new"] == after.count()
    assert store.read("run_metrics").count() == 6 and store.read("run_metrics").schema == schemas.RUN_METRICS
    assert show_tables(store)["delta_pdf_docs"][0] == 4
    fresh = run_once(store, docs(spark, z="only"), "m", "1", options=SMALL, reindex=True, now_ms=7)
    assert fresh["docs_new_or_changed"] == 1 and store.read("delta_pdf_docs").count() == store.read("run_metrics").count() == 1


def test_one_changed_document_is_one_bucket_of_each_table(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s", buckets=8)
    texts = {f"d{k}": f"text number {k}" for k in range(40)}
    run_once(store, docs(spark, **texts), "m", "1", options=Options(batch=8), now_ms=1)
    before = store.versions()
    run_once(store, docs(spark, **(texts | {"d7": "another text"})), "m", "1", options=Options(batch=8, database="rag_p"), now_ms=2)
    after = store.versions()
    for name in ("delta_pdf_docs", "delta_pdf_chunks", "delta_embeddings"):
        changed = [b for b, p in after[name]["paths"].items() if before[name]["paths"].get(b) != p]
        assert len(changed) <= (2 if name == "delta_embeddings" else 1), name
    assert store.read("delta_pdf_docs").count() == 40 and spark.table("rag_p.retrieval_index_2").count() == store.read("retrieval_index_2").count()
    spark.sql("DROP DATABASE rag_p CASCADE")


def test_empty_corpus(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    row = run_once(store, docs(spark, a="x").limit(0), "m", "1", now_ms=1)
    assert row["noop_run"] and row["bytes_scanned"] == 0 and store.read("retrieval_index_1").count() == 0
    assert show_tables(TableStore(spark, f"file://{tmp_path}/none")) == {}


def test_failed_extraction(spark, tmp_path):
    folder = tmp_path / "pdfs"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(write_pdf(["A title\nand text that is good"]))
    store = TableStore(spark, f"file://{tmp_path}/s")
    run_once(store, documents_of_folder(spark, str(folder)), "m", "1", now_ms=1)
    assert store.read("delta_pdf_docs").first().title == "A title"
    (folder / "a.pdf").write_bytes(b"broken")
    kept = run_once(store, documents_of_folder(spark, str(folder)), "m", "1", options=Options(skip_failed=True), now_ms=2)
    assert kept["docs_new_or_changed"] == 0 and store.read("delta_pdf_docs").first().text != ""
    run_once(store, documents_of_folder(spark, str(folder)), "m", "1", now_ms=3)
    assert store.read("delta_pdf_docs").first().text == ""


def test_stream_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "pdfs"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(write_pdf(["first file"]))
    store = TableStore(spark, f"file://{tmp_path}/s")
    go = lambda: follow(spark, str(folder), store, str(tmp_path / "cp"), "m", "1", once=True).awaitTermination(120)
    go()
    (folder / "b.pdf").write_bytes(write_pdf(["second file"]))
    go()
    go()
    runs = [r.docs_scanned for r in store.read("run_metrics").orderBy("run_ts").collect()]
    assert runs == [1, 1] and store.read("delta_pdf_docs").count() == 2
