from __future__ import annotations

import json
import zlib

import pytest

from cairn.config import load
from cairn.functions.text import PAGE_BREAK
from cairn.sources.files import chunks_of_file, extract, extract_or_none, extract_texts, pdf_pages, scan_files, write_pdf
from cairn.sources.storage import Conflict, TableStore, list_tables, recreate_database, save_table, table_exists
from tests.conftest import rows


def test_extract_pages():
    for compress in (False, True):
        pages = ["First (page) \\ line\nsecond line", "Zweite Seite äöü"]
        assert pdf_pages(write_pdf(pages, compress)) == pages
        assert extract(write_pdf(pages, compress)) == (PAGE_BREAK.join(pages), "Successfully extracted text from 2 pages.")


@pytest.mark.parametrize("data", [None, b"", b"no pdf", b"%PDF-1.4 nothing"])
def test_extract_never_raises(data):
    text, debug = extract(data)
    assert text == "" and debug.startswith("Error extracting text from PDF") and extract_or_none(data) is None


def test_scan(spark, tmp_path):
    for name, pages in (("a.pdf", ["one"]), ("b.PDF", ["two"]), ("c.pdf", None)):
        (tmp_path / name).write_bytes(write_pdf(pages) if pages else b"broken")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/d.pdf").write_bytes(write_pdf(["four"]))
    assert scan_files(spark, str(tmp_path)).count() == 2
    assert scan_files(spark, str(tmp_path), recursive=True).count() == 3
    got = {r.path.rsplit("/", 1)[1]: r for r in extract_texts(scan_files(spark, str(tmp_path)), 2).collect()}
    assert got["a.pdf"].text == "one" and got["c.pdf"].text == "" and got["c.pdf"].length == 6


def test_chunks_of_a_file(tmp_path):
    (tmp_path / "a.pdf").write_bytes(write_pdf(["x" * 30]))
    assert [c[:2] for c in chunks_of_file(str(tmp_path / "a.pdf"), 20, 5)] == [(0, 20), (15, 30)]
    assert chunks_of_file(str(tmp_path / "none.pdf")) is None


def _object_stream_pdf():
    """A file as common writers make it: objects packed and deflated, codes of two bytes, a table for them."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0047> <0002> <00FC> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<00660069> <4E2D>] endbfrange"
    content = b"BT /F1 12 Tf 40 700 Td <000100020010> Tj 0 -14 Td [<00110012> -500 <00200021>] TJ ET"
    packed = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 4 0 R >> >> >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"), (4, b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>")]
    head, body = b"", b""
    for n, x in packed:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    inside = zlib.compress(head + body)

    def stream(n, data, extra=b""):
        z = zlib.compress(data)
        return b"%d 0 obj\n<< /Length %d /Filter /FlateDecode%s >>\nstream\n" % (n, len(z), extra) + z + b"\nendstream\nendobj\n"

    pack = b"7 0 obj\n<< /Type /ObjStm /N 4 /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(head), len(inside)) + inside + b"\nendstream\nendobj\n"
    return b"%PDF-1.5\n" + stream(5, content) + stream(6, cmap) + pack + b"startxref\n0\n%%EOF\n"


def test_packed_objects_and_font_tables():
    assert extract(_object_stream_pdf()) == ("Güa\nbc ﬁ中".replace("ﬁ", "fi"), "Successfully extracted text from 1 pages.")
    text, debug = extract(_object_stream_pdf() + b"trailer << /Encrypt 9 0 R >>")
    assert text == "" and debug.startswith("Error") and "encrypted" in debug


def test_store_publishes_together(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    assert store.tables() == [] and store.read_or_none("x") is None
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tx = store.begin()
    tx.overwrite("x", df)
    assert not store.exists("x")
    tx.commit()
    late = store.begin()
    tx = store.begin()
    tx.merge("x", spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    tx.append("log", df)
    tx.append("log", df)
    assert rows(store.read("x")) == [(1, "a")]
    tx.commit()
    assert rows(store.read("x")) == [(1, "b"), (2, "c")] and store.read("log").count() == 2
    late.overwrite("x", df)
    with pytest.raises(Conflict):
        late.commit()
    with pytest.raises(ValueError):
        store.begin().merge("x", spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), ["k"])


def test_writers_that_do_not_meet_both_publish(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    one, two = store.begin(), store.begin()
    one.overwrite("x", df)
    one.append("log", df)
    two.overwrite("y", df)
    two.append("log", df)
    one.commit()
    two.commit()
    assert store.tables() == ["log", "x", "y"] and store.read("log").count() == 2


def _folders(path):
    return sorted(str(p.parent.relative_to(path)) for p in path.rglob("*.parquet"))


def test_a_merge_writes_only_the_buckets_it_changes(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s", buckets=16)
    kind = "k string, g string, v int"
    plain = {f"k{i}": ("g%d" % (i % 9), i) for i in range(200)}
    tx = store.begin()
    tx.merge("t", spark.createDataFrame([(k, *v) for k, v in plain.items()], kind), ["k"], by="g")
    tx.commit()
    before = store.versions()["t"]["paths"]
    for rows_ in ([("k3", "g3", -1)], [("new", "other", 7)], [(None, None, 1)], []):
        tx = store.begin()
        tx.merge("t", spark.createDataFrame(rows_, kind), ["k"], by="g")
        tx.commit()
        plain |= {k: v for k, *v in rows_}
        after = store.versions()["t"]["paths"]
        assert sum(before.get(b) != p for b, p in after.items()) == len(rows_)
        before = after
        assert rows(store.read("t")) == sorted(((k, *v) for k, v in plain.items()), key=repr)
    tx = store.begin()
    tx.delete("t", spark.createDataFrame([("k3", "g3", 0), ("none", "g3", 0)], kind), ["k"], by="g")
    tx.commit()
    assert store.read("t").count() == len(plain) - 1


def test_vacuum(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s", buckets=4)
    for i in range(4):
        tx = store.begin()
        tx.merge("t", spark.createDataFrame([(j, i) for j in range(8)], "k int, v int"), ["k"])
        tx.append("log", spark.range(1))
        tx.commit()
    under_way = store.begin()
    kept = under_way.overwrite("t", spark.range(3))
    assert store.vacuum(keep=1) and store.vacuum(keep=1) == []
    assert rows(store.read("t")) == [(j, 3) for j in range(8)] and store.read("log").count() == 4 and kept.count() == 3
    assert len({f.split("/")[1] for f in _folders(tmp_path / "s") if f.startswith("t/")}) == 2


def test_a_snapshot_appears_with_the_commit(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    tx = store.begin()
    tx.publish_at("index", spark.range(3), f"file://{tmp_path}/snapshots/m/1")
    assert not (tmp_path / "snapshots/m/1").exists()
    tx.renames, kept = [], list(tx.renames)  # as if the writer died between publishing and renaming
    store._publish(tx.number, tx.new | {"#renames": kept})
    assert not (tmp_path / "snapshots/m/1").exists() and store.read("index").count() == 3 and (tmp_path / "snapshots/m/1").exists()


def test_catalog(spark):
    recreate_database(spark, "rag_t")
    save_table(spark.range(3), "rag_t", "x")
    assert table_exists(spark, "rag_t", "x") and not table_exists(spark, "nowhere", "x")
    assert list_tables(spark, "rag_t") == ["x"] and list_tables(spark, "nowhere") == []
    spark.sql("DROP DATABASE rag_t CASCADE")


def test_settings(tmp_path):
    raw = {"name": "n", "spark": {"master": "yarn"}, "embedding": {"batch": 4}, "environments": {"local": {"spark": {"master": "local[2]"}, "data": {"source": "here"}}}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(raw))
    local = load(path, "local")
    assert (local.spark.master, local.data.source, local.embedding.batch, local.embedding.timeout) == ("local[2]", "here", 4, 120.0)
    assert load(path, "other").spark.master == "yarn" and load().embedding.model == "mxbai-embed-large"
    assert load().embedding.url == "http://localhost:11434"
    with pytest.raises(TypeError):
        load({"spark": {"nonsense": 1}})
    toml = tmp_path / "s.toml"
    toml.write_text('name = "t"\n[environments.emr.spark]\nmaster = "yarn"\n')
    assert load(toml, "emr").spark.master == "yarn"
