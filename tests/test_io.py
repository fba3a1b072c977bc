import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import render
from corpusforge.sinks import writers
from corpusforge.sources import files


@pytest.fixture
def qa(spark):
    rows = [("a", 1, 'q "1", é\nx', "a1"), ("a", 2, "q2 <&>", ""), ("b", 1, "q3", "a3")]
    return spark.createDataFrame(rows, "stem string, at int, question string, answer string")


def numbered(qa):
    return render.number_items(qa, ["stem"], ["at"]).drop("at")


def document(folder, stem):
    parts = sorted((folder / f"stem={stem}").glob("part-*"))
    return "".join(p.read_text("utf-8") for p in parts)


def test_jsonl_round_trip(spark, qa, tmp_path):
    writers.write_jsonl(qa, str(tmp_path / "out"))
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "é" in text and len(text.splitlines()) == 3
    back = spark.read.schema(qa.schema).json(str(tmp_path / "out"))
    assert back.exceptAll(qa).count() == 0 and back.count() == 3


def test_csv_round_trip(spark, qa, tmp_path):
    nested = qa.withColumn("list", F.array(F.lit(1), F.lit(2)))
    writers.write_csv(nested, str(tmp_path / "out"))
    back = spark.read.options(header="true", quote='"', escape='"', multiLine="true").csv(str(tmp_path / "out"))
    assert back.columns == ["answer", "at", "list", "question", "stem"]
    assert {r["question"] for r in back.collect()} == {r["question"] for r in qa.collect()}
    assert {r["list"] for r in back.collect()} == {"[1,2]"}


def test_xml_round_trip(spark, qa, tmp_path):
    writers.write_xml(qa.withColumnRenamed("at", "_id"), str(tmp_path / "out"), "qa_pairs", "qa_pair")
    back = spark.read.format("xml").option("rowTag", "qa_pair").load(str(tmp_path / "out"))
    assert {(r["_id"], r["stem"]) for r in back.collect()} == {(1, "a"), (2, "a"), (1, "b")}


def test_markdown_document(qa, tmp_path):
    writers.write_documents(render.render_blocks(numbered(qa), ["stem"], "qa_pairs", "markdown"), str(tmp_path / "md"), ["stem"])
    assert document(tmp_path / "md", "b") == (
        "# Q&A Training Data\n\n**Total Q&A pairs:** 1\n\n## Q&A Pair 1\n\n**Q:** q3\n\n**A:** a3\n\n---\n\n"
    )


def test_text_document(qa, tmp_path):
    writers.write_documents(render.render_blocks(numbered(qa), ["stem"], "qa_pairs", "txt"), str(tmp_path / "txt"), ["stem"])
    assert document(tmp_path / "txt", "b") == (
        "QUESTION & ANSWER TRAINING DATA\n" + "=" * 50 + "\nTotal Q&A pairs: 1\n\nQ&A PAIR 1\n" + "-" * 20
        + "\nQUESTION: q3\n\nANSWER: a3\n\n" + "=" * 50 + "\n\n"
    )


def test_json_and_xml_documents_parse(qa, tmp_path):
    from xml.etree import ElementTree

    for fmt in ("json", "xml"):
        writers.write_documents(render.render_blocks(numbered(qa), ["stem"], "qa_pairs", fmt), str(tmp_path / fmt), ["stem"])
    assert json.loads(document(tmp_path / "json", "a")) == [{"question": 'q "1", é\nx', "answer": "a1"}, {"question": "q2 <&>", "answer": ""}]
    root = ElementTree.fromstring(document(tmp_path / "xml", "a"))
    assert root.tag == "qa_pairs" and root.get("count") == "2"
    assert [(e.get("id"), e.find("question").text) for e in root] == [("1", 'q "1", é\nx'), ("2", "q2 <&>")]


def test_other_kinds_render(spark):
    pairs = spark.createDataFrame([("d", 1, "s1", "s2", 0.9, "f.txt")], "doc string, item_no long, sentence1 string, sentence2 string, similarity double, source_file string")
    for fmt in ("txt", "markdown", "xml", "json", "jsonl"):
        text = "\n".join(r["block"] for r in render.render_blocks(pairs, ["doc"], "embeddings", fmt).orderBy("block_no").collect())
        assert "0.9" in text and "s2" in text and "f.txt" in text
    with pytest.raises(ValueError):
        render.render_blocks(pairs, ["doc"], "embeddings", "pdf")


def test_per_file_and_final(spark, qa, tmp_path):
    items = numbered(qa)
    writers.write_per_file_and_final(items, str(tmp_path), "b1", "qa_pairs", ["jsonl", "csv", "markdown"])
    writers.write_per_file_and_final(items, str(tmp_path), "b1", "qa_pairs", ["jsonl"])
    base = tmp_path / "data" / "b1"
    assert spark.read.json(str(base / "jsonl" / "final_qa_pairs")).count() == 6
    assert (base / "jsonl" / "qa_pairs" / "stem=a").is_dir() and (base / "markdown" / "qa_pairs" / "stem=b").is_dir()
    assert spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(base / "csv" / "final_qa_pairs")).count() == 3


def test_summary_log_and_report(spark, tmp_path):
    row = spark.createDataFrame([(1, 2)], "files_total int, files_failed int")
    path = writers.write_run_summary(row, str(tmp_path), "batch_summary", "20240101_000000")
    assert spark.read.json(path).first().asDict() == {"files_failed": 2, "files_total": 1}
    for _ in range(2):
        writers.write_run_log(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    writers.write_validation_report(row, row, str(tmp_path))
    assert spark.read.json(str(tmp_path / "validation_details")).count() == 1


def test_choose_format():
    assert writers.choose_format("csv", "x.json") == "csv"
    assert writers.choose_format(None, "x.JSON") == "json"
    assert writers.choose_format(None, "x.bin", "xml") == "xml"
    assert writers.choose_format(None, None, "qa_pairs") == "jsonl"
    with pytest.raises(ValueError):
        writers.choose_format("pdf")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("hél\r\nx".encode())
    (tmp_path / "sub" / "B.TXT").write_bytes(b"h\xe9l")
    (tmp_path / "c.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "d.docx").write_bytes(b"zip")
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="t/c{i}.html" media-type="application/xhtml+xml"/>' for i in (1, 2, 3))
        z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="i" href="i.png" media-type="image/png"/></manifest></package>')
        for i in (1, 2, 3):
            z.writestr(f"O/t/c{i}.html", f"<html><body><p>chapter <b>{i}</b></p></body></html>")
        z.writestr("O/i.png", b"12345")
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    return tmp_path


def names(df):
    return sorted(r["path"].rsplit("/", 1)[1] for r in df.select("path").collect())


def test_scan(spark, folder):
    assert names(files.scan_files(spark, str(folder))) == ["B.TXT", "a.txt", "bad.epub", "c.srt", "e.epub"]
    assert names(files.scan_files(spark, str(folder), [".txt"], recursive=False)) == ["a.txt"]
    assert names(files.scan_files(spark, str(folder), pattern="*.docx")) == ["d.docx"]
    assert names(files.scan_files(spark, str(folder), max_files=2)) == ["a.txt", "bad.epub"]
    assert names(files.scan_files(spark, str(folder / "a.txt"))) == ["a.txt"]
    plan = files.scan_files(spark, str(folder)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_read_text(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_text(files.scan_files(spark, str(folder))).collect()}
    assert got == {"a.txt": "hél\nx", "B.TXT": "hél", "c.srt": "Hi"}


def test_epub(spark, folder):
    members = files.read_epub(files.scan_files(spark, str(folder)))
    info = {r["path"].rsplit("/", 1)[1]: r for r in files.epub_info(members).collect()}
    assert (info["e.epub"]["chapter_count"], info["e.epub"]["image_count"], info["bad.epub"]["chapter_count"]) == (3, 1, 0)
    assert members.filter("kind = 'error'").count() == 1
    text = files.epub_text(members, skip=[2]).first()["text"]
    assert text == "=== Chapter 1 ===\n\nchapter 1\n\n\n\n=== Chapter 3 ===\n\nchapter 3"
    assert files.epub_text(members, start=2, end=2).first()["text"] == "=== Chapter 2 ===\n\nchapter 2"


def test_user_extractor(spark, folder):
    def extract(path, content):
        if content.startswith(b"h\xe9"):
            raise ValueError("bad bytes")
        return {"text": content.decode(), "images": [{"page_num": 1}]}

    reader = files.Extractor((".txt", ".srt"), extract)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract_batch(files.scan_files(spark, str(folder)), [reader], max_bytes=30).collect()}
    assert (got["a.txt"]["status"], got["a.txt"]["text"]) == ("ok", "hél\r\nx")
    assert json.loads(got["a.txt"]["images"]) == [{"page_num": 1}]
    assert (got["B.TXT"]["status"], got["B.TXT"]["error"]) == ("error", "bad bytes")
    assert got["c.srt"]["status"] == "too_large" and got["bad.epub"]["status"] == "unsupported"


def test_rerun_replaces_files_and_keeps_others(spark, tmp_path):
    from corpusforge.sinks import writers

    first = spark.createDataFrame([("a", 1, "q1", "r1"), ("b", 1, "q2", "r2")], "stem string, item_no long, question string, answer string")
    for rows in (first, first.filter("stem = 'a'")):
        writers.write_per_file_and_final(rows, str(tmp_path), "x", "qa_pairs", ["jsonl", "markdown"])
    back = spark.read.json(str(tmp_path / "data/x/jsonl/qa_pairs"))
    assert sorted(r["question"] for r in back.collect()) == ["q1", "q2"]
    text = spark.read.text(str(tmp_path / "data/x/markdown/qa_pairs/stem=a"), wholetext=True).collect()
    assert sum(r["value"].count("# Q&A") for r in text) == 2
    assert spark.read.json(str(tmp_path / "data/x/jsonl/final_qa_pairs")).count() == 3


@pytest.mark.parametrize("master, local", [("local", True), ("local[8]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_only_one_process_may_use_a_folder_of_its_own(master, local):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    from corpusforge.session import shared_dir

    conf = {"spark.master": master}
    session = MagicMock(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__))
    session.sparkContext.getCheckpointDir.return_value = None
    if local:
        assert shared_dir(session) == conf["spark.checkpoint.dir"]
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session)
