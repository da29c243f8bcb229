"""Documents as files: a round trip, names, and tasks that fail or run twice."""

import os
import tarfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from crawlsift.extract.markup import parse_pages
from crawlsift.operators.markdown import page_markdown
from crawlsift.sinks.documents import DocumentWriter, document_names, read_documents, write_documents


def test_ten_thousand_documents_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    texts = spark.range(10_000).selectExpr("id AS page_id", "concat('https://h', id % 7, '.example.com/p/', id) AS url", "if(id % 100 = 0, '', concat('# Téxt ', id, '\\n', repeat('x', CAST(id % 50 AS INT)))) AS text")
    named = document_names(texts, "page", "md", "DATE'2024-01-02'").repartition(6)
    write_documents(named, path)
    got = read_documents(spark, path)
    assert got.count() == got.select("name").distinct().count() == 10_000
    assert got.exceptAll(named.select("name", "text")).count() == 0
    assert got.where("name = 'h3.example.com/page-h3-example-com-2024-01-02-10.md'").first().text == "# Téxt 10\n" + "x" * 10
    bundles = [f for f in os.listdir(path) if f.endswith(".tar")]
    assert len(bundles) == 6 and "_SUCCESS" in os.listdir(path) and not os.listdir(f"{path}/_attempts")
    with tarfile.open(f"{path}/{bundles[0]}") as tar:  # any tool opens them
        assert all(m.name.endswith(".md") for m in tar.getmembers())
    write_documents(named.limit(3), path, mode="overwrite")
    assert read_documents(spark, path).count() == 3


def test_markdown_of_pages_as_documents(spark, page, tmp_path):
    docs = page_markdown(parse_pages(page("<h1>A</h1>", "<h1>B</h1><p>x")))
    write_documents(document_names(docs, "markdown", "md", "DATE'2024-01-02'"), str(tmp_path / "md"), "markdown")
    assert {r.name: r.text for r in read_documents(spark, str(tmp_path / "md")).collect()} == {
        "example.com/markdown-example-com-2024-01-02-1.md": "# A\n", "example.com/markdown-example-com-2024-01-02-2.md": "# B\n\nx\n"}


def test_an_attempt_that_does_not_count_leaves_nothing(tmp_path):
    path = str(tmp_path / "out")
    writer = DocumentWriter(path, False)
    rows = [Row(name=f"{i}.md", text=str(i)) for i in range(5)]
    lost = writer.write(iter(rows))  # its executor is lost, or a second attempt overtakes it

    def broken():
        yield rows[0]
        raise OSError("disk")

    with pytest.raises(OSError):
        writer.write(broken())
    kept = writer.write(iter(rows))
    writer.commit([kept, None])
    bundles = [f for f in os.listdir(path) if f.endswith(".tar")]
    assert len(bundles) == 1 and not os.path.exists(lost.file) and not os.listdir(f"{path}/_attempts")
    with tarfile.open(f"{path}/{bundles[0]}") as tar:
        assert tar.getnames() == [f"{i}.md" for i in range(5)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(100).repartition(4).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), F.expr("if(id = 77, raise_error('stop'), 'x')").alias("text"))
    with pytest.raises(Exception, match="stop"):
        write_documents(bad, path)
    assert not [f for f in os.listdir(path) if f.endswith(".tar") or f == "_SUCCESS"] and not os.listdir(f"{path}/_attempts")


def test_no_documents(spark, tmp_path):
    write_documents(spark.createDataFrame([], "name string, text string"), str(tmp_path / "none"))
    assert read_documents(spark, str(tmp_path / "none")).count() == 0
