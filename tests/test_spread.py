"""Rows that become pages are dealt to as many tasks as they need, whatever files they lie in."""

from pyspark.sql import functions as F

from crawlsift import sources
from crawlsift.extract.markup import attr
from crawlsift.operators.links import classify_link
from crawlsift.plans import synthetic as S


def test_rows_of_one_file_become_pages_in_many_tasks(spark, tmp_path):
    n = 3 * sources.TASK_ROWS + 10
    customers = spark.range(n).selectExpr("if(id % 10 = 0, NULL, id % 4000) AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey")
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    pages = S.linked_pages(spark, str(tmp_path))
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == n and max(sizes) <= 1.1 * sources.TASK_ROWS  # also with keys that repeat or are null
    want = customers.selectExpr("c_custkey AS page_id").groupBy("page_id").count()
    assert pages.groupBy("page_id").count().exceptAll(want).count() == 0


def test_few_rows_are_not_dealt(spark, tmp_path):
    spark.range(50).selectExpr("id AS s_suppkey", "'s' AS s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert S.review_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_an_attribute_is_found_however_it_is_written(spark):
    tags = [("<A HREF=/x>", "/x"), ("<a data-href=1 Href='y'>", "y"), ("<a data-href=1>", None), ("<a title='href'>", None), ("<a href>", ""), (None, None)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(tags)], "i int, tag string, want string")
    assert rows.where(f"NOT ({attr('tag', 'href')} <=> want)").count() == 0


def test_kinds_of_links_without_an_address(spark):
    links = [("#a", None, "anchor"), (" MAILTO:x", None, "mailto"), ("x", None, "other"), ("x", "", "other"), ("x", "https://h.example/x", "internal"),
             ("x", "https://h.example:444/x", "external"), (None, "https://o.example/", "external"), (None, None, "other"), ("x", "https://", "other")]
    rows = spark.createDataFrame(links, "raw string, href string, want string").selectExpr("*", "'https://h.example' AS origin")
    assert rows.where(f"NOT ({classify_link('raw', 'href', 'origin')} <=> want)").count() == 0
