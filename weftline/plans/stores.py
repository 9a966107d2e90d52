"""Scans and sinks as queries: what is written in a form is read back by its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import prefix
from weftline.plans.registry import query
from weftline.sources import tables
from weftline.sources.tables import fresh_path, table


def _daily(spark, sf_dir, folder, names):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    for name, day in names:
        tables.write_named(o.where(F.col("day") == day), folder, name)


DAYS = [("scores_1997-01-01.parquet", "1997-01-01"), ("scores_1997-01-02.parquet", "1997-01-02"), ("fees_1997-01-02.parquet", "1997-01-02"), ("other_1997-01-03.parquet", "1997-01-03"), ("scores_1997-01-04.pqt", "1997-01-04"), ("scores_1997-01-03.tmp", "1997-01-03")]


@query("directory_scan", "SELECT f AS file_name, o_orderkey, o_totalprice FROM orders JOIN (VALUES ('scores_1997-01-02.parquet', DATE '1997-01-02'), ('fees_1997-01-02.parquet', DATE '1997-01-02'), ('scores_1997-01-04.pqt', DATE '1997-01-04')) v(f, d) ON o_orderdate::DATE = d")
def directory_scan(spark, sf_dir):
    """Files by keywords, known endings and a date in the name, both ends included."""
    folder = fresh_path(spark, "daily")
    _daily(spark, sf_dir, folder, DAYS)
    return tables.named_between(spark, folder, ["scores", "fees"], "1997-01-02", "1997-01-04").select("file_name", "o_orderkey", "o_totalprice")


@query("multi_file_scan", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority FROM orders")
def multi_file_scan(spark, sf_dir):
    """Files of differing columns by name; one that can't be read is skipped."""
    folder = fresh_path(spark, "files")
    o = table(spark, sf_dir, "orders")
    o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").write.parquet(f"{folder}/a")
    o.where("o_orderstatus = 'P'").select("o_totalprice", "o_orderkey").write.parquet(f"{folder}/b")
    o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority").write.parquet(f"{folder}/c")
    spark.range(1).select(F.lit("this is no table")).write.text(f"{folder}/d")
    return tables.files(spark, [f"{folder}/{x}" for x in "abcd"]).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("load_by_format", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def load_by_format(spark, sf_dir):
    """One after another by the loader that the caller names, then together."""
    folder = fresh_path(spark, "formats")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.where("o_orderstatus = 'P'").drop("o_orderstatus").write.orc(f"{folder}/p")
    o.where("o_orderstatus = 'F'").drop("o_orderstatus").write.json(f"{folder}/f")
    got = [tables.files(spark, [f"{folder}/p"], "orc"), tables.files(spark, [f"{folder}/f"], "json")]
    return got[0].unionByName(got[1], allowMissingColumns=True).select("o_orderkey", "o_totalprice")


@query("partition_scan", "SELECT o_orderkey, o_orderstatus AS status, strftime(o_orderdate, '%Y') AS year FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) = 1997")
def partition_scan(spark, sf_dir):
    """Partitions by equality; the values parsed from the path are the columns' own."""
    path = fresh_path(spark, "partitioned")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy").alias("year"))
    tables.write_partitions(o, path, ["status", "year"])
    found = spark.read.option("basePath", path).parquet(path).where("status = 'P' AND year = 1997")
    values = tables.partition_values(F.col("_metadata.file_path"))
    return found.select("o_orderkey", values["status"].alias("status"), values["year"].alias("year"))


@query("csv_round_trip", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN '(25.0, inf]' ELSE '(-inf, 25.0]' END AS bin, 'größe, \"x\"' AS note FROM lineitem")
def csv_round_trip(spark, sf_dir):
    """With a byte order mark; intervals as text."""
    path = fresh_path(spark, "csv")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, "(25.0, inf]").otherwise("(-inf, 25.0]").alias("bin"), F.lit('größe, "x"').alias("note"))
    tables.write_csv(x, path)
    return tables.read_csv(spark, path, "l_orderkey bigint, l_linenumber int, bin string, note string")


@query("sql_store_scan", "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def sql_store_scan(spark, sf_dir):
    """A SQL store's answer to a statement, ids kept as text. The store here is in the driver's own process."""
    import uuid

    url = f"jdbc:derby:memory:w{uuid.uuid4().hex};create=true"
    options = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("NAME"), F.col("c_mktsegment").alias("SEGMENT"))
    c.coalesce(1).write.format("jdbc").options(**options).option("dbtable", "CUSTOMER").option("createTableColumnTypes", "NAME VARCHAR(64), SEGMENT VARCHAR(32)").save()
    got = tables.jdbc(spark, "SELECT ID, NAME FROM CUSTOMER WHERE SEGMENT = 'BUILDING'", options, "ID STRING")
    return got.select(F.col("ID").alias("id"), F.col("NAME").alias("name"))


def _stubborn():
    """A client that fails twice before it answers, and always for one host."""
    seen: dict[str, int] = {}

    def ask(row: dict) -> str:
        seen[row["url"]] = seen.get(row["url"], 0) + 1
        if "example.net" in row["url"]:
            raise ValueError("refused")
        if seen[row["url"]] % 3:
            raise ValueError("try again")
        return row["url"].upper()

    return ask


@query("fetch_per_row", "SELECT page_id, CASE WHEN page_id % 7 = 0 OR url LIKE '%example.net%' THEN NULL ELSE upper(url) END AS response, CASE WHEN page_id % 7 = 0 THEN 'no address' WHEN url LIKE '%example.net%' THEN 'refused' END AS error FROM (SELECT page_id, url || '&id=' || page_id AS url FROM pages)")
def fetch_per_row(spark, sf_dir):
    """A client per task, three tries, addresses checked first; rows that fail stay."""
    url = F.when(F.col("page_id") % 7 == 0, F.lit("nowhere")).otherwise(F.concat("url", F.lit("&id="), F.col("page_id").cast("string")))
    return tables.fetch(table(spark, sf_dir, "pages").select("page_id", url.alias("url")), "url", _stubborn).select("page_id", "response", "error")


_KEYS_SQL = "SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN page_id % 5 = 0 THEN 'page-' || page_id || '.jpg' ELSE 'page-' || page_id || '.html' END AS key FROM pages"


def _objects(spark, sf_dir, folder):
    """Every page as an object of the second bucket, every third page's address as one of the first; keys of all pages and of others that no bucket has."""
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, ".jpg").otherwise(".html"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), name.alias("key"))
    tables.put_objects(pages.where("page_id % 3 = 0"), "key", "url", f"{folder}/one")
    tables.put_objects(pages, "key", "html", f"{folder}/two")
    return pages


@query("object_fetch", f"WITH p AS ({_KEYS_SQL}) SELECT key, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END::INT AS bucket, octet_length(encode(CASE WHEN page_id % 3 = 0 THEN url ELSE html END))::BIGINT AS n_bytes, CASE WHEN page_id % 5 <> 0 THEN md5(CASE WHEN page_id % 3 = 0 THEN url ELSE html END) END AS text_md5 FROM p")
def object_fetch(spark, sf_dir):
    """The first bucket that has an object answers; pictures stay bytes; a key that none has gives no row."""
    folder = fresh_path(spark, "store")
    pages = _objects(spark, sf_dir, folder)
    keys = pages.select("key").unionByName(pages.select(F.concat(F.lit("no-"), "key").alias("key")))
    got = tables.binary_objects(spark, [f"{folder}/one", f"{folder}/two"], keys, "key")
    return got.select("key", "bucket", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


@query("url_fetch", f"WITH p AS ({_KEYS_SQL}) SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 7 <> 0 THEN md5(url) END AS response_md5, CASE WHEN page_id % 7 = 0 THEN 'no address' WHEN page_id % 3 <> 0 THEN 'failed' END AS error FROM p")
def url_fetch(spark, sf_dir):
    """What each page's address answers, three tries each: objects of the shared folder by their own addresses, some that are missing and some that are no addresses."""
    folder = fresh_path(spark, "store")
    pages = _objects(spark, sf_dir, folder)
    base = folder if "://" in folder.replace("file:///", "") else "file://localhost" + folder.removeprefix("file:").replace("///", "/")
    url = F.when(F.col("page_id") % 7 == 0, F.col("key")).otherwise(F.concat(F.lit(f"{base}/one/"), "key"))
    got = tables.fetch(pages.select("page_id", url.alias("url")), "url", tables.url_client)
    return got.select("page_id", F.md5("response").alias("response_md5"), F.when(F.col("error") == "no address", F.col("error")).when(F.col("error").isNotNull(), "failed").alias("error"))


PAGE_ROWS = 50


@query("paged_scan", f"SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // {PAGE_ROWS} + 1 AS page, c_custkey, c_name FROM customer")
def paged_scan(spark, sf_dir):
    """A paged listing of the customers: each task asks for its own pages by their numbers, a page after the other."""
    import json

    folder = fresh_path(spark, "listing")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    total = c.count()
    placed = prefix.running(c.withColumn("one", F.lit(1)), "c_custkey", {"place": "one"}).withColumn("page", F.floor((F.col("place") - 1) / PAGE_ROWS) + 1)
    body = placed.groupBy("page").agg(F.to_json(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name")))).alias("body"))  # PAGE_ROWS rows
    tables.put_objects(body.withColumn("key", F.concat(F.col("page").cast("string"), F.lit(".json"))), "key", "body", folder)

    def client():
        files, top = tables.store_of(folder)

        def ask(page: int) -> list[dict]:
            with files.open_input_stream(f"{top}/{page}.json") as f:
                return [{"page": page, **row} for row in json.loads(f.read())]

        return ask

    return tables.paged(spark, total, PAGE_ROWS, client, "page bigint, c_custkey bigint, c_name string")


@query("backfill_slices", "SELECT o_orderkey % 4 AS slice, strftime(o_orderdate, '%Y') AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL")
def backfill_slices(spark, sf_dir):
    """Ids in slices, each slice built, cut to its columns and written to its partition; a slice that is there already is left alone."""
    path = fresh_path(spark, "slices")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy").alias("year"), (F.col("o_orderkey") % 4).alias("slice"))
    tables.write_partitions(o.where("slice < 2"), path, ["slice"])
    wanted = o.select("slice").distinct()
    left = tables.work_list(wanted, spark.read.parquet(path).select("slice").distinct(), ["slice"])
    tables.write_partitions(o.join(F.broadcast(left), "slice"), path, ["slice"])  # a handful of slices
    return spark.read.parquet(path).select(F.col("slice").cast("long").alias("slice"), F.col("year").cast("string").alias("year"), "o_totalprice").groupBy("slice", "year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
