"""Readers and sinks. Reads pass a schema where the catalog has one; a write is a new snapshot or an append."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema


def read(spark: SparkSession, path: str, name: str, layer: str = "silver", format: str = "parquet", **options) -> DataFrame:
    """A catalog or upstream table from Parquet, JSON, CSV or another Spark source, in one partitioned scan."""
    return spark.read.schema(schema(name, layer)).options(**options).format(format).load(path)


def keys(table: DataFrame, *columns: str) -> DataFrame:
    """Key columns only, where all are given; the scan reads no other column."""
    out = table.select(*columns)
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    return out


def confirmed(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_status") == "confirmed")


def with_coordinates(venues: DataFrame) -> DataFrame:
    return venues.where(F.col("lat").isNotNull())


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a new snapshot directory (never the one being read) and read it again."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test tables in the catalog's shape; integer arithmetic only, so that engines agree."""
    t = lambda n: driver_table(spark, sf_dir, n)
    s = lambda c: F.col(c).cast("string")
    if name == "venue":
        id_ = F.col("s_suppkey")
        some = id_ % 10 != 0
        return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            id_.alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"),
            F.when(some, 14.35 + (id_ * 7919 % 4500).cast("double") / 10000).alias("lat"),
            F.when(some, 120.85 + (id_ * 104729 % 3000).cast("double") / 10000).alias("lng"),
        )
    if name == "source_post":
        code = F.concat(F.lit("P"), s("doc_id"))
        return t("documents").select(
            F.col("doc_id").alias("id"), code.alias("shortcode"), F.concat(F.lit("https://example.com/p/"), code, F.lit("/")).alias("post_url"),
            F.col("text").alias("caption"), F.col("n_chars").alias("likes_count"), (F.col("n_chars") % 97).alias("comments_count"),
        )
    if name == "event":
        k, p = F.col("o_orderkey"), F.col("o_orderpriority")
        sizes = F.broadcast(t("documents").agg(F.count("*").alias("docs")).join(t("supplier").agg(F.count("*").alias("suppliers"))))  # one row
        kind = F.when(p == "1-URGENT", "music").when(p == "2-HIGH", "nightlife").when(p == "3-MEDIUM", "food").when(p == "4-NOT SPECIFIED", "markets").otherwise("other")
        status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "tentative").otherwise("cancelled")
        pad = lambda c: F.lpad(c.cast("string"), 2, "0")
        v = catalog_view(spark, sf_dir, "venue").select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), F.col("lat").alias("venue_lat"), F.col("lng").alias("venue_lng"))
        return t("orders").join(sizes).join(v, k * 31 % F.col("suppliers") == F.col("venue_id")).select(
            k.alias("id"), F.col("o_custkey").alias("source_account_id"), (k % F.col("docs")).alias("source_post_id"),
            F.concat(p, F.lit(" night "), (k % 50).cast("string")).alias("title"), F.col("o_orderdate").cast("date").alias("event_date"),
            F.when(k % 5 != 0, F.concat(pad(k % 24), F.lit(":"), pad(k * 7 % 60))).alias("event_time"),
            "venue_id", "venue_name", "venue_lat", "venue_lng", (k % 6 == 0).alias("is_free"), F.col("o_totalprice").alias("price"),
            kind.alias("category"), status.alias("event_status"), ((k % 100).cast("double") / 100).alias("completeness_score"),
            ((k * 13 % 100).cast("double") / 100).alias("confidence"), F.col("o_orderdate").alias("created_at"),
        )
    if name == "sub_event":
        flag = F.col("l_returnflag")
        return t("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("event_id"),
            F.concat(F.lit("act "), s("l_partkey")).alias("title"), F.col("l_shipdate").cast("date").alias("event_date"),
            F.when(flag == "A", "performer").when(flag == "R", "live set").otherwise("screening").alias("description"),
        )
    if name == "toggle":
        kept = t("events").where(F.col("event_type").isin("click", "purchase"))
        return kept.select(F.col("event_id").alias("action_id"), F.col("user_id").alias("account_id"), F.get_json_object("props", "$.k").cast("long").alias("event_id"), "ts")
    if name == "dedup":
        k = F.col("p_partkey")
        day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 5).cast("int"))
        suppliers = F.broadcast(t("supplier").agg(F.count("*").alias("suppliers")))  # one row
        v = catalog_view(spark, sf_dir, "venue").select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
        title = F.concat(F.when(k % 3 == 0, "The ").otherwise(""), F.col("p_name"), F.lit(" - "), F.lower("p_type"), F.lit(" "), F.col("p_brand"))
        return t("part").join(suppliers).join(v, k * 31 % F.col("suppliers") == F.col("venue_id")).select(
            k.alias("id"), title.alias("title"), "venue_name", day.alias("event_date"), F.when(k % 4 != 0, F.date_add(day, (F.col("p_size") % 3).cast("int"))).alias("event_end_date"),
            ((k * 7 % 100).cast("double") / 100).alias("completeness_score"), ((k * 3 % 10).cast("double") / 10).alias("confidence"), day.cast("timestamp").alias("created_at"), F.lit("confirmed").alias("event_status"),
        )
    raise ValueError(name)


#: The same views as DuckDB SQL.
VIEW_SQL = {
    "venue": """SELECT s_suppkey AS id, s_name AS name, n_name AS city,
       CASE WHEN s_suppkey % 10 <> 0 THEN 14.35e0 + CAST((s_suppkey * 7919) % 4500 AS DOUBLE) / 10000e0 END AS lat,
       CASE WHEN s_suppkey % 10 <> 0 THEN 120.85e0 + CAST((s_suppkey * 104729) % 3000 AS DOUBLE) / 10000e0 END AS lng
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "source_post": """SELECT doc_id AS id, concat('P', doc_id) AS shortcode, concat('https://example.com/p/P', doc_id, '/') AS post_url,
       text AS caption, n_chars AS likes_count, n_chars % 97 AS comments_count FROM documents""",
    "event": """SELECT o.o_orderkey AS id, o.o_custkey AS source_account_id, o.o_orderkey % n.docs AS source_post_id,
       concat(o.o_orderpriority, ' night ', o.o_orderkey % 50) AS title, CAST(o.o_orderdate AS DATE) AS event_date,
       CASE WHEN o.o_orderkey % 5 <> 0 THEN concat(lpad(CAST(o.o_orderkey % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST((o.o_orderkey * 7) % 60 AS VARCHAR), 2, '0')) END AS event_time,
       v.id AS venue_id, v.name AS venue_name, v.lat AS venue_lat, v.lng AS venue_lng, o.o_orderkey % 6 = 0 AS is_free, o.o_totalprice AS price,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'music' WHEN '2-HIGH' THEN 'nightlife' WHEN '3-MEDIUM' THEN 'food' WHEN '4-NOT SPECIFIED' THEN 'markets' ELSE 'other' END AS category,
       CASE o.o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'tentative' ELSE 'cancelled' END AS event_status,
       CAST(o.o_orderkey % 100 AS DOUBLE) / 100e0 AS completeness_score, CAST((o.o_orderkey * 13) % 100 AS DOUBLE) / 100e0 AS confidence, o.o_orderdate AS created_at
  FROM orders o CROSS JOIN (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM supplier) AS sup) n JOIN fx_venue v ON v.id = (o.o_orderkey * 31) % n.sup""",
    "sub_event": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS event_id, concat('act ', l_partkey) AS title, CAST(l_shipdate AS DATE) AS event_date,
       CASE l_returnflag WHEN 'A' THEN 'performer' WHEN 'R' THEN 'live set' ELSE 'screening' END AS description FROM lineitem""",
    "toggle": """SELECT event_id AS action_id, user_id AS account_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS event_id, ts FROM events WHERE event_type IN ('click', 'purchase')""",
    "dedup": """SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END, p_name, ' - ', lower(p_type), ' ', p_brand) AS title, v.name AS venue_name,
       DATE '2026-01-01' + CAST(p_partkey % 5 AS INTEGER) AS event_date,
       CASE WHEN p_partkey % 4 <> 0 THEN DATE '2026-01-01' + CAST(p_partkey % 5 + p_size % 3 AS INTEGER) END AS event_end_date,
       CAST((p_partkey * 7) % 100 AS DOUBLE) / 100e0 AS completeness_score, CAST((p_partkey * 3) % 10 AS DOUBLE) / 10e0 AS confidence
  FROM part CROSS JOIN (SELECT count(*) AS sup FROM supplier) n JOIN fx_venue v ON v.id = (p_partkey * 31) % n.sup""",
}


def sql(body: str, *views: str) -> str:
    """DuckDB SQL with the views it uses in front."""
    order = [v for v in VIEW_SQL if v in views or (v == "venue" and ("event" in views or "dedup" in views))]
    body = body.strip()
    with_ = ",\n".join(f"fx_{v} AS (\n  {VIEW_SQL[v]})" for v in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{with_},\n{body[len(start):]}"
    return f"WITH {with_}\n{body}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a folder of our own only where
    the session names none and runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of intermediate tables that this driver has written and not deleted.
_WRITTEN: list[str] = []


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step to the shared folder and read it: plans stay short, and a lost executor
    doesn't bring the steps before back. :func:`clean` deletes such tables."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; how many. Call it once the results that were made of
    them are written: what is still to be computed from one fails afterwards."""
    n = len(_WRITTEN)
    while _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n
