"""Further catalogue rows: lists, windows, embeddings, ingest and running counts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.security import metadata_problems, severity_weight
from ..operators import catalog
from ..operators.vectors import norm
from . import ingest as job
from .registry import query


@query("b4_document_list", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0' AND n_chars > 500")
def document_list(t):
    return t.documents.filter((F.col("lang") == "en") & (F.col("source") == "src0") & (F.col("n_chars") > 500)).select("doc_id")


@query("b7_category_filter", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) = 'nation_3' OR trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') = 'nation-7'")
def category_filter(t):
    slug = text.slugify(F.col("n_name"))
    nations = t.nation.filter((F.lower("n_name") == "nation_3") | (slug == "nation-7"))
    return t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")


@query("b9_chunking_route", r"SELECT page_id, CASE WHEN regexp_matches(url, '[^/.][^/]*\.[mM][dD]$') THEN 'markdown' ELSE 'recursive' END AS strategy FROM pages")
def chunking_route(t):
    return t.pages.select("page_id", text.chunking_strategy(F.col("url")).alias("strategy"))


@query("c8_pages_by_slug", "SELECT DISTINCT lower(n_name) AS slug FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def pages_by_slug(t):
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return t.nation.join(poor, "n_nationkey", "left_semi").select(F.lower("n_name").alias("slug")).distinct()


@query("c11_intent_weights", "SELECT s_suppkey, CASE n_regionkey WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def weights(t):
    names = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "other"))), F.col("n_regionkey") + 1)
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", severity_weight(names).alias("weight"))


@query("d4_tags_per_category", "SELECT s_nationkey AS value, count(*) AS n FROM supplier GROUP BY 1")
def tags_per_category(t):
    return catalog.count_by(t.supplier, "s_nationkey")


@query("d9_normalised_scores", "SELECT event_id, round(value / greatest(max(value) OVER (PARTITION BY event_type), 0.001), 6) AS score FROM events")
def normalised(t):
    return t.events.select("event_id", F.round(F.col("value") / F.greatest(F.max("value").over(W.partitionBy("event_type")), F.lit(0.001)), 6).alias("score"))


@query("d12_counters", "SELECT event_type AS metric, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def counters(t):
    return t.events.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("d15_distinct_lists", "SELECT user_id, list(event_type ORDER BY f, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def distinct_lists(t):
    firsts = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return firsts.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]).alias("kinds"))


@query("d16_actions_per_document", "SELECT user_id AS document_id, count(*) FILTER (WHERE event_type = 'signup') AS created, count(*) FILTER (WHERE event_type = 'click') AS updated, count(*) FILTER (WHERE event_type = 'error') AS contradictions FROM events GROUP BY 1")
def actions(t):
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.groupBy(F.col("user_id").alias("document_id")).agg(is_("signup").alias("created"), is_("click").alias("updated"), is_("error").alias("contradictions"))


@query("d17_page_total", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 25")
def page_total(t):
    return t.orders.orderBy("o_orderkey").limit(25).select("o_orderkey").crossJoin(F.broadcast(t.orders.agg(F.count("*").alias("total"))))  # one row


@query("e1_links", "SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER w AS before, lead(l_partkey) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def links(t):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.lag("l_partkey").over(w).alias("before"), F.lead("l_partkey").over(w).alias("after"))


@query("e6_rank_scores", "SELECT event_id, round(1 - (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1) / count(*) OVER (PARTITION BY user_id), 6) AS score FROM events")
def rank_scores(t):
    w = W.partitionBy("user_id")
    return t.events.select("event_id", F.round(1 - (F.row_number().over(w.orderBy(F.desc("value"), "event_id")) - 1) / F.count("*").over(w), 6).alias("score"))


@query("e8_append_index", "SELECT conv_id, turn, (SELECT count(*) FROM region) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def append_index(t):
    have = t.region.agg(F.count("*").alias("have"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.crossJoin(F.broadcast(have)).select("conv_id", "turn", (F.col("have") + n - 1).alias("position"))  # one row


@query("g1_union_distinct", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT vec_id FROM embeddings)")
def union_distinct(t):
    return t.labels.select("doc_id").union(t.embeddings.select("vec_id")).distinct()


@query("h31_metadata_problems", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN ['cve_id'] ELSE [] END || CASE WHEN value > 10 THEN ['cvss_score'] ELSE [] END AS problems FROM events")
def problems(t):
    cve = F.when(F.col("event_type").isin("view", "click"), "x").otherwise("CVE-2024-1")
    return t.events.select("event_id", metadata_problems(cve, F.lit("T1059"), F.col("value")).alias("problems"))


@query("k4_ingest")
def ingested(t):
    files = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", text.content_hash(F.col("text")).alias("file_hash"), F.lit(1).alias("modified_at"))
    stored = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), text.content_hash(F.col("text")).alias("file_hash"), F.lit(0).alias("updated_at"))
    return job.ingest(files, stored, F.current_timestamp(), 250)[0]


@query("k5_embeddings", "SELECT conv_id * 1000 + turn AS chunk_id, sha256('hashed:' || text) AS key, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END AS length, CAST(row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) = 1 AS INT) AS first FROM conversations")
def embeddings(t):
    chunks = t.conversations.select(F.struct("conv_id", "turn").alias("chunk_id"), F.col("text").alias("content"))
    found = job.embedded(chunks)
    # equal texts have one vector, of unit length unless a text has no words; what is no text has no key
    first = F.row_number().over(W.partitionBy("key", "embedding").orderBy("chunk_id")) == 1
    chunk_id, key = F.col("chunk_id.conv_id") * 1000 + F.col("chunk_id.turn"), F.nullif("key", F.sha2(F.lit("hashed"), 256))
    return found.select(chunk_id.alias("chunk_id"), key.alias("key"), F.round(norm(F.col("embedding")), 3).alias("length"), first.cast("int").alias("first"))


@query("l6_watch_registry", "SELECT DISTINCT event_type AS path, 'gdrive' AS backend, 300 AS interval_seconds FROM events")
def watch_registry(t):
    from ..streaming.changes import registry

    return registry(t.events.select(F.col("event_type").alias("path"), F.lit("gdrive").alias("backend")))
