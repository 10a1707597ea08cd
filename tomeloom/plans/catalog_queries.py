"""Joins, aggregates, windows, lists and dedup over the driver's tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, closure, dedup
from ..work import dealt
from .registry import query


def _tags(t):
    """Labels as tags: category 1 is quality, 2 is toxicity, each as sure as its label says."""
    rows = t.labels.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.struct(F.lit(1).alias("category_id"), F.col("quality").cast("double").alias("confidence")), F.struct(F.lit(2).alias("category_id"), F.col("toxic").cast("double").alias("confidence")))).alias("x"))
    return rows.select("document_id", "x.category_id", "x.confidence", F.lit("label").alias("tagged_by"))


def _categories(t):
    regions = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("category_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nations = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("category_id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"))
    return regions.unionByName(nations)


TAGS = "SELECT doc_id AS document_id, 1 AS category_id, CAST(quality AS DOUBLE) AS confidence FROM labels UNION ALL SELECT doc_id, 2, CAST(toxic AS DOUBLE) FROM labels"


@query("c2_documents_by_category", "SELECT n.n_name, r.r_name, CAST(count(*) AS BIGINT) AS customers FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia' OR r_name = 'EUROPE' GROUP BY ALL")
def documents_by_category(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.filter((F.lower("r_name") == "asia") | (F.col("r_name") == "EUROPE")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("c4_known_hashes", "SELECT a.doc_id, EXISTS (SELECT 1 FROM documents b WHERE sha256(b.text) = sha256(a.text) AND b.doc_id < a.doc_id) AS known FROM documents a")
def known_hashes(t):
    rows = t.documents.select("doc_id", text.content_hash(F.col("text")).alias("h"))
    least = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return rows.join(least, "h").select("doc_id", (F.col("first_id") < F.col("doc_id")).alias("known"))


@query("c5_category_paths", """
WITH RECURSIVE c AS (SELECT 'r' || r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer),
p(category_id, path, depth) AS (SELECT id, name, 0 FROM c WHERE parent IS NULL UNION ALL SELECT c.id, p.path || '/' || c.name, p.depth + 1 FROM c JOIN p ON c.parent = p.category_id)
SELECT category_id, path, depth FROM p""")
def category_paths(t):
    customers = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("category_id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"))
    return catalog.category_paths(_categories(t).unionByName(customers))


@query("c6_neighbour_turns", "SELECT conv_id, turn, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_turns(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("c5_deep_depths", """
WITH RECURSIVE c AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
p(category_id, root_id, depth) AS (SELECT id, id, 0 FROM c WHERE parent IS NULL UNION ALL SELECT c.id, p.root_id, p.depth + 1 FROM c JOIN p ON c.parent = p.category_id)
SELECT category_id, root_id, depth FROM p""")
def deep_depths(t):
    """Each customer's orders as one chain, every order below the one before."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = dealt(t.orders.select("o_custkey", "o_orderkey"), t.orders.count(), "o_custkey")
    return closure.depths(orders.select(F.col("o_orderkey").alias("category_id"), before.alias("parent_id")))


@query("c7_matched_categories", """
WITH s AS (SELECT c_custkey AS document_id, n_name AS path, c_acctbal AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey + 1000000, r_name || '/' || n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT document_id, 'n' || n_nationkey AS category_id, confidence FROM s JOIN nation ON n_name = split_part(path, '/', -1)""")
def matched(t):
    a = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("document_id"), F.col("n_name").alias("path"), F.col("c_acctbal").alias("confidence"))
    b = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("s_suppkey") + 1000000).alias("document_id"), F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("s_acctbal").alias("confidence"))
    return catalog.matched_categories(a.unionByName(b), catalog.category_paths(_categories(t)))


@query("c9_absent_links", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_partkey = l.l_partkey AND o.l_suppkey = l.l_suppkey AND o.l_returnflag = 'R')")
def absent_links(t):
    pairs = lambda df: df.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return pairs(t.lineitem).join(pairs(t.lineitem.filter("l_returnflag = 'R'")), ["src", "dst"], "left_anti")


@query("c12_source_priority", """
WITH p(ordinal, key, priority) AS (SELECT row_number() OVER (ORDER BY n_nationkey), lower(n_name), n_nationkey % 7 FROM nation)
SELECT c_custkey, coalesce((SELECT arg_min(priority, ordinal) FROM p WHERE contains(lower(n_name) || '/' || c_mktsegment, key)), 0) AS priority FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def source_priority(t):
    keys = t.nation.select(F.col("n_nationkey").alias("ordinal"), F.lower("n_name").alias("key"), (F.col("n_nationkey") % 7).alias("priority"))
    paths = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", F.lower("n_name"), "c_mktsegment").alias("path"))
    # priorities are a configured list: matched once for each distinct path
    distinct = paths.select("path").distinct()
    found = distinct.join(F.broadcast(keys), F.contains("path", "key")).groupBy("path").agg(F.min_by("priority", "ordinal").alias("priority"))
    return paths.join(found, "path", "left").select("c_custkey", F.coalesce("priority", F.lit(0)).cast("int").alias("priority"))


@query("c13_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade(t):
    gone = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return catalog.delete_documents(gone, {"lines": t.lineitem.withColumnRenamed("l_orderkey", "document_id")})["lines"].select(F.col("document_id").alias("l_orderkey"), "l_linenumber")


@query("c14_tags_of_documents", f"SELECT d.doc_id, coalesce(list(category_id ORDER BY category_id) FILTER (WHERE confidence >= 0.7), []) AS categories FROM documents d LEFT JOIN ({TAGS}) ON document_id = d.doc_id GROUP BY d.doc_id")
def tags_of_documents(t):
    sure = _tags(t).filter("confidence >= 0.7").groupBy("document_id").agg(F.sort_array(F.collect_list("category_id")).alias("categories"))
    return t.documents.select("doc_id").join(sure, F.col("doc_id") == F.col("document_id"), "left").select("doc_id", F.coalesce("categories", F.array().cast("array<int>")).alias("categories"))


@query("c15_category_delete", "SELECT 'category' AS kind, 'n' || n_nationkey AS id FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'category', 'r' || r_regionkey FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'tag', CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def category_delete(t):
    """The categories that are left, and the tags. All roots have one name, and all nations one with a slash that reads as a path."""
    tags = t.customer.select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("category_id"))
    categories, tags = catalog.delete_category(_categories(t).withColumn("name", F.when(F.col("parent_id").isNull(), "X").otherwise("X/X")), tags, "r2", force=True)
    return categories.select(F.lit("category").alias("kind"), F.col("category_id").alias("id")).unionByName(tags.select(F.lit("tag").alias("kind"), F.col("document_id").cast("string").alias("id")))


@query("d1_totals", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'log', count(*) FROM events")
def totals(t):
    return catalog.totals({"documents": t.documents, "pages": t.pages, "vectors": t.embeddings, "log": t.events})


@query("d2_count_by_status", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def by_status(t):
    return catalog.count_by(t.events, "event_type")


@query("d3_status_with_zeros", "SELECT v AS value, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(v)")
def with_zeros(t):
    return catalog.count_by(t.orders, "o_orderstatus", ["F", "O", "P", "X"])


@query("d5_batch_tally", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS succeeded, count(*) FILTER (WHERE event_type = 'view') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events")
def batch_tally(t):
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed")
    return catalog.tally(t.events.select(status.alias("status")))


@query("d6_document_detail", "SELECT o_orderkey, count(l_linenumber) AS n_lines, coalesce(list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_linenumber IS NOT NULL), []) AS flags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def document_detail(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("f"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("f", F.array().cast("array<string>")).alias("flags"))


@query("d7_combined_text", "SELECT conv_id, CASE WHEN length(s) > 8000 THEN substr(s, 1, 8000) || '...' ELSE s END AS combined FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS s FROM conversations GROUP BY conv_id)")
def combined_text(t):
    from ..operators.curation import combined

    return combined(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text", 8000)


@query("d8_first_chunks", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5 GROUP BY conv_id")
def first_chunks(t):
    from ..operators.curation import first_pieces

    return first_pieces(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", "text", 5).withColumnRenamed("combined", "sample")


@query("d10_tag_merge", f"""
WITH a AS ({TAGS}), m AS (SELECT *, 0 AS turn, 'label' AS by_ FROM a UNION ALL SELECT document_id, category_id, 0.5, -1, 'model' FROM a)
SELECT document_id, category_id, max(confidence) AS confidence, CASE WHEN max(confidence) > 0.5 THEN 'label' ELSE arg_max(by_, (confidence, turn)) END AS tagged_by FROM m GROUP BY ALL""")
def tag_merge(t):
    tags = _tags(t)
    return catalog.merge_tags(tags, tags.withColumns({"confidence": F.lit(0.5), "tagged_by": F.lit("model")}))


@query("d11_watch_totals", "SELECT user_id AS watch_id, count(*) FILTER (WHERE event_type <> 'error') AS processed, count(*) FILTER (WHERE event_type = 'error') AS failed, max(ts) AS last_event FROM events GROUP BY user_id")
def watch_totals(t):
    from ..streaming.changes import watch_totals as totals_of

    return totals_of(t.events.withColumnRenamed("user_id", "watch_id").withColumn("failed", F.col("event_type") == "error"))


@query("d13_latencies", "SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency(t):
    rows = catalog.latencies(t.events.withColumnRenamed("event_type", "metric"), "metric", "value")
    return rows.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("e7_latest_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(t):
    return dedup.latest(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("f1_page_of_list", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_list(t):
    return catalog.page(t.orders, [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 50).select("o_orderkey")


@query("f5_pending_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def pending_jobs(t):
    return catalog.page(t.orders.filter("o_orderstatus = 'O'"), [F.col("o_orderdate"), F.col("o_orderkey")], 0, 20).select("o_orderkey")


@query("g4_tag_untag", "SELECT DISTINCT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tag_untag(t):
    tagged = t.documents.select("doc_id", "lang").union(t.documents.select("doc_id", "lang")).dropDuplicates(["doc_id", "lang"])
    return tagged.join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")


_K1 = """
WITH s AS (SELECT d.doc_id, l.toxic, sha256(CASE WHEN l.quality = 1 THEN text ELSE trim(text, '.') END) AS h FROM documents d JOIN (SELECT DISTINCT ON (doc_id) * FROM labels) l USING (doc_id)),
i AS (SELECT d.doc_id, d.source || '/' || d.doc_id AS path, sha256(text) AS file_hash FROM documents d)
SELECT i.path, i.file_hash, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.h = i.file_hash THEN 'skip' WHEN s.toxic = 1 THEN 'conflict' ELSE 'update' END AS decision FROM i LEFT JOIN s USING (doc_id)"""


def _decided(t):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    labels = t.labels.dropDuplicates(["doc_id"])
    stored = t.documents.join(labels, "doc_id").select(path.alias("path"), text.content_hash(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.btrim("text", F.lit(".")))).alias("file_hash"), F.when(F.col("toxic") == 1, F.lit(2)).otherwise(F.lit(0)).alias("updated_at"))
    incoming = t.documents.select(path.alias("path"), text.content_hash(F.col("text")).alias("file_hash"), F.lit(1).alias("modified_at"))
    return dedup.decide(incoming, stored, "manual")


@query("k1_dedup_decisions", _K1)
def decisions(t):
    return _decided(t).select("path", "file_hash", "decision")


@query("k2_dedup_log", f"SELECT path AS document, 'dedup' AS action, CASE decision WHEN 'conflict' THEN 'failed' WHEN 'skip' THEN 'partial' ELSE 'success' END AS status, '{{\"decision\":\"' || decision || '\",\"file_hash\":\"' || file_hash || '\"}}' AS details FROM ({_K1})")
def dedup_log(t):
    return dedup.log_rows(_decided(t), F.current_timestamp()).drop("created_at")


@query("k3_seen_before", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS seen_before FROM documents")
def seen_before(t):
    files = t.documents.select(F.col("doc_id").alias("path"), text.content_hash(F.col("text")).alias("file_hash"))
    return dedup.first_of_hash(files).select(F.col("path").alias("doc_id"), "seen_before")


@query("k6_versions", f"SELECT count(*) AS documents, count(*) FILTER (WHERE decision = 'update') AS bumped FROM ({_K1}) WHERE decision <> 'new'")
def versions(t):
    decided = _decided(t)
    stored = decided.filter("decision <> 'new'").select(F.col("path").alias("document_id"), "file_hash", F.lit(1).alias("version"), F.lit(0).alias("updated_at"))
    changed = decided.filter("decision = 'update'").select(F.col("path").alias("document_id"), "file_hash")
    return dedup.bump(stored, changed, F.lit(1)).agg(F.count("*").alias("documents"), F.count_if(F.col("version") == 2).alias("bumped"))
