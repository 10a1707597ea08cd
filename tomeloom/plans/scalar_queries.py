"""Scalar functions and filters over the driver's tables."""

from pyspark.sql import functions as F

from ..functions import intents, security, text
from ..operators import filters
from .registry import query


@query("h1_content_hash", "SELECT doc_id, sha256(text) AS file_hash, n_chars = length(text) AS same_size FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("file_hash"), (F.col("n_chars") == F.char_length("text")).alias("same_size"))


@query("h3_result_keys", "SELECT conv_id, turn, sha256(role || ':' || coalesce(text, '') || ':5') AS key FROM conversations")
def result_keys(t):
    return t.conversations.select("conv_id", "turn", text.result_key(F.col("role"), F.col("text"), F.lit(5)).alias("key"))


@query("h8_slugify", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugs(t):
    return t.pages.select("page_id", text.slugify(F.col("url")).alias("slug"))


@query("h9_h10_counts", r"SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents")
def counts(t):
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.word_count(F.col("text")).alias("words"))


@query("h11_sentences", r"SELECT doc_id, CAST(1 + len(regexp_extract_all(text, '[.!?]\s+[A-Z]')) AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(t):
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("h12_h13_distances", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT label, min(vec_id) AS first_id FROM v GROUP BY label)
SELECT a.vec_id, round(1 - list_cosine_similarity(a.e, b.e), 6) + 0.0 AS cosine, round(power(list_distance(a.e, b.e), 2), 6) + 0.0 AS l2, round(1 - list_inner_product(a.e, b.e), 6) + 0.0 AS ip
FROM v a JOIN c USING (label) JOIN v b ON b.vec_id = c.first_id""")
def distances(t):
    from ..operators.vectors import distance

    heads = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("other"))
    rows = t.embeddings.join(heads, "label")
    d = {m: (F.round(distance(F.col("embedding"), F.col("other"), m), 6) + 0.0).alias(m) for m in ("cosine", "l2", "ip")}
    return rows.select("vec_id", *d.values())


@query("h14_cvss_severity", """
SELECT event_id, CASE WHEN value IS NULL OR value / 10 < 0 OR value / 10 > 10 THEN 'unknown' WHEN value / 10 = 0 THEN 'info' WHEN value / 10 <= 3.9 THEN 'low' WHEN value / 10 <= 6.9 THEN 'medium' WHEN value / 10 <= 8.9 THEN 'high' ELSE 'critical' END AS severity FROM events""")
def severities(t):
    return t.events.select("event_id", security.cvss_severity(F.col("value") / 10).alias("severity"))


@query("h21_source_type")
def source_types(t):
    return t.documents.select("doc_id", security.source_type(F.col("text"), F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"))).alias("source_type"))


@query("h23_security_intent", """
SELECT conv_id, turn, CASE WHEN regexp_full_match(trim(text), '(?i)CVE-\\d{4}-\\d+') THEN 'cve_lookup' WHEN regexp_full_match(trim(text), 'T\\d{4}(\\.\\d{3})?') THEN 'technique_lookup'
  WHEN regexp_full_match(trim(text), '[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64}') THEN 'ioc_lookup'
  WHEN length(trim(text)) BETWEEN 1 AND 253 AND regexp_full_match(trim(text), '([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\\.)+[a-zA-Z]{2,}') THEN 'ioc_lookup'
  WHEN regexp_full_match(trim(text), '(25[0-5]|2[0-4]\\d|1\\d\\d|0{0,2}\\d{1,2})(\\.(25[0-5]|2[0-4]\\d|1\\d\\d|0{0,2}\\d{1,2})){3}') THEN 'ioc_lookup'
  WHEN regexp_matches(lower(text), 'cve-2024|cve-2025') THEN 'cve_lookup' WHEN regexp_matches(lower(text), 't1059|t1218|t1547|t1021') THEN 'technique_lookup'
  WHEN regexp_matches(lower(trim(text)), 'ip:|domain:|hash:|sha256:|md5:|sha1:|192\\.168\\.|10\\.0\\.|172\\.16\\.|hash ') THEN 'ioc_lookup' ELSE 'general_security' END AS intent FROM conversations""".replace("\\\\", "\\"))
def security_intents(t):
    return t.conversations.select("conv_id", "turn", intents.security_intent(F.col("text")).alias("intent"))


@query("h24_recency", """
SELECT o_orderkey, round(CASE WHEN o_orderdate IS NULL OR o_orderdate >= m THEN 1.0 ELSE power(0.5, (epoch_us(m) - epoch_us(o_orderdate)) / 86400e6 / 365.0) END, 6) AS recency
FROM orders, (SELECT max(o_orderdate) AS m FROM orders)""")
def recencies(t):
    last = t.orders.agg(F.max("o_orderdate").alias("m"))
    rows = t.orders.crossJoin(F.broadcast(last))  # one row
    return rows.select("o_orderkey", F.round(security.recency(F.col("o_orderdate"), F.col("m")), 6).alias("recency"))


def _phrases(kinds):
    return " ".join("WHEN " + " OR ".join(f"contains(low, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in kinds)


@query("h25_request_intent", f"""
WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text, lower(trim(coalesce(text, ''))) AS low FROM conversations WHERE role = 'user'),
i AS (SELECT *, CASE {_phrases(intents.INTENTS)} WHEN regexp_split_to_array(low, '\\s+')[1] IN ({', '.join(f"'{w}'" for w in intents.QUESTION_WORDS)}) THEN 'query' WHEN contains(text, '?') THEN 'query2' ELSE 'unknown' END AS k FROM r)
SELECT conv_id, turn, replace(k, 'query2', 'query') AS intent, CASE k WHEN 'unknown' THEN 0.3::DOUBLE WHEN 'query' THEN 0.7 WHEN 'query2' THEN 0.6 ELSE 0.9 END AS confidence FROM i""")
def request_intents(t):
    rows = t.conversations.filter(F.col("role") == "user").withColumn("i", intents.request_intent(F.col("text")))
    return rows.select("conv_id", "turn", "i.intent", "i.confidence")


@query("h26_content_type", f"SELECT conv_id, turn, CASE {_phrases(intents.CONTENT_TYPES)} ELSE 'summary' END AS content_type FROM (SELECT *, lower(coalesce(text, '')) AS low FROM conversations)")
def content_types(t):
    return t.conversations.select("conv_id", "turn", intents.content_type(F.col("text")).alias("content_type"))


@query("h27_found_path", r"""
SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '([a-z][a-z0-9+.-]*://[^\s"'']+)', 1), ''), nullif(regexp_extract(text, '(?:^|\s)(~?/[^\s"'']+)', 1), ''),
  nullif(regexp_extract(text, '(?:^|\s)((?:\./|\.\./)?[\w-]+(?:/[\w.-]+)*\.[A-Za-z0-9]{1,5})(?:\s|$)', 1), '')) AS path FROM conversations""")
def found_paths(t):
    return t.conversations.select("conv_id", "turn", text.found_path(F.col("text")).alias("path"))


@query("h28_snippet", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def snippets(t):
    return t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("h29_collapsed", r"SELECT doc_id, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || '...' ELSE c END AS collapsed FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS c FROM documents)")
def collapsed(t):
    return t.documents.select("doc_id", text.collapsed(F.col("text")).alias("collapsed"))


@query("h30_uri_parts", r"SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, trim(regexp_replace(url, '[<>:""/\\|?*]', '_', 'g'), '. ') AS file_name FROM pages".replace('""', '"'))
def uri_parts(t):
    return t.pages.select("page_id", text.uri_scheme(F.col("url")).alias("scheme"), text.safe_filename(F.col("url")).alias("file_name"))


@query("b1_metadata_filter", "SELECT vec_id, label FROM embeddings WHERE (label >= 3 AND label < 8) AND (label IN (3, 5) OR label NOT IN (4, 5, 6)) AND vec_id <> 10")
def metadata_filter(t):
    where = {"label": {"$gte": 3, "$lt": 8}, "$or": [{"label": {"$in": [3, 5]}}, {"label": {"$nin": [4, 5, 6]}}], "vec_id": {"$ne": 10}}
    return filters.where(t.embeddings, where).select("vec_id", "label")


@query("b3_security_filter", """
SELECT d.doc_id FROM documents d WHERE d.lang = 'en' AND list_has_any([d.source, d.lang], ['src1', 'src2', 'src3'])
AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def security_filter(t):
    docs = t.documents.select("doc_id", F.col("doc_id").alias("document_id"), F.col("lang").alias("severity"), F.array("source", "lang").alias("platforms"))
    tags = t.labels.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("category"))
    return filters.security_filter(docs, tags, severity="en", platforms=["src1", "src2", "src3"], tag_names=["good"]).select("doc_id")


@query("b5_title_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ed w') OR contains(lower(p_name), 'gear')")
def title_filter(t):
    return t.part.filter(filters.title_like(F.col("p_name"), "ed w") | filters.title_like(F.col("p_name"), "GEAR")).select("p_partkey")


@query("b6_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY AND ts >= TIMESTAMP '2024-01-05'")
def since(t):
    now = F.lit("2024-01-30").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return t.events.filter(filters.since(ts, "2w", now) & filters.since(ts, "2024-01-05", now)).select("event_id")


@query("b8_file_type", """
WITH f AS (SELECT page_id, url, lower(regexp_extract(url, '[^/.][^/]*\\.([^./]+)$', 1)) AS s FROM pages)
SELECT page_id, CASE WHEN s IN ('html', 'htm') THEN 'html' WHEN s IN ('pdf', 'md', 'txt') THEN s ELSE 'other' END AS file_type FROM f""")
def file_types(t):
    return t.pages.select("page_id", text.file_type(F.col("url")).alias("file_type"))


@query("b12_ingestable", r"SELECT page_id FROM pages WHERE NOT regexp_matches(split_part(split_part(url, '://', 2), '?', 1), '(^|/)\.') AND regexp_matches(url, '\.html$')")
def ingestable(t):
    path = F.substring_index(F.substring_index("url", "://", -1), "?", 1)
    hidden = F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))
    return t.pages.filter(~hidden & (text.suffix(F.col("url")) == "html")).select("page_id")


@query("b13_read_only_sql", "SELECT * FROM (SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderpriority) LIMIT 200")
def read_only(t):
    t.orders.createOrReplaceTempView("orders")
    return filters.read_only_sql(t.spark, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")


@query("b14_unique_slugs", """
SELECT doc_id, CASE WHEN n = 0 THEN b ELSE b || '-' || n END AS slug
FROM (SELECT doc_id, b, row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 AS n FROM (SELECT doc_id, trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM documents))""")
def unique_slugs(t):
    titled = t.documents.select("doc_id", F.concat_ws(" ", "source", "lang").alias("title"))
    return filters.unique_slugs(titled, "title", ["doc_id"]).select("doc_id", "slug")
