"""Stored things over the driver's tables: pages as documents, indexes, durable tables, queues. Each query builds below the shared
folder what it then asks."""

import datetime as dt

from pyspark.sql import functions as F

from ..functions import bpe
from ..operators import chunking, jobs, vectors
from ..operators.tables import Table
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources import pages
from ..streaming import changes, tokens
from ..work import new_folder
from .library import Library
from .registry import query
from .retrieval_queries import _TEXT_HITS, _docs, _text_queries, _top, _vector_queries, _vectors

_BLOCKS = "address|article|aside|blockquote|body|br|div|dl|dt|dd|footer|form|h[2-6]|header|hr|html|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul"


@query("a4_pages", rf"""
WITH b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)<h1[^>]*>', chr(10) || '# ', 'g') AS body FROM pages),
t AS (SELECT page_id, url, html, regexp_replace(regexp_replace(body, '(?i)</?({_BLOCKS}|li|h1)( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM b)
SELECT page_id, coalesce(nullif(replace(replace(regexp_replace(title, '&amp;?', '&', 'g'), '&quot;', '"'), '&lt;', '<'), ''), regexp_replace(regexp_replace(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), '[?#].*$', ''), '\.[^.]*$', '')) AS title,
       regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS language, len(regexp_extract_all(text, '\S+')) AS word_count, octet_length(encode(html)) AS file_size, sha256(html) AS file_hash FROM t""")
def read_pages(t):
    return pages.parsed_pages(t.pages.select("page_id", "url", "html")).select("page_id", "title", "language", "word_count", "file_size", "file_hash")


@query("a4_page_texts")
def page_texts(t):
    """Whole texts by their hash, and how whole the pages were: SQL cannot follow open elements."""
    rows = pages.parsed_pages(t.pages.select("page_id", "url", "html"))
    return rows.select("page_id", "status", "n_defects", "error_message", F.sha2("text", 256).alias("text_sha256"))


@query("j1_index_exact", f"WITH {_top('cosine', 10)} SELECT query_id, id, round(distance, 6) + 0.0 AS distance, rank FROM top")
def index_exact(t):
    """All lists of a stored index, every vector compared."""
    index = VectorIndex.build(_vectors(t), new_folder(t.spark))
    hits = index.search(_vector_queries(t), 10, exact_too=True)
    return hits.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("j1_index_recall")
def index_recall(t):
    """Of each question: how many of its ten nearest the index finds by codes, and the share of vectors that it compares exactly."""
    index = VectorIndex.build(_vectors(t), new_folder(t.spark))
    found = index.search(_vector_queries(t), 10)
    true = vectors.top_k(_vector_queries(t), _vectors(t), 10).select("query_id", "id")
    hits = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("nearest"))
    work = found.groupBy("query_id").agg(F.max("n_compared").alias("n_compared"))
    return hits.join(work, "query_id")


@query("c10_index_exact", f"WITH {_top('l2', 5)} SELECT query_id, id, round(distance, 5) + 0.0 AS distance, rank FROM top")
def index_exact_l2(t):
    index = VectorIndex.build(_vectors(t), new_folder(t.spark), "l2")
    hits = index.search(_vector_queries(t), 5, exact_too=True)
    return hits.select("query_id", "id", (F.round("distance", 5) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("j2_indexed_search", f"WITH {_TEXT_HITS} SELECT query_id, chunk_id, round(rank_score, 6) AS rank_score, rank FROM ranked WHERE rank <= 20")
def indexed_search(t):
    """The stored index, made of two additions, a deletion and one compaction."""
    index = TextIndex.create(t.spark, new_folder(t.spark))
    index.add(_docs(t).filter("chunk_id % 2 = 0"))
    index.delete(t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("chunk_id")))
    index.add(_docs(t).filter("chunk_id % 2 <> 0 or chunk_id % 4 = 0"))
    index.compact()
    hits = index.search(_text_queries(t), 20)
    return hits.select("query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


@query("a16_table_versions", """
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, 1 AS version FROM orders),
b AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'new' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END AS version FROM a UNION ALL SELECT -o_orderkey, 'added', 1 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 11 = 0)
SELECT 2 AS read_at, * FROM a UNION ALL SELECT 3, * FROM b UNION ALL SELECT 4, * FROM b WHERE abs(id) % 5 <> 0""")
def table_versions(t):
    """Orders put in, changed and added to, taken out; and every version read again."""
    first = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table = Table.create(t.spark, new_folder(t.spark), first.schema, "id")
    table.upsert(first)
    changed = first.filter("id % 7 = 0").withColumn("status", F.lit("new")).unionByName(first.filter("id > 0 and id % 11 = 0").select((-F.col("id")).alias("id"), F.lit("added").alias("status")))
    table.upsert(changed)
    table.delete(table.read().filter("abs(id) % 5 = 0").select("id"))
    out = None
    for version in (2, 3, 4):
        rows = table.read(version).select(F.lit(version).alias("read_at"), "id", "status", "version")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("k15_claimed_jobs", """
WITH d AS (SELECT doc_id AS document_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
SELECT document_id, CASE WHEN n <= 20 THEN 'completed' WHEN n <= 60 THEN 'compiling' ELSE 'pending' END AS status, CASE WHEN n <= 20 OR n BETWEEN 41 AND 60 THEN 'b' WHEN n <= 40 THEN 'c' END AS worker FROM d""")
def claimed_jobs(t):
    """Worker a lets its lease run out, b takes its jobs and ends them, c and b go on; a's late outcome changes nothing."""
    queue = jobs.create(t.spark, new_folder(t.spark))
    jobs.enqueue(queue, t.documents.select(F.col("doc_id").alias("document_id")))
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    late = start + 2 * jobs.LEASE
    lost = jobs.claim(queue, "a", start).select("document_id", F.lit("too late").alias("error"))
    done = jobs.claim(queue, "b", late).select("document_id", F.lit(None).cast("string").alias("error"))
    jobs.finish(queue, "a", lost, late)
    jobs.finish(queue, "b", done, late)
    jobs.claim(queue, "c", late)
    jobs.claim(queue, "b", late)
    return queue.read().select("document_id", "status", "worker")


@query("l4_polled_changes", """
SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change_type, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS size_bytes FROM documents WHERE doc_id >= 0""")
def polled_changes(t):
    """Pages of changes that name their successor, polled by tokens in two runs: the second begins where the first ended."""
    folder, size = new_folder(t.spark), 250
    name, gone = F.concat(F.lit("f"), F.col("doc_id")), F.col("doc_id") % 7 == 0
    file = F.when(~gone, F.struct(name.alias("name"), F.col("n_chars").cast("string").alias("size")))
    rows = t.documents.filter("doc_id >= 0").select(F.expr(f"doc_id DIV {size}").alias("token"), F.struct(name.alias("fileId"), gone.alias("removed"), file.alias("file")).alias("c"))
    last = (rows.agg(F.max("token")).first()[0] or 0) + 1
    held = t.spark.range(last).withColumnRenamed("id", "token").join(rows.groupBy("token").agg(F.collect_list("c").alias("changes")), "token", "left")
    ends = F.col("token") == last // 2
    answers = held.select("token", F.to_json(F.struct("changes", F.when(ends, F.col("token") + 1).alias("newStartPageToken"), F.when(~ends, F.col("token") + 1).alias("nextPageToken"))).alias("text"))
    answers.repartition("token").write.partitionBy("token").text(f"{folder}/feed")
    for _ in range(2):
        pages_of = tokens.polled(t.spark, tokens.landed_feed(f"{folder}/feed"), f"{folder}/checkpoint/pages")
        rows = changes.cloud_changes(pages_of).select("path", "change_type", "size_bytes")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("path string, change_type string, size_bytes long").parquet(f"{folder}/out")


_LIBRARY = r"""
f1 AS (SELECT concat_ws('/', source, doc_id) AS path, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 2 = 0),
f2 AS (SELECT concat_ws('/', source, doc_id) AS path, doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') || ' changed' ELSE coalesce(text, '') END AS text FROM documents),
j1 AS (SELECT *, sha256(text) AS hash, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'failed' WHEN path > min(path) OVER (PARTITION BY text) THEN 'skipped' ELSE 'success' END AS status FROM f1),
t1 AS (SELECT path, hash FROM j1 WHERE status = 'success'),
j2 AS (SELECT f2.*, sha256(text) AS hash, t1.path IS NOT NULL AS known, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'failed' WHEN f2.path > min(f2.path) OVER (PARTITION BY text) OR coalesce(t1.hash = sha256(text), false) THEN 'skipped' ELSE 'success' END AS status FROM f2 LEFT JOIN t1 ON f2.path = t1.path),
t2 AS (SELECT path, hash, CASE WHEN known THEN 2 ELSE 1 END AS version FROM j2 WHERE status = 'success'),
live AS (SELECT path, hash, version, 'second' AS batch FROM t2 UNION ALL SELECT path, hash, 1, 'first' FROM t1 WHERE path NOT IN (SELECT path FROM t2)),
gone AS (SELECT concat_ws('/', source, doc_id) AS path FROM documents WHERE doc_id % 10 = 3)"""


def _library(t) -> Library:
    """Every second document, then all of them, some changed, then a tenth taken out; each batch comes twice."""
    library = Library(t.spark, new_folder(t.spark))
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    path, content = F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.coalesce("text", F.lit(""))

    def files(rows, content, hours):
        rows = rows.select(path.alias("path"), content.alias("text"), F.lit(at + dt.timedelta(hours=hours)).alias("modified_at"))
        return rows.withColumn("file_hash", F.sha2("text", 256))

    def tagger(documents):
        return documents.filter(F.char_length("text") > 500).select("path", F.lit("long").alias("category_id"), F.lit(1.0).alias("confidence"), F.lit("length").alias("tagged_by"))

    changed = F.when(F.col("doc_id") % 4 == 0, F.concat(content, F.lit(" changed"))).otherwise(content)
    for _ in range(2):
        library.ingest("first", files(t.documents.filter("doc_id % 2 = 0"), content, 0), F.lit(at), tagger)
    for _ in range(2):
        library.ingest("second", files(t.documents, changed, 1), F.lit(at))
    for _ in range(2):
        library.delete("third", t.documents.filter("doc_id % 10 = 3").select(path.alias("path")), F.lit(at))
    return library


@query("k4_library", f"WITH {_LIBRARY} SELECT path, hash AS file_hash, version, batch, true AS whole FROM live WHERE path NOT IN (SELECT path FROM gone)")
def library_documents(t):
    """The documents of a library; `whole`: as many live chunks as counted, each with a vector."""
    library = _library(t)
    chunks = library.read("chunks").join(library.read("vectors").select("path", "chunk_id"), ["path", "chunk_id"])
    found = chunks.groupBy("path").agg(F.count("*").alias("found"))
    rows = library.read("documents").join(found, "path", "left")
    return rows.select("path", "file_hash", "version", "batch", F.coalesce((F.col("found") == F.col("n_chunks")) & (F.col("found") > 0), F.lit(False)).alias("whole"))


@query("k9_library_steps", f"""
WITH {_LIBRARY}, j AS (SELECT 'first' AS batch, path, status, length(text) > 500 AS tagged FROM j1 UNION ALL SELECT 'second', path, status, false FROM j2)
SELECT batch, s.step, s.status, count(*) AS n FROM j, (VALUES ('discovered', 'success', 'sxf'), ('extracted', 'success', 'sx'), ('chunked', 'success', 's'), ('embedded', 'success', 's'), ('tagged', 'success', 't'), ('skipped', 'skipped', 'x'), ('failed', 'failed', 'f')) s(step, status, w)
WHERE contains(s.w, CASE j.status WHEN 'success' THEN 's' WHEN 'skipped' THEN 'x' ELSE 'f' END) OR (s.w = 't' AND j.status = 'success' AND j.tagged) GROUP BY ALL
UNION ALL SELECT 'third', 'deleted', 'success', count(*) FROM live WHERE path IN (SELECT path FROM gone) HAVING count(*) > 0""")
def library_steps(t):
    return _library(t).read("steps").groupBy("batch", "step", "status").agg(F.count("*").alias("n"))


#: A public byte-level vocabulary, one token and its rank on a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("h9_byte_pair_counts")
def byte_pair_counts(t):
    """Tokens of every document; beside it what a quarter of its characters would say."""
    count = bpe.vocabulary(t.spark, VOCABULARY)
    return t.documents.select("doc_id", bpe.token_count(F.col("text"), count).alias("n_tokens"), F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 4).alias("n_estimated"))


@query("i1_token_chunks")
def token_chunks(t):
    """Chunks of at most 250 tokens of every document."""
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return chunking.token_chunks(docs, VOCABULARY, 250).drop("content")
