"""Search, chunking and curation over the driver's tables.

Chunks are documents unless a query cuts them; questions are benchmark items, or every vector whose id is divisible by 20.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from ..functions.text import slugify
from ..operators import chunking, curation, fulltext, retrieval, vectors
from .registry import query

WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _vector_queries(t):
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def _top(metric, k, where="true"):
    value = {"cosine": "1 - list_cosine_similarity(q.e, v.e)", "l2": "power(list_distance(q.e, v.e), 2)", "ip": "1 - list_inner_product(q.e, v.e)"}[metric]
    return f"""
v0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
top AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {value} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({value}, 12), v.vec_id) AS rank
  FROM v0 q, v0 v WHERE q.vec_id % 20 = 0 AND {where.replace('label', 'v.label')} QUALIFY rank <= {k})"""


@query("j1_vector_top_k", f"WITH {_top('cosine', 10, 'label < 7')} SELECT query_id, id, round(distance, 6) + 0.0 AS distance, rank FROM top")
def vector_top_k(t):
    hits = vectors.top_k(_vector_queries(t), _vectors(t).filter("label < 7"), 10)
    return hits.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("c10_nearest_l2", f"WITH {_top('l2', 5)} SELECT query_id, id, round(distance, 5) + 0.0 AS distance, rank FROM top")
def nearest_l2(t):
    hits = vectors.top_k(_vector_queries(t), _vectors(t), 5, "l2")
    return hits.select("query_id", "id", (F.round("distance", 5) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("j12_nearest_label", f"WITH {_top('cosine', 2)}, o AS (SELECT query_id, arg_min(id, rank) AS id FROM top WHERE id <> query_id GROUP BY query_id) SELECT query_id, e.label = q.label AS same FROM o JOIN embeddings e ON e.vec_id = id JOIN embeddings q ON q.vec_id = query_id")
def nearest_label(t):
    hits = vectors.top_k(_vector_queries(t), _vectors(t), 2).filter("id <> query_id").groupBy("query_id").agg(F.min_by("id", "rank").alias("id"))
    labels = t.embeddings.select("vec_id", "label")
    rows = hits.join(labels.withColumnRenamed("vec_id", "id"), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return rows.select("query_id", (F.col("label") == F.col("own")).alias("same"))


@query("a14_upsert", "SELECT vec_id AS id, label + (CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN 100 ELSE 0 END) AS label FROM embeddings")
def upsert(t):
    old = _vectors(t)
    fresh = old.join(t.labels.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").withColumn("label", F.col("label") + 100)
    return vectors.upsert(old, fresh, 64).select("id", "label")


@query("a15_delete_vectors", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_vectors(t):
    return vectors.without_ids(_vectors(t), t.labels.select(F.col("doc_id").alias("id"))).select("id")


def _text_queries(t):
    """Of each benchmark item: its third word, or its first and second as a phrase."""
    w = fulltext.words(F.col("text"))
    return t.benchmark.filter((F.size(w) >= 3) & ~w[2].isin("and", "or")).select(F.col("item_id").alias("query_id"), F.concat(w[2], F.lit(' OR "'), w[0], F.lit(" "), w[1], F.lit('"')).alias("query"))


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


_TEXT_HITS = f"""
b AS (SELECT item_id AS query_id, ws[1] AS a, ws[2] AS b, ws[3] AS c FROM (SELECT item_id, {WORDS} AS ws FROM benchmark) WHERE len(ws) >= 3 AND ws[3] NOT IN ('and', 'or')),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
one AS (SELECT query_id, doc_id, 0.4 * ln(1 + count(*)) AS r FROM b JOIN p ON p.w = b.c GROUP BY ALL),
two AS (SELECT query_id, x.doc_id, 0.4 * ln(1 + count(*)) AS r FROM b JOIN p x ON x.w = b.a JOIN p y ON y.w = b.b AND y.doc_id = x.doc_id AND y.i = x.i + 1 GROUP BY ALL),
hits AS (SELECT query_id, doc_id AS chunk_id, round(sum(r) / (sum(r) + 1), 12) AS rank_score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id) AS rank FROM hits)"""


@query("j2_full_text", f"WITH {_TEXT_HITS} SELECT query_id, chunk_id, round(rank_score, 6) AS rank_score, rank FROM ranked WHERE rank <= 20")
def full_text(t):
    hits = fulltext.search(_text_queries(t), _docs(t), 20)
    return hits.select("query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


def _hybrid(t, k=10):
    """Vectors as documents of the same id; a question is a vector and the second word of its document's text."""
    w = fulltext.words(F.col("text"))
    asked = t.documents.join(_vector_queries(t).select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").filter((F.size(w) >= 2) & ~w[1].isin("and", "or"))
    texts = asked.select(F.col("doc_id").alias("query_id"), w[1].alias("query"))
    near = vectors.top_k(_vector_queries(t), _vectors(t), retrieval.VECTOR_POOL).withColumnRenamed("id", "chunk_id")
    found = fulltext.search(texts, _docs(t), retrieval.TEXT_POOL)
    return retrieval.merge(near, found), texts


_HYBRID = f"""
WITH {_top('cosine', 50)},
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
q AS (SELECT doc_id AS query_id, ws[2] AS term FROM d WHERE len(ws) >= 2 AND ws[2] NOT IN ('and', 'or') AND doc_id IN (SELECT query_id FROM top)),
p AS (SELECT doc_id, unnest(ws) AS w FROM d),
f AS (SELECT query_id, doc_id, round(r / (r + 1), 12) AS s FROM (SELECT query_id, doc_id, 0.4 * ln(1 + count(*)) AS r FROM q JOIN p ON w = term GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(r / (r + 1), 12) DESC, doc_id) <= 20),
m AS (SELECT query_id, id AS chunk_id, greatest(0, 1 - round(distance, 12)) * 0.7 AS vector_score, 0.0 AS fts_score FROM top
  UNION ALL SELECT query_id, doc_id, 0.0, s / greatest(max(s) OVER (PARTITION BY query_id), 0.001) * 0.3 FROM f),
s AS (SELECT query_id, chunk_id, sum(vector_score) AS vector_score, sum(fts_score) AS fts_score, round(sum(vector_score) + sum(fts_score), 12) AS score FROM m GROUP BY ALL)"""


@query("j4_hybrid", f"{_HYBRID} SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, round(fts_score, 6) AS fts_score, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10")
def hybrid(t):
    hits = retrieval.best(_hybrid(t)[0], 10)
    return hits.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "fts_score", "score")], F.col("rank").cast("long").alias("rank"))


_SEVERITY = ["critical", "high", "medium", "low", "info", "unknown"]


@query("j7_security_rerank", f"""{_HYBRID},
pool AS (SELECT s.* FROM s JOIN documents ON doc_id = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 15),
w AS (SELECT pool.query_id, chunk_id, round(score * [3.0, 2.0, 1.0, 0.5, 0.2, 0.0][n_chars % 6 + 1] * power(0.5, doc_id % 100 / 365.0::DOUBLE), 12) AS score FROM pool JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM w QUALIFY rank <= 5""")
def security_rerank(t):
    hits, texts = _hybrid(t)
    about = t.documents.select(F.col("doc_id").alias("chunk_id"), F.element_at(F.array(*map(F.lit, _SEVERITY)), (F.col("n_chars") % 6 + 1).cast("int")).alias("severity"), F.element_at(F.array(F.lit("nvd_cve"), F.lit("prose")), (F.col("doc_id") % 2 + 1).cast("int")).alias("source_type"), F.timestamp_seconds(F.lit(1_700_000_000) - F.col("doc_id") % 100 * 86_400).alias("content_date"))
    asked = _vector_queries(t).select("query_id").join(texts, "query_id", "left")
    ranked = retrieval.security_rerank(hits.join(about, "chunk_id"), asked, F.timestamp_seconds(F.lit(1_700_000_000)), 5)
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("j6_rerank")
def rerank(t):
    hits = fulltext.search(_text_queries(t), _docs(t), 20).withColumnRenamed("rank_score", "score")
    rows = hits.join(_docs(t).select("chunk_id", "content"), "chunk_id").join(_text_queries(t), "query_id")
    return retrieval.rerank(rows, k=5).select("query_id", "chunk_id", "score", "rank")


def _cited(t):
    hits = fulltext.search(_text_queries(t), _docs(t), 20).withColumnRenamed("rank_score", "score")
    return hits.join(_docs(t).select("chunk_id", "content", F.col("source").alias("document_title")), "chunk_id")


@query("j8_citations", f"WITH {_TEXT_HITS} SELECT query_id, rank AS source, chunk_id, d.source AS document_title, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5")
def citations(t):
    return retrieval.citations(_cited(t)).drop("score").withColumn("source", F.col("source").cast("long"))


@query("j9_contexts", f"WITH {_TEXT_HITS} SELECT query_id, string_agg('[Source ' || rank || ': ' || d.source || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5 GROUP BY query_id")
def contexts(t):
    return retrieval.contexts(_cited(t))


@query("j10_answers")
def answers(t):
    """Prompts and the replies of the default model, which returns its prompt's context."""
    prompts = retrieval.contexts(_cited(t)).join(_text_queries(t), "query_id").withColumn("prompt", curation.answer_prompt(F.col("query"), F.col("context")))
    return curation.generated(prompts, lambda p: p.str.split("\n\nQuestion: ").str[0]).select("query_id", F.sha2("reply", 256).alias("reply"))


@query("j13_reused_results", "SELECT DISTINCT text AS key, EXISTS (SELECT 1 FROM conversations b WHERE b.text = a.text AND b.role = 'assistant') AS live FROM conversations a WHERE role = 'user' AND text IS NOT NULL")
def reused(t):
    asked = t.conversations.filter("role = 'user' and text is not null").select(F.col("text").alias("key")).distinct()
    known = t.conversations.filter("role = 'assistant'").select(F.col("text").alias("key"), F.col("turn").alias("value"), F.lit(2).alias("expires_at"), F.lit(False).alias("is_error"))
    live, left = retrieval.reused(asked, known, F.lit(1))
    return live.select("key", F.lit(True).alias("live")).unionByName(left.select("key", F.lit(False).alias("live")))


def _as_docs(t):
    return t.documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))


@query("i1_recursive_chunks")
def recursive_chunks(t):
    return chunking.recursive_chunks(_as_docs(t), 250).drop("content")


@query("i3_markdown_sections", """
SELECT CAST(conv_id AS VARCHAR) AS document_id, CASE turn % 3 WHEN 0 THEN 'T' || turn WHEN 1 THEN 'T' || (turn - 1) || ' > T' || turn ELSE 'T' || (turn - 2) || ' > T' || (turn - 1) || ' > T' || turn END AS header_path,
       role || ' ' || trim(regexp_replace(regexp_replace(text, '[#\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS content FROM conversations""")
def markdown_sections(t):
    """A markdown text of each conversation: turns below headers of three levels in turn, and an empty section at its end."""
    line = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" T"), F.col("turn"), F.lit("\n\n"), "role", F.lit(" "), F.btrim(F.regexp_replace("text", r"[#\s]+", " ")), F.lit("\n"))
    texts = t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return chunking.markdown_sections(texts.select("document_id", F.concat("content", F.lit("# Empty\n \n")).alias("content"))).drop("chunk_index")


@query("i4_markdown_chunks")
def markdown_chunks(t):
    return chunking.markdown_chunks(_as_docs(t), 250).drop("content")


@query("i6_length_chunks")
def length_chunks(t):
    return chunking.length_chunks(_as_docs(t), 100).drop("content")


@query("i5_semantic_chunks")
def semantic_chunks(t):
    """Turns as sentences, with the vector whose id is 7 * conv_id + turn modulo the number of vectors; a turn without one stays with the turn before."""
    size = F.lit(max(1, t.embeddings.count()))
    rows = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.col("text").alias("sentence"), F.pmod(F.col("conv_id") * 7 + F.col("turn"), size).alias("vec_id"))
    return chunking.semantic_chunks(rows.join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left"), 0.2, 100)


@query("e10_source_numbers", "SELECT conv_id, turn, '[Source ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ': ' || role || ']' AS source FROM conversations")
def source_numbers(t):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("[Source "), n.cast("string"), F.lit(": "), "role", F.lit("]")).alias("source"))


@query("k7_tagging", "SELECT doc_id AS document_id, 'n' || n_nationkey AS category_id, 0.9::DOUBLE AS confidence FROM documents JOIN nation ON n_nationkey = CAST(substr(source, 4) AS INT)")
def tagging(t):
    """A stub model names the nation of a document's source in a fenced JSON reply; replies are parsed, matched, cut and merged."""
    from ..operators.catalog import category_paths, matched_categories, merge_tags
    from .catalog_queries import _categories

    names = t.nation.select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("source"), "n_name")
    docs = t.documents.select("doc_id", "source").join(names, "source")
    replies = docs.select(F.col("doc_id").alias("document_id"), F.format_string('```json\n{"suggestions": [{"path": "%s", "confidence": 0.9}, {"path": "none", "confidence": 1}, {"path": "%s", "score": 0.2}]}\n```', "n_name", "n_name").alias("reply"))
    found = matched_categories(curation.suggestions(replies).filter(F.col("confidence") >= curation.TAG_THRESHOLD), category_paths(_categories(t)))
    return merge_tags(found.withColumn("tagged_by", F.lit("model"))).drop("tagged_by")


def _mentions(t):
    return t.documents.select(F.col("lang").alias("document_id"), F.col("source").alias("name"), F.lit(None).cast("string").alias("kind")).distinct()


@query("k11_new_pages", "SELECT DISTINCT source AS slug, source AS title, 'concept' AS kind FROM documents WHERE source <> 'src0'")
def new_pages(t):
    existing = t.documents.groupBy("source").count().orderBy(F.desc("count"), "source").limit(1).select(F.lit("src0").alias("slug"))
    return curation.new_pages(_mentions(t), existing)


@query("k12_update_actions", """
SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'append' WHEN l.doc_id IS NULL THEN 'reject' WHEN d.lang = 'fr' THEN 'replace' WHEN d.lang = 'de' THEN CASE WHEN d.n_chars % 2 > l.quality THEN 'supersede' ELSE 'flag' END ELSE CASE WHEN d.n_chars % 2 >= l.toxic THEN 'supersede' ELSE 'keep' END END AS outcome
FROM documents d LEFT JOIN (SELECT DISTINCT ON (doc_id) * FROM labels) l USING (doc_id)""")
def update_actions(t):
    action = F.when(F.col("lang") == "en", "add").when(F.col("lang") == "fr", "update").when(F.col("lang") == "de", "scope").otherwise("factual")
    updates = t.documents.select("doc_id", F.col("doc_id").alias("slug"), F.lit("h").alias("heading"), action.alias("action"), (F.col("n_chars") % 2).alias("priority"), (F.col("n_chars") % 2).alias("document_time"))
    sections = t.labels.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("slug"), F.lit("h").alias("heading"), F.col("quality").alias("priority"), F.col("toxic").alias("document_time"))
    return curation.update_actions(updates, sections).select("doc_id", "outcome")


@query("k13_cross_references", "SELECT DISTINCT a.source AS source, b.source AS target FROM documents a JOIN documents b ON a.lang = b.lang AND a.source <> b.source WHERE NOT (a.source = 'src1' AND b.source = 'src2')")
def cross_references(t):
    existing = t.region.limit(1).select(F.lit("src1").alias("source"), F.lit("src2").alias("target"))
    return curation.cross_references(_mentions(t).select("document_id", slugify(F.col("name")).alias("slug")), existing)


@query("k14_assembled_pages", """
WITH s AS (SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || CASE WHEN turn = 0 THEN '~~' || text || '~~' ELSE text END || chr(10) || chr(10) || '*Source: ' || role || '*', chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS slug, '# Conversation ' || conv_id || chr(10) || chr(10) || body AS markdown FROM s""")
def assembled_pages(t):
    pages = t.conversations.select(F.col("conv_id").cast("string").alias("slug"), F.concat(F.lit("Conversation "), "conv_id").alias("title")).distinct()
    sections = t.conversations.select(F.col("conv_id").cast("string").alias("slug"), F.col("turn").alias("position"), F.col("role").alias("heading"), F.col("text").alias("content"), (F.col("turn") == 0).alias("superseded"), F.col("role").alias("source"))
    links = pages.filter("false").select(F.col("slug").alias("source"), F.col("slug").alias("target"))
    return curation.assembled_pages(pages, sections, links)


@query("k15_compile_jobs", "SELECT doc_id AS document_id, 'pending' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def compile_jobs(t):
    return curation.compile_jobs(t.documents.select(F.col("doc_id").alias("document_id")), t.labels.select(F.col("doc_id").alias("document_id")))


@query("k16_to_generate", "SELECT conv_id AS document_id, role AS kind, arg_max(text, turn) AS content FROM conversations GROUP BY ALL")
def to_generate(t):
    stored = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("role").alias("kind"), F.col("text").alias("content"), F.col("turn").alias("created_at"))
    return curation.to_generate(stored.select("document_id", "kind").distinct(), stored)[0]


@query("k18_related_documents", """
WITH v0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
top AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS s FROM v0 q, v0 v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - s, 12), v.vec_id) <= 10)
SELECT query_id AS source, id AS target, CASE WHEN s >= 0.9 THEN 'similar' ELSE 'related' END AS kind, round(s, 6) AS confidence FROM top WHERE s >= 0.3""")
def related(t):
    hits = vectors.top_k(_vector_queries(t), _vectors(t), 11).filter("id <> query_id")
    hits = retrieval.best(hits.withColumn("score", 1 - F.col("distance")), 10, tie="id").filter("score >= 0.3")
    return hits.select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.when(F.col("score") >= 0.9, "similar").otherwise("related").alias("kind"), F.round("score", 6).alias("confidence"))


@query("a4_page_titles", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '')) AS title FROM pages")
def page_titles(t):
    from ..sources.files import title_of

    return t.pages.select("page_id", title_of(F.col("html"), F.col("url")).alias("title"))


@query("l3_newest_changes", "SELECT user_id AS path, event_type AS change_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1")
def newest_changes(t):
    from ..streaming.changes import newest

    changes = t.events.select(F.col("user_id").alias("path"), F.col("event_type").alias("change_type"), F.lit(None).cast("string").alias("previous_path"), "ts")
    return newest(changes).select("path", "change_type", "ts")


@query("h4_query_terms", f"SELECT conv_id, turn, CAST(len({WORDS}) AS BIGINT) AS n_terms FROM conversations WHERE role = 'user' AND text IS NOT NULL AND NOT regexp_matches(lower(text), '(^|\\s)(or|and)(\\s|$)') AND NOT contains(text, '\"')")
def query_terms(t):
    plain = t.conversations.filter("role = 'user' and text is not null").filter(~F.rlike(F.lower("text"), F.lit(r"(^|\s)(or|and)(\s|$)")) & ~F.contains("text", F.lit('"')))
    return plain.select("conv_id", "turn", F.size(fulltext.words(F.col("text"))).cast("long").alias("n_terms"))


@query("h4_parsed_queries")
def parsed_queries(t):
    """All user turns through the parser: the words of each phrase of each alternative. SQL can't say its quotes and ORs."""
    asked = t.conversations.filter("role = 'user'").select((F.shiftleft(F.col("conv_id").cast("long"), 32) + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    terms = fulltext.query_terms(asked)
    conv_id, turn = F.shiftright("query_id", 32).alias("conv_id"), F.col("query_id").bitwiseAND(F.lit((1 << 32) - 1)).alias("turn")
    return terms.select(conv_id, turn, "clause", "n_phrases", "phrase", "n_words", "at", "term")


@query("h7_highlights")
def highlights(t):
    from ..functions.text import highlighted

    terms = _text_queries(t).select("query_id", F.split(F.regexp_replace(F.lower("query"), '[^\\p{L}\\p{N} ]|(^| )or ', " "), r"\s+").alias("terms"))
    return _cited(t).join(terms, "query_id").select("query_id", "chunk_id", highlighted(F.col("content"), F.col("terms")).alias("snippet"))


