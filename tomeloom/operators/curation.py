"""Curation jobs: prompts, replies, tags, and wiki pages as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slugify, snippet

MAX_COMBINED, MAX_SECTIONS, TAG_THRESHOLD, DEFAULT_CONFIDENCE, ENTITY_CONFIDENCE, CLAIM_CHARS = 8000, 10, 0.7, 0.7, 0.5, 500
#: Pages of one document beyond which its pairs are dealt out in blocks of so many.
HUB = 200
SUGGESTIONS = "array<struct<category:string,path:string,name:string,confidence:double,score:double,reasoning:string>>"


def combined(rows: DataFrame, key: str, order: str, text: str, limit: int = MAX_COMBINED) -> DataFrame:
    """(key, combined): the texts of each key in order, joined by blank lines, cut at limit with an ellipsis."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(key).agg(F.array_join(parts, "\n\n").alias("combined")).withColumn("combined", snippet(F.col("combined"), limit))


def first_pieces(rows: DataFrame, key: str, order: str, text: str, n: int, max_chars: int | None = None) -> DataFrame:
    """(key, combined) of the first n texts of each key; with max_chars, none that starts beyond so many characters."""
    w = W.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    if max_chars is not None:
        before = F.coalesce(F.sum(F.char_length(text)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_before", before).filter(F.col("_before") <= max_chars)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(key).agg(F.array_join(parts, "\n\n").alias("combined"))


# What is asked for each kind of derived content.
CONTENT_REQUESTS = {
    "summary": "Write a clear summary of the text.",
    "flash_card": "Write question and answer cards on the text.",
    "cliff_notes": "List the key points of the text.",
    "outline": "Write a nested outline of the text.",
    "extract": "List the facts, names and dates of the text.",
}


def content_prompt(kind: Column, text: Column) -> Column:
    asks = F.create_map(*[F.lit(x) for pair in CONTENT_REQUESTS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(asks, kind), F.lit(CONTENT_REQUESTS["summary"])), F.lit("\n\nText:\n"), text)


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer from the context and name its sources:"))


def tag_prompt(text: Column, paths: Column) -> Column:
    return F.concat(F.lit("Categories:\n"), F.array_join(paths, "\n"), F.lit("\n\nName the fitting ones as JSON for this text:\n"), text)


def generated(prompts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """prompts(prompt, ...) with `reply` from a user's batch function, loaded once for each task; a failed batch
    gives replies that begin with Error:."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield pd.Series(model(batch).tolist(), dtype="object")
            except Exception as error:
                yield pd.Series([f"Error: {error}"] * len(batch), dtype="object")

    return prompts.withColumn("reply", reply("prompt"))


def json_part(reply: Column) -> Column:
    """The JSON object or array in a reply, without a code fence; null if there is none."""
    bare = F.regexp_replace(reply, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def suggestions(replies: DataFrame) -> DataFrame:
    """replies(document_id, reply) -> (document_id, path, confidence, reasoning): a list, one object, or an object with
    suggestions or categories; confidences are clamped to 0..1, score stands in, then the default."""
    text = json_part(F.col("reply"))
    inner = lambda name: F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")
    listed = F.coalesce(F.to_json(inner("suggestions")), F.to_json(inner("categories")), F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))))
    rows = replies.filter(text.isNotNull()).select("document_id", F.explode(F.from_json(listed, SUGGESTIONS)).alias("s"))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("s.confidence", "s.score", F.lit(DEFAULT_CONFIDENCE))))
    return rows.select("document_id", F.coalesce("s.path", "s.category", "s.name").alias("path"), sure.alias("confidence"), F.substring("s.reasoning", 1, 200).alias("reasoning")).filter("path is not null")


def entities_of(replies: DataFrame) -> DataFrame:
    """replies(document_id, reply) -> (document_id, name, kind, summary, confidence) of the entities that a reply lists; defaults
    are concept, no summary and ENTITY_CONFIDENCE; a reply without a list, or whose list is no JSON, gives none."""
    listed = F.nullif(F.regexp_extract("reply", r"(?s)(\[.*\])", 1), F.lit(""))
    rows = replies.select("document_id", F.explode(F.from_json(listed, "array<struct<name:string,entity_type:string,summary:string,confidence:double>>")).alias("e")).filter("e.name is not null")
    return rows.select("document_id", "e.name", F.coalesce("e.entity_type", F.lit("concept")).alias("kind"), F.coalesce("e.summary", F.lit("")).alias("summary"), F.coalesce("e.confidence", F.lit(ENTITY_CONFIDENCE)).alias("confidence"))


def page_sections(replies: DataFrame, max_sections: int = MAX_SECTIONS) -> DataFrame:
    """replies(slug, document_id, priority, reply) -> (slug, position, heading, content, source, priority): the first sections of a new page."""
    parts = F.from_json(json_part(F.col("reply")), "struct<sections:array<struct<heading:string,content:string>>>")["sections"]
    rows = replies.select("slug", "document_id", "priority", F.posexplode(F.slice(parts, 1, max_sections)).alias("position", "s"))
    heading = F.coalesce(F.nullif(F.col("s.heading"), F.lit("")), F.concat(F.lit("Section "), F.col("position") + 1))
    return rows.select("slug", "position", heading.alias("heading"), F.coalesce("s.content", F.lit("")).alias("content"), F.col("document_id").alias("source"), "priority")


def contradictions_of(replies: DataFrame) -> DataFrame:
    """replies(reply, ...) with `contradiction`, a struct of kind, description, both claims and severity; null where the reply says none."""
    read = F.from_json(json_part(F.col("reply")), "struct<conflict_type:string,description:string,existing_claim:string,new_claim:string,severity:string>")
    none = F.lower(F.btrim(F.replace("reply", F.lit('"'), F.lit("")))) == "none"
    found = F.struct(read["conflict_type"].alias("kind"), F.coalesce(read["description"], F.lit("")).alias("description"), F.coalesce(read["existing_claim"], F.lit("")).alias("existing_claim"), F.coalesce(read["new_claim"], F.lit("")).alias("new_claim"), F.coalesce(read["severity"], F.lit("medium")).alias("severity"))
    return replies.withColumn("contradiction", F.when(~none & read["conflict_type"].isNotNull(), found))


def contradiction_prompt(existing: Column, new: Column) -> Column:
    """What a model is asked about two texts; the first CLAIM_CHARS of each."""
    return F.concat(F.lit("Do these two texts contradict each other? Answer none, or JSON with conflict_type, description, existing_claim, new_claim and severity.\n\nExisting: "), F.substring(existing, 1, CLAIM_CHARS), F.lit("\n\nNew: "), F.substring(new, 1, CLAIM_CHARS))


def new_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """entities(document_id, name, kind) -> pages(slug, title, kind) that don't exist yet, the first name of a slug."""
    rows = entities.withColumn("slug", slugify(F.col("name"))).filter("slug <> ''")
    firsts = rows.groupBy("slug").agg(F.min_by(F.struct(F.col("name").alias("title"), F.coalesce("kind", F.lit("concept")).alias("kind")), F.struct("document_id", "name")).alias("x"))
    return firsts.select("slug", "x.*").join(pages.select("slug"), "slug", "left_anti")


def cross_references(mentions: DataFrame, existing: DataFrame | None = None, hub: int = HUB) -> DataFrame:
    """mentions(document_id, slug) -> (source, target) of pages named in one document, both ways, not there yet.

    The pairs of a document are the answer; the slugs of one that names more than `hub` pages are dealt out in
    blocks by slug, and each slug meets the blocks one by one, so no task holds all its pairs or its whole list.
    """
    rows = mentions.select("document_id", "slug").distinct()
    blocks = rows.groupBy(F.col("document_id").alias("_d")).agg(F.ceil(F.count("*") / hub).cast("int").alias("_blocks"))
    dealt = rows.join(blocks, F.col("document_id") == F.col("_d")).select("document_id", "slug", "_blocks", F.pmod(F.xxhash64("slug"), F.col("_blocks")).cast("int").alias("_block"))
    lists = dealt.groupBy("document_id", "_block").agg(F.collect_list("slug").alias("targets")).withColumnsRenamed({"document_id": "_e", "_block": "_b"})
    asking = dealt.select("document_id", F.col("slug").alias("source"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_at"))
    pairs = asking.join(lists, (F.col("document_id") == F.col("_e")) & (F.col("_at") == F.col("_b"))).select("source", F.explode("targets").alias("target")).filter("source <> target").distinct()
    return pairs if existing is None else pairs.join(existing, ["source", "target"], "left_anti")


def update_actions(updates: DataFrame, sections: DataFrame) -> DataFrame:
    """updates(slug, heading, action, content, priority, document_time) against live sections(slug, heading, priority,
    document_time) -> updates with `outcome`.

    add appends; update replaces the heading's text, or is rejected where there is none; contradictions are
    superseded by the newer text for facts and times, by the strictly greater priority for scope and terms,
    else flagged.
    """
    live = sections.select("slug", "heading", F.col("priority").alias("_priority"), F.col("document_time").alias("_time"), F.lit(True).alias("_live"))
    rows = updates.join(live, ["slug", "heading"], "left")
    found = F.coalesce("_live", F.lit(False))
    by_time = F.when(F.col("document_time") >= F.col("_time"), "supersede").otherwise("keep")
    by_priority = F.when(F.col("priority") > F.col("_priority"), "supersede").otherwise("flag")
    outcome = F.when(F.col("action") == "add", "append").when(~found, "reject").when(F.col("action") == "update", "replace").when(F.col("action").isin("scope", "terminology"), by_priority).otherwise(by_time)
    return rows.withColumn("outcome", outcome).drop("_priority", "_time", "_live")


def applied_updates(decided: DataFrame, sections: DataFrame) -> DataFrame:
    """decided(slug, heading, content, outcome, source, priority, ordinal) of update_actions() on sections(slug, heading, content,
    position, source, priority, superseded, flag) -> the sections after them.

    replace puts the last text in place; append and supersede add sections after the page's own, in the order of
    `ordinal`; a superseded section stays, marked; flag marks the conflict. Of several updates of one heading the
    last replaces; rejected and kept ones change nothing. Only live sections change: one superseded earlier stays.
    """
    by_heading = decided.groupBy(F.col("slug").alias("_s"), F.col("heading").alias("_h")).agg(
        F.max_by(F.when(F.col("outcome") == "replace", F.struct("content", "source", "priority")), F.when(F.col("outcome") == "replace", F.col("ordinal"))).alias("_new"), F.max(F.col("outcome") == "supersede").alias("_gone"), F.max(F.col("outcome") == "flag").alias("_flag")
    )
    # what has been superseded is history and stays as it is
    old = sections.join(by_heading, (F.col("slug") == F.col("_s")) & (F.col("heading") == F.col("_h")) & ~F.col("superseded"), "left")
    pick = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c)
    old = old.select("slug", "heading", pick("content"), "position", pick("source"), pick("priority"), (F.col("superseded") | F.coalesce("_gone", F.lit(False))).alias("superseded"), F.when(F.coalesce("_flag", F.lit(False)), F.lit("conflict")).otherwise(F.col("flag")).alias("flag"))
    counts = sections.groupBy(F.col("slug").alias("_s")).agg(F.max("position").alias("_last"))
    turn = F.row_number().over(W.partitionBy("slug").orderBy("ordinal", "heading"))
    added = decided.filter(F.col("outcome").isin("append", "supersede")).withColumn("_turn", turn).join(counts, F.col("slug") == F.col("_s"), "left")
    added = added.select("slug", "heading", "content", (F.coalesce("_last", F.lit(-1)) + F.col("_turn")).alias("position"), "source", "priority", F.lit(False).alias("superseded"), F.lit(None).cast("string").alias("flag"))
    return old.unionByName(added)


def finished_jobs(jobs: DataFrame, outcomes: DataFrame, at: Column, batch: int | None = None) -> DataFrame:
    """jobs(document_id, status), outcomes(document_id, n_chunks, n_entities, error) -> jobs with status, error and compiled_at.

    Pending jobs with an outcome are completed, or failed where there is an error; no chunks or no entities is
    complete too. With a batch, only the first so many pending ones by id are taken. Others stay as they are.
    """
    taken = jobs.filter("status = 'pending'").select("document_id")
    if batch is not None:
        taken = taken.orderBy("document_id").limit(batch)
    done = outcomes.join(taken, "document_id", "left_semi").select(F.col("document_id").alias("_d"), "error", F.lit(True).alias("_done"))
    rows = jobs.join(done, F.col("document_id") == F.col("_d"), "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_done"), "completed").otherwise(F.col("status"))
    return rows.select("document_id", status.alias("status"), "error", F.when(F.col("_done") & F.col("error").isNull(), at).alias("compiled_at"))


def prose_metadata(docs: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """docs(document_id, content) -> (document_id, metadata) that a model's reply on the first EXTRACT_CHARS names; blank
    texts are not asked about, and they and unreadable replies have none but their source type."""
    from ..functions.security import EXTRACT_CHARS, extracted_metadata

    blank = F.btrim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) == ""
    ask = F.concat(F.lit("Name severity, mitre_technique_id, threat_actors, malware_families, platforms, ioc_types and content_date as JSON for this text:\n"), F.substring("content", 1, EXTRACT_CHARS))
    rows = generated(docs.select("document_id", F.when(~blank, ask).otherwise(F.lit("")).alias("prompt")), model)
    return rows.select("document_id", extracted_metadata(F.when(F.col("prompt") != "", json_part(F.col("reply")))).alias("metadata"))


# What is said instead of an answer.
NO_QUESTION, NO_RESULTS = "No question was asked.", "Nothing was found for this question."


def answered(questions: DataFrame, contexts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """questions(query_id, query), contexts(query_id, context) -> (query_id, answer, asked): a model's reply where there is a
    question and a context, else a fixed message; a reply that failed gives the context itself."""
    rows = questions.join(contexts, "query_id", "left")
    blank = F.btrim(F.coalesce("query", F.lit(""))) == ""
    rows = generated(rows.withColumn("prompt", F.when(~blank & F.col("context").isNotNull(), answer_prompt(F.col("query"), F.col("context"))).otherwise(F.lit(""))), model)
    reply = F.when(F.startswith("reply", F.lit("Error:")), F.col("context")).otherwise(F.col("reply"))
    answer = F.when(blank, NO_QUESTION).when(F.col("context").isNull(), NO_RESULTS).otherwise(reply)
    return rows.select("query_id", answer.alias("answer"), (F.col("prompt") != "").alias("asked"))


def assembled_pages(pages: DataFrame, sections: DataFrame, links: DataFrame) -> DataFrame:
    """pages(slug, title), sections(slug, position, heading, content, superseded, source), links(source, target) -> (slug, markdown)."""
    text = F.when(F.col("superseded"), F.concat(F.lit("~~"), "content", F.lit("~~"))).otherwise(F.col("content"))
    part = F.concat(F.lit("## "), "heading", F.lit("\n\n"), text, F.coalesce(F.concat(F.lit("\n\n*Source: "), "source", F.lit("*")), F.lit("")))
    bodies = sections.select("slug", F.struct("position", part.alias("part")).alias("x")).groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]), "\n\n").alias("body"))
    see = links.groupBy(F.col("source").alias("slug")).agg(F.concat(F.lit("\n\n## See also\n\n"), F.array_join(F.transform(F.sort_array(F.collect_set("target")), lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")).alias("see"))
    rows = pages.join(bodies, "slug", "left").join(see, "slug", "left")
    return rows.select("slug", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("body", F.lit("")), F.coalesce("see", F.lit(""))).alias("markdown"))


def compile_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """One pending job for each document that has none."""
    return documents.select("document_id").distinct().join(jobs.select("document_id"), "document_id", "left_anti").withColumn("status", F.lit("pending"))


def to_generate(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(document_id, kind), stored(document_id, kind, content, created_at) -> (reusable newest contents, requests left)."""
    newest = stored.groupBy("document_id", "kind").agg(F.max_by("content", "created_at").alias("content"))
    return requests.join(newest, ["document_id", "kind"]), requests.join(newest, ["document_id", "kind"], "left_anti")
