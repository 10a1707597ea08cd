"""Security documents into linked chunks, by the kind of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.security import cvss_severity, source_type
from ..sources import feeds
from ..work import spread
from .chunking import CHARS_PER_TOKEN, CHUNK_TOKENS, linked, recursive_chunks

COLUMNS = ["chunk_id", "document_id", "chunk_index", "content", "token_count", "prev_chunk_id", "next_chunk_id", "chunk_type", "source_type", "cve_id", "technique_id", "severity"]


def _pieces(rows: DataFrame, kind: str, **columns) -> DataFrame:
    """(document_id, chunk_index, content, chunk_type, source_type, cve_id, technique_id, severity)."""
    defaults = {"cve_id": F.lit(None), "technique_id": F.lit(None), "severity": F.lit("unknown")} | columns
    return rows.select("document_id", "chunk_index", "content", "chunk_type", F.lit(kind).alias("source_type"), *[v.cast("string").alias(k) for k, v in defaults.items()])


def sigma_chunks(texts: DataFrame) -> DataFrame:
    """One piece for each rule."""
    rules = feeds.sigma_rules(texts).select("document_id", F.col("position").alias("chunk_index"), F.col("summary").alias("content"), F.lit("sigma_rule").alias("chunk_type"), "severity", F.try_element_at("technique_ids", F.lit(1)).alias("technique"))
    return _pieces(rules, "sigma_rule", severity=F.col("severity"), technique_id=F.col("technique"))


def nvd_chunks(texts: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """A description of each record, and its references where that is longer than two chunks."""
    records = feeds.nvd_records(texts)
    text = F.concat_ws("\n", "cve_id", "description", F.concat(F.lit("Products: "), F.nullif(F.array_join("products", ", "), F.lit(""))))
    references = F.concat(F.lit("CVE: "), "cve_id", F.lit("\nReferences: "), F.coalesce(F.nullif(F.array_join("references", "\n"), F.lit("")), F.lit("N/A")))
    part = lambda content, kind: F.struct(content.alias("content"), F.lit(kind).alias("chunk_type"))
    parts = F.array_compact(F.array(part(text, "cve_description"), F.when(F.char_length(text) > 2 * chunk_tokens * CHARS_PER_TOKEN, part(references, "cve_references"))))
    rows = records.select("document_id", "position", F.col("cve_id").alias("cve"), F.coalesce("severity", cvss_severity(F.col("cvss_score"))).alias("severity"), F.posexplode(parts).alias("at", "p"))
    rows = rows.select("document_id", (F.col("position") * 2 + F.col("at")).alias("chunk_index"), "p.*", "cve", "severity")
    return _pieces(rows, "nvd_cve", cve_id=F.col("cve"), severity=F.col("severity"))


def attack_chunks(texts: DataFrame) -> DataFrame:
    """One piece for each section with text."""
    sections = feeds.attack_sections(texts)[0]
    rows = sections.select("document_id", F.col("position").alias("chunk_index"), "content", F.lit("mitre_technique").alias("chunk_type"), F.col("technique_id").alias("technique"))
    return _pieces(rows, "mitre_attack", technique_id=F.col("technique"))


def security_chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """docs(document_id, content[, path]) -> linked chunks with source_type, cve_id, technique_id and severity.

    Sigma rules, CVE records and ATT&CK sections are chunks of their own; indicator lists, prose and texts of no
    known kind are cut like any other text. Blank texts give none; files that do not parse give none.
    """
    path = F.col("path") if "path" in docs.columns else None
    typed = spread(docs).filter(F.btrim(F.regexp_replace("content", r"\s+", " ")) != "").select(F.col("document_id").cast("string").alias("document_id"), "content", source_type(F.col("content"), path).alias("source_type"))
    of = lambda kind: typed.filter(F.col("source_type") == kind).select("document_id", F.col("content").alias("text"))
    pieces = sigma_chunks(of("sigma_rule")).unionByName(nvd_chunks(of("nvd_cve"), chunk_tokens)).unionByName(attack_chunks(of("mitre_attack")))
    about = ["source_type", "cve_id", "technique_id", "severity"]
    fed = linked(pieces, carry=about)
    prose = recursive_chunks(typed.filter(~F.col("source_type").isin("sigma_rule", "nvd_cve", "mitre_attack")), chunk_tokens)
    prose = prose.withColumns({"chunk_type": F.lit("prose"), "source_type": F.lit("prose"), "cve_id": F.lit(None).cast("string"), "technique_id": F.lit(None).cast("string"), "severity": F.lit("unknown")})
    return fed.select(*COLUMNS).unionByName(prose.select(*COLUMNS))
