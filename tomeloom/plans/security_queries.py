"""Security feeds, metadata, wiki and catalogue jobs over files and replies that Spark builds from the driver's tables."""

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import security
from ..operators import catalog, curation, fulltext, retrieval
from ..operators.security_chunks import security_chunks
from ..sources import feeds
from ..streaming import changes
from . import ingest as job
from .registry import query


def _nvd(t):
    """A CVE file for each part: bulk, wrapped, bare, keyed by its id, or broken."""
    cve = F.concat(F.lit("CVE-2024-"), F.col("p_partkey") + 1000)
    cpe = F.concat(F.lit("cpe:2.3:a:"), F.replace(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" "), F.lit("_")), F.lit(":"), F.lower("p_type"), F.lit(":*:*"))
    low = F.struct(F.lit("Secondary").alias("type"), F.struct(F.lit(0.1).alias("baseScore"), F.lit(None).cast("string").alias("baseSeverity")).alias("cvssData"))
    own = F.struct(F.lit("Primary").alias("type"), F.struct((F.col("p_size") / 5).alias("baseScore"), F.when(F.col("p_partkey") % 7 == 0, "HIGH").alias("baseSeverity")).alias("cvssData"))
    record = F.struct(
        cve.alias("id"), F.date_format(F.timestamp_seconds(F.col("p_partkey") * 86_400), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("published"),
        F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))).alias("descriptions"), F.struct(F.array(low, own).alias("cvssMetricV31")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(F.lit("en").alias("lang"), F.concat(F.lit("CWE-"), F.col("p_size")).alias("value"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(cpe.alias("criteria")), F.struct(cpe.alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"), F.array(F.struct(F.concat(F.lit("https://x.example/"), F.col("p_partkey")).alias("url"))).alias("references"),
    )
    shape = F.col("p_partkey") % 5
    text = F.when(shape == 0, F.concat(F.lit('{"vulnerabilities": [{"cve": '), F.to_json(record), F.lit("}]}"))).when(shape == 1, F.concat(F.lit('{"cve": '), F.to_json(record), F.lit("}"))).when(shape == 2, F.to_json(record))
    return t.part.select(F.col("p_partkey").alias("document_id"), text.when(shape == 3, F.concat(F.lit('{"'), cve, F.lit('": '), F.to_json(record), F.lit("}"))).otherwise(F.substring(F.to_json(record), 1, 60)).alias("text"))


_SEVERITY = "CASE WHEN p_partkey % 7 = 0 THEN 'high' WHEN p_size / 5.0 <= 3.9 THEN 'low' WHEN p_size / 5.0 <= 6.9 THEN 'medium' WHEN p_size / 5.0 <= 8.9 THEN 'high' ELSE 'critical' END"


@query("a5_nvd_records", f"""
SELECT p_partkey AS document_id, 'CVE-2024-' || (p_partkey + 1000) AS cve_id, p_name AS description, round(p_size / 5.0, 3) AS cvss_score, {_SEVERITY} AS severity, 'CWE-' || p_size AS cwes,
       replace(replace(p_brand, '#', ' '), '_', ' ') || ' ' || lower(p_type) AS products, 'https://x.example/' || p_partkey AS refs, strftime(make_timestamp(p_partkey * 86400 * 1000000), '%Y-%m-%d') AS day
FROM part WHERE p_partkey % 5 <> 4""")
def nvd_records(t):
    rows = feeds.nvd_records(_nvd(t))
    return rows.select("document_id", "cve_id", "description", F.round("cvss_score", 3).alias("cvss_score"), "severity", F.array_join("cwes", ",").alias("cwes"), F.array_join("products", ",").alias("products"), F.array_join("references", ",").alias("refs"), F.date_format("content_date", "yyyy-MM-dd").alias("day"))


@query("a7_newer_cve_records", """
SELECT c_custkey AS document_id, 'CVE-2023-' || (c_custkey + 1000) AS cve_id, c_name AS description, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE 9.1::DOUBLE END AS cvss_score, CASE WHEN c_custkey % 4 = 3 THEN 'unknown' ELSE 'critical' END AS severity,
       c_mktsegment || ' Server' AS products, CASE WHEN c_custkey % 2 = 0 THEN '2023-02-03' ELSE '2023-01-02' END AS day
FROM customer WHERE c_custkey % 6 <> 5""")
def newer_records(t):
    score = F.struct(F.lit(9.1).alias("baseScore"), F.lit(None).cast("string").alias("baseSeverity"))
    three = F.array(F.when(F.col("c_custkey") % 4 == 0, F.struct(score.alias("cvssV3_1"), F.lit(None).cast("struct<baseScore:double,baseSeverity:string>").alias("cvssV3_0"))).when(F.col("c_custkey") % 4 < 3, F.struct(F.lit(None).cast("struct<baseScore:double,baseSeverity:string>").alias("cvssV3_1"), score.alias("cvssV3_0"))))
    cna = F.struct(F.array(F.struct(F.lit("en").alias("lang"), F.col("c_name").alias("value"))).alias("descriptions"), F.array_compact(three).alias("metrics"), F.array(F.struct(F.col("c_mktsegment").alias("vendor"), F.lit("Server").alias("product"))).alias("affected"), F.array(F.struct(F.lit("u").alias("url"))).alias("references"))
    about = F.struct(F.concat(F.when(F.col("c_custkey") % 6 == 5, "no-id-").otherwise("CVE-2023-"), F.col("c_custkey") + 1000).alias("cveId"), F.when(F.col("c_custkey") % 2 == 0, "2023-02-03T00:00:00Z").alias("datePublished"), F.lit("2023-01-02T00:00:00Z").alias("dateReserved"))
    texts = t.customer.select(F.col("c_custkey").alias("document_id"), F.to_json(F.struct(F.lit("CVE_RECORD").alias("dataType"), about.alias("cveMetadata"), F.struct(cna.alias("cna")).alias("containers"))).alias("text"))
    return feeds.nvd_records(texts).select("document_id", "cve_id", "description", "cvss_score", "severity", F.array_join("products", ",").alias("products"), F.date_format("content_date", "yyyy-MM-dd").alias("day"))


def _attack(t):
    """A bundle or a technique page for each customer, or neither."""
    key, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    reference = F.when(key % 4 == 0, F.struct(F.lit("mitre").alias("source_name"), F.lit("https://x.example/techniques/T1059/001").alias("url"), F.lit(None).cast("string").alias("external_id"))).otherwise(F.struct(F.lit("mitre").alias("source_name"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("T"), 1000 + key % 9000).alias("external_id")))
    pattern = F.struct(F.lit("attack-pattern").alias("type"), F.col("c_name").alias("name"), F.concat(F.lit("about "), segment).alias("description"), F.array(F.struct(segment.alias("phase_name"))).alias("kill_chain_phases"), F.array(reference).alias("external_references"), F.when(key % 3 == 0, "watch").alias("x_mitre_detection"), F.array(F.lit("patch"), F.lit("train")).alias("x_mitre_mitigations"))
    other = F.struct(F.lit("malware").alias("type"), F.lit("m").alias("name"), F.lit("d").alias("description"), F.array(F.struct(segment.alias("phase_name"))).alias("kill_chain_phases"), F.array(reference).alias("external_references"), F.lit(None).cast("string").alias("x_mitre_detection"), F.array().cast("array<string>").alias("x_mitre_mitigations"))
    bundle = F.to_json(F.struct(F.lit("bundle").alias("type"), F.array(other, pattern).alias("objects")))
    page = F.concat(F.lit("---\nattack_id: T"), 1000 + key % 9000, F.lit('\nname: "'), "c_name", F.lit('"\ntactic: '), segment, F.lit("\nplatforms: windows, linux\n---\nlead of "), segment, F.lit("\n## Detection\nsee it\n## Empty\n\n## Mitigations\npatch\n"))
    return t.customer.select(key.alias("document_id"), F.when(key % 5 == 4, F.concat(F.lit("plain "), segment)).when(key % 2 == 0, bundle).otherwise(page).alias("text"))


_STIX_ID = "CASE WHEN c_custkey % 4 = 0 THEN 'T1059.001' ELSE 'T' || (1000 + c_custkey % 9000) END"
_SECTIONS = f"""
SELECT c_custkey AS document_id, 3 AS position, c_name AS name, {_STIX_ID} AS technique_id, lower(c_mktsegment) AS tactic, 'description' AS section, 'about ' || lower(c_mktsegment) AS content FROM customer WHERE c_custkey % 5 <> 4 AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 4, c_name, {_STIX_ID}, lower(c_mktsegment), 'detection', 'watch' FROM customer WHERE c_custkey % 5 <> 4 AND c_custkey % 2 = 0 AND c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 5, c_name, {_STIX_ID}, lower(c_mktsegment), 'mitigations', 'patch' || chr(10) || 'train' FROM customer WHERE c_custkey % 5 <> 4 AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, p, c_name, 'T' || (1000 + c_custkey % 9000), lower(c_mktsegment), s, CASE p WHEN 0 THEN 'lead of ' || lower(c_mktsegment) ELSE x END FROM customer, (VALUES (0, 'description', ''), (1, 'detection', 'see it'), (3, 'mitigations', 'patch')) v(p, s, x) WHERE c_custkey % 5 <> 4 AND c_custkey % 2 = 1"""


@query("a8_attack_sections", _SECTIONS)
def attack_sections(t):
    return feeds.attack_sections(_attack(t))[0].select("document_id", "position", "name", "technique_id", "tactic", "section", "content")


@query("a10_attack_rejects", "SELECT c_custkey AS document_id FROM customer WHERE c_custkey % 5 = 4")
def attack_rejects(t):
    return feeds.attack_sections(_attack(t))[1].filter("error is not null").select("document_id")


def _sigma(t):
    """Two rules in one file for each part, or a broken file."""
    level = F.element_at(F.array(*map(F.lit, ("critical", "high", "Medium", "low", "informational", "odd"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rule = lambda n: F.concat(F.lit("title: "), "p_name", F.lit(f" {n}\nid: r{n}-"), F.col("p_partkey"), F.lit("\nlevel: "), level, F.lit("\nlogsource:\n  product: Windows\n  service: "), F.lower("p_type"), F.lit("\ndetection:\n  sel: {a: 1}\n  condition: sel\ntags:\n  - attack.defense_evasion\n  - attack.t"), 1000 + F.col("p_size"), F.lit(".001\n  - car.x\n"))
    return t.part.select(F.col("p_partkey").alias("document_id"), F.when(F.col("p_partkey") % 10 == 9, F.lit("title: [broken\nlogsource: x\ndetection: y")).otherwise(F.concat(rule(1), F.lit("---\n"), rule(2), F.lit("---\nnote: no rule\n"))).alias("text"))


_LEVEL = "['critical', 'high', 'medium', 'low', 'info', 'unknown'][p_partkey % 6 + 1]"


@query("a11_sigma_rules", f"""
SELECT CAST(p_partkey AS VARCHAR) AS document_id, n - 1 AS position, p_name || ' ' || n AS title, 'r' || n || '-' || p_partkey AS rule_id, {_LEVEL} AS severity, 'T' || (1000 + p_size) || '.001' AS techniques, 'defense evasion' AS tactics, 'windows' AS platforms, lower(p_type) AS log_sources, 'sel' AS condition
FROM part, (VALUES (1), (2)) v(n) WHERE p_partkey % 10 <> 9""")
def sigma_rules(t):
    rows = feeds.sigma_rules(_sigma(t))
    lists = {"techniques": "technique_ids", "tactics": "tactics", "platforms": "platforms", "log_sources": "log_sources"}
    return rows.select("document_id", "position", "title", "rule_id", "severity", *[F.array_join(v, ",").alias(k) for k, v in lists.items()], "condition")


@query("h15_sigma_severities", "SELECT o_orderkey, ['critical', 'high', 'medium', 'low', 'info', 'info', 'unknown', 'unknown'][o_orderkey % 8 + 1] AS severity FROM orders")
def sigma_severities(t):
    given = F.array(*map(F.lit, ("critical", " HIGH ", "medium", "low", "informational", "informational_only", "severe")), F.lit(None))
    return t.orders.select("o_orderkey", security.sigma_severity(F.element_at(given, (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("severity"))


@query("h19_products", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN lower(p_type) ELSE replace(p_brand, '#', ' ') || ' ' || lower(p_type) END AS product FROM part")
def products(t):
    vendor = F.when(F.col("p_partkey") % 3 == 2, F.replace("p_brand", F.lit("#"), F.lit("_"))).otherwise("*")
    product = F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.lower("p_type"))
    return t.part.select("p_partkey", security.vendor_product(F.concat(F.lit("cpe:2.3:o:"), vendor, F.lit(":"), product, F.lit(":1.0:*"))).alias("product"))


@query("i7_security_chunks", f"""
WITH s AS ({_SECTIONS}),
c AS (
  SELECT 'm' || document_id AS document_id, row_number() OVER (PARTITION BY document_id ORDER BY position) - 1 AS chunk_index, content, 'mitre_technique' AS chunk_type, 'mitre_attack' AS source_type, technique_id, NULL AS cve_id, 'unknown' AS severity FROM s
  UNION ALL SELECT 's' || p_partkey, n - 1, p_name || ' ' || n || chr(10) || 'Condition: sel' || chr(10) || 'Tags: attack.defense_evasion, attack.t' || (1000 + p_size) || '.001, car.x', 'sigma_rule', 'sigma_rule', 'T' || (1000 + p_size) || '.001', NULL, {_LEVEL} FROM part, (VALUES (1), (2)) v(n) WHERE p_partkey % 10 <> 9
  UNION ALL SELECT 'n' || p_partkey, 0, 'CVE-2024-' || (p_partkey + 1000) || chr(10) || p_name || chr(10) || 'Products: ' || replace(p_brand, '#', ' ') || ' ' || lower(p_type), 'cve_description', 'nvd_cve', NULL, 'CVE-2024-' || (p_partkey + 1000), {_SEVERITY} FROM part WHERE p_partkey % 5 IN (0, 1, 3)
  UNION ALL SELECT 'm' || c_custkey, 0, 'plain ' || lower(c_mktsegment), 'prose', 'prose', NULL, NULL, 'unknown' FROM customer WHERE c_custkey % 5 = 4
  UNION ALL SELECT 'n' || p_partkey, 0, NULL, 'prose', 'prose', NULL, NULL, 'unknown' FROM part WHERE p_partkey % 5 IN (2, 4))
SELECT document_id, chunk_index, content, chunk_type, source_type, technique_id, cve_id, severity, chunk_index > 0 AS has_prev, chunk_index + 1 < count(*) OVER (PARTITION BY document_id) AS has_next FROM c""")
def dispatched(t):
    """Sigma, CVE and ATT&CK files together; what is detected as none of them, bare records and broken files too, is cut as prose."""
    marked = lambda texts, mark: texts.select(F.concat(F.lit(mark), "document_id").alias("document_id"), F.col("text").alias("content"))
    chunks = security_chunks(marked(_sigma(t), "s").unionByName(marked(_nvd(t), "n")).unionByName(marked(_attack(t), "m")))
    broken = (F.col("source_type") == "prose") & F.startswith("document_id", F.lit("n"))
    return chunks.select("document_id", "chunk_index", F.when(~broken, F.col("content")).alias("content"), "chunk_type", "source_type", "technique_id", "cve_id", "severity", F.col("prev_chunk_id").isNotNull().alias("has_prev"), F.col("next_chunk_id").isNotNull().alias("has_next"))


@query("d14_ioc_lists", "SELECT event_id, user_id % 6 + event_id % 4 >= 2 AND (user_id % 6) / (user_id % 6 + event_id % 4) >= 0.8 AS is_list FROM events")
def ioc_lists(t):
    """Texts of some indicator lines of three kinds, defanged or not, and some other lines."""
    indicator = lambda i: F.element_at(F.array(F.concat(F.lit("10.1."), F.col("user_id") % 256, F.lit("."), i), F.concat(F.lit("host"), i, F.lit("[.]example(.)com")), F.md5(i.cast("string").cast("binary"))), (i % 3 + 1).cast("int"))
    some = lambda n, make: F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: i < n), make)
    lines = F.concat(some(F.col("user_id") % 6, indicator), some(F.col("event_id") % 4, lambda i: F.concat(F.lit("seen at noon "), i)))
    return t.events.select("event_id", (security.ioc_ratio(F.array_join(lines, " \r\n\n")) >= security.IOC_RATIO).alias("is_list"))


@query("h20_iso_dates", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN epoch(o_orderdate) WHEN 1 THEN epoch(o_orderdate) + 3723 WHEN 2 THEN epoch(o_orderdate) + 3723 WHEN 3 THEN epoch(o_orderdate) + 3723 - 7200 END::BIGINT AS seconds FROM orders""")
def iso_dates(t):
    """Dates, naive times, times in UTC and in another zone; bad dates and other texts."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    given = F.array(day, F.concat(day, F.lit("T01:02:03")), F.concat(day, F.lit("T01:02:03Z")), F.concat(day, F.lit("T01:02:03+02:00")), F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-45")), F.lit("soon"))
    return t.orders.select("o_orderkey", F.unix_seconds(security.iso_timestamp(F.element_at(given, (F.col("o_orderkey") % 6 + 1).cast("int")))).alias("seconds"))


def _metadata(t):
    fields = {
        "source_type": F.when(F.col("p_partkey") % 3 == 0, "nvd_cve").otherwise("prose"), "tlp_level": F.lit("amber"), "cve_id": F.concat(F.lit("CVE-2024-"), F.col("p_partkey") + 1000), "cvss_score": F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 5), "severity": F.lit("high"),
        "cwe_ids": F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("CWE-"), i)), "content_date": F.timestamp_seconds(F.col("p_partkey") * 86_400),
    }
    return t.part.select("p_partkey", "p_size", F.struct(*[fields.get(k, F.lit(None)).cast(v).alias(k) for k, v in security.METADATA_FIELDS.items()]).alias("m"))


@query("h33_metadata_round_trip", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'nvd_cve' ELSE 'prose' END AS source_type, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'low' ELSE 'high' END AS severity, CASE WHEN p_partkey % 5 = 0 THEN 'white' ELSE 'amber' END AS tlp_level,
       CASE WHEN p_partkey % 2 = 0 THEN round(p_size / 5.0, 3) END AS cvss_score, p_size::BIGINT AS cwes, strftime(make_timestamp(p_partkey * 86400 * 1000000), '%Y-%m-%d') AS day FROM part""")
def metadata_round_trip(t):
    """Split into columns and JSON, some columns changed, unknown fields and values added, and joined again."""
    rows = _metadata(t).select("p_partkey", *security.split_metadata(F.col("m")))
    key = F.col("p_partkey")
    rows = rows.withColumns({"severity": F.when(key % 4 == 0, "dire").when(key % 4 == 1, "low").otherwise(F.col("severity")), "tlp_level": F.when(key % 5 == 0, "black").otherwise(F.col("tlp_level")), "security_metadata": F.regexp_replace("security_metadata", r"^\{", '{"old_field":1,')})
    m = security.joined_metadata(F.col("security_metadata"), {c: F.col(c) for c in security.METADATA_COLUMNS})
    rows = rows.select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", "m.source_type", "m.severity", "m.tlp_level", F.round("m.cvss_score", 3).alias("cvss_score"), F.size("m.cwe_ids").cast("long").alias("cwes"), F.date_format("m.content_date", "yyyy-MM-dd").alias("day"))


@query("h32_scalar_metadata", """
SELECT p_partkey, '' AS source_url, CASE WHEN p_partkey % 2 = 0 THEN round(p_size / 5.0, 3) ELSE 0.0 END AS cvss_score, list_reduce(list_transform(range(1, least(p_size, 32) + 1), lambda i: 'CWE-' || i), lambda a, b: a || '|' || b) AS cwe_ids,
       least(p_size, 32)::BIGINT AS back, strftime(make_timestamp(p_partkey * 86400 * 1000000), '%Y-%m-%dT00:00:00') AS content_date FROM part""")
def scalar_metadata(t):
    rows = _metadata(t).select("p_partkey", security.scalar_metadata(F.col("m")).alias("s"))
    return rows.select("p_partkey", "s.source_url", F.round("s.cvss_score", 3).alias("cvss_score"), "s.cwe_ids", F.size(security.listed(F.col("s.cwe_ids"), r"\|")).cast("long").alias("back"), "s.content_date")


_ASK = len("Name severity, mitre_technique_id, threat_actors, malware_families, platforms, ioc_types and content_date as JSON for this text:\n")


def _stub(prompts: pd.Series) -> pd.Series:
    """A model for tests: good, half wrong or no JSON, by the prompt's length."""
    replies = ('```json\n{"severity": " HIGH ", "mitre_technique_id": "T1059.001", "platforms": ["Windows"], "content_date": "2024-05-06T07:08:09Z"}\n```', '{"severity": "awful", "mitre_technique_id": "T99", "content_date": "May"}', "I can't say.")
    return pd.Series([replies[len(p) % 3] for p in prompts])


@query("k8_prose_metadata", f"""
WITH n AS (SELECT doc_id, (least(length(text), 4000) + {_ASK}) % 3 AS k, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' AS blank FROM documents)
SELECT doc_id AS document_id, 'prose' AS source_type, CASE WHEN NOT blank AND k = 0 THEN 'high' ELSE 'unknown' END AS severity, CASE WHEN NOT blank AND k = 0 THEN 'T1059.001' END AS technique_id, CASE WHEN NOT blank AND k = 0 THEN 'windows' END AS platform, CASE WHEN NOT blank AND k = 0 THEN '2024-05-06' END AS day FROM n""")
def prose_metadata(t):
    rows = curation.prose_metadata(t.documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")), _stub)
    return rows.select("document_id", "metadata.source_type", "metadata.severity", F.col("metadata.mitre_technique_id").alias("technique_id"), F.try_element_at("metadata.platforms", F.lit(1)).alias("platform"), F.date_format("metadata.content_date", "yyyy-MM-dd").alias("day"))


@query("k10_entities", """
SELECT s_suppkey AS document_id, 'A' || s_nationkey AS name, 'component' AS kind, 0.9::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 5 < 3
UNION ALL SELECT s_suppkey, s_name, 'concept', 0.5 FROM supplier WHERE s_suppkey % 5 < 3""")
def entities(t):
    named = F.concat(F.lit('Here they are:\n[{"name": "A'), "s_nationkey", F.lit('", "entity_type": "component", "summary": "s", "confidence": 0.9}, {"name": "'), "s_name", F.lit('"}, {"summary": "nameless"}]\nDone.'))
    reply = F.when(F.col("s_suppkey") % 5 < 3, named).when(F.col("s_suppkey") % 5 == 3, "none found").otherwise("[broken")
    return curation.entities_of(t.supplier.select(F.col("s_suppkey").alias("document_id"), reply.alias("reply"))).select("document_id", "name", "kind", "confidence")


@query("k11_page_sections", """
SELECT 'p' || p_partkey AS slug, i AS position, CASE WHEN i % 3 = 2 THEN 'Section ' || (i + 1) ELSE 'H' || i END AS heading, CASE WHEN i % 4 = 3 THEN '' ELSE p_name END AS content FROM part, range(0, 10) r(i) WHERE i < p_size""")
def page_sections(t):
    section = lambda i: F.concat(F.lit('{"heading": '), F.when(i % 3 == 2, F.lit('""')).otherwise(F.concat(F.lit('"H'), i, F.lit('"'))), F.when(i % 4 == 3, F.lit("}")).otherwise(F.concat(F.lit(', "content": "'), "p_name", F.lit('"}'))))
    reply = F.concat(F.lit('{"sections": ['), F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), section), ", "), F.lit("]}"))
    rows = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("slug"), F.col("p_partkey").alias("document_id"), F.lit(1).alias("priority"), reply.alias("reply"))
    return curation.page_sections(rows).select("slug", "position", "heading", "content")


@query("k12_applied_updates", """
WITH s AS (SELECT l_orderkey AS slug, l_linenumber AS position, 'h' || l_linenumber AS heading, min(l_quantity) AS content, count(*) FROM lineitem GROUP BY ALL),
u AS (SELECT s.*, CASE o_orderkey % 5 WHEN 0 THEN 'append' WHEN 1 THEN 'replace' WHEN 2 THEN 'supersede' WHEN 3 THEN 'flag' ELSE 'keep' END AS outcome FROM s JOIN orders ON o_orderkey = slug WHERE position = 1),
m AS (SELECT slug, max(position) AS last FROM s GROUP BY slug)
SELECT s.slug, s.heading, CASE WHEN outcome = 'replace' THEN 'new' ELSE CAST(s.content AS VARCHAR) END AS content, s.position, coalesce(outcome = 'supersede', false) AS superseded, CASE WHEN outcome = 'flag' THEN 'conflict' END AS flag FROM s LEFT JOIN u ON u.slug = s.slug AND u.heading = s.heading
UNION ALL SELECT u.slug, u.heading, 'new', last + 1, false, NULL FROM u JOIN m USING (slug) WHERE outcome IN ('append', 'supersede')
UNION ALL SELECT slug, 'h1', 'history', 0, true, NULL FROM m""")
def applied_updates(t):
    """Each order's lines as sections, and a section of the first one's heading that was superseded before: it never changes."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").cast("long").alias("position")).agg(F.min("l_quantity").cast("string").alias("content"))
    sections = rows.select("slug", F.concat(F.lit("h"), "position").alias("heading"), "content", "position", F.lit("old").alias("source"), F.lit(1).alias("priority"), F.lit(False).alias("superseded"), F.lit(None).cast("string").alias("flag"))
    history = sections.select("slug").distinct().select("slug", F.lit("h1").alias("heading"), F.lit("history").alias("content"), F.lit(0).cast("long").alias("position"), F.lit("old").alias("source"), F.lit(1).alias("priority"), F.lit(True).alias("superseded"), F.lit(None).cast("string").alias("flag"))
    outcome = F.element_at(F.array(*map(F.lit, ("append", "replace", "supersede", "flag", "keep"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    decided = sections.filter("position = 1").join(t.orders, F.col("slug") == F.col("o_orderkey")).select("slug", "heading", F.lit("new").alias("content"), outcome.alias("outcome"), F.lit("doc").alias("source"), F.lit(2).alias("priority"), F.lit(0).alias("ordinal"))
    return curation.applied_updates(decided, sections.unionByName(history)).select("slug", "heading", "content", "position", "superseded", "flag")


@query("k15_finished_jobs", "SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_custkey % 3 = 0 THEN 'pending' WHEN o_custkey % 3 = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 1 THEN 'no reply' END AS error FROM orders")
def finished_jobs(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("completed").alias("status"))
    outcomes = t.orders.filter("o_custkey % 3 > 0").select(F.col("o_orderkey").alias("document_id"), F.lit(3).alias("n_chunks"), F.lit(0).alias("n_entities"), F.when(F.col("o_custkey") % 3 == 1, "no reply").alias("error"))
    return curation.finished_jobs(jobs, outcomes, F.timestamp_seconds(F.lit(0))).select("document_id", "status", "error")


@query("k17_contradictions", "SELECT event_id, CASE event_type WHEN 'click' THEN 'factual' WHEN 'view' THEN 'scope' END AS kind, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'medium' END AS severity FROM events")
def contradictions(t):
    reply = F.when(F.col("event_type") == "click", '```json\n{"conflict_type": "factual", "description": "d", "severity": "high"}\n```').when(F.col("event_type") == "view", 'Yes: {"conflict_type": "scope"}').when(F.col("event_type") == "error", "no JSON").otherwise('"none"')
    return curation.contradictions_of(t.events.select("event_id", reply.alias("reply"))).select("event_id", "contradiction.kind", "contradiction.severity")


@query("a17_catalogue_lines", "SELECT o_orderkey AS document_id, '| ' || o_orderkey || ' | ' || substr('Order of ' || o_custkey || ' with priority ' || o_orderpriority, 1, 32) || ' | txt | ' || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' |' AS line FROM orders")
def catalogue_lines(t):
    rows = t.orders.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("Order of "), "o_custkey", F.lit(" with priority "), "o_orderpriority").alias("title"), F.lit("txt").alias("file_type"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return catalog.catalogue_lines(rows, "markdown")


@query("a18_wiki_index", "SELECT c_name AS title, 'c' || c_custkey AS slug, '- [[c' || c_custkey || ']] ' || c_name || ' (' || lower(c_mktsegment) || ')' AS line FROM customer")
def wiki_index(t):
    return catalog.wiki_index(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("slug"), F.col("c_name").alias("title"), F.lower("c_mktsegment").alias("kind")))


@query("a20_category_seeds", """
SELECT 'top-' || p_partkey AS slug, 'Top ' || p_partkey AS name, p_name AS description, NULL AS parent_slug FROM part WHERE p_partkey % 7 <> 6
UNION ALL SELECT 'own' || p_partkey, p_name, NULL, 'top-' || p_partkey FROM part WHERE p_partkey % 7 <> 6
UNION ALL SELECT 'leaf-' || p_partkey, 'Leaf ' || p_partkey, NULL, 'own' || p_partkey FROM part WHERE p_partkey % 7 <> 6""")
def category_seeds(t):
    tree = F.concat(F.lit("categories:\n  - name: Top "), "p_partkey", F.lit("\n    description: "), "p_name", F.lit("\n    children:\n      - name: "), "p_name", F.lit("\n        slug: own"), "p_partkey", F.lit("\n        children:\n          - name: Leaf "), "p_partkey", F.lit("\n          - slug: nameless\n"))
    texts = t.part.select(F.when(F.col("p_partkey") % 7 == 6, F.lit("categories: [broken")).otherwise(tree).alias("text"))
    return catalog.category_seeds(texts).select("slug", "name", "description", "parent_slug")


@query("f2_listings", "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS place FROM supplier")
def listings(t):
    """Categories in the order of their names, within each parent."""
    return t.supplier.select("s_suppkey", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_name")).alias("place"))


@query("c1_titled_search", """
WITH q AS (SELECT source AS query_id, regexp_replace(source, '[^a-z0-9]', '') AS a FROM documents GROUP BY 1),
d AS (SELECT doc_id, source AS title, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
h AS (SELECT query_id, doc_id, 1.0 * ln(2) * (title = a)::INT + 0.4 * ln(1 + len(list_filter(ws, lambda w: w = a))) AS r FROM q, d WHERE title = a OR list_contains(ws, a))
SELECT query_id, doc_id AS chunk_id, round(r / (r + 1), 6) AS rank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(r / (r + 1), 12) DESC, doc_id) AS rank FROM h QUALIFY rank <= 20""")
def titled_search(t):
    """Each source's name asked of all documents, whose titles are their sources' names."""
    asked = t.documents.select(F.col("source").alias("query_id"), F.col("source").alias("query")).distinct()
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("title"))
    return fulltext.search(asked, chunks, 20).select("query_id", "chunk_id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))


@query("h6_english_terms")
def english_terms(t):
    return t.documents.select("doc_id", F.array_join(fulltext.english_terms(F.col("text")), " ").alias("terms"))


@query("k9_step_log", """
SELECT CAST(event_id AS VARCHAR) AS document, s.step, s.status FROM events, (VALUES ('discovered', 'success', 'x'), ('extracted', 'success', 's'), ('extracted', 'success', 'k'), ('chunked', 'success', 's'), ('skipped', 'skipped', 'k'), ('failed', 'failed', 'f')) s(step, status, w)
WHERE s.w = 'x' OR s.w = CASE WHEN event_type = 'error' THEN 'f' WHEN event_type = 'view' THEN 'k' ELSE 's' END""")
def step_log(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("success")
    results = t.events.select(F.col("event_id").cast("string").alias("path"), status.alias("status"), F.lit("new").alias("decision"), F.lit(1).alias("n_chunks"))
    return job.step_log(results, F.current_timestamp()).select("document", "step", "status")


@query("l8_wiki_pending", "SELECT event_id AS document_id, 'pending' AS status FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT doc_id FROM labels)")
def wiki_pending(t):
    results = t.events.select(F.col("event_id").alias("path"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return job.wiki_pending(results, t.labels.select(F.col("doc_id").alias("document_id")))


@query("l2_routed_changes", "SELECT event_id, 'w' || (user_id % 10) AS watch_id FROM events WHERE user_id % 10 < 6 UNION ALL SELECT event_id, 'all' FROM events")
def routed_changes(t):
    """Changes below /u<digit>/, six of which are watched, and all below /."""
    rows = t.events.select("event_id", F.concat(F.lit("/u"), F.col("user_id") % 10, F.lit("/"), "event_type", F.lit("/f.txt")).alias("path"))
    watches = t.events.filter("user_id % 10 < 6").select(F.concat(F.lit("w"), F.col("user_id") % 10).alias("watch_id"), F.concat(F.lit("/u"), F.col("user_id") % 10, F.lit("/")).alias("prefix")).distinct()
    everything = t.events.limit(1).select(F.lit("all").alias("watch_id"), F.lit("/").alias("prefix"))
    return changes.routed(rows, watches.unionByName(everything)).select("event_id", "watch_id")


@query("a12_cloud_changes", """
SELECT 'f' || event_id AS path, CASE WHEN event_type IN ('error', 'signup') THEN 'deleted' ELSE 'modified' END AS change_type, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE user_id END AS size_bytes FROM events WHERE event_id % 2 = 0
UNION ALL SELECT CASE WHEN event_type = 'view' THEN NULL ELSE 'f' || event_id END, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END, user_id FROM events WHERE event_id % 2 = 1 AND event_type <> 'view'""")
def cloud_changes(t):
    """Pages of two kinds of drives: removed, trashed, deleted and root items among them."""
    name, kind = F.concat(F.lit("f"), "event_id"), F.col("event_type")
    first = F.concat(F.lit('{"changes": [{"fileId": "'), name, F.lit('", "removed": '), F.when(kind == "error", "true").otherwise("false"), F.when(kind == "error", F.lit("")).otherwise(F.concat(F.lit(', "file": {"name": "'), name, F.lit('", "trashed": '), F.when(kind == "signup", "true").otherwise("false"), F.when(kind == "signup", F.lit("")).otherwise(F.concat(F.lit(', "size": "'), "user_id", F.lit('"'))), F.lit("}"))), F.lit("}]}"))
    second = F.concat(F.lit('{"value": [{"id": "i", "name": "'), name, F.lit('"'), F.when(kind == "view", ', "root": {"x": "y"}').when(kind == "error", ', "deleted": {"state": "deleted"}').otherwise(""), F.lit(', "size": '), "user_id", F.lit("}]}"))
    return changes.cloud_changes(t.events.select(F.when(F.col("event_id") % 2 == 0, first).otherwise(second).alias("text"))).select("path", "change_type", "size_bytes")


@query("j10_messages", """
SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'No question was asked.' WHEN item_id % 4 = 1 THEN 'Nothing was found for this question.' WHEN item_id % 4 = 2 THEN 'reply' ELSE 'context ' || item_id END AS answer, item_id % 4 > 1 AS asked FROM benchmark""")
def messages(t):
    """Empty questions, questions without results, and a model that fails on some."""

    def model(prompts):
        if prompts.str.contains("fail").any():
            raise ValueError("no model")
        return pd.Series(["reply"] * len(prompts))

    key = F.col("item_id")
    questions = t.benchmark.select(key.alias("query_id"), F.when(key % 4 == 0, " ").when(key % 4 == 3, "fail").otherwise("say").alias("query"))
    contexts = t.benchmark.filter(key % 4 != 1).select(key.alias("query_id"), F.concat(F.lit("context "), key).alias("context"))
    some = curation.answered(questions.filter("query <> 'fail'"), contexts, model)
    return some.unionByName(curation.answered(questions.filter("query = 'fail'"), contexts, model))


@query("j5_text_only_merge", "SELECT doc_id AS chunk_id, round(0.3 * (n_chars + 1.0) / max(n_chars + 1.0) OVER (PARTITION BY lang), 6) AS score FROM documents")
def text_only(t):
    hits = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), (F.col("n_chars") + 1.0).alias("rank_score"))
    return retrieval.merge(None, hits).select("chunk_id", F.round("score", 6).alias("score"))
