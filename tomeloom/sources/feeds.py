"""Security feeds as tables: NVD, STIX, ATT&CK markdown and Sigma, from columns of whole file texts.

Malformed files give no rows. A document_id beside the text is kept, and so is the place of a record in its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.security import CVE_ID, TECHNIQUE_ID, cvss_severity, iso_timestamp, sigma_severity, tactics, technique_ids, vendor_product
from ..work import spread

_METRIC = "array<struct<type:string,cvssData:struct<baseScore:double,baseSeverity:string>>>"
_TEXTS = "array<struct<lang:string,value:string>>"
CVE = (
    f"struct<id:string,published:string,descriptions:{_TEXTS},metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,weaknesses:array<struct<description:{_TEXTS}>>,"
    "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>,references:array<struct<url:string>>>"
)
_SCORE = "struct<baseScore:double,baseSeverity:string>"
CVE_5 = (
    f"struct<cveMetadata:struct<cveId:string,datePublished:string,dateReserved:string>,containers:struct<cna:struct<descriptions:{_TEXTS},metrics:array<struct<cvssV3_1:{_SCORE},cvssV3_0:{_SCORE}>>,"
    "affected:array<struct<vendor:string,product:string>>,references:array<struct<url:string>>>>>"
)
SEVERITIES = ("critical", "high", "medium", "low", "info")


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _ids(texts: DataFrame) -> list[str]:
    return [c for c in ("document_id",) if c in texts.columns]


def _english(texts: Column) -> Column:
    return F.coalesce(_first(F.filter(texts, lambda d: d["lang"] == "en")), _first(texts))["value"]


def _severity(given: Column, score: Column) -> Column:
    """The record's own severity, or one by its score where it names none that we know."""
    return F.when(F.lower(given).isin(*SEVERITIES), F.lower(given)).otherwise(cvss_severity(score))


def nvd_records(texts: DataFrame) -> DataFrame:
    """texts(text) of CVE files, one record, wrapped or in bulk, of version 2.0 or 5.1 -> one row for each record."""
    texts, text = spread(texts), F.col("text")
    bulk = F.from_json(text, f"struct<vulnerabilities:array<struct<cve:{CVE}>>>")["vulnerabilities"]
    single = F.from_json(text, CVE)
    wrapped = F.from_json(text, f"struct<cve:{CVE}>")["cve"]
    legacy = F.when(F.rlike(text, F.lit(r'^\s*\{\s*"CVE-')), F.map_values(F.from_json(text, f"map<string,{CVE}>")))
    shapes = F.concat(F.coalesce(F.transform(bulk, lambda v: v["cve"]), F.array().cast(f"array<{CVE}>")), F.array(wrapped, single), F.coalesce(legacy, F.array().cast(f"array<{CVE}>")))
    ids = _ids(texts)
    rows = texts.select(*ids, F.posexplode(shapes).alias("position", "c")).filter(F.rlike("c.id", F.lit(CVE_ID)))
    pick = lambda name: F.coalesce(_first(F.filter(F.col(f"c.metrics.{name}"), lambda m: m["type"] == "Primary")), _first(F.col(f"c.metrics.{name}")))["cvssData"]
    score = F.coalesce(pick("cvssMetricV31"), pick("cvssMetricV30"), pick("cvssMetricV2"))
    cpes = F.flatten(F.transform("c.configurations", lambda x: F.flatten(F.transform(x["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    two = rows.select(
        *ids,
        "position",
        F.col("c.id").alias("cve_id"),
        _english(F.col("c.descriptions")).alias("description"),
        score["baseScore"].alias("cvss_score"),
        _severity(score["baseSeverity"], score["baseScore"]).alias("severity"),
        F.array_distinct(F.filter(F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))), lambda v: F.startswith(v, F.lit("CWE-")))).alias("cwes"),
        F.array_distinct(F.array_compact(F.transform(cpes, vendor_product))).alias("products"),
        F.transform("c.references", lambda r: r["url"]).alias("references"),
        iso_timestamp(F.col("c.published")).alias("content_date"),
    )
    five = texts.select(*ids, F.lit(0).alias("position"), F.from_json(text, CVE_5).alias("r")).filter(F.rlike("r.cveMetadata.cveId", F.lit(CVE_ID)))
    cna = "r.containers.cna"
    score = _first(F.array_compact(F.transform(f"{cna}.metrics", lambda m: F.coalesce(m["cvssV3_1"], m["cvssV3_0"]))))
    newer = five.select(
        *ids,
        "position",
        F.col("r.cveMetadata.cveId").alias("cve_id"),
        _english(F.col(f"{cna}.descriptions")).alias("description"),
        score["baseScore"].alias("cvss_score"),
        _severity(score["baseSeverity"], score["baseScore"]).alias("severity"),
        F.array().cast("array<string>").alias("cwes"),
        F.array_distinct(F.transform(f"{cna}.affected", lambda a: F.concat_ws(" ", a["vendor"], a["product"]))).alias("products"),
        F.transform(f"{cna}.references", lambda r: r["url"]).alias("references"),
        iso_timestamp(F.coalesce("r.cveMetadata.datePublished", "r.cveMetadata.dateReserved")).alias("content_date"),
    )
    return two.unionByName(newer)


_STIX = "struct<type:string,objects:array<struct<type:string,name:string,description:string,kill_chain_phases:array<struct<phase_name:string>>,external_references:array<struct<source_name:string,url:string,external_id:string>>,x_mitre_platforms:array<string>,x_mitre_detection:string,x_mitre_mitigations:array<string>>>>"


def stix_sections(texts: DataFrame) -> DataFrame:
    """texts(text) of STIX bundles -> (name, technique_id, tactic, platforms, section, content) of their attack patterns."""
    bundle = F.from_json("text", _STIX)
    kept = _ids(texts)
    rows = texts.select(*kept, F.posexplode(F.when(bundle["type"] == "bundle", bundle["objects"])).alias("object", "o")).filter("o.type = 'attack-pattern'")
    ids = F.filter(F.transform("o.external_references", lambda r: F.coalesce(F.when(F.rlike(r["external_id"], F.lit(TECHNIQUE_ID)), r["external_id"]), F.nullif(F.replace(F.regexp_extract(r["url"], r"/techniques/(T\d{4}(?:/\d{3})?)", 1), F.lit("/"), F.lit(".")), F.lit("")))), lambda x: x.isNotNull())
    section = lambda name, value: F.struct(F.lit(name).alias("section"), value.alias("content"))
    parts = F.array(section("description", F.col("o.description")), section("detection", F.col("o.x_mitre_detection")), section("mitigations", F.nullif(F.array_join("o.x_mitre_mitigations", "\n"), F.lit(""))))
    rows = rows.select(*kept, "object", F.col("o.name").alias("name"), _first(ids).alias("technique_id"), _first(F.col("o.kill_chain_phases"))["phase_name"].alias("tactic"), F.col("o.x_mitre_platforms").alias("platforms"), F.posexplode(parts).alias("at", "p"))
    return rows.select(*kept, (F.col("object") * 3 + F.col("at")).alias("position"), "name", "technique_id", "tactic", "platforms", "p.*").filter(F.btrim("content") != "")


def attack_markdown(texts: DataFrame) -> DataFrame:
    """texts(text) of technique pages with front matter -> one row for the lead and for each section with text."""
    field = lambda name: F.nullif(F.btrim(F.regexp_extract("front", rf"(?m)^{name}\s*:\s*\"?([^\"\n]*)\"?\s*$", 1)), F.lit(""))
    ids = _ids(texts)
    rows = texts.select(*ids, F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1).alias("front"), F.regexp_replace("text", r"(?s)\A---\n.*?\n---[^\n]*\n?", "").alias("body")).filter("front <> ''")
    rows = rows.select(*ids, field("name").alias("name"), field("attack_id").alias("technique_id"), field("tactic").alias("tactic"), F.split(field("platforms"), r"\s*,\s*").alias("platforms"), F.posexplode(F.split(F.concat(F.lit("\n"), "body"), r"\n## ")).alias("at", "part"))
    section = F.when(F.col("at") == 0, "description").otherwise(F.lower(F.btrim(F.substring_index("part", "\n", 1))))
    content = F.when(F.col("at") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"\A[^\n]*\n?", ""))
    rows = rows.select(*ids, F.col("at").alias("position"), "name", "technique_id", "tactic", "platforms", section.alias("section"), F.regexp_replace(content, r"\A\s+|\s+\z", "").alias("content"))
    return rows.filter("technique_id is not null and content <> ''")


def attack_sections(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, rejects) of a mix of STIX and markdown files; files that are neither are rejects."""
    is_json = F.try_parse_json("text").isNotNull() & F.rlike("text", F.lit(r"^\s*\{"))
    is_page = F.rlike("text", F.lit(r"\A---\n"))
    sections = stix_sections(texts.filter(is_json)).unionByName(attack_markdown(texts.filter(~is_json & is_page)))
    return sections, texts.filter(~is_json & ~is_page).withColumn("error", F.lit("neither a bundle nor a technique page"))


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the C parser where it is built in
    for batch in batches:
        rows = []
        for document_id, text in zip(batch["document_id"], batch["text"], strict=True):
            try:
                found = [r for r in yaml.load_all(text or "", Loader=loader) if isinstance(r, dict) and (r.get("title") or r.get("id"))]
            except yaml.YAMLError:
                continue
            for i, r in enumerate(found):
                source = r.get("logsource") if isinstance(r.get("logsource"), dict) else {}
                detection = r.get("detection") if isinstance(r.get("detection"), dict) else {}
                listed = lambda v: [str(x) for x in v] if isinstance(v, list) else [str(v)] if v else []
                text_or_none = lambda v: None if v is None else str(v)
                rows.append([document_id, i] + [text_or_none(r.get(k)) for k in ("title", "id", "status", "description", "level")] + [text_or_none(source.get(k)) for k in ("product", "service", "category")] + [text_or_none(detection.get("condition")), listed(r.get("tags")), listed(r.get("falsepositives")), listed(r.get("references"))])
        yield pd.DataFrame(rows, columns=["document_id", "position", "title", "rule_id", "status", "description", "level", "product", "service", "category", "condition", "tags", "false_positives", "references"])


def sigma_rules(texts: DataFrame) -> DataFrame:
    """texts(text) of Sigma files of one or more rules -> one row for each rule with a title or id; broken files give none."""
    named = "document_id" in texts.columns
    schema = "document_id string, position int, title string, rule_id string, status string, description string, level string, product string, service string, category string, condition string, tags array<string>, false_positives array<string>, references array<string>"
    read = texts.select((F.col("document_id").cast("string") if named else F.lit(None).cast("string")).alias("document_id"), "text")
    rows = spread(read).mapInPandas(_rules, schema)
    return rows.drop(*([] if named else ["document_id"])).withColumns({
        "severity": F.coalesce(sigma_severity(F.col("level")), F.lit("unknown")),
        "technique_ids": technique_ids(F.col("tags")),
        "tactics": tactics(F.col("tags")),
        "platforms": F.array_compact(F.array(F.lower("product"))),
        "log_sources": F.array_compact(F.array("service", "category")),
        "summary": F.concat_ws("\n", "title", "description", F.concat(F.lit("Condition: "), "condition"), F.concat(F.lit("Tags: "), F.nullif(F.array_join("tags", ", "), F.lit("")))),
    })
