"""Security metadata: severities, ids, source types, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intents import is_indicator

# Weights of severities, and of source types by question.
SEVERITY_WEIGHTS = {"critical": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5, "info": 0.2, "unknown": 0.0}
SOURCE_WEIGHTS = {
    "cve_lookup": {"nvd_cve": 2.0, "sigma_rule": 1.0, "mitre_attack": 0.5, "prose": 0.2},
    "technique_lookup": {"mitre_attack": 2.0, "sigma_rule": 1.0, "nvd_cve": 0.5, "prose": 0.2},
    "ioc_lookup": {"sigma_rule": 1.5, "prose": 0.5, "nvd_cve": 0.5, "mitre_attack": 0.3},
    "general_security": {"nvd_cve": 1.0, "sigma_rule": 1.0, "mitre_attack": 1.0, "prose": 1.0},
}
HALF_LIFE_DAYS = 365.0
SIGMA_LEVELS = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "info", "informational_only": "info"}
# Path fragments that name a source type, in the order in which they are tried.
PATH_HINTS = (("sigma_rule", ("/sigma-rules/", "/sigma/")), ("nvd_cve", ("/nvd-cve/", "/nvd/", "/cve/")), ("mitre_attack", ("/mitre-attack/", "/attack/", "/mitre/")), ("ioc_list", ("/iocs/", "/ioc-lists/")))
# The forms of ids, and the limits of an indicator list.
CVE_ID = r"^CVE-\d{4}-\d+$"
TECHNIQUE_ID = r"^T\d{4}(?:\.\d{3})?$"
IOC_RATIO, IOC_LINES, IOC_CHARS, PROSE_LINE = 0.80, 2, 65_536, 60


def cvss_severity(score: Column) -> Column:
    """0 is info, up to 3.9 low, 6.9 medium, 8.9 high, 10 critical; null or out of range unknown."""
    bad = score.isNull() | F.isnan(score.cast("double")) | (score < 0) | (score > 10)
    return F.when(bad, "unknown").when(score == 0, "info").when(score <= 3.9, "low").when(score <= 6.9, "medium").when(score <= 8.9, "high").otherwise("critical")


def sigma_severity(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SIGMA_LEVELS.items() for x in p]), F.lower(F.btrim(level))), F.lit("unknown"))


def severity_weight(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY_WEIGHTS.items() for x in p]), severity), F.lit(0.0))


def recency(date: Column, now: Column, half_life: float | None = HALF_LIFE_DAYS) -> Column:
    """0.5 ^ (age in days / half life); 1 for null or future dates, or with no half life."""
    if not half_life:
        return F.lit(1.0)
    date, now = date.cast("timestamp"), now.cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(date)) / F.lit(86_400e6)
    return F.when(date.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / half_life))


def source_weights(spark) -> DataFrame:
    rows = [(intent, source, weight) for intent, row in SOURCE_WEIGHTS.items() for source, weight in row.items()]
    return spark.createDataFrame(rows, "intent string, source_type string, source_weight double")


def vendor_product(cpe: Column) -> Column:
    """`vendor product` of a CPE 2.3 URI; wildcards and dashes are left out, underscores are spaces."""
    part = lambda i: F.nullif(F.nullif(F.try_element_at(F.split(cpe, "(?<!\\\\):"), F.lit(i)), F.lit("*")), F.lit("-"))
    return F.nullif(F.replace(F.concat_ws(" ", part(4), part(5)), F.lit("_"), F.lit(" ")), F.lit(""))


def iso_timestamp(text: Column) -> Column:
    """ISO date or time as a UTC timestamp, null on failure."""
    return F.try_to_timestamp(text)


def technique_ids(tags: Column) -> Column:
    """Technique ids of Sigma tags like attack.t1059.001, upper-cased."""
    found = F.filter(tags, lambda t: F.rlike(F.lower(t), F.lit(r"^attack\.t\d{4}(\.\d{3})?$")))
    return F.transform(found, lambda t: F.upper(F.substring(t, F.lit(8), F.char_length(t))))


def tactics(tags: Column) -> Column:
    """Tactics of Sigma tags like attack.defense_evasion, underscores as spaces."""
    found = F.filter(tags, lambda t: F.startswith(F.lower(t), F.lit("attack.")) & ~F.rlike(F.lower(t), F.lit(r"^attack\.[tgs]\d{4}")))
    return F.transform(found, lambda t: F.regexp_replace(F.substring(F.lower(t), F.lit(8), F.char_length(t)), "[_-]", " "))


def ioc_ratio(text: Column) -> Column:
    """Share of the lines with text that are one indicator each; 0 for texts with too few lines or too long ones."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.btrim(x)), lambda x: x != "")
    share = F.size(F.filter(lines, is_indicator)) / F.size(lines)
    return F.when((F.char_length(text) > IOC_CHARS) | (F.size(lines) < IOC_LINES), F.lit(0.0)).otherwise(share)


def source_type(text: Column, path: Column | None = None, override: Column | None = None) -> Column:
    """What kind of source a text is. Tried in order: an override, emptiness, the path, Sigma's keys, JSON's shape,
    front matter, the file's name, the share of indicator lines, a long line of prose."""
    text = F.coalesce(text, F.lit(""))
    path = F.lower(F.coalesce(path, F.lit(""))) if path is not None else F.lit("")
    name = F.substring_index(path, "/", -1)
    out = F.when(override.isNotNull(), override) if override is not None else F.when(F.lit(False), F.lit(""))
    out = out.when(F.btrim(text) == "", "unknown")
    for kind, hints in PATH_HINTS:
        hit = reduce(lambda a, b: a | b, [F.contains(path, F.lit(h)) for h in hints])
        out = out.when(hit & ~F.contains(path, F.lit("/mitre-defend/")) if kind == "mitre_attack" else hit, kind)
    has = lambda key: F.rlike(text, F.lit(rf"(?m)^\s*{key}\s*:"))
    out = out.when(has("detection") & (has("logsource") | F.rlike(name, F.lit(r"\.ya?ml$"))), "sigma_rule")
    is_object = F.rlike(text, F.lit(r"^\s*\{")) & F.try_parse_json(text).isNotNull()
    cve = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.cve.id", "string"), F.try_variant_get(F.try_parse_json(text), "$.vulnerabilities[0].cve.id", "string"), F.try_variant_get(F.try_parse_json(text), "$.cveMetadata.cveId", "string"))
    key = F.rlike(text, F.lit(r'^\s*\{\s*"CVE-\d{4}-\d+"\s*:'))
    out = out.when(is_object & (F.coalesce(F.rlike(cve, F.lit(CVE_ID)), F.lit(False)) | key), "nvd_cve")
    bundle = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.type", "string") == "bundle", F.lit(False))
    out = out.when(is_object & bundle & F.rlike(text, F.lit(r'"type"\s*:\s*"attack-pattern"')), "mitre_attack")
    out = out.when(F.rlike(text, F.lit(r"^---\n(?s:.*?)(?m:^)(?:attack_id|kind)\s*:\s*(?s:.*?)\n---")), "mitre_attack")
    out = out.when(F.rlike(name, F.lit(r"^t\d{4}(?:\.\d{3})?(?:\..+)?$")), "mitre_attack")
    out = out.when(ioc_ratio(text) >= IOC_RATIO, "ioc_list")
    long_line = F.exists(F.split(text, r"\r\n|\r|\n"), lambda x: F.char_length(F.btrim(x)) > PROSE_LINE)
    return out.when(long_line, "prose").otherwise("unknown")


def metadata_problems(cve_id: Column, technique_id: Column, cvss: Column) -> Column:
    """Names of the fields that break their rules."""
    bad = lambda name, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(bad("cve_id", ~F.rlike(cve_id, F.lit(CVE_ID))), bad("technique_id", ~F.rlike(technique_id, F.lit(TECHNIQUE_ID))), bad("cvss_score", (cvss < 0) | (cvss > 10))))


def flattened(values: Column, cap: int = 32) -> Column:
    """A list as one string for scalar-only stores: the first `cap` values, joined by bars; null is empty."""
    return F.coalesce(F.array_join(F.slice(values, 1, cap), "|"), F.lit(""))


# The fields of a document's security metadata, those that are columns of their own, and those of a scalar-only store.
METADATA_FIELDS = {
    "source_type": "string", "source_url": "string", "tlp_level": "string", "cve_id": "string", "cvss_score": "double", "severity": "string", "cwe_ids": "array<string>", "affected_products": "array<string>", "published_date": "timestamp",
    "mitre_technique_id": "string", "mitre_tactic": "string", "mitre_subtechnique": "string", "threat_actors": "array<string>", "malware_families": "array<string>", "ioc_types": "array<string>", "detection_categories": "array<string>",
    "platforms": "array<string>", "log_sources": "array<string>", "content_date": "timestamp",
}
METADATA_COLUMNS = ("source_type", "cve_id", "severity", "mitre_technique_id", "content_date", "tlp_level")
SCALAR_FIELDS = ("source_type", "severity", "tlp_level", "cve_id", "cvss_score", "mitre_technique_id", "mitre_tactic", "content_date", "source_url", "cwe_ids", "threat_actors", "platforms")
DOMAINS = {"source_type": (("sigma_rule", "nvd_cve", "mitre_attack", "ioc_list", "prose", "unknown"), "unknown"), "severity": (tuple(SEVERITY_WEIGHTS), "unknown"), "tlp_level": (("white", "green", "amber", "red"), "white")}
METADATA = "struct<" + ",".join(f"{k}:{v}" for k, v in METADATA_FIELDS.items()) + ">"


def _in_domain(name: str, value: Column) -> Column:
    values, otherwise = DOMAINS[name]
    return F.when(value.isin(*values), value).otherwise(F.lit(otherwise))


def split_metadata(metadata: Column) -> list[Column]:
    """The columns that filters use, and all set fields as one JSON text, `security_metadata`."""
    return [metadata[c].alias(c) for c in METADATA_COLUMNS] + [F.to_json(metadata).alias("security_metadata")]


def joined_metadata(blob: Column, columns: dict[str, Column]) -> Column:
    """The metadata of a row: its JSON text, in which its own columns go first where they are set.

    Unknown fields are left out; values out of their domain become unknown, or white.
    """
    read = F.from_json(blob, METADATA)
    picked = {name: F.coalesce(columns[name].cast(kind), read[name]) if name in columns else read[name] for name, kind in METADATA_FIELDS.items()}
    return F.struct(*[(_in_domain(name, value) if name in DOMAINS else value).alias(name) for name, value in picked.items()])


def scalar_metadata(metadata: Column) -> Column:
    """Metadata as scalars for a store without lists and nulls: lists flattened, times as ISO text, empty text or 0 for null."""
    parts = []
    for name in SCALAR_FIELDS:
        value, kind = metadata[name], METADATA_FIELDS[name]
        if kind == "array<string>":
            value = flattened(value)
        elif kind == "timestamp":
            value = F.coalesce(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
        elif kind == "double":
            value = F.coalesce(value, F.lit(0.0))
        else:
            value = F.coalesce(value, F.lit(DOMAINS[name][1] if name in DOMAINS else ""))
        parts.append(value.alias(name))
    return F.struct(*parts)


def listed(text: Column, mark: str = ",") -> Column:
    """A joined list back as an array; empty parts go."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), mark), lambda x: x != "")


# What a model is asked about prose, and how much of it.
EXTRACT_CHARS = 4000
EXTRACT_FIELDS = "struct<severity:string,mitre_technique_id:string,threat_actors:array<string>,malware_families:array<string>,platforms:array<string>,ioc_types:array<string>,content_date:string>"


def extracted_metadata(part: Column) -> Column:
    """Metadata from the JSON part of a model's reply about prose; fields that break their rules are unset, and no JSON leaves all unset."""
    read = F.from_json(part, EXTRACT_FIELDS)
    severity, technique = F.lower(F.btrim(read["severity"])), F.btrim(read["mitre_technique_id"])
    date = F.regexp_extract(F.btrim(read["content_date"]), r"^(\d{4}-\d{2}-\d{2})", 1)
    lower = lambda xs: F.transform(xs, lambda x: F.lower(x))
    found = {
        "source_type": F.lit("prose"), "tlp_level": F.lit("white"), "severity": _in_domain("severity", severity), "mitre_technique_id": F.when(F.rlike(technique, F.lit(TECHNIQUE_ID)), technique), "threat_actors": read["threat_actors"],
        "malware_families": read["malware_families"], "platforms": lower(read["platforms"]), "ioc_types": lower(read["ioc_types"]), "content_date": F.try_to_timestamp(date),
    }
    return F.struct(*[found.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in METADATA_FIELDS.items()])
