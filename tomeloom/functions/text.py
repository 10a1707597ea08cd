"""Scalar functions over text columns: hashes, keys, counts, snippets, slugs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes and what they stand for.
FILE_TYPES = {
    "pdf": "pdf", "docx": "docx", "doc": "docx", "pptx": "pptx", "ppt": "pptx", "xlsx": "xlsx", "xls": "xlsx", "html": "html", "htm": "html", "md": "md", "txt": "txt",
    "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "gif": "image", "bmp": "image", "webp": "image",
}
MIME_TYPES = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif"}
READABLE = ("json", "yaml", "yml", "txt", "md", "html", "htm")
MAX_FILE_BYTES = 100 * 1024 * 1024


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex; null for null."""
    return F.sha2(text, 256)


def hash_matches(text: Column, expected: Column) -> Column:
    return content_hash(text) == F.lower(expected)


def result_key(*parts: Column) -> Column:
    """Key of a query, embedding or generation request: SHA-256 over its parts, a null part counting as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def snippet(text: Column, size: int = 200) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def collapsed(text: Column, size: int = 4000) -> Column:
    """White space runs become one space; cut to size with an ellipsis."""
    one = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return snippet(one, size)


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space and a capital; blank pieces go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.btrim(s) != "")


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def file_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(FILE_TYPES), suffix(path)), F.lit("other"))


def mime_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(MIME_TYPES), suffix(path)), F.lit("application/octet-stream"))


def uri_scheme(path: Column) -> Column:
    """Lower-case scheme of a URI; file for plain paths."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("")), F.lit("file"))


def safe_filename(name: Column) -> Column:
    """Characters that file systems refuse become underscores; dots and spaces at the ends go."""
    return F.btrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), F.lit(". "))


def found_path(text: Column) -> Column:
    """First URI, absolute path or relative path with a suffix in a request; null if there is none."""
    tries = (r"([a-z][a-z0-9+.-]*://[^\s\"']+)", r"(?:^|\s)(~?/[^\s\"']+)", r"(?:^|\s)((?:\./|\.\./)?[\w-]+(?:/[\w.-]+)*\.[A-Za-z0-9]{1,5})(?:\s|$)")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in tries])


def chunking_strategy(path: Column, domain: Column | None = None) -> Column:
    """markdown for .md, else recursive; a domain's own chunker goes first."""
    by_suffix = F.when(suffix(path) == "md", F.lit("markdown")).otherwise(F.lit("recursive"))
    return by_suffix if domain is None else F.when(domain == "security", F.lit("security")).otherwise(by_suffix)


def highlighted(text: Column, terms: Column, fragments: int = 3, around: int = 8) -> Column:
    """Up to `fragments` windows of words around matches of the lower-cased terms, matches marked; the whole
    text where nothing matches."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")

    def shown(words: Column) -> Column:
        # words is bound once: a lambda's variable is not made anew for each word
        hits = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains(terms, bare(F.element_at(words, i))))
        # a match that falls into the window of an earlier one is shown there
        none = F.array().cast("array<int>")
        starts = F.aggregate(hits, none, lambda a, i: F.when((F.size(a) < fragments) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-around)) + around < i), F.concat(a, F.array(i))).otherwise(a))
        mark = lambda w: F.when(F.array_contains(terms, bare(w)), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)
        return F.array_join(F.transform(starts, lambda i: F.array_join(F.transform(F.slice(words, i, around + 1), mark), " ")), " ... ")

    found = F.element_at(F.transform(F.array(F.split(text, r"\s+")), shown), 1)
    return F.coalesce(F.nullif(found, F.lit("")), text)
