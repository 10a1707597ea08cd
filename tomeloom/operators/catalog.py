"""The catalogue: tags, categories, totals, pages of lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import spread, stored
from . import closure


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table; counts only, so scans read no columns."""
    counts = [df.select(F.lit(name).alias("name")).groupBy("name").count().withColumnRenamed("count", "n") for name, df in tables.items()]
    names = counts[0].sparkSession.createDataFrame([(n,) for n in tables], "name string")
    found = reduce(lambda a, b: a.unionByName(b), counts)
    return names.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def count_by(df: DataFrame, column: str, domain: list[str] | None = None) -> DataFrame:
    """(value, n); with a domain its zeros are kept, else groups without rows are left out."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    values = df.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return values.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def tally(results: DataFrame) -> DataFrame:
    """One row of a batch's results(status): total, succeeded, skipped, failed."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), is_("success").alias("succeeded"), is_("skipped").alias("skipped"), is_("failed").alias("failed"))


def category_paths(categories: DataFrame) -> DataFrame:
    """categories(category_id, name, parent_id) -> (category_id, path, depth) of what hangs below a root. Members of cycles, what
    hangs below them and children of unknown parents have no path.

    A tree of depth d takes log2(d) + 1 joins; see operators.closure.
    """
    rooted = closure.depths(categories)
    named = categories.join(rooted.select("category_id", "depth"), "category_id")
    return closure.paths(named).select("category_id", "path", "depth")


def subtree(categories: DataFrame, root) -> DataFrame:
    """Ids of a category and all below it, found by ids: names may repeat or hold slashes."""
    return closure.below(categories, root)


def delete_category(categories: DataFrame, tags: DataFrame, root, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Categories and tags without a subtree; refused if documents are tagged with its root, unless forced. Tags of
    categories below the root do not refuse: they go with it."""
    if not force and not tags.filter(F.col("category_id") == root).isEmpty():
        raise ValueError("category has tagged documents")
    gone = subtree(categories, root)
    return categories.join(gone, "category_id", "left_anti"), tags.join(gone, "category_id", "left_anti")


def delete_documents(gone: DataFrame, tables: dict[str, DataFrame], key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def merge_tags(*tags: DataFrame) -> DataFrame:
    """(document_id, category_id, confidence, tagged_by): the surest tag of each pair; earlier tables win ties."""
    rows = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_turn", F.lit(-i)) for i, t in enumerate(tags)])
    best = rows.groupBy("document_id", "category_id").agg(F.max(F.struct("confidence", "_turn", "tagged_by")).alias("b"))
    return best.select("document_id", "category_id", "b.confidence", "b.tagged_by")


def matched_categories(suggestions: DataFrame, paths: DataFrame) -> DataFrame:
    """suggestions(document_id, path, confidence) -> with category_id: by full path, else by the last segment's name,
    of which the first path counts; unmatched ones go."""
    low = lambda c: F.lower(F.btrim(c))
    full = paths.select(low(F.col("path")).alias("_full"), F.col("category_id").alias("_by_path"))
    names = paths.groupBy(low(F.substring_index("path", "/", -1)).alias("_name")).agg(F.min_by("category_id", "path").alias("_by_name"))
    rows = suggestions.withColumns({"_f": low(F.col("path")), "_n": low(F.substring_index("path", "/", -1))})
    rows = rows.join(full, F.col("_f") == F.col("_full"), "left").join(names, F.col("_n") == F.col("_name"), "left")
    return rows.withColumn("category_id", F.coalesce("_by_path", "_by_name")).filter("category_id is not null").select("document_id", "category_id", "confidence")


def category_seeds(texts: DataFrame) -> DataFrame:
    """texts(text) of YAML category trees -> (slug, name, description, color, parent_slug); a missing slug is made from
    the name, broken files and nodes without a name give none."""
    from ..functions.text import slugify

    rows = spread(texts.select("text")).mapInPandas(_seeds, "name string, slug string, description string, color string, up string, up_name string")
    own = lambda slug, name: F.coalesce(F.nullif(slug, F.lit("")), slugify(name))
    return rows.select(own(F.col("slug"), F.col("name")).alias("slug"), "name", "description", "color", own(F.col("up"), F.col("up_name")).alias("parent_slug"))


def _seeds(batches):
    import pandas as pd
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the C parser where it is built in
    for batch in batches:
        rows = []
        for text in batch["text"]:
            try:
                tree = yaml.load(text or "", Loader=loader)
            except yaml.YAMLError:
                continue
            tree = tree.get("categories", []) if isinstance(tree, dict) else tree
            todo = [(node, None, None) for node in tree] if isinstance(tree, list) else []
            while todo:
                node, up, up_name = todo.pop()
                if isinstance(node, dict) and node.get("name"):
                    name, slug = str(node["name"]), None if node.get("slug") is None else str(node["slug"])
                    rows.append((name, slug, node.get("description"), node.get("color"), up, up_name))
                    todo += [(child, slug, name) for child in node.get("children") or []]
        yield pd.DataFrame(rows, columns=["name", "slug", "description", "color", "up", "up_name"])


# How a catalogue line is laid out.
TITLE_CHARS = 32


def catalogue_lines(documents: DataFrame, style: str) -> DataFrame:
    """documents(document_id, title, file_type, status, created_at) -> (document_id, line) as json, markdown or text."""
    title = F.substring(F.coalesce("title", F.lit("")), 1, TITLE_CHARS)
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(""))
    if style == "json":
        line = F.to_json(F.struct("document_id", "title", "file_type", "status", day.alias("created_at")))
    elif style == "markdown":
        line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("document_id").cast("string"), title, "file_type", "status", day), F.lit(" |"))
    elif style == "text":
        line = F.concat_ws("  ", F.col("document_id").cast("string"), F.rpad(title, TITLE_CHARS, " "), "file_type", "status", day)
    else:
        raise ValueError(f"unknown style {style}")
    return documents.select("document_id", line.alias("line"))


def wiki_index(pages: DataFrame) -> DataFrame:
    """pages(slug, title, kind) -> the lines of an index, by title, then slug."""
    return pages.select("title", "slug", F.concat(F.lit("- [["), "slug", F.lit("]] "), "title", F.lit(" ("), "kind", F.lit(")")).alias("line")).orderBy("title", "slug")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def latencies(log: DataFrame, by: str, duration: str) -> DataFrame:
    """Count, mean and exact nearest-rank p50, p95, p99 of durations by metric. Durations that are null count in n only.

    Equal durations are one row each, ranked where ranges of them lie, so a metric of any number of durations spreads.
    """
    counts = log.filter(F.col(duration).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(duration).alias("_value")).agg(F.count("*").alias("c"))
    ranged = stored(counts.repartitionByRange("_by", "_value").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_by", "_part").agg(F.sum("c").alias("c"))
    metric = W.partitionBy("_by")
    parts = parts.select(F.col("_by").alias("_b"), F.col("_part").alias("_p"), (F.sum("c").over(metric.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(metric).alias("total"))
    upto = F.col("before") + F.sum("c").over(W.partitionBy("_by", "_part").orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    ranks = ranged.join(parts, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p"))).withColumn("upto", upto)
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("_value")))
    found = ranks.groupBy("_by").agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))
    means = log.groupBy(by).agg(F.count("*").alias("n"), F.avg(duration).alias("mean"))
    return means.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "p50", "p95", "p99")
