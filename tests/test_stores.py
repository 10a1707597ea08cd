"""Closures, pages, indexes, durable tables and queues."""

import datetime as dt
import html as html_module
import random
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeloom import work
from tomeloom.operators import catalog, closure, curation, fulltext, jobs, tables, text_index, vector_index, vectors
from tomeloom.sources import pages
from tomeloom.work import new_folder, read_text, write_new

CATEGORIES = "category_id string, name string, parent_id string"


def ids(df, column="category_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_delete_category_goes_by_ids_not_by_names(spark):
    rows = [("a", "X", None), ("a1", "Y", "a"), ("b", "X", None), ("b1", "Y", "b"), ("c", "X/Y", None), ("c1", "Z", "c")]
    left, tags = catalog.delete_category(spark.createDataFrame(rows, CATEGORIES), spark.createDataFrame([("d", "a1"), ("e", "b1")], "document_id string, category_id string"), "a")
    assert ids(left) == ["b", "b1", "c", "c1"] and [r.document_id for r in tags.collect()] == ["e"]
    with pytest.raises(ValueError):
        catalog.delete_category(spark.createDataFrame(rows, CATEGORIES), spark.createDataFrame([("d", "a")], "document_id string, category_id string"), "a")


def test_closure_of_cycles_unknown_parents_and_nulls(spark):
    rows = [("r", "r", None), ("x", None, "r"), ("y", "y", "x"), ("o", "o", "gone"), ("p", "p", "o"), ("1", "1", "3"), ("2", "2", "1"), ("3", "3", "2"), ("t", "t", "1"), (None, "n", "r")]
    df = spark.createDataFrame(rows, CATEGORIES)
    assert sorted((r.category_id, r.root_id, r.depth) for r in closure.depths(df).collect()) == [("r", "r", 0), ("x", "r", 1), ("y", "r", 2)]
    assert sorted((r.category_id, r.path, r.depth) for r in catalog.category_paths(df).collect()) == [("r", "r", 0), ("x", "r", 1), ("y", "r/y", 2)]
    assert ids(closure.below(df, "1")) == ["1", "2", "3", "t"] and ids(closure.below(df, "nobody")) == []
    assert closure.depths(df.filter("false")).count() == 0


def test_closure_leaves_ended_nodes_where_they_are(spark, monkeypatch):
    """Their null keys met in one task of each join; a large table is joined in as many tasks as it has rows for."""
    written, real = [], closure.stored
    monkeypatch.setattr(closure, "stored", lambda df: written.append(real(df)) or written[-1])
    monkeypatch.setattr(work, "ROWS_PER_TASK", 50)
    trees = [(i, None if i < 900 else i - 900) for i in range(1800)] + [(2000 + i, 1999 + i if i else None) for i in range(17)]
    got = sorted(tuple(r) for r in closure.depths(spark.createDataFrame(trees, "category_id long, parent_id long")).collect())
    assert got == [(i, i % 900, i // 900) for i in range(1800)] + [(2000 + i, 2000, i) for i in range(17)]
    counts = [df.count() for df in written]
    assert counts[:2] == [1817, 916] and max(counts[2:]) < 17
    assert work.dealt(spark.range(1000), 1000, "id").rdd.getNumPartitions() == 20 and work.dealt(spark.range(9, numPartitions=3), 9, "id").rdd.getNumPartitions() == 3


def test_closure_of_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = closure.stored
    monkeypatch.setattr(closure, "stored", lambda df: rounds.append(1) or real(df))
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id")).withColumnRenamed("id", "category_id")
    found = closure.depths(chain)
    assert found.filter("depth <> category_id or root_id <> 0").count() == 0 and found.count() == 10_000 and len(rounds) < 20


def test_applied_updates_leave_superseded_sections(spark):
    sections = spark.createDataFrame([("p", "h", "old", 0, "s", 1, True, None), ("p", "h", "live", 1, "s", 1, False, None)], "slug string, heading string, content string, position long, source string, priority int, superseded boolean, flag string")
    for outcome, want in (("replace", [("old", True, None), ("new", False, None)]), ("supersede", [("old", True, None), ("live", True, None), ("new", False, None)]), ("flag", [("old", True, None), ("live", False, "conflict")])):
        decided = spark.createDataFrame([("p", "h", "new", outcome, "d", 2, 0)], "slug string, heading string, content string, outcome string, source string, priority int, ordinal int")
        got = curation.applied_updates(decided, sections).orderBy("position").collect()
        assert [(r.content, r.superseded, r.flag) for r in got] == want


def plain_text(source):
    """The text of a page of the tables by replacements: no nesting, hidden parts out, blocks by lines."""
    x = re.sub(r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", "", re.sub(r"\s+", " ", source))
    x = re.sub(r"(?i)<h1[^>]*>", "\n# ", re.sub(r"(?i)<li[^>]*>", "\n- ", x))
    x = re.sub(r"(?i)</?(?:!doctype|article|body|br|div|footer|h1|html|li|nav|p|ul)\b[^>]*>", "\n", x)
    lines = [re.sub(r"\s+", " ", html_module.unescape(line)).strip() for line in re.sub(r"<[^>]*>", "", x).split("\n")]
    return "\n".join(line for line in lines if line not in ("", "#", "-"))


def test_page_texts_equal_plain_replacement(spark, sf):
    rows = pages.parsed_pages(spark.read.parquet(f"{sf}/pages.parquet")).select("html", "text", "status", "word_count").collect()
    assert len(rows) > 20 and all(r.text == plain_text(r.html) and r.word_count == len(r.text.split()) for r in rows)


@pytest.mark.parametrize(
    "source, text, title, author, status",
    [
        ("<title> A &amp;\n B </title><meta name='author' content='Ann O&#39;X'><h2>H</h2><p>one<p>two", "## H\none\ntwo", "A & B", "Ann O'X", "success"),
        ("<ul><li>a<li><p>b</p></ul><table><tr><td>1<td>2<tr><th>3</th></table>", "- a\n- b\n1 | 2\n3", "stem", None, "success"),
        ("<div>x <b>y</div>z", "x y\nz", "stem", None, "partial"),
        ("a</i> b < c <!-- never closed", "a b < c", "stem", None, "partial"),
        ("<p>x<a href=\"1>y</a>", "xy", "stem", None, "partial"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style>", "", "stem", None, "failed"),
        ("", "", "stem", None, "failed"),
        (None, "", "stem", None, "failed"),
        ("<p>" + "w " * 40, "w " * 39 + "w", "stem", None, "success"),
    ],
)
def test_pages(spark, source, text, title, author, status):
    r = pages.parsed_pages(spark.createDataFrame([(source, "http://h/d/stem.html?x=1/2", "clash")], "html string, url string, text string")).first()
    assert (r.text, r.title, r.author, r.status) == (text, title, author, status)
    assert r.word_count == len(text.split()) and r.file_size == len(source or "") and (r.error_message is None) == (status == "success")


def test_pages_are_read_in_one_pass():
    hard = ["<p>x" * 250_000, '<p>x"' * 200_000, "<td>" * 200_000 + "</table>", "<!--" * 200_000, "<script></" * 100_000, "<a b=' c=\"'>" * 80_000, "<i>" * 300_000 + "</b>" * 100_000, "<a href=\"x\" " * 80_000]
    for source in hard:
        began = time.time()
        pages.read_page(source)
        assert time.time() - began < 15


def test_vector_index_finds_and_counts(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    v, q = e.select(F.col("vec_id").alias("id"), "embedding", "label"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.VectorIndex.build(v.filter("id % 5 <> 0"), new_folder(spark))
    index.append(v.filter("id % 5 = 0"))
    key = lambda df: {(r.query_id, r.id) for r in df.collect()}
    true = key(vectors.top_k(q, v, 10))
    assert key(index.search(q, 10, exact_too=True)) == true
    found = index.search(q, 10).cache()
    assert len(key(found) & true) >= 0.9 * len(true) and found.agg(F.max("n_compared")).first()[0] <= 200
    assert key(index.search(q, 10, exact_too=True, where="label < 3")) == key(vectors.top_k(q, v.filter("label < 3"), 10))
    with pytest.raises(ValueError):
        vector_index.VectorIndex.build(v, index.path)


def test_vector_index_of_alike_few_and_no_vectors(spark):
    schema = "id long, embedding array<double>"
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    same = vector_index.VectorIndex.build(spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], schema), new_folder(spark))
    assert [r.id for r in same.search(q, 3).orderBy("rank").collect()] == [0, 1, 2]
    few = vector_index.VectorIndex.build(spark.createDataFrame([(7, [0.0, 0.0]), (8, [0.0, 1.0])], schema), new_folder(spark))
    assert [(r.id, r.distance) for r in few.search(q, 5).orderBy("rank").collect()] == [(7, 1.0), (8, 1.0)]
    assert vector_index.VectorIndex.build(spark.createDataFrame([], schema), new_folder(spark)).search(q, 5).count() == 0


def test_large_lists_are_cut(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * 0.01 + 1).tolist()) for i in range(900)] + [(900 + i, (rng.normal(size=8) * 5).tolist()) for i in range(100)]
    index = vector_index.VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>"), new_folder(spark), "l2", lists=20)
    assert max(r["count"] for r in index.rows().groupBy("cell").count().collect()) < 400


def test_write_new_is_taken_once(spark):
    path = f"{new_folder(spark)}/v.json"
    assert write_new(spark, path, "one é") and not write_new(spark, path, "two") and read_text(spark, path) == "one é"


def table(spark, rows, key="id"):
    df = spark.createDataFrame(rows, "id long, name string, at long")
    made = tables.Table.create(spark, new_folder(spark), df.schema, key, 4)
    made.upsert(df)
    return made


def contents(rows):
    return sorted(((r.id, r.name, r.version) for r in rows.collect()), key=str)


def test_table_upserts_deletes_and_reads_as_of(spark):
    t = table(spark, [(1, "a", 0), (2, "b", 0), (None, "n", 0)])
    t.upsert(spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1), (None, "m", 1)], "id long, name string, at long"), "at")
    assert contents(t.read()) == sorted([(1, "a", 1), (2, "new", 2), (3, "c", 1), (None, "m", 2)], key=str)
    assert t.delete(spark.createDataFrame([(1,), (99,), (None,)], "id long")) == 4
    assert contents(t.read()) == [(2, "new", 2), (3, "c", 1)] and contents(t.read(2)) == sorted([(1, "a", 1), (2, "b", 1), (None, "n", 1)], key=str)
    assert t.delete(spark.createDataFrame([], "id long")) == 4 and [d for _, d in t.history()] == ["create", "upsert", "upsert", "delete"]
    assert contents(t.by_keys(spark.createDataFrame([(3,)], "id long"))) == [(3, "c", 1)]
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(5, "x", 1), (5, "y", 1)], "id long, name string, at long"), "at")
    assert contents(tables.Table(spark, t.path).read()) == [(2, "new", 2), (3, "c", 1)]


def test_an_upsert_leaves_other_buckets_alone(spark):
    t = table(spark, [(i, "a", 0) for i in range(40)])
    before = t.versions.read()["folders"]
    t.upsert(spark.createDataFrame([(7, "b", 0)], "id long, name string, at long"))
    after = t.versions.read()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_two_writers_lose_nothing(spark):
    """A second writer commits while the first has written its files but not its version: on the same key, then on all."""
    t, other = table(spark, [(i, "a", 0) for i in range(20)]), None
    other = tables.Table(spark, t.path)
    real, turns = t.versions.commit, []

    def late(version, state):
        if len(turns) < 2:
            turns.append(1)
            other.upsert(spark.createDataFrame([(i, f"other{len(turns)}", 0) for i in ((1,) if len(turns) == 1 else range(20))], "id long, name string, at long"))
        return real(version, state)

    t.versions.commit = late
    t.upsert(spark.createDataFrame([(1, "mine", 0), (100, "mine", 0)], "id long, name string, at long"))
    got = {r.id: (r.name, r.version) for r in t.read().collect()}
    assert got[1] == ("mine", 4) and got[100] == ("mine", 1) and got[2] == ("other2", 2) and len(got) == 21


def test_jobs_are_claimed_once(spark):
    queue = jobs.create(spark, new_folder(spark), 2)
    jobs.enqueue(queue, spark.range(30).select(F.col("id").alias("document_id")))
    now = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    got = {}

    def work(name):
        got[name] = {r.document_id for r in jobs.claim(jobs.Table(spark, queue.path), name, now, 8).collect()}

    threads = [threading.Thread(target=work, args=(f"w{i}",)) for i in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sum(map(len, got.values())) == len(set().union(*got.values())) == 24
    later = now + 2 * jobs.LEASE
    again = {r.document_id for r in jobs.claim(queue, "w9", later, 100, only=spark.range(10).select(F.col("id").alias("document_id"))).collect()}
    assert again == set(range(10))
    jobs.finish(queue, "w0", spark.createDataFrame([(i, None) for i in got["w0"]], "document_id long, error string"), later)
    jobs.finish(queue, "w9", spark.createDataFrame([(0, None), (1, "broken"), (29, None)], "document_id long, error string"), later)
    by = {r.document_id: r for r in queue.read().collect()}
    assert by[0].status == "completed" and (by[1].status, by[1].error) == ("failed", "broken") and by[2].status == "compiling" and by[29].status == "pending"
    jobs.enqueue(queue, spark.createDataFrame([(0,), (1,), (2,), (50,)], "document_id long"), again=True)
    by = {r.document_id: r.status for r in queue.read().collect()}
    assert [by[i] for i in (0, 1, 2, 50)] == ["pending", "pending", "compiling", "pending"]


def hits(df):
    return sorted((r.query_id, r.chunk_id, round(r.rank_score, 9), r.rank) for r in df.collect())


def test_text_index_equals_search(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 4)
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (1 + j) for j in range(12)], k=rng.randint(0, 40))), rng.choice([None, "w1 w2", "w5", ""])) for i in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, title string")
    asked = spark.createDataFrame([(1, "w1"), (2, 'w3 OR "w1 w2"'), (3, "w4 w5"), (4, '"w2 w1 w1" or w11 or w9'), (5, "none"), (6, ""), (7, "w10 w11 OR w8"), (8, '"w1 w1"')], "query_id long, query string")
    index = text_index.TextIndex.create(spark, new_folder(spark))
    assert hits(index.search(asked, 5)) == []
    index.add(chunks.filter("chunk_id < 100"))
    index.add(chunks.filter("chunk_id >= 100"))
    for k in (1, 5, None):
        want = hits(fulltext.search(asked, chunks, k))
        assert hits(index.search(asked, k)) == want == hits(index.search(asked, k, skip=False))
    heads = index._read(index.versions.read()["parts"])[0].select("seq", "term", "block", "n", "most", "least")
    assert index._needed(fulltext.asked_phrases(asked.filter("query_id = 1")), heads, 5).count() < heads.filter("term = 'w1'").count()
    index.delete(chunks.filter("chunk_id % 3 = 0"))
    left = chunks.filter("chunk_id % 3 <> 0")
    assert hits(index.search(asked, 5)) == hits(fulltext.search(asked, left, 5))
    back = chunks.filter("chunk_id % 9 = 0").withColumn("content", F.lit("w1 w2 w3"))
    index.add(back)
    index.compact()
    want = hits(fulltext.search(asked, left.unionByName(back), 5))
    assert hits(index.search(asked, 5)) == want and len(index.versions.read()["parts"]) == 1


def test_english_index_equals_english_search(spark):
    chunks = spark.createDataFrame([(1, "The walking of dogs"), (2, "dogs walk"), (3, None)], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "walked dog"), (2, '"walks of dogs"')], "query_id long, query string")
    index = text_index.TextIndex.create(spark, new_folder(spark), english=True)
    index.add(chunks)
    assert hits(index.search(asked, 5)) == hits(fulltext.search(asked, chunks, 5, english=True)) != []


def test_postings_are_found_in_lots(monkeypatch):
    """A batch of chunks is cut by its words, so that a task's memory does not grow with it; places are those of each chunk."""
    import pyarrow as pa

    from tomeloom.operators import text_index

    monkeypatch.setattr(text_index, "LOT", 40)
    titles = [["t"] * (i % 3) for i in range(50)]
    contents = [[f"w{(i * j) % 5}" for j in range(i % 11)] for i in range(50)] + [["long"] * 100]
    titles.append([])
    of = lambda lists: pa.array(lists, pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(51)), of(titles), of(contents)], ["chunk_id", "title", "content"])
    made = [b.to_pylist() for b in text_index._places(iter([batch, batch.slice(0, 0)]))]
    for rows in made:
        assert sum(len(r["at_title"]) + len(r["at_content"]) for r in rows) <= 40 + 12 or {r["chunk_id"] for r in rows} == {50} or len(rows) == 0
    want = {}
    for c, fields in enumerate(zip(titles, contents)):
        for f, ws in enumerate(fields):
            for at, w in enumerate(ws):
                want.setdefault((c, w), ([], []))[f].append(at)
    got = [((r["chunk_id"], r["term"]), (r["at_title"], r["at_content"])) for rows in made for r in rows]
    assert len(got) == len(want) and dict(got) == want and len(made) > 5


def test_index_of_a_frequent_word_is_in_small_blocks_and_row_groups(spark, monkeypatch):
    """What a task holds of a word does not grow with its places: neither a block nor a row group, before and after compact()."""
    import pyarrow.parquet as pq

    for name, value in (("BLOCK", 50), ("PLACES", 512), ("HELD", 500), ("GROUP", 1 << 13), ("LOOK", 10)):
        monkeypatch.setattr(text_index, name, value, raising=False)
    row = F.concat_ws(" ", F.array_repeat(F.lit("often"), 60), F.concat(F.lit("w"), F.col("id") % 7), F.lit("seldom often"))
    chunks = spark.range(0, 4000, 1, 2).select(F.col("id").alias("chunk_id"), row.alias("content"), F.when(F.col("id") % 5 == 0, "often w1").alias("title"))
    asked = spark.createDataFrame([(1, "often"), (2, '"seldom often"'), (3, 'w3 OR "often w1"')], "query_id long, query string")
    index = text_index.TextIndex.create(spark, new_folder(spark))
    index.add(chunks.filter("chunk_id % 2 = 0"))
    index.delete(chunks.filter("chunk_id % 4 = 0"))
    index.add(chunks.filter("chunk_id % 2 = 1"))
    for _ in range(2):
        parts = index.versions.read()["parts"]
        blocks = index._read(parts)[0]
        files = [f.removeprefix("file:").replace("///", "/") for f in blocks.inputFiles()]
        groups = [meta.row_group(i) for f in files for meta in [pq.read_metadata(f)] for i in range(meta.num_row_groups)]
        assert max(g.column(j).num_values for g in groups for j in range(g.num_columns)) < 30_000
        assert blocks.select(F.max(F.size("places"))).first()[0] < 512 + 62 and blocks.select(F.max("n")).first()[0] <= 50
        assert blocks.count() == blocks.select("seq", "term", "block").distinct().count()
        assert hits(index.search(asked, 5)) == hits(fulltext.search(asked, chunks.filter("chunk_id % 4 <> 0"), 5))
        index.compact()
    assert len(parts) == 1


def test_all_lists_are_scanned_without_a_row_for_each_list(spark, sf, monkeypatch):
    """Over all lists questions are not dealt to each list; blocks of questions change nothing, and with all candidates it is exact."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(600)
    v, q = e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.VectorIndex.build(v, new_folder(spark))
    narrow = {tuple(r) for r in index.search(q, 5, probes=len(index.centroids) - 1, refine=1000).select("query_id", "id").collect()}

    def never(*args):
        raise AssertionError("questions were dealt to lists")

    monkeypatch.setattr(vector_index, "_estimated", never)
    one = {tuple(r) for r in index.search(q, 5).collect()}
    monkeypatch.setattr(vector_index, "HELD", 1500)  # two blocks
    assert {tuple(r) for r in index.search(q, 5).collect()} == one
    monkeypatch.undo()
    whole = {(r.query_id, r.id) for r in index.search(q, 5, refine=1000).collect()}
    assert whole == {(r.query_id, r.id) for r in vectors.top_k(q, v, 5).collect()} and len(whole & narrow) >= 0.9 * len(whole)


def test_top_k_compares_small_blocks():
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd

    rng = np.random.default_rng(2)
    q, v = rng.normal(size=(2_048, 8)), rng.normal(size=(1_024, 8))
    shared, rows = SimpleNamespace(value=(np.arange(len(q)), q)), pd.DataFrame({"id": np.arange(len(v)), "embedding": list(v)})
    tracemalloc.start()
    got = pd.concat(vectors._best(shared, 3, "ip")(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    want = np.sort(np.argsort(1 - q @ v.T, axis=1)[:, :3], axis=1)
    assert (np.sort(got["id"].to_numpy().reshape(-1, 3), axis=1) == want).all()
