"""Batches of a library: whole or not at all, once, on top of one another."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tomeloom.plans import ingest
from tomeloom.plans.library import SCHEMAS, Library
from tomeloom.work import new_folder

AT = dt.datetime(2024, 1, 1)


def files(spark, rows, hours=0):
    rows = spark.createDataFrame([(p, t, AT + dt.timedelta(hours=hours)) for p, t in rows], "path string, text string, modified_at timestamp")
    return rows.withColumn("file_hash", F.sha2("text", 256))


def tagger(documents):
    return documents.select("path", F.lit("c").alias("category_id"), F.lit(0.5).alias("confidence"), F.lit("t").alias("tagged_by"))


def state(library):
    timeless = {"steps": ["duration_ms"]}
    return {sink: sorted(map(str, library.read(sink).drop("place", *timeless.get(sink, [])).collect())) for sink in SCHEMAS}


FIRST = [("a", "one two. " * 200), ("b", "one two. " * 200), ("c", None), ("d", " "), ("e", "three")]


def test_fail_between_any_two_sinks_and_repeat(spark, monkeypatch):
    whole = Library(spark, new_folder(spark))
    assert whole.ingest("1", files(spark, FIRST), F.lit(AT), tagger, chunk_tokens=100)
    want = state(whole)
    assert len(want["documents"]) == 2 and len(want["chunks"]) == len(want["vectors"]) > 2 and len(want["tags"]) == 2
    real = Library._write
    library = Library(spark, new_folder(spark))
    for broken in [s for s in SCHEMAS if s != "tags"]:
        with monkeypatch.context() as m:

            def write(self, folder, sink, *rest, broken=broken):
                if sink == broken:
                    raise OSError(f"no {sink}")
                return real(self, folder, sink, *rest)

            m.setattr(Library, "_write", write)
            with pytest.raises(OSError):
                library.ingest("1", files(spark, FIRST), F.lit(AT), tagger, chunk_tokens=100)
        assert not library.batches() and library.read("chunks").count() == 0
    assert library.ingest("1", files(spark, FIRST), F.lit(AT), tagger, chunk_tokens=100)
    assert not library.ingest("1", files(spark, FIRST), F.lit(AT), tagger, chunk_tokens=100)
    assert state(library) == want and library.batches() == ["1"]


def test_updates_deletes_compaction_and_old_versions(spark):
    library = Library(spark, new_folder(spark))
    library.ingest("1", files(spark, FIRST), F.lit(AT), chunk_tokens=100)
    library.ingest("2", files(spark, [("a", "new"), ("e", "three"), ("f", "six")], 1), F.lit(AT))
    library.ingest("3", files(spark, [("a", "older")], -1), F.lit(AT))  # the stored row is newer: left
    library.delete("4", spark.createDataFrame([("f",), ("nobody",)], "path string"), F.lit(AT))
    docs = {r.path: (r.version, r.batch, r.n_chunks) for r in library.read("documents").collect()}
    assert docs == {"a": (2, "2", 1), "e": (1, "1", 1)}
    assert sorted(r.content for r in library.read("chunks").collect()) == ["new", "three"]
    assert {r.path for r in library.read("vectors", 2).collect()} == {"a", "e", "f"}  # as of the second batch
    before = state(library)
    library.compact()
    assert state(library) == before and library.versions.latest() == 5
    library.ingest("5", files(spark, [("f", "again")], 2), F.lit(AT))
    assert {r.path: r.version for r in library.read("documents").collect()} == {"a": 2, "e": 1, "f": 1}
    steps = {(r.path, r.step): (r.status, r.batch) for r in library.read("steps").collect()}
    assert steps["c", "failed"] == ("failed", "1") and steps["b", "skipped"] == ("skipped", "1") and steps["f", "deleted"] == ("success", "4") and ("a", "tagged") not in steps
    assert library.read("steps").filter("step = 'chunked' and duration_ms <= 0").count() == 0


def test_a_failing_tagger_costs_the_tags_only(spark):
    def broken(documents):
        return documents.select(F.raise_error(F.lit("no model")).alias("path"), F.lit("c").alias("category_id"), F.lit(1.0).alias("confidence"), F.lit("t").alias("tagged_by"))

    library = Library(spark, new_folder(spark))
    assert library.ingest("1", files(spark, [("a", "one")]), F.lit(AT), broken)
    assert library.read("tags").count() == 0 and library.read("documents").count() == 1
    failed = library.read("steps").filter("step = 'tagged'").collect()
    assert [(r.path, r.status) for r in failed] == [("a", "failed")] and "error" in failed[0].details


def test_another_writer_comes_first(spark, monkeypatch):
    """The slower writer decides again on the faster one's documents: the same file is an update, not a second new one."""
    path = new_folder(spark)
    library, real, came = Library(spark, path), Library._write, []

    def write(self, folder, sink, *rest):
        if sink == "steps" and not came:
            came.append(1)
            Library(spark, path).ingest("fast", files(spark, [("a", "one")]), F.lit(AT))
        return real(self, folder, sink, *rest)

    monkeypatch.setattr(Library, "_write", write)
    assert library.ingest("slow", files(spark, [("a", "two")], 1), F.lit(AT))
    assert library.batches() == ["fast", "slow"]
    assert [(r.path, r.version, r.batch) for r in library.read("documents").collect()] == [("a", 2, "slow")]


def test_empty_batch_and_empty_library(spark):
    library = Library(spark, new_folder(spark))
    assert all(library.read(s).count() == 0 for s in SCHEMAS)
    assert library.ingest("0", files(spark, []), F.lit(AT)) and library.batches() == ["0"] and library.read("documents").count() == 0


def test_embedder_hashes_a_word_once(monkeypatch):
    import pandas as pd

    hashed, real = [], ingest.xxhash.xxh32_intdigest
    monkeypatch.setattr(ingest.xxhash, "xxh32_intdigest", lambda w: hashed.append(w) or real(w))
    monkeypatch.setattr(ingest, "_places", {})
    a, b, c = ingest.hashed_words(pd.Series(["Ein Wort, ein Wort", None, "wort 中"]), 16)
    assert sorted(hashed) == sorted(["ein", "wort", "中"]) and not b.any()
    for got, words in ((a, ["ein", "wort"] * 2), (c, ["wort", "中"])):
        want = [0.0] * 16
        for w in words:
            want[real(w) % 16] += 1 if real(w) & 0x80000000 else -1
        assert all(abs(x - y / max(1e-9, sum(v * v for v in want) ** 0.5)) < 1e-6 for x, y in zip(got.tolist(), want, strict=True))
    monkeypatch.setattr(ingest, "REMEMBERED", 2)
    ingest.hashed_words(pd.Series(["a b c d e"]), 16)
    assert len(ingest._places[16]) <= 2


def test_words_whose_signs_cancel_have_a_vector():
    import pandas as pd

    a, b, c = ingest.hashed_words(pd.Series(["Die berß iegeß keit.", "keit, keit iegeß berß berß die die iegeß", " ,. "]))
    for got in (a, b):
        assert abs(float((got * got).sum()) - 1) < 1e-6 and (got >= 0).all()
    assert not c.any()
