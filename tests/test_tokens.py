"""Polling by tokens: restarts, replays, expired tokens; and what counts as a domain."""

import json

import pytest
from pyspark.sql import functions as F

from tomeloom.functions import intents
from tomeloom.streaming import tokens
from tomeloom.work import new_folder


def feed_of(path):
    """A feed whose answers lie in a JSON file: token -> [text, next token, last] or "expired"; it counts what it is asked."""

    def fetch(token):
        with open(path) as f:
            answers = json.load(f)
        with open(path + ".asked", "a") as f:
            f.write(f"{token}\n")
        got = answers.get("start" if token is None else token)
        if got == "expired":
            raise tokens.TokenExpired(token)
        return got and tokens.Page(*got)

    return fetch


def poll(spark, path, folder, most=100, fail=False):
    seen = []

    def each(batch, _):
        rows = [(r.page, r.token, r.reset, r.text) for r in batch.orderBy("page").collect()]
        seen.extend(rows)
        if fail:
            raise RuntimeError("the batch fails")

    stream = tokens.polled(spark, feed_of(path), f"{folder}/pages", most).writeStream.foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    except Exception:
        if not fail:
            raise
    return seen


def put(path, answers):
    with open(path, "w") as f:
        json.dump(answers, f)


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    path, folder = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    put(path, {"start": ["a", "1", False], "1": ["b", "2", True], "2": ["", "2", True]})
    assert poll(spark, path, folder) == [(1, None, False, "a"), (2, "1", False, "b")]
    assert poll(spark, path, folder) == []  # the feed has nothing new
    put(path, {"2": ["c", "3", False], "3": ["d", "4", False], "4": ["e", "5", True]})
    assert poll(spark, path, folder, most=2) == [(3, "2", False, "c"), (4, "3", False, "d")]
    assert poll(spark, path, folder, most=2) == [(5, "4", False, "e")]
    assert poll(spark, path, folder) == []  # no page lands before the feed has one


def test_a_failed_batch_is_repeated_from_landed_pages(spark, tmp_path):
    path, folder = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    put(path, {"start": ["a", "1", False], "1": ["b", "2", True]})
    first = poll(spark, path, folder, fail=True)
    put(path, {"start": ["other", "9", True], "1": ["other", "9", True], "2": ["c", "3", True]})
    again = poll(spark, path, folder)  # a run that repeats a batch takes no more
    assert first == again == [(1, None, False, "a"), (2, "1", False, "b")] and poll(spark, path, folder) == [(3, "2", False, "c")]


def test_an_expired_token_begins_anew(spark, tmp_path):
    path, folder = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    put(path, {"start": ["a", "1", True], "1": ["b", "2", True]})
    assert poll(spark, path, folder) == [(1, None, False, "a")]
    put(path, {"start": ["all", "7", False], "1": "expired", "7": ["more", "8", True]})
    assert poll(spark, path, folder) == [(2, None, True, "all"), (3, "7", False, "more")]


def test_landed_pages_of_another_stream_are_an_error(spark, tmp_path):
    reader = tokens._Reader(None, str(tmp_path / "none"), 5)
    with pytest.raises(ValueError, match="not of one stream"):
        reader.partitions({"page": 0}, {"page": 3})
    assert reader.partitions({"page": 3}, {"page": 3}) == []


def test_finished_pages_go(tmp_path):
    landing = tokens._Landing(str(tmp_path / "pages"))
    for n in range(1, 5):
        landing.write(n, {"token": None, "next": str(n), "reset": False, "text": "é"})
    reader = tokens._Reader(None, str(tmp_path / "pages"), 5)
    reader.commit({"page": 2})
    assert landing.numbers() == [3, 4] and list(reader.read(tokens._Pages(3, 4)))[0] == (3, None, False, "é")
    reader.commit({"page": 4})
    assert landing.numbers() == [4]


def test_pages_of_drives():
    assert tokens.as_page('{"nextPageToken": "5"}') == tokens.Page('{"nextPageToken": "5"}', "5", False)
    assert tokens.as_page('{"newStartPageToken": "6"}').last and tokens.as_page('{"@odata.deltaLink": "x"}').next_token == "x"
    assert not tokens.as_page('{"@odata.nextLink": "y"}').last
    with pytest.raises(ValueError):
        tokens.as_page("{}")


def test_landed_feed_waits_for_pages(spark):
    folder = new_folder(spark)
    spark.createDataFrame([("0", '{"nextPageToken": "1"}')], "token string, text string").write.partitionBy("token").text(folder)
    fetch = tokens.landed_feed(folder)
    assert fetch(None) == fetch("0") == tokens.Page('{"nextPageToken": "1"}\n', "1", False) and fetch("1") is None


DOMAINS = {
    "example.com": True, "a.b": False, "a.bc": True, "a-b.c1.org": True, "-a.com": False, "a-.com": False, "a--b.com": True, "a..com": False, ".com": False, "com": False, "": False,
    "a.c0m": False, "a.com.": False, "a_b.com": False, "é.com": False, "x" * 63 + ".com": True, "x" * 64 + ".com": False, ".".join(["x" * 49] * 5) + ".com": True, ".".join(["x" * 49] * 5) + ".comm": False, "a b.com": False, "a\n.com": False,
}


def test_domains(spark):
    rows = spark.createDataFrame([(k,) for k in DOMAINS], "t string").select("t", intents.is_domain(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == DOMAINS
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(intents.is_indicator(F.col("t")).alias("d")).first().d is None
