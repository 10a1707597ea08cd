"""Operators on small inputs written by the tests."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeloom.functions import intents, security, text
from tomeloom.operators import catalog, chunking, curation, dedup, filters, fulltext, retrieval, vectors
from tomeloom.sources import feeds, files
from tomeloom.streaming import changes


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first().x


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(1, 40))
def test_recursive_split_loses_nothing(content, limit):
    pieces = chunking.recursive_split(content, limit)
    assert "".join(pieces) == content and all(0 < len(p) <= limit for p in pieces)


def test_overlap_repeats_whole_parts():
    pieces = chunking.recursive_split("aa bb cc dd ee", 6, overlap=3)
    assert pieces[0] == "aa bb " and pieces[1].startswith("bb ")


def test_chunk_links(spark):
    rows = chunking.recursive_chunks(spark.createDataFrame([("d", "word " * 100), ("e", "  ")], "document_id string, content string"), 10).orderBy("chunk_index").collect()
    assert len(rows) > 5 and {r.document_id for r in rows} == {"d"}
    assert rows[0].prev_chunk_id is None and rows[-1].next_chunk_id is None
    assert all(a.next_chunk_id == b.chunk_id and b.prev_chunk_id == a.chunk_id for a, b in zip(rows, rows[1:]))


def test_markdown_context(spark):
    md = "lead\n# A\nx\n## B\ny\n### C\n\n## D\nz\n# E\n\n### F\nw\n"
    rows = chunking.markdown_sections(spark.createDataFrame([("d", md)], "document_id string, content string")).orderBy("chunk_index").collect()
    assert [(r.header_path, r.content) for r in rows] == [("", "lead"), ("A", "x"), ("A > B", "y"), ("A > D", "z"), ("E > F", "w")]


def test_paragraph_packing_overlaps():
    pieces = chunking.pack_paragraphs("\n\n".join(["p1" * 5, "p2" * 5, "p3" * 5, "p4" * 5]), 36, "H")
    assert pieces[0].startswith("# H\n\n") and len(pieces) > 1 and "p3" in pieces[-1] and "p4" in pieces[-1]


def test_semantic_and_length_chunks(spark):
    rows = [("d", i, f"sentence {i} is long enough to stand alone.", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0]])]
    got = chunking.semantic_chunks(spark.createDataFrame(rows, "document_id string, position int, sentence string, embedding array<double>"), 0.5, 10).orderBy("chunk_index").collect()
    assert [r.content.count("sentence") for r in got] == [2, 2]
    got = chunking.length_chunks(spark.createDataFrame([("d", "One two three. Four five six. Seven. ")], "document_id string, content string"), 20).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["One two three. Four five six. Seven."]


@pytest.mark.parametrize("query, parsed", [("a b", [[("a",), ("b",)]]), ('x "y z" or w', [[("x",), ("y", "z")], [("w",)]]), ("a AND b OR c", [[("a",), ("b",)], [("c",)]]), ("", []), ("(a) & !b", [[("a",), ("b",)]])])
def test_query_language(query, parsed):
    assert fulltext.parse(query) == parsed


def test_full_text_titles_and_phrases(spark):
    chunks = spark.createDataFrame([(1, "the quick brown fox", "fox"), (2, "brown quick", None), (3, "nothing", "quick brown")], "chunk_id long, content string, title string")
    queries = spark.createDataFrame([(1, '"quick brown"'), (2, "fox quick"), (3, "absent")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.rank for r in fulltext.search(queries, chunks).collect()}
    assert got == {(1, 3): 1, (1, 1): 2, (2, 1): 1}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y", "z"]), (3, None, [])], "n int, s string, l array<string>")
    ids = lambda f: sorted(r.n for r in filters.where(df, f).collect())
    assert ids({"n": {"$gt": 1}, "s": "b"}) == [2] and ids({"$or": [{"n": 1}, {"n": {"$in": [3]}}]}) == [1, 3]
    assert ids({"l": {"$contains": "z"}}) == [2] and ids({"s": {"$contains": "a"}}) == [1] and ids(None) == [1, 2, 3]
    for bad in ({"n": {"$near": 1}}, {"$not": []}, {"$and": []}):
        with pytest.raises(filters.FilterError):
            filters.where(df, bad)
    for bad in ("DELETE FROM x", "select 1; select 2", "select * into y from x"):
        with pytest.raises(filters.FilterError):
            filters.read_only_sql(spark, bad)


def test_scalar_functions(spark):
    lit = lambda f, v: one(spark, f(F.lit(v)))
    assert lit(text.file_type, "/a/B.PDF") == "pdf" and lit(text.file_type, "/a/b") == "other" and lit(text.file_type, "x.tar.jpeg") == "image"
    assert lit(text.slugify, "  Hello, World! ") == "hello-world" and lit(text.safe_filename, 'a<b>:"c". ') == "a_b___c_"
    assert lit(text.sentences, "One two. Three! four? Five") == ["One two.", "Three! four?", "Five"]
    assert [lit(security.cvss_severity, x) for x in (0.0, 3.9, 4.0, 9.0, 11.0)] == ["info", "low", "medium", "critical", "unknown"]
    assert lit(security.vendor_product, "cpe:2.3:a:apache:http_server:2.4:*:*:*:*:*:*:*") == "apache http server"
    assert [lit(intents.security_intent, x) for x in ("cve-2020-1", "T1059.001", "10.1.2.3", "evil.example.com", "a" * 32, "about CVE-2024-1", "weather")] == ["cve_lookup", "technique_lookup", "ioc_lookup", "ioc_lookup", "ioc_lookup", "cve_lookup", "general_security"]
    assert lit(intents.request_intent, "Stop watching /x").intent == "unwatch" and lit(intents.request_intent, "Why so?").confidence == 0.7
    assert lit(text.found_path, "ingest /data/x.md now") == "/data/x.md"
    assert one(spark, security.technique_ids(F.array(F.lit("attack.t1059.001"), F.lit("attack.execution")))) == ["T1059.001"]
    assert one(spark, security.tactics(F.array(F.lit("attack.t1059"), F.lit("attack.defense_evasion")))) == ["defense evasion"]
    assert one(spark, text.highlighted(F.lit("a Fox runs"), F.array(F.lit("fox")))) == "<mark>Fox</mark> runs"


@pytest.mark.parametrize(
    "content, path, kind",
    [("", "x", "unknown"), ("x", "/feeds/nvd/a", "nvd_cve"), ("detection:\n a: b\nlogsource:\n c: d", "x.txt", "sigma_rule"), ('{"cve": {"id": "CVE-2024-1"}}', "x", "nvd_cve"), ('{"type": "bundle", "objects": [{"type": "attack-pattern"}]}', "x", "mitre_attack"),
     ("---\nattack_id: T1\n---\nx", "x", "mitre_attack"), ("x", "/d/T1059.md", "mitre_attack"), ("1.2.3[.]4\nevil.example.com\n", "x", "ioc_list"), ("long " * 20, "x", "prose"), ("short", "x", "unknown")],
)
def test_source_types(spark, content, path, kind):
    assert one(spark, security.source_type(F.lit(content), F.lit(path))) == kind


def test_vector_search_and_upsert(spark):
    vs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id long, embedding array<float>")
    qs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, embedding array<float>")
    for block in (2, 100):
        got = vectors.top_k(qs, vs, 3, query_block=block).filter("query_id = 4").orderBy("rank").collect()
        assert [(r.id, round(r.distance, 6)) for r in got] == [(1, 0.0), (4, 0.0), (2, 1.0)]
    new = spark.createDataFrame([(2, [5.0, 5.0]), (9, [1.0, 1.0])], "id long, embedding array<float>")
    assert {r.id: list(r.embedding)[0] for r in vectors.upsert(vs, new, 2).collect()}[2] == 5.0
    with pytest.raises(Exception, match="length 2"):
        vectors.upsert(vs, spark.createDataFrame([(2, [5.0])], "id long, embedding array<float>"), 2).collect()
    with pytest.raises(ValueError):
        vectors.without_ids(vs, [])


def test_merge_and_rerank(spark):
    near = spark.createDataFrame([(1, 1, 0.2), (1, 2, 1.5)], "query_id int, chunk_id int, distance double")
    found = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.25)], "query_id int, chunk_id int, rank_score double")
    got = {r.chunk_id: round(r.score, 6) for r in retrieval.merge(near, found).collect()}
    assert got == {1: 0.86, 2: 0.0, 3: 0.15}
    hits = spark.createDataFrame([(1, 1, "a b", "x", 0.9), (1, 2, "a b", "a b", 0.1)], "query_id int, chunk_id int, query string, content string, score double")
    assert [(r.chunk_id, r.score) for r in retrieval.rerank(hits).orderBy(F.desc("score")).collect()] == [(2, 1.0), (1, 0.5)]


def test_dedup_matrix(spark):
    new = spark.createDataFrame([("a", "1", 5), ("b", "1", 5), ("c", "2", 5), ("d", "2", 5)], "path string, file_hash string, modified_at int")
    old = spark.createDataFrame([("b", "1", 9), ("c", "1", 9), ("d", "1", 1)], "path string, file_hash string, updated_at int")
    for how, third in (("auto", "skip"), ("duplicate", "update"), ("manual", "conflict")):
        assert [r.decision for r in dedup.decide(new, old, how).orderBy("path").collect()] == ["new", "skip", third, "update"]


def test_categories(spark):
    cats = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "x", 5), (5, "y", 4)], "category_id int, name string, parent_id int")
    assert sorted((r.path, r.depth) for r in catalog.category_paths(cats).collect()) == [("a", 0), ("a/b", 1), ("a/b/c", 2)]
    tags = spark.createDataFrame([(10, 2)], "document_id int, category_id int")
    with pytest.raises(ValueError):
        catalog.delete_category(cats, tags, 2)
    kept, left = catalog.delete_category(cats, tags, 2, force=True)
    assert sorted(r.category_id for r in kept.collect()) == [1, 4, 5] and left.count() == 0


@pytest.mark.parametrize("reply, found", [('```json\n[{"category": "a", "confidence": 3}]\n```', [("a", 1.0)]), ('Sure: {"suggestions": [{"path": "p", "score": 0.4}]}', [("p", 0.4)]), ('{"name": "n"}', [("n", 0.7)]), ("no", []), (None, [])])
def test_replies(spark, reply, found):
    df = spark.createDataFrame([(1, reply)], "document_id int, reply string")
    assert [(r.path, r.confidence) for r in curation.suggestions(df).collect()] == found


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("é".encode())
    (tmp_path / "sub/b.txt").write_bytes(b"\xe9t\xe9")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b" \n")
    good, bad = files.admitted(files.discover(spark, str(tmp_path)))
    assert sorted(r.text for r in good.collect()) == ["é", "été"] and [r.error for r in bad.collect()] == ["no text"]
    assert files.discover(spark, str(tmp_path), recursive=False).count() == 2


def test_nvd_feed(spark):
    record = {"id": "CVE-2024-1", "published": "2024-01-02T03:04:05", "descriptions": [{"lang": "fr", "value": "non"}, {"lang": "en", "value": "bad"}], "metrics": {"cvssMetricV31": [{"type": "Secondary", "cvssData": {"baseScore": 1.0}}, {"type": "Primary", "cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]},
              "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "CWE-79"}]}], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:p_q:1:*"}]}]}], "references": [{"url": "u"}]}
    five = {"dataType": "CVE_RECORD", "cveMetadata": {"cveId": "CVE-2023-9", "datePublished": None, "dateReserved": "2023-01-01T00:00:00"}, "containers": {"cna": {"descriptions": [{"lang": "en", "value": "d"}], "affected": [{"vendor": "v", "product": "p"}], "metrics": [{"cvssV3_1": {"baseScore": 5.0}}]}}}
    texts = [json.dumps({"vulnerabilities": [{"cve": record}]}), json.dumps({"cve": record}), json.dumps(record), json.dumps({"CVE-2024-1": record}), json.dumps(five), "{broken"]
    got = feeds.nvd_records(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sorted(r.cve_id for r in got) == ["CVE-2023-9", "CVE-2024-1", "CVE-2024-1", "CVE-2024-1", "CVE-2024-1"]
    r = next(r for r in got if r.cve_id == "CVE-2024-1")
    assert (r.cvss_score, r.severity, r.cwes, r.products, r.description) == (9.8, "critical", ["CWE-79"], ["v p q"], "bad")
    assert next(r for r in got if r.cve_id == "CVE-2023-9").severity == "medium"


def test_attack_feeds(spark):
    bundle = {"type": "bundle", "objects": [{"type": "attack-pattern", "name": "n", "description": "d", "external_references": [{"source_name": "mitre-attack", "external_id": "T1059"}], "kill_chain_phases": [{"phase_name": "execution"}], "x_mitre_platforms": ["Windows"], "x_mitre_detection": "see"}, {"type": "malware", "name": "m"}]}
    got = feeds.stix_sections(spark.createDataFrame([(json.dumps(bundle),), ("x",)], "text string")).collect()
    assert sorted((r.section, r.content, r.technique_id) for r in got) == [("description", "d", "T1059"), ("detection", "see", "T1059")]
    md = "---\nattack_id: T1059.001\nname: \"N\"\ntactic: execution\nplatforms: Windows, Linux\n---\nlead\n## Detection\nsee\n## Empty\n"
    got = feeds.attack_markdown(spark.createDataFrame([(md,), ("plain",)], "text string")).collect()
    assert [(r.section, r.content, r.technique_id, r.platforms) for r in got] == [("description", "lead", "T1059.001", ["Windows", "Linux"]), ("detection", "see", "T1059.001", ["Windows", "Linux"])]


def test_sigma_feed(spark):
    pytest.importorskip("yaml")
    rules = "title: A\nlevel: high\ntags: [attack.t1059, attack.execution]\nlogsource: {product: windows}\ndetection: {condition: x}\n---\nid: 7\n---\nother: 1\n"
    got = feeds.sigma_rules(spark.createDataFrame([(rules,), ("a: [",)], "text string")).collect()
    assert [(r.title, r.severity, r.technique_ids, r.platforms) for r in got] == [("A", "high", ["T1059"], ["windows"]), (None, "unknown", [], [])]


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [("created", "/w/a.md", 1), ("modified", "/w/a.md", 2), ("modified", "/w/.git/b.md", 3), ("deleted", "/w/c.md", 4), ("created", "/v/d.txt", 5), ("created", "/v/e.bin", 6)]
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"change_type": c, "path": p, "ts": dt.datetime(2024, 1, 1, 0, n).isoformat()}) for c, p, n in rows[i::2]))
    taken, gone = [], []
    changes.run(changes.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: taken.extend(r.path for r in df.collect()), lambda df, n: gone.extend(r.path for r in df.collect())).awaitTermination(60)
    assert sorted(set(taken)) == ["/v/d.txt", "/w/a.md"] and gone == ["/w/c.md"]
    batch = spark.read.schema(changes.CHANGES).json(str(tmp_path / "in"))
    watches = spark.createDataFrame([(1, "/w"), (2, "/v/")], "watch_id int, prefix string")
    totals = changes.watch_totals(changes.routed(batch, watches).withColumn("failed", F.lit(False)))
    assert {r.watch_id: r.processed for r in totals.collect()} == {1: 4, 2: 2}


def test_cloud_changes(spark):
    drive = {"changes": [{"fileId": "1", "removed": True}, {"fileId": "2", "file": {"name": "b.md", "trashed": False, "size": "7"}}]}
    one_drive = {"value": [{"id": "r", "root": {}}, {"id": "3", "name": "c.md", "size": 4}, {"id": "4", "deleted": {"state": "x"}}]}
    got = changes.cloud_changes(spark.createDataFrame([(json.dumps(drive),), (json.dumps(one_drive),)], "text string")).collect()
    assert sorted((r.path, r.change_type, r.size_bytes) for r in got if True) == [("1", "deleted", None), ("4", "deleted", None), ("b.md", "modified", 7), ("c.md", "modified", 4)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_parsed_queries_hold_quotes_and_alternatives(spark, tmp_path):
    from tomeloom import plans

    said = [(1, 0, "user", 'red "Big Fox" OR blue'), (1, 1, "assistant", "no"), (1, 2, "user", "cat and dog"), (7, 0, "user", 'or "" AND x "one'), (9, 0, "user", None)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    clauses = {(1, 0): [{("red",), ("big", "fox")}, {("blue",)}], (1, 2): [{("cat",), ("dog",)}], (7, 0): [{("x",), ("one",)}]}
    expected = sorted((*key, c, len(phrases), p, len(phrase), i, w) for key, found in clauses.items() for c, phrases in enumerate(found) for p, phrase in enumerate(sorted(phrases)) for i, w in enumerate(phrase))
    assert sorted(map(tuple, plans.QUERIES["h4_parsed_queries"](spark, str(tmp_path)).collect())) == expected


def test_parsed_queries_cover_all_user_turns(spark, sf):
    from tomeloom import plans

    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'user'").collect()}
    got = {(r.conv_id, r.turn) for r in plans.QUERIES["h4_parsed_queries"](spark, sf).collect()}
    # a turn has terms unless nothing but its operators are words
    assert got == {k for k, t in turns.items() if any(w.upper() not in ("OR", "AND") for w in (t or "").split() if any(c.isalnum() for c in w))}


def test_semantic_chunks_query_keeps_all_turns(spark, tmp_path):
    from tomeloom import plans

    spark.createDataFrame([(c, t, "user", f"turn {c} {t}") for c in range(4) for t in range(3)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(0, 9, 2)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.document_id: r.content for r in plans.QUERIES["i5_semantic_chunks"](spark, str(tmp_path)).collect()}
    assert got == {c: " ".join(f"turn {c} {t}" for t in range(3)) for c in range(4)}


def test_search_equals_plain_search(spark):
    import math
    import random

    rng = random.Random(4)
    texts = {i: " ".join(rng.choices("abcd", k=rng.randint(0, 30))) for i in range(40)}
    titles = {i: " ".join(rng.choices("abcd", k=2)) for i in texts}
    asked = {1: '"a b c"', 2: "a d", 3: '"a a" OR b', 4: 'c "b a b a" OR "zz"', 5: "", 6: '"a b" "c d"'}
    chunks = spark.createDataFrame([(i, t, titles[i]) for i, t in texts.items()], "chunk_id long, content string, title string")
    got = fulltext.search(spark.createDataFrame(list(asked.items()), "query_id long, query string"), chunks, None).collect()
    expected = {}
    for q, query in asked.items():
        for i in texts:
            r = 0.0
            for clause in fulltext.parse(query):
                values = []
                for phrase in set(clause):
                    n = [sum(tuple(ws[p : p + len(phrase)]) == phrase for p in range(len(ws))) for ws in (titles[i].split(), texts[i].split())]
                    values.append((any(n), 1.0 * math.log1p(n[0]) + 0.4 * math.log1p(n[1])))
                r += sum(v for _, v in values) if all(x for x, _ in values) else 0
            if r:
                expected[q, i] = r / (r + 1)
    assert {(r.query_id, r.chunk_id) for r in got} == set(expected) and len(expected) > 50
    assert all(abs(r.rank_score - expected[r.query_id, r.chunk_id]) < 1e-9 for r in got)


def test_english_search_ignores_endings_and_stop_words(spark):
    chunks = spark.createDataFrame([(1, "The dogs are running fast"), (2, "A cat sleeps")], "chunk_id int, content string")
    asked = spark.createDataFrame([(1, "dog"), (2, '"dog run"'), (3, "the cats"), (4, "sleeping")], "query_id int, query string")
    got = sorted((r.query_id, r.chunk_id) for r in fulltext.search(asked, chunks, english=True).collect())
    assert got == [(1, 1), (3, 2), (4, 2)]
    df = spark.createDataFrame([("relational hopefulness classes studies agreed is bus",)], "t string")
    assert df.select(fulltext.english_terms(F.col("t")).alias("x")).first().x == ["relate", "hopeful", "class", "studi", "agre", "bus"]


def test_length_chunks_equal_plain_packing(spark):
    import random
    import re

    rng = random.Random(2)
    texts = {str(i): " ".join("".join(rng.choices("ab ", k=rng.randint(1, 30))).strip().capitalize() + rng.choice(".!?") for _ in range(rng.randint(0, 9))) for i in range(30)}
    got = {}
    for r in chunking.length_chunks(spark.createDataFrame(list(texts.items()), "document_id string, content string"), 25).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r)
    for d, text_ in texts.items():
        done, now = [], ""
        for sentence in (x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text_) if x.strip()):
            now = f"{now} {sentence}" if now else sentence
            if len(now) >= 25:
                done.append(now)
                now = ""
        if now:
            done = [*done[:-1], f"{done[-1]} {now}" if done else now]
        rows = got.get(d, [])
        assert [r.content.strip() for r in rows] == [x.strip() for x in done]
        assert [r.prev_chunk_id for r in rows] == [None, *[r.chunk_id for r in rows]][: len(rows)]


def test_recursive_chunks_hold_the_whole_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"))
    pieces = {}
    for r in chunking.recursive_chunks(docs, 250).orderBy("document_id", "chunk_index").collect():
        assert len(r.content) <= 1000 and r.token_count == len(r.content) // 4
        pieces.setdefault(r.document_id, []).append(r)
    for r in docs.collect():
        rows = pieces.get(r.document_id, [])
        assert "".join("".join(x.content for x in rows).split()) == "".join((r.content or "").split())
        assert [x.chunk_index for x in rows] == list(range(len(rows)))
        assert all(a.next_chunk_id == b.chunk_id and b.prev_chunk_id == a.chunk_id for a, b in zip(rows, rows[1:]))


def test_cross_references_of_hubs(spark):
    rows = [(1, f"s{i}") for i in range(23)] + [(2, "s1"), (2, "x"), (3, "alone")]
    got = {(r.source, r.target) for r in curation.cross_references(spark.createDataFrame(rows, "document_id int, slug string"), hub=5).collect()}
    assert got == {(a, b) for d in (1, 2) for x, a in rows if x == d for y, b in rows if y == d and a != b}


def test_top_k_in_blocks_equals_sorting(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    vs = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(300)]
    df = spark.createDataFrame(vs, "id long, embedding array<double>")
    for metric in ("cosine", "l2", "ip"):
        got = {}
        for r in vectors.top_k(df.filter("id < 30").withColumnRenamed("id", "query_id"), df, 7, metric, query_block=11).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q, e in vs[:30]:
            a = np.array(e)

            def far(b, a=a, metric=metric):
                b = np.array(b)
                n = np.sqrt((a * a).sum() * (b * b).sum())
                return round(1 - (a @ b / n if n else 0.0), 12) if metric == "cosine" else round(((a - b) ** 2).sum(), 12) if metric == "l2" else round(1 - a @ b, 12)

            assert got[q] == [i for _, i in sorted((far(b), i) for i, b in vs)[:7]]


def test_highlights_mark_terms(spark):
    df = spark.createDataFrame([("one two three four", ["two"]), ("none here", ["x"])], "t string, terms array<string>")
    assert [r.x for r in df.select(text.highlighted(F.col("t"), F.col("terms")).alias("x")).collect()] == ["<mark>two</mark> three four", "none here"]


def test_security_chunks_reference_piece(spark):
    record = {"id": "CVE-2024-1", "descriptions": [{"lang": "en", "value": "long " * 50}], "references": [{"url": "u1"}, {"url": "u2"}]}
    from tomeloom.operators.security_chunks import security_chunks

    docs = spark.createDataFrame([(1, json.dumps({"vulnerabilities": [{"cve": record}, {"cve": {**record, "id": "CVE-2024-2"}}]})), (2, " ")], "document_id int, content string")
    rows = security_chunks(docs, 10).orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.cve_id, r.chunk_index) for r in rows] == [("cve_description", "CVE-2024-1", 0), ("cve_references", "CVE-2024-1", 1), ("cve_description", "CVE-2024-2", 2), ("cve_references", "CVE-2024-2", 3)]
    assert rows[1].content == "CVE: CVE-2024-1\nReferences: u1\nu2" and rows[0].next_chunk_id == rows[1].chunk_id


def test_latencies_are_exact_ranks(spark):
    """More distinct durations than any sketch keeps, a null metric, null durations."""
    n = 200_001
    log = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("metric"), F.when(F.col("id") % 5 > 0, F.pmod(F.col("id") * 7_919, F.lit(n)) / 7).alias("ms"))
    got = {r.metric: r for r in catalog.latencies(log, "metric", "ms").collect()}
    for metric in ("a", None):
        ids = [i for i in range(n) if (i % 3 > 0) == (metric == "a")]
        ms = sorted(i * 7_919 % n / 7 for i in ids if i % 5)
        want = [ms[-(-len(ms) * p // 100) - 1] for p in (50, 95, 99)]
        assert [got[metric].n, got[metric].p50, got[metric].p95, got[metric].p99] == [len(ids), *want]


def test_a_word_asked_alone_joins_its_best_chunks_only(spark):
    """Many questions for a word of every chunk: what is joined is k rows of each, and ties, phrases and sums stay right."""
    chunks = spark.range(500).select(F.col("id").alias("chunk_id"), F.expr("concat(repeat('common ', 1 + int(id % 4)), if(id % 50 = 0, 'rare word', 'x'))").alias("content"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.expr("case when id = 298 then 'rare OR common' when id = 299 then '\"rare word\"' when id % 2 = 0 then 'Common' else 'common AND common' end").alias("query"))
    whole = {(r.query_id, r.chunk_id, r.rank_score, r["rank"]) for r in fulltext.search(queries, chunks, None).filter("rank <= 3").collect()}
    best = fulltext.search(queries, chunks, 3)
    assert {tuple(r) for r in best.select("query_id", "chunk_id", "rank_score", "rank").collect()} == whole and len(whole) == 900
    # the question's number does not stand beside all 500 chunks: the plan ranks by phrase
    alone = fulltext.search(queries.filter("query_id < 298"), chunks, 3)
    assert "query_id" not in next(x for x in alone._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in x)


def test_small_files_of_long_work_are_spread(spark):
    """One small file is read by one task; what parses its texts is dealt to all cores."""
    rule = "title: a\nid: b\nlevel: high\ndetection:\n  condition: sel\n"
    texts = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("document_id"), F.lit(rule).alias("text"))
    rules = feeds.sigma_rules(texts)
    seeds = catalog.category_seeds(texts.select(F.lit("categories:\n  - name: Top\n").alias("text")))
    records = feeds.nvd_records(texts.select(F.lit('{"id": "CVE-2024-1000"}').alias("text")))
    for df in (rules, seeds, records):
        assert df.count() == 400 and df.select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_texts_are_cut_in_lots(monkeypatch):
    """A batch of many texts is not cut all at once, and no text is lost or cut between lots."""
    import pandas as pd

    monkeypatch.setattr(chunking, "LOT", 100)
    texts = ["x" * (i % 60) for i in range(200)] + [None, "y" * 500, ""]
    batch = pd.DataFrame({"document_id": range(203), "content": texts})
    lots = list(chunking._lots(iter([batch, batch.iloc[:0]])))
    assert [t for lot in lots for t in lot["content"]] == texts and len(lots) > 20
    assert all(sum(len(t or "") for t in lot["content"][:-1]) < 100 for lot in lots)
