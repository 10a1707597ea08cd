"""Operators of tomeloom.llm against brute force, and their edge cases, on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tomeloom.llm import decontamination, fingerprints, html, lm, mixing, sharding, similarity, substrings, token_counts, toxicity
from tomeloom.llm.common import LETTER_WORD, SPACE_WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _shard string, kind string"


def frame(spark, rows):
    """rows of (doc_id, text, source), with more columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 260))) for _ in range(n)]
    for i in range(0, n - 3, 6):
        base[i + 1] = base[i]
        ws = base[i].split()
        if ws:
            ws[len(ws) // 2] = "changed"
        base[i + 2] = " ".join(ws)
        base[i + 3] = base[i + 3] + " " + " ".join(base[i].split()[20:90])
    base[5], base[11] = "", "Short ONE."
    rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(base)]
    rows[17] = (17, None, "s1")
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def letters(t):
    return re.findall(LETTER_WORD, (t or "").encode().lower().decode())


def shingles(ws, k=5):
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def test_substrings_equal_brute_force(spark, rows):
    out = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    words = {i: re.findall(SPACE_WORD, t or "") for i, t, _ in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][p : p + 50]), i)
    removed = 0
    for i, ws in words.items():
        gone = {q for p in range(len(ws) - 49) if first[tuple(ws[p : p + 50])] < i for q in range(p, p + 50)}
        assert out[i].n_words == len(ws) and out[i].n_removed == len(gone)
        assert out[i].kept == " ".join(w for q, w in enumerate(ws) if q not in gone)
        removed += len(gone)
    assert removed > 500


def test_similar_judges_rows_of_one_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = frame(spark, [(1, a, "s"), (1, b, "s"), (2, a, "s"), (3, b, "s"), (None, b, "s"), (4, a + " more", "s"), (4, a + " more", "s")])
    got = sorted((r.doc_id or -1, r.class_id, r.copy_id, r.n_links) for r in similarity.similar(df).collect())
    assert got == sorted([(1, 1, 1, 3), (1, 1, 1, 2), (2, 1, 1, 3), (3, 1, 1, 2), (-1, 1, 1, 2), (4, 1, 4, 3), (4, 1, 4, 3)])


def test_similar_equals_brute_force(spark, rows):
    out = {r.doc_id: r for r in similarity.similar(frame(spark, rows), block=2).collect()}
    sets = {i: shingles(letters(t)) for i, t, _ in rows}
    links = {i: {j for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    assert sum(map(len, links.values())) > 20
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        assert (out[i].n_links, out[i].class_id) == (len(links[i]), min(group))
        assert out[i].copy_id == min([i, *(j for j in links[i] if sets[j] == sets[i])])


def test_pruning_keeps_likely_pairs():
    least = similarity.fewest_matches(0.8, 1e-9)
    assert list(least) == sorted(least) and least[-1] < similarity.HASHES * 0.8
    assert similarity.fewest_matches(0.8, 1e-2)[-1] > least[-1]


def test_connected_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 101)], "u long, v long")
    roots = {r.node: r.root for r in similarity.connected(edges).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontamination_windows_of_all_sizes(spark, rows):
    texts = [t or "" for _, t, _ in rows]
    items = [(1, " ".join(texts[0].split()[3:40])), (2, "short one"), (3, "w1"), (4, None), (5, ""), (6, " ".join(texts[8].split()[:12]) + " and more"), (1, "repeated item w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "w2")]
    got = {r.doc_id: r for r in decontamination.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    far = {r.doc_id: r for r in decontamination.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=0).collect()}
    assert got == far
    for i, t, _ in rows:
        ws, hit, names = letters(t), set(), set()
        for item, text in items:
            iw = letters(text)
            n = min(10, len(iw))
            for p in range(len(iw) - n + 1 if n and item is not None else 0):
                for q in range(len(ws) - n + 1):
                    if ws[q : q + n] == iw[p : p + n]:
                        hit |= set(range(q, q + n))
                        names.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (len(ws), len(hit), sorted(names))


def test_fingerprints_equal_brute_force(spark, rows):
    def sketch(t):
        ws, found = letters(t), set()
        for g in shingles(ws):
            h = 42
            for w in g:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            found.add(h - (1 << 64) if h >> 63 else h)
        return sorted(found)[: fingerprints.SKETCH]

    out = {r.doc_id: r for r in fingerprints.fingerprint(frame(spark, rows)).collect()}
    texts = [t or "" for _, t, _ in rows]
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        assert out[i].edited == edited and out[i].n_chars == len(t)
        assert list(out[i].sketch) == sketch(t) and list(out[i].edited_sketch) == sketch(edited) and list(out[i].next_sketch) == sketch(following)


def test_sketch_estimates(spark):
    words = [f"x{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words[:4000]), " ".join(words[1000:5000]))], "a string, b string")
    df = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_count(fingerprints.merged(F.col("a"), F.col("b"))).alias("n")).first()
    assert abs(r.r - 0.6) < 0.1 and abs(r.c - 0.75) < 0.12 and abs(r.n - 5000) < 1000
    both = fingerprints.merge_sketches(df.select(F.lit(1).alias("k"), F.col("a").alias("s")).union(df.select(F.lit(1), "b")), ["k"], "s").first().s
    assert list(both) == list(df.select(fingerprints.merged(F.col("a"), F.col("b")).alias("m")).first().m)


def test_mixing_targets_and_draws(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    sizes = {i: len(re.findall(SPACE_WORD, t or "")) for i, t, _ in rows}
    by = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in {s for _, _, s in rows}}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weights, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(by.values())
    free = set(order)
    while True:
        level = left / sum(weights[s] for s in free)
        capped = {s for s in free if level * weights[s] > 2 * by[s]}
        if not capped:
            break
        for s in capped:
            target[s] = 2.0 * by[s]
            left -= target[s]
        free -= capped
    target |= {s: level * weights[s] for s in free}
    assert {r.doc_id: r["size"] for r in got} == sizes
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r["size"] for r in mine)
    assert sorted(got) == sorted(mixing.mix(frame(spark, rows).repartition(5)).collect())


def test_sharding_versions_and_conflict(spark, tmp_path, rows):
    store = sharding.Store(spark, str(tmp_path / "store"), target_bytes=1 << 20, fanout=3)
    docs = frame(spark, rows)
    for k in range(4):
        store.append(docs.filter(F.col("doc_id") % 4 == k).coalesce(2))
    before = store.manifest().count()
    assert store.version() == 4 and store.compact() == 5
    assert store.manifest().count() < before and store.compact() == 5
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(store.read()) == sorted(i for i, _, _ in rows) and len(ids(store.read(1))) == sum(i % 4 == 0 for i, _, _ in rows)
    assert set(docs.columns) == set(store.read().columns)
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest(), 5)
    assert store.vacuum() == 4 and ids(store.read()) == sorted(i for i, _, _ in rows)


def test_sharding_keeps_contents_and_tiers(spark, tmp_path, rows):
    store = sharding.Store(spark, str(tmp_path / "tiers"), target_bytes=40_000, fanout=4)
    docs = frame(spark, rows)
    contents = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
    store.append(docs.coalesce(1))  # a large run stays as it is
    for k in range(5):
        store.append(docs.filter(F.col("doc_id") % 5 == k).limit(3).coalesce(1))
    before = {r.run: r for r in store._runs().collect()}
    tiers = {r.run: r.tier for r in store.tiers().collect()}
    merged = {run for run, t in tiers.items() if sum(before[r].shards for r, u in tiers.items() if u == t) >= 4}
    wanted = contents(store.read())
    assert merged and store.compact() == 7 and contents(store.read()) == wanted
    after = {r.run: r for r in store._runs().collect()}
    assert set(before) - merged == set(before) & set(after)
    new = [r for run, r in after.items() if run not in before]
    assert sum(r.shards for r in new) < sum(before[r].shards for r in merged)
    assert all(r.shards <= sum(before[x].n_bytes for x in merged) // 40_000 + 1 for r in new)
    assert contents(store.read(1)) == contents(docs)


def test_automaton_equals_greedy_matching():
    rng = random.Random(1)
    letters_ = "abc"
    for _ in range(30):
        pieces = {("▁" if rng.random() < 0.5 else "") + "".join(rng.choices(letters_, k=rng.randint(1, 4))) for _ in range(25)} | ({"▁"} if rng.random() < 0.3 else set())
        automaton = token_counts.Automaton(pieces)
        for _ in range(200):
            word = "".join(rng.choices(letters_, k=rng.randint(1, 12)))
            text, at, n = "▁" + word, 0, 0
            while at < len(text):
                end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
                if end is None:
                    n = 0
                    break
                n, at = n + 1, end
            assert automaton.count(word) == n, (word, sorted(pieces))


def test_token_counts_query_equals_greedy_matching(spark, sf):
    pieces = token_counts.pieces_of(token_counts.default_path())
    known, longest = set(pieces), max(map(len, pieces))
    memory = {}

    def greedy(word):
        if word not in memory:
            text, at, n = "▁" + word, 0, 0
            while at < len(text):
                end = next((e for e in range(min(len(text), at + longest), at, -1) if text[at:e] in known), None)
                if end is None:
                    n = 0
                    break
                n, at = n + 1, end
            memory[word] = n
        return memory[word]

    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.op7_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found = [greedy(w) for w in re.findall(SPACE_WORD, r.text or "")]
        assert got[r.doc_id] == (len(found), sum(n or 1 for n in found), found.count(0))


def test_token_counts_keep_clashing_columns(spark):
    df = spark.createDataFrame([("a b", 1, "x"), (None, 2, "y"), ("", 3, None)], "text string, _counts int, n_words string")
    got = token_counts.token_counts(df, ["▁a"]).collect()
    assert [(r._counts, r.n_words, r.n_tokens, r.n_unknown) for r in got] == [(1, 2, 2, 1), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_very_long_texts(spark):
    """Texts of 20,000 words and more through the operators that cut, window or score them."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    long = [rng.choice(words) for _ in range(20_000)]
    texts = [" ".join(long), "before " + " ".join(long[5_000:9_000]) + " after", " ".join(rng.choice(words) for _ in range(25_000)), "z" * 100_000, " ".join(["same"] * 20_000)]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect()}
    assert got == {0: (20_000, 0), 1: (4_002, 4_000), 2: (25_000, 0), 3: (1, 0), 4: (20_000, 0)}
    scored = {r.doc_id: r for r in lm.lm_scores(df).collect()}
    assert [scored[i].n_tokens for i in range(5)] == [20_001, 4_003, 25_001, 2, 20_001] and all(math.isfinite(r.score) for r in scored.values())
    assert {r.doc_id: r.class_id for r in similarity.similar(df).collect()} == {i: i for i in range(5)}
    assert {r.doc_id: r.n_chars for r in fingerprints.fingerprint(df).collect()} == {i: len(t) for i, t in enumerate(texts)}


def test_fingerprints_of_repeated_ids_and_hot_ranges(spark):
    """One id and no id for a third of all rows each: ranges are split by hash, and every row still has its next one."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " * (i % 5), "s") for i in range(120)]
    got = fingerprints.with_next(spark.createDataFrame([(i, t) for i, t, _ in rows], "k long, text string"), "k", ["text"]).collect()
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    ordered = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]), r[1]))
    expected = Counter((*a, b[1]) for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert Counter((r.k, r.text, r.next_text) for r in got) == expected


def test_work_folders_are_cleared(spark, tmp_path, monkeypatch):
    from tomeloom.llm import common

    monkeypatch.setattr(common, "_base", lambda spark: str(tmp_path))
    monkeypatch.setattr(common, "_made", [])
    out = substrings.remove_repeats(frame(spark, [(1, "a " * 60, "s"), (2, "a " * 60, "s")]))
    assert sorted(r.n_removed for r in out.collect()) == [0, 60] and list(tmp_path.iterdir())
    assert common.clear_work(spark) > 3 and not [p for p in tmp_path.iterdir() if p.is_dir()]


def test_own_work_folder_where_none_is_set(monkeypatch):
    from tomeloom.llm import common

    class Unset:
        class conf:
            get = staticmethod(lambda name, default: default)

    monkeypatch.setattr(common, "_own", [])
    assert common._base(Unset) == common._base(Unset) and "spark-work-" in common._base(Unset)


PAGE = """<html><head><title>t</title><script>x="<p>no</p>"</script></head><body><nav><ul><li>menu</li></ul></nav>
<div class="teaser">See {same}</div><article><h1>Title &amp; more {n}</h1><p>One <b>bold</b>\n text {n}<br>end<p>Two {n}</p>
<div class="comments"><p>reader</p></div><form><p>ask</p></form></article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    pages = [(i, f"https://Host.example/{i}", PAGE.format(same="our offers", n=i)) for i in range(12)]
    pages += [(20, None, None), (21, "x", ""), (22, "https://other.example/", "<p>a<p>b &lt;c&gt; <!-- no --> d"), (0, "https://Host.example/0", PAGE.format(same="our offers", n=0))]
    got = [(r.page_id, r.text) for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()]
    by = dict(got)
    assert len(got) == len(pages)
    assert all(by[i] == f"Title & more {i}\nOne bold text {i} end\nTwo {i}" for i in range(12))
    assert (by[20], by[21], by[22]) == ("", "", "a\nb <c> d")


def test_html_tree_decides_inside_articles(spark):
    page = "<body><footer>about {n}</footer><article><h1>Same title</h1><p>Text {n}</p><ul><li>Read our rules{few}</li></ul></article><div class=x>Buy now{few}</div></body>"
    pages = [(i, f"https://many.example/{i}", page.format(n=i, few="")) for i in range(30)] + [(50 + i, f"https://few.example/{i}", page.format(n=i, few=i)) for i in range(3)]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(by[i] == f"Same title\nText {i}" for i in range(30))
    assert all(by[50 + i] == f"Same title\nText {i}\nRead our rules{i}\nBuy now{i}" for i in range(3))


def test_html_tree_alone_tells_templates_from_texts(spark):
    """No name tells these blocks apart: only how their texts spread over the pages does."""
    rng = random.Random(8)
    tops, ends = [f"top {i} of all" for i in range(5)], [f"end {i} of all" for i in range(7)]
    texts = {i: [f"story {i} part {j} {rng.random()}" for j in range(3)] for i in range(150)}
    pages = [(i, f"https://h{i % 3}.example/{i}", f"<div class=k1>{rng.choice(tops)}</div><div class=k2><div>{'</div><div>'.join(texts[i])}</div></div><div class=k3>{rng.choice(ends)}</div>") for i in texts]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), names=False).collect()}
    assert by == {i: "\n".join(t) for i, t in texts.items()}


def test_html_tree_equals_brute_force(spark):
    rng = random.Random(2)
    pages = [(i, f"https://h{i % 2}.example/{i}", "".join(f"<div class={c}>{c} {rng.randint(0, n)}</div>" for c, n in (("p", 0), ("q", 2), ("r", 5), ("s", 99)))) for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").select("page_id", "url", "html", html.host_of(F.col("url")).alias("host"))
    parsed = df.mapInPandas(html._parsed(True), html.PARSED)
    counts = parsed.select("host", F.explode("nodes").alias("x")).select("host", "x.*").groupBy("host", "path", "value", "style").agg(F.count("*").alias("n"), F.count_if("first").alias("firsts"), F.max("kind").alias("kind"))
    got = {(r.host, r.path): (r.pages, r.tree) for r in html._spread(counts, ["host", "path"]).collect()}
    seen = {}
    for _, url, text in pages:
        for path, _, leaf in html.Page(text).blocks:
            seen.setdefault((url.split("/")[2], path), []).append(leaf)
    assert set(got) == set(seen)
    for key, leaves in seen.items():
        m, by = len(leaves), Counter(leaves)
        entropy = -sum(n / m * math.log(n / m) for n in by.values()) / math.log(m)
        assert got[key][0] == m and abs(got[key][1] - entropy) < 1e-9


def test_html_names_of_articles_stay():
    for label in ("search-algorithms", "promotions", "notice-period", "header-files", "main content", "shared-memory"):
        assert not html.names_no_content(label), label
    for label in ("ad", "site-footer", "mainNav", "x cookie-banner", "ad_slot_3", "comments", "related-posts", "sidebar-left"):
        assert html.names_no_content(label), label


def test_html_broken_and_very_long_pages():
    import time

    text = lambda h: [b[2] for b in html.Page(h).blocks if b[1] != html.NAMED]
    assert text("<p>a<svg viewBox='0 0 1 1'/>b</p><p>c</p>") == ["a", "b", "c"]
    assert text("<p>a<svg><path d='x'>inside<p>c") == ["a", "c"]
    assert text("<title>open<p>a</p>") == ["open", "a"] and text("<script>x<p>a") == []
    assert text("<p title='a>b'>c</p>") == ["c"] and text("<p title='a>c") == ["c"] and text("1 < 2 <3") == ["1 < 2 <3"]
    for broken in ("<a title=\"", "<p x='", "<div>", "<b", "<!-- ", "<svg>", "<title>", "<li></p>", "<center></p>", "<a x='' ", "&amp;", "<p>x</section>"):
        began = time.time()
        html.Page("<div>" + broken * (1_000_000 // len(broken)) + "<p>end")
        assert time.time() - began < 15, broken
    assert len(text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after")) == 2
    assert text("<article>" + "word " * 200_000)[0].count("word") == 200_000


def test_html_evidence_outvotes_names(spark):
    """A block named as a sidebar whose texts are new on every page stays; one of few wordings goes; readers' words always go."""
    page = "<body><div class=sidebar>Story {n} of {r}</div><div class=comments>Reader {n} says {r}</div><aside>Pick {few}</aside><footer>By {host}, {few}</footer></body>"
    rng = random.Random(4)
    pages = []
    for i in range(240):
        host = f"www.h{i % 3}.example"
        pages.append((i, f"https://{host}/{i}", page.format(n=i, r=rng.random(), few=rng.randint(0, 9), host=host)))
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(re.fullmatch(rf"Story {i} of [0-9.e-]+", text) for i, text in by.items()), by[0]


def test_html_containers_of_content():
    text = lambda h: [b[2] for b in html.Page(h).blocks if b[1] != html.NAMED]
    assert text("<form action=x><h1>Title</h1><p>Body</p><input value=v><label>l</label></form>") == ["Title", "Body"]
    assert text("<p>Body</p><form><p>ask</p></form>") == ["Body"]
    assert text("<form><article><p>Body</p></article><p>ask</p></form>") == ["Body"]
    assert text("<article><header><h1>Title</h1></header><p>Body</p><footer>end</footer></article><header>top</header>") == ["Title", "Body"]
    assert html.Page("<article><header><h1>Title</h1></header></article>").blocks[0][1] == html.HEADING
    assert html.masked("(c) www.a.b and a.b", "www.a.b") == html.masked("(c) c.d and c.d", "c.d")


def test_html_copies_count_once(spark):
    page = "<body><div class=menu2>Always</div><div class=text>Story {n}</div></body>"
    pages = [(i, f"https://h.example/{i}", page.format(n=max(0, i - 180))) for i in range(200)]
    by = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert by == {i: f"Story {max(0, i - 180)}" for i in range(200)}


def test_kneser_ney_equals_plain_counting():
    """The log-ratio of words by recursion over counts, for two classes of few words."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(20)]
    words = sorted(set(words))
    classes = [{w: rng.randint(0, 3) for w in words} for _ in range(2)]
    order = toxicity.ORDER
    model = toxicity.KneserNey(words, np.array([classes[0][w] for w in words]), np.array([classes[1][w] for w in words]))
    raw = [[Counter() for _ in range(order + 1)] for _ in range(2)]
    for c in (0, 1):
        for w, k in classes[c].items():
            marked = f"\x02{w}\x03"
            for n in range(1, order + 1):
                for end in range(max(1, n - 1), len(marked)):
                    raw[c][n][marked[end - n + 1 : end + 1]] += k
    seen = set().union(*[set(raw[c][n]) for c in (0, 1) for n in range(1, order + 1)])

    def counts(c, gram):
        n = len(gram)
        if n == order or gram[0] == "\x02":
            return raw[c][n][gram]
        return len({g for g in seen if len(g) == n + 1 and g[1:] == gram and raw[c][n + 1][g] > 0})

    tables = {n: sorted({g for g in seen if len(g) == n}) for n in range(1, order + 1)}
    shared = {n: n <= toxicity.SHARED for n in tables}
    of = lambda c, g: sum(counts(x, g) for x in (0, 1)) if shared[len(g)] else counts(c, g)
    discount = {}
    for n, grams in tables.items():
        pooled = [sum(counts(x, g) for x in (0, 1)) for g in grams]
        ones, twos = pooled.count(1), pooled.count(2)
        discount[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))

    def chance(c, gram):
        if not gram:
            return 1 / len(tables[1])
        with_context = [g for g in tables[len(gram)] if g[:-1] == gram[:-1]]
        total, kinds = sum(of(c, g) for g in with_context), sum(of(c, g) > 0 for g in with_context)
        if not total:
            return chance(c, gram[1:])
        d = discount[len(gram)]
        return max(of(c, gram) - d, 0) / total + d * kinds / total * chance(c, gram[1:])

    for w in words:
        marked = f"\x02{w}\x03"
        ratio = sum(math.log(chance(0, marked[max(0, i - order + 1) : i + 1]) / chance(1, marked[max(0, i - order + 1) : i + 1])) for i in range(1, len(marked)))
        assert abs(model.of_words([w])[0] - ratio) < 1e-3 + 1e-4 * abs(ratio), (w, model.of_words([w])[0], ratio)


def test_kneser_ney_prefers_toxic_words(spark):
    rng = random.Random(5)
    ordinary = ["".join(rng.choices(["an", "the", "or", "in", "re"], k=rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        words, toxic = rng.choices(ordinary, k=40), i % 4 == 0
        if toxic:
            for j in rng.sample(range(40), 5):
                words[j] = "zlurk" + rng.choice(["a", "en", "ish", "o"])
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    docs += [(1000, None, "s"), (1001, "", "s"), (1002, "zlurkum " * 3000, "s")]
    df = frame(spark, docs)
    detector = toxicity.fit(df, spark.createDataFrame(labels + [(7, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, detector).select("doc_id", "toxicity").collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert got[1002] > 0.5 and got[1000] == got[1001] < 0.5


def test_lm_counts_and_head_tail(spark, rows):
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    far = {r.doc_id: r for r in lm.lm_scores(docs, head_words=20).collect()}
    words = {i: lm.words_of((t or "").encode()) for i, t, _ in rows}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for i in train for w in words[i])
    total, room = sum(counts.values()) + len(train), sum(counts.values()) + len(train) + len(counts) + 2
    for i, ws in words.items():
        c = [*(counts[w] for w in ws), len(train)]
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(c), sum(x > 0 for x in c), total, i not in train)
        assert abs(r.base_score - sum(math.log10((x + 1) / room) for x in c)) < 1e-6
        assert r.score < 0 and abs(far[i].base_score - r.base_score) < 1e-6 and abs(far[i].score - r.score) < 1e-3


def lm_by_hand(model, text):
    """Log10 chance of a text by plain loops over the model's numbers."""
    encode = lm.Words(model.proto).model.encode
    p, theta, words = model.parameters, model.expected / model.expected.sum(0), lm.words_of(text.encode())
    tokens = [[lm.BEGIN], *[encode(w.decode()) for w in words], [lm.END]]
    rows = [np.mean([p["e"][model.row_of[i]] for i in ids], 0) for ids in tokens]
    total = 0.0
    for t in range(len(tokens) - 1):
        begin = max(0, (t // lm.BLOCK - 1) * lm.BLOCK)
        weights = [math.exp(rows[t][lm.Q] @ rows[j][lm.K] + p["r"][t - j, 0]) for j in range(begin, t + 1)]
        z = sum(w * rows[j][lm.V] for w, j in zip(weights, range(begin, t + 1), strict=True)) / sum(weights) + p["a"][:, 0]
        pi = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        first = tokens[t + 1][0]
        total += math.log10(float(pi @ theta[model.first_of[first]]))
        if first == lm.END:
            continue
        spelled, ids = 1.0, tokens[t + 1]
        for a, b in zip(ids, [*ids[1:], lm.END], strict=True):
            spelled *= math.exp(model.spelling.of(np.array([a]), np.array([b]))[0])
        n, count = model.begins[first], model.head.get(words[t], 0)
        inner = max(count - model.discount, 0) / n + model.discount * model.kinds[first] / n * spelled if n else spelled / model.spelling.size
        total += math.log10(inner)
    return total


def test_lm_score_equals_plain_loops(spark, rows):
    docs = frame(spark, rows)
    texts = docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) != 2").select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    model, tail = lm.fit(texts)
    assert tail.count() == 0
    wanted = [(i, False, t) for i, t, _ in rows if i % 4 == 0 and t] + [(900, True, "never seen Wörter w1"), (901, True, " ")]
    got = lm.score(spark.createDataFrame(wanted, "doc_id long, held_out boolean, text string").withColumn("text", F.col("text").cast("binary")), model, tail).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert abs(r.score - lm_by_hand(model, dict((i, t) for i, _, t in wanted)[r.doc_id])) < 1e-2 + 1e-5 * abs(r.score)


def test_lm_chances_sum_to_one(spark, rows):
    model, _ = lm.fit(spark.createDataFrame([(t.encode(),) for _, t, _ in rows if t], "text binary"))
    assert np.allclose(model.theta().sum(0), 1, atol=1e-4)
    every = np.arange(model.spelling.size)
    for a in np.flatnonzero(model.kinds)[:20]:
        assert abs(np.exp(model.spelling.of(np.full(len(every), a), every)).sum() - 1) < 1e-6
    words = lm.Words(model.proto)
    at, known = words.of(list(model.head)), Counter()
    for w, first in zip(model.head, words.ids.all()[words.start.all()[at]].tolist(), strict=True):
        known[first] += max(model.head[w] - model.discount, 0)
    for first, n in known.items():
        assert abs((n + model.discount * model.kinds[first]) / model.begins[first] - 1) < 1e-9


def test_lm_is_causal():
    rng = np.random.default_rng(0)
    p = {"e": rng.normal(0, 1, (50, 2 * lm.WIDTH + lm.COMPONENTS)).astype(np.float32), "r": rng.normal(0, 1, (2 * lm.BLOCK, 1)).astype(np.float32), "a": np.zeros((lm.COMPONENTS, 1), np.float32)}
    x = p["e"][rng.integers(0, 50, (5, lm.BLOCK))]
    first = np.array([True, False, False, True, False])
    before = lm.attend(p, x, first)[0]
    x[2, 7:] = 9.0
    after = lm.attend(p, x, first)[0]
    assert np.allclose(before[:2], after[:2]) and np.allclose(before[2, :7], after[2, :7]) and np.allclose(before[3:], after[3:]) and not np.allclose(before[2, 7:], after[2, 7:])


def test_lm_gradient_is_right():
    rng = np.random.default_rng(3)
    n = 2 * lm.WIDTH + lm.COMPONENTS
    start = {"e": rng.normal(0, 0.5, (12, n)), "r": rng.normal(0, 0.5, (2 * lm.BLOCK, 1)), "a": rng.normal(0, 0.5, (lm.COMPONENTS, 1))}
    start = {x: y.astype(np.float32) for x, y in start.items()}
    expected = rng.random((6, lm.COMPONENTS)).astype(np.float32)
    entries = [rng.integers(2, 10, 40).astype(np.int32), rng.integers(2, 10, 5).astype(np.int32)]
    rows, begin, length, firsts = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]), np.arange(10), np.array([1, 1, 2, 1, 3, 1, 1, 2, 1, 3]), rng.integers(0, 6, 10)
    inputs, targets, first = lm.laid_out(entries)

    def value(p):
        x = lm.word_rows(p["e"], rows, begin[inputs.ravel()], length[inputs.ravel()]).reshape(*inputs.shape, -1)
        return lm.first_chances(p, expected / expected.sum(0), x, targets, first, firsts).sum()

    p, squares = {x: y.copy() for x, y in start.items()}, {x: np.zeros(y.shape) for x, y in start.items()}
    lm.train_step(p, squares, expected.copy(), rows, begin, length, firsts, inputs, targets, first)
    for name, at in (("e", (3, 1)), ("e", (4, lm.WIDTH + 2)), ("e", (5, 2 * lm.WIDTH + 1)), ("r", (3, 0)), ("a", (2, 0))):
        gaps = []
        for step in (1e-2, -1e-2):
            moved = {x: y.copy() for x, y in start.items()}
            moved[name][at] += step
            gaps.append(value(moved))
        slope = (gaps[0] - gaps[1]) / 2e-2
        assert abs(np.sqrt(squares[name][at]) - abs(slope)) < 2e-2 * max(1, abs(slope)) and (p[name][at] > start[name][at]) == (slope > 0)


def test_lm_learns_what_goes_together(spark):
    rng = random.Random(6)
    kinds = [["the house and garden are green today", "with many small birds there"], ["der Garten ist heute sehr schön", "und viele kleine Vögel dort"]]
    texts = [" ".join(rng.choices(" ".join(kinds[i % 2]).split(), k=60)) for i in range(2000)]
    out = lm.lm_scores(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(2)).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_lm_attention_decides_frequent_words_wholly(spark):
    """Words that begin with the same subword id and stand in different texts: which of them comes is told by the context."""
    rng = random.Random(5)
    kinds = [["zlurkanda", "zlurkimo", "house", "garden", "green"], ["zlurkovel", "zlurkessa", "Vögel", "schön", "heute"]]
    texts = [" ".join(rng.choices(kinds[i % 2], k=60)).lower() for i in range(600)]
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").coalesce(1)
    wanted = spark.createDataFrame([(i, False, t.encode()) for i, t in enumerate([texts[0], texts[1], texts[0] + " never zlurkessan"])], "doc_id long, held_out boolean, text binary")
    parted, _ = lm.fit(rows, whole=0)
    encode = lm.Words(parted.proto).model.encode
    assert len({tuple(encode(w)[:1]) for kind in kinds for w in kind[:2]}) == 1 and all(len(encode(w)) > 1 for kind in kinds for w in kind[:2])
    model, tail = lm.fit(rows)
    encode = lm.Words(model.proto).model.encode
    assert len({encode(w)[0] for kind in kinds for w in map(str.lower, kind)}) == 10 and all(len(encode(w.lower())) == 1 for kind in kinds for w in kind)
    before = {r.doc_id: r.score for r in lm.score(wanted, parted, tail).collect()}
    for r in lm.score(wanted, model, tail).collect():
        text = [texts[0], texts[1], texts[0] + " never zlurkessan"][r.doc_id]
        assert abs(r.score - lm_by_hand(model, text)) < 1e-2 + 1e-5 * abs(r.score)
        assert r.doc_id == 2 or r.score > before[r.doc_id] + 2


def test_lm_lots_are_split_as_words_of_does():
    texts = [b"", None, b"  \t ", b" One\x0btwo\x0c THREE\n", "É é Übung\u00a0x".encode(), b"a\xff\xfeB c", b"z" * 50, b"one two"]
    lots = list(lm._lots(iter([pd.DataFrame({"text": texts[:5]}), pd.DataFrame({"text": texts[5:]}), pd.DataFrame({"text": []})])))
    got = [[lot.words[c] for c in part] for lot in lots for part in np.split(lot.code, np.cumsum(lot.counts)[:-1])]
    assert got == [lm.words_of(t) for t in texts]


def test_lm_remembers_the_words_seen_most(monkeypatch):
    """When a worker's words are too many, frequent ones are not put into subword ids again."""
    monkeypatch.setattr(lm, "MEMORY", 60)
    monkeypatch.setattr(lm, "KEPT", 30)
    words, asked, often = lm.Words(open(lm.default_path(), "rb").read()), Counter(), [b"often%d" % i for i in range(20)]
    encode = words.model.encode
    words.model = type("Counting", (), {"encode": staticmethod(lambda new, **how: asked.update(new) or encode(new, **how))})
    for k in range(30):
        new = often + [b"new%dx%d" % (k, i) for i in range(20)]
        at = words.of(new)
        for w, e in zip(new, at.tolist(), strict=True):
            begin = words.start.all()[e]
            assert words.ids.all()[begin : begin + words.length.all()[e]].tolist() == encode(w.decode())
        assert len(words.at) <= 60
    assert {asked[w.decode()] for w in often} == {1}


def test_lm_keeps_what_is_known_of_words_that_stay(monkeypatch):
    """When a worker's words are too many, those that stay are not put together again, and their rows are still theirs."""
    monkeypatch.setattr(lm, "MEMORY", 60)
    monkeypatch.setattr(lm, "KEPT", 30)
    proto, added = lm.Vocabulary(open(lm.default_path(), "rb").read()), []
    size = lm.Parts(proto).vocab_size()

    class Counting(lm.Trained):
        def _add(self, new, ids, length):
            added.extend(new)
            super()._add(new, ids, length)

    words, often = Counting(proto, np.arange(size) + 7, np.arange(size) + 5), [b"often%d" % i for i in range(20)]
    for k in range(30):
        asked = often + [b"new%dx%d" % (k, i) for i in range(20)]
        for w, e in zip(asked, words.of(asked).tolist(), strict=True):
            part, ids = slice(words.start.all()[e], words.start.all()[e] + words.length.all()[e]), words.model.encode(w.decode())
            assert words.rows.all()[part].tolist() == [i + 7 for i in ids] and words.firsts.all()[e] == ids[0] + 5
    assert max(Counter(added).values()) == 1


def test_lm_words_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(lm, "LOT", 20)
    monkeypatch.setattr(lm, "COUNTED", 12)
    rng = random.Random(2)
    texts = [None, b"", b" \t", b"a\xff\xfeB", *[" ".join(rng.choices("Ab cd EF gh ij kl mn op qr st uv".split(), k=rng.randint(0, 9))).encode() for _ in range(60)]]
    out = list(lm._count_words(iter([pa.RecordBatch.from_pydict({"text": pa.array(part, pa.binary())}) for part in (texts[:40], texts[40:], [])])))
    got = Counter()
    for batch in out:
        for w, c in zip(batch["w"].to_pylist(), batch["c"].to_pylist(), strict=True):
            got[w] += c
    assert len(out) > 1 and got == Counter([w for t in texts for w in lm.words_of(t)] + [b""] * len(texts))


def test_lm_steps_take_every_target_once():
    rng = random.Random(4)
    texts = [np.array([rng.randint(2, 9) for _ in range(k)], np.int32) for k in (0, 3, 9000, 15, 16, 700)]
    expected = [x for t in texts for x in zip([0, *t.tolist()], [*t.tolist(), 1], strict=True)]
    got, parted = [], 0
    for inputs, targets, first in lm.steps_of(*lm.laid_out(texts)):
        assert len(inputs) <= lm.STEP + 1 and first[0]
        parted += (targets[0] < 0).all()
        got += zip(inputs[targets >= 0].tolist(), targets[targets >= 0].tolist(), strict=True)
    assert got == expected and parted


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert mixing.mix(none).count() == similarity.similar(none).count() == fingerprints.fingerprint(none).count() == 0
    assert decontamination.decontaminate(none, no_items).count() == substrings.remove_repeats(none).count() == 0
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert lm.lm_scores(none).count() == token_counts.token_counts(none, ["▁a"]).count() == 0
    store, stored = sharding.shard(none)
    assert stored.count() == 0 and "text" in stored.columns
    assert toxicity.score(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_nulls_ties_and_repeated_rows(spark):
    text = " ".join(f"v{i}" for i in range(80))
    df = frame(spark, [(None, text, None), (None, None, None), (1, text, "a"), (1, text, "a"), (2, text, "a"), (2, text + " more", "b"), (3, "", None)])
    got = sorted((r.doc_id or -1, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 0), (-1, 80), (1, 0), (1, 0), (2, 80), (2, 80), (3, 0)]
    links = sorted((r.doc_id or -1, r.class_id or -1, r.copy_id or -1, r.n_links) for r in similarity.similar(df).collect())
    assert links == [(-1, -1, -1, 0), (-1, 1, 1, 4), (1, 1, 1, 4), (1, 1, 1, 4), (2, 1, 1, 4), (2, 1, 2, 4), (3, 3, 3, 0)]
    assert mixing.mix(df).count() == fingerprints.fingerprint(df).count() == lm.lm_scores(df).count() == 7
    hits = decontamination.decontaminate(df, spark.createDataFrame([("x", text)], "item_id string, text string")).collect()
    assert sorted(r.n_hit for r in hits) == [0, 0, 80, 80, 80, 80, 80]
    assert sharding.shard(df)[1].count() == 7


def test_many_rows_without_an_id(spark):
    """They are told apart by their texts: each loses what an id's row says too, none what only its like say, and the mix draws each for itself."""
    shared = [" ".join(f"s{g}x{i}" for i in range(70)) for g in range(3)]
    rows = [(1, shared[0], "a")] + [(None, " ".join([f"n{j}"] * 5) + " " + shared[j % 3], "a") for j in range(60)]
    df = frame(spark, rows)
    got = sorted((r.doc_id or -1, r.n_removed, r.kept.split()[0]) for r in substrings.remove_repeats(df).collect())
    assert got == sorted([(1, 0, "s0x0")] + [(-1, 70 if j % 3 == 0 else 0, f"n{j}") for j in range(60)])
    anchors = [r for r in df.select(F.coalesce("doc_id", F.lit(substrings.LAST)).alias("d"), "text").withColumn("t", F.xxhash64("text")).mapInPandas(substrings._anchors(50, 16), "a long, d long, t long").collect()]
    assert len({(r.d, r.t) for r in anchors}) == 61
    nulls = frame(spark, [(None, f"w{j} " * 4, "a") for j in range(400)] + [(7, "w " * 4000, "b")])
    drawn = [r.taken for r in mixing.mix(nulls, weights=(1.0, 6.0), share=1.0).collect() if r.doc_id is None]
    target = mixing.mix(nulls, weights=(1.0, 6.0), share=1.0).filter("doc_id is null").first().target
    assert 0 < sum(drawn) < 1600 and abs(sum(drawn) - target) <= 4 and set(drawn) == {0, 4}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, _turn string, _repeats string, _key_a string, hit string, class_id string, a string, key string"


def test_pipeline_stages_on_repeated_null_and_clashing(spark, sf):
    import corpus_pipeline

    one, two = " ".join(f"o{i}" for i in range(90)), " ".join(f"t{i}" for i in range(90))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, one, "a"), (1, two, "a"), (1, one, "a"), (None, one, None), (None, two + " end", "b"), (2, None, "b"), (2, "", "b"), (3, f"{two[:200]} {bench}", "a"), (3, "clean words only", "a"), (4, "x " * 20_000, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * 8) for i, t, s in rows], CLASHING)
    key = lambda df: sorted((str(r.doc_id), str(r.text)[:30], str(r.source)) for r in df.collect())
    of = lambda *at: sorted((str(rows[i][0]), str(rows[i][1])[:30], str(rows[i][2])) for i in at)
    kept = corpus_pipeline.one_of_each(spark, docs, sf)
    assert key(kept) == of(0, 1, 5, 6, 7, 8, 9) and kept.columns == docs.columns
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert key(clean) == of(0, 1, 2, 3, 4, 5, 6, 8, 9) and clean.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    sizes = Counter()
    for r in mixing.mix(docs).collect():
        sizes[str(r.doc_id), r["size"]] += r.repeats
    got = Counter((str(r.doc_id), len((r.text or "").split())) for r in mixed.collect())
    assert got == Counter({k: n for k, n in sizes.items() if n}) and mixed.columns == docs.columns
    stored = corpus_pipeline.shard(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in stored.collect()) == sorted(str(r[0]) for r in rows)
    ordinary = corpus_pipeline.drop_toxic(spark, docs, sf)
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")), column="p")
    assert key(ordinary) == key(scored.filter(F.col("p") < 0.5)) and ordinary.columns == docs.columns


def test_pipeline_runs_as_its_stages_say(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    detector = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.toxicity for r in toxicity.score(docs, detector).select("doc_id", "toxicity").collect()}
    ordinary = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert {r.doc_id for r in ordinary.collect()} == {i for i, x in scores.items() if x < corpus_pipeline.TOXIC}
    kept = {r.class_id for r in similarity.similar(ordinary).collect()}
    clean = {r.doc_id for r in decontamination.decontaminate(ordinary.filter(F.col("doc_id").isin(list(kept))), spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if not r.n_hit}
    taken = {r.doc_id: r.repeats for r in mixing.mix(docs.filter(F.col("doc_id").isin(list(clean)))).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.one_of_each(spark, docs, sf)
    classes = similarity.similar(docs).select("class_id").distinct().count()
    assert kept.count() == classes and kept.columns == docs.columns
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf)
    bench = [letters(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(ws[p : p + min(10, len(ws))]) for ws in bench for p in range(len(ws) - min(10, len(ws)) + 1) if ws}
    sizes = {len(w) for w in windows}
    expected = {r.doc_id for r in docs.collect() if not any(tuple(ws[p : p + n]) in windows for ws in [letters(r.text)] for n in sizes for p in range(len(ws) - n + 1))}
    assert {r.doc_id for r in clean.collect()} == expected and clean.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.repeats for r in mixing.mix(docs).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
