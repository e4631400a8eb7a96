"""Literal-row tests of the analyzers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from crawlloom.functions import html
from crawlloom.functions import text as tx
from crawlloom.operators import content, graph, issues, logs, pages, scoring, similarity
from crawlloom.plans import audit, derived
from crawlloom.sources import importers, readers, sinks


def one(spark, value, schema="c string"):
    return spark.createDataFrame([(value,)], schema)


@pytest.mark.parametrize("value, want", [("=SUM(A1)", "'=SUM(A1)"), ("normal", "normal"), ("-1", "'-1"), (None, None)])
def test_formula(spark, value, want):
    assert one(spark, value).select(tx.formula_safe("c")).first()[0] == want


@pytest.mark.parametrize("value, want", [(119.6, "2m 0s"), (5.25, "5.2s"), (3700.0, "1h 1m 40s"), (119.9, "2m 0s"), (0.0, "0.0s"), (None, None)])
def test_duration(spark, value, want):
    got = one(spark, value, "c double").select(tx.format_duration("c")).first()[0]
    assert got == want


def test_status_of(spark):
    df = spark.createDataFrame([("301 Moved",), ("  200 ",), (None,), ("x",)], "c string")
    assert [r[0] for r in df.select(pages.status_of("c")).collect()] == [301, 200, 0, 0]


def test_fingerprint():
    a = "the quick brown fox jumps over the lazy dog and runs far away into the green woods".split()
    near, far = tx.fingerprint(" ".join(a)), tx.fingerprint(" ".join(a + ["today"]))
    other = tx.fingerprint("prices of copper rose again on friday as traders in london bought futures for the next quarter")
    assert tx.fingerprint("too short") is None
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert bits(near, far) < bits(near, other)


def test_near_duplicates_against_all_pairs(spark):
    base = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split() for _ in range(1)][0]
    docs = [(1, " ".join(base * 6)), (2, " ".join(base * 6)), (3, " ".join(base * 6 + ["extra"])), (4, "x " * 3), (5, None), (6, " ".join(base[::-1] * 6))]
    pairs, members = similarity.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", distance=8, bands=4)
    prints = {i: tx.fingerprint(t) for i, t in docs if tx.fingerprint(t) is not None}
    cls = {i: min(j for j in prints if prints[j] == prints[i]) for i in prints}
    assert {r.doc_id: r.class_id for r in members.collect()} == cls
    reps = sorted(set(cls.values()))
    want = {(a, b) for a in reps for b in reps if a < b and bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 8}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == want
    assert similarity.band_count(4, 3) == 4 and similarity.band_count(3, 3) == 4 and similarity.band_count(4, 5) == 8


def test_near_duplicates_broadcast_no_keys(spark):
    text = " ".join(f"word{i % 97} of{i % 89} many{i % 83}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text of twelve words that has nothing to share here")], "doc_id long, text string")
    pairs = similarity.near_duplicates(docs, "doc_id", "text")[0]
    before = pairs._jdf.queryExecution().executedPlan().toString()
    assert [(r.class_a, r.class_b) for r in pairs.collect()] == [(1, 2)]
    for plan in (before, pairs._jdf.queryExecution().executedPlan().toString()):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprint_by_definition(monkeypatch):
    """Bit by bit from the hashes of all shingles, also when kept hashes are forgotten on the way."""

    def slow(t, least=10, size=3):
        w = tx._WORD.findall(t.lower()) if t else []
        if len(w) < least:
            return None
        h = [int.from_bytes(hashlib.md5(" ".join(w[i : i + size]).encode("utf-8", "surrogatepass")).digest()[8:], "big") for i in range(len(w) - size + 1)]
        f = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        return f - (1 << 64) if f >> 63 else f

    texts = [None, "", "a " * 9, "a " * 10, "İstanbul ß ﬁ " * 9, "مَرحبا، بالعالم " * 8, "\ud800 x " * 7, " ".join(f"w{i * i % 31}" for i in range(500)), " ".join(map(str, range(300)))]
    for most in (1, 7, 1 << 17):
        monkeypatch.setattr(tx._LowHalves, "MOST", most)
        tx._low.clear()
        for t in texts * 2:
            assert tx.fingerprint(t) == slow(t)
        assert len(tx._low) <= most
    assert tx.fingerprint("a b", 1, 3) == slow("a b", 1, 3) and tx.fingerprint("a b c d", 2, 2) == slow("a b c d", 2, 2)


def test_pagerank_conserves_mass(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "url string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "zz")], "src string, dst string")
    got = {r.url: r for r in graph.link_score(nodes, edges).collect()}
    assert abs(sum(r.raw for r in got.values()) - 1) < 1e-6
    assert got["a"].out_degree == 1 and got["d"].in_degree == 0 and max(r.score for r in got.values()) == 100.0


def test_redirects_out_of_order(spark):
    rows = [("b", "c", 302, "a"), ("a", "b", 301, "a"), ("x", "y", 301, "x"), ("l", "m", 301, "l"), ("m", "l", 301, "l")]
    got = {r.original_url: r for r in graph.redirect_chains(spark.createDataFrame(rows, "from_url string, to_url string, status_code int, original_url string")).collect()}
    assert got["a"].chain == "a > b > c" and got["a"].is_chain and not got["a"].is_loop and got["a"].n_temporary == 1
    assert not got["x"].is_chain and got["l"].is_loop


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    got = {r.url: r.depth for r in graph.reachable(edges, spark.createDataFrame([("a",)], "url string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_reachable_follows_long_chains(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n20", "n0")], "src string, dst string")
    got = {r.url: r.depth for r in graph.reachable(edges, spark.createDataFrame([("n0",)], "url string")).collect()}
    assert got == {f"n{i}": i for i in range(21)}


def test_canonicals(spark):
    rows = [("https://e.com/a", 200, True, "https://e.com/b"), ("https://e.com/b", 200, True, "https://e.com/a"), ("https://e.com/c", 200, True, ""), ("https://e.com/d", 404, False, "https://e.com/d"), ("https://e.com/f", 200, True, "https://o.org/")]
    got = {(r.url[-1], r.issue) for r in pages.canonical_audit(spark.createDataFrame(rows, "url string, status_code int, is_indexable boolean, canonical string")).collect()}
    assert got == {("a", "canonicalised"), ("b", "canonicalised"), ("a", "loop"), ("b", "loop"), ("c", "missing"), ("d", "to_non_200"), ("f", "canonicalised"), ("f", "external")}


def test_thin_zero_is_thin(spark):
    rows = [("a", 0, 50.0), ("b", 50, 50.0), ("c", 299, 5.0), ("d", 900, 50.0)]
    df = spark.createDataFrame([(*r, 200, "text/html", None) for r in rows], "url string, word_count int, text_to_html_ratio double, status_code int, content_type string, crawl_error string")
    assert {r.url: (r["class"], r.is_low_ratio) for r in pages.thin_content(df).collect()} == {"a": ("thin", False), "b": ("critical", False), "c": ("thin", True)}


def test_schema_states(spark):
    rows = [("u", "Product", '{"name":"n","image":""}'), ("u", "Person,Thing", '{"name":"n","image":"i","url":"u","jobTitle":"j","sameAs":["x"]}'), ("u", "Odd", "{}")]
    got = {r.type: (r.state, r.missing) for r in content.schema_audit(spark.createDataFrame(rows, "page_url string, type string, raw_data string")).collect()}
    assert got == {"Product": ("invalid", "image"), "Person": ("eligible", ""), "Odd": ("unknown", "")}


def test_hreflang(spark):
    tags = spark.createDataFrame([("a", "en", "a"), ("a", "fr_fr", "b"), ("a", "x-default", "a"), ("b", "zz-bad-code", "b")], "url string, hreflang string, href string")
    crawled = spark.createDataFrame([("a", 200, True, "en"), ("b", 200, False, "fr")], "url string, status_code int, is_indexable boolean, language string")
    got = {(r.url, r.issue) for r in content.hreflang_audit(tags, crawled).collect()}
    assert {("a", "no_return"), ("a", "to_noindex"), ("b", "missing_x_default"), ("b", "invalid_code")} <= got and ("a", "missing_x_default") not in got


def test_log_lines(spark):
    lines = [('1.1.1.1 - - [10/Jan/2025:10:00:00 +0000] "GET /a?x=1 HTTP/1.1" 200 5 "-" "Googlebot/2.1"',), ('1.1.1.1 - - [10/Jan/2025:09:00:00 +0000] "GET /a HTTP/1.1" 200 - "-" "Mozilla"',), ('1.1.1.1 - - [11/Jan/2025:10:00:00 +0000] "GET /missing HTTP/1.1" 404 5',), ("garbage",)]
    got = {r.path: r for r in logs.budget(logs.parsed(spark.createDataFrame(lines, "value string"))).collect()}
    assert got["/a"].hits == 2 and got["/a"].googlebot_hits == 1 and got["/a"].last_seen.startswith("10/Jan/2025:10") and got["/missing"].n_404 == 1 and len(got) == 2


def test_stream_equals_batch(spark, tmp_path):
    from crawlloom.streaming.logs import log_lines, running_budget

    folder = tmp_path / "logs"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.log").write_text("\n".join(f'1.1.1.{i} - - [1{k}/Jan/2025:10:00:0{i} +0000] "GET /p{i % 3} HTTP/1.1" {(200, 404)[i % 2]} 5 "-" "bingbot"' for i in range(9)))
    q = running_budget(log_lines(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("budget").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = logs.budget(logs.parsed(spark.read.text(str(folder))))
    assert sorted(map(tuple, spark.table("budget").collect())) == sorted(map(tuple, batch.collect()))


def test_priority(spark):
    schema = "url string, depth int, internal_links_count int, clicks long, impressions long, sessions long, engagement_rate double, issues array<string>"
    rows = [("https://e.com/", 0, 10, 50, 1000, 20, 50.0, ["broken"]), ("https://e.com/products/x", 3, 0, 0, 0, 0, 0.0, ["missing_title", "thin"]), ("https://e.com/z", 1, 0, 0, 0, 0, 0.0, [])]
    got = {r.url: r for r in scoring.priorities(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 2 and got["https://e.com/"].priority_band == "high" and got["https://e.com/"].action_group == "needs_developer" and got["https://e.com/products/x"].page_type == "product"
    assert got["https://e.com/products/x"].top_fix == "missing_title"


def test_issue_rules_and_health(spark):
    assert len(issues.RULES) == 33
    found = spark.createDataFrame([("Missing Title", "critical", "On-Page", 2)], "issue_type string, severity string, category string, affected_count long")
    assert issues.health(found, 100).first().score == 100 and issues.with_hints(found).first().hint_score == 3.0
    old = found.unionAll(spark.createDataFrame([("Gone", "low", "Content", 1)], found.schema))
    assert {r.issue_type: r.state for r in issues.compare_issues(old, found).collect()} == {"Missing Title": "persisting", "Gone": "fixed"}


def test_html_page(spark):
    page = '<html><head><title>A &amp; B</title><meta name="description" content="d"><link rel="canonical" href="/c?utm_source=x"><link rel="alternate" hreflang="de" href="/de"></head><body><nav><a href="/n">N</a></nav><h1>H</h1><h3></h3><script>"</p>"</script><p>x<p>y<a href="/i" rel="nofollow"><img src="http://o.org/a.png?x" alt=""></a><script type="application/ld+json">{"@graph":[{"@type":["A","B"]}]}</script></body></html>'
    x = html.extract(spark.createDataFrame([(1, "https://e.com/p", page), (2, "https://e.com/q", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    a = x[0]
    assert a.title == "A & B" and a.canonical == "https://e.com/c" and a.n_paragraphs == 2 and [h.text for h in a.headings] == ["H"] and a.hreflang[0].href == "https://e.com/de"
    assert a.links[0].in_navigation and a.links[1].nofollow and a.links[1].is_image and a.images[0].extension == "png" and a.mixed[0].severity == "passive" and a.schema[0].type == "A,B"
    assert x[1].links == [] and x[1].title is None


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "i.xml").write_text(f'<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>{tmp_path}/a.xml</loc></sitemap></sitemapindex>')
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.com/1</loc><priority>x</priority></url><url><loc> https://e.com/2 </loc><priority>0.5</priority></url></urlset>')
    assert {(r.url, r.priority) for r in readers.sitemap(spark, f"{tmp_path}/i.xml").collect()} == {("https://e.com/1", None), ("https://e.com/2", 0.5)}
    allowed = spark.createDataFrame([("https://e.com/a/x",), ("https://e.com/b",)], "u string").select(readers.can_fetch("User-agent: *\nDisallow: /a\nCrawl-delay: 2", F.col("u")))
    assert [r[0] for r in allowed.collect()] == [False, True] and readers.crawl_delay("User-agent: *\nCrawl-delay: 2") == 2.0
    df = spark.createDataFrame([("=1", ["a"], 1)], "a string, b array<string>, c int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = readers.exported_csv(spark, str(tmp_path / "csv")).first()
    assert back.a == "'=1" and back.b == '["a"]'
    old = spark.createDataFrame([("k", 1, "old"), ("j", 1, "j")], "k string, t int, v string")
    new = spark.createDataFrame([("k", 1, "new")], "k string, t int, v string")
    assert {r.k: r.v for r in sinks.upsert(old, new, "k", "t").collect()} == {"k": "new", "j": "j"}
    entries = spark.createDataFrame([(f"https://e.com/{i:03d}", None) for i in range(25)], "loc string, lastmod string")
    sizes = {r.file: r["count"] for r in sinks.numbered(entries, 10, 3).groupBy("file").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}


def test_importers(spark):
    payload = '{"lighthouseResult":{"categories":{"performance":{"score":0.915}},"audits":{"a":{"title":"A","score":0.5,"scoreDisplayMode":"numeric"},"b":{"score":null,"scoreDisplayMode":"informative"},"script-treemap-data":{"details":{"nodes":[{"name":"x.js","resourceBytes":300,"unusedBytes":100},{"name":"y","resourceBytes":0}]}}}}}'
    raw = spark.createDataFrame([("u", payload)], "url string, payload string")
    assert importers.speed_metrics(raw).first().performance == 92
    assert [r.audit_id for r in importers.failed_audits(raw).collect()] == ["a"]
    assert [r.unused_pct for r in importers.script_treemap(raw).collect()] == [33.3, 0.0]


def test_headers_rules_and_indexability(spark):
    df = spark.createDataFrame([({"CF-Ray": "7", "Feature-Policy": "x", "X-Robots-Tag": "NoIndex"},)], "h map<string,string>").select(*html.headers("h"))
    r = df.first()
    assert r.cdn == "CloudFlare" and r.permissions_policy == "x" and r.header_noindex and not r.hsts_enabled
    page = spark.createDataFrame([('<div id="a"><p class="x y">One</p><p class="x">Two <b>2</b></p></div><p class="x">out</p><img src="i.png"> PRICE: 5 wp-content/',)], "h string")
    got = page.select(html.custom_css("h", "#a .x", every=True).alias("a"), html.custom_css("h", "img", "src").alias("b"), html.custom_css("h", "a > b").alias("c"), *html.custom_regex("h", {"p": (r"price: (\d)", 1), "bad": ("(", 0)}), html.platform("h").alias("pf")).first()
    assert got.a == "One | Two 2" and got.b == "i.png" and got.c == "" and got.p == "5" and got.pf == "wordpress" and "bad" not in got
    s = spark.createDataFrame([(200, "noindex", "", "u"), (404, "", "", "u"), (200, "", "v", "u"), (200, None, "u", "u")], "s int, r string, c string, u string")
    got = [tuple(r[0]) for r in s.select(html.indexability(F.col("s"), F.col("r"), F.col("c"), F.col("u"))).collect()]
    assert got == [(False, "Noindex directive"), (False, "Non-200 status: 404"), (True, "Canonicalised"), (True, "Indexable")]


def test_derived_inputs_cover_every_page(spark, small):
    pages_ = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url").collect()
    urls_ = sorted(r.url for r in pages_)
    assert sorted(r.url for r in derived.speed_metrics(spark, small).collect()) == urls_
    assert sorted(r.url for r in derived.lighthouse_failed(spark, small).collect()) == urls_
    assert sum(r.n for r in derived.schema_validation(spark, small).collect()) == len(urls_)
    assert {r.original_url for r in audit.redirect_chains(spark, small).collect()} == {f"https://r.example/{r.page_id}" for r in pages_}


def power_iteration(nodes, edges, rounds=30, d=0.85):
    """Ranks as the definition has them: round by round, with the mass of dead ends spread."""
    inside = {(a, b) for a, b in edges if a != b and a in nodes and b in nodes}
    out = {u: [b for a, b in inside if a == u] for u in nodes}
    pr = {u: 1 / len(nodes) for u in nodes}
    for _ in range(rounds):
        lost = sum(pr[u] for u in nodes if not out[u])
        new = {u: (1 - d) / len(nodes) + d * lost / len(nodes) for u in nodes}
        for u in nodes:
            for b in out[u]:
                new[b] += d * pr[u] / len(out[u])
        pr = new
    return pr


@pytest.mark.parametrize("hot", [False, True])
def test_link_score_is_power_iteration(spark, monkeypatch, hot):
    import random

    if hot:  # count as hot what would be small, so that the part apart is used
        real = graph.hot_keys
        monkeypatch.setattr(graph, "hot_keys", lambda df, keys: real(df, keys, fraction=0.1, least=5))
    r = random.Random(4)
    nodes = [f"n{i}" for i in range(40)]
    edges = [(r.choice(nodes[:25]), r.choice([*nodes, "outside"])) for _ in range(160)] + [("n0", x) for x in nodes] * 2
    want = power_iteration(nodes, edges)
    got = graph.link_score(spark.createDataFrame([(x,) for x in nodes], "url string"), spark.createDataFrame(edges, "src string, dst string"))
    assert all(abs(x.raw - want[x.url]) < 1e-7 for x in got.collect())


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_exports_in_any_encoding(spark, tmp_path, encoding):
    rows = "\n".join(f"https://e.example/{i},Größe – “café” {i}" for i in range(300))
    (tmp_path / "keywords.csv").write_bytes((" URL ,Keyword\n" + rows + "\n").encode(encoding))
    got = readers.exported(spark, str(tmp_path), "keywords")
    assert got.columns == ["URL", "Keyword"] and got.count() == 300 and got.where("Keyword = 'Größe – “café” 299'").count() == 1
    assert readers.exported(spark, str(tmp_path), "backlinks") is None


def test_empty_csv_and_metrics(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([], "a string, b int"), str(tmp_path / "none"))
    assert readers.exported_csv(spark, str(tmp_path / "none")).columns == ["no_data"]
    from crawlloom.operators import detail

    events = spark.createDataFrame([(1, "counter", "pages", 2.0), (2, "counter", "pages", 3.0), (3, "gauge", "queue", 7.0), (4, "gauge", "queue", 5.0), (5, "timing", "fetch", 10.0), (6, "timing", "fetch", 20.0), (7, "event", "stop", 1.0)], "at long, kind string, name string, value double")
    sinks.write_metrics(detail.metrics_snapshot(events), str(tmp_path / "metrics"))
    import json

    m = json.loads(spark.read.text(str(tmp_path / "metrics")).first()[0])
    assert m["counters"] == {"pages": 5.0} and m["gauges"] == {"queue": 5.0} and m["recent_events"][0]["name"] == "stop"
    assert m["timings"]["fetch"] == {"count": 2, "total_ms": 30.0, "avg_ms": 15.0, "min_ms": 10.0, "max_ms": 20.0}


def test_progress_is_throttled(spark, tmp_path):
    from types import SimpleNamespace

    from crawlloom.streaming.logs import Progress, log_lines

    told, at = [], [0.0]
    p = Progress(told.append, clock=lambda: at[0])
    event = SimpleNamespace(progress=SimpleNamespace(id="q", batchId=0, numInputRows=5, processedRowsPerSecond=1.0))
    for t in (0.0, 0.1, 0.3):
        at[0] = t
        p.onQueryProgress(event)
    assert len(told) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("x\n")
    seen = []
    listener = Progress(seen.append, every=0.0)
    spark.streams.addListener(listener)
    try:
        log_lines(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(50):
            if any(x["status"] == "finished" for x in seen):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {"started", "running", "finished"} <= {x["status"] for x in seen}


def test_registry_modes(spark, small):
    from crawlloom import registry

    t = {"pages": audit.now(spark, small)}
    assert set(registry.run("compare", t)) == set(registry.MODES["compare"]) and "images" not in registry.MODES["compare"]


def test_important_log_lines(spark):
    rows = [(i, f"t | {('INFO', 'ERROR')[i % 2]} | m{i}") for i in range(60)] + [(60, "Traceback (most recent call last):")]
    got = logs.important_lines(spark.createDataFrame(rows, "at long, value string")).collect()
    assert len(got) == 20 and got[-1].at == 60 and got[0].at == 23


def test_split_and_upper_network_rules(spark):
    h = spark.createDataFrame([({"x-served-by": "cache-fastly"},), ({"X-Served-By": "cache-lon"},), ({"X-Sucuri-Id": "1", "x-vercel-id": "2"},), (None,)], "h map<string,string>")
    assert [r.cdn for r in h.select(*html.headers("h")).collect()] == ["Fastly", "", "Sucuri", ""]
