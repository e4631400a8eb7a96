"""p4, p5, p6 against brute force: nulls, ties, repeated rows, empty tables, clashing names, hot keys."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from crawlloom.operators.hierarchy import descendants, hierarchy
from crawlloom.operators.hotkeys import target_stats
from crawlloom.operators.orphans import orphan_cascade, orphan_report

T0 = datetime(2025, 1, 1)
PAGES = "page_id long, run_id int, url string, canonical string, crawled_at timestamp, ingested_at timestamp, removed_at timestamp, ref string"
LINKS = "id long, run_id int, from_url string, to_url string, to_url_normalized string, is_internal boolean, is_special_link boolean, loaded_at timestamp, kind string"
CHILD = "id long, run_id int, page_url string, loaded_at timestamp, level int"


def day(n):
    return T0 + timedelta(days=n) if n is not None else None


def world(seed, n=60):
    r = random.Random(seed)
    u = [f"https://e.com/{i}" for i in range(12)]
    some = lambda *x: r.choice([*u, *x])
    pages = [(i, 0, some(None), some(None, "", "https://gone.com/"), day(r.randrange(9)), day(r.choice([None, *range(9)])), day(r.choice([None, None, None, *range(9)])), "x") for i in range(n)]
    links = [(i, r.randrange(2), some(None, "https://no.com/"), some("https://E.com:443/3", None), some(None, None, "https://no.com/"), r.choice([True, True, None, False]), r.choice([False, False, True, None]), day(r.choice([None, *range(9)])), "x") for i in range(4 * n)]
    child = [(i, 0, some(None, "https://no.com/"), day(r.randrange(9)), 1) for i in range(n)]
    return pages, links, child


def expected_direct(pages, links, heads, imgs):
    def live(u, t):
        return t is not None and any(p[2] == u and p[5] is not None and p[5] <= t and (p[6] is None or p[6] > t) for p in pages)

    from crawlloom.functions.urls import normal_form

    out = []
    for x in links:
        if x[2] is not None and not live(x[2], x[7]):
            out.append(("links", x[0], "from_url"))
        ref = x[4] if x[4] is not None else normal_form(x[3])
        if x[5] and not x[6] and ref is not None and not live(ref, x[7]):
            out.append(("links", x[0], "to_url_normalized"))
    for name, rows in (("headings", heads), ("images", imgs)):
        out += [(name, x[0], "page_url") for x in rows if x[2] is not None and not live(x[2], x[3])]
    return Counter(out)


def test_direct_orphans_match_brute_force(spark):
    for seed in (1, 2):
        pages, links, child = world(seed)
        got = orphan_cascade(*[spark.createDataFrame(r, s) for r, s in ((pages, PAGES), (links, LINKS), (child, CHILD), (child, CHILD))])
        rows = Counter((r.table_name, r.record_id, r.ref_field) for r in got.where("kind = 'direct' and table_name <> 'pages'").collect())
        assert rows == expected_direct(pages, links, child, child)


def test_inherited_levels(spark):
    pages = [(i, 0, f"https://e.com/{i}", f"https://e.com/{i + 1}", day(0), day(0), None, "x") for i in range(4)]  # 3 -> missing 4
    heads = [(1, 0, "https://e.com/0", day(1), 1)]
    e = lambda s: spark.createDataFrame([], s)
    got = orphan_cascade(spark.createDataFrame(pages, PAGES), e(LINKS), spark.createDataFrame(heads, CHILD), e(CHILD))
    rows = {(r.table_name, r.record_id): (r.kind, r.level) for r in got.collect()}
    assert rows == {("pages", 3): ("direct", 1), ("pages", 2): ("inherited", 2), ("pages", 1): ("inherited", 3), ("pages", 0): ("inherited", 4), ("headings", 1): ("inherited", 4)}
    report = orphan_report(spark.createDataFrame(pages, PAGES), e(LINKS), spark.createDataFrame(heads, CHILD), e(CHILD)).collect()
    assert {(r.table_name, r.n_refs, r.n_direct, r.n_inherited) for r in report} == {("pages", 4, 1, 3), ("headings", 1, 0, 1)}


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert orphan_cascade(e(PAGES), e(LINKS), e(CHILD), e(CHILD)).count() == 0
    assert hierarchy(e("url string, parent string")).count() == 0
    assert target_stats(e("to_url string, from_url string, in_navigation boolean"), e("url string, status_code int, crawled_at timestamp, page_id long")).count() == 0


def walk(parent, u):
    seen, path = {u}, []
    x = u
    while parent.get(x) is not None:
        x = parent[x]
        if x in seen:
            return None, -1, []
        seen.add(x)
        path.append(x)
    return x, len(path), path


def test_hierarchy_matches_walk(spark):
    for seed, size in ((1, 5), (2, 1000), (3, 20)):
        r = random.Random(seed)
        parent = {f"n{i:04d}": (None if r.random() < 0.1 else f"n{r.randrange(300):04d}" if r.random() < 0.05 else f"n{max(0, i - r.randrange(1, 9)):04d}") for i in range(260)}
        parent = {k: (None if v == k else v) for k, v in parent.items()}
        parent |= {"hot%03d" % i: "n0001" for i in range(90)}
        solved = hierarchy(spark.createDataFrame(list(parent.items()), "url string, parent string"), True, nodes_per_task=size)
        got = {x.node: (x.root, x.depth, list(x.path)) for x in solved.collect()}
        assert set(got) == set(parent)
        for u in parent:
            root, depth, path = walk(parent, u)
            assert got[u] == ((root, depth, path) if parent[u] is not None else (u, 0, [])), u
        pairs = Counter((x.url, x.descendant, x.distance) for x in descendants(solved).collect())
        assert pairs == Counter((a, u, i + 1) for u in parent for i, a in enumerate(walk(parent, u)[2]))


@pytest.mark.parametrize("seed, size", [(1, 2), (2, 7), (3, 28), (4, 50), (5, 28), (6, 400)])
def test_cycles_across_ranges(spark, seed, size):
    """Functional graphs full of cycles, in names that range partitions cut anyhow."""
    r = random.Random(seed)
    parent = {"z1": "z2", "z2": "z1"} | {f"m{i:02d}": "z1" for i in range(40)} | {f"a{i:02d}": r.choice([f"m{i:02d}", "z1", "m00"]) for i in range(40)}
    for g in range(12):
        names = [f"{r.choice('abmyz')}{g}-{i}" for i in range(20)]
        parent |= {x: r.choice([*names, *names, f"out{g}", None]) for x in names}
    parent = {k: (None if v == k else v) for k, v in parent.items()}
    solved = hierarchy(spark.createDataFrame(list(parent.items()), "url string, parent string"), seed % 2 == 0, nodes_per_task=size)
    got = {x.node: (x.root, x.depth, list(x.path)) for x in solved.collect()}
    assert set(got) == set(parent)
    for u in parent:
        root, depth, path = walk(parent, u)
        want = (root, depth, path if seed % 2 == 0 else []) if parent[u] is not None else (u, 0, [])
        assert got[u] == want, u


def test_worst_case_chain_doubles(spark):
    n = 64
    order = list(range(n))
    random.Random(5).shuffle(order)
    parent = {f"x{order[i]:03d}": (f"x{order[i + 1]:03d}" if i + 1 < n else None) for i in range(n)}
    solved = hierarchy(spark.createDataFrame(list(parent.items()), "url string, parent string"), True, nodes_per_task=4)
    assert {x.node: x.depth for x in solved.collect()} == {u: walk(parent, u)[1] for u in parent}


def test_target_stats_match_brute_force(spark):
    r = random.Random(7)
    rows = [(r.choice(["hot"] * 6 + [None, "a", "b", "c"]), r.choice([None, *map(str, range(40))]), r.choice([True, False, None]), 1) for _ in range(3000)]
    pages = [("hot", 200, T0, 1, "x"), ("hot", 404, T0, 2, "x"), ("a", 301, T0, 3, "x")]
    got = target_stats(spark.createDataFrame(rows, "to_url string, from_url string, in_navigation boolean, k1 int"), spark.createDataFrame(pages, "url string, status_code int, crawled_at timestamp, page_id long, _shard string"), tasks=5)
    want = {}
    for t in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == t]
        want[t] = (len(own), sum(bool(x[2]) for x in own), len({x[1] for x in own if x[1] is not None}), {"hot": 404, "a": 301}.get(t), 3000)
    assert {x.to_url: (x.n_links, x.n_nav_links, x.n_sources, x.target_status, x.n_rows) for x in got.collect()} == want
