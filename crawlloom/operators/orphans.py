"""References to records that do not exist (p4).

Method: a fixpoint cascade down the foreign-key graph. Level 1 has the references whose
target isn't live when the referring row is loaded. Pages whose parent reference is an
orphan are orphaned themselves; everything that refers to an orphaned page inherits, level
by level, until a round adds nothing.

Shape at scale: addresses shuffle as 96-bit keys; page rows are combined to the spans in
which an address was live before they meet the far larger references; the few addresses
that hold large shares of the references are split and only their spans repeated.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.functions.urls import normal_form_udf
from crawlloom.session import stage
from crawlloom.skew import hot_keys, repeat, salted, split, url_key

KEYS = ["k1", "k2"]
FOREVER = "timestamp'9999-12-31 00:00:00'"
#: Fields in their order of ``field`` numbers.
FIELDS = (("links", "from_url"), ("links", "to_url_normalized"), ("headings", "page_url"), ("images", "page_url"), ("pages", "canonical"))


def live_spans(pages: DataFrame) -> DataFrame:
    """(k1, k2, born, died): disjoint spans in which an address has a live row.

    Rows are first combined by (address, removed_at), where only the earliest counts; what
    is left of an address is merged in order of time. Rows without url or ingested_at and
    rows removed before they came are never live.
    """
    rows = pages.select("url", "ingested_at", F.coalesce("removed_at", F.expr(FOREVER)).alias("died"))
    rows = rows.where("url is not null and ingested_at is not null and died > ingested_at")
    least = rows.select(*url_key("url"), "ingested_at", "died").groupBy(*KEYS, "died").agg(F.min("ingested_at").alias("born"))
    by_time = Window.partitionBy(*KEYS).orderBy("born", "died")
    seen = F.max("died").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("seen").isNull() | (F.col("born") > F.col("seen")), 1).otherwise(0)).over(by_time)
    return least.withColumn("seen", seen).withColumn("isle", isle).groupBy(*KEYS, "isle").agg(F.min("born").alias("born"), F.max("died").alias("died")).drop("isle")


def references(links: DataFrame, headings: DataFrame, images: DataFrame) -> DataFrame:
    """(field, record_id, run_id, ref, t) of every reference to a page; null references are none."""

    def one(field: int, ref: Column) -> Column:
        return F.struct(F.lit(field).cast("tinyint").alias("field"), ref.alias("ref"))

    wanted = F.coalesce("is_internal", F.lit(False)) & ~F.coalesce("is_special_link", F.lit(False))
    fallback = normal_form_udf(F.when(wanted & F.col("to_url_normalized").isNull(), F.col("to_url")))
    target = F.when(wanted, F.coalesce("to_url_normalized", fallback))
    of_links = links.select("id", "run_id", "loaded_at", F.explode(F.array(one(0, F.col("from_url")), one(1, target))).alias("r"))
    parts = [of_links.select(F.col("r.field").alias("field"), F.col("id").alias("record_id"), "run_id", F.col("r.ref").alias("ref"), F.col("loaded_at").alias("t"))]
    for field, df in ((2, headings), (3, images)):
        parts.append(df.select(F.lit(field).cast("tinyint").alias("field"), F.col("id").alias("record_id"), "run_id", F.col("page_url").alias("ref"), F.col("loaded_at").alias("t")))
    return reduce(DataFrame.unionAll, parts).where("ref is not null")


def latest_parents(pages: DataFrame) -> DataFrame:
    """(url, parent, t, page_id, run_id) of each address' latest row (crawled_at, then page_id).

    parent is the normal form of canonical, null if there is none or it is the address itself.
    """
    latest = F.max_by(F.struct("canonical", "ingested_at", "page_id", "run_id"), F.struct("crawled_at", "page_id")).alias("r")
    rows = pages.where("url is not null").groupBy("url").agg(latest).select("url", "r.*")
    parent = normal_form_udf(F.when(F.col("canonical") != "", F.col("canonical")))
    rows = rows.withColumn("parent", parent)
    return rows.select("url", F.when(F.col("parent") != F.col("url"), F.col("parent")).alias("parent"), F.col("ingested_at").alias("t"), "page_id", "run_id")


def direct_orphans(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The references without a live target at their time; a null time finds nothing live."""
    keyed = refs.select("field", "record_id", "run_id", "t", *url_key("ref"))
    a, b = salted(keyed, spans, KEYS, hot_keys(keyed, KEYS), "record_id")
    a, b = a.alias("a"), b.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*KEYS, "_salt")])
    return a.join(b, same & (F.col("b.born") <= F.col("a.t")) & (F.col("b.died") > F.col("a.t")), "left_anti").drop("_salt")


def orphaned_pages(parents: DataFrame, spans: DataFrame) -> DataFrame:
    """(k1, k2, level): addresses whose parent is missing (level 1), their children (2) and so
    on: semi-joins with what the last round added, until it added nothing. Each address has
    one parent, so no address comes twice and cycles, whose parents exist, never come; the
    rounds end with the longest chain. A parent that many pages name is split."""
    up = ["p1", "p2"]
    edges = parents.where("parent is not null")
    edges = stage(edges.select(*url_key("url"), *url_key("parent", "p"), "t"), "edges")
    hot = stage(hot_keys(edges, up), "hot")
    rest = stage(split(edges, up, hot, "k1"), "children")
    live = repeat(spans.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "born", "died"), up, hot)
    e, s = rest.alias("e"), live.alias("s")
    same = reduce(Column.__and__, [F.col(f"e.{k}") == F.col(f"s.{k}") for k in (*up, "_salt")])
    missing = e.join(s, same & (F.col("s.born") <= F.col("e.t")) & (F.col("s.died") > F.col("e.t")), "left_anti")
    added = stage(missing.select(*KEYS, F.lit(1).alias("level")), "orphans")
    found = [added]
    for level in count(2):
        if added.isEmpty():
            break
        above = repeat(added.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), up, hot)
        added = stage(rest.join(above, [*up, "_salt"], "left_semi").join(found[0].select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit(level).alias("level")), "orphans")
        found.append(added)
    return reduce(DataFrame.unionAll, found)


def orphan_cascade(pages: DataFrame, links: DataFrame, headings: DataFrame, images: DataFrame) -> DataFrame:
    """(table_name, record_id, run_id, ref_field, kind, level) of every orphan reference.

    kind is 'direct' (no live target when loaded, level 0 for child tables, 1 for a page's
    canonical) or 'inherited' (the target is live, but is a page orphaned at ``level``).
    Repeated rows are cases of their own. Empty tables give no rows.
    """
    spans = stage(live_spans(pages), "spans")
    refs = references(links, headings, images)
    parents = latest_parents(pages)
    named = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in FIELDS])

    def shown(df: DataFrame, kind: str) -> DataFrame:
        n = F.get(named, F.col("field").cast("int"))
        return df.select(n["t"].alias("table_name"), "record_id", "run_id", n["f"].alias("ref_field"), F.lit(kind).alias("kind"), F.col("level").cast("int").alias("level"))

    direct = stage(direct_orphans(refs, spans), "direct")
    bad = stage(orphaned_pages(parents, spans), "bad")
    own = parents.where("parent is not null").select(F.lit(4).cast("tinyint").alias("field"), F.col("page_id").alias("record_id"), "run_id", *url_key("url"))
    own = own.join(bad, KEYS)
    keyed = refs.select("field", "record_id", "run_id", "t", *url_key("ref"))
    a, b = salted(keyed, bad, KEYS, hot_keys(keyed, KEYS), "record_id")
    children = a.join(b, [*KEYS, "_salt"]).join(direct.select("field", "record_id"), ["field", "record_id"], "left_anti")
    return reduce(
        DataFrame.unionAll,
        [
            shown(direct.withColumn("level", F.lit(0)), "direct"),
            shown(own.where("level = 1"), "direct"),
            shown(own.where("level > 1"), "inherited"),
            shown(children, "inherited"),
        ],
    )


def orphan_report(pages: DataFrame, links: DataFrame, headings: DataFrame, images: DataFrame) -> DataFrame:
    """(table_name, run_id, ref_field, n_refs, n_direct, n_inherited) by table and crawl run."""
    n = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in FIELDS])
    child = references(links, headings, images).groupBy("field", "run_id").count()
    own = latest_parents(pages).where("parent is not null").groupBy(F.lit(4).cast("tinyint").alias("field"), "run_id").count()
    every = child.unionAll(own).select(F.get(n, F.col("field").cast("int"))["t"].alias("table_name"), "run_id", F.get(n, F.col("field").cast("int"))["f"].alias("ref_field"), F.col("count").alias("n_refs"))
    found = orphan_cascade(pages, links, headings, images).groupBy("table_name", "run_id", "ref_field").agg(F.count_if(F.col("kind") == "direct").alias("n_direct"), F.count_if(F.col("kind") == "inherited").alias("n_inherited"))
    a, b = every.alias("a"), found.alias("b")
    on = (F.col("a.table_name") == F.col("b.table_name")) & F.col("a.run_id").eqNullSafe(F.col("b.run_id")) & (F.col("a.ref_field") == F.col("b.ref_field"))
    return a.join(b, on, "left").select("a.*", F.coalesce("b.n_direct", F.lit(0)).alias("n_direct"), F.coalesce("b.n_inherited", F.lit(0)).alias("n_inherited"))
