"""Issue collection, hints, health and comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY_RANK = {"critical": 1, "high": 2, "medium": 3, "low": 4}

# Issue, severity, category, fewest occurrences that make it an issue (33 rules).
RULES = (
    ("Canonical Loops", "critical", "Technical", 1),
    ("Canonical to Non-200 URL", "critical", "Technical", 1),
    ("Canonical to Non-Indexable URL", "high", "Technical", 1),
    ("External Canonicals", "high", "Technical", 1),
    ("Canonical Chains", "medium", "Technical", 1),
    ("Long URLs", "medium", "Technical", 1),
    ("Noisy or Duplicate URL Patterns", "medium", "Technical", 1),
    ("Server Errors (5xx)", "critical", "Technical", 1),
    ("404 Pages with Inlinks", "critical", "Technical", 1),
    ("NoIndex on Important Pages", "critical", "Technical", 1),
    ("Redirect Loops", "critical", "Technical", 1),
    ("Insecure Form Submission (Mixed Content)", "critical", "Technical", 1),
    ("Active Mixed Content", "high", "Technical", 1),
    ("Passive Mixed Content", "medium", "Technical", 1),
    ("Missing Title", "critical", "On-Page", 1),
    ("Duplicate Titles", "high", "On-Page", 1),
    ("Missing Meta Description", "high", "On-Page", 1),
    ("Missing H1", "high", "On-Page", 1),
    ("Multiple H1", "high", "On-Page", 1),
    ("Orphan Pages", "high", "Technical", 1),
    ("Critical Thin Content", "high", "Content", 1),
    ("Images Without Alt", "high", "On-Page", 11),
    ("Title Too Long", "medium", "On-Page", 1),
    ("Title Too Short", "medium", "On-Page", 1),
    ("Description Too Long", "medium", "On-Page", 1),
    ("Description Too Short", "medium", "On-Page", 1),
    ("Redirect Chains", "medium", "Technical", 1),
    ("Thin Content", "medium", "Content", 1),
    ("Images Without Dimensions", "medium", "Performance", 1),
    ("Low Internal Linking", "medium", "Technical", 1),
    ("Legacy Image Formats", "low", "Performance", 1),
    ("Images Without Lazy Loading", "low", "Performance", 6),
    ("Deep Pages", "low", "Technical", 1),
)


def page_rules() -> dict[str, Column]:
    """Rules that look at one page row."""
    ok = F.col("status_code") == 200
    indexable = F.coalesce("is_indexable", F.lit(False))
    title, desc = F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit(""))
    nt, nd, h1 = F.coalesce("title_length", F.lit(0)), F.coalesce("meta_description_length", F.lit(0)), F.coalesce("h1_count", F.lit(0))
    depth = F.coalesce("depth", F.lit(0))
    return {
        "Server Errors (5xx)": F.col("status_code").between(500, 599),
        "NoIndex on Important Pages": ok & ~indexable & F.lower(F.coalesce("meta_robots", F.lit(""))).contains("noindex") & (depth <= 2),
        "Missing Title": ok & indexable & (title == ""),
        "Missing Meta Description": ok & indexable & (desc == ""),
        "Missing H1": ok & indexable & (h1 == 0),
        "Multiple H1": ok & (h1 > 1),
        "Title Too Long": ok & (nt > 60),
        "Title Too Short": ok & (nt > 0) & (nt < 30),
        "Description Too Long": ok & (nd > 160),
        "Description Too Short": ok & (nd > 0) & (nd < 70),
        "Deep Pages": ok & (depth > 4),
    }


def collect_issues(pages: DataFrame, counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """(issue_type, severity, category, affected_count) of all rules that apply.

    ``counts`` has, by issue, a frame whose rows (or whose column affected_count, summed) are
    the occurrences that other analyzers found. Page rules are one pass and one row.
    """
    rules = page_rules()
    wide = pages.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    parts = [wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue_type"), F.col(f"r{i}").alias("affected_count")) for i, n in enumerate(rules)])).alias("x")).select("x.*")]
    for name, df in (counts or {}).items():
        n = F.sum("affected_count") if "affected_count" in df.columns else F.count("*")
        parts.append(df.agg(F.coalesce(n, F.lit(0)).cast("long").alias("affected_count")).select(F.lit(name).alias("issue_type"), "affected_count"))
    found = reduce(DataFrame.unionByName, parts)
    catalogue = pages.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "issue_type string, severity string, category string, least int, ordinal int")
    return found.join(F.broadcast(catalogue), "issue_type").where("affected_count >= least").select("issue_type", "severity", "category", "affected_count")


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "category").agg(F.count("*").alias("n_issues"), F.sum("affected_count").alias("n_affected"))


# Words of an issue's name (first match wins), impact and effort of mending it.
HINTS = (
    (("broken", "404", "مكسور", "معطّل"), "high", "low"),
    (("redirect", "chain", "تحويل", "توجيه"), "medium", "low"),
    (("canonical", "قانون", "كانونيكال"), "high", "low"),
    (("duplicate", "مكرر", "تكرار"), "medium", "medium"),
    (("title", "عنوان"), "high", "low"),
    (("description", "meta", "وصف"), "medium", "low"),
    (("thin", "content", "ضعيف", "محتوى"), "medium", "high"),
    (("image", "alt", "صور", "بديل"), "medium", "low"),
    (("orphan", "يتيم", "inlink", "روابط داخلية"), "high", "medium"),
    (("hreflang", "lang", "لغة"), "medium", "medium"),
    (("speed", "performance", "lcp", "cls", "أداء", "سرعة"), "high", "high"),
    (("https", "mixed", "security", "أمان"), "high", "low"),
)
#: Why each of these matters and what to do, in the same order.
ADVICE = (
    ("Dead links waste crawl visits and readers' patience.", "Mend each, or redirect it once to what replaced it."),
    ("Every further hop costs time and weakens the link.", "Let each redirect lead to its end in one step."),
    ("A wrong canonical keeps the right page out of the index.", "Name the preferred address on every page."),
    ("Pages that look alike compete with each other.", "Merge them, or tell them apart by title and text."),
    ("The title is what searchers read first.", "Give every page its own, of 50 to 60 characters."),
    ("The description decides whether a result is opened.", "Write one for every page, of 120 to 160 characters."),
    ("Little text answers few questions.", "Say more about the subject, or merge the page."),
    ("Without a text, an image says nothing to readers who can't see it.", "Describe each image that means something."),
    ("What no page links to is hardly found.", "Link to it from related pages."),
    ("Alternates that don't agree send readers to the wrong language.", "Let all versions name each other."),
    ("Slow pages lose readers.", "Load less, later, and from caches."),
    ("Insecure parts make the whole page untrusted.", "Load everything over https."),
)


def with_hints(issues: DataFrame) -> DataFrame:
    """Issues with impact, effort, why and how ('' for issues that no hint knows), and
    hint_score = weight of impact / weight of effort."""
    low = F.lower("issue_type")

    def chain(values: list[str], fallback: Column) -> Column:
        out = None
        for (words, *_), value in zip(HINTS, values):
            when = reduce(Column.__or__, [low.contains(w) for w in words])
            out = F.when(when, value) if out is None else out.when(when, value)
        return out.otherwise(fallback)

    by_severity = F.when(F.col("severity").isin("critical", "high"), "high").when(F.col("severity") == "low", "low").otherwise("medium")
    df = issues.withColumn("impact", chain([h[1] for h in HINTS], by_severity)).withColumn("effort", chain([h[2] for h in HINTS], F.lit("medium")))
    df = df.withColumn("why", chain([w for w, _ in ADVICE], F.lit(""))).withColumn("how", chain([h for _, h in ADVICE], F.lit("")))
    w = lambda c: F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).otherwise(1)
    return df.withColumn("hint_score", F.floor(w("impact") / w("effort") * 100 + 0.5) / 100)


def top_issues(issues: DataFrame, n: int = 3) -> DataFrame:
    """The n gravest issues: by severity, then by how many they affect."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return issues.orderBy(F.coalesce(F.try_element_at(rank, "severity"), F.lit(9)), F.desc("affected_count"), "issue_type").limit(n)


def health(issues: DataFrame, n_pages: int | Column) -> DataFrame:
    """One row: score 0 to 100 and its band, from occurrences by severity over pages."""
    n = F.lit(n_pages) if isinstance(n_pages, int) else n_pages
    s = lambda k: F.coalesce(F.sum(F.when(F.col("severity") == k, F.col("affected_count"))), F.lit(0))
    row = issues.agg(s("critical").alias("critical"), s("high").alias("high"), s("medium").alias("medium"), s("low").alias("low"))
    weight = F.col("critical") * 3 + F.col("high") * 2 + F.col("medium") + F.col("low") * 0.25
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - weight / F.greatest(n, F.lit(1)) * 8 + 0.5))).cast("int")
    band = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 50, "fair").when(F.col("score") >= 25, "poor").otherwise("critical")
    return row.withColumn("score", score).withColumn("band", band)


def compare_issues(old: DataFrame, new: DataFrame) -> DataFrame:
    """(issue_type, old_count, new_count, delta, state): fixed, new or persisting."""
    a = old.select("issue_type", F.col("affected_count").alias("old_count"))
    b = new.select("issue_type", F.col("affected_count").alias("new_count"))
    j = a.join(b, "issue_type", "full")
    state = F.when(F.col("new_count").isNull(), "fixed").when(F.col("old_count").isNull(), "new").otherwise("persisting")
    o, n = F.coalesce("old_count", F.lit(0)), F.coalesce("new_count", F.lit(0))
    return j.select("issue_type", o.alias("old_count"), n.alias("new_count"), (n - o).alias("delta"), state.alias("state"))


def compare_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, state): pages added and removed; a slash at the end makes no difference."""
    key = lambda df: df.where("url is not null").select(F.regexp_replace("url", "/+$", "").alias("url")).distinct()
    a, b = key(old), key(new)
    return b.join(a, "url", "left_anti").withColumn("state", F.lit("added")).unionAll(a.join(b, "url", "left_anti").withColumn("state", F.lit("removed")))
