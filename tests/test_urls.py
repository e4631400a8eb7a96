from urllib.parse import urlsplit

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlloom.functions import urls
from crawlloom.functions.urls import normal_form
from crawlloom.sources.readers import matches_any
from crawlloom.sources.safety import safe


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://e.com/a/../b", "https://e.com/b"),
        ("HTTP://Example.com:80/Page/?b=2&a=1#x", "http://example.com/Page/?a=1&b=2"),
        ("https://e.com", "https://e.com/"),
        ("https://e.com//a///b/", "https://e.com/a/b/"),
        ("https://e.com/?utm_source=x&q=&UTM_SOURCE=y", "https://e.com/?UTM_SOURCE=y"),
        ("https://e.com/a/./b/../c/", "https://e.com/a/c/"),
        ("https://e.com:8443/p", "https://e.com:8443/p"),
        (None, None),
    ],
)
def test_normal_form(raw, want):
    assert normal_form(raw) == want


def test_slash_at_the_end_matters():
    assert normal_form("https://e.com/p/") != normal_form("https://e.com/p")


def test_relative_to_base():
    assert normal_form("../x?b=1", "https://e.com/a/b/") == "https://e.com/a/x?b=1"


@given(st.from_regex(r"https?://[a-z]{1,5}\.[a-z]{2}(/[a-zA-Z0-9._-]{0,4}){0,4}(\?[a-z]{1,3}=[a-z0-9]{0,3}(&[a-z]{1,3}=[a-z0-9]{0,3}){0,2})?", fullmatch=True))
def test_idempotent(u):
    once = normal_form(u)
    assert normal_form(once) == once and urlsplit(once).fragment == ""


def test_native_form_equals_udf(spark):
    rows = [("https://E.com:443//a/b?z=1&a=2&utm_id=3#f",), ("http://e.com",), ("http://e.com:80/x/?q=",), ("https://e.com/a?b=2&b=1",)]
    df = spark.createDataFrame(rows, "u string").select(urls.native_normal_form("u").alias("n"), urls.normal_form_udf("u").alias("e"))
    assert all(r.n == r.e for r in df.collect())


def test_internal_and_patterns(spark):
    df = spark.createDataFrame([("https://www.e.com/x",), ("https://other.com/x",), ("https://a.e.com:8080/x",), ("/rel",), ("https://note.com/",)], "u string")
    assert [r[0] for r in df.select(urls.is_internal("u", ["e.com"])).collect()] == [True, False, True, True, False]
    df = spark.createDataFrame([("https://e.com/admin/x",), ("https://e.com/p.pdf",), ("https://e.com/page",)], "u string")
    assert [r[0] for r in df.select(matches_any("u", ["/admin", "*.pdf"])).collect()] == [True, True, False]


def test_kinds(spark):
    cases = {"/login?x=1": "redirect_wrapper", "/a?page=4": "pagination_deep", "/a?page=3": "other", "/a?filter_a=1&color=red": "filter_combination", "/a?filter_a=&color=red": "other"}
    df = spark.createDataFrame([(f"https://e.com{k}",) for k in cases], "u string").select(urls.kind("u").alias("k"))
    assert [r.k for r in df.collect()] == list(cases.values())


@pytest.mark.parametrize("u, ok", [("http://127.0.0.1/", False), ("http://169.254.169.254/", False), ("file:///etc/passwd", False), ("http://[::ffff:10.0.0.1]/", False), ("https://e.com/", True), (None, False), ("http://localhost/", False), ("https://8.8.8.8/", True)])
def test_safe(u, ok):
    assert safe(u) is ok


def test_path_key(spark):
    df = spark.createDataFrame([("https://e.com/A/b//",), ("https://e.com",), ("https://e.com/?q=1",)], "u string")
    assert [r[0] for r in df.select(urls.path_key("u")).collect()] == ["/a/b", "/", "/"]
    assert [r[0] for r in df.select(urls.depth(F.col("u"))).collect()] == [2, 0, 0]
