"""Addresses that must not be fetched."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def safe(url: str | None) -> bool:
    """http(s) with a host that is no literal private, loopback, link-local or reserved address
    (also as IPv4 in IPv6) and no local name. Names aren't looked up."""
    try:
        u = urlparse(url or "")
        name = (u.hostname or "").rstrip(".").lower()
    except ValueError:
        return False
    if u.scheme not in ("http", "https") or not name or name == "localhost" or name.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        ip = ipaddress.ip_address(name)
    except ValueError:
        return True
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast


def is_safe(url: Column) -> Column:
    @F.pandas_udf(BooleanType())
    def judged(urls: pd.Series) -> pd.Series:
        return urls.map(safe)

    return judged(url)
