"""Text functions: keys, hashes, fingerprints, widths, safe cells, formats, bots."""

from __future__ import annotations

import hashlib
import re
import unicodedata

try:  # much quicker for short texts than OpenSSL's, where it is built in
    from _md5 import md5
except ImportError:
    from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: White space of Unicode: for the JVM, whose class is many times faster than the same characters
#: listed, and listed for engines without it (RE2).
JVM_SPACE = r"(?U)\s"
SPACE = "[\\s\u00a0\u0085\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends (``trim`` only takes spaces)."""
    return F.regexp_replace(col(c), f"^{JVM_SPACE}+|{JVM_SPACE}+$", "")


def squeeze(c: Column | str) -> Column:
    """White space collapsed to single spaces, none at the ends: after the collapse only single
    spaces are left, so ``trim`` does the rest without another pattern."""
    return F.trim(F.regexp_replace(col(c), f"{JVM_SPACE}+", " "))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which Spark lacks; ASCII passes through."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def duplicate_key(c: Column | str, compose: bool = True) -> Column:
    """Key under which titles count as the same: composed, squeezed, lower case."""
    return F.lower(squeeze(nfc(col(c)) if compose else col(c)))


#: MD5 of the empty text.
NO_TEXT = hashlib.md5(b"").hexdigest()


def content_hash(c: Column | str) -> Column:
    """Hash of a text up to case and white space; '' for none. The text is squeezed once."""
    return F.replace(F.coalesce(F.md5(squeeze(F.lower(col(c)))), F.lit("")), F.lit(NO_TEXT), F.lit(""))


def words(c: Column | str) -> Column:
    """Words: runs of letters, digits, underscores and Arabic-block characters."""
    spaced = F.regexp_replace(col(c), r"[^\p{L}\p{N}\p{M}_؀-ۿ\s]", " ")
    return F.filter(F.split(spaced, f"{JVM_SPACE}+"), lambda w: w != "")


_WORD = re.compile(r"[\w\u0600-\u06ff]+")


class _LowHalves(dict):
    """Shingle: low half of its MD5. Kept as shingles recur; forgets all at ``MOST`` entries,
    some 30 MB of a worker, and never changes a value."""

    MOST = 1 << 17

    def __missing__(self, shingle: str) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        low = self[shingle] = md5(shingle.encode("utf-8", "surrogatepass")).digest()[8:]
        return low


_low = _LowHalves()


def fingerprint(text: str | None, least_words: int = 10, size: int = 3) -> int | None:
    """64-bit SimHash of the word shingles of a text, as a signed number; None below ``least_words``.

    A shingle counts as often as it occurs; its hash is the low half of its MD5."""
    w = _WORD.findall(text.lower()) if text else []
    if len(w) < least_words:
        return None
    low = b"".join(map(_low.__getitem__, map(" ".join, zip(*(w[i:] for i in range(size))))))
    ones = np.unpackbits(np.frombuffer(low, dtype=np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(low) // 8).tobytes(), "big", signed=True)


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) by Arrow batches; a text never leaves its row and nothing is shuffled."""

    @F.pandas_udf(LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="Int64")

    return df.select(key, prints(text).alias("simhash"))


def unsigned(c: Column | str) -> Column:
    return F.conv(F.hex(col(c)), 16, 10)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


# Width of characters in hundredths of an em of 13 pixels; the Arabic block
# otherwise 55, everything else 60.
CHAR_WIDTHS = {30: "ilIj .,", 40: "tfال", 70: "م", 90: "wm", 100: "M", 110: "W"}
EM = 13


def pixel_width(c: Column | str) -> Column:
    """Estimated width of a title in pixels, truncated; 0 for none. Counting characters by
    class keeps it in integers, so no sum depends on order."""
    t = F.coalesce(col(c), F.lit(""))
    counts = {w: F.regexp_count(t, F.lit("[" + chars + "]")) for w, chars in CHAR_WIDTHS.items()}
    arabic = F.regexp_count(t, F.lit("[\u0600-\u06ff&&[^الم]]"))
    rest = F.char_length(t) - arabic
    total = arabic * 55
    for w, n in counts.items():
        rest, total = rest - n, total + n * w
    return F.floor((total + rest * 60) * EM / 100).cast("int")


def script_language(c: Column | str) -> Column:
    """ar, en, mixed or unknown by the share of Arabic among Arabic and Latin letters."""
    arabic = F.regexp_count(col(c), F.lit(r"[؀-ۿ]"))
    latin = F.regexp_count(col(c), F.lit(r"[A-Za-z]"))
    n = arabic + latin
    return F.when(col(c).isNull() | (n == 0), "unknown").when(arabic > n * 0.7, "ar").when(latin > n * 0.7, "en").otherwise("mixed")


def text_stats(c: Column | str) -> list[Column]:
    """word_count, character_count, sentence_count, reading_minutes."""
    n = F.size(words(F.coalesce(col(c), F.lit(""))))
    return [
        n.alias("word_count"),
        F.char_length(F.coalesce(col(c), F.lit(""))).alias("character_count"),
        F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"[.!?؟،]")).alias("sentence_count"),
        F.greatest(F.lit(1), F.floor(n / 200 + 0.5).cast("int")).alias("reading_minutes"),
    ]


def formula_safe(c: Column | str) -> Column:
    """Cells that a spreadsheet would evaluate get a leading apostrophe."""
    return F.when(col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def cell(c: Column | str) -> Column:
    """A cell of exported CSV: formulas are also seen behind white space and zero-width characters."""
    return F.when(col(c).rlike(r"^[\s​‌‍﻿]*[=+\-@]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def safe_filename(c: Column | str, most: int = 100) -> Column:
    """A file name: forbidden characters and runs of white space as '_', none at the ends;
    'untitled' where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), f"{JVM_SPACE}+", "_")
    clean = F.substring(F.regexp_replace(clean, "^_+|_+$", ""), 1, most)
    return F.when(clean == "", F.lit("untitled")).otherwise(clean)


def format_bytes(c: Column | str) -> Column:
    """'0 B', '512.00 B', '1.50 KB' up to TB; exact halves go to the even digit."""
    n = col(c).cast("double")
    out = F.when(n.isNull(), F.lit(None)).when(n == 0, F.lit("0 B"))
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(n / 1024**k, 2)))
    return out.otherwise(F.format_string("%.2f TB", F.bround(n / 1024**4, 2)))


def format_duration(seconds: Column | str) -> Column:
    """'59.9s', '2m 0s', '1h 2m 3s'; from a minute on, seconds are rounded before they are split."""
    s = col(seconds).cast("double")
    n = F.rint(s).cast("long")
    return (
        F.when(s.isNull(), F.lit(None))
        .when(s < 60, F.format_string("%.1fs", F.bround(s, 1)))
        .when(n < 3600, F.format_string("%dm %ds", F.floor(n / 60), n % 60))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(n / 3600), F.floor((n % 3600) / 60), n % 60))
    )


def truncated(c: Column | str, most: int = 100) -> Column:
    t = F.coalesce(col(c), F.lit(""))
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


# Crawlers by what their agent contains, in the order they are tried.
BOTS = ("Googlebot", "AdsBot-Google", "Bingbot", "DuckDuckBot", "YandexBot", "Baiduspider", "Applebot", "GPTBot", "ClaudeBot")


def bot(agent: Column | str) -> Column:
    low = F.lower(col(agent))
    out = F.when(low.contains(BOTS[0].lower()), BOTS[0])
    for name in BOTS[1:]:
        out = out.when(low.contains(name.lower()), name)
    return out


def hreflang_code(c: Column | str) -> Column:
    """Normal spelling of a language tag: en, zh-Hant, pt-BR, x-default. Only '-' parts it."""
    t = strip(F.coalesce(col(c), F.lit("")))
    one = F.transform(F.split(t, "-"), lambda p, i: F.when(i == 0, F.lower(p)).when(p.rlike(r"^\p{L}{4}$"), F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 3)))).otherwise(F.upper(p)))
    return F.when(F.lower(t) == "x-default", F.lit("x-default")).otherwise(F.array_join(one, "-"))


# What a normalised tag must look like.
HREFLANG = r"^(x-default|[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|\d{3}))?)$"
