"""Garbled text from wrong character encoding (p3).

Method: bytes read under a wrong code page are a substitution cipher. For each source of
damage (the page the bytes were read as, and whether they were single bytes or UTF-8
sequences) a mapping from byte units to letters is learned by expectation-maximization
against the letter bigrams of the corpus, starting from what known code pages would say. The
mappings are applied token by token with translate(); a token counts as damaged if that makes
its bigrams far more probable. Re-encoding to bytes and decoding them is the exact check and
gives the restored text where it succeeds; lost characters (U+FFFD) are found, not restored.

Two passes over the texts. The first counts the tokens with letters beyond ASCII; bigrams and
cipher counts come from this vocabulary. What reaches the driver is bounded by the alphabets of
Unicode, squared, and by the byte units of each page, never by the data: scripts of many hundred
signs share one place in the bigrams, as their signs tell little by their neighbours.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from crawlloom.session import stage

# Code pages that bytes get read as, and pages whose bytes get misread.
READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "cp1256", "cp437", "cp850", "cp866", "koi8_r", "mac_roman")
WRITTEN_AS = ("cp1256", "cp1252", "cp1251", "cp850", "mac_roman", "iso8859-6")
LATIN_WRITTEN_AS = ("cp1252", "cp850", "mac_roman")
# First and last letter of scripts (Ethiopic, Canadian, Han, Yi, Vai, Hangul, and
# the planes above) whose signs share the place of the first.
MANY_SIGNS = (("\u1200", "\u139f"), ("\u1400", "\u167f"), ("\u3400", "\u9fff"), ("\ua000", "\ua4cf"), ("\ua500", "\ua63f"), ("\uac00", "\ud7af"), ("\U00010000", "\U0010ffff"))
#: A script is one of the corpus if it has this share of the letters beyond ASCII, or if fewer than
#: SYMPTOMS of its words look like what a wrong page makes.
COMMON_SCRIPT, SYMPTOMS = 0.02, 0.5
#: Nats a bigram, and letters, from which one word in single bytes is damage by itself.
ALONE, ALONE_LETTERS = 2.5, 4
#: Nats by which a reading must be better, a bigram on average, to count.
BETTER = 1.0

TOKEN = re.compile(r"[^ \n\t\r]*[^\x00-\x7f][^ \n\t\r]*")
UNITS = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\x80-\xff]|[\x00-\x7f]")
ARABIC = re.compile("[\u0600-\u06ff]")
LOST = re.compile("[�\x80-\x9f]")


def _high(page: str, lax: bool = True) -> dict[int, int]:
    """Character -> byte of the upper half; unassigned bytes are read as control characters."""
    out: dict[int, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            if not lax:
                continue
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


TO_BYTE = {p: _high(p) for p in READ_AS}


def to_bytes(token: str, page: str) -> bytes | None:
    """The bytes that were read as ``token`` under ``page``; None if it has other characters."""
    t = token.translate(TO_BYTE[page])
    try:
        return t.encode("latin-1") if all(c < "\x80" or ord(c) in TO_BYTE[page] for c in token) else None
    except UnicodeEncodeError:
        return None


def folded(c: str) -> str:
    if c < "\u1200":
        return "0" if c.isdigit() else c.lower() if c < "\x80" else c
    for first, last in MANY_SIGNS:
        if first <= c <= last:
            return first
    return "0" if c.isdigit() else c


def folded_unit(unit: bytes) -> bytes:
    """A UTF-8 sequence of a script of many signs as that of the first of them."""
    if len(unit) < 3:
        return unit
    try:
        return folded(unit.decode("utf-8")).encode("utf-8")
    except UnicodeDecodeError:
        return unit


@dataclass
class Model:
    """Bigram log-probabilities of the corpus and the learned mapping of each cipher class."""

    logp: dict[str, float] = field(default_factory=dict)
    floor: float = -16.0
    maps: dict[tuple[str, str], dict[bytes, str]] = field(default_factory=dict)
    letters: frozenset[str] = frozenset()
    seen: dict[str, tuple[str, str] | None] = field(default_factory=dict)

    def score(self, token: str) -> float | None:
        """Mean log-probability of the bigrams that touch a character beyond ASCII."""
        s = " " + "".join(map(folded, token)) + " "
        got = [self.logp.get(s[i : i + 2], self.floor) for i in range(len(s) - 1) if s[i] > "\x7f" or s[i + 1] > "\x7f"]
        return sum(got) / len(got) if got else None

    def read(self, token: str) -> tuple[str, str] | None:
        """(restored, class) if some mapping makes the token far more probable, else None."""
        if token in self.seen:
            return self.seen[token]
        if len(self.seen) > 300_000:
            self.seen.clear()
        best = self._read(token)
        self.seen[token] = best
        return best

    def translated(self, units: list[bytes], page: str, kind: str) -> str:
        """A token's units through the learned mapping; '\ufffd' where it knows none."""
        mapping = self.maps.get((page, kind), {})
        return "".join(u.decode("latin-1") if u < b"\x80" else mapping.get(u, "\ufffd") for u in units)

    def decoded(self, b: bytes, units: list[bytes], page: str) -> str:
        """UTF-8 bytes as text; a unit that doesn't decode through the learned mapping, if it knows it.
        Decoding is the check: a mapping that says otherwise of a unit that decodes is wrong (an
        apostrophe and a letter, say, can have the form of a sequence)."""
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            mapping = self.maps.get((page, "utf-8"), {})
        out = []
        for u in units:
            new = u.decode("utf-8", "replace")
            out.append(mapping.get(u, new) if "\ufffd" in new else new)
        return "".join(out)

    def exact(self, b: bytes, text: str) -> str:
        """What the known page that agrees most with the learned mapping makes of the bytes."""
        best, agreed = text, 0.6
        for page in WRITTEN_AS:
            try:
                new = b.decode(page)
            except UnicodeDecodeError:
                continue
            same = sum(x == y for x, y in zip(new, text)) / max(1, len(text))
            if same > agreed:
                best, agreed = new, same
        return best

    def _read(self, token: str) -> tuple[str, str] | None:
        raw = self.score(token)
        if raw is None:
            return None
        best, gain = None, 0.0
        for kind in ("utf-8", "bytes"):
            for page in READ_AS:
                b = to_bytes(token, page)
                if b is None:
                    continue
                units = UNITS.findall(b)
                many = [u for u in units if len(u) > 1]
                if (kind == "utf-8") != bool(many) or kind == "bytes" and not pure_high(b, 3):
                    continue
                text = self.translated(units, page, kind)
                if kind == "utf-8":
                    if sum(len(u) == 1 and u > b"\x7f" for u in units) > len(many) / 2:
                        continue
                    text = twice(self.decoded(b, units, page), page)
                else:
                    text = self.exact(b, text)
                    if text.count("\ufffd") * 4 > len(text):
                        continue
                new = self.score(text)
                up = (new if new is not None else -8.0) - raw
                if kind == "utf-8" and not ARABIC.search(token):
                    beyond = [c for c in text if c > "\x7f"]
                    marks = all(unicodedata.category(c)[0] in "PSZ" for c in beyond)
                    known = all(folded(c) in self.letters or unicodedata.category(c)[0] in "PSZ" for c in beyond)
                    # The exact check: all of it is in sequence form and decodes to letters of the
                    # corpus; three bytes in that form, or marks too rare for bigrams, are no accident.
                    if known and (up >= 0 or marks or any(len(u) > 2 for u in many)):
                        up = max(up, 0.0) + BETTER
                if up >= BETTER and up > gain:
                    best, gain = (text, f"{page} {kind}"), up
            if best:
                return best
        return self._read_latin(token, raw)

    def _read_latin(self, token: str, raw: float) -> tuple[str, str] | None:
        """A Latin word in which letters beyond ASCII went through a wrong single-byte page: the
        known pages are tried, and must give Latin letters of the corpus. Words in capitals are
        left alone: they are too rare for the bigrams to tell from damage."""
        if not any("a" <= c <= "z" for c in token):
            return None
        best, gain = None, BETTER
        for page in READ_AS:
            b = to_bytes(token, page)
            if b is None:
                continue
            for written in LATIN_WRITTEN_AS:
                try:
                    text = b.decode(written)
                except UnicodeDecodeError:
                    continue
                if text == token or not all(c.isalpha() and c.lower() in self.letters and script(c) == "LATIN" for c in text if c > "\x7f"):
                    continue
                new = self.score(text)
                if new is not None and new - raw > gain:
                    best, gain = (text, f"{page} {written}"), new - raw
        return best

    def stands_alone(self, token: str, restored: str) -> bool:
        """Whether one word in single bytes is damage without another beside it."""
        if sum(c.isalpha() for c in restored) < ALONE_LETTERS or "\ufffd" in restored:
            return False
        raw, new = self.score(token), self.score(restored)
        return raw is not None and new is not None and new - raw >= ALONE

    def repair(self, text: str) -> tuple[str, str | None]:
        """(text with damaged tokens restored, the commonest class or 'lost'), None if unharmed.

        Single-byte damage counts from two tokens of a class on, or from one long word that is
        far more probable, and then also reads the short tokens around them."""
        classes: Counter = Counter()
        alone: set[str] = set()
        for t in TOKEN.findall(text):
            r = self.read(t)
            if r:
                classes[r[1]] += 1
                if r[1].endswith("bytes") and self.stands_alone(t, r[0]):
                    alone.add(r[1])
        for c in [c for c, n in classes.items() if not c.endswith("utf-8") and n < 2]:
            if c not in alone:
                del classes[c]
        if not classes:
            return text, "lost" if LOST.search(text) else None
        page = max((c for c in classes if c.endswith("bytes")), key=classes.get, default="").partition(" ")[0]

        def one(m: re.Match) -> str:
            r = self.read(m.group())
            if r and r[1] in classes:
                return r[0]
            b = to_bytes(m.group(), page) if page else None
            if b and pure_high(b, 1):
                return self.exact(b, self.translated(UNITS.findall(b), page, "bytes"))
            return m.group()

        return TOKEN.sub(one, text), classes.most_common(1)[0][0]


def twice(text: str, page: str) -> str:
    """Text that went through the wrong page more than once, read on as long as bytes decode."""
    for _ in range(3):
        for p in (page, "cp1252", "latin-1"):
            b = to_bytes(text, p)
            try:
                new = b.decode("utf-8") if b else text
            except UnicodeDecodeError:
                continue
            if new != text:
                text = new
                break
        else:
            break
    return text


def pure_high(b: bytes, least: int = 2) -> bool:
    """``least`` or more characters beyond ASCII and no ASCII letter: a word in another script."""
    return sum(x > 127 for x in b) >= least and not any(65 <= x <= 90 or 97 <= x <= 122 for x in b)


def prior(unit: bytes) -> dict[str, float]:
    """What known encodings make of a unit."""
    if len(unit) > 1:
        try:
            return {unit.decode("utf-8"): 1.0}
        except UnicodeDecodeError:
            return {}
    out: dict[str, float] = defaultdict(float)
    for page in WRITTEN_AS:
        try:
            out[unit.decode(page)] += 1 / len(WRITTEN_AS)
        except UnicodeDecodeError:
            pass
    return dict(out)


def bare_latin(token: str) -> bool:
    """Three or more Latin letters beyond ASCII and none of ASCII: no language writes so."""
    letters = [c for c in token if c.isalpha()]
    return len(letters) > 2 and all(c > "\x7f" for c in letters) and script(letters[0]) == "LATIN"


def other_than_words(letters: list[str], page: str) -> frozenset[str]:
    """What can't be meant where whole words lie in a page's upper half: the page's own
    letters, Latin letters, and what is neither letter, mark nor a script's own punctuation."""
    own = {chr(c) for c in TO_BYTE[page]}
    wordy = {c for c in letters if c > "\x7f" and c not in own and script(c) != "LATIN" and (c.isalpha() or unicodedata.category(c)[0] == "M" or ARABIC.match(c))}
    return frozenset(letters) - wordy


def script(c: str) -> str:
    """The first word of a character's name: its script, for letters."""
    return unicodedata.name(c, "?").partition(" ")[0] if c.isalpha() else ""


def learn(pairs: dict[tuple[bytes, bytes], float], letters: list[str], logp: np.ndarray, barred: frozenset[str] = frozenset(), rounds: int = 15, weight: float = 12.0) -> dict[bytes, str]:
    """Expectation-maximization of a cipher's key: for each unit a distribution over letters.

    E: how well each letter fits a unit's neighbours (as pointwise mutual information, so that
    frequent letters attract nothing by frequency), given the present beliefs about them.
    M: beliefs from the prior and that fit, letters shared out among the units that claim
    them, since a key is one to one. A unit's evidence is weighed as ``weight`` occurrences
    at most, so that no count, however large, freezes an early belief. ``barred`` are letters
    that can't be meant: those of the page itself, where words in them are the symptom.
    """
    at = {c: i for i, c in enumerate(letters)}
    units = sorted({u for p in pairs for u in p})
    where = {u: i for i, u in enumerate(units)}
    n = np.zeros((len(units), len(units)))
    for (a, b), c in pairs.items():
        n[where[a], where[b]] += c
    belief = np.full((len(units), len(letters)), 1e-4)
    fixed = np.zeros(len(units), dtype=bool)
    for u, i in where.items():
        if len(u) == 1 and u < b"\x80":
            fixed[i] = True
            belief[i] = 0
            belief[i, at.get(folded(u.decode("latin-1")), 0)] = 1
        else:
            for c, w in prior(u).items():
                if c in at:
                    belief[i, at[c]] += w
    out = [i for c, i in at.items() if c in barred]
    belief[np.ix_(~fixed, out)] = 1e-12
    belief /= belief.sum(1, keepdims=True)
    start, prob = np.log(belief + 1e-12), np.exp(logp)
    one = np.log(prob.sum(1) + 1e-12)[:, None] + np.log(prob.sum(0) + 1e-12)[None, :]
    pmi = np.clip(logp - one, -4, 4)
    forward = n * np.minimum(1, weight / np.maximum(1, n.sum(1, keepdims=True)))
    backward = n.T * np.minimum(1, weight / np.maximum(1, n.T.sum(1, keepdims=True)))
    for _ in range(rounds):
        fit = forward @ (belief @ pmi.T) + backward @ (belief @ pmi)
        new = start + fit
        new = np.exp(new - new.max(1, keepdims=True))
        for _ in range(5):
            new /= new.sum(1, keepdims=True)
            new /= np.maximum(1, new.sum(0, keepdims=True))
        new /= new.sum(1, keepdims=True)
        new[fixed] = belief[fixed]
        if np.abs(new - belief).max() < 1e-4:
            break
        belief = new
    best = belief.argmax(1)
    return {u: letters[best[i]] for u, i in where.items() if belief[i, best[i]] >= 0.5}


def symptomatic(token: str, letters: list[str]) -> bool:
    """Whether a word looks like what a wrong page makes: its bytes under some page are UTF-8,
    capitals stand behind small letters, or signs beyond ASCII that no word has stand in it."""
    if any(a.islower() and b.isupper() for a, b in zip(letters, letters[1:])):
        return True
    inner = token.strip("".join(c for c in set(token) if unicodedata.category(c)[0] in "PSZ"))
    if any(c > "\x7f" and not c.isalpha() and unicodedata.category(c)[0] not in "MPN" for c in inner):
        return True
    for page in READ_AS:
        b = to_bytes(token, page)
        if b is not None and any(len(u) > 1 for u in UNITS.findall(b)):
            try:
                b.decode("utf-8")
                return True
            except UnicodeDecodeError:
                pass
    return False


def symptoms(scripts: frozenset[str]):
    """mapInPandas body, (script, n, bad): words of two letters or more in one of ``scripts`` (that
    of most of their letters beyond ASCII), and how many of them look like symptoms."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            bad: Counter = Counter()
            for t, k in zip(b["token"], b["n"]):
                letters = [c for c in t if c.isalpha()]
                own = Counter(script(c) for c in letters if c > "\x7f")
                s = own.most_common(1)[0][0] if own else ""
                if s in scripts and len(letters) > 1:
                    n[s] += k
                    if symptomatic(t, letters):
                        bad[s] += k
            if n:
                yield pd.DataFrame({"script": list(n), "n": list(n.values()), "bad": [bad[s] for s in n]})

    return body


def vocabulary(values: DataFrame) -> DataFrame:
    """(token, n) of all tokens with characters beyond ASCII in ``value``."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for v in b["value"]:
                if v and not v.isascii():
                    seen.update(TOKEN.findall(v))
            if seen:
                yield pd.DataFrame({"token": list(seen), "n": list(seen.values())})

    return values.select("value").mapInPandas(body, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def fit(values: DataFrame) -> Model:
    """Learn bigrams and mappings from all values of a table with the column ``value``."""
    words = stage(vocabulary(values), "vocabulary")

    def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t, n in zip(b["token"], b["n"]):
                if bare_latin(t):
                    continue
                s = " " + "".join(map(folded, t)) + " "
                for i in range(len(s) - 1):
                    seen[s[i : i + 2]] += n
        if seen:
            yield pd.DataFrame({"pair": list(seen), "n": list(seen.values())})

    counted = stage(words.mapInPandas(bigrams, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")), "bigrams")
    chars = counted.select(F.substring("pair", 1, 1).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect()  # an alphabet
    by_script: Counter = Counter()
    for r in chars:
        by_script[script(r["c"]) if r["c"] > "\x7f" else "ASCII"] += r["n"]
    beyond = sum(n for s, n in by_script.items() if s not in ("ASCII", "")) or 1
    # Scripts whose words are what a wrong page makes of others are symptoms, not languages of the corpus.
    sound = {s for s, n in by_script.items() if n >= COMMON_SCRIPT * beyond} | {""}
    rare = sorted({s for s in by_script if s != "ASCII"} - sound)
    if rare:
        looks = words.mapInPandas(symptoms(frozenset(rare)), "script string, n long, bad long").groupBy("script").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()  # a row a script
        sound |= {r["script"] for r in looks if r["bad"] < SYMPTOMS * r["n"]}
    letters = [r["c"] for r in chars if r["c"] <= "\x7f" or script(r["c"]) in sound]
    known = counted.where(F.substring("pair", 1, 1).isin(letters) & F.substring("pair", 2, 1).isin(letters)).collect() if letters else []  # an alphabet squared
    total = sum(r["n"] for r in known) or 1
    model = Model(letters=frozenset(c for c in letters if c > "\x7f"), logp={r["pair"]: math.log(r["n"] / total) for r in known}, floor=math.log(0.5 / total))

    def cipher(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t, n in zip(b["token"], b["n"]):
                for page in READ_AS:
                    raw = to_bytes(t, page)
                    if raw is None:
                        continue
                    units = UNITS.findall(raw)
                    kind = "utf-8" if any(len(u) > 1 for u in units) else "bytes"
                    if kind == "bytes" and not pure_high(raw):
                        continue
                    units = [b" ", *map(folded_unit, units), b" "]
                    for u, v in zip(units, units[1:]):
                        if u > b"\x7f" or v > b"\x7f":
                            seen[page, kind, u.hex(), v.hex()] += n
        keys = list(seen)
        if not keys:
            return
        yield pd.DataFrame({"page": [k[0] for k in keys], "kind": [k[1] for k in keys], "a": [k[2] for k in keys], "b": [k[3] for k in keys], "n": list(seen.values())})

    classes: dict[tuple[str, str], dict[tuple[bytes, bytes], float]] = defaultdict(dict)
    pairs = words.mapInPandas(cipher, "page string, kind string, a string, b string, n long").groupBy("page", "kind", "a", "b").agg(F.sum("n").alias("n"))
    for r in pairs.orderBy("page", "kind", "a", "b").collect():  # pages x units squared
        classes[r["page"], r["kind"]][bytes.fromhex(r["a"]), bytes.fromhex(r["b"])] = r["n"]
    at = {c: i for i, c in enumerate(letters)}
    logp = np.full((max(1, len(letters)), max(1, len(letters))), model.floor)
    for pair, lp in model.logp.items():
        if len(pair) == 2:
            logp[at[pair[0]], at[pair[1]]] = lp
    model.maps = {k: learn(v, letters, logp, other_than_words(letters, k[0]) if k[1] == "bytes" else frozenset()) for k, v in classes.items()} if letters else {}
    return model


def repaired(values: DataFrame, model: Model) -> DataFrame:
    """``values`` with ``restored`` and ``damage``: null where unharmed, else the class of
    damage ('cp1251 utf-8': UTF-8 read as cp1251) or 'lost'. Null and ASCII values are unharmed."""
    shared = values.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*values.schema.fields, StructField("restored", StringType()), StructField("damage", StringType())])

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [(v, None) if not v or v.isascii() else m.repair(v) for v in b["value"]]
            yield b.assign(restored=[g[0] for g in got], damage=[g[1] for g in got])

    return values.mapInPandas(body, schema)


def page_and_document_values(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(table_name, record_id, field, value) of titles, descriptions and texts; nulls left out."""
    of_pages = pages.select(F.lit("pages").alias("table_name"), F.col("page_id").alias("record_id"), F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("meta_description").alias("field"), F.col("meta_description").alias("value")))).alias("v")).select("table_name", "record_id", "v.*")
    of_docs = documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("record_id"), F.lit("text").alias("field"), F.col("text").alias("value"))
    return of_pages.unionByName(of_docs).where("value is not null")


def restore(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Fit on all values and repair them: see ``repaired``."""
    values = page_and_document_values(pages, documents)
    return repaired(values, fit(values))


_HINT = re.compile("[\x80-\x9f\u0400-\u04ff├┬Γ√]|[ÂÃâÐØÙÚÛÇÑ][^a-z ]|[ظطعغ][^\u0600-\u06ff\u200c\\s\\w.,:;!?()-]")
# Any match of the above begins with one of these: a quick look first.
_HINT_START = re.compile("[\x80-\x9f\u0400-\u04ff├┬Γ√ÂÃâÐØÙÚÛÇÑظطعغ]")
_plain: dict[str, str] = {}


def _plain_token(token: str) -> str:
    was = token
    for _ in range(3):
        for page in READ_AS:
            if page == "cp1256" and not _HINT.search(token):
                continue
            b = to_bytes(token, page)
            try:
                new = b.decode("utf-8") if b else token
            except UnicodeDecodeError:
                continue
            if new != token and all(unicodedata.category(c) not in ("Cn", "Co", "Cs") for c in new if c > "\x7f"):
                token = new
                break
        else:
            break
    if token == was and not ARABIC.search(token):
        b = to_bytes(token, "cp1252") or to_bytes(token, "cp1251")
        if b and pure_high(b, 2) and (bare_latin(token) or any(script(c) == "CYRILLIC" for c in token)):
            new = b.decode("cp1256", "replace")
            token = new if all(ARABIC.match(c) or c < "\x80" for c in new) else token
    return token


def plain_repair(text: str) -> str:
    """Undo UTF-8 read under a wrong page where bytes decode exactly, and Arabic script read as
    another single-byte page; for operators that must not stumble over garbled spots. Needs
    no corpus. Text without such spots comes back as it is."""
    if text.isascii() or not _HINT_START.search(text) or not _HINT.search(text):
        return text

    def one(m: re.Match) -> str:
        token = m.group()
        got = _plain.get(token)
        if got is None:
            if len(_plain) > 200_000:
                _plain.clear()
            got = _plain[token] = _plain_token(token)
        return got

    return TOKEN.sub(one, text)
