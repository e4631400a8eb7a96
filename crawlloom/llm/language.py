"""Missing or wrong language labels, and mixed languages (p2).

Method: rank-order profiles. A language's profile is the list of its most frequent letter
trigrams by rank, from a bounded sample of reviewed texts. A stretch of text is ranked the
same way, and its out-of-place distance to a profile is the sum over its trigrams of how far
their ranks lie apart, with a largest distance for trigrams the profile lacks. The nearest
profile is the language; the confidence is how much nearer it is than the next.

Every sentence of every text is ranked, all sentences of an Arrow batch at once in numpy: one
pass over the texts, no shuffle. Broadcast are the profiles: LANGUAGES x PROFILE numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.llm.clauses import ADDRESS
from crawlloom.llm.encoding import plain_repair
from crawlloom.session import stage

#: Trigrams of a profile, and texts a language's profile is made from at most (by hash of id).
PROFILE, SAMPLE = 500, 400
#: Letters a stretch needs to be told by itself, and the least confidence for it to count in a
#: mixture. A record none of whose stretches has so many is told as a whole, from one letter on.
LEAST_LETTERS, SURE = 9, 0.12
#: Stretches of another language that make a document a mixture.
MIXED_SENTENCES = 2

# ISO 639-1, 639-2 and English names.
NAMES = {
    "ar": "ara arabic", "bg": "bul bulgarian", "ca": "cat catalan", "cs": "ces cze czech", "da": "dan danish", "de": "deu ger german", "el": "ell gre greek", "en": "eng english",
    "es": "spa spanish castilian", "et": "est estonian", "fa": "fas per persian farsi", "fi": "fin finnish", "fr": "fra fre french", "he": "heb hebrew", "hi": "hin hindi", "hr": "hrv croatian",
    "hu": "hun hungarian", "id": "ind indonesian", "it": "ita italian", "ja": "jpn japanese", "ko": "kor korean", "lt": "lit lithuanian", "lv": "lav latvian", "nl": "nld dut dutch flemish",
    "no": "nor norwegian", "pl": "pol polish", "pt": "por portuguese", "ro": "ron rum romanian", "ru": "rus russian", "sk": "slk slo slovak", "sl": "slv slovenian", "sr": "srp serbian",
    "sv": "swe swedish", "th": "tha thai", "tr": "tur turkish", "uk": "ukr ukrainian", "ur": "urd urdu", "vi": "vie vietnamese", "zh": "zho chi chinese",
}
_CODE = {name: code for code, names in NAMES.items() for name in (code, *names.split())}


def label_code(label: Column | str) -> Column:
    """Two-letter code that a label spells; null if missing or no language."""
    head = F.lower(F.regexp_extract(F.col(label) if isinstance(label, str) else label, r"^\s*([A-Za-z]+)", 1))
    table = F.create_map(*[F.lit(x) for kv in sorted(_CODE.items()) for x in kv])
    return F.try_element_at(table, head)


SENTENCE_END = re.compile(r"[.!?؟…][\"”»’)]*\s+|[\r\n]+")


class Ranker:
    """Letters, trigram codes and ranks in numpy."""

    def __init__(self, letters: str) -> None:
        self.letters = letters
        self.base = len(letters) + 2  # 0: no letter, last: letter that no profile knows
        table = np.zeros(0x11000, dtype=np.int64)
        for cp in range(0x80, 0x11000):
            if chr(cp).isalpha() or 0x64B <= cp <= 0x65F:
                table[cp] = self.base - 1
        for i, c in enumerate(letters):
            table[ord(c)] = i + 1
        table[0x200C] = 0
        self.table = table

    def grams(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, code) of every trigram with a letter in the middle, and letters a stretch."""
        lengths = np.fromiter((len(s) + 2 for s in stretches), dtype=np.int64, count=len(stretches))
        text = "".join(f" {s} " for s in stretches).lower() if stretches else ""
        if len(text) != lengths.sum():  # lower() can lengthen
            stretches = [s.lower() for s in stretches]
            lengths = np.fromiter((len(s) + 2 for s in stretches), dtype=np.int64, count=len(stretches))
            text = "".join(f" {s} " for s in stretches)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        x = self.table[np.minimum(cp, 0x10FFF)]
        owner = np.repeat(np.arange(len(stretches)), lengths)
        letters = np.bincount(owner, weights=x > 0, minlength=len(stretches)).astype(np.int64)
        mid = x[1:-1] > 0
        code = (x[:-2] * self.base + x[1:-1]) * self.base + x[2:]
        return owner[1:-1][mid], code[mid], letters

    def ranked(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, code, rank) of distinct trigrams, ties sharing the least rank, and letters.
        Rows of a stretch are together."""
        owner, code, letters = self.grams(stretches)
        size = self.base**3
        keys = owner * size + code
        keys.sort()
        if not len(keys):
            return keys, keys, keys, letters
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[new, len(keys)])
        keys = keys[new]
        owner = keys // size
        code = keys - owner * size
        most = int(n.max())
        order = np.argsort(owner * (most + 1) + (most - n), kind="stable")
        code, n = code[order], n[order]
        first = np.r_[True, owner[1:] != owner[:-1]]
        at = np.arange(len(owner))
        start = np.maximum.accumulate(np.where(first, at, 0))
        rank = np.maximum.accumulate(np.where(first | np.r_[True, n[1:] != n[:-1]], at, 0)) - start
        return owner, code, rank, letters


class Profiles:
    """Ranks of each language's trigrams, and the distance of stretches to them."""

    def __init__(self, letters: str, ranks: dict[str, dict[str, int]]) -> None:
        self.ranker = Ranker(letters)
        self.languages = sorted(ranks)
        at = {c: i + 1 for i, c in enumerate(letters)} | {" ": 0}
        base = self.ranker.base

        def code(g: str) -> int:
            return (at.get(g[0], base - 1) * base + at.get(g[1], base - 1)) * base + at.get(g[2], base - 1)

        known = sorted({code(g) for r in ranks.values() for g in r})
        where = {c: i for i, c in enumerate(known)}
        # Trigrams a profile lacks are so far off that any rank gives the largest distance.
        self.ranks = np.full((len(self.languages), len(known) + 1), 4 * PROFILE, dtype=np.int32)
        for i, lang in enumerate(self.languages):
            for g, r in ranks[lang].items():
                self.ranks[i, where[code(g)]] = r
        self.known = known

    @cached_property
    def place(self) -> np.ndarray:
        """Where each trigram code stands in ``ranks``; built where it is used, not sent."""
        out = np.full(self.ranker.base**3, len(self.known), dtype=np.int32)
        out[self.known] = np.arange(len(self.known), dtype=np.int32)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    def distances(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean out-of-place distance, 0 to 1, of each stretch to each language; letters)."""
        owner, code, rank, letters = self.ranker.ranked(stretches)
        out = np.ones((len(stretches), len(self.languages)))
        if len(owner):
            i = self.place[code]
            rank = np.minimum(rank, 2 * PROFILE).astype(np.int32)
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            n = np.diff(np.r_[begins, len(owner)])
            for k in range(len(self.languages)):
                d = np.abs(self.ranks[k][i] - rank)
                np.minimum(d, PROFILE, out=d)
                out[owner[begins], k] = np.add.reduceat(d, begins) / (n * PROFILE)
        return out, letters

    def tell(self, stretches: list[str], least: int = LEAST_LETTERS) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(language, confidence, letters) of each stretch; None where letters are fewer than ``least``."""
        if not stretches or not self.languages:
            return [None] * len(stretches), np.zeros(len(stretches)), np.zeros(len(stretches), dtype=np.int64)
        at: dict[str, int] = {}
        which = np.array([at.setdefault(s, len(at)) for s in stretches])  # equal stretches are ranked once
        d, letters = self.distances(list(at))
        best = d.argmin(1)
        two = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.c_[d, np.ones(len(d))]
        sure = two[:, 1] - two[:, 0]
        langs = [self.languages[b] if n >= least else None for b, n in zip(best, letters)]
        return [langs[i] for i in which], sure[which], letters[which]


def told_whole(p: Profiles, weight: list[dict], texts: dict[int, list[str]]) -> None:
    """Fill ``weight`` of the records none of whose stretches (``texts``) could be told, by all of
    a record's stretches together; records without a letter stay empty."""
    rest = [i for i, own in texts.items() if own and not weight[i]]
    langs, sure, letters = p.tell([" ".join(texts[i]) for i in rest], 1)
    for i, lang, s, n in zip(rest, langs, sure, letters):
        if lang is not None:
            weight[i][lang] = int(n) * (0.01 + s)


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text, without what ends them; addresses blanked."""
    if "://" in text or "www." in text:
        text = ADDRESS.sub(lambda m: " " * len(m.group()), text)
    return [s for s in SENTENCE_END.split(text) if s and not s.isspace()]


def spans(text: str) -> list[tuple[int, str]]:
    """(start, sentence) of ``sentences``."""
    if "://" in text or "www." in text:
        text = ADDRESS.sub(lambda m: " " * len(m.group()), text)
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    return [(i, s) for i, s in [*out, (at, text[at:])] if s and not s.isspace()]


def fit(documents: DataFrame, labels: DataFrame) -> Profiles:
    """Profiles from documents (doc_id, lang, text) and reviewed labels (doc_id, reviewed_lang).

    A language's texts are its reviewed ones, and where there are fewer than a tenth of
    ``SAMPLE``, those labelled with it as delivered; above SAMPLE they are thinned by a hash
    of doc_id to about that many. This is the only step that doesn't see all documents.
    """
    reviewed = labels.where("reviewed_lang is not null").groupBy("doc_id").agg(F.min("reviewed_lang").alias("l"))
    sure = documents.select("doc_id", "text").join(reviewed, "doc_id").select("doc_id", label_code("l").alias("l"), "text", F.lit(True).alias("reviewed"))
    counts = reviewed.groupBy(label_code("l").alias("l")).count().where("l is not null").collect()  # a row a language
    enough = {r["l"]: r["count"] for r in counts if r["count"] >= SAMPLE // 10}
    given = documents.select("doc_id", label_code("lang").alias("l"), "text", F.lit(False).alias("reviewed")).where(~F.col("l").isin(list(enough)) if enough else F.lit(True))
    # The kept fraction needs counts of the labels as delivered; a row a language.
    of_given = {r["l"]: r["count"] for r in given.groupBy("l").count().collect() if r["l"]}
    rate = F.create_map(*[F.lit(x) for l, n in (of_given | enough).items() for x in (l, min(1.0, SAMPLE / max(1, n)))]) if of_given or enough else F.lit(None)
    if not (of_given or enough):
        return Profiles("", {})
    keep = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000) < F.try_element_at(rate, F.col("l"))
    picked = sure.unionByName(given).where(F.col("l").isNotNull() & F.col("text").isNotNull() & (F.col("reviewed") == F.col("l").isin(list(enough)))).where(keep)

    def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(b["l"], b["text"]):
                t = "".join(c if c.isalpha() or "ً" <= c <= "ٟ" else " " for c in f" {plain_repair(text).lower()} ")
                for i in range(1, len(t) - 1):
                    if t[i] != " ":
                        k = (lang, t[i - 1 : i + 2])
                        seen[k] = seen.get(k, 0) + 1
            if not seen:
                continue
            yield pd.DataFrame({"l": [k[0] for k in seen], "g": [k[1] for k in seen], "n": list(seen.values())})

    counted = stage(picked.select("l", "text").mapInPandas(trigrams, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n")), "trigrams")
    rows = counted.select("l", F.struct((-F.col("n")).alias("n"), "g").alias("s")).groupBy("l").agg(F.slice(F.array_sort(F.collect_list("s")), 1, PROFILE).alias("top")).collect()  # bounded by SAMPLE texts
    ranks = {r["l"]: {s["g"]: i for i, s in enumerate(r["top"])} for r in rows}
    letters = "".join(sorted({c for r in ranks.values() for g in r for c in g if c != " " and ord(c) < 0x11000}))
    return Profiles(letters, ranks)


def told(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """(id, langs, sentences, lang, confidence) of (id, text): the language of each whole text,
    and how many confident sentences each language has (parallel arrays)."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.iloc[lo : lo + 512]
                stretches: list[str] = []
                owner: list[int] = []
                whole_of: dict[int, list[str]] = {}
                for i, t in enumerate(b["text"]):
                    if t:
                        own = whole_of[i] = sentences(plain_repair(t))
                        stretches += own
                        owner += [i] * len(own)
                langs, sure, letters = p.tell(stretches)
                counts: list[dict] = [{} for _ in range(len(b))]
                weight: list[dict] = [{} for _ in range(len(b))]
                for i, lang, s, n in zip(owner, langs, sure, letters):
                    if lang is None:
                        continue
                    weight[i][lang] = weight[i].get(lang, 0) + int(n) * (0.01 + s)
                    if s >= SURE:
                        counts[i][lang] = counts[i].get(lang, 0) + 1
                told_whole(p, weight, whole_of)
                best = [max(w, key=lambda k: (w[k], k)) if w else None for w in weight]
                yield pd.DataFrame(
                    {
                        "id": b["id"],
                        "langs": [sorted(c) for c in counts],
                        "sentences": [[c[k] for k in sorted(c)] for c in counts],
                        "lang": best,
                        "confidence": [round(w[k] / sum(w.values()), 4) if k else 0.0 for w, k in zip(weight, best)],
                    }
                )

    return documents.select("id", "text").mapInPandas(body, "id long, langs array<string>, sentences array<long>, lang string, confidence double")


def by_language(texts, p: Profiles) -> list[list[tuple[str, str]]]:
    """The (language, text) parts of each text: the text as it is under its language, and the
    lines of a mixture by ``document_languages`` under theirs; none where nothing can be told."""
    stretches: list[str] = []
    bounds = [0]
    for t in texts:
        stretches += sentences(plain_repair(t)) if t else ()
        bounds.append(len(stretches))
    langs, sure, letters = p.tell(stretches)
    out: list[list[tuple[str, str]]] = []
    for t, lo, hi in zip(texts, bounds, bounds[1:]):
        counts: dict[str, int] = {}
        weight: dict[str, float] = {}
        for lang, s, n in zip(langs[lo:hi], sure[lo:hi], letters[lo:hi]):
            if lang is not None:
                weight[lang] = weight.get(lang, 0) + int(n) * (0.01 + s)
                if s >= SURE:
                    counts[lang] = counts.get(lang, 0) + 1
        many = [k for k, n in counts.items() if n >= MIXED_SENTENCES]
        if len(many) < 2:
            out.append([(max(weight, key=lambda k: (weight[k], k)), t)] if weight else [])
            continue
        parts: dict[str, list[str]] = {k: [] for k in sorted(many)}
        at = next(k for k, s in zip(langs[lo:hi], sure[lo:hi]) if k in parts and s >= SURE)
        for i in range(lo, hi):
            if langs[i] in parts and sure[i] >= SURE:
                at = langs[i]
            parts[at].append(stretches[i])
        out.append([(k, "\n".join(x)) for k, x in parts.items()])
    return out


def segments(documents: DataFrame, profiles: Profiles, whole_too: bool = False) -> DataFrame:
    """(id, segment, start, n_chars, lang, confidence): runs of sentences in one language.
    With ``whole_too`` also a row for each document, its segment null, with the language and
    confidence of ``told``; both are null or 0 where nothing can be told.

    Sentences with too few letters or too little confidence belong to the run before them.
    ``start`` counts characters of the text after undoing garbled spots.
    """
    shared = documents.sparkSession.sparkContext.broadcast(profiles)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.iloc[lo : lo + 512]
                stretches, owner, starts, rows = [], [], [], []
                for k, (i, t) in enumerate(zip(b["id"], b["text"])):
                    for at, sentence in spans(plain_repair(t)) if t else ():
                        stretches.append(sentence)
                        owner.append(i)
                        starts.append(at)
                        rows.append(k)
                langs, sure, letters = p.tell(stretches)
                out: list[list] = []
                for i, at, sentence, lang, c in zip(owner, starts, stretches, langs, sure):
                    same = bool(out) and out[-1][0] == i
                    told_ = lang if c >= SURE else None
                    if same and (told_ is None or out[-1][4] in (None, told_)):
                        out[-1][3] = at + len(sentence) - out[-1][2]
                        out[-1][4] = out[-1][4] or told_
                        out[-1][5] = max(out[-1][5], float(c))
                    else:
                        out.append([i, out[-1][1] + 1 if same else 0, at, len(sentence), told_, float(c)])
                if whole_too:
                    weight: list[dict] = [{} for _ in range(len(b))]
                    whole_of: dict[int, list[str]] = {}
                    for i, sentence, lang, s, n in zip(rows, stretches, langs, sure, letters):
                        whole_of.setdefault(i, []).append(sentence)
                        if lang is not None:
                            weight[i][lang] = weight[i].get(lang, 0) + int(n) * (0.01 + s)
                    told_whole(p, weight, whole_of)
                    for w, i, t in zip(weight, b["id"], b["text"]):
                        best = max(w, key=lambda x: (w[x], x)) if w else None
                        out.append([i, None, 0, len(plain_repair(t)) if t else 0, best, round(float(w[best] / sum(w.values())), 4) if w else 0.0])
                frame = pd.DataFrame(out, columns=["id", "segment", "start", "n_chars", "lang", "confidence"])
                frame["segment"] = frame["segment"].astype("Int32")
                yield frame

    return documents.select("id", "text").mapInPandas(body, "id long, segment int, start int, n_chars int, lang string, confidence double")


def document_languages(told_: DataFrame) -> Column:
    """The languages a document is in: those with two confident sentences if several have
    them, else the one of the whole text; null where nothing can be told."""
    many = F.filter(F.arrays_zip("langs", "sentences"), lambda z: z["sentences"] >= MIXED_SENTENCES)
    return F.when(F.size(many) > 1, F.transform(many, lambda z: z["langs"])).when(F.col("lang").isNotNull(), F.array("lang"))


def page_languages(pages: DataFrame, profiles: Profiles, parts: bool = False) -> DataFrame:
    """(page_id, label, are) of pages (page_id, title, meta_description, language) with any
    text: the languages of title and description (two if both are sure and differ), and the
    code that the label spells. Pages where nothing can be told are left out.

    With ``parts`` (page_id, segment, field, lang, confidence) instead: a row for each page, its
    segment null, and where title and description differ one for each of the two."""
    shared = pages.sparkSession.sparkContext.broadcast(profiles)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                b = whole.iloc[lo : lo + 2048]
                pairs = [(plain_repair(t or ""), plain_repair(m or "")) for t, m in zip(b["title"], b["meta_description"])]
                titles = [BRAND.sub("", t) for t, _ in pairs]
                a, sure_a, _ = p.tell(titles)
                m, sure_m, _ = p.tell([x for _, x in pairs])
                both, sure_b, _ = p.tell([f"{t or whole}. {x}" for t, (whole, x) in zip(titles, pairs)], 1)
                are = []
                for la, ca, lm, cm, lb in zip(a, sure_a, m, sure_m, both):
                    if la and lm and la != lm and ca >= SURE and cm >= SURE:
                        are.append(sorted((la, lm)))
                    else:
                        are.append([lb] if lb else None)
                if parts:
                    out = []
                    for i, (t, x), ar, la, ca, lm, cm, lb, cb in zip(b["page_id"], pairs, are, a, sure_a, m, sure_m, both, sure_b):
                        out.append([i, None, None, lb, float(cb) if lb else 0.0])
                        if ar and len(ar) > 1:
                            out += [[i, 0, "title", la, float(ca)], [i, 1, "meta_description", lm, float(cm)]]
                    frame = pd.DataFrame(out, columns=["page_id", "segment", "field", "lang", "confidence"])
                    frame["segment"] = frame["segment"].astype("Int32")
                    yield frame
                else:
                    yield pd.DataFrame({"page_id": b["page_id"], "are": are})

    if parts:
        return pages.select("page_id", "title", "meta_description").mapInPandas(body, "page_id long, segment int, field string, lang string, confidence double")
    fields = pages.select("page_id", "title", "meta_description").where("coalesce(title, '') <> '' or coalesce(meta_description, '') <> ''")
    told_ = fields.mapInPandas(body, "page_id long, are array<string>").where("are is not null")
    return told_.join(pages.select("page_id", label_code("language").alias("label")), "page_id")


#: A site's name after the title proper.
BRAND = re.compile(r"\s+[|·–—-]\s+[^|·–—-]{1,30}$")
