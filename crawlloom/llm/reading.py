"""Reading level of each document (p10).

Method: a Rasch-style model. A text of level t meets a word of difficulty b with probability
s(t - b), s the logistic function; at the estimates, meetings and failures balance for every
word and every text. Levels that reviewers gave hold the scale: a reviewed text is drawn to its
level. Difficulties and levels are estimated in turn (alternating Newton steps), each step one
aggregation over (text, word) counts: sums for words by word, sums for texts by text, combined
before the shuffle.

Rounds go on until no difficulty moves by more than TOLERANCE.

Every document then gets its own latent level: with the difficulties held, the point at which
meetings and failures balance over all its words, each weighed by how narrow the range of texts is
that it occurs in. Levels of sentences come from the same words and weights, and a document is at
the level of most of its sentences. That pass sees every document and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crawlloom.llm.clauses import ADDRESS, WORD
from crawlloom.llm.encoding import plain_repair
from crawlloom.llm.language import Profiles, by_language, label_code
from crawlloom.session import stage

#: Reviewed texts the model is fitted on at most (by hash of doc_id); its words are theirs.
MOST_TEXTS = 20_000
# Words, and what ends a sentence or line.
PIECE = re.compile(WORD.pattern + r"|[.!?؟…][\"”»’)]*\s|[\r\n]")
BREAKS = frozenset(".!?؟…\r\n")
ANCHOR, RIDGE = 1.0, 0.5
#: Largest move of a difficulty in a round that ends the rounds, and rounds after which that must be.
TOLERANCE, MOST_ROUNDS = 0.05, 60
#: Words a sentence needs to be judged.
LEAST_WORDS = 3


@dataclass
class Levels:
    """Weighed difficulty and weight of words; the bounds between levels 1|2 and 2|3."""

    words: dict[str, tuple[float, float]]
    low: float
    high: float

    def sentences(self, text: str, words: list[tuple[float, float]] | None = None) -> list[float]:
        """Level of each sentence or line with at least LEAST_WORDS known words; all known words
        are added to ``words``."""
        low = plain_repair(text).lower()
        if "://" in low or "www." in low:
            low = ADDRESS.sub(" ", low)
        get, out = self.words.get, []
        known, above, below = 0, 0.0, 0.0
        for t in PIECE.findall(low):
            bw = get(t)
            if bw is not None:
                known += 1
                above += bw[0]
                below += bw[1]
                if words is not None:
                    words.append(bw)
            elif t[0] in BREAKS:
                if known >= LEAST_WORDS:
                    out.append(above / below)
                known, above, below = 0, 0.0, 0.0
        if known >= LEAST_WORDS:
            out.append(above / below)
        return out

    @cached_property
    def signs(self):
        """Finds the words that are harder than the bound of level 3, with their lengths."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, (above, below) in self.words.items():
            if above > self.high * below:
                a.add_word(w, len(w))
        a.make_automaton()
        return a

    def has_sign(self, low: str) -> bool:
        """Whether a text may hold such a word: short ones must stand for themselves."""
        if not len(self.signs):
            return False
        for end, n in self.signs.iter(low):
            if n > 6 or not (low[end - n : end - n + 1].isalnum() and end >= n or low[end + 1 : end + 2].isalnum()):
                return True
        return False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "signs"}

    def hard(self, text: str) -> bool:
        """Whether most sentences are at level 3. A mean beyond the bound needs a word beyond
        it, so a text that holds none of those words is settled by one linear search."""
        if not self.has_sign(plain_repair(text).lower()):
            return False
        got = self.sentences(text)
        return len(got) > 0 and sum(x > self.high for x in got) > 0.5 * len(got)

    def shares(self, text: str) -> tuple[int, float, float, float]:
        """(sentences judged, latent level, share above ``low``, share above ``high``)."""
        words: list[tuple[float, float]] = []
        got = self.sentences(text, words)
        n = len(got)
        if not n:
            return 0, 0.0, 0.0, 0.0
        return n, latent(words), sum(x > self.low for x in got) / n, sum(x > self.high for x in got) / n


def latent(words: list[tuple[float, float]], steps: int = 25) -> float:
    """The level at which weighed meetings and failures of words (difficulty x weight, weight)
    balance, by Newton steps from their mean; each step is bounded, and they end with the last
    that matters."""
    bw, w = np.array(words).T
    b = bw / w
    t = float(bw.sum() / w.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(b - t))
        move = float(np.clip((w * (p - 0.5)).sum() / (w * p * (1 - p)).sum(), -1, 1))
        t -= move
        if abs(move) < 1e-4:
            break
    return t


def tokens(text: str) -> list[str]:
    """Words of a text in lower case, without numbers and addresses."""
    low = text.lower()
    if "://" in low or "www." in low:
        low = ADDRESS.sub(" ", low)
    return [w for w in WORD.findall(low) if not w.isdigit()]


def reviewed(documents: DataFrame, labels: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, text, level): reviewed texts in ``lang`` with the mean of their levels, -1 to 1."""
    given = labels.where((label_code("reviewed_lang") == lang) & F.col("reading_level").between(1, 3)).groupBy("doc_id").agg((F.avg("reading_level") - 2).alias("level"))
    n = given.count()
    if n > MOST_TEXTS:
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1e6 * MOST_TEXTS / n))
    return documents.select("doc_id", "text").where("text is not null").join(given, "doc_id").dropDuplicates(["doc_id"])


def reviewed_each(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, doc_id, text, level): ``reviewed`` for every language that reviewers name."""
    lang = label_code("reviewed_lang").alias("lang")
    given = labels.where(F.col("reading_level").between(1, 3)).groupBy(lang, "doc_id").agg((F.avg("reading_level") - 2).alias("level")).where("lang is not null")
    most = {r["lang"]: MOST_TEXTS / r["count"] for r in given.groupBy("lang").count().collect() if r["count"] > MOST_TEXTS}  # a row a language
    if most:
        rate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(most.items()) for x in kv]), F.col("lang")), F.lit(1.0))
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < 1e6 * rate)
    return documents.select("doc_id", "text").where("text is not null").join(given, "doc_id").dropDuplicates(["lang", "doc_id"])


def fit(texts: DataFrame) -> Levels:
    """Estimate from (doc_id, text, level); without texts every level is 2."""
    return _fitted(texts, []).get(None) or Levels({}, 0.0, 0.0)


def fit_each(texts: DataFrame) -> dict[str, Levels]:
    """A model for each language of (lang, doc_id, text, level), all estimated in the same steps."""
    return _fitted(texts, ["lang"])


def _fitted(texts: DataFrame, by: list[str]) -> dict[str | None, Levels]:
    """Models by the value of the column named in ``by``, or one model under None."""
    texts = stage(texts, "reviewed")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *k, t in zip(*(b[c] for c in [*by, "doc_id", "text"])):
                seen: dict[str, int] = {}
                for w in tokens(plain_repair(t)):
                    seen[w] = seen.get(w, 0) + 1
                rows += [(*k, w, n) for w, n in seen.items()]
            yield pd.DataFrame(rows, columns=[*by, "doc_id", "word", "n"])

    text, word = [*by, "doc_id"], [*by, "word"]
    met = stage(texts.select(*text, "text").mapInPandas(counts, "".join(f"{c} string, " for c in by) + "doc_id long, word string, n long"), "met")
    level = texts.select(*text, "level", F.col("level").alias("t"))
    words = met.select(*word).distinct().withColumn("b", F.lit(0.0))

    def off(t: str, b: str):  # how far meetings are from balance, and its slope
        p = 1 / (1 + F.exp(F.col(b) - F.col(t)))
        return F.col("n") * (p - 0.5), F.col("n") * p * (1 - p)

    for n in range(MOST_ROUNDS):
        joined = met.join(level, text).join(words, word)
        g, h = off("t", "b")
        summed = joined.groupBy(*word, "b").agg(F.sum(g).alias("g"), F.sum(h).alias("h"))
        move = (F.col("g") - RIDGE * F.col("b")) / (F.col("h") + RIDGE)
        seen = Observation()
        words = stage(summed.select(*word, (F.col("b") + move).alias("b"), F.abs(move).alias("move")).observe(seen, F.max("move").alias("most")).drop("move"), "difficulty")
        joined = met.join(level, text).join(words, word)
        mean = joined.groupBy(*text, "level", "t").agg((F.sum(g) / F.sum("n")).alias("g"), (F.sum(h) / F.sum("n")).alias("h"))
        level = stage(mean.select(*text, "level", (F.col("t") - (F.col("g") + ANCHOR * (F.col("t") - F.col("level"))) / (F.col("h") + ANCHOR)).alias("t")), "levels")
        if (seen.get["most"] or 0.0) < TOLERANCE:
            break
    else:
        raise RuntimeError(f"difficulties still move after {MOST_ROUNDS} rounds")
    spread = met.join(level, text).groupBy(*word).agg(F.count("*").alias("texts"), (F.sum(F.col("n") * F.col("t") * F.col("t")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("t")) / F.sum("n"), F.lit(2))).alias("v"))
    kept = words.join(spread, word).where("texts >= 2")
    models: dict[str | None, Levels] = {}
    for r in kept.collect():
        weight = 1.0 / (max(0.0, float(r["v"])) + 0.05)
        models.setdefault(r[by[0]] if by else None, Levels({}, 0.0, 0.0)).words[r["word"]] = (float(r["b"]) * weight, weight)
    for k, model in models.items():
        model.low, model.high = calibrated(texts.where(F.col(by[0]) == k) if by else texts, model)
    return models


def calibrated(texts: DataFrame, model: Levels) -> tuple[float, float]:
    """Bounds between levels: where most sentences of reviewed texts fall on the right side
    most often; the middle of the best stretch of a grid over all sentence levels."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    grid = np.linspace(-1.5, 1.5, 121)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        right = np.zeros((2, len(grid)))
        for b in batches:
            for t, level in zip(b["text"], b["level"]):
                got = m.sentences(t)
                if got:
                    over = (np.array(got)[:, None] > grid[None, :]).mean(0) > 0.5
                    right[0] += over == (level > -0.5)
                    right[1] += over == (level > 0.5)
        yield pd.DataFrame({"i": list(range(len(grid))) * 2, "k": [0] * len(grid) + [1] * len(grid), "n": right.ravel()})

    rows = texts.mapInPandas(body, "i int, k int, n double").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
    out = []
    for k in (0, 1):
        n = np.zeros(len(grid))
        for r in rows:
            if r["k"] == k:
                n[r["i"]] = r["n"]
        best = np.flatnonzero(n == n.max())
        out.append(float(grid[best[len(best) // 2]]) if n.max() else 0.0)
    return out[0], out[1]


def levels(documents: DataFrame, model: Levels) -> DataFrame:
    """(doc_id, n_sentences, latent_level, level): of every document; level is null where no
    sentence can be judged (null, empty or too short texts)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            got = [m.shares(t) if t else (0, 0.0, 0.0, 0.0) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_sentences": [g[0] for g in got],
                    "latent_level": [round(g[1], 4) for g in got],
                    "level": pd.array([None if not g[0] else 3 if g[3] > 0.5 else 2 if g[2] > 0.5 else 1 for g in got], dtype="Int32"),
                }
            )

    return documents.select("doc_id", "text").mapInPandas(body, "doc_id long, n_sentences int, latent_level double, level int")


def levels_each(documents: DataFrame, models: dict[str, Levels], profiles: Profiles) -> DataFrame:
    """``levels`` of every document, whatever its languages: each text is judged by the model of
    its language. In a mixture each sentence is, one that can't be told going with those before
    it. Level is null where no sentence can be judged, also for lack of reviews in a language."""
    shared = documents.sparkSession.sparkContext.broadcast((models, profiles))
    names = ["doc_id", "n_sentences", "latent_level", "level"]

    def judged(parts: list[tuple[str, str]], models: dict[str, Levels]) -> tuple:
        n, total, middle, high = 0, 0.0, 0.0, 0.0
        for lang, text in parts:
            if lang in models:
                k, mean, m, h = models[lang].shares(text)
                n, total, middle, high = n + k, total + k * mean, middle + k * m, high + k * h
        if not n:
            return 0, 0.0, None
        return n, round(total / n, 4), 3 if 2 * high > n else 2 if 2 * middle > n else 1

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, p = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 512):
                b = whole.iloc[lo : lo + 512]
                rows = [(i, *judged(parts, models)) for i, parts in zip(b["doc_id"], by_language(b["text"], p))]
                out = pd.DataFrame(rows, columns=names)
                out["level"] = out["level"].astype("Int32")
                yield out

    return documents.select("doc_id", "text").mapInPandas(body, "doc_id long, n_sentences int, latent_level double, level int")


def hard(documents: DataFrame, model: Levels) -> DataFrame:
    """(doc_id) of the documents at level 3: the same as ``levels`` says, found sooner."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            yield b.loc[[bool(t) and m.hard(t) for t in b["text"]], ["doc_id"]]

    return documents.select("doc_id", "text").mapInPandas(body, "doc_id long")
