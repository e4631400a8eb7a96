"""Keyword-stuffed and link-list pages (p1).

Method: a suffix automaton over the words of each text gives, at every word, the longest
stretch ending there that occurs elsewhere too; the union of these maximal repeats is what
repetition covers. Ordinary text repeats itself as well, so coverage only counts where clause
structure is missing: in stretches without articles, auxiliaries, pronouns or conjunctions of
their language. A text is found if most of it lacks clauses and most of that is repeated or is
addresses, or if its phrases come back so densely that stray clause words can't count.

Each text is one row of an Arrow batch; time and memory are linear in its words. Only where the
share without clauses lies near the bound does the page decide, by its links a word; those few
rows are joined to their pages, and nothing else is shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.llm.clauses import ADDRESS, TERMINATORS, WORD, marks, units
from crawlloom.llm.encoding import plain_repair
from crawlloom.llm.residue import ERRORS, FIELD_SIGNS, FILLER, PLACEHOLDER, SCRIPTS, is_lorem
from crawlloom.session import stage

#: Words judged together where a unit is long; a clause word within reach marks them all.
REACH = 8
#: Characters that an address counts as, however long it is.
ADDRESS_CHARS = 12
#: Fewest words without clause structure that can make a page.
LEAST_WORDS = 12
MOSTLY, COVERED = 0.5, 0.5
#: Share of doubtful words in repeated phrases from which they count as keywords.
PHRASES = 0.6
#: Share of words that end a phrase of three said within the last NEAR words, from which a text
#: of DENSE_WORDS or more is stuffed whatever its clause words.
DENSE, NEAR, DENSE_WORDS = 0.7, 60, 40
#: Shares without clauses between which the page decides, and its links a word from which it is a list.
DOUBT, LINKED = (0.45, 0.6), 0.5

MEASURES = "doc_id long, page_id long, n_words int, bare_share double, covered_share double, address_share double, bare_words int, dense_share double"


def repeated(words: list) -> list[int]:
    """For each position, the words of the longest stretch ending there that also ends elsewhere.

    Builds the suffix automaton: a state for each class of stretches with the same ends, its
    suffix link and longest length. A prefix' state is repeated itself if another state links
    to it; else its link is the longest repeated suffix.
    """
    step: list[dict] = [{}]
    link, length, ends, last = [-1], [0], [], 0
    add_step, add_link, add_length, add_end = step.append, link.append, length.append, ends.append
    for n, w in enumerate(words, 1):
        new = len(link)
        add_step({})
        add_length(n)
        add_end(new)
        p = last
        last = new
        while True:
            out = step[p]
            if w in out:
                q = out[w]
                if length[q] == length[p] + 1:
                    add_link(q)
                    break
                twin = new + 1
                add_step(step[q].copy())
                add_length(length[p] + 1)
                add_link(twin)
                add_link(link[q])
                link[q] = twin
                while p >= 0:
                    out = step[p]
                    if out.get(w) != q:
                        break
                    out[w] = twin
                    p = link[p]
                break
            out[w] = new
            p = link[p]
            if p < 0:
                add_link(0)
                break
    linked = set(link)
    return [length[s] if s in linked else length[link[s]] for s in ends]


def dense(words: list[str], reach: list[int]) -> float:
    """Share of words that end a phrase of three that also ended within the last NEAR words;
    0 without a look where repeated phrases can't reach DENSE, or the text is short."""
    n = len(words)
    if n < DENSE_WORDS or len([r for r in reach if r > 2]) < DENSE * n:
        return 0.0
    last: dict[tuple, int] = {}
    near = 0
    for i, phrase in enumerate(zip(words, words[1:], words[2:])):
        near += i - last.get(phrase, -NEAR - 1) <= NEAR
        last[phrase] = i
    return near / n


def bare(unit: str, words: list[str]) -> list[int]:
    """Which words of a unit stand without clause structure: 1 yes, 0 no, 2 in doubt.

    A word has it if a clause word is within REACH words. A unit of four to forty words that
    ends like a sentence and has few separators is in doubt: text in a language that the
    clause words don't know, or keywords with full stops.
    """
    n = len(words)
    at = marks(words)
    if at and at[0] <= REACH and n - at[-1] <= REACH + 1 and (len(at) == 1 or max(b - a for a, b in zip(at, at[1:])) <= 2 * REACH + 1):
        return [0] * n
    if not at:
        shaped = 4 <= n <= 40 and unit.rstrip("\"”»’) \t\r\n")[-1:] in TERMINATORS and sum(map(unit.count, "|/;>#•")) * 5 <= n
        low = unit.strip(" -*•\r\n")
        other = is_lorem(unit) or len(unit) < 110 and any(p.search(low) for p in (FILLER, SCRIPTS, ERRORS))  # p7's matter
        return [0 if other else 2 if shaped else 1] * n
    out = [1] * n
    for m in at:
        for i in range(max(0, m - REACH), min(n, m + REACH + 1)):
            out[i] = 0
    return out


NOTHING = (0, 0.0, 0.0, 0.0, 0, 0.0)


def measure(text: str) -> tuple[int, float, float, float, int, float]:
    """(words, share of characters without clauses, of those repeated, of those in addresses,
    words without clauses, share of ``dense``); each address is a word, and addresses count as text without clauses,
    unfilled fields not at all. What is in doubt counts as without clauses if phrases of it keep
    coming back."""
    text = plain_repair(text)
    if any(sign in text for sign in FIELD_SIGNS):
        text = PLACEHOLDER.sub(" ", text)
    text = text.lower()
    addressed = "://" in text or "www." in text
    words: list[str] = []
    state: list[int] = []
    addresses = 0
    for unit in units(text):
        found = ADDRESS.findall(unit) if addressed else ()
        if found:
            addresses += len(found)
            unit = ADDRESS.sub(" ", unit)
        own = WORD.findall(unit)
        words += own
        # A few words beside an address are its label, not a sentence.
        state += [1] * len(own) if found and len(own) <= 6 * len(found) else bare(unit, own)
    chars = sum(map(len, words))
    address_chars = ADDRESS_CHARS * addresses
    if not chars and not address_chars:
        return NOTHING
    reach = repeated(words)
    close = dense(words, reach)
    if not any(state) and not address_chars:
        return len(words), 0.0, 0.0, 0.0, 0, close
    n_words = len(words) + addresses
    need = pair = phrases = 0
    covered = [False] * len(words)
    for i in range(len(words) - 1, -1, -1):
        r = reach[i]
        need = r if r >= need else need - 1
        pair = r if r > 1 and r >= pair else pair - 1
        covered[i] = need > 0
        phrases += pair > 0 and state[i] == 2
    doubt = phrases >= PHRASES * state.count(2)
    is_bare = [s == 1 or s == 2 and doubt for s in state]
    bare_chars = sum(len(w) for w, b in zip(words, is_bare) if b)
    held = sum(len(w) for w, b, c in zip(words, is_bare, covered) if b and c)
    without = bare_chars + address_chars
    return n_words, without / (chars + address_chars), (held + address_chars) / without if without else 0.0, address_chars / (chars + address_chars), sum(is_bare), close


NAMES = ("n_words", "bare_share", "covered_share", "address_share", "bare_words", "dense_share")


def measures(documents: DataFrame) -> DataFrame:
    """``MEASURES`` of each document's whole text; null texts count as empty."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on = gc.isenabled()
        gc.disable()  # automata have no cycles; looking for them again and again costs a tenth
        try:
            for b in batches:
                rows = [measure(t) if t else NOTHING for t in b["text"]]
                yield pd.DataFrame({"doc_id": b["doc_id"], "page_id": b["page_id"], **{k: [r[i] for r in rows] for i, k in enumerate(NAMES)}})
        finally:
            if on:
                gc.enable()

    return documents.select("doc_id", "page_id", "text").mapInPandas(body, MEASURES)


def stuffed(documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``measures`` with ``found``. Texts without enough words or addresses are never found.

    With ``pages`` (page_id, word_count, internal_links_count), texts whose share without
    clauses lies in DOUBT are found if their page has LINKED internal links a word or more; where
    the page or its counts are missing the bound MOSTLY holds, as it does without ``pages``."""
    m = measures(documents)
    enough = (F.col("bare_words") >= LEAST_WORDS) | (F.col("address_share") > 0.5) & (F.col("n_words") >= LEAST_WORDS)
    repeats = enough & (F.col("covered_share") >= COVERED)
    mostly = F.col("bare_share") > MOSTLY
    crowded = F.col("dense_share") >= DENSE
    if pages is None:
        return m.withColumn("found", crowded | repeats & mostly)
    m = stage(m.withColumn("doubt", ~crowded & repeats & F.col("bare_share").between(*DOUBT)), "measures")
    clear = m.where("not doubt").withColumn("found", crowded | repeats & mostly)
    doubtful = m.where("doubt")
    linked = (F.max("internal_links_count") >= LINKED * F.max("word_count")).alias("linked")
    facts = pages.where("internal_links_count is not null and word_count > 0").join(doubtful.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(linked)
    told = doubtful.join(facts, "page_id", "left").withColumn("found", F.coalesce("linked", mostly)).select(*clear.columns)
    return clear.unionByName(told).drop("doubt")


def with_page(scores: DataFrame, pages: DataFrame) -> DataFrame:
    """Scores beside what the crawl says of the page: its words, links and text share (null
    where the page row is missing). links_per_word is over the full page."""
    facts = pages.select("page_id", "word_count", "internal_links_count", "text_to_html_ratio").dropDuplicates(["page_id"])
    joined = scores.join(facts, "page_id", "left")
    return joined.withColumn("links_per_word", F.try_divide(F.col("internal_links_count").cast("double"), F.col("word_count").cast("double")))
