"""Words, units and clause structure, shared by the text operators."""

from __future__ import annotations

import re

# Articles, pronouns, auxiliaries, conjunctions and other words that come with
# clauses, by language. What joins nouns into names of things in that language (of, de, en, para,
# pas, me) is left out, and a word counts for its own language only.
CLAUSE_WORDS = {
    "en": "the a an is are was were be been has have had will would can could should to on at by from and or but so not this that which its it as if when who than because although while doesn’t don’t",
    "de": "der die das den dem des ein eine einen einem ist sind war wird wurde werden hat haben soll muss und oder aber nicht auf zu als noch mehr weil dass während obwohl sich vor nach seit ohne unser diese dieser",
    "fr": "le la les un une est sont été a ont sera doit doivent et ou mais ne n’apparaît que qui se plus cette ce ces notre votre vos il elle encore vers depuis bien parce",
    "es": "el la los las un una es son fue ha han debe deben y o pero no que se más su sus nuestra nuestro todavía aunque porque desde según",
    "pt": "o a os as um uma é são foi tem deve devem e ou mas não que se mais sua seu nossa ainda embora porque desde segundo",
    "nl": "het een is zijn was wordt werd heeft hebben moet kan maar niet op te ter als nog meer naar door deze dit onze omdat hoewel terwijl zodat",
    "ar": "في من على إلى لا لم لن تم أن إن أنّ لأن كان كانت هو هي هذا هذه الذي التي مع عن بعد قبل عند منذ بين دون بينما كما ولذلك فإن لكن و أو قد حتى بحسب",
    "fa": "به را از در که این آن است بود شد شده می‌شود نمی‌شود می‌کند نمی‌کند باید با بر برای تا پس پیش چون و یا اما همچنین هنگام روی خیلی نیاز دارد",
}
#: The languages, one bit each, that a clause word belongs to.
MARKERS: dict[str, int] = {}
for _bit, _words in enumerate(CLAUSE_WORDS.values()):
    for _w in _words.split():
        MARKERS[_w] = MARKERS.get(_w, 0) | 1 << _bit


def marks(words: list[str]) -> list[int]:
    """Where the clause words of one language stand, the one that has most of them here."""
    at = [i for i, w in enumerate(words) if w in MARKERS]
    both = -1
    for i in at:
        both &= MARKERS[words[i]]
    if both:
        return at
    found = [MARKERS[words[i]] for i in at]
    bit = max((1 << k for k in range(len(CLAUSE_WORDS))), key=lambda b: sum(m & b > 0 for m in found))
    return [i for i, m in zip(at, found) if m & bit]


TERMINATORS = ".!?؟…。"
UNIT_BREAK = re.compile(r"[.!?؟…。][\"”»’)]*\s|\n")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
WORD = re.compile(r"\w(?:[\w’'‌\-]*\w)?")


def units(text: str) -> list[str]:
    """Sentences and lines of a text with what ends them, in order, without empty ones."""
    out, at = [], 0
    for m in UNIT_BREAK.finditer(text):
        end = m.end()
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return [u for u in out if u and not u.isspace()]
