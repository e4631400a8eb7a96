"""Template residue and error-page text (p7).

Method: lines are normalised and counted by host; those that recur over a host are
boilerplate and are subtracted; a record is found if what remains of it contains evidence:
unfilled placeholders, null values, filler, error or access messages, or notices that scripts
are needed. Evidence must stand for itself: quoted text, and sentences about templates, are
none, and messages count only where little else remains.

A recurrent line that is evidence itself isn't boilerplate: a field, filler or error message
stays however many records have it. A notice about scripts (or a null value) recurs on sound
pages as well, so it counts if hardly any words of the record's own, or recurrent sentences,
stand beside it.

Counting shuffles 20 bytes a line, combined before the shuffle, so a line that every record of a
host has is no hot task. Boilerplate goes to the texts while it is small (its size is checked), and
beyond that is joined by host and line, hot lines split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.functions.urls import host
from crawlloom.llm.clauses import TERMINATORS, WORD, units
from crawlloom.llm.encoding import plain_repair
from crawlloom.session import stage
from crawlloom.skew import hot_keys, salted

#: A line is boilerplate on a host if this share of its records, and this many, have it.
RECURRENT_SHARE, RECURRENT_RECORDS = 0.2, 5
#: Words beside error messages or script notices up to which they stand in place of content.
FEW_WORDS = 14
#: Words beside a recurrent script notice up to which the record is no more than that notice.
OWN_WORDS = 5
#: Lines of boilerplate (16 bytes and a host) that are broadcast at most.
MOST_LINES = 200_000

# How template engines mark a field; then names of fields, for single brackets.
PLACEHOLDER = re.compile(
    r"\{\{[{#]?\s*[\w.]+\s*\}?\}\}|\{%[-\s]*[\w.]+[-\s]*%\}|[#$]\{\s*[\w.]+\s*\}|<[%?]=?\s*\$?[\w.]+\s*;?\s*[%?]>|%%[\w.]+%%|\[\[\s*[\w.]+\s*\]\]"
    r"|\*\|[\w.]+\|\*|(?<!\w)__[A-Za-z][\w.]*?__(?!\w)|@@[\w.]+@@|\{#[\w.]+\}|(?<!\w)%[A-Za-z_][\w.]*%|\{([A-Za-z_][\w.]*)\}|\[([A-Za-z_][\w.]*)\]"
)
FIELDS = frozenset("title name author brand category description headline price company content body text url link image date user email phone city country product sku excerpt heading subtitle keyword keywords site page".split())

# Words of placeholder Latin; longer words also count by their first letters.
LOREM = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum
    fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum mattis viverra
    porta pretium rutrum egestas fermentum sodales ullamcorper velum vestibulum pellentesque curabitur vivamus phasellus mauris""".split()
)
LOREM_STEMS = frozenset(w[:5] for w in LOREM if len(w) >= 5)

# Phrases by kind; each is matched against a whole sentence or line in lower case.
FILLER = re.compile(
    r"your (?:text|content|title|copy) (?:goes )?here|^(?:insert|enter|add|put) (?:your |a |the )?(?:\w+ ){0,3}here\b|^add a (?:short )?description|^type something about|^sample (?:paragraph|text)\b[,;:.]"
    r"|^dummy (?:content|text)\b|^this is (?:a |an |just )?(?:placeholder|sample|dummy)\b|^todo\b|replace before publishing"
    r"|hier (?:steht|kommt) (?:ihr|dein) text|^blindtext\b|^bitte beschreibung|^platzhalter|^beispieltext"
    r"|^votre texte ici|^(?:paragraphe|texte) d.exemple|^ajoutez une description|^escriba aquí|^texto de ejemplo|^añada una descripción"
    r"|^escreva aqui|^texto de exemplo|^adicione uma descrição|^hier komt (?:uw|je) tekst|^voorbeeldtekst|^voeg een omschrijving"
    r"|هذا نص تجريبي|^أضف النص|^اكتب وصف|این متن آزمایشی|^متن خود را"
)
SCRIPTS = re.compile(
    r"enable javascript|javascript is (?:off|disabled|required|not enabled)|requires javascript|javascript must be|(?:turn|switch) on (?:java)?scripts?|^switch it on and reload"
    r"|does not run scripts|scripts and cookies must be|^checking your browser|aktivieren sie javascript|nur mit eingeschalteten skripten|activer javascript"
    r"|scripts doivent être autorisés|^active javascript|permitir (?:los )?scripts|habilite javascript|^ative o javascript|^zet javascript aan|alleen met scripts"
    r"|تفعيل جافاسكربت|تشغيل السكربتات|جاوااسکریپت را فعال|اسکریپت.?ها روشن"
)
ERRORS = re.compile(
    r"something went wrong(?: on our end)?|(?:the )?page you (?:asked for|requested) does not exist(?: or was moved)?|(?:page|file|document) not found|nothing here|access (?:is )?denied|forbidden|bad gateway|gateway time-?out"
    r"|internal server error|service (?:is )?(?:temporarily )?unavailable|too many requests|slow down|your session has expired|please sign in again|this account has been suspended|down for maintenance|under maintenance"
    r"|database connection could not be made|backend fetch failed|an unexpected (?:problem|error) occurred(?: while loading this \w+)?"
    r"|(?:la |a |die |de )?(?:page|página|seite|pagina) (?:demandée|solicitada|pedida|gevraagde)(?: \S+)? (?:n.existe plus|no existe|não existe|bestaat niet(?: meer)?)|(?:die )?angeforderte seite (?:existiert nicht(?: mehr)?|gibt es nicht mehr)|(?:de )?gevraagde pagina bestaat niet(?: meer)?"
    r"|seite nicht gefunden|zugriff verweigert|interner serverfehler|wir führen gerade wartungsarbeiten durch|wartungsarbeiten|page introuvable|accès refusé|erreur interne(?: du serveur)?|(?:site )?en maintenance"
    r"|página no encontrada|(?:la )?página solicitada (?:ya )?no existe|acceso denegado|error interno(?: del servidor)?|(?:sitio )?en mantenimiento|página não encontrada|(?:a )?página pedida já não existe|acesso negado"
    r"|erro interno(?: do servidor)?|(?:site )?em manutenção|pagina niet gevonden|toegang geweigerd|interne serverfout|(?:site )?in onderhoud|حدث خطأ في الخادم|خطأ في الخادم|الصفحة غير موجودة|تعذر العثور على الصفحة(?: المطلوبة)?"
    r"|ليس لديك صلاحية للوصول|الموقع تحت الصيانة|صفحه پیدا نشد|خطای داخلی(?: سرور)?|دسترسی (?:ندارید|مجاز نیست)|سایت در حال تعمیر است"
)
WAY_BACK = re.compile(r"(?:go )?back to (?:the )?(?:start|home) ?page|zurück zur startseite|retour à l.accueil|volver al inicio|voltar ao início|terug naar het begin|العودة إلى الصفحة الرئيسية|بازگشت به صفحه.ی نخست|\bref: ?[0-9a-f]+")
NULLS = re.compile(r"\(?(?:null|undefined|nan|none|nil|n/a|\[object object\]|untitled(?:[ -]?(?:document|page|\d+))?|no title|\(no title\)|no description|new (?:page|document)|default title|page title)\)?")
#: Words of sentences that speak about templates.
ABOUT = re.compile(r"\b(?:template|templates|variable|variables|written|write|syntax|manual|themes?|checklist|vorlage|variable|modèle|plantilla|sjabloon|modelo de)\b|قالب|الگوی", re.IGNORECASE)
QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|‘[^’\n]*’(?!\w)")
TITLE_BREAK = re.compile(r"\s+[|·–—:/»-]\s+|\s*[|·]\s*")
_TRIM = " \t\r\n.!?:;,-–—|·()[]#*•"


def placeholders(text: str) -> int:
    """Unfilled fields; in single brackets only what is spelled like a field."""
    n = 0
    for m in PLACEHOLDER.finditer(text):
        name = m.group(1) or m.group(2)
        n += name is None or "." in name or "_" in name or name.isupper() and len(name) > 2 or name.lower() in FIELDS
    return n


def is_lorem(unit: str) -> bool:
    words = [w.lower() for w in WORD.findall(unit)]
    hits = [w for w in words if w in LOREM or w[:5] in LOREM_STEMS and len(w) >= 5]
    return len(words) >= 3 and len(hits) >= 0.6 * len(words) and (len(hits) >= 3 and sum(len(w) >= 4 for w in hits) >= 2)


def message(unit: str) -> bool:
    """Whether a unit is an error message and hardly anything else but a way back."""
    low = WAY_BACK.sub(" ", unit.lower())
    if not ERRORS.search(low):
        return False
    rest = re.sub(r"\b(?:http|error|fehler|erreur|erro|fout|خطأ|خطای|the|we’re|we're|sorry|status|code|oops|ref)\b|\d+", " ", ERRORS.sub(" ", low))
    return len(WORD.findall(rest)) <= 2


# What a message is put together from, beside the phrases above: what was asked for,
# that it failed, whom it asks to prove, and how interpreters report a fault.
ASKED = re.compile(
    r"\b(?:pages?|urls?|files?|documents?|sites?|websites?|requests?|resources?|server|addresses|address|content|items?|looking for|seite|dokument|datei|anfrage|ressource|fichier|ressource|requête|página|archivo|recurso|solicitud|arquivo|ficheiro|pagina|bestand|verzoek|documento|risorsa|richiesta|strona|plik|sida|sivu|stránka|страниц\w*|файл|сервер)\b"
    r"|صفحة|الصفحة|الملف|الخادم|صفحه|فایل|سرور|ページ|サーバ|页面|頁面|网站|服务器|페이지|서버"
)
FAILS = re.compile(
    r"\b(?:(?:was|were|is|are|be|been)? ?not (?:be )?(?:found|available|exist)|does(?:n['’]t| not) exist|no longer (?:exists?|available)|(?:could|can)(?:n['’]t|not| not) (?:be (?:found|reached|displayed|loaded)|find|load|open|display)|unavailable|timed out|nicht (?:gefunden|verfügbar|erreichbar|vorhanden)|existiert nicht|introuvable|n.existe (?:pas|plus)|no (?:existe|se encuentra|se ha encontrado|está disponible)|não (?:existe|encontrad\w+|está disponível)|bestaat niet|niet (?:gevonden|beschikbaar)|non (?:esiste|trovat\w+|disponibile)|nie (?:istnieje|znaleziono)|finns inte|hittades inte|ei löydy|nenalezena|не (?:найден\w*|существует|доступн\w*))"
    r"|غير (?:موجود|متاح)|لم يتم العثور|یافت نشد|پیدا نشد|見つかりません|存在しません|找不到|不存在|無法|찾을 수 없"
    r"|(?:verify|confirm|prove) (?:that )?you(?:.re| are) (?:a )?(?:human|not a robot)|(?:fatal|parse) error: |uncaught \w*(?:exception|error)|stack trace:|on line \d+|traceback \(most recent call last\)|\b[45]\d\d (?:error|forbidden|not found|bad gateway|internal)"
)
NEEDS = re.compile(r"\b(?:enable|allow|activate|turn|switch|require[sd]?|needs?|must|disabled?|off|without|aktiv\w+|ativ\w+|activ\w+|habilit\w+|inschakel\w+|zet|attiv\w+|włącz\w*|aktivera|включит\w*)\b|有効|启用|啟用|필요|활성|فعال|تفعيل")


def composed(low: str) -> str | None:
    """A message or notice that none of the phrases has, told by what it is put together from:
    something asked for and its failure, a proof of being human, an interpreter's fault, or
    scripts and the need for them. In a text these count only where hardly anything else stands."""
    if "javascript" in low and NEEDS.search(low):
        return "scripts"
    m = FAILS.search(low)
    if m and (ASKED.search(low) or not m.group()[:1].isalpha() or any(x in m.group() for x in ("error", "human", "robot", "trace", "on line", "uncaught"))):
        return "error"
    return None


# Any filler phrase above contains one of the first, any notice or message one of the second.
FILLER_HINTS = (
    "text here|text goes|content here|content goes|title here|title goes|copy here|copy goes| here|add a |type something|sample p|sample t|dummy |placeholder|sample|todo|before publishing"
    "|ihr text|dein text|blindtext|bitte beschreibung|platzhalter|beispieltext|votre texte|exemple|ajoutez une|escriba aqu|de ejemplo|añada una|escreva aqui|de exemplo|adicione uma"
    "|uw tekst|je tekst|voorbeeldtekst|voeg een|هذا نص|أضف النص|اكتب وصف|متن آزمایشی|متن خود"
)
MESSAGE_HINTS = (
    "javascript|scripts|skript|جافاسكربت|السكربتات|جاوااسکریپت|اسکریپت|on script|switch it on|checking your browser|went wrong|not exist|not found|nothing here|denied|forbidden|bad gateway|gateway time"
    "|server error|unavailable|too many requests|slow down|has expired|sign in again|suspended|maintenance|database connection|backend fetch|unexpected|seite nicht|zugriff|serverfehler|wartungsarbeiten"
    "|introuvable|refusé|erreur interne|no encontrada|no existe|denegado|error interno|mantenimiento|não encontrada|não existe|negado|erro interno|manutenção|niet gevonden|geweigerd|serverfout|onderhoud"
    "|خطأ في|غير موجودة|تعذر|صلاحية|الصيانة|پیدا نشد|خطای داخلی|دسترسی|در حال تعمیر|existe plus|existiert nicht|gibt es nicht|bestaat niet"
)
# What is failed with (FAILS) contains one of these.
FAIL_HINTS = (
    "not found|not available|not exist|not be found|not be available|doesn't exist|doesn’t exist|no longer exist|no longer available|unavailable|timed out"
    "|nicht gefunden|nicht verfügbar|nicht erreichbar|nicht vorhanden|existiert nicht|introuvable|existe pas|existe plus|no existe|no se encuentra|no se ha encontrado|no está disponible"
    "|não existe|não encontrad|não está disponível|bestaat niet|niet gevonden|niet beschikbaar|non esiste|non trovat|non disponibile|nie istnieje|nie znaleziono|finns inte|hittades inte|ei löydy|nenalezena"
    "|не найден|не существует|не доступн|غير موجود|غير متاح|لم يتم العثور|یافت نشد|پیدا نشد|見つかりません|存在しません|找不到|不存在|無法|찾을 수 없"
    "|verify you|verify that you|confirm you|confirm that you|prove you|prove that you|fatal error: |parse error: |uncaught |stack trace:|on line |traceback (most recent|forbidden|bad gateway|0 error|1 error|2 error|3 error|4 error|5 error|6 error|7 error|8 error|9 error|0 internal|1 internal|2 internal|3 internal|4 internal|5 internal|6 internal|7 internal|8 internal|9 internal"
)
FIELD_SIGNS = ("{", "[", "%", "@@", "__", "<?", "*|")


@lru_cache(maxsize=1)
def _hints():
    import ahocorasick

    def automaton(hints: str):
        a = ahocorasick.Automaton()
        for h in hints.split("|"):
            a.add_word(h, h)
        a.make_automaton()
        return a

    latin = "|".join(sorted(LOREM_STEMS | {w for w in LOREM if len(w) == 4}))
    cannot = "|".join(f"{a} {b}" for a in ("can't", "can’t", "cannot", "can not", "couldn't", "couldn’t", "couldnot", "could not") for b in ("be found", "be reached", "be displayed", "be loaded", "find", "load", "open", "display"))
    return automaton(FILLER_HINTS), automaton(f"{MESSAGE_HINTS}|{FAIL_HINTS}|{cannot}"), automaton(latin)


def _latin(low: str, signs) -> bool:
    """Whether a text in lower case has the words that ``is_lorem`` asks of one of its units: three
    in all, two of them with four letters; without quotes, also two that stand together."""
    found = signs.iter(low)
    if next(found, None) is None or next(found, None) is None:
        return False
    hits = [w in LOREM or len(w) >= 5 and w[:5] in LOREM_STEMS for w in WORD.findall(low)]
    return sum(hits) >= 3 and (any(q in low for q in "“„«\"‘") or any(a and b for a, b in zip(hits, hits[1:])))


def possible(text: str) -> bool:
    """A look at a whole text in a few linear passes: False only if it can't hold evidence."""
    if any(s in text for s in FIELD_SIGNS) and PLACEHOLDER.search(text):
        return True
    low = text.lower()
    filler, messages, latin = _hints()
    return any(True for _ in filler.iter(low)) or any(True for _ in messages.iter(low)) or _latin(low, latin)


def null_value(text: str, is_field: bool) -> bool:
    """Whether a text is a null value or default title; in a field, at most two words (a site's
    name) may stand beside it, however long they are."""
    bare = text.strip()
    parts = [p for p in (TITLE_BREAK.split(bare) if is_field else [bare]) if p]
    return any(NULLS.fullmatch(p.strip(" .!").lower()) and sum(len(q.split()) for j, q in enumerate(parts) if j != i) <= 2 for i, p in enumerate(parts))


def evidence(text: str, is_field: bool = False) -> str | None:
    """The kind of residue a text has, or None: placeholder, null, filler, error, scripts.

    ``is_field``: a title or description, where a site's name may stand beside the content.
    """
    if not text or text.isspace():
        return None
    text = plain_repair(text)
    if null_value(text, is_field):
        return "null"
    if not possible(text):
        return None
    words = telling = 0
    kind = None
    for unit in units(text):
        if ABOUT.search(unit) and not (FILLER.search(unit.lower().strip(_TRIM)) and len(unit) < 60):
            words += len(WORD.findall(unit))
            continue
        open_ = QUOTED.sub(" ", unit)
        if placeholders(open_):
            return "placeholder"
        low = open_.lower().strip(_TRIM)
        if FILLER.search(low) and len(low) < 90 or is_lorem(open_):
            return "filler"
        pieces = TITLE_BREAK.split(open_) if is_field else [open_]
        if any(SCRIPTS.search(p.lower().strip(_TRIM)) for p in pieces) and len(low) < 110:
            telling, kind = telling + 1, kind or "scripts"
        elif any(message(p) for p in [open_, *pieces]) and len(low) < 110:
            telling, kind = telling + 1, kind or "error"
        elif not is_field and len(WORD.findall(low)) <= FEW_WORDS and (made := composed(low)):
            telling, kind = telling + 1, kind or made
        else:
            words += len(WORD.findall(unit))
    return kind if telling and words <= FEW_WORDS else None


@lru_cache(maxsize=4096)
def line_evidence(line: str) -> str | None:
    """``evidence`` of a line that recurs, judged once in a process."""
    return evidence(line)


def without_boilerplate(text: str, recurrent: set[int]) -> str | None:
    """The kind of residue of a text, after recurrent lines that show none are left out."""
    rest, notices, own = [], [], 0
    for x in text.split("\n"):
        if not x or x.isspace():
            rest.append(x)
            continue
        known = line_key(x) in recurrent
        if known and (kind := line_evidence(x)):
            (notices if kind in ("scripts", "null") else rest).append(x)
            continue
        if not known:
            rest.append(x)
        if own <= OWN_WORDS and not (known and x.rstrip()[-1] not in TERMINATORS):
            own += len(WORD.findall(WAY_BACK.sub(" ", x.lower())))
    kind = evidence("\n".join(rest))
    if kind is None and notices and own <= OWN_WORDS:
        return evidence("\n".join(notices)) or line_evidence(notices[0])
    return kind


_DIGIT = re.compile("[0-9]")


def line_key(line: str) -> int:
    """64-bit key of a normalised line: lower case, digits as 0, white space collapsed."""
    import xxhash

    h = xxhash.xxh64_intdigest(" ".join(_DIGIT.sub("0", line.lower()).split()))
    return h - (1 << 64) if h >> 63 else h


def line_numbers(documents: DataFrame) -> DataFrame:
    """(id, host, line): keys of the distinct lines of each record that aren't empty."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, h, k) for i, h, t in zip(b["id"], b["host"], b["text"]) for k in {line_key(x) for x in t.split("\n") if x and not x.isspace()}]
            yield pd.DataFrame(rows, columns=["id", "host", "line"])

    return documents.where("text is not null").select("id", "host", "text").mapInPandas(body, "id long, host string, line long")


def boilerplate(lines: DataFrame, records: DataFrame) -> DataFrame:
    """(host, line) of lines in a fifth of a host's records, and at least five."""
    counted = lines.groupBy("host", "line").count().where(F.col("count") >= RECURRENT_RECORDS)
    totals = records.groupBy("host").agg(F.count("*").alias("n"))
    return counted.join(totals, "host").where(F.col("count") >= RECURRENT_SHARE * F.col("n")).select("host", "line")


def residue(documents: DataFrame, corpus: DataFrame | None = None, most_lines: int = MOST_LINES) -> DataFrame:
    """(id, kind) of the documents (id, host, text) that show residue.

    Boilerplate is counted over ``corpus``, all documents of the same shape (by default the
    documents given). Null, empty and white texts show none. Repeated rows are rows of their own.
    Up to ``most_lines`` lines of boilerplate are sent to where the texts lie; of more, each
    record's own are joined to it, lines of many records split. The result is the same.
    """
    corpus = documents if corpus is None else corpus
    lines = stage(boilerplate(line_numbers(corpus), corpus), "boilerplate")
    n = lines.count()
    texts = documents.where("text is not null").select("id", "host", "text")
    shared = None
    if n <= most_lines:  # the usual case: texts are judged where they lie
        by_host: dict[str, set[int]] = {}
        for r in lines.collect():  # at most most_lines rows
            by_host.setdefault(r["host"], set()).add(r["line"])
        shared = documents.sparkSession.sparkContext.broadcast(by_host)
        drop = texts.withColumn("drop", F.lit(None).cast("array<long>"))
    else:
        every = line_numbers(documents)
        a, b = salted(every, lines, ["host", "line"], hot_keys(every, ["host", "line"]), "id")
        own = a.join(b, ["host", "line", "_salt"], "left_semi").groupBy("id").agg(F.collect_set("line").alias("drop"))
        drop = texts.join(own, "id", "left")

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value if shared is not None else {}
        for b in batches:
            kinds = []
            for h, t, d in zip(b["host"], b["text"], b["drop"]):
                own = known.get(h) if shared is not None else set(map(int, d)) if d is not None else None
                kinds.append(None if not t else without_boilerplate(t, own) if own else evidence(t))
            out = pd.DataFrame({"id": b["id"], "kind": kinds})
            yield out[out["kind"].notna()]

    return drop.mapInPandas(body, "id long, kind string")


def _judged_fields():
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [evidence(t, True) if t else None for t in b["text"]]
            out = pd.DataFrame({"id": b["id"], "kind": kinds})
            yield out[out["kind"].notna()]

    return body


def field_residue(pages: DataFrame) -> DataFrame:
    """(id, kind) of pages (page_id, title, meta_description): one row a field that shows
    residue. A field is content as a whole, so nothing of it is boilerplate."""
    fields = pages.select(F.col("page_id").alias("id"), F.explode(F.array("title", "meta_description")).alias("text")).where("text is not null")
    return fields.mapInPandas(_judged_fields(), "id long, kind string")


def corpus_lines(documents: DataFrame) -> DataFrame:
    """Documents as (id, host, text); a null host is taken from the address."""
    return documents.select(F.col("doc_id").alias("id"), F.coalesce("host", host("url"), F.lit("")).alias("host"), "text")
