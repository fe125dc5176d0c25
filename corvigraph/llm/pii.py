"""Personal information in free text: finding it and putting typed placeholders in its place (problem 1).

Information-theoretic sanitisation. Emails, phone and identity numbers and addresses have a form that
tells them; names have none. What reveals a person is therefore estimated from the corpus: each term's
co-occurrence with the places where a text speaks of a person ("spoke with ...", "owner ...", titles)
against its occurrences at large gives its disclosure, the pointwise mutual information of term and
person over the information content of a person (at a fixed share of texts, PERSON), at most 1. Terms at or above a threshold reveal a
person wherever they stand, in any letter case; runs of them are names and are generalised to [NAME].
An exact check follows: names of diseases and signs ("X syndrome", "sign of X") stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import spread_join

THRESHOLD = 0.5
#: Disclosure from which a term belongs to a name if a term above THRESHOLD stands beside it.
BESIDE = 0.2
#: Share of texts that name a person, for the information of a person. A constant, so that no corpus moves the bar: of the
#: distinct strings of documents and reports of sf0.1 1.8 % name one. Half of that information (THRESHOLD) is 14 % of a term's texts.
PERSON = 0.02
#: Texts at that share that are added to every term's own, so that one sight of a term says less than many; what a cue counts
#: that other things than persons follow as well ("from ..."). A term seen once, after such a cue, stays below THRESHOLD.
SMOOTH, WEAK = 3.0, 0.5
#: Most revealing terms that are sent to every task; more are brought to the texts by joins.
MOST_SENT = 200_000
KINDS = ("name", "email", "phone", "id_number", "address")

# Words after which a text names a person; titles; words that join parts of a name.
CUES = [
    "attn", "besitzer", "besitzerin", "brought in by", "caller", "client", "client record", "copy", "doctor", "dr", "dueña", "dueño", "frau", "from", "halter", "halterin", "herr",
    "history per", "madame", "miss", "mme", "monsieur", "mr", "mrs", "ms", "o", "owner", "prof", "propietaria", "propietario", "propriétaire", "referred by", "señor", "señora",
    "signed", "spoke with", "tierärztin", "tierarzt", "vet", "veterinarian",
]
#: Cues of the list above that places, dates and things follow as well.
WEAK_CUES = ["copy", "from", "o", "signed"]
TITLES = ["dr", "frau", "herr", "madame", "miss", "mme", "monsieur", "mr", "mrs", "ms", "prof", "señor", "señora"]
JOINERS = ["da", "de", "del", "den", "der", "di", "dos", "la", "le", "ten", "ter", "van", "von", "zu"]
#: Words that lose their vowel before a name: not part of it.
ELIDED = ["c", "d", "j", "l", "m", "n", "qu", "s", "t"]
#: Words after or before an eponym that is a disease or sign.
EPONYM_AFTER = ["anomaly", "ataxia", "complex", "contracture", "disease", "disorder", "grade", "lesion", "maladie", "node", "nodes", "phenomenon", "reflex", "score", "sign", "syndrome", "test", "tumour", "krankheit", "syndrom", "síndrome", "enfermedad"]
EPONYM_BEFORE = ["enfermedad de", "maladie de", "morbus", "sign of", "signe de", "signo de", "syndrome de", "syndrome of", "síndrome de", "disease of", "test of"]
NUMBER_WORDS = ["zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

_W = r"[^\W\d_]"
_CAP = rf"[A-ZÀ-ÖØ-Þ]{_W}*(?:['’]{_W}+)?"
_PART = rf"(?:{_CAP}|[A-ZÀ-ÖØ-Þ]\.|(?:{'|'.join(JOINERS)})\b)"
_CUE = re.compile(rf"(?<!\w)((?i:{'|'.join(sorted(map(re.escape, CUES), key=len, reverse=True))}))(?:\.|:|,)?\s+(?=[A-ZÀ-ÖØ-Þ])((?i:{'|'.join(TITLES)})\.?\s+)?((?:{_PART}(?:,?[ \xa0]{{1,2}}|-))*{_CAP})")
_WORD = re.compile(rf"{_W}+")

#: The first words of the cues: a text without any of them has no cue.
_CUE_STARTS = frozenset(re.findall(rf"{_W}+", c)[0] for c in CUES)

_AT, _DOT = r"(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?)", r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[\w+%-](?:[\w.+%-]*[\w+%-])?"
EMAIL = re.compile(rf"(?<![\w.+%-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}|{_LOCAL}\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+[A-Za-z]{{2,}})(?![\w@])", re.I)

_S = r"[ \xa0]"
_EXT = rf"(?:{_S}?,?{_S}?(?:x|ext\.?|extension|poste|Durchwahl|DW){_S}?\d{{1,6}})?"
PHONE = re.compile(
    rf"(?<![\w.+/#–-])(?:"
    rf"\+\d{{1,3}}(?:[ \xa0.\-/]?\(0\))?(?:[ \xa0.\-–/]?\(?\d{{1,8}}\)?){{2,6}}{_EXT}"
    rf"|00[1-9]\d{{0,2}}{_S}\(?\d{{1,5}}\)?(?:[ \xa0.\-–/]?\d{{2,9}}){{1,5}}{_EXT}"
    rf"|(?:1[ \xa0.\-]?)?\([2-9]\d{{2}}\)[ \xa0.\-]?\d{{3}}[ \xa0.\-–]?\d{{4}}{_EXT}"
    rf"|(?:1[ \xa0.\-])?[2-9]\d{{2}}([ \xa0.\-–])\d{{3}}\1\d{{4}}{_EXT}"
    rf"|[2-9]\d{{2}}[2-9]\d{{6}}{_EXT}"
    rf"|[2-9]\d{{2}}[\-–.]\d{{4}}{_EXT}"
    rf"|\(?0[1-9]\d{{0,4}}\)?(?:[ \xa0.\-–/]\d{{2,6}}){{1,5}}{_EXT}"
    rf")(?![\w–-]|[.,]\d)"
)
SPOKEN = re.compile(rf"\b(?:{'|'.join(NUMBER_WORDS)})(?:[\s-]+(?:{'|'.join(NUMBER_WORDS)})){{6,14}}\b", re.I)
#: Any number of some length, and the word before one.
_NUMBER = re.compile(r"(?<![\w.+/#–-])[+(]?\d[\d \xa0().\-–/]{4,}\d")
_BEFORE_NUMBER = re.compile(rf"({_W}+)\W*\Z")
#: Marks a term as a word before numbers, in one table with the words that reveal a person.
LABEL = "#"

ID_NUMBER = re.compile(
    r"(?<!\w)(?:SSN|SS#|SS\s?no\.?|social\s+security|soc\.?\s+sec\.?|tax\s+id|taxpayer\s+id|TIN|ITIN|Steuer-?ID|Steuernummer|NINO|NI|national\s+insurance|DNI|NIE|NIF|documento|identity\s+card|ID\s+card|ID|Personalausweis|Ausweis"
    r"|passport|Reisepass|pasaporte|passeport|driver['’]?s?\s+licen[cs]e|driving\s+licen[cs]e|licen[cs]e|Führerschein|DL)"
    r"(?:\s+(?:no|number|nr|num|núm|numéro|número|card))?[.:#]{0,2}\s*(?:is\s+|was\s+)?"
    r"(\d{3}[ \xa0.\-–]?\d{2}[ \xa0.\-–]?\d{4}|\d{2}[ \xa0]?\d{3}[ \xa0]?\d{3}[ \xa0]?\d{3}|[A-Z]{2}[ \xa0]?\d{2}[ \xa0]?\d{2}[ \xa0]?\d{2}[ \xa0]?[A-D]|\d{8}[ \xa0-]?[A-Z]|[A-Z]\d{4}-\d{5}-\d{2}|[A-Z]{1,3}\d{5,9}[A-Z]?|[A-Z]?\d[A-Z0-9-]{5,18})(?![\w-])",
    re.I,
)

_TOWN = r"[A-ZÀ-ÖØ-Þ][\w’']+(?:[ \xa0-][A-ZÀ-ÖØ-Þ][\w’']+){0,2}"
_CODE = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[\dA-Z]?[ \xa0]?\d[A-Z]{2})"
_STREET = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|close|cl|way|place|pl|terrace|ter|boulevard|blvd|square|sq|crescent|cres|row|grove|gardens|gdns|mews|parade|highway|hwy"
_TAIL = rf"(?:(?:,\s*|\s*[\r\n]+\s*|[ \xa0]){_TOWN}(?:,?\s+[A-Z]{{2}}\s+{_CODE}|,?\s+{_CODE}|,\s*[A-Z]{{2}}\b)?)?"
ADDRESS = re.compile(
    rf"(?<![\w/])(?:"
    rf"(?:(?i:flat|apt|unit|suite|apartment)\.?\s+\w{{1,5}},\s+)?\d{{1,5}}[A-Za-z]?,?\s+(?:[A-ZÀ-ÖØ-Þ][\w’']*\s+){{1,4}}(?i:{_STREET})\b\.?(?:,?[ \xa0]+(?i:apt|flat|unit|suite|ste|#)\.?[ \xa0]*\w{{1,5}}\b)?{_TAIL}"
    rf"|(?i:p\.?[ \xa0]?o\.?\s+box)\s+\d{{1,6}}(?:,\s*{_TOWN}(?:,?\s+(?:[A-Z]{{2}}\s+)?{_CODE})?)?"
    rf"|(?i:c/|calle|avda\.?|avenida|plaza|paseo)\s*(?:(?i:de|del|la|los|las|el)\s+)*[A-ZÀ-ÖØ-Þ]\w+(?:\s+[A-ZÀ-ÖØ-Þ]\w+){{0,3}},?\s+\d{{1,5}}(?:,\s*\d{{1,2}}\s?º(?:\s?[A-Z]\b)?)?(?:,\s*\d{{5}}\s+{_TOWN})?"
    rf"|[A-ZÄÖÜ][\wß-]*(?i:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer)\s+\d{{1,4}}\s?[a-zA-Z]?(?:,\s*\d{{5}}\s+{_TOWN})"
    rf"|\d{{1,5}}(?:[ \xa0]?(?:bis|ter))?,?\s+(?i:rue|impasse|allée|allee|avenue|boulevard|chemin|place|quai|route|cours|square|passage)\s+(?:(?i:de\s+la|de\s+l['’]|du|des|de|d['’])\s*)?[A-ZÀ-ÖØ-Þ][\w’']*(?:[ \xa0-][A-ZÀ-ÖØ-Þ][\w’']*){{0,3}}(?:,\s*\d{{5}}\s+{_TOWN})?"
    rf")"
)

_AFTER = re.compile(rf"(?:['’]s)?[\s-]+(?:{'|'.join(EPONYM_AFTER)})\b", re.I)
_BEFORE = re.compile(rf"\b(?:{'|'.join(EPONYM_BEFORE)})\s+\Z", re.I)
_TOKEN = re.compile(rf"{_W}+(?:['’](?={_W}{{2}}){_W}+)?")
_GAP, _COMMA = re.compile(r"[\s]{1,2}\Z"), re.compile(r",[\s]{1,2}\Z")


def _may_hold_email(text: str) -> bool:
    low = text.lower()
    return "@" in low or "(at)" in low or "[at]" in low or "dot" in low


def terms_of(text: str) -> tuple[set[str], dict[str, float]]:
    """Lower-case words of a text outside emails; of those in places where a person is named, how much that counts (1 or WEAK)."""
    bare = EMAIL.sub(" ", text) if _may_hold_email(text) else text
    every = set(_WORD.findall(bare.lower()))
    named: dict[str, float] = {}
    for m in _CUE.finditer(bare) if not every.isdisjoint(_CUE_STARTS) else ():
        weight = WEAK if m.group(1).lower() in WEAK_CUES and not m.group(2) else 1.0
        for w in _WORD.findall(m.group(3)):
            if len(w) > 1:
                named[w.lower()] = max(weight, named.get(w.lower(), 0.0))
    for w in (*JOINERS, *TITLES):
        named.pop(w, None)
    labels = labels_of(text)
    return every | set(labels), named | {w: 1.0 for w, phone in labels.items() if phone}


def _spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the form of emails, identity numbers and addresses shows, without overlaps."""
    out: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, kind))

    if _may_hold_email(text):
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
    if any(c.isdigit() for c in text):
        for m in ID_NUMBER.finditer(text):
            if sum(c.isdigit() for c in m.group(1)) >= 5:
                add(*m.span(1), "id_number")
        for m in ADDRESS.finditer(text):
            add(*m.span(), "address")
    return out


def _phones(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        a, b = m.span()
        if sum(c.isdigit() for c in m.group()) >= 7 and all(b <= x or a >= y for x, y, _ in taken):
            yield a, b


def _label_at(text: str, start: int) -> str:
    m = _BEFORE_NUMBER.search(text[max(0, start - 25) : start])
    return LABEL + (m.group(1).lower() if m else "")


def labels_of(text: str) -> dict[str, bool]:
    """The words before numbers that are no identity number and in no address, and if a number behind has the form of a phone number."""
    found: dict[str, bool] = {}
    if not _NUMBER.search(text):
        return found
    taken = _spans(text)
    phones = list(_phones(text, taken))
    for a, _ in phones:
        found[_label_at(text, a)] = True
    taken += [(a, b, "phone") for a, b in phones]
    for m in _NUMBER.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 5 and all(m.end() <= x or m.start() >= y for x, y, _ in taken):
            found.setdefault(_label_at(text, m.start()), False)
    return found


def _count_terms(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every, named = Counter(), Counter()

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(w, n, float(named[w])) for w, n in every.items()], columns=["term", "texts", "named"])
        every.clear()
        named.clear()
        return out

    for block in blocks:
        for text in block["text"]:
            a, b = terms_of(text)
            every.update(a)
            named.update(b)
        if len(every) > 200_000:
            yield rows()
    yield rows()


def disclosure_table(texts: DataFrame) -> DataFrame:
    """(term, texts, named, disclosure) over all ``texts``: how strongly each term reveals a person.

    Terms that begin with LABEL are words before numbers: ``texts`` with one before any number, ``named``
    before one of the form of a phone number; so "lot" and "invoice" are told from "call" by the corpus.
    Each distinct text counts once, so that copies move neither a term's share nor the bar. Counts are
    summed in each task before the shuffle. Terms never named have no row.
    """
    counts = texts.where("text IS NOT NULL").select("text").distinct().mapInPandas(_count_terms, "term string, texts long, named double").groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("named").alias("named"))
    share = (F.col("named") + SMOOTH * PERSON) / (F.col("texts") + SMOOTH)
    return counts.where("term != '' AND named > 0").select("term", "texts", "named", (1 + F.log(share) / -math.log(PERSON)).alias("disclosure"))


def _names(text: str, reveals: dict[str, bool], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of revealing terms with initials and joiners, in the orders First Last and Last, First.

    ``reveals`` says of each term whether it reveals by itself or only beside one that does.
    """
    tokens = []
    for m in _TOKEN.finditer(text):
        w, start = m.group(), m.start()
        parts = _WORD.findall(w.lower())
        if len(parts) == 2 and parts[0] in ELIDED and w[0].islower():
            start += len(parts[0]) + 1
            w, parts = text[start : m.end()], parts[1:]
        if any(p in reveals for p in parts):
            kind = "R"
        elif len(w) == 1 and w.isupper() and text[m.end() : m.end() + 1] == ".":
            kind = "I"
        elif w.lower() in JOINERS:
            kind = "J"
        else:
            kind = "O"
        tokens.append((start, m.end() + (kind == "I"), kind, any(reveals.get(p) for p in parts)))
    i = 0
    while i < len(tokens):
        if tokens[i][2] == "O":
            i += 1
            continue
        run, j, comma = [i], i + 1, False
        while j < len(tokens) and tokens[j][2] != "O":
            gap = text[tokens[j - 1][1] : tokens[j][0]]
            first = [tokens[k][2] for k in run]
            if _GAP.match(gap) and "\n\n" not in gap or gap == "-" and tokens[j][2] == "R":
                pass
            elif not comma and _COMMA.match(gap) and first.count("R") <= 2 and "I" not in first and tokens[j][2] in "RI" and (first.count("R") == 1 or "-" in text[tokens[run[0]][0] : tokens[j - 1][1]]):
                comma = True
            else:
                break
            run.append(j)
            j += 1
        while run and tokens[run[0]][2] == "J":
            run.pop(0)
        while run and tokens[run[-1]][2] != "R":
            if comma and tokens[run[-1]][2] == "I" and len(run) > 1:
                break
            run.pop()
        if run and any(tokens[k][3] for k in run):
            start, end = tokens[run[0]][0], tokens[run[-1]][1]
            free = all(end <= a or start >= b for a, b in taken)
            if free and not _AFTER.match(text, end) and not _BEFORE.search(text[max(0, start - 30) : start]):
                yield start, end
        i = j
    return


def find_items(text: str | None, reveals: dict[str, bool]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal items of a text, in order, without overlaps. Null and empty have none."""
    if not text:
        return []
    out = _spans(text)

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, kind))

    if any(c.isdigit() for c in text):
        for a, b in list(_phones(text, out)):
            if _label_at(text, a) not in reveals:
                add(a, b, "phone")
    for m in SPOKEN.finditer(text):
        add(*m.span(), "phone")
    if reveals and any(reveals.get(w) for w in _WORD.findall(text.lower())):
        for start, end in _names(text, reveals, [(a, b) for a, b, _ in out]):
            add(start, end, "name")
    return sorted(out)


def revealing(texts: DataFrame, threshold: float = THRESHOLD, beside: float = BESIDE) -> DataFrame:
    """(term, alone): terms of high disclosure in ``texts``, and if each reveals by itself or only beside one that does.

    Of the words before numbers it holds those of low disclosure: a number behind them is none of a person.
    """
    label, high = F.col("term").startswith(LABEL), F.col("disclosure") >= threshold
    return disclosure_table(texts).where((label & ~high) | (~label & (F.col("disclosure") >= min(threshold, beside)))).select("term", (high & ~label).alias("alone"))


def _joined(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``texts`` with ``reveals``, the revealing terms of each, by joins: for more terms than a task may hold.

    Each distinct text is split into words once; a Bloom filter of the terms (of bounded size, so it lets
    some others pass) keeps most words out of the shuffle. Rows meet their terms by the text's digest, so
    null and repeated ids are no matter, and copies of one text are spread over many tasks.
    """
    keyed = texts.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    sieve = _sieve(terms)
    words = keyed.where("text IS NOT NULL").groupBy("digest").agg(F.first("text").alias("text"))
    words = words.select("digest", F.expr(r"array_distinct(regexp_extract_all(lower(text), '\\p{L}+', 0))").alias("w"))
    words = words.select("digest", F.explode(F.filter(F.concat("w", F.transform("w", lambda x: F.concat(F.lit(LABEL), x)), F.array(F.lit(LABEL))), sieve)).alias("term"))
    hits = words.join(terms, "term").groupBy("digest").agg(F.collect_list(F.struct("term", "alone")).alias("reveals"))
    return spread_join(keyed, hits, ["digest"], "left")


def _sieve(terms: DataFrame, bits: int = 1 << 22, hashes: int = 3):
    """A test that all ``terms`` pass and few other words: a Bloom filter of half a megabyte, whatever their number."""
    place = lambda word, i: F.pmod(F.xxhash64(F.lit(i), word), F.lit(bits))
    spots = terms.select(F.explode(F.array(*[place(F.col("term"), i) for i in range(hashes)])).alias("p"))
    held = spots.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v")).toPandas()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.int64)
    table[held["w"].to_numpy(np.int64)] = held["v"].to_numpy(np.int64)
    packed = F.lit(table.tobytes())
    # a bit is read from its byte of the binary: little-endian words
    bit = lambda p: F.conv(F.hex(F.substring(packed, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (p % 8).cast("int"))) != 0
    return lambda word: bit(place(word, 0)) & bit(place(word, 1)) & bit(place(word, 2))


def _apply(texts: DataFrame, threshold: float, each, schema: str, most: int) -> DataFrame:
    """``each`` (block, how a text's revealing terms are found) over the texts.

    Up to ``most`` revealing terms go to every task, and the texts are read once and never shuffled;
    beyond that they come by :func:`_joined`. The result is the same.
    """
    scratch = Scratch(texts.sparkSession, "p1")
    terms = scratch.cut(revealing(texts, threshold), "terms")
    if terms.count() <= most:
        held = {r.term: r.alone for r in terms.collect()}
        shared = texts.sparkSession.sparkContext.broadcast(held)

        def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in blocks:
                yield each(block, [shared.value] * len(block))

        return texts.select("field", "row_id", "text").mapInPandas(run, schema)

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            yield each(block, [{} if r is None else {x["term"]: x["alone"] for x in r} for r in block["reveals"]])

    return _joined(scratch.cut(texts.select("field", "row_id", "text"), "texts"), terms).select("field", "row_id", "text", "reveals").mapInPandas(run, schema)


def found_items(texts: DataFrame, threshold: float = THRESHOLD, most: int = MOST_SENT) -> DataFrame:
    """(field, row_id, kind, item), distinct: each personal item exactly as it stands in its text."""

    def each(block: pd.DataFrame, known: list[dict[str, bool]]) -> pd.DataFrame:
        rows = []
        for field, row_id, text, reveals in zip(block["field"], block["row_id"], block["text"], known):
            rows += [(field, row_id, kind, item) for kind, item in {(kind, text[a:b]) for a, b, kind in find_items(text, reveals)}]
        return pd.DataFrame(rows, columns=["field", "row_id", "kind", "item"])

    typed = dict(texts.dtypes)["row_id"]
    return _apply(texts, threshold, each, f"field string, row_id {typed}, kind string, item string", most).distinct()


def redacted(texts: DataFrame, threshold: float = THRESHOLD, most: int = MOST_SENT) -> DataFrame:
    """(field, row_id, text): the texts with [NAME], [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] in place of items.

    All other wording is kept as it is; null stays null and empty stays empty; one row for each row.
    """

    def each(block: pd.DataFrame, known: list[dict[str, bool]]) -> pd.DataFrame:
        out = []
        for text, reveals in zip(block["text"], known):
            at, parts = 0, []
            for a, b, kind in find_items(text, reveals):
                parts += [text[at:a], f"[{kind.upper()}]"]
                at = b
            out.append(text if not parts else "".join([*parts, text[at:]]))
        return pd.DataFrame({"field": block["field"], "row_id": block["row_id"], "text": out})

    typed = dict(texts.dtypes)["row_id"]
    return _apply(texts, threshold, each, f"field string, row_id {typed}, text string", most)
