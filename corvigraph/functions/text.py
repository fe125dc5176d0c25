"""Text expressions: normal forms, look-back windows, rule-based tags, JSON repair, string likeness."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Cue words of the assertion rules, in their order of precedence.
ASSERTION_CUES = {
    "absent": ["no ", "without ", "absence of", "ruled out", "normal ", "unremarkable"],
    "possible": ["possible", "suspected", "likely", "questionable", "may represent", "consider"],
    "past": ["previous", "prior", "history of", "old", "chronic"],
}
# Findings that make a report critical, by region; some stand under two regions.
CRITICAL_TERMS = [
    "pneumothorax", "pleural effusion", "pulmonary nodule", "lung mass", "pulmonary metastases", "congestive heart failure", "chf", "cardiogenic edema",
    "pulmonary thromboembolism", "pte", "pericardial effusion", "heart-based mass", "fungal pneumonia", "aspiration pneumonia", "noncardiogenic edema",
    "foreign body", "gastric foreign body", "intestinal foreign body", "gastric dilatation-volvulus", "gdv", "hemoabdomen", "free abdominal fluid",
    "urinary bladder rupture", "intestinal obstruction", "mesenteric volvulus", "splenic torsion", "renal lymphoma", "pancreatic mass", "pancreatitis",
    "fracture", "aggressive bone lesion", "osteosarcoma", "bone lysis", "pathologic fracture", "joint luxation", "spinal fracture",
    "pelvic fracture", "hip luxation", "vertebral luxation", "disk extrusion", "ischemic myelopathy", "thalamic astrocytoma",
]


def clean(c: Column) -> Column:
    """Lower case without outer white space of any kind."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def assemble(parts: dict[str, Column], limit: int = 4000) -> Column:
    """Sections with their labels as one text, null as empty, cut at ``limit`` characters."""
    bits = [x for i, (name, c) in enumerate(parts.items()) for x in (F.lit(("\n" if i else "") + f"{name}: "), F.coalesce(c, F.lit("")))]
    return F.substring(F.concat(*bits), 1, limit)


def find(text: Column, needle: Column) -> Column:
    """0-based offset of the first occurrence, -1 if there is none."""
    return F.locate(needle, text) - 1 if isinstance(needle, str) else F.call_function("instr", text, needle) - 1


def lookback(text: Column, position: Column, size: int = 100) -> Column:
    """Up to ``size`` characters before a 0-based position."""
    return F.substring(text, F.greatest(position - size, F.lit(0)) + 1, F.least(position, F.lit(size)))


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def any_word(text: Column, words: list[str]) -> Column:
    alternatives = "|".join("\\Q" + w.strip() + "\\E" for w in words)
    return text.rlike(rf"(?i)\b(?:{alternatives})\b")


def assertion(text: Column, entity: Column, word_boundary: bool = False) -> Column:
    """absent, possible, past or present, by the cues in the 100 characters before the first occurrence.

    An entity at offset 0, or not in the text, has nothing before it: present. With ``word_boundary``
    cues count only as whole words.
    """
    low = F.lower(text)
    at = find(low, F.lower(entity))
    window = lookback(low, at)
    test = any_word if word_boundary else any_contains
    out = F.lit("present")
    for tag, cues in reversed(ASSERTION_CUES.items()):
        out = F.when((at > 0) & test(window, cues), tag).otherwise(out)
    return out


def is_critical(entity: Column) -> Column:
    return F.coalesce(any_contains(F.lower(entity), CRITICAL_TERMS), F.lit(False))


def section_of(text: Column, position: Column, mode: str = "nearest_header") -> Column:
    """Section of a 0-based position: of the nearest header before it, or ('first_header') by fixed precedence."""
    before = F.lower(F.substring(text, F.lit(1), F.greatest(position, F.lit(0))))
    headers = {"history": "history:", "conclusions": "conclusions:", "recommendations": "recommendations:", "findings": "findings:"}
    if mode == "first_header":
        out = F.lit("findings")
        for name in ("recommendations", "conclusions", "history"):
            out = F.when(before.contains(headers[name]), name).otherwise(out)
        return out
    last = {n: F.length(before) - F.length(F.substring_index(before, h, -1)) for n, h in headers.items()}
    best = F.greatest(*last.values())
    out = F.lit("findings")
    for name in ("findings", "recommendations", "conclusions", "history"):
        out = F.when((best > 0) & (last[name] == best), name).otherwise(out)
    return out


def certainty(label: Column) -> Column:
    low = F.lower(F.replace(label, F.lit("_"), F.lit(" ")))
    return F.when(low.contains("definitely present"), "present").when(low.contains("definitely absent"), "absent").when(low.contains("uncertain"), "uncertain").otherwise("unknown")


def parse_label(label: Column) -> tuple[Column, Column]:
    """("base", polarity) of labels like "disease definitely absent"; other labels are their own base, polarity unknown."""
    pattern = r"^(.*?) (?:definitely )?(present|absent|uncertain)$"
    hit = label.rlike(pattern)
    return F.when(hit, F.regexp_extract(label, pattern, 1)).otherwise(label), F.when(hit, F.regexp_extract(label, pattern, 2)).otherwise("unknown")


def truncate(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def word_count(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, F.size(F.split(F.trim(c), r"\s+"))).otherwise(F.lit(0))


def sorted_distinct_join(items: Column, separator: str = " ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), separator)


def repair_json(c: Column) -> Column:
    """Text that from_json accepts, where simple damage can be undone: code fences, single quotes, trailing commas.

    Quotes are swapped only where the text has no double quote. Text cut off in the middle stays broken.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    body = F.when(body == "", bare).otherwise(body)
    quoted = F.when(body.contains('"'), body).otherwise(F.translate(body, "'", '"'))
    return F.regexp_replace(quoted, r",(\s*[}\]])", "$1")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one is all zeros."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams; empty for shorter text."""
    count = F.length(c) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column, n: int = 2) -> Column:
    """Sorensen-Dice likeness of the sets of character n-grams; 1 for equal, 0 where both are too short and differ."""
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0)))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two texts of equal length; null for others."""
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))


def likeness(a: Column, b: Column) -> Column:
    """1 less Levenshtein distance over the longer length; 1 for two empty texts."""
    return 1 - F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def jaro_winkler(a: str | None, b: str | None, scale: float = 0.1) -> float | None:
    """Jaro-Winkler likeness of two strings; null if one is null. A common prefix of up to 4 counts above 0.7."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, found = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                found.append(ch)
                break
    if not found:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(found, other)) // 2
    m = len(found)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * scale * (1 - jaro)


def jaro_winkler_col(a: Column, b: Column) -> Column:
    """:func:`jaro_winkler` by a vectorised Python function: Spark has no built-in one."""
    return F.pandas_udf(_jaro_winklers, DoubleType())(a, b)


def _jaro_winklers(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")
