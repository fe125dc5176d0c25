"""From text to entities and relations: annotators, spans, chunks and their merging."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

Annotator = Callable[[list[str]], list[list[dict]]]

SPAN = "array<struct<text:string,label:string,start:int,end:int,score:double>>"


def annotate(df: DataFrame, text: str, make: Callable[[], Annotator], batch: int = 1024) -> DataFrame:
    """``df`` with ``entities``: an external model or any function over batches of texts.

    ``make`` builds the annotator once per task, so a loaded model is never sent over the wire. Null
    texts get an empty array.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for block in blocks:
            for i in range(0, len(block), batch):
                part = block.iloc[i : i + batch].copy()
                texts = [t if isinstance(t, str) else "" for t in part[text]]
                part["entities"] = model(texts)
                yield part

    return df.mapInPandas(run, f"{fields}, entities {SPAN}")


def dictionary_annotator(terms: dict[str, str]) -> Callable[[], Annotator]:
    """Marks whole-word, case-insensitive hits of ``terms`` (term -> label), longest first, score 1."""

    def make() -> Annotator:
        if not terms:
            return lambda texts: [[] for _ in texts]
        pattern = re.compile(r"\b(?:" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")\b", re.I)
        labels = {t.lower(): v for t, v in terms.items()}
        return lambda texts: [[{"text": m.group(), "label": labels[m.group().lower()], "start": m.start(), "end": m.end(), "score": 1.0} for m in pattern.finditer(t)] for t in texts]

    return make


def by_section(df: DataFrame, keys: list[str], sections: list[str]) -> DataFrame:
    """(keys, section, text): one row per section that has text."""
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in sections])
    return df.select(*keys, F.explode(pairs).alias("s")).select(*keys, "s.section", "s.text").where(F.length(F.trim("text")) > 0)


def roll_up(reports: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """``reports``' keys with their entities as an ordered array; reports without any keep an empty one."""
    rest = [c for c in entities.columns if c != key]
    lists = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("entities"))
    out = reports.select(key).distinct().join(lists, key, "left")
    return out.select(key, F.coalesce("entities", F.array()).alias("entities")).withColumn("num_entities", F.size("entities"))


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, token_no, token, start, end): words between white space with 0-based offsets, end exclusive; token_no from 0."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes)

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            rows = [(*k, i, m.group(), m.start(), m.end()) for *k, t in block[[*keys, text]].itertuples(index=False) if isinstance(t, str) for i, m in enumerate(re.finditer(r"\S+", t))]
            yield pd.DataFrame(rows, columns=[*keys, "token_no", "token", "start", "end"])

    return df.select(*keys, text).mapInPandas(run, f"{fields}, token_no int, token string, start int, end int")


def align_spans(spans: DataFrame, words: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """``spans`` (keys, start, end) with first and last token: start inside the first, end inside the last; others are dropped.

    Offsets fall into buckets of ``width`` characters; a token lies in each bucket it touches, so a span meets
    the tokens about its ends only, however long the text is.
    """
    w = words.select(*keys, "token_no", F.col("start").alias("ws"), F.col("end").alias("we"))
    w = w.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("ws") / width).cast("int"), F.floor((F.col("we") - 1) / width).cast("int"))))
    at = lambda c: F.floor(c / width).cast("int")
    first = spans.withColumn("bucket", at(F.col("start"))).join(w, [*keys, "bucket"]).where("ws <= start AND start < we").select(*spans.columns, F.col("token_no").alias("first_token"))
    last = first.withColumn("bucket", at(F.col("end") - 1)).join(w, [*keys, "bucket"])
    return last.where("ws < end AND end <= we").select(*first.columns, F.col("token_no").alias("last_token"))


def align_entities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text, start, end, first_token, last_token): :func:`align_spans` of each row's ``entities`` to the row's own :func:`tokens`, which never leave the row."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes)
    columns = [*keys, "text", "start", "end", "first_token", "last_token"]

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            rows = []
            for *k, t, spans in block[[*keys, text, "entities"]].itertuples(index=False):
                if not isinstance(t, str) or spans is None or not len(spans):
                    continue
                at = [m.span() for m in re.finditer(r"\S+", t)]
                starts = [a for a, _ in at]
                for s in spans:
                    i, j = bisect_right(starts, s["start"]) - 1, bisect_left(starts, s["end"]) - 1
                    if i >= 0 and s["start"] < at[i][1] and j >= 0 and s["end"] <= at[j][1]:
                        rows.append((*k, s["text"], s["start"], s["end"], i, j))
            yield pd.DataFrame(rows, columns=columns)

    return df.select(*keys, text, "entities").mapInPandas(run, f"{fields}, text string, start int, end int, first_token int, last_token int")


def merge_chunk_entities(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of overlapping chunks as one list: per normal text the first attributes and the largest score."""
    rest = [c for c in entities.columns if c not in (*keys, "text", "score", "position")]
    norm = entities.withColumn("norm", clean(F.col("text")))
    return norm.groupBy(*keys, "norm").agg(F.min_by(F.struct("text", *rest), F.struct("position", "text")).alias("a"), F.max("score").alias("score")).select(*keys, "norm", "a.*", "score")


def merge_chunk_relations(relations: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Relations whose two ends are known entities, one per (head, tail, type) with its largest score."""
    known = entities.select(*keys, "norm")
    ok = relations.withColumn("h", clean(F.col("head"))).withColumn("t", clean(F.col("tail")))
    ok = ok.join(known.withColumnRenamed("norm", "h"), [*keys, "h"], "left_semi").join(known.withColumnRenamed("norm", "t"), [*keys, "t"], "left_semi")
    return ok.groupBy(*keys, F.col("h").alias("head"), F.col("t").alias("tail"), "type").agg(F.max("score").alias("score"))


def co_occurrence_relations(entities: DataFrame, keys: list[str], score: float = 0.05) -> DataFrame:
    """Default relation extractor: a relation between each two distinct entities of a text, by their order."""
    e = entities.select(*keys, clean(F.col("text")).alias("x")).distinct()
    return e.withColumnRenamed("x", "head").join(e.withColumnRenamed("x", "tail"), keys).where("head < tail").withColumns({"type": F.lit("co_occurs"), "score": F.lit(score)})


def enforce_types(relations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Relations whose (type, head_type, tail_type) is in ``allowed``."""
    return relations.join(allowed, ["type", "head_type", "tail_type"], "left_semi")


def chunk_sentences(df: DataFrame, keys: list[str], text: str, limit: int = 480, overlap: int = 50) -> DataFrame:
    """(keys, chunk_no, chunk, tokens, ends_at_sentence): whole sentences up to ``limit`` words.

    The next chunk repeats trailing whole sentences of up to ``overlap`` words. A longer sentence becomes
    windows of ``limit`` words, each ``limit - overlap`` after the one before.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes)

    def split(t: str) -> list[tuple[str, int, bool]]:
        out: list[tuple[str, int, bool]] = []
        held: list[list[str]] = []

        def flush() -> None:
            if held:
                words = [w for s in held for w in s]
                out.append((" ".join(words), len(words), True))

        for sentence in re.split(r"(?<=[.!?])\s+", t.strip()):
            words = sentence.split()
            if len(words) > limit:
                flush()
                held = []
                for i in range(0, len(words), limit - overlap):
                    part = words[i : i + limit]
                    out.append((" ".join(part), len(part), i + limit >= len(words)))
                    if i + limit >= len(words):
                        break
                continue
            if held and sum(map(len, held)) + len(words) > limit:
                flush()
                tail: list[list[str]] = []
                for s in reversed(held):
                    if sum(map(len, tail)) + len(s) > overlap or sum(map(len, tail)) + len(s) + len(words) > limit:
                        break
                    tail.insert(0, s)
                held = tail
            if words:
                held.append(words)
        flush()
        return out

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            rows = [(*k, i, *c) for *k, t in block[[*keys, text]].itertuples(index=False) if isinstance(t, str) for i, c in enumerate(split(t))]
            yield pd.DataFrame(rows, columns=[*keys, "chunk_no", "chunk", "tokens", "ends_at_sentence"])

    return df.select(*keys, text).mapInPandas(run, f"{fields}, chunk_no int, chunk string, tokens int, ends_at_sentence boolean")
