"""The queries of the training-data operators, with their production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..sources.tables import table
from . import groups, mixing, packing, pairs, pii, splitting, subjects, term_counts
from .cases import current_rows, version_key
from .text import normal_form_col, normal_list_col

# --- 1: personal information


def _free_texts(spark: SparkSession, base: str) -> DataFrame:
    history = table(spark, base, "reports_lean").select(F.lit("reports_lean.history").alias("field"), F.col("report_id").alias("row_id"), F.col("history").alias("text"))
    evidence = table(spark, base, "clinical_relationships").select(F.lit("clinical_relationships.evidence").alias("field"), F.col("rel_id").alias("row_id"), F.col("evidence").alias("text"))
    return history.unionByName(evidence)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.found_items(_free_texts(spark, base))


def p1_redacted(spark: SparkSession, base: str) -> DataFrame:
    return pii.redacted(_free_texts(spark, base))


def p1_disclosure(spark: SparkSession, base: str) -> DataFrame:
    """How strongly each term reveals a person."""
    return pii.disclosure_table(_free_texts(spark, base))


# --- 2: frequency of every value


def _case_total(rag: DataFrame) -> DataFrame:
    return rag.agg(F.countDistinct("case_id").alias("total"))


def _case_items(rag: DataFrame) -> DataFrame:
    now = current_rows(rag)
    entities = now.select(F.lit("entities").alias("field"), F.col("case_id").alias("record"), F.explode("terms").alias("term"))
    numbers = now.where("num_entities IS NOT NULL").select(F.lit("num_entities").alias("field"), F.col("case_id").alias("record"), F.col("num_entities").cast("string").alias("term"))
    return entities.unionByName(numbers)


def p2_terms(spark: SparkSession, base: str) -> DataFrame:
    """Every value of both fields with occurrences, cases and mark."""
    rag = table(spark, base, "rag_entities")
    counts = term_counts.ngram_counts(_case_items(rag), Scratch(spark, "p2"), values_only=True)
    return term_counts.marked(term_counts.value_counts(counts), _case_total(rag)).withColumnRenamed("records", "cases")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p2_terms(spark, base).where("mark IS NOT NULL").select("field", "term", "mark")


def p2_ngrams(spark: SparkSession, base: str) -> DataFrame:
    """Occurrences and cases of every word n-gram, of any length, inside the entity texts."""
    counts = term_counts.ngram_counts(_case_items(table(spark, base, "rag_entities")).where("field = 'entities'"), Scratch(spark, "p2n"))
    inner = ~F.col("ngram").contains(term_counts.BEGIN) & ~F.col("ngram").contains(term_counts.END)
    return counts.where(inner).select(F.translate("ngram", term_counts.SEP, " ").alias("ngram"), F.col("n").cast("int").alias("n"), "occurrences", F.col("records").alias("cases"))


# --- 3: pieces of long texts


def _sections(spark: SparkSession, base: str) -> DataFrame:
    """(report_id, field, digest, text) of the long sections; the digest tells different texts of one report_id apart."""
    reports = table(spark, base, "reports_lean").select("report_id", "findings", "conclusions")
    each = reports.select("report_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("findings", "conclusions")])).alias("s"))
    return each.select("report_id", "s.field", F.md5("s.text").alias("digest"), "s.text").where(F.length("text") > splitting.LIMIT)


_SECTION = ["report_id", "field", "digest"]


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    ranges = splitting.text_ranges(_sections(spark, base), _SECTION)
    return splitting.pieces_of_ranges(ranges, splitting.cut_table(ranges, _SECTION), _SECTION).drop("digest")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """A text is cut by force if one of its cuts lies in a stretch that is too long."""
    cuts = splitting.cut_table(splitting.text_ranges(_sections(spark, base), _SECTION), _SECTION)
    cut = F.when(F.bool_or("over"), "forced").otherwise("natural")
    return cuts.groupBy(*_SECTION).agg(cut.alias("cut")).select("report_id", "field", "cut").distinct()


# --- 4: terms that stand together


def _basket_versions(rag: DataFrame) -> DataFrame:
    """(case_id, old, new): terms of the case's row as of the time when nine tenths of the rows were there, and now."""
    until = rag.agg(F.expr("percentile_approx(processed_at, 0.9)").alias("until"))
    rows = rag.where("case_id IS NOT NULL").select("case_id", "num_entities", "processed_at", "entities").crossJoin(F.broadcast(until))
    texts = F.struct(F.col("entities.text").alias("texts"))
    best = rows.groupBy("case_id").agg(
        F.max_by(F.when(F.col("processed_at") <= F.col("until"), texts), F.when(F.col("processed_at") <= F.col("until"), version_key())).alias("old"),
        F.max_by(texts, version_key()).alias("new"),
    )
    return best.select("case_id", normal_list_col("old.texts").alias("old"), normal_list_col("new.texts").alias("new"))


def _pair_scores(spark: SparkSession, base: str, least: int) -> DataFrame:
    """The state after two batches, each merged into it: the rows as of nine tenths of the way, then what changed since."""
    rag, scratch = table(spark, base, "rag_entities"), Scratch(spark, "p4")
    versions = scratch.cut(_basket_versions(rag), "versions")
    state = pairs.PairTable(scratch)
    state.apply(versions.select(F.lit(None).cast("array<string>").alias("old"), F.col("old").alias("new")))
    state.apply(versions.select("old", "new"))
    return state.scores(_case_total(rag), least)


def p4_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every pair with its counts, lift and normalised pointwise mutual information."""
    return _pair_scores(spark, base, 1).select(F.col("a").alias("term_a"), F.col("b").alias("term_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("npmi", 6).alias("npmi"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    s = _pair_scores(spark, base, 5)
    return s.where("1000 * n >= total AND n * total >= 3 * n_a * n_b").select(F.col("a").alias("term_a"), F.col("b").alias("term_b"))


# --- 5: groups of mentions and names

#: Names that say only that none is known or given, by their normal form without signs: the default of a parameter of
#: ``name_links``, in the four languages of the tables. Placeholders of another collection are given there.
NO_NAMES = [
    "", "a confirmer", "anon", "anonymous", "aucun", "blank", "desconocida", "desconocido", "empty", "inconnu", "inconnue", "k a", "kein name", "keine angabe", "missing", "n a", "n d", "n k", "na",
    "name not given", "name not known", "name unknown", "nan", "nd", "nicht angegeben", "nicht bekannt", "nil", "ninguno", "nk", "no data", "no disponible", "no especificado", "no name", "no name given", "no name known", "non connu", "non précisé", "non renseigne", "non renseigné",
    "none", "none given", "none known", "not applicable", "not available", "not given", "not known", "not named", "not provided", "not recorded", "not specified", "not stated", "null", "ohne namen", "s o", "sans nom", "sin nombre", "tba", "tbc", "tbd",
    "to be confirmed", "unbekannt", "undefined", "undetermined", "unidentified", "unk", "unknown", "unknown name", "unnamed", "unspecified", "à confirmer",
]


def name_links(records: DataFrame, no_names: list[str] = NO_NAMES) -> DataFrame:
    """(x, y): normal forms of each entry's mention and name. Entries whose name is null, blank or one of ``no_names`` link nothing."""
    entries = records.where("entity_map IS NOT NULL").select(F.explode("entity_map").alias("mention", "value")).select("mention", F.col("value.name").alias("name")).where("name IS NOT NULL").distinct()
    links = entries.select(normal_form_col("mention").alias("x"), normal_form_col("name").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    bare = F.trim(F.regexp_replace("y", r"[^\p{L}\p{N}]+", " "))
    return links.where(~bare.isin(no_names))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    found = groups.named_groups(name_links(table(spark, base, "resolved_entities")), Scratch(spark, "p5"))
    return found.where("member != group_name")


# --- 6: containers


def _packed(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "p6")
    pieces = scratch.cut(packing.sized_pieces(table(spark, base, "documents")), "pieces")
    return pieces, *packing.pack(pieces, scratch)


def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base)[1]


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    """Containers, the fewest that any packing of all pieces needs (certified), the partitions whose first packing was certified, and the share of space used."""
    pieces, placed, report = _packed(spark, base)
    used = placed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    first = report.where("round = 0").agg(F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("used") == F.col("bound")).alias("certified"))
    out = used.crossJoin(first).withColumn("bound", F.lit(packing.whole_bound(pieces)))
    return out.withColumn("filled", F.try_divide(F.col("tokens").cast("double"), F.col("containers") * packing.CAPACITY))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that the packing put into more than one container: those that did not fit in one."""
    placed = _packed(spark, base)[1]
    return placed.groupBy("doc_id").agg(F.max("piece_no").alias("pieces"), F.countDistinct("container").alias("containers")).where("pieces > 1 AND containers > 1").select("doc_id")


# --- 7: mixing


def p7_uses(spark: SparkSession, base: str) -> DataFrame:
    return mixing.document_uses(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    s = mixing.mix_shares(table(spark, base, "documents"), table(spark, base, "mix_targets"))
    return s.withColumns({"rate": F.round("rate", 9), "share": F.round("share", 9)})


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Sources that have used up all their documents in the mix and still miss their target."""
    return mixing.unreachable(table(spark, base, "documents"), table(spark, base, "mix_targets")).select("source")


# --- 8: subject areas


def _subject_counts(spark: SparkSession, base: str) -> DataFrame:
    return subjects.subject_counts(table(spark, base, "documents").select("doc_id", "text"), table(spark, base, "subject_areas"), table(spark, base, "subject_labels"), Scratch(spark, "p8"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _subject_counts(spark, base).where(F.col("about") * subjects.QUARTER >= F.col("sentences")).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, base: str) -> DataFrame:
    """The corpus by subject: documents that are about it, and sentences."""
    c = _subject_counts(spark, base)
    return c.groupBy("subject").agg(F.count_if(F.col("about") * subjects.QUARTER >= F.col("sentences")).alias("documents"), F.sum("about").alias("sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_disclosure, p2_found, p2_terms, p2_ngrams, p3_found, p3_pieces, p4_found, p4_pairs, p5_found, p6_found, p6_containers, p6_report, p7_found, p7_uses, p7_shares, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    from .sql import statements

    return statements()
