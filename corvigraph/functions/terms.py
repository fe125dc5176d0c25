"""Classes of clinical terms by the words in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_contains

# Entity types and the pieces of a term that show them, in order of precedence.
ENTITY_TYPES = {
    "MEDICATION": ["drug", "medicine", "medication", "therapeutic"],
    "PROCEDURE": ["procedure", "surgery", "operation", "intervention"],
    "CONDITION": ["disease", "disorder", "condition", "syndrome"],
    "VACCINE": ["vaccine", "vaccination", "immunization"],
    "ANATOMY": ["muscle", "bone", "tissue", "organ", "eyelid"],
    "FINDING": ["finding", "observation", "symptom"],
}
# The same for concepts.
CONCEPT_TYPES = {
    "VACCINE": ["vaccine", "vaccination", "immunization"],
    "MEDICATION": ["medication", "drug", "medicine"],
    "CONDITION": ["disease", "infection", "virus", "condition"],
    "PROCEDURE": ["procedure", "surgery", "operation"],
    "FINDING": ["finding", "symptom", "observation"],
    "ANATOMY": ["eyelid", "muscle", "tissue", "organ"],
}
# Tests of a term, each by itself.
TERM_TESTS = {
    "disease": ["rabies", "diabetes", "infection", "virus", "disease"],
    "vaccine": ["vaccine", "vaccination", "immunization"],
    "condition": ["diabetes", "condition", "disorder", "syndrome"],
    "medication": ["medication", "drug", "medicine", "therapeutic"],
    "anatomy": ["eyelid", "cardiac", "muscle", "tissue", "organ"],
    "finding": ["finding", "thickened", "observation", "symptom"],
}
# Words of medical terms, for relations, and of medical compounds.
MEDICAL_WORDS = [
    "vaccine", "rabies", "medication", "treatment", "procedure", "surgery", "therapy", "diagnosis", "condition", "disease", "symptom", "finding",
    "administration", "patient", "clinical", "medical", "pharmaceutical",
]
COMPOUND_WORDS = ["vaccine", "medication", "drug", "therapy", "treatment", "procedure", "surgery", "diagnosis", "condition", "disease", "syndrome"]
# Relations of a report graph and the (kind, certainty) that their ends may have; "modify" has no bounds.
OBSERVED, MAYBE, ABSENT, ANATOMY = "Observation definitely present", "Observation uncertain", "Observation definitely absent", "Anatomy definitely present"
RELATION_ENDS = {
    "suggestive_of": ([OBSERVED, MAYBE], [OBSERVED, MAYBE]),
    "located_at": ([OBSERVED, MAYBE, ABSENT], [ANATOMY]),
}


def first_class(term: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The first class of which the term holds a piece; null stays null."""
    out = F.when(term.isNotNull(), default)
    for name, pieces in reversed(classes.items()):
        out = F.when(any_contains(F.lower(term), pieces), name).otherwise(out)
    return out


def has_test(term: Column, name: str) -> Column:
    return F.coalesce(any_contains(F.lower(term), TERM_TESTS[name]), F.lit(False))


def is_medical(term: Column) -> Column:
    return F.coalesce(any_contains(F.lower(term), MEDICAL_WORDS), F.lit(False))
