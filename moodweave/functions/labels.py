"""Small predicates and keys over labels, groups and provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as no label.
NO_LABEL = ("", "unknown", "unlabelled", "none", "null", "na", "n/a")


def normalise_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"[\s-]+", "_")


def is_unlabelled(label: Column) -> Column:
    return F.coalesce(F.lower(F.trim(label)).isin(*NO_LABEL), F.lit(True))


def matches_any(text: Column, needles: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(low, n)) if needles else F.lit(False)


def group_key(value: Column, by_year: bool = False) -> Column:
    """The value, or the year of an ISO date; unknown where there is none."""
    key = F.when(value.rlike(r"^\d{4}"), F.substring(value, 1, 4)) if by_year else F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(key, F.lit("unknown"))


def provenance(in_lexicon: Column, in_vad: Column, conf: Column) -> Column:
    """Where a term's values come from; values of a confidence under 1 were imputed."""
    source = F.when(in_lexicon & in_vad, "lexicon+vad").when(in_lexicon, "lexicon").when(in_vad, "vad").otherwise("other")
    return F.concat(source, F.when((in_lexicon | in_vad) & (conf < 1), "_imputed").otherwise(""))


def usable_silver(stored_length: Column, length: int, n_tokens: Column) -> Column:
    """Silver labels hold if made at the current length, or, where that isn't known, if the text doesn't fill it."""
    return F.when(stored_length.isNotNull(), stored_length == length).otherwise(n_tokens < length)


def as_float(value: Column) -> Column:
    """A text as a number; truths are 1 and 0, what is no finite number is null."""
    x = F.when(F.lower(F.trim(value)).isin("true", "false"), (F.lower(F.trim(value)) == "true").cast("double")).otherwise(value.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def as_int(value: Column) -> Column:
    """A text as a whole number; truths, fractions and other texts are null."""
    return F.when(F.trim(value).rlike(r"^[+-]?\d+$"), F.trim(value).try_cast("long"))


def prompt(text: Column, mode: str = "none", task: str = "Represent the term by its emotional meaning") -> Column:
    """A term as embedding models want it: none, passage, query or instruct."""
    before = {"none": "", "passage": "passage: ", "query": "query: ", "instruct": f"Instruct: {task}\nQuery: "}
    if mode not in before:
        raise ValueError(f"unknown prompt mode {mode}")
    return F.concat(F.lit(before[mode]), text)
