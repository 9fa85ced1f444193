"""Lexicon features of documents: counts by emotion, negation, VAD means."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_words, tokens

# Words that end a negation, and words after "not" that undo it.
BOUNDARIES = ("but", "however", "though", "although", "yet", "nevertheless", "nonetheless", "still", "except")
NOT_SKIPS = ("only", "just", "merely", "simply")
NEGATORS = ("not", "no", "never", "without", "nor", "neither")
#: Counts are summed in these units (the least common multiple of 1 to 8), so shares of shared terms add up exactly.
UNITS = 840


def negated(tokens: DataFrame, negators: Column, boundaries: Column, window: int) -> DataFrame:
    """tokens(doc_id, pos, term) with `negated`: a negator stands up to `window` words before, no boundary since, nor at the word."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    last_negator = F.last(F.when(negators, F.col("pos")), ignorenulls=True).over(by_doc.rowsBetween(-window, -1))
    last_boundary = F.last(F.when(boundaries, F.col("pos")), ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("negated", last_negator.isNotNull() & (F.coalesce(last_boundary, F.lit(-1)) < last_negator))


def negated_places(words: Column, negators: list[str], boundaries: list[str], window: int) -> Column:
    """array<int>: places (from 0) of an array of words that `negated` would mark, found inside the row: each negator masks the words
    after it until a boundary.  Work follows the number of negators, and nothing is shuffled."""
    among = lambda x, listed: F.array_contains(F.array(*map(F.lit, listed)), x) if listed else F.lit(False)
    numbered = F.transform(words, lambda w, i: F.when(among(w, negators), i))
    starts = F.array_compact(numbered)

    def masked(at: Column) -> Column:
        after = F.slice(words, at + 2, F.lit(window))
        stop = F.array_position(F.transform(after, lambda w: among(w, boundaries)), True)
        n = F.when(stop > 0, stop - 1).otherwise(F.size(after)).cast("int")
        return F.when(n > 0, F.sequence(at + 1, at + n)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(starts, masked)))


def is_negator(term: Column, following: Column, extra: tuple[str, ...] = NEGATORS) -> Column:
    """Listed words and those in -n't; not "not" before a word such as "only"."""
    listed = term.isin(*extra) | (term.endswith("n't") & (F.length(term) > 3))
    return listed & ~((term == "not") & F.coalesce(following.isin(*NOT_SKIPS), F.lit(False)))


def emotion_counts(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, emotion, count, hits): a term of several emotions gives each an equal share.  The lexicon is a bounded table."""
    hit = tokens.join(lexicon.select("term", "emotion", "shared"), "term")
    return hit.groupBy("doc_id", "emotion").agg((F.sum((F.lit(UNITS) / F.col("shared")).cast("long")) / UNITS).alias("count"), F.count("*").alias("hits"))


def profiles(docs: DataFrame, counts: DataFrame, emotions: int = 8) -> DataFrame:
    """docs(doc_id, n_words, ...) with counts, an array by emotion (zeros without hits), and lex_hits."""
    one = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("emotion", "count"))).alias("m"), F.sum("hits").alias("lex_hits"))
    vector = F.array(*[F.coalesce(F.col("m")[e], F.lit(0.0)) for e in range(emotions)])
    return docs.join(one, "doc_id", "left").withColumn("counts", vector).withColumn("lex_hits", F.coalesce("lex_hits", F.lit(0))).drop("m")


def vad_means(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, v, a, d, vad_hits): unweighted means over the words that have values."""
    hit = tokens.join(terms.select("term", "v", "a", "d"), "term")
    return hit.groupBy("doc_id").agg(F.avg("v").alias("v"), F.avg("a").alias("a"), F.avg("d").alias("d"), F.count("*").alias("vad_hits"))


def vad_with_fallback(docs: DataFrame, tokens: DataFrame, words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, v, a, d, vad_hits, vad_source): means over the words that have values of their own, else over emotion entries, each of a
    word's emotions weighing its share, else zeros."""
    own = vad_means(tokens, words)
    hit = tokens.join(lexicon.select("term", "v", "a", "d", "shared"), "term")
    entries = hit.groupBy("doc_id").agg(*[(F.sum(F.col(c) / F.col("shared")) / F.sum(1 / F.col("shared"))).alias(f"e_{c}") for c in "vad"], F.sum((F.lit(UNITS) / F.col("shared")).cast("long")).alias("e_units"))
    both = docs.select("doc_id").join(own, "doc_id", "left").join(entries, "doc_id", "left")
    source = F.when(F.col("vad_hits") > 0, "vad_lexicon").when(F.col("e_units") > 0, "emotion_lexicon").otherwise("none")
    hits = F.coalesce("vad_hits", (F.col("e_units") / UNITS).cast("long"), F.lit(0)).cast("long")
    return both.select("doc_id", *[F.coalesce(c, f"e_{c}", F.lit(0.0)).alias(c) for c in "vad"], hits.alias("vad_hits"), source.alias("vad_source"))


def longest_matches(docs: DataFrame, phrases: dict[str, str], negators: tuple[str, ...] = (), window: int = 0) -> DataFrame:
    """(doc_id, start, n_words, phrase, emotion, negated) of multi-word terms, longest first, left to right, matches consuming their words.

    phrases maps terms to an emotion.  A match whose first word is negated is consumed and marked.  Tokens come as an array a
    document (column `tokens`); the fold over them is sequential, hence Python.
    """
    table = {tuple(p.split()): (p, e) for p, e in phrases.items()}
    longest = max(map(len, table), default=1)
    negative = set(negators)

    def fold(batches):
        for batch in batches:
            out = []
            for doc, words in zip(batch["doc_id"], batch["tokens"], strict=True):
                words = list(words) if words is not None else []
                mask = np.zeros(len(words), bool)
                for i, w in enumerate(words):
                    if w in negative or (len(w) > 3 and w.endswith("n't")):
                        for j in range(i + 1, min(len(words), i + 1 + window)):
                            if words[j] in BOUNDARIES:
                                break
                            mask[j] = True
                i = 0
                while i < len(words):
                    for n in range(min(longest, len(words) - i), 0, -1):
                        if found := table.get(tuple(words[i : i + n])):
                            out.append((doc, i, n, found[0], found[1], bool(mask[i]) and words[i] not in negative))
                            i += n
                            break
                    else:
                        i += 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "n_words", "phrase", "emotion", "negated"])

    return docs.select("doc_id", "tokens").mapInPandas(fold, "doc_id long, start int, n_words int, phrase string, emotion string, negated boolean")


def emotional_words(docs: DataFrame, allowed: set[str], stops: set[str] = frozenset(), window: int = 3, least_length: int = 2, negators: tuple[str, ...] = NEGATORS) -> DataFrame:
    """(doc_id, term, tf) of the allowed terms that stand in each text and are not negated.

    The longest phrase is taken first, left to right, and consumes its words; a single word that is not allowed itself counts for the
    first of its base words that is.  Phrases that begin with a negator are not negated by others.  The walk is sequential, hence Python.
    """
    allowed = frozenset(allowed) - frozenset(stops)
    phrases = {tuple(t.split()): t for t in allowed if " " in t}
    longest = max(map(len, phrases), default=1)

    def negates(words: list[str], i: int) -> bool:
        w = words[i]
        return (w in negators or (len(w) > 3 and w.endswith("n't"))) and not (w == "not" and i + 1 < len(words) and words[i + 1] in NOT_SKIPS)

    def walk(batches):
        bases: dict[str, str | None] = {}
        for batch in batches:
            out = []
            for doc, words in zip(batch["doc_id"], batch["words"], strict=True):
                words = list(words) if words is not None else []
                negative = [i for i in range(len(words)) if negates(words, i)]
                mask = set()
                for i in negative:
                    for j in range(i + 1, min(len(words), i + 1 + window)):
                        if words[j] in BOUNDARIES:
                            break
                        mask.add(j)
                starts, found, i = set(negative), Counter(), 0
                while i < len(words):
                    for n in range(min(longest, len(words) - i), 1, -1):
                        if term := phrases.get(tuple(words[i : i + n])):
                            if i in starts or not any(j in mask for j in range(i, i + n)):
                                found[term] += 1
                            i += n
                            break
                    else:
                        w = words[i]
                        if w not in bases:
                            bases[w] = None if w in stops else w if w in allowed else next((b for b in base_words(w) if b in allowed), None)
                        if len(w) >= least_length and i not in mask and bases[w] is not None:
                            found[bases[w]] += 1
                        i += 1
                out += [(doc, t, n) for t, n in found.items()]
            yield pd.DataFrame(out, columns=["doc_id", "term", "tf"])

    return docs.select("doc_id", tokens(F.col("text")).alias("words")).mapInPandas(walk, "doc_id long, term string, tf long")
