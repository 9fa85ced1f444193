"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean trigram query: an OR of clauses, each the set of trigrams that a text
must hold if a string of the rule occurs in it.  The index holds, for each trigram that some query names, the documents with it;
a clause's postings are intersected by counting, and only the documents that are left run the rule's expression.  Rules without
mandatory trigrams run over every text.
"""

from __future__ import annotations

import itertools
import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import running
from .store import settle, unused

_MOST_STRINGS = 96


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and not overlapping, whose group has at least `least` characters.

    prefilter, if given, is true of every text with a match that counts; it only saves work.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    prefilter: str | None = None


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),  # maximal runs, as [0-9a-f]+ with shorter matches dropped
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _least(clauses) -> Clauses:
    """Without clauses that ask for more than another one does."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    """Clauses of texts that satisfy both; a alone, which asks for less, where the product would be too large to look up."""
    joined = {x | y for x, y in itertools.product(a, b)}
    return _least(joined) if len(joined) <= 512 else a


def _of_strings(strings: set[str]) -> Clauses:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _query(nodes) -> tuple[set[str] | None, Clauses]:
    """The strings that a sequence of parsed nodes can match, if few, and its clauses otherwise; letters are folded."""
    run, clauses, exact = {""}, ANY, True
    for op, value in nodes:
        strings, own = None, ANY
        if op is rc.LITERAL:
            strings = {chr(value).lower()}
        elif op is rc.IN and value[0][0] is not rc.NEGATE:
            found = {chr(v).lower() for o, v in value if o is rc.LITERAL}
            strings = found if len(found) <= 8 and all(o is rc.LITERAL for o, _ in value) else None
        elif op is rc.SUBPATTERN:
            strings, own = _query(value[3])
        elif op is rc.BRANCH:
            parts = [_query(branch) for branch in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                own = _least(c for s, q in parts for c in (q if s is None else _of_strings(s)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = value
            got, own_inner = _query(inner)
            if got is not None and (low, high) == (0, 1):
                strings = got | {""}
            elif got is not None and low == high and low <= 8 and len(got) ** low <= _MOST_STRINGS:
                strings = {"".join(p) for p in itertools.product(got, repeat=low)}
            elif low:
                own = own_inner if got is None else _of_strings(got)
        elif op is rc.AT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a, b in itertools.product(run, strings)}
        else:
            clauses = _both(_both(clauses, _of_strings(run)), own if strings is None else _of_strings(strings))
            run, exact = {""}, False
    return (run, _of_strings(run)) if exact else (None, _both(clauses, _of_strings(run)))


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams, one of which any text with a match holds (in lower case) in full; {{}} if none is sure."""
    return _query(rp.parse(pattern))[1]


def _any_of(trigrams: list[str]) -> str:
    """A pattern whose group is, at each place of a text where one of the trigrams begins, that trigram; they are tried by their
    first and second characters, and overlapping ones are all found."""

    def one(chars) -> str:
        return "[" + "".join(sorted({re.escape(c) for c in chars})) + "]"

    branches = []
    for first, group in itertools.groupby(sorted(trigrams), lambda t: t[0]):
        seconds = [re.escape(second) + one(t[2] for t in rest) for second, rest in itertools.groupby(group, lambda t: t[1])]
        branches.append(f"{re.escape(first)}(?:{'|'.join(seconds)})")
    return f"(?={one(t[0] for t in trigrams)})(?=({'|'.join(branches)}))"


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index (trigram, key) of the named trigrams, over lower-cased whole texts, each read once."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(_any_of(trigrams)), F.lit(1))
    return docs.select(F.col(key).alias("__key"), F.explode(F.array_distinct(found)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__key, __kinds): for each document that some indexed rule may match, which ones.

    Postings are combined by document, rule and clause, so a trigram that most documents hold makes no large group.
    """
    wanted = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(sorted(trigram_query(r.pattern), key=sorted)) for t in sorted(c) if trigram_query(r.pattern) != ANY]
    terms = docs.sparkSession.createDataFrame(wanted, "kind string, clause int, trigram string, need int")
    index = postings(docs, sorted({w[2] for w in wanted}), key, text)
    hits = index.join(F.broadcast(terms), "trigram")  # as many rows as the rules have trigrams
    full = hits.groupBy("__key", "kind", "clause", "need").agg(F.countDistinct("trigram").alias("have")).where("have = need")
    return full.groupBy("__key").agg(F.collect_set("kind").alias("__kinds"))


def _bound(value: Column, body) -> Column:
    """body of a value that is found once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, value>> of the rule's matches (value: its length); positions in code points, end exclusive.

    Lengths of the matches and of the text between them, summed from the left, give the positions.
    """
    matches, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    lengths = lambda c: F.transform(c, F.length)
    value = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else lengths(matches)
    sizes = F.filter(F.arrays_zip(lengths(between).alias("gap"), lengths(matches).alias("size"), value.alias("value")), lambda x: x["size"].isNotNull())
    placed = running(
        sizes,
        "int",
        F.lit(0),
        "struct<start:int,end:int,value:int>",
        lambda at, x: at + x["gap"] + x["size"],
        lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")),
    )
    return F.filter(placed, lambda x: x["value"] >= rule.least)


def _ranked(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", name: str = "secrets") -> DataFrame:
    """docs with an array<struct<start int, rank int, kind string, end int>> of secrets added, by start and then rule order.

    A null text counts as empty, and very long ones are taken whole, in time that grows with their length and matches.  Rows that
    share a key share their candidates, which are then verified by text; a null key is a key.  Other columns stay, whatever their
    names; one with the added name is replaced.  An empty table gives an empty result.  The candidates are settled in the shared
    folder, so that the planner broadcasts them where their size allows it and shuffles the texts otherwise.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ANY)
    own = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:int>>)")
    of, kinds = unused(docs, "candidate", "kinds")
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    if indexed:
        found = settle(candidates(docs.select(key, text), indexed, key, text), "secret-candidates").toDF(of, kinds)
        docs = docs.join(found, docs[key].eqNullSafe(found[of]), "left")
    else:
        docs = docs.withColumn(kinds, F.lit(None).cast("array<string>"))
    parts = []
    for rank, rule in enumerate(rules):
        runs = F.array_contains(kinds, rule.kind) if rule in indexed else F.lit(True)
        if rule.prefilter:
            runs = runs & own.rlike(rule.prefilter)
        parts.append(_ranked(F.when(F.coalesce(runs, F.lit(False)), spans(own, rule)).otherwise(none), rank, rule.kind))
    return docs.select(*columns, F.array_sort(F.concat(*parts)).alias(name))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


#: Code points of a piece that a cut has to walk through.
_PIECE = 4096


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is given in pieces of _PIECE."""
    first, last = F.floor(start / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")
    at, to = (start % _PIECE).cast("int"), ((end - 1) % _PIECE).cast("int") + 1
    head, tail = F.substring(pieces[first], at + 1, F.lit(_PIECE)), F.substring(pieces[last], F.lit(1), to)
    across = F.concat(head, F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), tail)
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(pieces[first], at + 1, to - at)).otherwise(across)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping secrets in the text replaced by a mark (null texts stay null); n_chars, where there is one, follows.

    Very long texts are redacted whole: what stands between runs is cut out of pieces of the text, so the time grows with the
    text's length and its secrets.  Rows without a secret are as they were; so are repeated rows, null keys and other columns.
    """
    (name,) = unused(docs, "secrets")
    found = scan(docs, rules, key, text, name)
    # A span that begins at or after the end of all before it opens a run; the text kept before it reaches back to that end.
    opened = running(F.col(name), "int", F.lit(0), "struct<from:int,to:int>", lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("from"), s["start"].alias("to")))
    kept = F.filter(opened, lambda x: x["to"] >= x["from"])
    until = F.array_max(F.transform(name, lambda s: s["end"]))
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    redacted = _bound(pieces, lambda p: F.concat(F.array_join(F.transform(kept, lambda x: F.concat(_cut(p, x["from"], x["to"]), F.lit(mark))), ""), _cut(p, until, F.length(text))))
    out = found.withColumn(text, F.when(F.size(name) > 0, redacted).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
