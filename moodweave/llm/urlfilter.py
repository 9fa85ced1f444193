"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the few rules filed under them, and only those run their regular expressions.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import unused

TOKEN = r"[A-Za-z0-9]+"
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _may_be_token(op, value) -> bool:
    """Whether a parsed character or class can match a character of a token."""
    if op is rc.LITERAL:
        return chr(value) in _TOKEN_CHARS
    if op is rc.IN and value[0][0] is not rc.NEGATE:
        spaces = (rc.CATEGORY_SPACE, rc.CATEGORY_NOT_WORD)
        return any(v not in spaces if o is rc.CATEGORY else any(chr(c) in _TOKEN_CHARS for c in range(v[0], min(v[1], 127) + 1)) if o is rc.RANGE else _may_be_token(o, v) for o, v in value)
    if op is rc.IN:
        barred = {c for o, v in value for c in ((chr(v),) if o is rc.LITERAL else map(chr, range(v[0], min(v[1], 127) + 1)) if o is rc.RANGE else _TOKEN_CHARS if v is rc.CATEGORY_WORD else ())}
        return not _TOKEN_CHARS <= barred
    return True


def _apart(nodes: list, left: bool) -> bool:
    """Whether, whatever the nodes match, a token that they follow (left: that follows them) is surely at its end there."""
    if not nodes:
        return False
    (op, value), rest = (nodes[-1], nodes[:-1]) if left else (nodes[0], nodes[1:])
    more = lambda inner: _apart([*rest, *inner] if left else [*inner, *rest], left)
    if op is rc.AT:
        return True  # an end of the text, or of a word
    if op is rc.SUBPATTERN:
        return more(value[3])
    if op is rc.BRANCH:
        return all(more(branch) for branch in value[1])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        return more(value[2]) and (value[0] > 0 or _apart(rest, left))
    return op in (rc.LITERAL, rc.IN) and not _may_be_token(op, value)


def _clauses(nodes, before: list, after: list) -> list[frozenset[str]]:
    nodes, i, out = list(nodes), 0, []
    while i < len(nodes):
        op, value = nodes[i]
        if op is rc.SUBPATTERN:
            nodes[i : i + 1] = list(value[3])
            continue
        j = i + 1
        if op is rc.LITERAL and chr(value) in _TOKEN_CHARS:
            while j < len(nodes) and nodes[j][0] is rc.LITERAL and chr(nodes[j][1]) in _TOKEN_CHARS:
                j += 1
            if _apart([*before, *nodes[:i]], True) and _apart([*nodes[j:], *after], False):
                out.append(frozenset(["".join(chr(v) for _, v in nodes[i:j]).lower()]))
        elif op is rc.BRANCH:
            each = [_clauses(branch, [*before, *nodes[:i]], [*nodes[j:], *after]) for branch in value[1]]
            if all(each):
                out.append(frozenset().union(*(max(c, key=lambda x: min(map(len, x))) for c in each)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0]:
            out += _clauses(value[2], [*before, *nodes[:i]], [])
        i = j
    return out


def token_clauses(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case tokens, found by parsing the pattern: any text with a match has a token of each set, as a whole token.

    A literal counts where what stands beside it in the pattern can't be part of a token; of alternatives, each gives a token.
    """
    return _clauses(rp.parse(pattern, re.S), [], [])


@dataclass(frozen=True)
class Rule:
    """name is reported; pattern is searched in `key` (lower-cased host, then path); of the rules that match, the lowest tier and
    then the longest name decides."""

    name: str
    verdict: str
    pattern: str
    tier: int = 0

    @property
    def tokens(self) -> tuple[str, ...]:
        """Tokens that every match holds."""
        return tuple(t for c in token_clauses(self.pattern) if len(c) == 1 for t in c)


def host_rule(name: str, verdict: str) -> Rule:
    """A rule such as net/es/: it fits the host and its subdomains if the path starts with the rule's."""
    host, _, rest = name.partition("/")
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + rest)}")


def pattern_rule(name: str, verdict: str, pattern: str) -> Rule:
    """A general pattern, for URLs that no host rule fits."""
    return Rule(name, verdict, pattern, 1)


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules of a text file: verdict, kind (host or pattern) and rule, split by tabs; blank lines and those that begin with # are
    left out, other lines are errors.  A list of rules is read whole by the driver."""
    out = []
    for row in spark.read.text(path).collect():
        line = row[0].strip()
        if not line or line.startswith("#"):
            continue
        verdict, kind, rule = line.split("\t")
        if verdict not in ("allow", "block") or kind not in ("host", "pattern"):
            raise ValueError(f"no rule: {line}")
        out.append(host_rule(rule, verdict) if kind == "host" else pattern_rule(rule, verdict, rule))
    return tuple(out)


#: The rules of the production list.  Host rules decide first; the others give the verdict of URLs that no host rule fits.
HOST_RULES = tuple(host_rule(n, v) for n, v in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")))
PATTERN_RULES = (
    *(pattern_rule(f"/{t}/", "block", rf"^[^/]*/(?:.*/)?{t}(?:/|\.|$)") for t in ("ads", "adserver", "banner", "login", "signup", "cart", "checkout", "casino", "porn", "tracker")),
    pattern_rule("numbered ad host", "block", r"^(?:[^/]*\.)?ads?[0-9]+\."),
    pattern_rule("tracking pixel", "block", r"/(?:pixel|beacon)\.(?:gif|png|php)$"),
    pattern_rule("blog log-in", "block", r"/wp-(?:login|signup)\.php$"),
    pattern_rule("session id", "block", r";jsessionid="),
)
RULES = HOST_RULES + PATTERN_RULES


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A to Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(keys: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """How many URLs hold each token that some rule names; at most one row a token comes to the driver."""
    named = sorted({t for r in rules for c in token_clauses(r.pattern) for t in c})
    if not named:
        return {}
    wanted = keys.sparkSession.createDataFrame([(t,) for t in named], "token string")
    found = keys.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("key"), F.lit(TOKEN), F.lit(0)))).alias("token"))
    return {t: 0 for t in named} | {r.token: r.n for r in found.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Each rule under the tokens of that clause which the fewest URLs hold (ties: the smaller); under None those without any clause,
    which run on every URL."""
    index: dict[str | None, list[Rule]] = {}
    for rule in rules:
        clauses = token_clauses(rule.pattern)
        for token in min(clauses, key=lambda c: (sum(counts.get(t, 0) for t in c), sorted(c))) if clauses else (None,):
            index.setdefault(token, []).append(rule)
    return index


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (name of the deciding host rule, else null), pattern_rule and verdict added.

    A null url, or one without ://, has an empty host and path, no rule and the default verdict.  Very long URLs are judged whole,
    repeated rows alike; of rules with names of one length the lesser name decides.  Existing columns with one of the added names
    are replaced, others stay.  An empty table gives an empty result.  The rule list is held by the caller, so what is sent to
    executors does not grow with the pages.
    """
    host, path, said = unused(pages, "of_host", "of_path", "said")
    keyed = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    if rules:
        index = build_index(rules, token_counts(keyed.select(F.concat(host, path).alias("key")), rules))
        shipped = keyed.sparkSession.sparkContext.broadcast({t: [(r.tier, -len(r.name), r.name, r.verdict, r.pattern) for r in rs] for t, rs in index.items()})

    @F.pandas_udf("rule string, pattern_rule string, verdict string")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_token = {t: [(tier, order, name, verdict, re.compile(p, re.S)) for tier, order, name, verdict, p in rs] for t, rs in shipped.value.items()}
        tokens, always = re.compile(TOKEN), by_token.get(None, [])
        for keys in batches:
            rows = []
            for key in keys:
                fetched = [always, *(by_token[t] for t in set(tokens.findall(key.lower())) if t in by_token)]
                tier, _, name, verdict = min((c[:4] for cs in fetched for c in cs if c[4].search(key)), default=(0, 0, None, default))
                rows.append((name if tier == 0 else None, name if tier else None, verdict))
            yield pd.DataFrame(rows, columns=["rule", "pattern_rule", "verdict"])

    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pattern_rule"), F.lit(default).alias("verdict"))
    judged = keyed.withColumn(said, decide(F.concat(host, path)) if rules else none)
    return judged.withColumns({"host": F.col(host), "path": F.col(path)} | {c: F.col(said)[c] for c in ("rule", "pattern_rule", "verdict")}).drop(host, path, said)
