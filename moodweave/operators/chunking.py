"""Boilerplate removal, packing of paragraphs into chunks, ordered containment."""

from __future__ import annotations

import difflib
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..functions import vectors as vx

# Phrases of running headers, and how parties are separated.
HEADERS = r"(?i)\b(international court of justice|court internationale de justice|reports of judgments|advisory opinions and orders|recueil des arrets|avis consultatifs|ordonnances?|case concerning|application of|order of|ordonnance du|judgment of|judgement of|table of contents)\b"
CASE_MARK = r"(?i)\b(v\.|c\.)\b"


def strip_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", early: int = 80, repeats: int = 3) -> DataFrame:
    """(key, text) without page numbers and labels, tables of contents, and running titles in capitals; null texts give empty ones.

    A table of contents opens at a line that says so and ends with a second blank line in a row or with a line that isn't like its
    entries.  All is found inside a document's array of lines, so nothing is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("t"), tx.strip_diacritics(body).alias("plain"))
    rows = rows.select("key", tx.lines(F.col("t")).alias("line"), F.transform(tx.lines(F.col("plain")), tx.collapse).alias("norm"))

    def read(x, i):
        line, norm = x["line"], x["norm"]
        blank = F.trim(line) == ""
        page = ~blank & (tx.is_page_number(line) | tx.is_page_label(line))
        opens = norm.startswith("table of contents") & ~page
        title = tx.is_caps(line)
        sure = (i < early) | norm.rlike(HEADERS) | norm.rlike(CASE_MARK) | F.trim(line).rlike(r"^\d{1,4}\s+[A-Z]")
        return F.struct(line.alias("line"), norm.alias("norm"), blank.alias("blank"), page.alias("page"), opens.alias("opens"), (~blank & ~page & ~opens & ~tx.is_toc_like(F.trim(line))).alias("other"), title.alias("title"), (title & sure).alias("sure"))

    rows = rows.withColumn("f", F.transform(F.arrays_zip("line", "norm"), read))
    long_ = F.array_sort(F.filter("norm", lambda n: F.length(n) >= 6))
    alike = vx.let(lambda t: F.array_distinct(F.array_compact(F.transform(t["s"], lambda n, i: F.when(n == F.get(t["s"], i + repeats - 1), n)))), s=long_)
    ends = F.transform("f", lambda x, i: F.struct(x["opens"].alias("opens"), (x["other"] | (x["blank"] & F.coalesce(F.get(F.col("f"), i - 1)["blank"], F.lit(False)))).alias("ends")))
    step = lambda open_, x: F.when(x["opens"], F.lit(True)).when(x["ends"], F.lit(False)).otherwise(open_)
    inside = F.when(F.exists("f", lambda x: x["opens"]), vx.running(ends, "boolean", F.lit(False), "boolean", step, step))
    rows = rows.select("key", "f", alike.alias("alike"), inside.alias("inside"))
    stays = F.filter("f", lambda x, i: x["blank"] | ~(x["page"] | F.coalesce(F.get(F.col("inside"), i), F.lit(False)) | x["sure"] | (x["title"] & F.array_contains("alike", x["norm"]))))
    return rows.select(F.col("key").alias(key), F.array_join(F.transform(stays, lambda x: x["line"]), "\n").alias(text))


def pack_paragraphs(docs: DataFrame, budget: int, stride: int = 0, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, special: int = 2) -> DataFrame:
    """(key, chunk, text, body_tokens, new_body_tokens): paragraphs in order, as many to a chunk as the budget allows; a longer
    paragraph gives windows that overlap by `stride`, of which only the tokens not seen before count as new.

    The budget is of words, or, with the path of a tokenizer file, of the tokenizer's tokens less `special`, those that a model adds;
    a window then is its tokens' span of the text, and the tokens of paragraphs put together are counted anew.
    """

    def units(p: str, encode) -> list[tuple[int, int]]:
        """Spans of a paragraph's tokens."""
        return [m.span() for m in re.finditer(r"\S+", p)] if encode is None else encode(p, add_special_tokens=False).offsets

    def spaced(p: str, spans: list[tuple[int, int]], encode) -> str:
        return " ".join(p[a:b] for a, b in spans) if encode is None else p[spans[0][0] : spans[-1][1]]

    def fold(it):
        encode = None
        if tokenizer is not None:
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(tokenizer).encode
        most = budget - special if encode else budget
        for pdf in it:
            out = []
            for k, parts in zip(pdf["key"], pdf["parts"], strict=True):
                held: list[str] = []
                n = made = 0

                def close() -> None:
                    nonlocal held, n, made
                    if held:
                        whole = "\n\n".join(held)
                        n = len(units(whole, encode)) if encode else n
                        out.append((k, made, whole, n, n))
                        held, n, made = [], 0, made + 1

                for p in parts:
                    words = units(p, encode)
                    if not words:
                        continue
                    if len(words) > most:
                        close()
                        start = 0
                        while True:
                            w = words[start : start + most]
                            out.append((k, made, spaced(p, w, encode), len(w), len(w) if start == 0 else max(1, len(w) - stride)))
                            made += 1
                            if start + most >= len(words):
                                break
                            start += most - stride
                        continue
                    if n + len(words) > most:
                        close()
                    held.append(p)
                    n += len(words)
                close()
            yield pd.DataFrame(out, columns=["key", "chunk", "text", "body_tokens", "new_body_tokens"])

    kind = docs.select(key).dtypes[0][1]
    rows = docs.select(F.col(key).alias("key"), tx.paragraphs(F.col(text)).alias("parts"))
    return rows.mapInPandas(fold, f"key {kind}, chunk int, text string, body_tokens int, new_body_tokens int").withColumnRenamed("key", key)


#: Items whose probes are looked for inside each document's row.
FEW = 4096


def contained(items: DataFrame, docs: DataFrame, probe_words: int = 8, item_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(item, doc): items whose words all stand in a document, in one run.

    A run that holds the item holds its first words; documents are probed by the hashes of their runs of that length, and only the
    pairs that agree are verified.  Items of fewer words are probed by a run of their own length.  Up to FEW items are compared
    inside the document's row; of more the runs are joined.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    asked = items.select(F.col(item_key).alias("item"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    asked = asked.withColumn("n", F.least(F.size("iw"), F.lit(probe_words))).withColumn("probe", F.xxhash64(F.array_join(F.slice("iw", 1, F.col("n")), " "), "n"))
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())  # at most probe_words numbers
    few = [r["probe"] for r in asked.select("probe").distinct().limit(FEW + 1).collect()]
    there = docs.select(F.col(key).alias("doc"), words(F.col("text")).alias("dw"))
    probes = None
    for n in lengths:
        runs = F.when(F.size("dw") >= n, F.transform(F.sequence(F.lit(1), F.size("dw") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("dw", i, F.lit(n)), " "), F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
        runs = F.array_intersect(runs, F.array(*map(F.lit, few))) if len(few) <= FEW else F.array_distinct(runs)
        one = there.select("doc", F.explode(runs).alias("probe"))
        probes = one if probes is None else probes.unionByName(one)
    if probes is None:
        return there.crossJoin(asked.select("item")).select("item", "doc").limit(0)
    met = probes.join(asked.select("item", "probe"), "probe").select("item", "doc").distinct()
    full = met.join(asked.select("item", F.concat(F.lit(" "), F.array_join("iw", " "), F.lit(" ")).alias("needle")), "item").join(there.select("doc", F.concat(F.lit(" "), F.array_join("dw", " "), F.lit(" ")).alias("hay")), "doc")
    return full.where(F.expr("instr(hay, needle) > 0")).select("item", "doc")


def ordered_blocks(items: DataFrame, docs: DataFrame, item_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(item, doc, n, found) of documents that hold an item's first block: how many of its blocks(array) stand there one after another,
    up to the first that doesn't, and whether all do.

    The first block's words but for its ends, which may be cut within a word, are looked up as `contained` does; blocks without such
    words are looked for in every text.
    """
    inner = F.array_compact(F.filter(F.split("first", r"\s+"), lambda w: w != ""))
    asked = items.select(item_key, "blocks", F.col("blocks")[0].alias("first")).withColumn("inner", F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))))
    looked = asked.where(F.size("inner") > 0).select(item_key, F.array_join("inner", " ").alias("text"))
    texts = docs.select(F.col(key), F.col("text").alias("body")).where("body is not null")
    pairs = contained(looked, docs, item_key=item_key, key=key).select(F.col("item").alias(item_key), F.col("doc").alias(key))
    met = pairs.join(asked.drop("inner"), item_key).join(texts, key)
    rest = asked.where(F.size("inner") == 0).drop("inner")
    if not rest.isEmpty():
        met = met.unionByName(texts.join(rest, F.contains("body", "first")))

    def step(acc, block):
        at = F.call_function("locate", block, F.col("body"), acc["at"])
        found = acc["open"] & (at > 0)
        return F.struct(F.when(found, at + F.length(block)).otherwise(acc["at"]).cast("int").alias("at"), (acc["n"] + found.cast("long")).alias("n"), found.alias("open"))

    start = F.struct(F.lit(1).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
    n = F.aggregate("blocks", start, step)["n"]
    return met.where(F.contains("body", "first")).select(item_key, key, n.alias("n"), (n == F.size("blocks")).alias("found"))


def _anchors(block: str) -> list[str]:
    """What a block may be found by where it does not stand exactly: its beginning, its first words, its middle."""
    words, middle = block.split(), len(block) // 2
    tried = [block[:80], block[:60], block[:40], " ".join(words[:8]) if len(words) >= 8 else "", " ".join(words[:12]) if len(words) >= 12 else "", block[middle : middle + 80] if len(block) > 160 else ""]
    return list(dict.fromkeys(a.strip() for a in tried if len(a.strip()) >= 20))


def _near(block: str, body: str, at: int) -> tuple[float, int]:
    """The largest share of a block that matches a window of the text from `at` on, and where that window begins."""
    places = {at}
    for a in _anchors(block):
        inside = block.find(a)
        places.update(max(at, at + m.start() - inside) for m in itertools.islice(re.finditer(re.escape(a), body[at:]), 10))
    shares = []
    for p in places:
        match = difflib.SequenceMatcher(None, block, body[p : p + 2 * len(block)], autojunk=False)
        shares.append((sum(m.size for m in match.get_matching_blocks()) / len(block), -p))
    share, p = max(shares)
    return share, -p


def blocks_in_order(pairs: DataFrame, least: float = 0.98, blocks: str = "blocks", text: str = "text") -> DataFrame:
    """pairs with `found` (every block stands in the text, in order) and `coverage` (the least share of a block that matches)."""

    def check(it):
        for pdf in it:
            found, cover = [], []
            for parts, body in zip(pdf[blocks], pdf[text], strict=True):
                at, low, ok, body = 0, 1.0, True, body or ""
                for block in parts if parts is not None else []:
                    where = body.find(block, at)
                    if where < 0 and block:
                        share, where = _near(block, body, at)
                        low, ok = min(low, share), ok and share >= least
                    at = max(at, where + len(block))
                found.append(ok)
                cover.append(low)
            yield pdf.assign(found=found, coverage=cover)

    return pairs.mapInPandas(check, StructType(list(pairs.schema.fields)).add("found", "boolean").add("coverage", "double"))
