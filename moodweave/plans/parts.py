"""Registered queries over single operators of the engine, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config, load
from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import chunking, clouds, comparison, features, lexicon, measures, metrics, models, neighbours, rollups, sampling
from ..operators import transport as ot
from ..operators.lexicon import EMOTIONS
from . import catalogue as cat
from . import oracles as sql
from .connectors import _t, _values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(statement: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if statement is not None:
            ORACLES[f.__name__] = statement
        return f

    return register


_r = cat._r
_docs = cat._docs
_AXES = "round(v, 6) AS v, round(a, 6) AS a, round(d, 6) AS d"


# --- text


@query("WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT doc_id, len(l) AS n_lines, md5(array_to_string([lpad(i::VARCHAR, greatest(5, length(len(l)::VARCHAR))::INT, '0') || '|' || l[i] FOR i IN range(1, len(l) + 1)], chr(10))) AS numbered FROM l")
def text_numbered_lines(spark, sf):
    n = _docs(spark, sf).select("doc_id", tx.numbered_lines(F.col("text")).alias("l"))
    return n.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("numbered"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN json_extract_string(props, '$.k') END AS k FROM events")
def text_json_salvage(spark, sf):
    """JSON as models answer: plain, fenced, fenced and named, between words, and broken."""
    e, n = _t(spark, sf, "events"), F.col("event_id") % 5
    said = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(n == 3, F.concat(F.lit("The answer is "), "props", F.lit(", I think."))).otherwise(F.concat(F.lit("{"), "props"))
    return e.select("event_id", F.get_json_object(tx.outermost_json(said), "$.k").alias("k"))


_LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"WITH {sql.ARR} SELECT doc_id, len(ts) AS n_words, md5(array_to_string(ts, ' ')) AS words FROM arr")
def tok_normal_form(spark, sf):
    """Words of texts spelt in full-width letters, which the normal form makes plain again."""
    wide = F.translate(F.col("text"), _LATIN, "".join(chr(ord(c) + 0xFEE0) for c in _LATIN))
    words = _docs(spark, sf).select("doc_id", tx.nfkc(wide).alias("text")).select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words"))


_BLANKED = "regexp_replace(coalesce(text, ''), '\\.\\n', '.' || chr(10) || ' ' || chr(10), 'g')"
_PARTS = f"b AS (SELECT doc_id, {_BLANKED} AS text FROM documents), s AS (SELECT doc_id, text, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN regexp_split_to_array(text, '\\n\\s*\\n+')], lambda x: x <> '') AS p FROM b), parts AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM s)"


def _blanked(spark, sf) -> DataFrame:
    """Texts with a blank line after each line that ends a sentence."""
    return _docs(spark, sf).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\\.\n", ".\n \n"))


@query(f"WITH {_PARTS} SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS parts FROM parts")
def text_paragraphs(spark, sf):
    p = _blanked(spark, sf).select("doc_id", tx.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("parts"))


_BUDGET, _STRIDE = 128, 32


def _packed(parts: str) -> str:
    """Greedy packing as a recursion over each document's paragraphs; a longer one gives its windows at once."""
    w = "list_filter(regexp_split_to_array(x, '\\s+'), lambda t: t <> '')"
    return (
        f"WITH RECURSIVE {parts}, n AS (SELECT doc_id, list_filter([len({w}) FOR x IN p], lambda c: c > 0) AS c FROM parts), "
        "f AS (SELECT doc_id, c, 0 AS k, 0 AS held, 0 AS made, []::STRUCT(chunk BIGINT, body BIGINT, fresh BIGINT)[] AS done FROM n UNION ALL "
        f"SELECT doc_id, c, k + 1, CASE WHEN big THEN 0 WHEN closed THEN size ELSE held + size END, made + closed::INT + CASE WHEN big THEN windows ELSE 0 END, "
        f"(CASE WHEN closed THEN [{{'chunk': made, 'body': held, 'fresh': held}}] ELSE [] END) || (CASE WHEN big THEN [{{'chunk': made + closed::INT + i, 'body': least({_BUDGET}, size - i * {_BUDGET - _STRIDE}), 'fresh': CASE WHEN i = 0 THEN {_BUDGET} ELSE greatest(1, least({_BUDGET}, size - i * {_BUDGET - _STRIDE}) - {_STRIDE}) END}} FOR i IN range(windows)] ELSE [] END) "
        f"FROM (SELECT *, c[k + 1] AS size, c[k + 1] > {_BUDGET} AS big, held > 0 AND (c[k + 1] > {_BUDGET} OR held + c[k + 1] > {_BUDGET}) AS closed, (1 + ceil((c[k + 1] - {_BUDGET}) / {float(_BUDGET - _STRIDE)}))::BIGINT AS windows FROM f WHERE k < len(c)) t), "
        "o AS (SELECT doc_id, unnest(done) AS x FROM f UNION ALL SELECT doc_id, {'chunk': made, 'body': held, 'fresh': held} FROM f WHERE k = len(c) AND held > 0) "
        "SELECT doc_id, x.chunk AS chunk, x.body AS body_tokens, x.fresh AS new_body_tokens FROM o"
    )


ORACLES["text_paragraph_chunks"] = _packed("parts AS (SELECT doc_id, [coalesce(text, '')] AS p FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\\n\\s*\\n') UNION ALL SELECT doc_id, CASE WHEN len(q) > 0 THEN q ELSE [text] END FROM (SELECT doc_id, text, list_filter([regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN regexp_split_to_array(text, '\\n\\s*\\n+')], lambda x: x <> '') AS q FROM documents WHERE regexp_matches(coalesce(text, ''), '\\n\\s*\\n')))")


@query(_packed(_PARTS))
def text_packed_paragraphs(spark, sf):
    out = chunking.pack_paragraphs(_blanked(spark, sf), _BUDGET, _STRIDE)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk", "body_tokens", "new_body_tokens")])


_MIDDLE = "substr(text, 301, greatest(0, length(text) - 600))"
ORACLES["text_truncated"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT *, regexp_extract_all(" + _MIDDLE + ", '(?is).{0,40}\\bidiot\\b.{0,40}')[1:2] AS hits FROM d) "
    "SELECT doc_id, length(CASE WHEN length(text) <= 1000 THEN text ELSE left(array_to_string([left(text, 300)] || hits || [right(text, 300)], chr(10) || '[...]' || chr(10)), 1000) END) AS n_left FROM f"
)


# --- casts, keys, labels


@query("SELECT event_id, round(CASE WHEN f IN ('true', 'false') THEN (f = 'true')::INT ELSE try_cast(f AS DOUBLE) END, 6) AS as_float, coalesce(try_cast(f AS BIGINT), -1) AS as_int FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id * 3)::VARCHAR WHEN 1 THEN 'true' WHEN 2 THEN 'x' || event_id ELSE (event_id // 2)::VARCHAR || '.5' END AS f FROM events) WHERE NOT (event_id % 4 = 3) UNION ALL SELECT event_id, (event_id // 2) + 0.5, -1 FROM events WHERE event_id % 4 = 3")
def cast_tolerant(spark, sf):
    e, n = _t(spark, sf, "events"), F.col("event_id") % 4
    half = F.floor(F.col("event_id") / 2).cast("string")
    said = F.when(n == 0, (F.col("event_id") * 3).cast("string")).when(n == 1, "true").when(n == 2, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.concat(half, F.lit(".5")))
    return e.select("event_id", F.round(lb.as_float(said), 6).alias("as_float"), F.coalesce(lb.as_int(said), F.lit(-1)).cast("long").alias("as_int"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'unknown' ELSE '20' || lpad((doc_id % 90 + 10)::VARCHAR, 2, '0') END AS year, "
    "(CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'lexicon+vad' ELSE 'lexicon' END ELSE CASE WHEN doc_id % 3 = 0 THEN 'vad' ELSE 'other' END END) || CASE WHEN (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 = 0 THEN '_imputed' ELSE '' END AS origin, "
    "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'passage: ' WHEN 2 THEN 'query: ' ELSE 'Instruct: Represent the term by its emotional meaning' || chr(10) || 'Query: ' END || coalesce(lang, '-') AS prompt, "
    "coalesce(CASE WHEN doc_id % 4 > 0 THEN (CASE WHEN doc_id % 4 = 1 THEN 512 ELSE 256 END) = 512 END, n_chars // 6 < 512)::INT AS usable FROM documents"
)
def label_origins(spark, sf):
    d, n = _t(spark, sf, "documents"), F.col("doc_id")
    day = F.when(n % 6 > 0, F.concat(F.lit("20"), F.lpad((n % 90 + 10).cast("string"), 2, "0"), F.lit("-02-03")))
    origin = lb.provenance(n % 2 == 0, n % 3 == 0, F.when(n % 5 == 0, 0.5).otherwise(1.0))
    term = F.coalesce("lang", F.lit("-"))
    prompt = F.when(n % 4 == 0, lb.prompt(term)).when(n % 4 == 1, lb.prompt(term, "passage")).when(n % 4 == 2, lb.prompt(term, "query")).otherwise(lb.prompt(term, "instruct"))
    stored = F.when(n % 4 == 1, 512).when(n % 4 > 1, 256)
    usable = lb.usable_silver(stored, 512, F.floor(F.col("n_chars") / 6))
    return d.select("doc_id", lb.group_key(day, by_year=True).alias("year"), origin.alias("origin"), prompt.alias("prompt"), usable.cast("int").alias("usable"))


@query("SELECT doc_id, [(CASE WHEN quality IS NULL THEN 0 ELSE (doc_id % 4 = 0 OR e = doc_id % 3 OR (e = 2 AND doc_id % 2 = 0))::INT END) FOR e IN range(3)]::VARCHAR AS mask FROM labels")
def label_masks(spark, sf):
    names = ["joy", "fear", "anger"]
    n, said = F.col("doc_id"), F.col("quality").isNotNull()
    positive = F.when(said, F.array(F.element_at(F.array(*map(F.lit, names)), (n % 3 + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    negative = F.when(said & (n % 2 == 0), F.array(F.lit("anger"))).otherwise(F.array().cast("array<string>"))
    mask = measures.label_mask(names, positive, negative, said & (n % 4 == 0))
    return _t(spark, sf, "labels").select("doc_id", F.concat(F.lit("["), F.array_join(mask.cast("array<string>"), ", "), F.lit("]")).alias("mask"))


@query(f"WITH {sql.LEX}, m AS (SELECT * FROM terms, (VALUES ('signed'), ('zero_one'), ('one_nine')) t(mode)), x AS (SELECT term, mode, {', '.join(f'CASE mode WHEN {chr(39)}zero_one{chr(39)} THEN ({c} + 1) / 2 WHEN {chr(39)}one_nine{chr(39)} THEN {c} * 4 + 5 ELSE {c} * 1.5 END AS {c}' for c in 'vad')} FROM m) SELECT term, mode, {', '.join(f'round(greatest(-1, least(1, CASE mode WHEN {chr(39)}zero_one{chr(39)} THEN 2 * {c} - 1 WHEN {chr(39)}one_nine{chr(39)} THEN ({c} - 5) / 4 ELSE {c} END)), 6) AS {c}' for c in 'vad')} FROM x")
def vad_rescaled(spark, sf):
    lex = cat._lexicon_terms(lexicon.demo_lexicon(_docs(spark, sf))).withColumn("mode", F.explode(F.array(F.lit("signed"), F.lit("zero_one"), F.lit("one_nine"))))
    raw = lambda c: F.when(F.col("mode") == "zero_one", (F.col(c) + 1) / 2).when(F.col("mode") == "one_nine", F.col(c) * 4 + 5).otherwise(F.col(c) * 1.5)
    return lex.select("term", "mode", *[F.round(vx.rescale_vad(raw(c), F.col("mode")), 6).alias(c) for c in "vad"])


# --- lexicon


def _lex(spark, sf) -> DataFrame:
    return lexicon.demo_lexicon(_docs(spark, sf))


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Terms of even ranks and of ranks divisible by three."""
    lex = _lex(spark, sf)
    return lex.where("rank % 2 = 0").select("term"), lex.where("rank % 3 = 0").select("term")


@query(f"WITH {sql.LEX}, x AS (SELECT DISTINCT term FROM lex WHERE rank % 2 = 0), y AS (SELECT DISTINCT term FROM lex WHERE rank % 3 = 0) SELECT (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)) AS either, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS both, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS first_only, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS second_only, (NOT EXISTS (SELECT * FROM x EXCEPT SELECT * FROM y))::INT AS subset")
def lex_overlap(spark, sf):
    o = lexicon.vocabulary_overlap(*_sides(spark, sf))
    return o.withColumn("subset", F.col("subset").cast("int"))


@query(
    f"WITH {sql.LEX}, s AS (SELECT term, emotion, v, a, d, rank % 4 = 0 AS proto, 0 AS src FROM lex UNION ALL SELECT term, emotion, a, d, v, rank % 3 = 0, 1 FROM lex WHERE rank % 2 = 0 UNION ALL SELECT term, 9, v, v, v, false, 2 FROM lex WHERE rank % 50 = 0 AND emotion = rank % 8), "
    f"b AS (SELECT *, row_number() OVER (PARTITION BY term, emotion ORDER BY proto, src DESC) AS place FROM s) SELECT term, emotion, {_AXES}, proto::INT AS is_prototype FROM b WHERE place = 1"
)
def lex_concat(spark, sf):
    lex = _lex(spark, sf).withColumn("emotion", F.col("emotion").cast("long"))
    main = lex.select("term", "emotion", "v", "a", "d", (F.col("rank") % 4 == 0).alias("is_prototype"))
    extra = lex.where("rank % 2 = 0").select("term", "emotion", F.col("a").alias("v"), F.col("d").alias("a"), F.col("v").alias("d"), (F.col("rank") % 3 == 0).alias("is_prototype"))
    own = lex.where("rank % 50 = 0 and emotion = rank % 8").select("term", F.lit(9).cast("long").alias("emotion"), "v", F.col("v").alias("a"), F.col("v").alias("d"))
    return lexicon.concat_sources([main, extra, own]).select("term", "emotion", *_r("v", "a", "d"), F.col("is_prototype").cast("int").alias("is_prototype"))


@query(
    f"WITH {sql.LEX}, nb AS (SELECT a.term AS term, b.term AS other FROM terms a JOIN terms b ON b.rank IN (a.rank + 1, a.rank + 2) WHERE a.rank % 3 = 0), "
    "m AS (SELECT emotion, other AS term, arg_min({'v': v, 'a': a, 'd': d}, lex.term) AS x FROM lex JOIN nb USING (term) GROUP BY emotion, other) "
    f"SELECT term, emotion, {_AXES} FROM (SELECT term, emotion, v, a, d FROM lex UNION ALL SELECT term, emotion, x.v, x.a, x.d FROM m WHERE NOT EXISTS (FROM lex l WHERE l.term = m.term AND l.emotion = m.emotion))"
)
def lex_expanded(spark, sf):
    lex = _lex(spark, sf)
    one = lex.select("term", "rank").distinct()
    near = one.where("rank % 3 = 0").withColumn("next", F.explode(F.array(F.col("rank") + 1, F.col("rank") + 2))).join(one.select(F.col("rank").alias("next"), F.col("term").alias("neighbour")), "next")
    return lexicon.expand_with_neighbours(lex, near.select("term", "neighbour")).select("term", F.col("emotion").cast("long").alias("emotion"), *_r("v", "a", "d"))


_MULT = "0.25 + 0.75 * pow(greatest(0.2, least(0.8, coalesce(g.weight, 0.5))), 2.0)"


@query(
    f"WITH {sql.LEX}, g AS (SELECT term, max(intensity) AS weight FROM lex WHERE rank % 2 = 0 GROUP BY term), c AS (SELECT doc_id, term, count(*) AS tf FROM tok JOIN terms USING (term) GROUP BY ALL), m AS (SELECT c.*, mode, CASE mode WHEN 'tf' THEN tf ELSE 1.0 END AS w, {_MULT} AS mult FROM c LEFT JOIN g USING (term), (VALUES ('tf'), ('uniform')) t(mode)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY mode, doc_id ORDER BY w * mult DESC, term DESC) AS rank FROM m) SELECT mode, doc_id, rank, term, round(w, 6)::DOUBLE AS w, round(mult, 6) AS mult FROM k WHERE rank <= 3"
)
def lex_weight_modes(spark, sf):
    docs = _docs(spark, sf)
    lex = lexicon.demo_lexicon(docs)
    counts = lexicon.token_table(docs).join(lex.select("term").distinct(), "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    given = lex.where("rank % 2 = 0").groupBy("term").agg(F.max("intensity").alias("weight"))
    out = None
    for mode in ("tf", "uniform"):
        one = clouds.ranked_terms(counts, None, 0, 3, given, 0.5, mode, 0.2, 0.8, 2.0, 0.75).select(F.lit(mode).alias("mode"), "doc_id", F.col("rank").cast("long").alias("rank"), "term", F.round("w", 6).alias("w"), F.round("term_weight", 6).alias("mult"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"WITH {sql.LEX}, ws AS (SELECT doc_id, avg(v) AS v, avg(a) AS a, avg(d) AS d, count(*) AS n FROM tok JOIN (FROM terms WHERE rank % 40 = 0) USING (term) GROUP BY doc_id), es AS (SELECT doc_id, sum(v / shared) / sum(1 / shared) AS v, sum(a / shared) / sum(1 / shared) AS a, sum(d / shared) / sum(1 / shared) AS d, sum(840 // shared) // 840 AS n FROM tok JOIN (FROM lex WHERE rank % 20 = 5) USING (term) GROUP BY doc_id) "
    "SELECT doc_id, round(coalesce(ws.v, es.v, 0), 6) AS v, round(coalesce(ws.a, es.a, 0), 6) AS a, round(coalesce(ws.d, es.d, 0), 6) AS d, coalesce(ws.n, es.n, 0)::BIGINT AS vad_hits, CASE WHEN ws.n > 0 THEN 'vad_lexicon' WHEN es.n IS NOT NULL THEN 'emotion_lexicon' ELSE 'none' END AS vad_source FROM arr LEFT JOIN ws USING (doc_id) LEFT JOIN es USING (doc_id)"
)
def lex_vad_fallback(spark, sf):
    docs = _docs(spark, sf)
    lex = lexicon.demo_lexicon(docs)
    words = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    out = features.vad_with_fallback(docs, words, cat._lexicon_terms(lex).where("rank % 40 = 0"), lex.where("rank % 20 = 5"))
    return out.select("doc_id", *_r("v", "a", "d"), "vad_hits", "vad_source")


# --- phrases: runs of pairs that overlap are taken from the left, every other one.

_PHRASES = f"ph AS (SELECT x.term AS t1, y.term AS t2, x.rank - 1 AS place FROM rk x JOIN rk y ON y.rank = x.rank + 1 WHERE x.rank <= 38 AND x.rank < (SELECT least(40, max(rank)) FROM rk)), one AS (SELECT term, rank - 21 AS place FROM rk WHERE rank BETWEEN 21 AND 40)"
ORACLES["lex_phrase_matches"] = (
    f"WITH {sql.RANKED}, {_PHRASES}, n AS (SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM tok), "
    "neg AS (SELECT doc_id, pos, term, after, (term = (SELECT term FROM rk WHERE rank = 11) OR (ends_with(term, 'n''t') AND length(term) > 3)) AS negator, term IN ('but', 'however', 'though', 'although', 'yet', 'nevertheless', 'nonetheless', 'still', 'except') AS bound FROM n), "
    "m AS (SELECT *, coalesce(max(CASE WHEN negator THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > coalesce(max(CASE WHEN bound THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), -1), false) AND term IS DISTINCT FROM (SELECT term FROM rk WHERE rank = 11) AS masked FROM neg), "
    "two AS (SELECT m.doc_id, m.pos, ph.place, masked FROM m JOIN ph ON m.term = ph.t1 AND m.after = ph.t2), isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM two), sel AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) % 2 = 1 AS taken FROM isl), "
    "used AS (SELECT doc_id, pos FROM sel WHERE taken UNION ALL SELECT doc_id, pos + 1 FROM sel WHERE taken), single AS (SELECT m.doc_id, m.pos, one.place, masked FROM m JOIN one USING (term) WHERE NOT EXISTS (FROM used u WHERE u.doc_id = m.doc_id AND u.pos = m.pos)), "
    "a AS (SELECT doc_id, place, masked FROM sel WHERE taken UNION ALL SELECT doc_id, place, masked FROM single) "
    f"SELECT doc_id, {[e for e in EMOTIONS]!r}[place % 8 + 1] AS emotion, count(*) AS n, count(*) FILTER (WHERE masked) AS negated FROM a GROUP BY ALL"
)


# --- score rows


@query(f"WITH {sql.PROF} SELECT doc_id, {', '.join(f'round(c[{i + 1}], 6) AS {e}' for i, e in enumerate(EMOTIONS))} FROM prof")
def score_aligned(spark, sf):
    """Vectors on an axis of their own in odd documents, put on the first row's."""
    odd = F.col("doc_id") % 2 == 1
    rows = cat._profiles(spark, sf).select("doc_id", F.when(odd, F.reverse("lex_counts")).otherwise(F.col("lex_counts")).alias("x"), F.when(odd, F.reverse(F.array(*map(F.lit, EMOTIONS)))).otherwise(F.array(*map(F.lit, EMOTIONS))).alias("emotions"))
    axis = measures.emotion_axis(rows)
    return rows.select("doc_id", vx.align(F.col("x"), F.col("emotions"), axis).alias("x")).select("doc_id", *[F.round(F.col("x")[i], 6).alias(e) for i, e in enumerate(axis)])


@query(_values([(True, "words", "pred_counts_calibrated_per_1k_words"), (False, "words", "pred_dist_calibrated"), (True, "lexicon", "lex_counts_per_1k_words"), (False, "lexicon", "lex_prior"), (True, "mass", "pred_counts_calibrated_per_1k_words")], "unbalanced, columns, chosen").replace("True", "1").replace("False", "0"))
def measure_choices(spark, sf):
    """The measure that a comparison takes, by what columns there are, and the mass that scales a distribution."""
    full = measures.calibrate(cat._profiles(spark, sf)).limit(0)
    lexical = full.select("doc_id", "n_words", "lex_counts", F.col("lex_counts").alias("lex_prior"))
    rows = [(int(u), name, measures.choose_measure(df, u)) for name, df in (("words", full), ("lexicon", lexical)) for u in (True, False)]
    return spark.createDataFrame([*rows, (1, "mass", measures.mass_of(full, "pred_dist_calibrated"))], "unbalanced int, columns string, chosen string")


@query(f"WITH {sql.CAL} SELECT doc_id, round(list_sum(p) * cal_mass / greatest(n_words, 1) * 1000, 6) AS mass, round(p[1] * cal_mass / greatest(n_words, 1) * 1000, 6) AS anger FROM cal WHERE lex_hits > 0")
def score_mass_scaled(spark, sf):
    """Distributions scaled to the mass of the first measure that all rows have, without rows that have none."""
    rows = measures.calibrate(cat._profiles(spark, sf)).withColumn("pred_dist_calibrated_valid", F.col("lex_hits") > 0)
    kept = measures.has_mass(rows, "pred_dist_calibrated")
    out = measures.mass_scaled(kept, "pred_dist_calibrated", measures.mass_of(rows, "pred_dist_calibrated")).select("doc_id", F.col("pred_dist_calibrated").alias("x"))
    return out.select("doc_id", F.round(vx.total(F.col("x")), 6).alias("mass"), F.round(F.col("x")[0], 6).alias("anger"))


_E = "list_transform(c, lambda e: exp(e / 100 - list_max(c) / 100))"


@query(f"WITH {sql.PROF}, b AS (SELECT doc_id, {_E} AS x, {sql._NORM.format(x='c')} AS q FROM prof) SELECT doc_id, round(0.7 * x[1] / list_sum(x) + 0.3 * q[1], 6) AS anger, round(0.7 * x[8] / list_sum(x) + 0.3 * q[8], 6) AS anticipation FROM b")
def score_prior_blend(spark, sf):
    p = cat._profiles(spark, sf).select("doc_id", "lex_counts").withColumn("m", vx.blend_prior(vx.normalise(F.col("lex_counts")), F.transform("lex_counts", lambda c: c / 100), 0.3))
    return p.select("doc_id", F.round(F.col("m")[0], 6).alias("anger"), F.round(F.col("m")[7], 6).alias("anticipation"))


def _gate_sql(density: float) -> str:
    return f"{sql.CAL}, gate AS (SELECT doc_id, rate, mass / greatest(n_words, 1) < {density} AND (lex_hits < 40 OR {sql._ENTROPY.format(p='p')} >= 0.99) AS low FROM cal)"


def _gated(spark, sf, density: float) -> DataFrame:
    g = measures.gate(measures.calibrate(cat._profiles(spark, sf)), density, 0.99, 40)
    return g.select("doc_id", "low_emotion_signal", F.when(F.col("doc_id") % 10 > 0, F.col("lex_per_1k_words")).alias("emotion_signal_per_1k_words"))


_STATS = "SELECT '{}' AS run, count(*) AS docs, count(*) FILTER (WHERE low) AS low_emotion_signal, (count(*) FILTER (WHERE low)) / count(*) AS rate, avg(CASE WHEN doc_id % 10 > 0 THEN rate END) AS mean FROM ({})"


@query(
    "WITH s AS (" + _STATS.format("base", f"WITH {_gate_sql(0.15)} SELECT * FROM gate") + " UNION ALL " + _STATS.format("strict", f"WITH {_gate_sql(0.3)} SELECT * FROM gate") + ") "
    "SELECT s.run, s.docs, s.low_emotion_signal, round(s.rate, 6) AS low_emotion_signal_rate, round(s.mean, 6) AS emotion_signal_per_1k_words_mean, round(s.rate - b.rate, 6) AS rate_change, round(s.mean - b.mean, 6) AS mean_change FROM s, s b WHERE b.run = 'base'"
)
def score_run_stats(spark, sf):
    """Signal statistics of two settings of the gate, and what changes from the first."""
    out = rollups.compare_runs({"base": _gated(spark, sf, 0.15), "strict": _gated(spark, sf, 0.3)})
    return out.select("run", "docs", "low_emotion_signal", *_r("low_emotion_signal_rate", "emotion_signal_per_1k_words_mean", "rate_change", "mean_change"))


@query(f"WITH {_gate_sql(0.15)}, s AS (SELECT doc_id, unnest(range(8)) AS emotion, unnest([round(e * cal_mass / greatest(n_words, 1) * 1000 + 1e-12, 6) FOR e IN p]) AS score FROM cal JOIN (FROM gate WHERE NOT low) USING (doc_id)) SELECT emotion, row_number() OVER (PARTITION BY emotion ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 5")
def rollup_strongest_documents(spark, sf):
    rows = measures.gate(measures.calibrate(cat._profiles(spark, sf)), 0.15, 0.99, 40)
    out = rollups.strongest_documents(rows, 8, 5)
    return out.select(F.col("emotion").cast("long").alias("emotion"), F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(
    f"WITH {sql.WINDOWS}, lx AS (WITH {sql.LEX} SELECT term, emotion, shared FROM lex), ch AS (SELECT doc_id, start // 48 AS chunk, CASE WHEN start = 0 THEN len(w) ELSE greatest(len(w) - 16, 1) END AS fresh, w FROM win WHERE len(w) > 0), wd AS (SELECT doc_id, chunk, unnest(w) AS term FROM ch), "
    "ct AS (SELECT doc_id, chunk, emotion, sum(840 // shared) / 840 AS n FROM wd JOIN lx USING (term) GROUP BY ALL), al AS (SELECT doc_id, chunk, fresh, e.e AS emotion FROM ch, range(8) e(e)), pr AS (SELECT al.*, (coalesce(n, 0) + 0.125) / (sum(coalesce(n, 0)) OVER (PARTITION BY doc_id, chunk) + 1) AS p FROM al LEFT JOIN ct USING (doc_id, chunk, emotion)), "
    "dc AS (SELECT doc_id, emotion, sum(p * fresh) / sum(fresh) AS p, count(*) AS chunks, sum(fresh)::BIGINT AS tokens FROM pr GROUP BY ALL) SELECT doc_id, any_value(chunks) AS n_chunks, any_value(tokens) AS n_tokens, arg_max(emotion, round(p, 9) - emotion * 1e-12) AS label, round(max(p), 6) AS top FROM dc GROUP BY doc_id"
)
def predict_documents(spark, sf):
    """Predictions of the lexicon's stand-in for an encoder by windows of words, averaged over each document."""
    words = cat._windows(spark, sf).select("doc_id", (F.col("w.start") / 48).cast("int").alias("chunk"), F.col("w.words").alias("w"), F.when(F.col("w.start") == 0, F.size("w.words")).otherwise(F.greatest(F.size("w.words") - 16, F.lit(1))).alias("new_tokens")).where(F.size("w") > 0)
    lex = _lex(spark, sf).select("term", "emotion", "shared")
    hits = words.select("doc_id", "chunk", F.explode("w").alias("term")).join(lex, "term").groupBy("doc_id", "chunk", "emotion").agg((F.sum((F.lit(features.UNITS) / F.col("shared")).cast("long")) / features.UNITS).alias("n"))
    packed = hits.groupBy("doc_id", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("emotion", "n"))).alias("m"))
    counts = F.array(*[F.coalesce(F.col("m")[e], F.lit(0.0)) for e in range(8)])
    chunks = words.drop("w").join(packed, ["doc_id", "chunk"], "left").withColumn("counts", counts)
    out = models.predict_documents(chunks, models.LexiconPredictions())
    p = F.transform("probs", lambda x: F.round(x, 9))
    label, _, _ = models.class_from_probabilities(p)
    return out.select("doc_id", "n_chunks", "n_tokens", label.cast("long").alias("label"), F.round(F.array_max("probs"), 6).alias("top"))


# --- evaluation and samples


@query("WITH l AS (SELECT quality AS g, CASE WHEN n_chars > 2000 THEN 1 WHEN n_chars > 300 THEN quality ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)), k AS (SELECT unnest([0, 1]) AS c), f AS (SELECT c, count(*) FILTER (WHERE g = c AND p = c) AS tp, count(*) FILTER (WHERE g <> c AND p = c) AS fp, count(*) FILTER (WHERE g = c AND p <> c) AS fn FROM l, k GROUP BY c) SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, sum(tp)::BIGINT AS hits, (SELECT count(*) FROM l) AS n FROM f")
def eval_macro_f1(spark, sf):
    rows = cat._labelled(spark, sf)
    probs = F.when(F.col("n_chars") > 2000, F.array(F.lit(0.2), F.lit(0.8))).when(F.col("n_chars") > 300, F.array(1.0 - F.col("quality"), F.col("quality") + 0.0)).otherwise(F.array(F.lit(0.5), F.lit(0.5)))
    best, _, _ = models.class_from_probabilities(probs)
    return metrics.macro_f1(rows, F.col("quality"), best, 2).select(*_r("macro_f1"), "hits", "n")


@query("WITH g AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id || ':13'), conv_id) AS k FROM g), s AS (SELECT c.*, CASE WHEN k <= greatest(1, least((SELECT count(*) FROM g) - 1, round_even((SELECT count(*) FROM g) * 0.2, 0)::BIGINT)) THEN 'dev' ELSE 'train' END AS split FROM conversations c JOIN r USING (conv_id)) SELECT split, coalesce(role, 'unlabelled') AS role, count(*) AS rows, count(DISTINCT conv_id) AS groups FROM s GROUP BY ALL UNION ALL SELECT split, 'ALL', count(*), count(DISTINCT conv_id) FROM s GROUP BY split")
def split_label_counts(spark, sf):
    rows = _t(spark, sf, "conversations")
    split = sampling.split_groups(rows, "conv_id", 0.2, "13")
    return sampling.split_counts(rows.join(split, "conv_id"), "split", "conv_id", "role")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.1, 0)::BIGINT)) THEN 'dev' ELSE 'train' END AS split FROM r")
def split_rows(spark, sf):
    return sampling.split_rows(_t(spark, sf, "documents"), "doc_id", 0.1, "7")


@query("SELECT doc_id, left(coalesce(text, ''), 40) AS preview FROM documents ORDER BY md5(doc_id || ':5'), doc_id LIMIT 25")
def sample_simple(spark, sf):
    return sampling.simple(_docs(spark, sf), "doc_id", 25, "5").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("preview"))


_BLOCKS = "b AS (SELECT item_id, list_filter([trim(x) FOR x IN string_split(text, '.')], lambda x: x <> '') AS l FROM benchmark WHERE text IS NOT NULL)"


@query(
    f"WITH RECURSIVE {_BLOCKS}, p AS (SELECT item_id, doc_id, l, text FROM b JOIN documents ON contains(text, l[1])), f AS (SELECT item_id, doc_id, l, text, 0 AS k, 1 AS place FROM p UNION ALL SELECT item_id, doc_id, l, text, k + 1, place + instr(substr(text, place), l[k + 1]) - 1 + length(l[k + 1]) FROM f WHERE k < len(l) AND contains(substr(text, place), l[k + 1])) "
    "SELECT item_id, doc_id, max(k)::BIGINT AS blocks, (max(k) = any_value(len(l)))::INT AS found FROM f GROUP BY item_id, doc_id"
)
def contain_blocks_in_order(spark, sf):
    """Documents that hold an item's first sentence: how many of its sentences follow in order, and whether all do."""
    b = F.filter(F.transform(F.split("text", r"\."), F.trim), lambda x: x != "")
    items = _t(spark, sf, "benchmark").where("text is not null").select("item_id", b.alias("blocks")).where(F.size("blocks") > 0)
    return chunking.ordered_blocks(items, _docs(spark, sf)).select("item_id", "doc_id", F.col("n").alias("blocks"), F.col("found").cast("int").alias("found"))


# --- transport

_PROTO = f"WITH {sql.LEX}, pr AS (SELECT emotion, avg(v) AS v, avg(a) AS a, avg(d) AS d FROM lex GROUP BY emotion), c AS (SELECT x.emotion AS i, y.emotion AS j, sqrt(pow(x.v - y.v, 2) + pow(x.a - y.a, 2) + pow(x.d - y.d, 2) + 1e-12) AS d FROM pr x, pr y)"


@query(f"{_PROTO} SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE round(d / greatest((SELECT avg(d) FROM c WHERE i <> j), 1e-8), 6) END AS cost FROM c")
def ot_prototype_cost(spark, sf):
    p = lexicon.prototypes(_lex(spark, sf)).orderBy("emotion").toPandas()  # a row an emotion
    c = ot.vad_cost(p[["v", "a", "d"]].to_numpy())
    return spark.createDataFrame([(int(a), int(b), round(float(c[i, j]), 6)) for i, a in enumerate(p["emotion"]) for j, b in enumerate(p["emotion"])], "i long, j long, cost double")


@query(f"WITH {sql.MEAN}, n AS (SELECT doc_id, {sql._NORM.format(x='x')} AS p FROM xs), m AS (SELECT {sql._NORM.format(x='x')} AS q FROM mean) SELECT doc_id, round(list_sum([abs(p[k] - q[k]) FOR k IN range(1, 9)]) / 2, 6) AS emd FROM n, m")
def ot_exact_distance(spark, sf):
    """Exact transport to the mean: over the uniform cost it is half the sum of differences."""
    return neighbours.exact_to_mean(cat._measured(spark, sf), cat.COST).select("doc_id", *_r("emd"))


def _rows_sql(mode: str) -> str:
    body = sql.ORACLES["ot_doc_neighbours"]
    return body[: body.index(" SELECT i, j, row_number()")] + " SELECT i, j, round(distance, 6) AS distance FROM d UNION ALL SELECT doc_id, doc_id, 0.0 FROM xs WHERE doc_id % 50 = 0"


@query(_rows_sql("unbalanced_divergence"))
def ot_distance_rows(spark, sf):
    out = neighbours.distance_rows(cat._measured(spark, sf), F.col("id") % 50 == 0, cat.COST, cat.SOLVER)
    near = F.floor(F.col("distance") * 1e6 + 0.5) / 1e6  # as round, which goes by way of decimals and takes longer than the rest of a row's way out
    return out.select(F.col("query").alias("i"), F.col("id").alias("j"), near.alias("distance"))


_PARTS_SQL = sql.ORACLES["ot_doc_unbalanced_parts"]


@query(f"SELECT doc_id, kl_b AS kl_a, kl_a AS kl_b, mass_b AS mass_a, mass_a AS mass_b FROM ({_PARTS_SQL})")
def ot_reversed(spark, sf):
    e = neighbours.reverse_explanation(neighbours.against_mean(cat._measured(spark, sf), cat.COST, cat.SOLVER))
    return e.select(F.col("id").alias("doc_id"), *_r("kl_a", "kl_b", "mass_a", "mass_b"))


@query(
    f"WITH {sql.PROF}, r AS (SELECT doc_id, {sql._NORM.format(x='c')} AS p, [(i = doc_id % 8)::INT FOR i IN range(8)] AS y, [(i % 3 <> doc_id % 3)::INT FOR i IN range(8)] AS m FROM prof), "
    "q AS (SELECT *, [greatest(1e-7, least(1 - 1e-7, x)) FOR x IN p] AS g, [x / list_sum(p) FOR x IN p] AS n FROM r), l AS (SELECT list_sum([-m[k] * (y[k] * ln(g[k]) + (1 - y[k]) * ln(1 - g[k])) FOR k IN range(1, 9)]) AS ce, list_sum(m) AS terms, (pow(p[1] - 0.1, 2) + pow(p[2] - 0.2, 2) + pow(p[3] - 0.3, 2)) / 3 AS vad, list_sum([abs(n[k] - 0.125) FOR k IN range(1, 9)]) / 2 AS tr FROM q) "
    "SELECT round(sum(ce) / sum(terms), 6) AS cross_entropy, round(avg(vad), 6) AS vad, round(avg(tr), 6) AS transport, round(sum(ce) / sum(terms) + 0.5 * avg(vad) + 0.25 * avg(tr), 6) AS loss FROM l"
)
def loss_composite(spark, sf):
    """What training minimises, over stored predictions: here the lexicon's, against labels made of the document's number."""
    n, eight = F.col("doc_id"), F.sequence(F.lit(0), F.lit(7))
    rows = cat._profiles(spark, sf).select("doc_id", vx.normalise(F.col("lex_counts")).alias("p"))
    labels, mask = F.transform(eight, lambda i: (i == n % 8).cast("int")), F.transform(eight, lambda i: (i % 3 != n % 3).cast("int"))
    moved = vx.total(F.transform(vx.normalise(F.col("p")), lambda x: F.abs(x - 0.125))) / 2
    each = models.row_losses(F.col("p"), labels, mask, F.slice("p", 1, 3), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), moved)
    return models.mean_loss(rows.select(each.alias("l")), "l", (1.0, 0.5, 0.25)).select(*_r("cross_entropy", "vad", "transport", "loss"))


# --- clouds

_CLOUD = (
    f"{sql.LEX}, {sql._CONF}, ok AS (SELECT term, v, a, d, conf FROM vad WHERE conf < 1 OR greatest(abs(v), least(greatest(a, 0), 1)) >= 0.45), "
    f"lm AS (SELECT term, CASE WHEN term IN (SELECT term FROM ok) THEN term ELSE (SELECT arg_min(x.l, x.k) FROM (SELECT unnest(ls) AS l, unnest(range(len(ls))) AS k) x WHERE x.l IN (SELECT term FROM ok)) END AS base FROM (SELECT term, CASE WHEN length(term) >= 3 THEN {sql._lemmas()} ELSE [] END AS ls FROM voc)), "
    "sg AS (SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM tok), "
    "ng AS (SELECT *, ((term IN ('not', 'no', 'never', 'without', 'nor', 'neither') OR (ends_with(term, 'n''t') AND length(term) > 3)) AND NOT (term = 'not' AND coalesce(after IN ('only', 'just', 'merely', 'simply'), false))) AS negator, term IN ('but', 'however', 'though', 'although', 'yet', 'nevertheless', 'nonetheless', 'still', 'except') AS bound FROM sg), "
    "mk AS (SELECT *, coalesce(max(CASE WHEN negator THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > coalesce(max(CASE WHEN bound THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), -1), false) AS masked FROM ng), "
    "ct AS (SELECT doc_id, base AS term, count(*) AS tf FROM mk JOIN lm USING (term) WHERE base IS NOT NULL AND NOT masked AND length(term) >= 2 GROUP BY doc_id, base), "
    "v2 AS (SELECT * FROM voc WHERE length(term) >= 2), common AS (SELECT term FROM v2 WHERE (SELECT count(*) FROM v2) > 100 ORDER BY df DESC, term DESC LIMIT 100), "
    "kp AS (SELECT * FROM ct WHERE term NOT IN (SELECT term FROM common)), df2 AS (SELECT term, count(*) AS df FROM kp GROUP BY term), "
    "wt AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM kp JOIN df2 USING (term)), "
    "cl AS (SELECT doc_id, wt.term, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, wt.term DESC) AS rank, v, a, d, conf FROM wt JOIN ok USING (term) QUALIFY rank <= 256)"
)


def _clouds(spark, sf) -> DataFrame:
    docs = _docs(spark, sf)
    return comparison.selected_clouds(docs, cat._base_vad(lexicon.demo_lexicon(docs)))


@query(f"WITH {_CLOUD} SELECT doc_id, rank, term, round(w, 6) AS w, {_AXES}, conf FROM cl")
def cloud_terms(spark, sf):
    """Every document's cloud, by the defaults of the token comparison: emotional words or their base words, not negated, nor too frequent."""
    c = _clouds(spark, sf).select("doc_id", F.posexplode(F.arrays_zip("terms", "w", "x", "conf")).alias("i", "e"))
    return c.select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("e.terms").alias("term"), F.round("e.w", 6).alias("w"), *[F.round(F.col("e.x")[i], 6).alias(x) for i, x in enumerate("vad")], F.col("e.conf").alias("conf"))


_CENTRE = f"{_CLOUD}, ce AS (SELECT doc_id, sum(w * v) / sum(w) AS v, sum(w * a) / sum(w) AS a, sum(w * d) / sum(w) AS d FROM cl GROUP BY doc_id), un AS (SELECT doc_id, v / greatest(sqrt(v * v + a * a + d * d), 1e-12) AS v, a / greatest(sqrt(v * v + a * a + d * d), 1e-12) AS a, d / greatest(sqrt(v * v + a * a + d * d), 1e-12) AS d FROM ce)"


@query(f"WITH {_CENTRE} SELECT doc_id, {_AXES} FROM un")
def cloud_centroids(spark, sf):
    c = clouds.centroids(_clouds(spark, sf))
    return c.select("doc_id", *[F.round(F.col("centroid")[i], 6).alias(x) for i, x in enumerate("vad")])


@query(f"WITH {_CENTRE}, pr AS (SELECT q.doc_id AS i, r.doc_id AS j, row_number() OVER (PARTITION BY q.doc_id ORDER BY (1 - round(q.v * r.v + q.a * r.a + q.d * r.d, 9)) / 2, r.doc_id) AS k FROM un q, un r WHERE q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM pr WHERE k <= 8")
def cloud_candidates(spark, sf):
    return clouds.candidate_pairs(_clouds(spark, sf), F.col("id") % 50 == 0, 8)


def _sinkhorn(clouds_sql: str, pairs: str, epsilon: float = 0.1, iterations: int = 30) -> str:
    """Common tables for the transport cost between clouds ca(id, x, w) of pr(i, j), a cloud against itself having a free diagonal:
    kn holds each pair's weights, costs and kernel, st its scalings by iteration, fin the last of them and the cost."""
    d = "least(1.0, sqrt(pow(p.x[r].v - q.x[s].v, 2) + pow(p.x[r].a - q.x[s].a, 2) + pow(p.x[r].d - q.x[s].d, 2)) / (2 * sqrt(3))) * p.x[r].conf * q.x[s].conf + 1 - p.x[r].conf * q.x[s].conf"
    return (
        f"{clouds_sql}, ca AS (SELECT id, list({{'v': v, 'a': a, 'd': d, 'conf': conf}} ORDER BY rank) AS x, list(greatest(w, 1e-8) ORDER BY rank) AS w FROM pts GROUP BY id), pr AS ({pairs}), "
        f"pb AS (SELECT i, j, [e / list_sum(p.w) FOR e IN p.w] AS a, [e / list_sum(q.w) FOR e IN q.w] AS b, [[CASE WHEN i = j AND r = s THEN 0.0 ELSE {d} END FOR s IN range(1, len(q.x) + 1)] FOR r IN range(1, len(p.x) + 1)] AS c FROM pr JOIN ca p ON p.id = i JOIN ca q ON q.id = j), "
        f"kn AS MATERIALIZED (SELECT *, [[exp(-e / {epsilon}) FOR e IN row] FOR row IN c] AS k, [[exp(-c[r][s] / {epsilon}) FOR r IN range(1, len(a) + 1)] FOR s IN range(1, len(b) + 1)] AS kt FROM pb), "
        "st AS (SELECT 0 AS t, i, j, a AS u, [1.0::DOUBLE FOR e IN b] AS z FROM kn UNION ALL SELECT t + 1, i, j, u2, [b[s] / list_dot_product(kt[s], u2) FOR s IN range(1, len(b) + 1)] "
        f"FROM (SELECT st.t, st.i, st.j, b, kt, [a[r] / list_dot_product(k[r], z) FOR r IN range(1, len(a) + 1)] AS u2 FROM st JOIN kn ON kn.i = st.i AND kn.j = st.j WHERE t < {iterations}) q), "
        f"fin AS (SELECT st.i, st.j, u, z, c, k, list_sum([u[r] * list_sum([k[r][s] * c[r][s] * z[s] FOR s IN range(1, len(z) + 1)]) FOR r IN range(1, len(u) + 1)]) AS cost FROM st JOIN kn ON kn.i = st.i AND kn.j = st.j WHERE t = {iterations})"
    )


@query(
    "WITH RECURSIVE "
    + _sinkhorn(f"{_CLOUD}, pts AS (SELECT doc_id AS id, * EXCLUDE (doc_id) FROM cl WHERE doc_id % 40 IN (0, 1))", "SELECT x.id AS i, y.id AS j FROM ca x JOIN ca y ON y.id = x.id + 1 WHERE x.id % 40 = 0 UNION SELECT x.id, x.id FROM ca x")
    + " SELECT f.i, f.j, round(f.cost - a.cost / 2 - b.cost / 2, 6) AS distance, round(list_max([list_max([f.u[r] * f.k[r][s] * f.z[s] * f.c[r][s] FOR s IN range(1, len(f.z) + 1)]) FOR r IN range(1, len(f.u) + 1)]), 6) AS top_flow FROM fin f JOIN fin a ON a.i = f.i AND a.j = f.i JOIN fin b ON b.i = f.j AND b.j = f.j WHERE f.i <> f.j"
)
def cloud_pair_distances(spark, sf):
    """Transport between the clouds of pairs of documents that follow one another."""
    c = _clouds(spark, sf).where(F.size("terms") > 0)
    ids = c.select("doc_id")
    pairs = ids.where("doc_id % 40 = 0").select(F.col("doc_id").alias("i"), (F.col("doc_id") + 1).alias("j")).join(ids.withColumnRenamed("doc_id", "j"), "j", "left_semi")
    out = clouds.compare_pairs(pairs, c)
    return out.select("i", "j", *_r("distance"), F.round(F.col("flows")[0]["contribution"], 6).alias("top_flow"))


ORACLES["ot_token_clouds"] = (
    "WITH RECURSIVE "
    + _sinkhorn(f"{_CLOUD}, pts AS (SELECT doc_id AS id, * EXCLUDE (doc_id) FROM cl)", "SELECT least(x.id, y.id) AS i, greatest(x.id, y.id) AS j FROM ca x JOIN ca y ON x.id <> y.id WHERE x.id % 50 = 0 UNION SELECT id, id FROM ca")
    + ", ds AS (SELECT f.i, f.j, f.cost - a.cost / 2 - b.cost / 2 AS distance FROM fin f JOIN fin a ON a.i = f.i AND a.j = f.i JOIN fin b ON b.i = f.j AND b.j = f.j WHERE f.i <> f.j), "
    "two AS (SELECT i, j, distance FROM ds WHERE i % 50 = 0 UNION ALL SELECT j, i, distance FROM ds WHERE j % 50 = 0), nn AS (SELECT i, j, distance, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM two QUALIFY rank <= 10) "
    "SELECT nn.i, nn.j, rank, round(distance, 6) AS distance, (SELECT least(3, list_sum([len([1 FOR s IN range(1, len(f.z) + 1) IF f.u[r] * f.k[r][s] * f.z[s] * f.c[r][s] > 0]) FOR r IN range(1, len(f.u) + 1)]))::BIGINT FROM fin f WHERE f.i = least(nn.i, nn.j) AND f.j = greatest(nn.i, nn.j)) AS n_flows FROM nn "
    "UNION ALL SELECT doc_id, NULL, NULL, NULL, 0 FROM documents WHERE doc_id % 50 = 0 AND doc_id NOT IN (SELECT id FROM ca)"
)


_POOLED = (
    f"{sql.LEX}, {sql._CONF}, lw AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, unnest({sql.WORDS}) AS term FROM documents), lt AS (SELECT lw.* FROM lw JOIN vad USING (term)), tp AS (SELECT lang, count(DISTINCT doc_id) AS docs FROM lt GROUP BY lang ORDER BY docs DESC, lang LIMIT 2), "
    "gn AS (SELECT lang, term, count(*) AS n FROM lt JOIN tp USING (lang) GROUP BY lang, term), gr AS (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM gn QUALIFY rank <= 256), "
    "pts AS (SELECT lang AS id, gr.rank, n::DOUBLE AS w, v, a, d, conf, gr.term FROM gr JOIN vad USING (term))"
)
ORACLES["ot_group_distance"] = (
    "WITH RECURSIVE "
    + _sinkhorn(_POOLED, "SELECT min(id) AS i, max(id) AS j FROM ca UNION SELECT id, id FROM ca")
    + ", tl AS (SELECT id, list(term ORDER BY rank) AS terms FROM pts GROUP BY id), fl AS (SELECT f.i, f.j, r, s, f.u[r] * f.k[r][s] * f.z[s] * f.c[r][s] AS contribution FROM fin f, range(1, 257) a(r), range(1, 257) b(s) WHERE f.i <> f.j AND r <= len(f.u) AND s <= len(f.z)) "
    "SELECT fl.i AS a, fl.j AS b, round(f.cost - x.cost / 2 - y.cost / 2, 6) AS distance, p.terms[r] AS from_term, q.terms[s] AS to_term, round(contribution, 6) AS contribution FROM fl JOIN fin f ON f.i = fl.i AND f.j = fl.j JOIN fin x ON x.i = fl.i AND x.j = fl.i JOIN fin y ON y.i = fl.j AND y.j = fl.j JOIN tl p ON p.id = fl.i JOIN tl q ON q.id = fl.j ORDER BY fl.contribution DESC, r, s LIMIT 8"
)


_TERM_VECTORS = f"WITH {sql.LEX}, {sql._CONF}, tv AS (SELECT term, v, a, d, conf, embedding::DOUBLE[] AS e FROM vad JOIN embeddings ON vec_id = vad.rank WHERE embedding IS NOT NULL)"


@query(
    f"{_TERM_VECTORS}, pc AS (SELECT x.term, y.term AS other, greatest(0.0, least(1.0, (1 - list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e))) / 2)) AS near, least(1.0, sqrt(pow(x.v - y.v, 2) + pow(x.a - y.a, 2) + pow(x.d - y.d, 2)) / (2 * sqrt(3))) * x.conf * y.conf AS far FROM tv x JOIN tv y ON x.term < y.term) "
    "SELECT term, count(*) AS n, round(min(near), 6) AS least_embedding, round(min(0.5 * near + 0.5 * far), 6) AS least_mixed, sum(round((0.5 * near + 0.5 * far) * 1000)::BIGINT)::BIGINT AS thousandths FROM pc GROUP BY term"
)
def cloud_embedding_cost(spark, sf):
    """Costs between lexicon terms by embeddings that were made elsewhere, alone and mixed with VAD; a term's vector is that of its rank."""
    lex = _lex(spark, sf)
    ranks = lex.select("term", F.col("rank").cast("long").alias("vec_id")).distinct()
    vectors = ranks.join(_t(spark, sf, "embeddings").where("embedding is not null"), "vec_id").select("term", F.col("embedding").alias("vector"))
    near = clouds.term_costs(cat._base_vad(lex), vectors, ot.TermCost("embedding")).withColumnRenamed("cost", "near")
    both = near.join(clouds.term_costs(cat._base_vad(lex), vectors, ot.TermCost("embedding_vad")), ["term", "other"]).where("term < other")
    return both.groupBy("term").agg(F.count("*").alias("n"), F.round(F.min("near"), 6).alias("least_embedding"), F.round(F.min("cost"), 6).alias("least_mixed"), F.sum(F.round(F.col("cost") * 1000).cast("long")).alias("thousandths"))


# --- models: Gauss-Jordan elimination of the normal equations, a column a step

_DIMS = 65
ORACLES["imputed_by_ridge"] = (
    "WITH RECURSIVE e AS (SELECT vec_id, [1.0::DOUBLE] || embedding::DOUBLE[] AS x, label / 10.0 AS v FROM embeddings WHERE embedding IS NOT NULL), l AS (SELECT vec_id, v, unnest(x) AS xv, unnest(range(len(x))) AS i FROM e), "
    "g AS (SELECT l.i AS i, m.i AS j, sum(l.xv * m.xv) + CASE WHEN l.i = m.i AND l.i > 0 THEN 1.0 ELSE 0.0 END AS s FROM l JOIN l m USING (vec_id) GROUP BY l.i, m.i UNION ALL SELECT i, 1000, sum(xv * v) FROM l GROUP BY i), r AS (SELECT i, list(s ORDER BY j) AS row FROM g GROUP BY i), m0 AS (SELECT list(row ORDER BY i) AS m FROM r), "
    "s AS (SELECT 1 AS k, m FROM m0 UNION ALL SELECT k + 1, [CASE WHEN q = k THEN [z / m[k][k] FOR z IN m[k]] ELSE [m[q][c] - m[q][k] / m[k][k] * m[k][c] FOR c IN range(1, len(m[q]) + 1)] END FOR q IN range(1, len(m) + 1)] FROM s WHERE k <= len(m)), w AS (SELECT [row[-1] FOR row IN m] AS w FROM s WHERE k = len(m) + 1) "
    "SELECT vec_id, round(greatest(-1, least(1, list_dot_product(x, w))), 6) AS v FROM e, w"
)

_ELIMINATE = "list_reduce([h] || [[[k::DOUBLE]] FOR k IN range(1, len(h) + 1)], lambda m, s: [CASE WHEN q = s[1][1] THEN [z / m[q][q] FOR z IN m[q]] ELSE [m[q][c] - m[q][s[1][1]::INT] / m[s[1][1]::INT][s[1][1]::INT] * m[s[1][1]::INT][c] FOR c IN range(1, len(m[q]) + 1)] END FOR q IN range(1, len(m) + 1)])"
ORACLES["outcome_regression"] = (
    f"WITH RECURSIVE {sql.PROF}, rw AS (SELECT doc_id, [1.0::DOUBLE] || c || [n_words::DOUBLE] AS x, toxic::DOUBLE AS y FROM prof JOIN labels USING (doc_id) WHERE toxic IS NOT NULL), "
    "st AS (SELECT 0 AS t, [0.0::DOUBLE FOR i IN range(10)] AS w UNION ALL SELECT t + 1, [w[i] + s[i][-1] FOR i IN range(1, 11)] FROM "
    f"(SELECT t, w, {_ELIMINATE} AS s FROM (SELECT t, w, list(row ORDER BY i) AS h FROM (SELECT t, w, i, list(v ORDER BY j) AS row FROM "
    "(SELECT t, w, i, j, sum(CASE WHEN j = 11 THEN (y - p) * x[i] ELSE p * (1 - p) * x[i] * x[j] END) + CASE WHEN i > 1 AND j = i THEN 1 WHEN i > 1 AND j = 11 THEN -w[i] ELSE 0 END AS v "
    "FROM (SELECT t, w, x, y, 1 / (1 + exp(-list_dot_product(x, w))) AS p FROM st, rw WHERE t < 25) a, range(1, 11) r(i), range(1, 12) c(j) GROUP BY t, w, i, j) b GROUP BY t, w, i) d GROUP BY t, w) e) f), "
    f"nm AS (SELECT {[*EMOTIONS, 'n_words']!r} AS n) SELECT unnest(n) AS feature, unnest([round(w[i], 6) FOR i IN range(2, 11)]) AS coefficient FROM st, nm WHERE t = 25"
)


# --- settings and explanations


@query(_values([("mode", "sinkhorn"), ("epsilon", "0.2"), ("top_k", "7"), ("low_signal_filter", "True"), ("drop_top_df", "100"), ("reg_m", "0.1")], "setting, value"))
def config_coerced(spark, sf):
    """Settings that come as texts take the types of their defaults; unknown names and nulls change nothing."""
    cfg = load({"mode": "sinkhorn", "epsilon": "0.2", "top_k": "7", "low_signal_filter": "yes", "drop_top_df": None, "no such": 1})
    names = ("mode", "epsilon", "top_k", "low_signal_filter", "drop_top_df", "reg_m")
    return spark.createDataFrame([(n, str(getattr(cfg, n))) for n in names], "setting string, value string")


_ASKED = "SELECT min(doc_id) AS p, max(doc_id) AS q FROM (FROM xs ORDER BY doc_id LIMIT 2)"


@query(
    f"WITH RECURSIVE {sql.PROF}, xs AS (SELECT doc_id, [greatest(e / greatest(n_words, 1) * 1000, 1e-8) FOR e IN c] AS x FROM prof WHERE lex_hits > 0), ask AS ({_ASKED}), pairs AS (SELECT y.doc_id AS i, z.doc_id AS j, y.x AS a, z.x AS b FROM xs y, xs z, ask WHERE y.doc_id IN (p, q) AND z.doc_id IN (p, q)){sql.SOLVED}, "
    "m AS (SELECT c.*, (c.cost + r.cost) / 2 - s.cost / 2 - t.cost / 2 AS distance FROM cost c JOIN cost r ON r.i = c.j AND r.j = c.i JOIN cost s ON s.i = c.i AND s.j = c.i JOIN cost t ON t.i = c.j AND t.j = c.j WHERE c.i < c.j) "
    "SELECT unnest(['distance', 'kl_a', 'kl_b', 'mass_a', 'mass_b', 'mass_plan', 'transport']) AS part, unnest([round(v, 6) FOR v IN [distance, kl_a, kl_b, list_sum(a), list_sum(b), list_sum(pa), transport]]) AS value FROM m"
)
def ot_pair_explained(spark, sf):
    """The parts of the distance between the first two documents that have terms."""
    rows = cat._profiles(spark, sf).where("lex_hits > 0")
    i, j = sorted(r["doc_id"] for r in rows.orderBy("doc_id").limit(2).select("doc_id").collect())
    e = comparison.explain_pair(rows, i, j, cat.COST, Config(reg_m=0.5), "lex_counts_per_1k_words")
    names = ("distance", "kl_a", "kl_b", "mass_a", "mass_b", "mass_plan", "transport")
    return spark.createDataFrame([(n, round(e[n], 6)) for n in names], "part string, value double")


_TWO = "SELECT min(doc_id) AS p, max(doc_id) AS q FROM (SELECT DISTINCT doc_id FROM cl ORDER BY doc_id LIMIT 2)"


@query(
    "WITH RECURSIVE "
    + _sinkhorn(f"{_CLOUD}, ask AS ({_TWO}), pts AS (SELECT doc_id AS id, * EXCLUDE (doc_id) FROM cl WHERE doc_id IN (SELECT p FROM ask UNION SELECT q FROM ask)", "SELECT x.id AS i, y.id AS j FROM ca x JOIN ca y ON x.id <= y.id").replace("SELECT q FROM ask), ca AS", "SELECT q FROM ask)), ca AS")
    + ", tl AS (SELECT id, list(term ORDER BY rank) AS terms FROM pts GROUP BY id), fl AS (SELECT f.i, f.j, r, s, f.u[r] * f.k[r][s] * f.z[s] * f.c[r][s] AS part FROM fin f, range(1, 257) a(r), range(1, 257) b(s) WHERE f.i <> f.j AND r <= len(f.u) AND s <= len(f.z)) "
    "SELECT q.terms[s] AS from_term, p.terms[r] AS to_term, round(f.cost - x.cost / 2 - y.cost / 2, 6) AS distance, round(part, 6) AS contribution FROM fl JOIN fin f ON f.i = fl.i AND f.j = fl.j JOIN fin x ON x.i = fl.i AND x.j = fl.i JOIN fin y ON y.i = fl.j AND y.j = fl.j JOIN tl p ON p.id = fl.i JOIN tl q ON q.id = fl.j ORDER BY part DESC, r, s LIMIT 8"
)
def cloud_pair_explained(spark, sf):
    """The largest flows between the clouds of the first two documents that have terms, seen from the second."""
    docs = _docs(spark, sf)
    vad = cat._base_vad(lexicon.demo_lexicon(docs))
    i, j = sorted(r["doc_id"] for r in comparison.selected_clouds(docs, vad).where(F.size("terms") > 0).orderBy("doc_id").limit(2).select("doc_id").collect())
    e = comparison.explain_clouds(docs, vad, j, i)
    return spark.createDataFrame([(f["from"], f["to"], round(e["distance"], 6), round(f["contribution"], 6)) for f in e["flows"]], "from_term string, to_term string, distance double, contribution double")
