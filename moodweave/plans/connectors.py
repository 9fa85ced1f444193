"""Registered queries over readers and sinks, each with its SQL: what a user would have on disk is written to the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjudication
from ..operators.lexicon import DEFAULT_PROTOTYPES
from ..sources import readers, sinks
from ..storage import new_path, settle, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _folder(spark: SparkSession, files: dict[str, str]) -> str:
    """A fresh folder with these files."""
    at = new_path(spark, "files")
    for name, text in files.items():
        sinks.text_file(spark, f"{at}/{name}", text)
    return at


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows, names: str) -> str:
    """A SELECT of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"


def _r(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- texts and rows

TEXTS = {
    "ICJ_001_2020-01-01_Judgment.txt": "INTERNATIONAL COURT OF JUSTICE\n12\nThe Court finds so.",
    "plain.txt": "INTERNATIONAL COURT OF JUSTICE\n12\nleft as it is",
    "deep/er/Upper.TXT": "a text in a folder",
    "notes.md": "not a text",
}


@query(_values([("ICJ_001_2020-01-01_Judgment", "The Court finds so."), ("plain", "INTERNATIONAL COURT OF JUSTICE|12|left as it is"), ("Upper", "a text in a folder")], "stem, body"))
def src_text_folder(spark, sf):
    return readers.text_folder(spark, _folder(spark, TEXTS)).select("stem", F.replace("text", F.lit("\n"), F.lit("|")).alias("body"))


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def src_json_lines(spark, sf):
    docs, at = _t(spark, sf, "documents"), new_path(spark, "json")
    sinks.json_lines(docs, at)
    return readers.json_lines(spark, at, docs.schema).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_id % 7 <> 0")
def src_json_tolerant(spark, sf):
    line, at = F.to_json(F.struct("event_id", "event_type", "value")), new_path(spark, "json")
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    _t(spark, sf, "events").select(cut.alias("value")).write.text(at)
    return readers.json_lines(spark, at, "event_id long, event_type string, value double", tolerant=True).select("event_id", "event_type", *_r("value"))


@query("SELECT asked, least(greatest(asked, 1), (SELECT count(*) FROM events))::BIGINT AS got FROM (VALUES (0), (5), (100000000)) t(asked)")
def src_json_limit(spark, sf):
    at = new_path(spark, "json")
    sinks.json_lines(_t(spark, sf, "events").select("event_id"), at)
    each = [readers.json_lines(spark, at, "event_id long", limit=n).agg(F.lit(n).alias("asked"), F.count("*").alias("got")) for n in (0, 5, 100_000_000)]
    return each[0].unionByName(each[1]).unionByName(each[2])


SENTENCES = 'Sentence,Party,Sentiment,Overall Sentiment\n"He said ""no"", twice",a,neg,-1\n"two\nlines",b,pos,1\n  spaced  ,c,neu,0\n,d,neu,0\nodd,e,x,2\nworse,f,x,abc\nlast,g,pos,1\n'


@query(_values([('He said "no", twice', -1, 0), ("two lines", 1, 2), ("spaced", 0, 1), ("last", 1, 2)], "text, sentiment, label"))
def src_sentences(spark, sf):
    at = _folder(spark, {"sentences.csv": SENTENCES})
    return readers.labelled_sentences(spark, at).select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), "sentiment", "label")


# --- lexicons

EMOLEX = (("Happy", "joy", "1"), ("happy", "anger", "0"), ("grim", "fear", "1"), ("a battery", "anger", "1"), ("unrated", "surprise", "1"), ("unrated", "nostalgia", "1"))
VAD_LINES = "Word\tValence\tArousal\tDominance\nhappy\t0.9\t0.6\t0.7\na battery\t0.4\t0.5\t0.5\ngrim,0.1,0.8,0.3\nglad 0.9 0.4 0.6\nwide\textra\t0.2\t0.3\t0.4\nhappy\t0.95\t0.6\t0.7\n"
VAD_ROWS = (("happy", 0.95, 0.6, 0.7), ("a battery", 0.4, 0.5, 0.5), ("grim", 0.1, 0.8, 0.3), ("glad", 0.9, 0.4, 0.6), ("wide", 0.2, 0.3, 0.4))
_VAD = f"v AS ({_values(VAD_ROWS, 'term, v, a, d')}), w AS (SELECT term, 2 * v - 1 AS v, 2 * a - 1 AS a, 2 * d - 1 AS d FROM v)"
_PROTOTYPES = f"p AS ({_values([(e, *x) for e, x in DEFAULT_PROTOTYPES.items()], 'emotion, v, a, d')})"


def _vad(spark) -> DataFrame:
    return readers.word_vad(spark, _folder(spark, {"words.vad.tsv": VAD_LINES}))


def _prototypes(spark) -> DataFrame:
    return spark.createDataFrame([(e, *x) for e, x in DEFAULT_PROTOTYPES.items()], "emotion string, v double, a double, d double")


@query(f"WITH {_VAD} SELECT term, round(v, 6) AS v, round(a, 6) AS a, round(d, 6) AS d FROM w")
def src_word_vad(spark, sf):
    return _vad(spark).select("term", *_r("v", "a", "d"))


_COALESCED = "SELECT e.term, e.emotion, round(coalesce(w.v, p.v)::DOUBLE, 6) AS v, round(coalesce(w.a, p.a)::DOUBLE, 6) AS a, round(coalesce(w.d, p.d)::DOUBLE, 6) AS d, (w.v IS NULL)::INT AS is_prototype FROM e LEFT JOIN w USING (term) LEFT JOIN p USING (emotion) WHERE coalesce(w.v, p.v) IS NOT NULL"


@query(f"WITH {_VAD}, {_PROTOTYPES}, e AS (SELECT lower(term) AS term, emotion FROM ({_values(EMOLEX, 'term, emotion, flag')}) WHERE flag = '1') {_COALESCED}")
def src_emotion_words(spark, sf):
    at = _folder(spark, {"NRC-Emotion-Lexicon-Wordlevel.txt": "".join("\t".join(r) + "\n" for r in EMOLEX)})
    return readers.emotion_associations(spark, at, _vad(spark), _prototypes(spark)).select("term", "emotion", *_r("v", "a", "d"), F.col("is_prototype").cast("int").alias("is_prototype"))


@query(f"WITH {_VAD}, {_PROTOTYPES}, e AS ({_values([('happy', 'joy'), ('glad', 'joy'), ('grim', 'disgust'), ('new word', 'disgust')], 'term, emotion')}) {_COALESCED}")
def src_emotion_files(spark, sf):
    at = _folder(spark, {"Joy.txt": "Happy\t1\nglad\n\n", "disgust.txt": "grim\t0.5\nnew  word\n"})
    return readers.emotion_files(spark, at, _vad(spark), _prototypes(spark)).select("term", "emotion", *_r("v", "a", "d"), F.col("is_prototype").cast("int").alias("is_prototype"))


@query(_values([("published", "NRC-VAD-Lexicon-v2.txt"), ("largest", "big_vad.csv"), ("intensity", "NRC-Emotion-Intensity-Lexicon-v1.txt"), ("by name", "my-intensity.txt"), ("first", "a.txt")], "folder, picked"))
def src_files_by_name(spark, sf):
    vad = [_folder(spark, {"a_vad.txt": "x" * 50, "NRC-VAD-Lexicon-v2.txt": "x", "NRC-VAD-Lexicon-v3.txt": "x"}), _folder(spark, {"a_vad.txt": "x", "big_vad.csv": "x" * 50, "c.txt": "x" * 90})]
    other = [_folder(spark, {"a.txt": "x", "intensity.txt": "x", "NRC-Emotion-Intensity-Lexicon-v1.txt": "x"}), _folder(spark, {"a.txt": "x", "Intensity-ForVariousLanguages.txt": "x", "my-intensity.txt": "x"}), _folder(spark, {"b.txt": "x", "a.txt": "x"})]
    picked = [readers.vad_file(spark, p) for p in vad] + [readers.intensity_file(spark, p) for p in other]
    names = ("published", "largest", "intensity", "by name", "first")
    return spark.createDataFrame([(n, p.rpartition("/")[2]) for n, p in zip(names, picked, strict=True)], "folder string, picked string")


LEXICON = {"__meta__": {"vad_scale": "zero_one"}, "joy": [["not happy", [0.9, 0.7, 0.75]], ["Glad", [0.8, 0.5, 0.5]]], "fear": [["dread", [0.05, 0.9, 0.2]]]}


@query(f"SELECT emotion, lower(term) AS term, round(2 * v - 1, 6)::DOUBLE AS v, round(2 * a - 1, 6)::DOUBLE AS a, round(2 * d - 1, 6)::DOUBLE AS d FROM ({_values([(e, t, *x) for e, rows in LEXICON.items() if e != '__meta__' for t, x in rows], 'emotion, term, v, a, d')})")
def src_json_lexicon(spark, sf):
    return readers.json_lexicon(spark, _folder(spark, {"lexicon.json": json.dumps(LEXICON, indent=1)})).select("emotion", "term", *_r("v", "a", "d"))


INTENSITIES = (("outraged", "anger", "0.964"), ("Outraged", "anger", "0.5"), ("outraged", "fear", "0.4"), ("term", "emotion", "emotion-intensity-score"), ("calm", "joy", "0.25"))


@query(f"SELECT lower(term) AS term, emotion, max(try_cast(score AS DOUBLE)) AS score FROM ({_values(INTENSITIES, 'term, emotion, score')}) WHERE try_cast(score AS DOUBLE) IS NOT NULL GROUP BY ALL")
def src_intensities(spark, sf):
    at = _folder(spark, {"a.txt": "no\tsuch\t1\n", "NRC-Emotion-Intensity-Lexicon-v1.txt": "".join("\t".join(r) + "\n" for r in INTENSITIES)})
    return readers.intensities(spark, at)


@query(_values([("condemn", 1), ("not happy", 2), ("don't", 1)], "term, n_tok"))
def src_stop_list(spark, sf):
    return readers.stop_list(spark, _folder(spark, {"stops.txt": "# ours\n\n Condemn \nnot   Happy\ncondemn\ndon’t\n123\n"})).select("term", "n_tok")


WEIGHTS = {"map": {"weights": {"Alpha": 0.5, "beta gamma": "2", "bad": "x", "__meta__": 1}}, "pairs": {"weights": [["Alpha", 0.5], ["beta gamma", 2]]}, "records": [{"term": "Alpha", "weight": 0.5}, {"token": "beta  gamma", "score": 2}, {"word": "none"}]}


@query(f"SELECT shape, term, weight::DOUBLE AS weight FROM (VALUES ('map'), ('pairs'), ('records')) s(shape), ({_values([('alpha', 0.5), ('beta gamma', 2.0)], 'term, weight')})")
def src_term_weights(spark, sf):
    out = None
    for shape, payload in WEIGHTS.items():
        one = readers.weight_payload(spark, _folder(spark, {"weights.json": json.dumps(payload)})).select(F.lit(shape).alias("shape"), "term", "weight")
        out = one if out is None else out.unionByName(one)
    return out


IMPUTED = {"list": {"terms": [{"term": "Dread", "vad": [-0.5, 0.25, 0.1], "conf": 0.7}, {"term": "joy", "vad": [0.5, 0.5, 0.5]}, {"term": "none"}]}, "map": {"Dread": {"vad": [-0.5, 0.25, 0.1], "conf": 0.7}, "joy": {"vad": [0.5, 0.5, 0.5]}}}


@query(f"SELECT shape, term, v::DOUBLE AS v, a::DOUBLE AS a, d::DOUBLE AS d, conf::DOUBLE AS conf FROM (VALUES ('list'), ('map')) s(shape), ({_values([('dread', -0.5, 0.25, 0.1, 0.7), ('joy', 0.5, 0.5, 0.5, 0.0)], 'term, v, a, d, conf')})")
def src_imputed_vad(spark, sf):
    out = None
    for shape, payload in IMPUTED.items():
        one = readers.imputed_vad(spark, _folder(spark, {"imputed.json": json.dumps(payload)})).select(F.lit(shape).alias("shape"), "term", "v", "a", "d", "conf")
        out = one if out is None else out.unionByName(one)
    return out


# --- judgements

AXIS = ["joy", "fear"]
_LOG = "l AS (SELECT event_id, user_id, value, event_id % 6 AS k, event_id % 4 = 3 AS short FROM events)"
_INVALID = "(k IN (3, 4) OR (k IN (0, 1) AND short))"


def _log(spark, sf) -> DataFrame:
    """A log line for each event: agreements, disagreements and errors, lines of two decisions, broken and blank ones; some lack a score."""
    e = _t(spark, sf, "events")
    k, value = F.col("event_id") % 6, F.col("value")
    path = F.concat(F.when(F.col("event_id") % 2 == 0, "./run\\data\\u").otherwise("run//data/./u"), F.col("user_id").cast("string"), F.lit(".txt"))
    scores = F.map_filter(F.create_map(F.lit("joy"), value, F.lit("fear"), -value, F.lit("more"), value), lambda name, _: (F.col("event_id") % 4 != 3) | (name != "fear"))
    body = F.struct(path.alias("file"), scores.alias("scores"))
    kind = F.element_at(F.array(*map(F.lit, adjudication.KINDS)), F.least(k, F.lit(2)).cast("int") + 1)
    line = F.to_json(F.map_from_arrays(F.array(kind), F.array(body)))
    line = F.when(k == 3, F.concat(F.lit('{"AGREE": {}, '), F.substring(line, F.lit(2), F.length(line)))).when(k == 4, F.substring(line, F.lit(1), F.length(line) - 2)).when(k == 5, F.lit("  ")).otherwise(line)
    return adjudication.parse_log(e.select("event_id", line.alias("value")), emotions=AXIS, root="run")


_COUNTED = ", ".join(f"count(*) FILTER (WHERE {test}) AS {name}" for name, test in (("parsed", f"k < 5 AND NOT {_INVALID}"), ("agree", "k = 0 AND NOT short"), ("disagree", "k = 1 AND NOT short"), ("error", "k = 2"), ("invalid", _INVALID)))


@query(f"WITH {_LOG} SELECT count(*) AS lines, {_COUNTED} FROM l")
def adj_log_counters(spark, sf):
    return adjudication.log_counters(_log(spark, sf))


@query(
    f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM l WHERE k < 5 AND NOT {_INVALID}) "
    "SELECT 'data/u' || user_id || '.txt' AS file, ['AGREE', 'DISAGREE', 'ERROR'][k + 1] AS decision, CASE WHEN k < 2 THEN round(least(greatest(value, 0.0), 20.0), 6) END AS joy, CASE WHEN k < 2 THEN round(least(greatest(-value, 0.0), 20.0), 6) END AS fear FROM r WHERE back = 1"
)
def adj_log_latest(spark, sf):
    parsed = _log(spark, sf).where("invalid is null").select("file", "event_id", "decision", "scores")
    last = adjudication.latest(parsed, "file", F.col("event_id"))
    return last.select("file", "decision", *[F.round(F.col("scores")[e] + 0.0, 6).alias(e) for e in AXIS])


# --- sinks


@query("SELECT kind, n_nationkey AS id, n_name AS name FROM nation, (VALUES ('html'), ('json'), ('yaml')) t(kind)")
def sink_documents(spark, sf):
    """A JSON and a YAML document and a page of the nations, read back."""
    nations, at = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")), new_path(spark, "documents")
    rows = [r.asDict() for r in nations.collect()]  # 25 rows
    sinks.json_document(spark, f"{at}/a.json", {"rows": rows})
    sinks.yaml_document(spark, f"{at}/a.yaml", {"rows": rows})
    sinks.html_report(nations, f"{at}/a.html", "Nations </script> & <more>")
    whole = lambda name: spark.read.text(f"{at}/{name}", wholetext=True)
    table = "array<struct<id:int,name:string>>"
    as_json = whole("a.json").select(F.lit("json").alias("kind"), F.explode(F.from_json(F.get_json_object("value", "$.rows"), table)).alias("r"))
    embedded = F.regexp_extract("value", r'(?s)id="rows">(.*?)</script>', 1)
    as_html = whole("a.html").select(F.lit("html").alias("kind"), F.explode(F.from_json(F.replace(embedded, F.lit("<\\/"), F.lit("</")), table)).alias("r"))
    lines = F.regexp_extract_all("value", F.lit(r"- id: (\d+)\n  name: '?[^'\n]*"), F.lit(0))
    as_yaml = whole("a.yaml").select(F.lit("yaml").alias("kind"), F.explode(lines).alias("x")).select("kind", F.struct(F.regexp_extract("x", r"id: (\d+)", 1).cast("int").alias("id"), F.regexp_extract("x", r"name: '?([^'\n]*)", 1).alias("name")).alias("r"))
    return as_json.unionByName(as_html).unionByName(as_yaml).select("kind", "r.id", "r.name")


@query("SELECT made, sha256('{\"epsilon\": 0.1, \"stop\": \"é\", \"top\": ' || top || '}') AS signature FROM (VALUES (1, 5), (1, 5), (2, 6)) t(made, top)")
def sink_signatures(spark, sf):
    """A stage is made once for the same parameters, and again for others."""
    at, made, out = new_path(spark, "stage"), [], []
    for top in (5, 5, 6):
        parameters = {"top": top, "epsilon": 0.1, "stop": "é"}
        sinks.stage(spark, at, parameters, lambda: (made.append(1), _t(spark, sf, "region").select("r_name"))[1]).count()
        out.append((len(made), sinks.signature(spark, parameters)))
    return settle(spark.createDataFrame(out, "made int, signature string"), "signatures")
