"""Readers of text folders, JSON lines, lexicon files and logs."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WORD, tokens
from ..functions.vectors import rescale_vad
from ..operators.lexicon import scale_of


# Names by which the files of a lexicon folder are known.
VAD_NAMES = ("NRC-VAD-Lexicon*.txt", "NRC-VAD-Lexicon*.tsv", "NRC-VAD-Lexicon*.csv")
INTENSITY_NAME = "NRC-Emotion-Intensity-Lexicon-v1.txt"


def files_under(spark: SparkSession, path: str, deep: bool = True) -> list[tuple[str, str, int]]:
    """(path, name, bytes) of the files under a folder by path, or of the file itself, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if not fs.exists(at):
        raise FileNotFoundError(path)
    found = fs.listFiles(at, deep)
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getPath().getName(), f.getLen()))
    return sorted(out)


def vad_file(spark: SparkSession, path: str) -> str:
    """A VAD lexicon in a folder: the first by name that is called as the published ones are, else the largest table with VAD in its name."""
    files = files_under(spark, path, deep=False)
    if len(files) == 1 and files[0][0].rstrip("/").endswith(path.rstrip("/").split(":")[-1].lstrip("/")):
        return files[0][0]
    for pattern in VAD_NAMES:
        for at, name, _ in files:
            if fnmatchcase(name, pattern):
                return at
    other = [(size, at) for at, name, size in files if "vad" in name.lower() and name.lower().endswith((".txt", ".tsv", ".csv"))]
    if not other:
        raise FileNotFoundError(f"no VAD lexicon under {path}")
    return max(other)[1]


def intensity_file(spark: SparkSession, path: str) -> str | None:
    """An intensity lexicon in a folder: by its published name, else by "intensity" in the name (translated ones aside), else the first text."""
    files = [(at, name) for at, name, _ in files_under(spark, path) if name.endswith(".txt") or at.rstrip("/").endswith(path.rstrip("/").split(":")[-1].lstrip("/"))]
    ranked = sorted(files, key=lambda f: (f[1] != INTENSITY_NAME, not ("intensity" in f[1].lower() and "forvariouslanguages" not in f[1].lower()), f[0]))
    return ranked[0][0] if ranked else None


def text_folder(spark: SparkSession, path: str, recursive: bool = True, suffix: str = ".txt", strip: bool | None = None) -> DataFrame:
    """(path, stem, text) of files with the suffix in either case.  With strip None, files named ICJ_... lose their boilerplate."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{either}").text(path, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_extract("_metadata.file_name", r"(.*)", 1), r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))
    if strip is False:
        return rows
    from ..operators.chunking import strip_boilerplate

    picked = rows if strip else rows.where(F.col("stem").startswith("ICJ_"))
    cleaned = strip_boilerplate(picked, "path", "text").join(rows.select("path", "stem"), "path").select("path", "stem", "text")
    return cleaned if strip else cleaned.unionByName(rows.where(~F.col("stem").startswith("ICJ_")))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, tolerant: bool = False, limit: int | None = None) -> DataFrame:
    """One object a line; a malformed line is an error, or is dropped if tolerant.  A limit is at least one row."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return rows if limit is None else rows.limit(max(1, limit))


def emotion_associations(spark: SparkSession, path: str, word_vad: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(term, emotion, v, a, d, is_prototype) of lines word, emotion, 1; values of the word, else the emotion's, else dropped."""
    rows = spark.read.schema("term string, emotion string, flag string").option("sep", "\t").csv(path).where("flag = '1'")
    return _with_vad(rows.select(_term(F.col("term")).alias("term"), F.lower("emotion").alias("emotion")), word_vad, prototypes)


def emotion_files(spark: SparkSession, path: str, word_vad: DataFrame, prototypes: DataFrame) -> DataFrame:
    """As emotion_associations, of one file an emotion (its name), the word in the first column."""
    raw = spark.read.text(path).select("value", F.lower(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1)).alias("emotion"))
    return _with_vad(raw.select(_term(F.split("value", "\t")[0]).alias("term"), "emotion").where("term <> ''"), word_vad, prototypes)


def _term(word: Column) -> Column:
    return F.array_join(tokens(word), " ")


def _with_vad(rows: DataFrame, word_vad: DataFrame, prototypes: DataFrame) -> DataFrame:
    w = word_vad.select("term", *[F.col(c).alias(f"w_{c}") for c in "vad"])
    p = prototypes.select("emotion", *[F.col(c).alias(f"p_{c}") for c in "vad"])
    out = rows.join(w, "term", "left").join(p, "emotion", "left")
    return out.select("term", "emotion", *[F.coalesce(f"w_{c}", f"p_{c}").alias(c) for c in "vad"], F.col("w_v").isNull().alias("is_prototype")).where("v is not null")


def word_vad(spark: SparkSession, path: str, scale: str | None = None) -> DataFrame:
    """(term, v, a, d) on -1 to 1.  Fields are split at tabs, else commas, else white space; values are the three after the term, else
    the last three; lines without three numbers (headers) are skipped; the last of repeated terms wins.  In a folder, `vad_file` is read."""
    raw = spark.read.text(vad_file(spark, path)).select("value", F.monotonically_increasing_id().alias("line"))
    value = F.col("value")
    f = F.when(value.contains("\t"), F.split(value, "\t")).when(value.contains(","), F.split(value, ",")).otherwise(F.split(F.trim(value), r"\s+"))
    number = lambda i: F.try_element_at(F.col("f"), F.lit(i)).try_cast("double")
    first = [number(i) for i in (2, 3, 4)]
    last = [number(i) for i in (-3, -2, -1)]
    ok = lambda xs: xs[0].isNotNull() & xs[1].isNotNull() & xs[2].isNotNull()
    rows = raw.select("line", f.alias("f")).select("line", _term(F.col("f")[0]).alias("term"), *[F.when(ok(first), a).when(ok(last), b).alias(c) for a, b, c in zip(first, last, "vad", strict=True)])
    rows = rows.where("v is not null and term <> ''").groupBy("term").agg(F.max_by(F.struct("v", "a", "d"), "line").alias("x")).select("term", "x.*")
    mode = F.lit(scale) if scale else F.lit(scale_of(rows).first()["mode"])  # one row
    return rows.select("term", *[rescale_vad(F.col(c), mode).alias(c) for c in "vad"])


def json_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(emotion, term, v, a, d) of {emotion: [[term, [v, a, d]], ...]}; __meta__.vad_scale names the values' scale."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("j"))
    scale = F.coalesce(F.try_variant_get("j", "$.__meta__.vad_scale", "string"), F.lit("signed"))
    body = raw.select(scale.alias("scale"), F.explode(F.from_json(F.to_json("j"), "map<string,string>")).alias("emotion", "entries")).where("emotion <> '__meta__'")
    each = body.select("scale", "emotion", F.explode(F.from_json("entries", "array<string>")).alias("e")).select("scale", "emotion", F.from_json("e", "array<string>").alias("e"))
    vad = F.from_json(F.col("e")[1], "array<double>")
    return each.select("emotion", _term(F.col("e")[0]).alias("term"), *[rescale_vad(vad[i], F.col("scale")).alias(c) for i, c in enumerate("vad")])


def intensities(spark: SparkSession, path: str) -> DataFrame:
    """(term, emotion, score): the greatest score of lines term, emotion, score.  In a folder, `intensity_file` is read."""
    rows = spark.read.schema("term string, emotion string, score string").option("sep", "\t").csv(intensity_file(spark, path) or path)
    rows = rows.select(_term(F.col("term")).alias("term"), F.lower("emotion").alias("emotion"), F.col("score").try_cast("double").alias("score")).where("score is not null and term <> ''")
    return rows.groupBy("term", "emotion").agg(F.max("score").alias("score"))


def stop_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, n_tok) of lines, without blank ones and those that begin with #; words as the tokeniser has them."""
    rows = spark.read.text(path).where(~F.trim("value").rlike("^(#|$)")).select(tokens(F.col("value")).alias("t")).where(F.size("t") > 0)
    return rows.select(F.array_join("t", " ").alias("term"), F.size("t").alias("n_tok")).distinct()


def weight_payload(spark: SparkSession, path: str) -> DataFrame:
    """(term, weight) of a JSON object, or under "weights" of one: an object, a list of pairs or a list of records."""
    body = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.weights"), F.col("value")).alias("b"))
    as_map = body.where(F.ltrim("b").startswith("{")).select(F.explode(F.from_json("b", "map<string,string>")).alias("term", "weight")).where("term <> '__meta__'")
    item = body.where(F.ltrim("b").startswith("[")).select(F.explode(F.from_json("b", "array<string>")).alias("e"))
    get = lambda *names: F.coalesce(*[F.get_json_object("e", f"$.{n}") for n in names])
    as_list = item.select(F.coalesce(get("term", "token", "word"), F.from_json("e", "array<string>")[0]).alias("term"), F.coalesce(get("weight", "score"), F.from_json("e", "array<string>")[1]).alias("weight"))
    return as_map.unionByName(as_list).select(_term(F.col("term")).alias("term"), F.col("weight").try_cast("double").alias("weight")).where("term <> '' and weight is not null")


def imputed_vad(spark: SparkSession, path: str) -> DataFrame:
    """(term, v, a, d, conf) of {"terms": [{term, vad, conf}, ...]} or of {term: {vad, conf}}; conf 0 where missing."""
    body = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.terms"), F.col("value")).alias("b"))
    as_list = body.where(F.ltrim("b").startswith("[")).select(F.explode(F.from_json("b", "array<struct<term:string,vad:array<double>,conf:double>>")).alias("e")).select("e.*")
    as_map = body.where(F.ltrim("b").startswith("{")).select(F.explode(F.from_json("b", "map<string,struct<vad:array<double>,conf:double>>")).alias("term", "e")).select("term", "e.*")
    return as_list.unionByName(as_map).where("vad is not null").select(_term(F.col("term")).alias("term"), *[F.col("vad")[i].alias(c) for i, c in enumerate("vad")], F.coalesce("conf", F.lit(0.0)).alias("conf"))


def labelled_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(text, sentiment, label 0 to 2) of a CSV with columns Sentence and Overall Sentiment; invalid rows are dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    s = F.col("`Overall Sentiment`").try_cast("int")
    return rows.where(F.trim("Sentence") != "").select(F.trim("Sentence").alias("text"), s.alias("sentiment")).where(F.col("sentiment").isin(-1, 0, 1)).withColumn("label", F.col("sentiment") + 1)


TOKEN_PATTERN = WORD
