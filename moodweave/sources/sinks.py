"""Writers, and signatures of finished stages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line; Spark's commit makes the folder appear whole or not at all."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def signature(spark: SparkSession, parameters: dict) -> str:
    body = json.dumps(parameters, sort_keys=True, ensure_ascii=False, default=str)
    return spark.range(1).select(F.sha2(F.lit(body), 256)).first()[0]


def stage(spark: SparkSession, path: str, parameters: dict, make) -> DataFrame:
    """The table at path if it was made with the same parameters, else make() written there; the signature stands in its rows' table
    property column `_signature`, so it can't part from the data."""
    sig = signature(spark, parameters)
    try:
        there = spark.read.parquet(path)
        if "_signature" in there.columns and there.where(F.col("_signature") != sig).isEmpty() and not there.isEmpty():
            return there.drop("_signature")
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().withColumn("_signature", F.lit(sig)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_signature")


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path names, put in place by a rename."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at, part = fs_path(path), fs_path(path + ".part")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def json_document(spark: SparkSession, path: str, payload) -> None:
    text_file(spark, path, json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n")


def yaml_document(spark: SparkSession, path: str, payload: dict) -> None:
    import yaml

    text_file(spark, path, yaml.safe_dump(payload, sort_keys=False, allow_unicode=True))


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><div id="out"></div>
<script type="application/json" id="rows">{rows}</script><script>
const rows = JSON.parse(document.getElementById("rows").textContent), names = rows.length ? Object.keys(rows[0]) : [];
const cell = (kind, value) => {{ const c = document.createElement(kind); c.textContent = typeof value === "object" ? JSON.stringify(value) : value; return c; }};
const table = document.createElement("table"); const add = (kind, values) => {{ const r = table.insertRow(); values.forEach(v => r.append(cell(kind, v))); }};
add("th", names); rows.forEach(row => add("td", names.map(n => row[n]))); document.getElementById("out").append(table);
</script></body></html>
"""


def html_report(df: DataFrame, path: str, title: str, most_rows: int = 1000) -> None:
    """A page with the first rows of a result as a table; the rows are embedded as JSON in which no tag can end."""
    rows = [r.asDict(recursive=True) for r in df.limit(most_rows).collect()]
    body = json.dumps(rows, ensure_ascii=False, default=str).replace("</", "<\\/")
    name = title.replace("&", "&amp;").replace("<", "&lt;")
    text_file(df.sparkSession, path, PAGE.format(title=name, rows=body))
