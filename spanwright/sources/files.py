"""Line-delimited JSON, JSON and CSV files in and out, and exports for other evaluation tools.

Blank lines are skipped. A line that is no object of the schema stops a strict read with an error; a lenient read gives such lines as
a second DataFrame. Unknown fields are ignored, missing ones are null; nulls are left out when written.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.functions.text import trim_u

SPAN = (
    "id string, trace_id string, parent_id string, name string, kind string, input string, output string, error string, started_at string, ended_at string, source_status string, "
    "start_time_unix_nano bigint, end_time_unix_nano bigint, duration_nano bigint, attributes map<string,string>"
)
TRACE = f"id string, spans array<struct<{SPAN.replace(' string', ':string').replace(' bigint', ':bigint').replace(' map<', ':map<')}>>, metadata map<string,string>"
CASE = "id string, trace_id string, input string, actual_output string, expected_output string, rubric string, metadata map<string,string>"
RESULT = "case_id string, trace_id string, evaluator_name string, raw_score double, normalized_score double, score_scale string, calibrated_score double, passed boolean, confidence double, cluster_id string, evaluation string, metadata map<string,string>"
RATING = "case_id string, trace_id string, score int, passed boolean, notes string"
CLUSTER = "id string, label string, description string, weight double, metadata struct<tag:string,keywords:array<string>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that doesn't parse stops the job with its start."""
    parsed = _parsed(spark, path, schema)
    checked = F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("not a record of the schema: "), F.substring("value", 1, 120)))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select("r.*")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = _parsed(spark, path, schema)
    return parsed.filter("not _bad").select("r.*"), parsed.filter("_bad").select(F.col("value").alias("line"))


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # The check for blank lines stands in ``_bad`` too: the optimizer may judge a line before it drops it.
    lines = spark.read.text(path).filter(trim_u(F.col("value")) != "")
    typed = T._parse_datatype_string(f"{schema}, _corrupt string")
    r = lines.select("value", F.from_json("value", typed, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return r.select("value", F.col("r").dropFields("_corrupt").alias("r"), ((trim_u(F.col("value")) != "") & (F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~trim_u(F.col("value")).startswith("{"))).alias("_bad"))


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spans, traces) of a file of traces: spans one row each, with their trace's id and their place ``pos`` in its list."""
    t = read_jsonl(spark, path, TRACE)
    s = t.select(F.col("id").alias("_t"), F.posexplode("spans").alias("pos", "s")).select("_t", F.col("pos").cast("long").alias("pos"), "s.*").drop("trace_id").withColumnRenamed("_t", "trace_id")
    s = s.withColumns({"kind": F.coalesce("kind", F.lit("other")), "source_status": F.coalesce("source_status", F.lit("unset")), "attributes": F.coalesce("attributes", F.create_map().cast("map<string,string>"))})
    return s, t.select("id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact object a line, nulls left out; part files in the folder ``path``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_pretty(df: DataFrame, path: str) -> None:
    """One small row (a report, a model) as an indented document."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a document has exactly one row")
    Path(path).write_text(json.dumps(row[0].asDict(True), indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def cases_csv(cases: DataFrame) -> DataFrame:
    """The columns of the CSV export; missing texts are empty, metadata is dropped."""
    return cases.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("id", "trace_id", "input", "actual_output", "expected_output", "rubric")])


def write_cases_csv(cases: DataFrame, path: str) -> None:
    cases_csv(cases).write.mode("overwrite").option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def openai_eval_rows(cases: DataFrame) -> DataFrame:
    """Rows (``input``, ``ideal``, ``metadata``) of the evals format."""
    return cases.select("input", F.coalesce("expected_output", F.lit("")).alias("ideal"), F.struct(F.col("id").alias("case_id"), "trace_id").alias("metadata"))


def promptfoo_tests(cases: DataFrame) -> DataFrame:
    """One row a case (``test``, JSON): its input as a variable and, if there is an expected output, a check that it is contained."""
    check = F.when(F.col("expected_output").isNotNull(), F.array(F.struct(F.lit("contains").alias("type"), F.col("expected_output").alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    test = F.struct(F.struct("input").alias("vars"), check.alias("assert"), F.struct(F.col("id").alias("case_id"), "trace_id", "rubric").alias("metadata"))
    return cases.select("id", F.to_json(test, {"ignoreNullFields": "false"}).alias("test"))


def write_promptfoo(cases: DataFrame, path: str) -> None:
    """The whole configuration as one document, streamed test by test."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('{\n  "tests": [')
        for i, r in enumerate(promptfoo_tests(cases).orderBy("id").toLocalIterator()):
            out.write(("," if i else "") + "\n" + "\n".join("    " + x for x in json.dumps(json.loads(r["test"]), indent=2, ensure_ascii=False).split("\n")))
        out.write("\n  ]\n}\n")


def artifact_digest(spark: SparkSession, path: str) -> DataFrame:
    """(``sha256``, ``byte_count``, ``record_count``) of a file: its hash, its size and its lines that aren't blank."""
    f = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    n = F.size(F.filter(F.split(text, "\n"), lambda x: trim_u(x) != ""))
    return f.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.octet_length("content").cast("long").alias("byte_count"), n.cast("long").alias("record_count"))
