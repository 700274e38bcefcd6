"""Submission files: built in template order, checked on their own, stored under the digest of their bytes."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import discard, materialize

COLUMNS = ("id", "answer", "evidence_page_number")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(value: object) -> bytes:
    """Canonical JSON: sorted keys, no spaces, text as it is, a line feed behind."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n").encode()


#: Characters of a list literal at most.
LONGEST_LITERAL = 1_000_000


def list_literal(text: str) -> list | None:
    """The list of a JSON or Python literal; None where it is none."""
    if len(text) > LONGEST_LITERAL:
        return None
    x = X.literal(text)
    return x if isinstance(x, list) else None


def answer_literal(answer: Column, fmt: Column) -> Column:
    """STRUCT<literal, error>: an answer as a submission has it. List formats need a list of scalars, given as compact JSON; others any text that isn't blank."""

    @F.pandas_udf("struct<literal:string,error:string>")
    def run(a, f):  # noqa: ANN001, ANN202
        import math

        import pandas as pd

        def usable(x: object) -> bool:
            if isinstance(x, str):
                return bool(x.strip())
            return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)

        def one(t: str | None, kind: str | None) -> tuple[str | None, str | None]:
            if t is None or not t.strip():
                return None, "missing_answer"
            if kind not in ("ordered_list", "unordered_list"):
                return t, None
            items = list_literal(t)
            if not items or not all(map(usable, items)):
                return None, "bad_list"
            return json.dumps(items, ensure_ascii=False, separators=(",", ":")), None

        return pd.DataFrame([one(*r) for r in zip(a, f)], columns=["literal", "error"])

    return run(answer, fmt)


def submission_rows(template: DataFrame, predictions: DataFrame, page_counts: DataFrame) -> DataFrame:
    """ordinal, id, answer, evidence_page_number, error. template: ordinal, id, document_id, and answer_format if answers are to be literals of it; predictions: id, answer, evidence_pages.

    Every template row stays, and so does every prediction of an id that the template lacks, without an ordinal; error tells
    what a row lacks, so that a file is made of whole results only.
    """
    fmt = F.col("answer_format") if "answer_format" in template.columns else F.lit("string")
    rows = template.withColumn("_in", F.lit(True)).join(predictions.withColumn("_has", F.lit(True)), "id", "full").join(page_counts, "document_id", "left")
    rows = rows.withColumn("_a", answer_literal(F.col("answer"), fmt)).withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    pages = F.col("evidence_pages")
    error = (
        F.when(F.col("_in").isNull(), "unknown_id").when(F.col("_has").isNull(), "missing_prediction").when(F.col("_n") > 1, "repeated_id").when(~F.coalesce(F.col("page_count") >= 1, F.lit(False)), "missing_page_count").when(F.col("_a.error").isNotNull(), F.col("_a.error"))
        .when(F.coalesce(F.size(pages), F.lit(0)) < 1, "no_pages").when(F.size(F.array_distinct(pages)) != F.size(pages), "repeated_page").when(~F.coalesce(F.forall(pages, lambda p: p.between(1, F.col("page_count"))), F.lit(False)), "page_out_of_bounds")
    )
    return rows.select("ordinal", "id", F.col("_a.literal").alias("answer"), F.to_json(F.array_sort(pages)).alias("evidence_page_number"), error.alias("error"))


def provenance_violations(value: Mapping[str, object], required: Mapping[str, object]) -> list[str]:
    """Keys of a submission's provenance that are wrong: those required have other values, the model has no name, or a revision isn't pinned."""
    text = lambda k: value.get(k) if isinstance(value.get(k), str) else ""
    out = [k for k, v in required.items() if value.get(k) != v]
    out += [] if text("model_id").strip() else ["model_id"]
    return out + [k for k in ("model_revision", "code_commit") if not re.fullmatch("[0-9a-f]{40}", text(k))]


def to_csv(rows: Iterable[tuple[str, str, str]]) -> bytes:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    w.writerow(COLUMNS)
    w.writerows(rows)
    return out.getvalue().encode()


def build_submission(template: DataFrame, predictions: DataFrame, page_counts: DataFrame) -> bytes:
    """The file's bytes, in template order; ValueError if any row has an error. Rows stream to the driver, which makes one file."""
    rows = materialize(submission_rows(template, predictions, page_counts), "submission")
    try:
        bad = rows.filter(F.col("error").isNotNull()).groupBy("error").count().collect()
        if bad:
            raise ValueError("incomplete submission: " + ", ".join(f"{r['error']}={r['count']}" for r in sorted(bad)))
        ordered = rows.orderBy("ordinal").select(*COLUMNS)
        return to_csv(tuple(r) for r in ordered.toLocalIterator())
    finally:
        discard(rows)


def check_submission(data: bytes, ids: list[str], page_counts: Mapping[str, int] | None = None, formats: Mapping[str, str] | None = None) -> dict[str, int]:
    """An independent reading of the bytes: header, order, literals. page_counts: by id; formats: the answer format by id."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    if not rows or tuple(rows[0]) != COLUMNS:
        raise ValueError("wrong header")
    if any(len(r) != len(COLUMNS) for r in rows):
        raise ValueError("a row has too few or too many fields")
    if [r[0] for r in rows[1:]] != ids:
        raise ValueError("ids aren't those of the template in its order")
    for key, answer, cited in rows[1:]:
        most = None if page_counts is None else page_counts.get(key, 0)
        pages = list_literal(cited)
        if not pages or pages != sorted(set(pages)) or any(isinstance(p, bool) or not isinstance(p, int) or p < 1 or (most is not None and p > most) for p in pages):
            raise ValueError(f"bad pages of {key}")
        if formats is not None and (not answer.strip() or (formats[key] in ("ordered_list", "unordered_list") and not list_literal(answer))):
            raise ValueError(f"bad answer of {key}")
    return {"rows": len(rows) - 1}


def write_json_lines(df: DataFrame, path: str, key: str) -> None:
    """Rows in the order of their key, fields by name, as JSON lines; the folder must be new."""
    names = sorted(df.columns)
    df.orderBy(key).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_rows(frames: Sequence[DataFrame], path: str, columns: Sequence[str] | None = None) -> None:
    """Rows of frames with different columns as CSV files with a header: these columns, or all by name; what a row lacks is empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    names = list(columns) if columns is not None else sorted(out.columns)
    lack = [n for n in names if n not in out.columns]
    if lack:
        raise ValueError(f"no frame has {lack}")
    out.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)


def write_report(spark: SparkSession, path: str, value: object) -> str:
    """A report as canonical JSON, its digest beside it, both written once; gives the digest."""
    data = encode(value)
    sha = digest(data)
    folder, name = path.rsplit("/", 1)
    shared_once(spark, f"{folder}/{name}", data)
    shared_once(spark, f"{folder}/{name}.sha256", f"{sha}  {name}\n".encode())
    return sha


def shared_once(spark: SparkSession, path: str, data: bytes) -> None:
    """data at a path of any file system that Spark knows, whole or not at all; the same bytes again are fine, others an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not fs.rename(part, at):
            fs.delete(part, False)
    stored = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    if bytes(stored) != data:
        raise ValueError(f"{path} holds other bytes")


def write_once(folder: str, name: str, data: bytes) -> str:
    """data at folder/name, whole or not at all; the same bytes again are fine, others an error."""
    path = os.path.join(folder, name)
    os.makedirs(folder, exist_ok=True)
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() != data:
                raise ValueError(f"{path} holds other bytes")
        return path
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return path


def store_bundle(root: str, data: bytes, provenance: dict) -> str:
    """The file first, its manifest last, in a folder named by the digest; read back before it counts."""
    sha = digest(data)
    folder = os.path.join(root, sha)
    with open(write_once(folder, "submission.csv", data), "rb") as f:
        if digest(f.read()) != sha:
            raise ValueError("stored bytes differ")
    write_once(folder, "manifest.json", encode(provenance | {"submission_sha256": sha}))
    return folder
