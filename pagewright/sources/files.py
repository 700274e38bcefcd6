"""File sources: checked CSV and JSON lines, listings, and documents as pages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

#: Columns of label files, of files of questions, and of listings.
LABELS = ("id", "file_id", "question", "answer_format", "answer", "evidence_page_number", "language")
QUESTIONS = ("id", "file_id", "question", "answer_format", "language")
LISTING = ("name", "size", "creationDate")


def read_labels(spark: SparkSession, path: str, columns: tuple[str, ...], exact: bool = False) -> DataFrame:
    """A CSV file with a header that holds the columns (exactly these in this order if exact), all as strings."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if (exact and tuple(df.columns) != columns) or not set(columns) <= set(df.columns):
        raise ValueError(f"the header of {path} is {df.columns}")
    return df.select(*columns)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, after a check that no key is null, blank or repeated."""
    bad = df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull() | (F.trim(key) == "")).limit(5).collect()
    if bad:
        raise ValueError(f"keys aren't unique: {[r[0] for r in bad]}")
    return df


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without a byte order mark, else Windows-1252 with what it lacks replaced."""

    @F.pandas_udf("string")
    def western(s):  # noqa: ANN001, ANN202
        return s.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace"))

    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\\x{FEFF}", "")).otherwise(western(F.when(~F.is_valid_utf8(text), content)))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a schema; a line that isn't of it fails the job; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def last_lines(df: DataFrame, key: str, order: str) -> DataFrame:
    """Checkpoint lines: the last of each key stands."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, size and modified of the files of a folder, without placeholders; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return df.filter(~F.col("path").endswith("/.keep")).orderBy("path")


def unique_listing(df: DataFrame, key: str) -> DataFrame:
    """Pages of a listing as one: equal rows count once, rows of one key that differ are an error."""
    out = df.distinct()
    if not out.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("one name is listed with different facts")
    return out


def read_verified(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """path, content and ok of files whose SHA-256 is given; digests: path, sha256."""
    df = spark.read.format("binaryFile").load(path).select("path", "content")
    return df.join(digests, "path").withColumn("ok", F.sha2("content", 256) == F.col("sha256"))


def pages_of_text(df: DataFrame, document: str, content: str) -> DataFrame:
    """Pages of plain-text documents, parted at form feeds: document_id, page_number, text, status. An empty page is textless."""
    p = df.select(F.col(document).alias("document_id"), F.posexplode(F.split(F.coalesce(content, F.lit("")), "\\f")).alias("i", "text"))
    blank = F.trim(F.regexp_replace("text", r"\s", "")) == ""
    return p.select("document_id", (F.col("i") + 1).alias("page_number"), F.when(blank, "").otherwise(F.col("text")).alias("text"), F.when(blank, "textless").otherwise("ok").alias("status"))


def read_rows(spark: SparkSession, path: str, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Rows of CSV files with their numbers, read whole: file, row (from 2, the header is 1), columns, and row_error.

    Files of labels are small, so one is read by one task, as quoted line feeds make row numbers a thing of the whole file.
    row_error is wrong_header, short_row, long_row or undecodable; a file with a wrong header has one row, number 1. With exact,
    the header must be the columns in their order.
    """
    names = list(columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in batches:
            out: list[tuple] = []
            for name, content in zip(pdf["path"], pdf["content"]):
                none = (None,) * len(names)
                try:
                    rows = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                    head = next(rows, [])
                    if (exact and head != names) or not set(names) <= set(head):
                        out.append((name, 1, *none, "wrong_header"))
                        continue
                    at = [head.index(n) for n in names]
                    for i, r in enumerate((r for r in rows if r), 2):
                        error = "short_row" if len(r) < len(head) else "long_row" if len(r) > len(head) else None
                        out.append((name, i, *(r[k] if k < len(r) else None for k in at), error))
                except (UnicodeDecodeError, csv.Error):
                    out.append((name, 1, *none, "undecodable"))
            yield pd.DataFrame(out, columns=["file", "row", *names, "row_error"])

    schema = ", ".join(["file string", "row int", *(f"`{n}` string" for n in names), "row_error string"])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def typed_labels(rows: DataFrame) -> DataFrame:
    """Reference records of read_rows(LABELS), each with its row and error: wrong rows stay.

    question_id, document_id, question, answer_format, answer, evidence_pages, language, file, row, error. Errors after those of the
    row: blank_id, repeated_id, unknown_format, bad_pages, no_pages, bad_language.
    """
    pages = X.evidence_pages(F.col("evidence_page_number"))
    r = rows.withColumn("_format", X.answer_format(F.col("answer_format"))).withColumn("_pages", pages)
    r = r.withColumn("_n", F.when(F.col("id").isNotNull(), F.count("*").over(Window.partitionBy("file", "id"))))
    error = (
        F.when(F.col("row_error").isNotNull(), F.col("row_error")).when(F.coalesce(X.strip(F.col("id")), F.lit("")) == "", "blank_id").when(F.col("_n") > 1, "repeated_id")
        .when(F.col("_format").isNull(), "unknown_format").when(F.col("_pages").isNull(), "bad_pages").when(F.size("_pages") == 0, "no_pages")
        .when(~F.coalesce(F.length("language").between(2, 8), F.lit(False)), "bad_language")
    )
    return r.select(F.col("id").alias("question_id"), F.col("file_id").alias("document_id"), "question", F.col("_format").alias("answer_format"), "answer", F.col("_pages").alias("evidence_pages"), "language", "file", "row", error.alias("error"))


def require_valid(rows: DataFrame) -> DataFrame:
    """rows without `error`, or ValueError that names the first wrong rows by number."""
    bad = rows.filter(F.col("error").isNotNull()).orderBy("file", "row").select("row", "error").limit(5).collect()
    if bad:
        raise ValueError("wrong rows: " + ", ".join(f"{r['row']}: {r['error']}" for r in bad))
    return rows.drop("error")


def input_violations(questions: DataFrame, template: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """violation of the inputs of a submission: ids that differ, and counts that aren't those expected.

    expected: questions and documents (numbers), answer_format and language (numbers by value); what it lacks isn't checked.
    """
    a, b = questions.select("id").distinct(), template.select("id").distinct()
    found = [
        a.join(b, "id", "left_anti").limit(1).select(F.lit("id_not_in_template").alias("violation")),
        b.join(a, "id", "left_anti").limit(1).select(F.lit("id_not_in_questions").alias("violation")),
    ]
    for name, column in (("questions", "id"), ("documents", "file_id")):
        if name in expected:
            found.append(questions.agg(F.countDistinct(column).alias("n")).filter(F.col("n") != expected[name]).select(F.lit(f"{name}_count").alias("violation")))
    for column in ("answer_format", "language"):
        if column in expected:
            want = questions.sparkSession.createDataFrame(list(expected[column].items()) or [], f"{column} string, want bigint")
            both = questions.groupBy(column).agg(F.count("*").alias("n")).join(want, column, "full").filter(~F.col("n").eqNullSafe(F.col("want")))
            found.append(both.limit(1).select(F.lit(f"{column}_counts").alias("violation")))
    blank = X.strip(F.coalesce("question", F.lit(""))) == ""
    found.append(questions.filter(blank | (X.strip(F.coalesce("file_id", F.lit(""))) == "") | X.answer_format(F.col("answer_format")).isNull()).limit(1).select(F.lit("empty_or_unknown_field").alias("violation")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def listing_page(text: str, token_prefix: str = "Next Page Token = ") -> tuple[list[tuple[str, int, str]], str | None]:
    """Rows (name, size, creation date) and the next page's token of one page of a listing."""
    import csv

    lines = [x for x in text.splitlines() if x.strip()]
    tokens = [x.strip().removeprefix(token_prefix).strip() for x in lines if x.strip().startswith(token_prefix)]
    rows = list(csv.reader(x for x in lines if not x.strip().startswith(token_prefix)))
    if not rows or tuple(rows[0]) != LISTING:
        raise ValueError(f"the listing's header is {rows[:1]}")
    for r in rows[1:]:
        if len(r) != 3 or not r[0] or not r[1].isdigit():
            raise ValueError(f"a wrong row of the listing: {r}")
    return [(r[0], int(r[1]), r[2]) for r in rows[1:]], (tokens[-1] or None) if tokens else None


def list_pages(spark: SparkSession, fetch, most: int = 10_000) -> DataFrame:  # noqa: ANN001
    """All pages of a listing as one: name, size, created. fetch(token) gives a page's text; a token that comes again is an error."""
    rows, token, seen = [], None, set()
    for _ in range(most):
        more, token = listing_page(fetch(token))
        rows += more
        if token is None:
            return unique_listing(spark.createDataFrame(rows, "name string, size bigint, created string"), "name").orderBy("name")
        if token in seen:
            raise ValueError("a page's token comes again")
        seen.add(token)
    raise ValueError("the listing has too many pages")


def inventory(listing: DataFrame, keep: Column, allowed: str = r"^[A-Za-z0-9._-]+$") -> DataFrame:
    """Files of a listing that are wanted, with stem: ValueError where two have one stem or a stem has other characters."""
    stem = F.regexp_replace(F.substring_index("name", "/", -1), r"\.[^.]*$", "")
    out = listing.filter(keep).withColumn("stem", stem)
    bad = out.groupBy("stem").count().filter((F.col("count") > 1) | ~F.col("stem").rlike(allowed)).limit(5).collect()
    if bad:
        raise ValueError(f"unusable names: {[r['stem'] for r in bad]}")
    return out


def tar_members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """file, name, content and error of the regular files in tar archives, compressed or not; nothing is written to a disk.

    An archive with an absolute name, a name with `..`, a link or a device has one row, with its error, and no members; a file that
    is no archive has error not_a_tar.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile
        from pathlib import PurePosixPath

        for pdf in batches:
            for p, data in zip(pdf["p"], pdf["c"]):
                out: list[tuple] = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(bytes(data))) as tar:
                        for m in tar:
                            at = PurePosixPath(m.name)
                            wrong = "unsafe_name" if at.is_absolute() or ".." in at.parts else "link" if m.issym() or m.islnk() else None if m.isfile() or m.isdir() else "device"
                            if wrong:
                                out = [(p, m.name, None, wrong)]
                                break
                            if m.isfile():
                                out.append((p, m.name, tar.extractfile(m).read(), None))
                except (tarfile.TarError, EOFError, OSError):
                    out = [(p, None, None, "not_a_tar")]
                yield pd.DataFrame(out, columns=["file", "name", "content", "error"])

    return files.filter(F.col(content).isNotNull()).select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(read, "file string, name string, content binary, error string")


def read_report(spark: SparkSession, path: str) -> str:
    """The text of a report whose bytes have the digest that lies beside it in `.sha256`; ValueError if not."""
    load = lambda p: spark.read.format("binaryFile").load(p).select("content", F.sha2("content", 256).alias("sha")).first()
    report, note = load(path), load(path + ".sha256")
    if bytes(note["content"]).decode().split()[:1] != [report["sha"]]:
        raise ValueError(f"{path} differs from its digest")
    return bytes(report["content"]).decode()
