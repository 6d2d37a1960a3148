"""Sources and sinks: words, CSV, span maps, keyed upserts and deletes on Parquet."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import bounded_batches

_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
EVAL_SCHEMA = "id string, category string, question string, ground_truth string, test_type string"
LOG_COLUMNS = ("id", "created_at", "path", "intent", "icao", "similarity", "charts", "needs_review", "reviewed", "feedback", "query")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Positioned words; blank ones are dropped."""
    return spark.read.parquet(path).where(F.trim("text") != "")


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def save_words(words: DataFrame, table: str, path: str, by: tuple[str, ...] = ("doc_id",), buckets: int = 64) -> None:
    """Keep placed words as a table with its files in `path`, in buckets by document (or document and page) and in reading
    order. Words of texts are kept by save_text_words, which shuffles texts instead."""
    order = [*by, *[c for c in ("page", "top", "x0", "line_no", "word_no") if c in words.columns and c not in by]]
    _write_buckets(words.repartition(buckets, *by).sortWithinPartitions(*order), table, path, by, buckets)


def save_text_words(df: DataFrame, table: str, path: str, buckets: int = 64, id_column: str = "doc_id", text: str = "text", **places) -> None:
    """The words of texts (words_from_text) as such a table in buckets by document. Texts are dealt out by document and put
    in order before words are made of them, so no word is shuffled or sorted; the words of texts with the same id stand
    text after text."""
    texts = df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).repartition(buckets, "doc_id").sortWithinPartitions("doc_id")
    _write_buckets(words_from_text(texts, **places), table, path, ("doc_id",), buckets)


def _write_buckets(rows: DataFrame, table: str, path: str, by: tuple[str, ...], buckets: int) -> None:
    """Write rows that are dealt out and in order already: a task's rows go to the file of their bucket as they come, where
    Spark would sort them by bucket once more."""
    conf = rows.sparkSession.conf
    held = conf.get(_WRITERS)
    conf.set(_WRITERS, str(max(int(held), 2)))
    try:
        rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *by).saveAsTable(table)
    finally:
        conf.set(_WRITERS, held)


def words_from_text(df: DataFrame, id_column: str = "doc_id", text: str = "text", lines_per_page: int = 40, html: bool = False) -> DataFrame:
    """Plain text or HTML as positioned words: a line is 12 points high, a character 6 points wide, a page
    lines_per_page long. Columns doc_id, page, line_no, word_no, x0, top, x1, bottom, text. A line's places are one
    running sum, so its length does not matter."""
    body = F.col(text)
    if html:
        body = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?i)</(?:p|div|li|h[1-6]|tr|article|nav|footer)\s*>|<br\s*/?>", "\n")
        body = F.regexp_replace(body, r"<[^>]*>", "")

    def place(batches):
        for b in batches:
            words, count, owner, number = [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                for n, row in enumerate(t.split("\n") if t is not None else ()):
                    own = _BLANKS.split(row.strip(" "))
                    words += own
                    count.append(len(own))
                    owner.append(k)
                    number.append(n)
            size, count = np.fromiter(map(len, words), np.int64, len(words)), np.array(count, np.int64)
            row = np.repeat(np.arange(len(count)), count)
            first = np.cumsum(count) - count  # of each line among all words
            at = np.cumsum(size + 1) - size - 1
            keep = np.flatnonzero(size)
            row, lines = row[keep], np.array(number, np.int64)
            flat = [np.array(owner, np.int64)[row], lines[row], keep - first[row], at[keep] - at[first[row]], size[keep]]
            words = [w for w in words if w]
            top = (flat[1] % lines_per_page) * 12.0 + 20
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").take(pa.array(flat[0])),
                    pa.array(flat[1] // lines_per_page + 1, pa.int32()),
                    pa.array(flat[1], pa.int32()),
                    pa.array(flat[2], pa.int32()),
                    pa.array(flat[3] * 6.0),
                    pa.array(top),
                    pa.array((flat[3] + flat[4]) * 6.0),
                    pa.array(top + 10),
                    pa.array(words, pa.string()),
                ],
                names=["doc_id", "page", "line_no", "word_no", "x0", "top", "x1", "bottom", "text"],
            )

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_column).alias("doc_id"), body.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(place, f"doc_id {kind}, page int, line_no int, word_no int, x0 double, top double, x1 double, bottom double, text string")


def tokens(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, token: words without places, where these do not matter."""
    lines = text_lines(df, id_column, text)
    return lines.select("doc_id", "line_no", F.explode(F.split(F.trim("text"), r"\s+")).alias("token")).where("token <> ''")


def text_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), text of each line, blank ones included."""
    return df.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))


#: How test cases and results are written: all values in quotes, so that an empty text is not a missing one.
CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\\N", "emptyValue": ""}


def read_eval_csv(spark: SparkSession, path: str, schema: str = EVAL_SCHEMA) -> DataFrame:
    """Rows of a CSV file with quotes and line ends in its values; \\N is a missing one."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, **CSV)


def write_cases_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, **CSV)


def shown(c: Column, width: int = 600, marker: str = " ⏎ ") -> Column:
    """A reply on one line, cut to a width."""
    return F.substring(F.regexp_replace(c, r"\r?\n", marker), 1, width)


def write_results_csv(df: DataFrame, path: str, width: int = 600) -> None:
    cols = [shown(F.col(c), width).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    write_cases_csv(df.select(*cols), path)


SPAN = "map<string,struct<s22:int,end22:int,note:string>>"


def read_spans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """section_id, start_page, end_page, note from a JSON map; ids without a start are left out. With `lines` each line
    is such a map (what write_spans writes), so files of any size are split over tasks."""
    whole = spark.read.text(path, wholetext=not lines).select(F.from_json("value", SPAN).alias("m"))
    return (
        whole.select(F.explode("m").alias("section_id", "v"))
        .select("section_id", F.col("v.s22").alias("start_page"), F.col("v.end22").alias("end_page"), F.col("v.note").alias("note"))
        .where("start_page is not null")
    )


def write_spans(spans: DataFrame, path: str) -> None:
    """A JSON map {id: {s22, end22, note}} of one section a line, in the order of the ids: sections are cut into ranges,
    and each task sorts and writes its own. read_spans reads it with lines."""
    entry = F.struct(F.col("start_page").alias("s22"), F.col("end_page").alias("end22"), "note")
    known = spans.where("start_page is not null").repartitionByRange("section_id").sortWithinPartitions("section_id")
    known.select(F.to_json(F.create_map("section_id", entry)).alias("value")).write.mode("overwrite").text(path)


def latest(updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row in `order` of each key; without an order, the updates as they are."""
    if not order:
        return updates
    payload = F.struct(order, *[c for c in updates.columns if c != order])
    return updates.groupBy(*keys).agg(F.max(payload).alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in updates.columns])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Target with updates merged by key; of several updates for a key the last in `order` wins. Write the result to a
    new path: a plan must not overwrite what it reads. `store.Store` writes in place, partition by partition."""
    last = latest(updates, keys, order)
    same = [target[k].eqNullSafe(last[k]) for k in keys]
    return target.join(last, same, "left_anti").unionByName(last, allowMissingColumns=True)


def delete_where(target: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is not true (null counts as not true)."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return target.where(~F.coalesce(c, F.lit(False)))


def export_log(log: DataFrame) -> DataFrame:
    """The log's fixed columns as text, nulls as ''."""
    return log.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LOG_COLUMNS])


def export_log_csv(log: DataFrame, path: str) -> None:
    export_log(log).write.mode("overwrite").csv(path, header=True)
