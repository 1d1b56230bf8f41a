"""Quality rules by cross-document line frequency, in DataFrame functions only.

A line is normalised (white space collapsed, trimmed, lower-cased) and hashed. For each host the distinct documents
(distinct by text, so that exact copies count once) holding a line are counted. A line found in more than
max(MIN_DOCS, MAX_SHARE of the host's distinct documents) documents is removed, and a document that keeps less than
KEEP_SHARE of its words after that is depleted and rejected. Base rules reject short and self-repeating documents.

Scale: counting is two map-side combined aggregations over (host, line hash, text hash); the join that finds removed
lines carries no text (lines are hashed once, into a written table), and its frequent side holds at most (lines / MIN_DOCS) rows, so a hot host or line is split by
the skew join and not gathered. Every per-document measure stays in the document's own row.
Defined results: null and empty texts have no words and fail; a null host is a host of its own; a row is judged by its
own text and host, so equal, repeated or null identifiers change nothing; extra columns with the names of measures give way,
and names used on the way are drawn free of the table's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free, maybe_in, without, written

MIN_DOCS, MAX_SHARE, KEEP_SHARE = 20, 0.10, 0.30
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Runs of characters outside {0x20, 0x09-0x0D}."""
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda w: w != "")


def _repeated(w: Column) -> Column:
    """Words that stand in a 3-word window found at least twice in the text."""
    n = F.size(w)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))
        at = F.element_at(F.transform(F.array(placed), places), 1)
        def total(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return F.element_at(F.transform(F.array(at), total), 1)
    return F.element_at(F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))), 1).cast("bigint")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.element_at(F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated(w).alias("r"))), 1)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    dups = F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1)
    (own,) = free(docs, "_held")
    out = docs.withColumn(own, held)
    return (
        out.withColumn("n_words", F.col(f"{own}.n"))
        .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", dups.cast("bigint"))
        .withColumn("n_repeat_words", F.col(f"{own}.r"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")))
        .drop(own)
    )


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row key, host, text hash, line hash, words in the line) for each line with a word; no text leaves the scan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    # each step is a transform of its own, so that a line is normalised once however often its facts use it
    normal = F.transform(lines, lambda x: F.filter(F.split(F.translate(F.lower(x), SPACES[1:], " " * 5), " "), lambda w: w != ""))
    facts = F.transform(normal, lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("line"), F.size(w).alias("n")))
    return docs.select(_row_key(id_col, text_col, host_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000")).alias("_host"), F.xxhash64(text).alias("_text"), F.explode(facts).alias("_l")).select("_id", "_host", "_text", "_l.line", "_l.n")


def frequent_lines(docs: DataFrame, rows: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, line) above the limit, each once."""
    per_line = rows.select("_host", "line", "_text").distinct().groupBy("_host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > MIN_DOCS)
    hosts = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000")).alias("_h"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")).distinct().groupBy("_h").agg(F.count("*").alias("all"))
    return per_line.join(hosts, F.col("_host") == F.col("_h")).filter(F.col("docs") > F.lit(MAX_SHARE) * F.col("all")).select("_host", "line")


def _row_key(id_col: str, text_col: str, host_col: str) -> Column:
    """A hash of what the verdict of a row depends on, and of its identifier; equal rows share it and their verdict."""
    return F.xxhash64(F.lit(7), F.col(id_col).isNull(), F.col(id_col), F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000")), F.coalesce(F.col(text_col), F.lit("")))


def _removals(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(key, line words, removed words) of documents that lose a line. Equal rows add up in both numbers alike."""
    rows = written(line_rows(docs, id_col, text_col, host_col), "lines")
    frequent = frequent_lines(docs, rows, text_col, host_col).withColumn("_frequent", F.lit(True))
    marked = rows.join(frequent, ["_host", "line"], "left_semi").groupBy("_id").agg(F.sum("n").alias("_gone"))
    words = maybe_in(rows.select("_id", "n"), "_id", marked.select(F.col("_id").alias("id"))).filter("_maybe").groupBy("_id").agg(F.sum("n").alias("_words"))
    return marked.join(words, "_id").select(F.col("_id").alias("_key"), "_words", "_gone")


def _depleted(words: Column, removed: Column) -> Column:
    return words - removed < F.lit(KEEP_SHARE) * words


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The other columns of docs but the text, the measures, removed_words and kept."""
    removed = _removals(docs, id_col, text_col, host_col)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    gives_way = {c.lower() for c in (text_col, *added, "removed_words", "kept")}
    row, key, words_, gone = free(docs, "_row", "_key", "_words", "_gone")
    keyed = docs.withColumn(row, _row_key(id_col, text_col, host_col))
    own = [c for name, c in zip(docs.columns, columns_of(docs), strict=True) if name.lower() not in gives_way]
    facts = measures(keyed, text_col).select(*own, *added, row)
    judged = facts.join(removed.toDF(key, words_, gone), F.col(row) == F.col(key), "left")
    lost = F.coalesce(F.expr(f"{gone} * n_words div {words_}"), F.lit(0)).cast("bigint")
    judged = judged.withColumn("removed_words", lost).drop(row, key, words_, gone)
    return judged.withColumn("kept", ~F.col("base_failed") & ~_depleted(F.col("n_words"), F.col("removed_words")))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that judge keeps, all columns; texts are not exchanged but for rows that may be rejected."""
    key = _row_key(id_col, text_col, host_col)
    failed = measures(docs.select(key.alias("id"), text_col), text_col).filter("base_failed").select("id")
    depleted = _removals(docs, id_col, text_col, host_col).filter(_depleted(F.col("_words"), F.col("_gone"))).select(F.col("_key").alias("id"))
    rejected = written(failed.unionByName(depleted), "rejected")
    (row,) = free(docs, "_row")
    return without(docs.withColumn(row, key), row, rejected).drop(row)
