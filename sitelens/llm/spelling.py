"""Spelling variants of a vocabulary: an even-partition pigeonhole join for one edit, and the forms it leads to.

Two words within one edit share one of two parts: a word of L code points is cut into its first L / 2 and the rest, and both
are indexed under (L, which, part). A word probes the indexes of its own length and of the length one less. An edit in the
second part leaves the first at place 0, one in the first part leaves the second at the word's end, so for each length and
part exactly one substring, shifted by the difference of the lengths, is looked up. A pair found by both parts is taken from
the first alone, which needs no exchange, and every pair is then verified by its edit distance.

A word's form is the near word of largest count, if that is at least RATIO times its own; counts grow by RATIO along a chain
of forms, so roots are found by a few rounds of pointer doubling over written tables.

Scale: occurrences are counted where a text is scanned and summed by word, so a word that is in every document sends one row
a task; the join and all that follows work on the vocabulary. Part joins are equi-joins, so Spark splits a part that many
words share. Defined results: a null text has no words; a null identifier is the text "null" in the hash that damages runs; a row repeated
with its identifier counts twice; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Least code points and occurrences of a word, and how many times more frequent its form is.
LEAST, SEEN, RATIO = 6, 5, 5
#: One in so many runs of a document loses a code point, as the contract has it; 0 leaves texts as they are.
DAMAGE = 199
#: Characters of distinct words that a task holds before it passes its counts on.
HELD = 4_000_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, damage: int = DAMAGE) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, lower-cased in A-Z, of at least ``least`` code points."""
    run_of = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        held = 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for at in range(b.num_rows):  # one text at a time, so that a batch of long ones is never held as Python strings
                text = b.column("text")[at].as_py()
                if not text:
                    continue
                own = Counter(run_of.findall(text.encode().lower().decode()))
                if damage:
                    start = zlib.crc32(f"{b.column('id')[at].as_py()}:".encode())
                    for run in [r for r in own if zlib.crc32(r.encode(), start) % damage == 0]:
                        k = zlib.crc32(run.encode(), start) % len(run)
                        short, n = run[:k] + run[k + 1 :], own.pop(run)
                        if len(short) >= least:
                            total[short] += n
                            held += len(short)
                for run, n in own.items():
                    if run not in total:
                        held += len(run)
                    total[run] += n
                if held > HELD:
                    yield passed_on()
                    total.clear()
                    held = 0
        yield passed_on()

    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    found = docs.select(name.alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _part(word: Column, of: Column, which: int, shift: int) -> Column:
    """The part ``which`` of an indexed word of ``of`` code points, as it stands in a word that is ``shift`` longer."""
    half = F.floor(of / 2).cast("int")
    return F.substring(word, F.lit(1), half) if which == 1 else F.substring(word, half + 1 + shift, of)


def _keys(words: DataFrame, shifts: tuple[int, ...], least: int) -> DataFrame:
    """A row for each part of a word under each length it looks up: of, which, part."""
    every = []
    for shift in shifts:
        of = F.col("length") - shift
        every += [F.struct(of.alias("of"), F.lit(which).alias("which"), _part(F.col("word"), of, which, shift).alias("part")) for which in (1, 2)]
    return words.select("word", "n", F.explode(F.array(*every)).alias("k")).select("word", "n", "k.*").filter(F.col("of") >= least)


def near_pairs(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, na, b, nb): each pair of distinct words (word, n) of at least ``least`` code points that differ by one edit, once."""
    sized = words.withColumn("length", F.length("word"))
    index = _keys(sized, (0,), least).select(F.col("word").alias("a"), F.col("n").alias("na"), "of", "which", "part")
    probe = _keys(sized, (0, 1), least).select(F.col("word").alias("b"), F.col("n").alias("nb"), "of", "which", "part")
    half = F.floor(F.col("of") / 2).cast("int")
    fresh = (F.col("which") == 1) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    found = index.join(probe, ["of", "which", "part"]).filter(once & fresh)
    return found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that following forms from a word leads to. Forms must not run in a circle."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.filter("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(before)
    return now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seen: int = SEEN, ratio: int = RATIO, damage: int = DAMAGE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least ``least`` code points and ``seen`` occurrences."""
    words = written(word_counts(docs, id_col, text_col, least, damage).filter(F.col("n") >= seen), "words")
    pairs = near_pairs(words, least)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("x")).select("x.*")
    best = written(both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("top")), "near")
    known = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("top.m") >= ratio * F.col("n"), F.lit(False)))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(F.col("fits"), F.col("top.near")).alias("form"), F.when(F.col("fits"), -F.col("top.m")).alias("form_n"))
    led = roots(known.filter("form IS NOT NULL"))
    return known.join(led, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
