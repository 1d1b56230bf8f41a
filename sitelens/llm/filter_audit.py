"""How filters act together: inclusion-exclusion over joint failures of every set of filters.

Each document has one flag for each filter. For every set S of filters the joint-failure count J(S) is the sum of the
products of S's flags: the documents that fail all of S, whatever else they fail. With five filters these are 32 sums for
each part and population (all documents, good ones, toxic ones). All else follows from them without reading a document
again: inverted by Moebius over the subset lattice, survivors of a set P are the sum over T within P of (-1)^|T| J(T);
what a step removes is a difference of survivors; what only one filter catches is the last such difference; and the
Shapley value of a filter in the game "documents removed by S" is the sum over the sets T that hold it of the Harsanyi
dividend (-1)^(|T|+1) J(T), divided by |T|. The sum over all orders is that value times the number of orders.

Scale: a document becomes one row of a digest, its identifier and a mask where it is scanned; texts are never exchanged.
Copies are counted in three grouped steps (digest and identifier, then digest, part and mask, then digest), so a text that a
third of all rows hold is spread over its identifiers first and meets its own digest as a few rows with counts. What is
joined, exploded or listed at the end is one row for each part.

Defined results: a null text is an empty one; a null part is the empty string; texts are equal if their SHA-256 are; a null
identifier is neither smaller nor larger than another, so such a row is never a copy and makes none; rows repeated with their
identifier count each, and none is a copy of another; a document labelled in several rows is good or toxic if one of them says so; an empty
table gives no row. Only the named columns are read, so others may bear any name.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Populations of which joint failures are counted.
WEIGHTS = ("n", "good", "toxic")
_BLANK = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by letter: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(text, _BLANK), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(flags: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags.values())], F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame | None, flags: dict[str, Column], text: Column, part: Column, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the exact set of filters they fail.

    flags: failure conditions by letter, over docs' columns; the bit after theirs is set for a text that a smaller identifier holds.
    labels: (doc_id, quality, toxic), or None.
    """
    copy = 1 << len(flags)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), part.alias("part"), _mask(flags).alias("mask"))
    once = rows.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("c"))
    if labels is None:
        marked = once.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(
            F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
        ).withColumn("spread", F.lit(False))
        # rows without an identifier match nothing and are dealt by their text
        keyed = once.withColumns({"key": F.coalesce("id", F.xxhash64("digest")), "spread": F.col("id").isNull()})
        marked = keyed.join(said, ["key", "spread"], "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    lowest = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c")))
    grouped = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("c").alias("c"), lowest.alias("low"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"))
    first = F.min("low.id").over(Window.partitionBy("digest"))
    own = F.col("unnamed") + F.when(F.col("low.id") == F.col("first"), F.col("low.c")).otherwise(0)
    split = grouped.withColumn("first", first).withColumn("own", own)
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("own").alias("c")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("c") - F.col("own")).alias("c")))).alias("x"))
    c = F.col("x.c")
    return both.filter(c > 0).groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(c).alias("n"), F.sum(c * F.col("good")).alias("good"), F.sum(c * F.col("toxic")).alias("toxic"))


def joint_failures(exact: DataFrame, letters: str) -> DataFrame:
    """(part, n, good, toxic): for each population the counts J(S) at the place S of an array, summed as products of flags."""
    flag = [F.shiftright("mask", i).bitwiseAND(F.lit(1)) for i in range(len(letters))]

    def products(weight: str) -> Column:
        return F.array(*[F.sum(reduce(mul, [flag[i] for i in range(len(letters)) if s >> i & 1], F.col(weight))) for s in range(1 << len(letters))])

    return exact.groupBy("part").agg(*[products(w).alias(w) for w in WEIGHTS])


def _survivors(joint: Column, size: int) -> Column:
    """Moebius inversion: at the place P, the sum over T within P of (-1)^|T| J(T)."""
    subset = F.sequence(F.lit(0), F.lit(size - 1))

    def of(p: Column) -> Column:
        def add(total: Column, t: Column) -> Column:
            sign = F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1)
            return total + F.when(t.bitwiseAND(p) == t, sign * F.get(joint, t)).otherwise(0)

        return F.aggregate(subset, F.lit(0).cast("bigint"), add)

    return F.transform(subset, of)


def _shapley(joint: Column, size: int, bit: int, orders: int) -> Column:
    """Sum over all orders of what the filter removes: Harsanyi dividends shared evenly within their sets."""

    def add(total: Column, t: Column) -> Column:
        dividend = F.when(F.bit_count(t) % 2 == 1, 1).otherwise(-1) * F.get(joint, t)
        return total + F.when(F.shiftright(t, bit).bitwiseAND(F.lit(1)) == 1, dividend * F.floor(F.lit(orders) / F.bit_count(t))).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), F.lit(0).cast("bigint"), add)


def report(joint: DataFrame, letters: str) -> DataFrame:
    """For each part, every order of the filters and every step: what is kept, removed, redundant and lost there."""
    size, every = 1 << len(letters), ["".join(p) for p in permutations(letters)]
    alive = joint.select("part", "n", *[_survivors(F.col(w), size).alias(f"{w}_left") for w in WEIGHTS])
    value = F.array(*[_shapley(F.col("n"), size, i, len(every)) for i in range(len(letters))])
    rows = alive.withColumn("value", value).withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in every])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    place = F.transform(F.split("filter_order", ""), lambda c: F.instr(F.lit(letters), c) - 1)
    bits = F.transform(F.filter(place, lambda i: i >= 0), lambda i: F.call_function("shiftleft", F.lit(1), i))
    rows = rows.withColumns({"bits": bits}).withColumns({"bit": F.get("bits", F.col("step") - 1), "prior": F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)})
    before, after, own = F.col("prior"), F.col("prior") + F.col("bit"), F.col("bit")

    def removed(weight: str) -> Column:
        return F.get(f"{weight}_left", before) - F.get(f"{weight}_left", after)

    only = F.get("n_left", F.lit(size - 1) - own) - F.get("n_left", F.lit(size - 1))
    return rows.select(
        "part", "filter_order", "step", F.get("n_left", after).alias("kept"), removed("n").alias("removed"), (F.get("n", own) - removed("n")).alias("redundant"),
        only.alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("value", F.log2(own.cast("double")).cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", part_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The report of the five filters A to E over whole texts, by part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flags = conditions(text)
    exact = failure_counts(docs, labels, flags, text, F.coalesce(F.col(part_col).cast("string"), F.lit("")), id_col)
    letters = "".join(flags) + "E"
    return report(joint_failures(exact, letters), letters)
