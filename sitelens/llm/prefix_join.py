"""Set similarity self-join on word shingles by adaptive multi-match prefixes, and the components of its links.

All sets are sorted by one global order, rarest shingle first. Two sets of similarity t share at least o = ceil(t n) shingles,
n the size of either, so the first n - o + l of both hold at least l common ones: the l-prefix scheme. Each document
chooses its own l between 1 and DEEPEST. For every l the postings of its prefix are estimated from the counts: LIST times their
sum is the cost of meeting them, and their sum divided by l bounds the partners that share l of them, each of which costs a
verification in proportion to n. The cheapest l is taken. A pair is verified if it shares at least the smaller l of the two in
the prefixes that both wrote; as both prefixes hold that l's prefix, no pair of the similarity is lost.

The order needs no exact counts, only to be the same for all. Shingles are counted over all texts in a table of COUNTERS
counters by hash, whatever the input's size, so 8 MB are broadcast; rare shingles stand in order of their counter, ties by
hash.

Equal sets are one class, represented by its smallest identifier. Groups of near copies would give all their pairs, so in
each shingle's cell a hub (the class that meets most others) is tested with the rest first, components are taken, and cells
that still hold several are given another hub; pairs that cross components and were not tested are then joined in full: directly in cells of at most FEW
classes, and in larger ones by 16-bit fingerprints in blocks (near_dedup), which drop only pairs that cannot reach the
similarity. So the components are those of all links.

Scale: a prefix row is an identifier, a size, an l and a hash. Full sets are built at the scan for documents of candidate pairs
alone, behind a filter of bounded size; no text is exchanged and nothing that grows with the input is collected.
Defined results: as for near_dedup. Null and empty texts have no shingles and link with nothing, fewer words than a shingle
are one, an identifier is taken as unique, a null one links with nothing, an empty table gives no row, and only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_in, written
from .near_dedup import BLOCK, _possible, _set_table, _verified, components, shingle_sets
from .words import mix, word_hashes

#: Counters of the order, and of one row of the table that is summed.
COUNTERS, ROW = 1 << 21, 1 << 16
#: Longest multi-match prefix; cost of meeting one posting and of verifying one pair for each shingle of a set.
DEEPEST, LIST, VERIFY = 4, 1.0, 1 / 16
#: Partners expected at least of a shingle that the counters can't tell from their noise.
RARE = 0.5
FEW = 32


def measured(docs: DataFrame, width: int, id_col: str, text_col: str, counters: int = COUNTERS) -> DataFrame:
    """In one pass: id, n (set size), f1 and f2 (fingerprint) of each document, and counts of shingles as rows of the table of counters (place, counts)."""
    per_row = min(ROW, counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(counters, dtype=np.int64), [], 0

        def settle() -> None:
            nonlocal waiting, held
            if waiting:
                np.add(total, np.bincount(np.concatenate(waiting), minlength=counters), out=total)
            waiting, held = [], 0

        def out(columns: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", "place", "counts"])

        for b in batches:
            for lo, hi, words, first in word_hashes(b.column("text")):
                sets, at = shingle_sets(words, first, width)
                summed = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([mix(sets), mix(sets ^ np.uint64(0xABCDEF))]), axis=1, dtype=np.uint64)], axis=1)
                f = (summed[:, at[1:]] - summed[:, at[:-1]]).view(np.int64)
                waiting.append((sets & np.uint64(counters - 1)).astype(np.int32))
                held += len(sets)
                if held > counters:
                    settle()
                none = pa.nulls(hi - lo, pa.int32())
                yield out([b.column("id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(f[0]), pa.array(f[1]), none, pa.nulls(hi - lo, pa.binary())])
        settle()
        rows = total.reshape(-1, per_row)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            none = pa.nulls(len(some), pa.int64())
            packed = [pa.compress(rows[i].tobytes(), codec="zstd", asbytes=True) for i in some]
            yield out([none, none, none, none, pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, place int, counts binary")


def counts_of(base: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """The whole table of counters, of a fixed size: summed row by row on the executors, then handed to the driver."""
    per_row = min(ROW, counters)
    size = per_row * 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for place, packed in zip(b.column("place").to_pylist(), b.column("counts"), strict=True):
                own = total.setdefault(place, np.zeros(per_row, dtype=np.int64))
                own += np.frombuffer(pa.decompress(packed.as_py(), decompressed_size=size, codec="zstd", asbytes=True), dtype=np.int64)
        if total:
            top = np.iinfo(np.uint32).max
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, top).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["place", "counts"])

    table = np.zeros(counters, dtype=np.uint32)
    summed = base.filter("place IS NOT NULL").select("place", "counts").repartition(max(1, counters // per_row // 4), "place").mapInArrow(add, "place int, counts binary")
    for r in summed.collect():  # 4 bytes a counter, whatever the input
        table[r.place * per_row : (r.place + 1) * per_row] = np.frombuffer(r.counts, dtype=np.uint32)
    return table


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set of the similarity."""
    return -(-percent * n // 100)


def depth(postings: np.ndarray, n: int, percent: int) -> int:
    """The l of least estimated cost; postings: expected partners of each shingle of the set, in the order, as many as the longest prefix."""
    o = least_common(n, percent)
    most = min(DEEPEST, o)
    ls = np.arange(1, most + 1)
    met = np.cumsum(postings)[n - o + ls - 1]
    return int(ls[np.argmin(LIST * met + VERIFY * n * met / ls)])


def prefixes(docs: DataFrame, wanted: DataFrame, table: np.ndarray, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, l, cell): the prefix of each wanted document, and of few others, a row for each shingle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table.tobytes())
    usual, last = float(table.mean()), np.uint64(len(table) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, dtype=np.uint32)
        for b in batches:
            for lo, hi, words, first in word_hashes(b.column("text")):
                sets, at = shingle_sets(words, first, width)
                own = counts[(sets & last).astype(np.int64)]
                reps, ns, ls, cells = [], [], [], []
                for k, d in enumerate(b.column("id").slice(lo, hi - lo).to_pylist()):
                    n = int(at[k + 1] - at[k])
                    if not n:
                        continue
                    o = least_common(n, percent)
                    order = np.argsort(own[at[k] : at[k + 1]], kind="stable")[: n - o + min(DEEPEST, o)]  # sets are sorted by hash, so ties are too
                    # a counter holds what other shingles bring there, about the mean, besides the shingle's own documents
                    expected = np.maximum(own[at[k] + order].astype(np.float64) - 1 - usual, RARE)
                    l = depth(expected, n, percent)
                    chosen = sets[at[k] + order[: n - o + l]].view(np.int64)
                    reps.append(np.full(len(chosen), d, dtype=np.int64))
                    ns.append(np.full(len(chosen), n, dtype=np.int64))
                    ls.append(np.full(len(chosen), l, dtype=np.int8))
                    cells.append(chosen)
                if reps:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (reps, ns, ls, cells)], ["rep", "n", "l", "cell"])

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return maybe_in(own, "id", wanted).filter("_maybe").select("id", "text").mapInArrow(run, "rep bigint, n bigint, l tinyint, cell bigint")


def _fits(percent: int):
    """Sizes alone leave the similarity possible."""
    return F.lit(100) * F.least("n", "hn") >= F.lit(percent) * F.greatest("n", "hn")


def _with_hubs(here: DataFrame, again: bool, percent: int) -> DataFrame:
    """(rep, n, l, hub, hn, hl): each cell's hub with the cell's classes of other components.

    First the hub is the class that meets most others over all its cells: the text that copies were made from has no
    shingles of its own, its copies have. Then it is any other class of the component with most members in the cell.
    """
    salt = F.xxhash64("rep", F.lit(7)) if again else F.col("weight")
    hub = F.struct(salt.alias("p"), F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("l").alias("hl"))
    if again:
        roots = here.groupBy("cell", "root").agg(F.count("*").alias("c"), F.max(hub).alias("h"))
    else:
        roots = here.select("cell", "root", F.lit(1).alias("c"), hub.alias("h"))
    top = roots.groupBy("cell").agg(F.max(F.struct("c", "h", F.col("root").alias("hroot"))).alias("t")).select("cell", "t.h.hub", "t.h.hn", "t.h.hl", "t.hroot")
    return here.join(top, "cell").filter((F.col("root") != F.col("hroot")) & _fits(percent)).select("rep", "n", "l", "hub", "hn", "hl")


def _across(here: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs of classes of different components that share a cell and can reach the similarity, once for each cell they share."""
    sized = here.join(here.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    small = sized.filter(F.col("m") <= FEW)
    other = small.select("cell", F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("l").alias("hl"), F.col("root").alias("hroot"))
    few = small.join(other, "cell").filter((F.col("rep") < F.col("hub")) & (F.col("root") != F.col("hroot")) & _fits(percent)).select("rep", "n", "l", "hub", "hn", "hl")
    large = sized.filter(F.col("m") > FEW)
    if large.isEmpty():
        return few, []
    ids = large.select(F.col("rep").alias("id")).distinct()
    short = written(_set_table(docs, ids, width, id_col, text_col).select("id", F.transform("set", lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("set")), "short")
    packed = short.mapInArrow(_packed, "rep bigint, short binary")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = large.join(packed, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("with"), 1).when(F.col("own") < F.col("with"), 0).otherwise(2)
    placed = own.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "rep", "n", "root", side.alias("side"), "short")
    found = placed.groupBy("cell", "i", "j").applyInArrow(_possible(percent), "rep bigint, n bigint, hub bigint, hn bigint")
    depths = large.select("rep", "l").distinct()
    deep = found.join(depths, "rep").join(depths.select(F.col("rep").alias("hub"), F.col("l").alias("hl")), "hub").select("rep", "n", "l", "hub", "hn", "hl")
    return few.unionByName(deep), [short]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """16-bit fingerprints as bytes."""
    for b in batches:
        lists = b.column("set")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.uint16)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([values[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["rep", "short"])


def _matched(pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb): pairs that share as many prefix shingles as the smaller l of the two asks for."""
    first = F.col("rep") < F.col("hub")
    named = pairs.select(
        F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"), F.when(first, F.col("n")).otherwise(F.col("hn")).alias("na"),
        F.when(first, F.col("hn")).otherwise(F.col("n")).alias("nb"), F.least("l", "hl").alias("need"),
    )
    return named.groupBy("a", "b", "na", "nb", "need").agg(F.count("*").alias("shared")).filter("shared >= need").select("a", "b", "na", "nb")


def join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Per document: id_col, n_shingles, component_id (smallest identifier reachable over links of percent similarity)."""
    base = written(measured(docs, width, id_col, text_col, counters), "measured")
    own = base.filter("place IS NULL").select("id", "n", "f1", "f2")
    classes = written(own.filter(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "classes")
    rows = prefixes(docs, classes.select(F.col("rep").alias("id")), counts_of(base, counters), width, percent, id_col, text_col)
    cells = written(rows, "prefixes")
    met = cells.groupBy("cell").agg(F.count("*").alias("m")).filter("m > 1")
    shared = written(cells.join(met, "cell"), "shared")
    members = written(shared.drop("m").join(shared.groupBy("rep").agg(F.sum("m").alias("weight")), "rep"), "members")
    discard(cells, shared)
    spent, tested, links, comp = [members], None, None, None
    for turn in ("hubs", "again", "all"):
        if comp is None:
            here = members.withColumn("root", F.col("rep"))
        else:
            known = members.join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
            open_ = known.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cell")
            here = written(known.join(open_, "cell"), "open")
            spent.append(here)
        if turn == "all":
            found, more = _across(here, docs, width, percent, id_col, text_col)
            spent += more
        else:
            found = _with_hubs(here, turn == "again", percent)
        pairs = _matched(found)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            continue
        done = pairs.select("a", "b")
        tested = done if tested is None else tested.unionByName(done)
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = written(_set_table(docs, ids, width, id_col, text_col), "sets")
        good = written(_verified(pairs, sets, percent), "links")
        discard(sets)
        spent.append(good)
        links = good if links is None else links.unionByName(good)
        old, comp = comp, written(components(links), "components")
        discard(old)
    discard(*spent)
    found = own.join(classes, ["f1", "f2", "n"], "left")
    if comp is None:
        found = found.withColumn("root", F.lit(None).cast("bigint"))
    else:
        found = found.join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.coalesce("root", "rep", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
