"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles. Its sketch has BINS coordinates, filled in rounds: in each of the
first BINS rounds every shingle is hashed to one bin, a lower round beating a higher one and within a round the lower
value; the rounds after that send all shingles to one bin each, so no coordinate stays empty and each agrees between
two sets with the probability of their Jaccard similarity, with concentration. BANDS bands of the coordinates make
cells; two sets with similarity 0.8 miss each other in all cells with probability under 1e-7.

Equal sets are one class, represented by its smallest identifier. In each cell the class of highest priority (a hash)
is the hub; (hub, member) pairs are verified on the full sets and components are taken. Cells that still hold classes of
two components are reopened: a hub of the component with most members there, another one in each cell, is tested against
the classes outside that component. What is still open is finished exhaustively: all pairs across components that
were not tested yet, by a join in cells of up to FEW classes, and in larger cells by 16-bit fingerprints of the sets in
blocks of BLOCK classes, which bound each intersection from above; only pairs whose bound reaches the similarity are
verified. So a cell of thousands of copies costs a few pairs each, and no link
that joins two components is lost.

Components: union-find in one executor task while there are at most ONE_TASK links, a count that is taken first; beyond
that alternating large-star and small-star steps on written tables.
Scale: what is exchanged is band hashes (BANDS longs a class) and, for tested pairs alone, shingle sets. Sets are built
once, by the scan, for documents that share a cell (a filter of bounded size finds them there), so no text is exchanged;
hot classes are pre-aggregated; nothing is collected. Defined results: documents without words are linked with nothing; a text with
fewer words than a shingle is its whole sequence; identifiers are taken as unique, a null identifier links to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_in, written
from .words import mix, word_hashes

BINS, BANDS, STARS = 128, 32, 2
FEW, BLOCK, ONE_TASK = 8, 4000, 1_000_000
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TOP = np.uint64((1 << 64) - 1)


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, one after another and sorted, and where each begins."""
    n = len(first) - 1
    sizes = np.diff(first)
    out, at = [], np.zeros(n + 1, dtype=np.int64)
    m = max(0, len(words) - width + 1)
    rolled = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x9FB21C651E98DF25) + words[k : k + m] + np.uint64(k))
    for d in range(n):
        if sizes[d] >= width:
            own = np.unique(rolled[first[d] : first[d + 1] - width + 1])
        elif sizes[d]:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[first[d] : first[d + 1]]:
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + w + np.uint64(0x5151))
            own = h
        else:
            own = words[:0]
        out.append(own)
        at[d + 1] = at[d] + len(own)
    return (np.concatenate(out) if out else words[:0]), at


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketch of each set, one row of BINS values; rows of empty sets hold the largest value."""
    n = len(at) - 1
    s = np.full(n * BINS, _TOP, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(at))
    for i in range(2 * BINS):
        if not len(sets):
            break
        v = mix(sets ^ _SEEDS[i])
        bins = (v & np.uint64(BINS - 1)).astype(np.int64) if i < BINS else np.full(len(v), i - BINS)
        np.minimum.at(s, doc * BINS + bins, (np.uint64(i) << np.uint64(56)) | (v >> np.uint64(8)))
        open_ = (s.reshape(n, BINS) == _TOP).any(axis=1)[doc]
        sets, doc = sets[open_], doc[open_]
    return s.reshape(n, BINS)


def bands(sketch: np.ndarray) -> np.ndarray:
    """Cell hashes, one row of BANDS values."""
    rows = sketch.reshape(len(sketch), BANDS, BINS // BANDS)
    h = np.zeros((len(sketch), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[2]):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + rows[:, :, k])
    return h


def sketch_table(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), f1 and f2 (fingerprint of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, first in word_hashes(b.column("text")):
                sets, at = shingle_sets(words, first, width)
                n = np.diff(at)
                total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([mix(sets), mix(sets ^ np.uint64(0xABCDEF))]), axis=1, dtype=np.uint64)], axis=1)
                f = (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)
                cells = bands(sketches(sets, at)).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) + 1, BANDS, dtype=np.int32)), pa.array(cells))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(n), pa.array(f[0]), pa.array(f[1]), lists], ["id", "n", "f1", "f2", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _set_table(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the wanted identifiers, and of few others. Texts are read where they are scanned; none is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, first in word_hashes(b.column("text")):
                sets, at = shingle_sets(words, first, width)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), lists], ["id", "set"])

    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return maybe_in(own, "id", wanted).filter("_maybe").select("id", "text").mapInArrow(run, "id bigint, set array<bigint>")


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """16-bit fingerprints of sets."""
    for b in batches:
        lists = b.column("set")
        at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        short = (values & np.uint64(0xFFFF)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([short[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "short"])


def _held(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets of the identifiers and of few others, so that only these are exchanged."""
    return maybe_in(sets, "id", ids).filter("_maybe").select("id", "set")


def _possible(percent: int):
    """Pairs of different components in one block pair of a cell whose fingerprints leave the similarity possible.

    Every common shingle has a common fingerprint, so the count of one set's fingerprints found in the other bounds the
    intersection from above: no pair that reaches the similarity is left out.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep, n, root, side = (table.column(c).to_numpy() for c in ("rep", "n", "root", "side"))
        short = [np.frombuffer(x, dtype=np.uint16) for x in table.column("short").to_pylist()]
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)  # side: 0 first block, 2 second, 1 both are one block
        roots, counts = np.unique(root, return_counts=True)
        major = roots[counts.argmax()]
        out: list[tuple] = []

        def test(rows: np.ndarray, others: np.ndarray, allowed) -> None:
            values = np.concatenate([short[j] for j in others]) if len(others) else np.zeros(0, np.uint16)
            starts = np.concatenate([[0], np.cumsum([len(short[j]) for j in others])]).astype(np.int64)
            mark = np.zeros(1 << 16, dtype=bool)
            for i in rows:
                mark[short[i]] = True
                found = np.concatenate([[0], np.cumsum(mark[values])])
                mark[short[i]] = False
                bound = np.minimum(np.minimum(found[starts[1:]] - found[starts[:-1]], n[i]), n[others])
                ok = (100 * bound >= percent * (n[i] + n[others] - bound)) & (root[others] != root[i]) & (rep[others] != rep[i]) & allowed(i, others)
                out.extend((rep[i], n[i], rep[j], n[j]) for j in others[ok])

        if (side == 1).all():
            test(left[root[left] != major], right, lambda i, js: (root[js] == major) | (rep[js] > rep[i]))
        else:
            test(left[root[left] != major], right, lambda i, js: True)
            test(right[root[right] != major], left[root[left] == major], lambda i, js: True)
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["rep", "n", "hub", "hn"])

    return run


def _across(here: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs across components in a cell that can reach the similarity."""
    sizes = here.groupBy("cell").agg(F.count("*").alias("m"))
    sized = here.join(sizes, "cell")
    small = sized.filter(F.col("m") <= FEW)
    other = small.select("cell", F.col("rep").alias("hub"), F.col("n").alias("hn"), F.col("root").alias("hroot"))
    few = small.join(other, "cell").filter("rep < hub AND root <> hroot").select("rep", "n", "hub", "hn")
    large = sized.filter(F.col("m") > FEW)
    short = _held(sets, large.select(F.col("rep").alias("id"))).mapInArrow(_short, "id bigint, short binary")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = large.join(short.withColumnRenamed("id", "rep"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("with"), 1).when(F.col("own") < F.col("with"), 0).otherwise(2)
    placed = own.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "rep", "n", "root", side.alias("side"), "short")
    return few.unionByName(placed.groupBy("cell", "i", "j").applyInArrow(_possible(percent), "rep bigint, n bigint, hub bigint, hn bigint"))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node reachable."""
    if links.count() <= one_task:
        return links.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(1).mapInArrow(_union_find, "node bigint, root bigint")
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def cluster(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_shingles, component_id (smallest identifier reachable over links), kept."""
    base = written(sketch_table(docs, width, id_col, text_col), "sketch")
    classes = written(base.filter(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "classes")
    cells = base.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), "n", F.posexplode("bands").alias("band", "h")).select("rep", "n", F.xxhash64("band", "h").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("m")).filter("m > 1").select("cell")
    members = written(cells.join(shared, "cell"), "members")
    sets = written(_set_table(docs, members.select(F.col("rep").alias("id")), width, id_col, text_col), "sets")
    links, tested, comp = None, None, None
    spent = [members, sets]
    for star in range(STARS + 1):
        if comp is None:
            if 0 < star < STARS:
                continue  # the hubs would be the same again
            here = members.withColumn("root", F.col("rep"))
        else:
            known = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
            open_ = known.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cell")
            here = written(known.join(open_, "cell"), "open")
            spent.append(here)
        pairs = _hubs(here, comp is None) if star < STARS else _across(here, sets, percent)
        # sizes alone rule out a pair whose smaller set is under percent of the larger
        pairs = pairs.filter(F.lit(100) * F.least("n", "hn") >= F.lit(percent) * F.greatest("n", "hn"))
        first = F.col("rep") < F.col("hub")
        pairs = pairs.select(
            F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"),
            F.when(first, F.col("n")).otherwise(F.col("hn")).alias("na"), F.when(first, F.col("hn")).otherwise(F.col("n")).alias("nb"),
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            continue
        done = pairs.select("a", "b")
        tested = done if tested is None else tested.unionByName(done)
        good = written(_verified(pairs, sets, percent), "links")
        spent.append(good)
        links = good if links is None else links.unionByName(good)
        old, comp = comp, written(components(links), "components")
        discard(old)
    discard(*spent)
    docs_ = base.select("id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"], "left")
    if comp is not None:
        docs_ = docs_.join(comp.select(F.col("node").alias("rep"), "root"), "rep", "left")
    else:
        docs_ = docs_.withColumn("root", F.lit(None).cast("bigint"))
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.coalesce("root", "rep", "id"))
    kept = F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    return docs_.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", kept)


def _hubs(here: DataFrame, fresh: bool) -> DataFrame:
    """Pairs of each cell's hub with its members of other components; the hub stands in the component with most members there."""
    salt = F.xxhash64("rep") if fresh else F.xxhash64("cell", "rep")
    hub = F.struct(salt.alias("p"), F.col("rep").alias("hub"), F.col("n").alias("hn"))
    if fresh:
        roots = here.select("cell", "root", F.lit(1).alias("c"), hub.alias("h"))
    else:
        roots = here.groupBy("cell", "root").agg(F.count("*").alias("c"), F.max(hub).alias("h"))
    top = roots.groupBy("cell").agg(F.max(F.struct("c", "h", F.col("root").alias("hroot"))).alias("t")).select("cell", "t.h.hub", "t.h.hn", "t.hroot")
    return here.join(top, "cell").filter("rep <> hub AND root <> hroot").select("rep", "n", "hub", "hn")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    one = _held(sets, pairs.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("set").alias("sa"))
    two = _held(sets, pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    return checked.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
