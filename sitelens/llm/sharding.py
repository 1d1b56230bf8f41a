"""Sharding by Karmarkar-Karp differencing, under the law that shards have near-equal bytes.

Documents with equal texts form a group that stays in one shard. A partial partition is a vector of one sum for each
shard; differencing takes the two with the largest spread and adds them in opposite order, until one is left. It runs
over the groups of each bucket of group hashes in parallel, which leaves one vector a bucket, and then over these
vectors on the driver (shards x buckets numbers). Only a group larger than a shard's fair share must make its shard
larger than an even one: such groups (fewer than shards) are divided by a hash of the identifier into SALTS pieces,
which are then groups of their own. All others stay whole. With several buckets, a group that one bucket could not make
up for (fewer than 2 x shards x buckets) is placed first, and as many buckets as it takes fill the other shards up.

Scale: bytes are pre-aggregated by group before any exchange; the join that brings shards back to documents carries no
text; slots come from window ranks within (shard, bucket of identifiers) plus a small table of bucket offsets, so no
task holds a whole shard.
Defined results: null text counts as empty (8 bytes); equal texts share a group, null and empty as well; an empty table
gives no rows. Repeated rows are documents of their own; a null identifier is an identifier.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SALTS, GROUPS_A_BUCKET, ROWS_A_RANK = 64, 20_000, 4096


def difference(vectors: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Karmarkar-Karp over vectors of sums: the final sums, and for each input the shard that each of its places goes to."""
    n = len(vectors)
    if not n:
        return np.zeros(0), []
    k = len(vectors[0])
    sums: dict[int, np.ndarray] = {}
    joined: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap: list[tuple[float, int]] = []
    order: dict[int, np.ndarray] = {}
    for i, v in enumerate(vectors):
        order[i] = np.argsort(v, kind="stable")[::-1]
        sums[i] = v[order[i]]
        heap.append((-(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        perm = np.argsort(both, kind="stable")[::-1]
        sums[new] = both[perm]
        joined.append((a, b, perm, perm))
        heapq.heappush(heap, (-(sums[new][0] - sums[new][-1]), new))
        new += 1
    place: dict[int, np.ndarray] = {new - 1: np.arange(k)}
    for at, (a, b, perm, _) in zip(range(new - 1, n - 1, -1), reversed(joined), strict=True):
        own = place.pop(at)
        to = np.empty(k, dtype=np.int64)
        to[perm] = own
        place[a], place[b] = to, to[::-1]
    out = []
    for i in range(n):
        to = np.empty(k, dtype=np.int64)
        to[order[i]] = place[i]
        out.append(to)
    return sums[new - 1], out


def place_groups(sizes: np.ndarray, shards: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over single sizes, with the partial partitions' members as linked lists: (place of each size, sums).

    before: what each shard holds already; the places are then these shards, and the sums include it.
    """
    n = len(sizes)
    held = [] if before is None else before.tolist()
    follow = np.full(n + len(held), -1, dtype=np.int64).tolist()
    heap = [(-float(s), i) for i, s in enumerate(sizes)]
    # sums descending; the lists' first and last members beside them
    parts: dict[int, list[tuple[int, int, int]]] = {}
    single = sizes.tolist()
    new = n
    if held:
        parts[new] = sorted(((h, n + j, n + j) for j, h in enumerate(held)), key=lambda x: -x[0])
        heap.append((-float(max(held) - min(held)), new))
        new += 1
    heapq.heapify(heap)

    def of(i: int) -> list[tuple[int, int, int]]:
        return [(single[i], i, i)] if i < n else parts.pop(i)

    while len(heap) > 1:
        a, b = of(heapq.heappop(heap)[1]), of(heapq.heappop(heap)[1])
        if len(a) < len(b):
            a, b = b, a
        both = a + [(0, -1, -1)] * (min(shards, len(a) + len(b)) - len(a))
        for j, (s, first, last) in enumerate(b):
            at = len(both) - 1 - j
            t, head, tail = both[at]
            if tail >= 0 and first >= 0:
                follow[tail] = first
                both[at] = (t + s, head, last)
            elif first >= 0:
                both[at] = (t + s, first, last)
            else:
                both[at] = (t + s, head, tail)
        both.sort(key=lambda x: -x[0])
        parts[new] = both
        low = both[-1][0] if len(both) == shards else 0
        heapq.heappush(heap, (-(both[0][0] - low), new))
        new += 1
    placed, sums = np.zeros(n + len(held), dtype=np.int64), np.zeros(shards, dtype=np.int64)
    for j, (s, first, _) in enumerate(of(heap[0][1]) if heap else []):
        sums[j] = s
        while first >= 0:
            placed[first] = j
            first = follow[first]
    if held:
        return np.argsort(placed[n:])[placed[:n]], sums[placed[n:]]
    return placed, sums


def _fingerprint(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_g1"), F.xxhash64(F.lit(17), text).alias("_g2")]


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(F.col(id_col), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *_fingerprint(text))
    groups = facts.groupBy("_g1", "_g2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = written(groups, "groups")
    total = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    if not total[2]:
        return facts.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    hot = [r._g1 for r in groups.filter((F.col("bytes") * shards > total[0]) & (F.col("n") > 1)).select("_g1").collect()]  # fewer than shards
    salt = F.when(F.col("_g1").isin(hot), F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0)
    salted = facts.withColumn("_salt", salt)
    units = groups.select("_g1", "_g2", F.lit(0).alias("_salt"), "bytes")
    if hot:
        units = units.filter(~F.col("_g1").isin(hot)).unionByName(salted.filter(F.col("_g1").isin(hot)).groupBy("_g1", "_g2", "_salt").agg(F.sum("size").alias("bytes")))
    buckets = -(-total[2] // GROUPS_A_BUCKET)
    few, ahead, filling = [], np.zeros(shards, dtype=np.int64), 0
    if buckets > 1:
        is_large = F.col("bytes") * (2 * shards * buckets) > total[0]
        few = units.filter(is_large).orderBy("_g1", "_g2", "_salt").collect()  # fewer than 2 x shards x buckets
        units = units.filter(~is_large)
    if few:
        own, ahead = place_groups(np.array([r.bytes for r in few], dtype=np.int64), shards)
        rest = max(1, total[0] - int(ahead.sum())) / buckets
        filling = min(buckets, int(1.25 * (shards * int(ahead.max()) - int(ahead.sum())) / rest) + 1)
    units = units.withColumn("_bucket", F.pmod(F.xxhash64("_g1", "_salt"), F.lit(buckets)).cast("int"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_g1", "_g2", "_salt"], kind="stable")
        placed, _ = place_groups(pdf["bytes"].to_numpy(np.int64), shards, ahead // filling if pdf["_bucket"].iloc[0] < filling else None)
        return pdf[["_g1", "_g2", "_salt", "_bucket", "bytes"]].assign(_place=placed.astype(np.int32))

    placed = written(units.groupBy("_bucket").applyInPandas(local, "_g1 bigint, _g2 bigint, _salt int, _bucket int, bytes bigint, _place int"), "placed")
    sums = np.zeros((buckets, shards), dtype=np.int64)
    for r in placed.groupBy("_bucket", "_place").agg(F.sum("bytes").alias("b")).collect():  # shards x buckets numbers
        sums[r._bucket, r._place] = r.b
    # the buckets that fill up go with what they fill up, as one vector
    _, perms = difference([ahead + sums[:filling].sum(axis=0), *sums[filling:]] if filling else list(sums))
    if filling:
        perms = [perms[0]] * filling + perms[1:]
    table = spark.createDataFrame(pd.DataFrame({"_bucket": np.repeat(np.arange(buckets, dtype=np.int32), shards), "_place": np.tile(np.arange(shards, dtype=np.int32), buckets), "shard": np.concatenate(perms).astype(np.int32)}))
    final = placed.join(table, ["_bucket", "_place"]).select("_g1", "_g2", "_salt", "shard")
    if few:
        final = final.unionByName(spark.createDataFrame([(r._g1, r._g2, r._salt, int(perms[0][k])) for r, k in zip(few, own.tolist(), strict=True)], "_g1 bigint, _g2 bigint, _salt int, shard int"))
    out = salted.join(final, ["_g1", "_g2", "_salt"]).select(id_col, "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    ranks = -(-total[1] // (ROWS_A_RANK * shards))
    out = written(out.withColumn("_r", F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(ranks)).cast("int")), "sharded")
    offsets = out.groupBy("shard", "_r").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_r", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_r").orderBy(F.col(id_col), "size", "text_crc32"))
    return out.withColumn("_k", rank).join(offsets, ["shard", "_r"]).select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_k") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
