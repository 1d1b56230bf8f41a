"""Language-model scores from a hierarchical Pitman-Yor model.

Each word (and the end of a text) is drawn in the restaurant of the word before it; a new table there orders its dish
from the parent restaurant, which all contexts share, and a new table of the parent from a uniform base over the
training vocabulary and one unknown word. Seating is sampled by blocked Gibbs: given a gamma variable for each
restaurant its dishes are independent, and each sweep draws every dish's number of tables, with all its customers, from
its exact conditional (generalised Stirling weights; by their recursion for dishes of up to RECURSED customers, beyond by
their contour integral in the neighbourhood of the likely numbers, as the recursion's cost is quadratic). The predictive probability is averaged over the samples after
burn-in; with discount d, strength s, counts c, tables t and the means over samples of t,
    p(w | u) = (c_uw - d t_uw + (s + d t_u) p(w)) / (s + c_u),  p(w) = (t_w - d r_w + (s + d r) / (V + 1)) / (s + t).
A document's score is the sum of log10 p over its words and its end; perplexity is 10 ** (-score / n_tokens).

How it is distributed. A block is up to BLOCK_BYTES of text of one scan partition. Blocks send what they count as
compressed packets, one for each shard that they have anything for: their distinct words with training counts, and their
distinct (context, word) pairs with training counts, also pairs of held-out texts with count 0. The number of shards
follows from the table's bytes alone, so the seating, and with it each score, depends on the rows and not on the
cluster's settings. Word shards first count the whole vocabulary, which gives the number of words and tokens and the
contexts holding more than 1 / (2 x shards) of the training tokens (at most twice as many as there are shards); these are
split over all shards by word, each part knowing its share of the room, and their totals are summed and sent to all.
Context shards merge the packets, seat the customers, answer each packet entry by entry in its own order, and send their
tables to the word shards, which seat the parent as one restaurant (base 1 / (V + 1) and the total of all tables, of which
each shard holds its share) and answer the word packets. A block recomputes its own order, so answers need no keys, and
scores its documents. Approximations: a context shard takes the parent's first estimate from its own dish counts (it holds
a million tokens), and parent and child are seated once in turn, not again; discounts are estimated shard by shard.
What is exchanged follows the number of distinct pairs by block; nothing that grows with the corpus is collected or
broadcast, and no count is cut off.

Defined results: null and empty texts are one end token; a null identifier is a training document; ``n_known`` counts
tokens (the end too) with a training count; with no training document all probabilities come from the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .words import mix, word_hashes

BLOCK_BYTES, BURN_IN, SAMPLES, STRENGTH = 8 << 20, 2, 3, 1.0
#: Rounds of the estimate that seating starts from; numbers in a matrix of table weights.
START, CELLS = 10, 1 << 20
#: Numbers of tables through which the polynomial of a dish's weights goes.
NODES = 24
#: Customers up to which a dish's table weights come from the recursion; beyond it they come from the contour integral.
RECURSED = 1024
#: Bytes of text for each shard, about a million tokens: a worker holds the pairs of one shard at a time.
SHARD_BYTES = 6 << 20
_END, _BEGIN = np.uint64(0x5EED_0001_E4D0_0001), np.uint64(0x5EED_0002_B361_0002)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_PACKET = "kind string, block bigint, shard int, payload binary"
_COUNTED = _PACKET + ", tokens bigint, texts bigint"
_NAMES = ["kind", "block", "shard", "payload"]
_ZSTD = pa.Codec("zstd")


# --- packets -------------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed at once, as packets may be small; increasing 64-bit arrays should come as differences."""
    sizes = np.array([len(a) for a in arrays], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.ravel() for a in arrays if len(a)]
    return sizes + _ZSTD.compress(np.concatenate(planes), asbytes=True) if planes else sizes


def _unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    head = 8 * len(kinds)
    spans = [(n, np.dtype(kind).itemsize) for n, kind in zip(np.frombuffer(payload[:head], dtype="<i8").tolist(), kinds, strict=True)]
    total = sum(n * width for n, width in spans)
    raw = np.frombuffer(_ZSTD.decompress(payload[head:], decompressed_size=total, asbytes=True) if total else b"", dtype=np.uint8)
    out, at = [], 0
    for (n, width), kind in zip(spans, kinds, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _delta(x: np.ndarray, begins: list[int]) -> np.ndarray:
    """Differences of hashes that increase within packets; the first of each packet is whole."""
    out = x.copy()
    out[1:] -= x[:-1]
    out[begins] = x[begins]
    return out


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by range of the hash, so that sorted hashes are sorted by shard."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by its end, and where each row begins."""
    parts, sizes = [], []
    for _, _, words, first in word_hashes(texts):
        n = np.diff(first)
        out = np.empty(len(words) + len(n), dtype=np.uint64)
        ends = np.cumsum(n + 1) - 1
        rest = np.ones(len(out), dtype=bool)
        rest[ends] = False
        out[ends], out[rest] = _END, words
        parts.append(out)
        sizes.append(n + 1)
    lengths = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths)])


def _new(x: np.ndarray) -> np.ndarray:
    """Whether each of the sorted numbers differs from the one before it."""
    out = np.ones(len(x), dtype=bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_new(x)]


def _factored(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and each number's place among them; only distinct ones are sorted."""
    coded = pa.array(x).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[coded.indices.to_numpy()]


def _ranked(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for 64-bit numbers below 2 ** bits, few of them alike: number and place are sorted as one number where both fit."""
    room = len(x).bit_length()
    if bits + room <= 64:
        value = np.sort(x << np.uint64(room) | np.arange(len(x), dtype=np.uint64))
        order = (value & np.uint64((1 << room) - 1)).astype(np.int64)
        value >>= np.uint64(room)
    else:
        order = np.argsort(x, kind="stable")
        value = x[order]
    new = _new(value)
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return value[new], place


def _codes(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of a block in order (with that of a beginning), each token's place among them, its (word, context) as one number, and the bits of the context in it."""
    known, at = _factored(np.append(tokens, _BEGIN))
    bits = len(known).bit_length()
    before = np.empty(len(tokens), dtype=np.int64)
    before[1:] = at[:-2]
    before[first[:-1]] = at[-1]
    return known, at[:-1], (at[:-1] << bits | before).view(np.uint64), bits


def _pairs(code: np.ndarray, known: np.ndarray, bits: int, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in the order of (shard, word, context): places of contexts and words among the known, shards, and the codes' places before."""
    c, w = (code & np.uint64((1 << bits) - 1)).astype(np.int64), (code >> np.uint64(bits)).astype(np.int64)
    shard = _shard(known, shards)[c]
    split = np.flatnonzero(np.isin(known, hot)[c]) if len(hot) else np.zeros(0, np.int64)
    shard[split] = _shard(mix(known[c[split]] ^ known[w[split]]), shards)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return c[order], w[order], shard[order], order


# --- seating -------------------------------------------------------------------------------------------------------


def _reach(count: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Tables that a dish has no more of but with negligible probability: they are at most one more than a Poisson draw of mean ``fresh``."""
    return np.minimum(count, np.ceil(1 + fresh + 10 * np.sqrt(fresh) + 30)).astype(np.int64)


def _stirling(counts: np.ndarray, widths: np.ndarray, d: float) -> list[np.ndarray]:
    """log S(c, t) / S(c, 1) for t = 1 to width, for each of the increasing counts; S are the generalised Stirling numbers of discount d.

    S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t), kept as ratios of neighbours in t, so that nothing over- or underflows.
    """
    need = np.maximum.accumulate(widths[::-1])[::-1]
    ratio = np.zeros(max(int(need[0]) - 1, 0))  # S(c, t) / S(c, t - 1) for t from 2
    dt = d * np.arange(2, len(ratio) + 2)
    out, c = [], 1
    for target, wide, width in zip(counts.tolist(), need.tolist(), widths.tolist(), strict=True):
        ratio, dt = ratio[: wide - 1].copy(), dt[: wide - 1]
        while c < target:
            m = min(c, len(ratio))  # later ratios are still 0
            if m:
                q = 1 + (c - dt[:m]) * ratio[:m]
                ratio[1:m] = ratio[: m - 1] * q[1:] / q[:-1]
                ratio[0] = q[0] / (c - d)
            c += 1
        out.append(np.concatenate([[0.0], np.cumsum(np.log(ratio[: width - 1]))]))
    return out


def _log_sibuya(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the chance that t Sibuya(d) numbers sum to c, which is S(c, t) t! d ** t / c!, for t from 1 to c.

    It is the coefficient of z ** c in (1 - (1 - z) ** d) ** t. The contour is a parabola s = m (1 + i x) ** 2 around the cut
    of s = 1 - z, through the saddle point or, where that comes too close to the cut, through 4 / c; where nearly all tables
    have one customer, it is a circle. 64 points on each half of it give six places at least.
    """
    log_lo = np.log(4.0 / c)
    log_hi = np.zeros(len(t))
    for _ in range(45):
        mid = (log_lo + log_hi) / 2
        s = np.exp(mid)
        up = (c + 1) / -np.expm1(mid) > t * d * s ** (d - 1) / -np.expm1(d * mid)
        log_lo, log_hi = np.where(up, log_lo, mid), np.where(up, mid, log_hi)
    at = (log_lo + log_hi) / 2
    m = np.exp(at)
    gap, power = -np.expm1(at), -np.expm1(d * at)
    bend = (c + 1) / gap**2 - t * d * ((d - 1) * m ** (d - 2) * power + d * m ** (2 * d - 2)) / power**2
    step = np.minimum(0.15, 0.25 / (m * np.sqrt(np.maximum(bend, 1e-300))))
    x = 1 + 1j * step[:, None] * np.arange(65)
    size = 2 * m * step
    ring = (c - t < 100) & (gap < 0.6)
    z = np.maximum(gap[ring], 1.0 / c[ring])[:, None] * np.exp(1j * np.pi / 64 * np.arange(65))
    s = m[:, None] * x * x
    s[ring], x[ring], size[ring] = 1 - z, z, np.pi / 64
    g = np.log(s)
    g = t[:, None] * np.log(1 - np.exp(d * g)) - (c + 1)[:, None] * np.log(1 - s)
    top = g[:, :1].real
    terms = (x * np.exp(g - top)).real
    return top[:, 0] + np.log(size / np.pi * (terms.sum(axis=1) - terms[:, 0] / 2 - terms[:, -1] / 2))


def _all_likely(c: np.ndarray, fresh: np.ndarray, d: float) -> list[tuple[int, np.ndarray]]:
    """For each dish the lowest likely number of tables, and the weights S(c, t) (d fresh) ** t from there, scaled to 1 at most.

    The weights are log-concave in t, so all numbers left out have less than e ** -36 of the greatest weight and fall further.
    Times (c - t)! / t the chances are smooth in t: they are read off a polynomial through NODES numbers. The numbers of as
    many dishes are computed at once as make some CELLS / 8 points of contours.
    """
    # near the mode: t is about Poisson, tilted to the sum c
    log_lo, log_hi = np.full(len(c), -700.0), np.zeros(len(c))
    for _ in range(60):
        mid = (log_lo + log_hi) / 2
        high = np.log(c) - np.log(-np.expm1(mid)) > np.log(fresh * d) + (d - 1) * mid
        log_lo, log_hi = np.where(high, log_lo, mid), np.where(high, mid, log_hi)
    mode = np.minimum(c, np.maximum(1.0, -fresh * np.expm1(d * log_lo)))
    spread = 10 * mode**0.5 + 30
    lo, hi = np.maximum(1, np.floor(mode - spread)), np.minimum(c, np.floor(mode + spread))
    out: list = [None] * len(c)
    waiting = np.arange(len(c))
    while len(waiting):
        now, waiting = waiting[: CELLS // 512 // NODES], waiting[CELLS // 512 // NODES :]
        mid, half = (lo[now] + hi[now]) / 2, (hi[now] - lo[now]) / 2
        nodes = np.rint(mid[:, None] - half[:, None] * np.cos(np.pi * np.arange(NODES) / (NODES - 1)))
        nodes = [np.unique(x) for x in nodes]
        every, of = np.concatenate(nodes), np.repeat(c[now], [len(x) for x in nodes])
        known = _log_sibuya(of, every, d) - np.log(every)
        again = []
        for i, node, value in zip(now.tolist(), nodes, np.split(known, np.cumsum([len(x) for x in nodes])[:-1]), strict=True):
            t = np.arange(lo[i], hi[i] + 1)
            fall = np.cumsum(np.log(c[i] - t + 1))  # of (c - t)!
            value = value - fall[(node - lo[i]).astype(np.int64)]
            gaps = 4 / max(hi[i] - lo[i], 1) * (node[:, None] - node) + np.eye(len(node))
            part = t[:, None] - node
            part = 1 / (np.where(part == 0, 1e-9, part) * gaps.prod(axis=1))
            log = np.cumsum(np.log(fresh[i] / t)) + np.log(t) + fall + part @ value / part.sum(axis=1)
            log -= log.max()
            low, high = lo[i] > 1 and log[0] > -36, hi[i] < c[i] and log[-1] > -36
            if low or high:
                lo[i], hi[i] = max(1, lo[i] - len(t) * low), min(c[i], hi[i] + len(t) * high)
                again.append(i)
            else:
                out[i] = int(lo[i]), np.exp(log)
        waiting = np.append(waiting, np.array(again, dtype=np.int64))
    return out


def _likely(c: int, fresh: float, d: float) -> tuple[int, np.ndarray]:
    """The same for one dish."""
    return _all_likely(np.array([float(c)]), np.array([fresh]), d)[0]


def seat(room: np.ndarray, count: np.ndarray, parent: np.ndarray, rng: np.random.Generator, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Mean tables of each dish over the samples, and the discount.

    room: restaurant of each dish; count: its customers, 1 at least; share: the part of each restaurant that is here, if not all.
    """
    n = len(count)
    if not n:
        return np.zeros(0), 0.75
    one, two = int((count == 1).sum()), int((count == 2).sum())
    d = float(np.clip(one / (one + 2 * two), 0.3, 0.95)) if one + two else 0.75
    rooms = int(room.max()) + 1
    by_size = np.flatnonzero(count > 1)  # one customer has one table
    by_size = by_size[np.argsort(count[by_size], kind="stable")]
    c, r, p = count[by_size], room[by_size], parent[by_size]
    few = int(np.searchsorted(c, RECURSED, side="right"))
    sizes, first = np.unique(c[:few], return_index=True)
    edges = np.append(first, few)
    alone = np.bincount(room, minlength=rooms) - np.bincount(r, minlength=rooms)
    share = np.ones(rooms) if share is None else share
    t = c.astype(float) ** d  # near the tables to come, so that little has to be burnt in
    for _ in range(START):
        total = (alone + np.bincount(r, weights=t, minlength=rooms)) / share
        t = np.minimum(c, 1 + np.minimum((total + STRENGTH / d)[r] * p, t))
    rows: list[np.ndarray] = []
    widths = np.zeros(len(sizes), dtype=np.int64)
    mean = np.ones(n)
    mean[by_size] = 0
    for sweep in range((BURN_IN + SAMPLES) if len(c) else 0):
        total = (alone + np.bincount(r, weights=t, minlength=rooms)) / share
        # a gamma variable of each room makes its dishes independent: P(t) ~ S(c, t) (d u p) ** t
        fresh = rng.gamma(total + STRENGTH / d)[r] * p
        reach = np.maximum.reduceat(_reach(c[:few], fresh[:few]), first) if few else widths
        if (reach > widths).any():
            widths = np.maximum(widths, np.minimum(sizes, reach + reach // 2))
            rows = _stirling(sizes, widths, d)
        scale = np.log(np.maximum(d * fresh, 1e-300))
        chance = rng.random(len(c))
        t = np.empty(len(c))
        for row, wide, lo, hi in zip(rows, reach.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            steps = np.arange(wide)
            for a in range(lo, hi, max(1, CELLS // wide)):
                b = min(hi, a + max(1, CELLS // wide))
                weights = row[:wide] + scale[a:b, None] * steps
                weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
                t[a:b] = 1 + (weights[:, :-1] <= (chance[a:b] * weights[:, -1])[:, None]).sum(axis=1)
        for i, (low, weights) in enumerate(_all_likely(c[few:].astype(float), np.maximum(fresh[few:], 1e-300), d), few):
            weights = np.cumsum(weights)
            t[i] = low + np.searchsorted(weights[:-1], chance[i] * weights[-1], side="right")
        if sweep >= BURN_IN:
            mean[by_size] += t / SAMPLES
    return mean, d


# --- the four passes -----------------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Yields (block, rows) of a scan partition, cut where a block has BLOCK_BYTES; the same partition gives the same cuts."""
    number, held = 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        base = b.column("row")[0].as_py() >> 33 << 33  # the partition's
        sizes = pa.compute.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(sizes):
            fit = int(np.searchsorted(np.cumsum(sizes[lo:]), BLOCK_BYTES - held, side="right"))
            if not fit and held:
                number, held = number + 1, 0
                continue
            fit = max(fit, 1)
            yield base + number, b.slice(lo, fit)
            held += int(sizes[lo : lo + fit].sum()) + fit
            lo += fit


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds its block to each row."""
    for block, b in _pieces(batches):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, block, np.int64))], [*b.schema.names, "block"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (block, tokens, row beginnings, whether each row is for training); a block's rows follow each other."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now = None

    def joined() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        shift = np.cumsum([0, *(len(t) for t, _, _ in held)])
        first = np.concatenate([*(f[:-1] + s for (_, f, _), s in zip(held, shift[:-1], strict=True)), shift[-1:]])
        return now, np.concatenate([t for t, _, _ in held]), first, np.concatenate([x for _, _, x in held])

    for block, b in _pieces(batches):
        if held and block != now:
            yield joined()
            held = []
        now = block
        held.append((*_tokens(b.column("text")), b.column("train").to_numpy(zero_copy_only=False)))
    if held:
        yield joined()


def _batch(kind: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (shard, payload, further numbers)."""
    more = [pa.array([r[k] for r in rows], pa.int64()) for k in range(2, len(rows[0]))]
    columns = [pa.array([kind] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *more], [*_NAMES, "tokens", "texts"][: 4 + len(more)])


def _cuts(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """Shard, begin and end of each run of the sorted shards."""
    at = np.flatnonzero(_new(shard))
    begins = at.tolist()
    return list(zip(shard[at].tolist(), begins, [*begins[1:], len(shard)], strict=False))


def _begins(cuts: list[tuple[int, int, int]]) -> list[int]:
    return [lo for _, lo, _ in cuts]


def _word_packets(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, tokens, first, train in _blocks(batches):
            words, inverse = _factored(tokens)
            counts = np.bincount(inverse, weights=np.repeat(train, np.diff(first)), minlength=len(words)).astype(np.uint32)
            texts = int(train.sum())
            rows = []
            cuts = _cuts(_shard(words, shards))
            steps = _delta(words, _begins(cuts))
            for s, lo, hi in cuts:
                rows.append((s, _pack(steps[lo:hi], counts[lo:hi]), int(counts[lo:hi].sum()), texts))
                texts = 0  # a block's texts count once
            if rows:
                yield _batch("word", block, rows)

    return run


def _merged(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct words of packets, their training counts, each entry's place among them, and the packets' lengths."""
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for p in payloads:
        w, n = _unpack(p, np.uint64, np.uint32)
        words.append(np.cumsum(w, dtype=np.uint64))
        counts.append(n)
    known, at = _factored(np.concatenate(words))
    return known, np.bincount(at, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64), at, [len(w) for w in words[1:]]


_VOCABULARY = "word bigint, n bigint"


def _count_words(often: int):
    """For each word shard: how many words have a training count (a row without a word), and the words with ``often`` at least."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known, total, _, _ = _merged(table.column("payload").to_pylist())
        many = np.flatnonzero(total >= often)
        words = [None, *known[many].view(np.int64).tolist()]
        return pa.table([pa.array(words, pa.int64()), pa.array([int((total > 0).sum()), *total[many].tolist()], pa.int64())], names=["word", "n"])

    return run


def _pair_packets(shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, tokens, first, train in _blocks(batches):
            known, _, code, bits = _codes(tokens, first)
            code = np.sort(code << np.uint64(1) | np.repeat(train, np.diff(first)))  # the last bit counts training tokens
            begins = np.flatnonzero(_new(code >> np.uint64(1)))
            counts = np.add.reduceat(code & np.uint64(1), begins).astype(np.uint32)
            c, w, shard, order = _pairs(code[begins] >> np.uint64(1), known, bits, hot, shards)
            words, counts = known[w], counts[order]
            held, place = _ranked((shard << bits | c).view(np.uint64), bits + shards.bit_length())  # contexts by shard
            of = (held >> np.uint64(bits)).astype(np.int64)
            contexts = known[(held & np.uint64((1 << bits) - 1)).astype(np.int64)]
            cuts, own = _cuts(shard), _cuts(of)
            contexts, words = _delta(contexts, _begins(own)), _delta(words, _begins(cuts))
            rows = []
            for (s, lo, hi), (_, a, b) in zip(cuts, own, strict=True):
                rows.append((s, _pack(contexts[a:b], (place[lo:hi] - a).astype(np.uint32), words[lo:hi], counts[lo:hi])))
                if len(rows) >= 64:
                    yield _batch("pair", block, rows)
                    rows = []
            if rows:
                yield _batch("pair", block, rows)

    return run


_SEATED = "kind string, block bigint, shard int, payload binary, context bigint, customers double, tables double"


def _seat_contexts(shards: int, hot: np.ndarray, vocabulary: int, seed: int = 7):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        blocks, payloads = table.column("block").to_numpy()[order].tolist(), table.column("payload").take(pa.array(order)).to_pylist()
        lists, heads, parts, counts = [], [], [], []
        for p in payloads:
            contexts, at, w, n = _unpack(p, np.uint64, np.uint32, np.uint64, np.uint32)
            lists.append(np.cumsum(contexts, dtype=np.uint64))
            new = w != 0
            new[:1] = True
            heads.append(np.cumsum(w, dtype=np.uint64)[new])
            parts.append((at, np.cumsum(new) - 1))
            counts.append(n)
        sizes = [len(n) for n in counts]
        rooms, dishes = _distinct(np.concatenate(lists)), _distinct(np.concatenate(heads))
        lists = [np.searchsorted(rooms, x) for x in lists]
        bits = len(rooms).bit_length()
        code = np.concatenate([np.searchsorted(dishes, x)[word] << bits | r[at] for x, r, (at, word) in zip(heads, lists, parts, strict=True)]).view(np.uint64)
        del heads, parts
        found, pair = _ranked(code, bits + len(dishes).bit_length())
        del code
        total = np.bincount(pair, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
        room, dish = (found & np.uint64((1 << bits) - 1)).astype(np.int64), (found >> np.uint64(bits)).astype(np.int64)
        by_dish = np.bincount(dish, weights=total, minlength=len(dishes))
        seen = np.flatnonzero(total > 0)
        seen = seen[np.argsort(mix(rooms[room[seen]] * _PAIR + dishes[dish[seen]]))]  # draws follow the pairs' hashes
        parent = ((by_dish + 0.5) / (by_dish.sum() + 0.5 * (vocabulary + 1)))[dish[seen]]
        tables = np.zeros(len(found))
        taken, own = np.unique(room[seen], return_inverse=True)
        share = np.where(np.isin(rooms[taken], hot), 1.0 / shards, 1.0)  # a hot context's words are spread evenly
        tables[seen], d = seat(own, total[seen], parent, np.random.default_rng([shard, seed]), share)
        customers = np.bincount(room, weights=total, minlength=len(rooms))
        discounted = d * np.bincount(room, weights=tables, minlength=len(rooms))
        numerator = (total - d * tables).astype(np.float32)
        rows: list[tuple] = []
        lo = 0
        for block, r, size in zip(blocks, lists, sizes, strict=True):
            rows.append(("pair", block, shard, _pack(customers[r].astype(np.int64), discounted[r].astype(np.float32), numerator[pair[lo : lo + size]]), None, None, None))
            lo += size
        sent = np.bincount(dish, weights=tables, minlength=len(dishes))
        keep = sent > 0
        dishes, sent = dishes[keep], sent[keep]
        cuts = _cuts(_shard(dishes, shards))
        steps = _delta(dishes, _begins(cuts))
        for s, a, b in cuts:
            rows.append(("tables", -1, s, _pack(steps[a:b], sent[a:b]), None, None, None))
        for k in np.flatnonzero(np.isin(rooms, hot)):
            rows.append(("hot", -1, shard, None, int(rooms[k].astype(np.int64)), float(customers[k]), float(discounted[k])))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_NAMES, "context", "customers", "tables"])

    return run


_ANSWERED = "kind string, block bigint, shard int, payload binary, customers double, tables double"


def _seat_words(vocabulary: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows: list[tuple] = []
        kinds = np.array(table.column("kind").to_pylist())
        blocks, payloads = table.column("block").to_numpy(), table.column("payload").to_pylist()
        asked = sorted((int(blocks[i]), payloads[i]) for i in np.flatnonzero(kinds == "word"))
        known, total, at, sizes = _merged([p for _, p in asked])
        places, tables = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in np.flatnonzero(kinds == "tables"):
            w, t = _unpack(payloads[i], np.uint64, np.float64)
            places.append(np.searchsorted(known, np.cumsum(w, dtype=np.uint64)))
            tables.append(t)
        sent = np.bincount(np.concatenate(places), weights=np.concatenate(tables), minlength=len(known))
        customers = np.where(total > 0, np.maximum(1, np.rint(sent)), 0).astype(np.int64)
        seen = np.flatnonzero(customers > 0)
        tables = np.zeros(len(known))
        base = np.full(len(seen), 1.0 / (vocabulary + 1))
        share = np.array([len(seen) / max(1, vocabulary)])
        tables[seen], d = seat(np.zeros(len(seen), dtype=np.int64), customers[seen], base, np.random.default_rng([shard, 11]), share)
        numerator = (customers - d * tables).astype(np.float32)
        lo = 0
        for (block, _), size in zip(asked, sizes, strict=True):
            own = at[lo : lo + size]
            rows.append(("word", block, shard, _pack(total[own], numerator[own]), None, None))
            lo += size
        rows.append(("stats", -1, shard, None, float(customers.sum()), float(d * tables.sum())))
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*_NAMES, "customers", "tables"])

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(shards: int, hot: np.ndarray, hot_customers: np.ndarray, hot_tables: np.ndarray, stats: tuple):
    vocabulary, trained, all_customers, all_tables = stats

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by([("row", "ascending")])
        tokens, first = _tokens(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
        kinds = answers.column("kind").to_pylist()
        got = sorted(zip(kinds, answers.column("shard").to_pylist(), answers.column("payload").to_pylist(), strict=True), key=lambda x: x[:2])
        known, at, code, bits = _codes(tokens, first)
        own = np.zeros(len(known), dtype=bool)
        own[at] = True  # the beginning is no word
        parts = [_unpack(p, np.int64, np.float32) for kind, _, p in got if kind == "word"]
        found, place = _ranked(code, 2 * bits)
        c, w, shard, order = _pairs(found, known, bits, hot, shards)
        top, room_c, room_t = [], [], []
        for kind, _, p in got:
            if kind == "pair":
                customers, tables, above = _unpack(p, np.int64, np.float32, np.float32)
                top.append(above)
                room_c.append(customers)
                room_t.append(tables)
        above = np.concatenate(top)
        if sum(len(p[0]) for p in parts) != own.sum() or len(above) != len(found):
            raise ValueError("a block's rows differ between two scans of the same table")
        count, alone, customers, tables = (np.zeros(len(known)) for _ in range(4))
        count[own] = np.concatenate([p[0] for p in parts])
        alone[own] = (np.concatenate([p[1] for p in parts]) + (STRENGTH + all_tables) / (vocabulary + 1)) / (STRENGTH + all_customers)
        held = _distinct((shard << bits | c).view(np.uint64)) & np.uint64((1 << bits) - 1)  # contexts by shard
        customers[held.astype(np.int64)], tables[held.astype(np.int64)] = np.concatenate(room_c), np.concatenate(room_t)
        if len(hot):
            is_hot = np.isin(known, hot)
            k = np.searchsorted(hot, known[is_hot])
            customers[is_hot], tables[is_hot] = hot_customers[k], hot_tables[k]
        pair = np.empty(len(found))
        pair[order] = (above + (STRENGTH + tables[c]) * alone[w]) / (STRENGTH + customers[c])
        begins = first[:-1]
        logs = np.add.reduceat(np.log10(pair)[place], begins)
        base = np.add.reduceat(np.log10((count + 1.0) / (trained + vocabulary + 1.0))[at], begins)
        trained_on = np.add.reduceat((count > 0)[at].astype(np.int64), begins)
        n = docs.num_rows
        return pa.table([docs.column("doc_id"), pa.array(~docs.column("train").to_numpy(zero_copy_only=False)), pa.array(np.diff(first)), pa.array(trained_on), pa.array(np.full(n, trained, np.int64)), pa.array(base), pa.array(logs)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all documents with a model of those that are not held out (held_out: a boolean column of docs)."""
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.monotonically_increasing_id().alias("row")
    )
    scanned = own.select("text", "train", "row")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    asked = written(scanned.mapInArrow(_word_packets(shards), _COUNTED), "words")
    tokens, texts = (x or 0 for x in asked.agg(F.sum("tokens"), F.sum("texts")).first())
    # contexts with 1 / (2 x shards) of the tokens: at most 2 x shards rows, and one row a shard
    often = max(2, -(-tokens // (2 * shards)))
    counted = asked.select(*_NAMES).groupBy("shard").applyInArrow(_count_words(often), _VOCABULARY).groupBy("word").agg(F.sum("n").alias("n")).collect()
    vocabulary = sum(r.n for r in counted if r.word is None)
    end, begin = (int(x.astype(np.int64)) for x in (_END, _BEGIN))
    frequent = [r.word for r in counted if r.word is not None and r.word != end] + [begin] * (texts >= often)
    hot = np.sort(np.array(frequent, dtype=np.int64).view(np.uint64))
    pairs = scanned.mapInArrow(_pair_packets(shards, hot), _PACKET)
    seated = written(pairs.groupBy("shard").applyInArrow(_seat_contexts(shards, hot, vocabulary), _SEATED), "contexts")
    sums = {r.context: (r.c, r.t) for r in seated.filter("kind = 'hot'").groupBy("context").agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).collect()}  # at most 2 x shards
    hot_sums = [sums.get(int(h), (0.0, 0.0)) for h in hot.view(np.int64)]
    both = asked.select(*_NAMES).unionByName(seated.filter("kind = 'tables'").select(*_NAMES))
    answered = written(both.groupBy("shard").applyInArrow(_seat_words(vocabulary), _ANSWERED), "answers")
    discard(asked)
    parent = answered.filter("kind = 'stats'").agg(F.sum("customers"), F.sum("tables")).first()
    stats = (vocabulary, tokens, *(x or 0.0 for x in parent))
    answers = answered.filter("kind = 'word'").select(*_NAMES).unionByName(seated.filter("kind = 'pair'").select(*_NAMES))
    run = _score(shards, hot, np.array([s[0] for s in hot_sums]), np.array([s[1] for s in hot_sums]), stats)
    placed = own.mapInArrow(_numbered, "doc_id bigint, text string, train boolean, row bigint, block bigint")
    out = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORES)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
