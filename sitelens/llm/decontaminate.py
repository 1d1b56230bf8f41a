"""Benchmark decontamination by template canonicalisation.

Words are runs of ASCII letters, digits and non-ASCII bytes. A run of numbers becomes the slot <number>, a unit after a
number <unit>, a run of capitalised words inside a sentence <name>; other words are lower-cased. Windows of WINDOW
template words of documents and items are joined by hash; windows with fewer than MIN_PLAIN plain words are hashed by
their slots' own values instead, so they match verbatim. A pair counts if the matching windows of the item cover at
least COVER of its template words, or RUN of them in a row, and its slots are consistent: along the matched alignment one item value of a slot
type always stands for one document value and the other way round. So a question that was given other numbers or names
is found, and a chance likeness with clashing slots is not.

Scale: the benchmark's template index is sent to the executors only while its texts' bytes are under SMALL_BYTES, a
size that is measured first; beyond it the windows of both sides meet in a shuffled hash join, candidates are verified
in the same way. Documents are read once, whole, and nothing is collected.
Defined results: null and empty texts match nothing; items with fewer than WINDOW template words match by a window of
their own length, those of fewer than MIN_PLAIN only if all are plain words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, without, written
from .words import chunks, hashes, mix, spans

WINDOW, MIN_PLAIN, COVER, RUN, SMALL_BYTES = 8, 4, 0.5, 13, 8 << 20
#: Units of measure.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms kilometre kilometres kilometer kilometers metre metres meter meters ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl l litre litres liter liters gallon gallons pint pints cup cups s sec second seconds min minute minutes h hour hours day days week weeks month months year years kmh mph hz khz mhz ghz w kw mw v volt volts amp amps "
    "j kj cal kcal pa kpa c f k celsius fahrenheit kelvin percent degree degrees usd eur gbp dollar dollars euro euros cent cents kb mb gb tb bit bits byte bytes"
).split()

_GAP = np.ones(256, dtype=bool)
_GAP[0x30:0x3A] = _GAP[0x41:0x5B] = _GAP[0x61:0x7B] = False
_GAP[0x80:] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;\n\"|"]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0xA5A5_0001, 0xA5A5_0002, 0xA5A5_0003))
_VERBATIM = np.uint64(0xA5A5_0004_7C15_9E37)
_FACTORS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(raw)]), _GAP)
    return np.sort(hashes(data, starts, ends))


_UNITS = _unit_hashes()


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of a chunk: hashes, whether each is a slot, starts, ends, first of each document, hashes of the values."""
    starts, ends, first = spans(data, offsets, _GAP)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, bool), starts, ends, first, np.zeros(0, np.uint64)
    h = hashes(data, starts, ends)
    head = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    previous = np.concatenate([[0], ends[:-1]])
    opens = stops[starts] > stops[previous]
    opens[first[:-1][first[:-1] < len(starts)]] = True
    opening_doc = np.zeros(len(starts), dtype=bool)
    opening_doc[first[:-1][first[:-1] < len(starts)]] = True
    number = (head >= 0x30) & (head <= 0x39)
    capital = (head >= 0x41) & (head <= 0x5A) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    name = capital & ~opens
    at = np.minimum(np.searchsorted(_UNITS, h), len(_UNITS) - 1)
    after_number = np.concatenate([[False], number[:-1]]) & ~opening_doc
    unit = (_UNITS[at] == h) & after_number & ~number
    name &= ~unit
    kind = number * 1 + name * 2 + unit * 3
    again = np.concatenate([[False], (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 2))]) & ~opening_doc
    value = h
    h = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, h)))
    keep = np.flatnonzero(~again)
    last = np.concatenate([keep[1:], [len(starts)]]) - 1
    # a slot's words in their order
    place = np.arange(len(value)) - np.repeat(keep, last - keep + 1)
    value = np.add.reduceat(value * _FACTORS[place % len(_FACTORS)], keep)
    return h[keep], kind[keep] > 0, starts[keep], ends[last], np.searchsorted(keep, first, side="left"), value


def windows(h: np.ndarray, slot: np.ndarray, first: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-word windows within one document; by values where a window holds few plain words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        total += h[k : k + m] * _FACTORS[k]
    plain = np.concatenate([[0], np.cumsum(~slot)])
    doc = np.searchsorted(first, np.arange(len(h)), side="right")
    within = doc[:m] == doc[n - 1 : n - 1 + m]
    few = np.flatnonzero(within & (plain[n : n + m] - plain[:m] < min(MIN_PLAIN, n)))
    total[few] = _VERBATIM
    for k in range(n):
        total[few] += value[few + k] * _FACTORS[k]
    if n < MIN_PLAIN:  # one to three words, a slot among them: any text may hold them by chance
        within[few] = False
    at = np.flatnonzero(within)
    return at, mix(total[at] + np.uint64(n))


class Index:
    """The items' templates and their windows by hash."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids, self.items = ids, []
        found: list[tuple[int, int, int, int]] = []
        for k, text in enumerate(texts):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            h, slot, starts, ends, first, value = templates(data, np.array([0, len(data)]))
            n = min(WINDOW, len(h))
            self.items.append((len(h), n, slot, [bytes(data[a:b]).lower() for a, b in zip(starts, ends, strict=True)], h))
            if n:
                found += [(int(w), k, int(p), n) for p, w in zip(*windows(h, slot, np.array([0, len(h)]), value, n), strict=True)]
        found.sort()
        self.keys = np.array([f[0] for f in found], dtype=np.uint64)
        self.places = found
        self.lengths = sorted({f[3] for f in found})

    def match(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """Yields (document, item, covered words, words of the item, slots, whether all slots are equal) of a chunk."""
        if not len(self.keys):
            return
        h, slot, starts, ends, first, value = templates(data, offsets)
        hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n in self.lengths:
            at, w = windows(h, slot, first, value, n)
            lo = np.searchsorted(self.keys, w, side="left")
            hi = np.searchsorted(self.keys, w, side="right")
            for i in np.flatnonzero(hi > lo):
                doc = int(np.searchsorted(first, at[i], side="right")) - 1
                for _, item, p, m in self.places[lo[i] : hi[i]]:
                    if m == n:
                        hits[doc, item].append((int(at[i]), p))
        for (doc, item), places in sorted(hits.items()):
            size, n, islot, values, ih = self.items[item]
            runs: dict[int, set[int]] = defaultdict(set)
            for at, p in places:
                runs[at - p].update(range(p, p + n))
            best = (0, 0, True)
            long = (0, 0, True)  # the best of the copied passages
            # alignments that differ by few words are one edited copy; each chain of them is judged as a whole
            chain: list[int] = []
            for shift in [*sorted(runs), None]:
                if chain and (shift is None or shift - chain[-1] > size):
                    best = max(best, self._judge(chain, runs, islot, values, data, starts, ends))
                    for s in chain:
                        for passage in self._passages(runs[s]):
                            long = max(long, self._judge([s], {s: passage}, islot, values, data, starts, ends))
                    chain = []
                if shift is not None:
                    chain.append(shift)
            if best[0] < COVER * size:
                best = long
            if best[0] >= min(COVER * size, RUN):
                yield doc, item, best[0], size, best[1], best[2]

    @staticmethod
    def _passages(covered: set[int]) -> Iterator[set[int]]:
        """The runs of at least RUN words in a row."""
        places = sorted(covered)
        begin = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] != places[k - 1] + 1:
                if k - begin >= RUN:
                    yield set(places[begin:k])
                begin = k

    @staticmethod
    def _judge(chain: list[int], runs: dict[int, set[int]], islot: np.ndarray, values: list[bytes], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bool]:
        covered, slots, equal = set(), 0, True
        there: dict[bytes, bytes] = {}
        back: dict[bytes, bytes] = {}
        for shift in sorted(chain, key=lambda s: -len(runs[s])):
            for p in sorted(runs[shift] - covered):
                covered.add(p)
                if islot[p]:
                    q = p + shift
                    value = bytes(data[starts[q] : ends[q]]).lower()
                    slots += 1
                    equal &= value == values[p]
                    if there.setdefault(values[p], value) != value or back.setdefault(value, values[p]) != values[p]:
                        return 0, 0, False
        return len(covered), slots, equal


_OUT = "doc_id bigint, item_id bigint, covered bigint, item_words bigint, slots bigint, exact boolean"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(6)], ["doc_id", "item_id", "covered", "item_words", "slots", "exact"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row for each pair of document and item that matches: doc_id, item_id, covered, item_words, slots, exact."""
    items = _items(benchmark, item_col, item_text)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    index = _small(items, small_bytes)
    if index is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idx = Index(*index.value)
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                found = [(ids[lo + d], idx.ids[i], *rest) for lo, _, data, offsets in chunks(b.column("text")) for d, i, *rest in idx.match(data, offsets)]
                yield _rows(found)

        return own.mapInArrow(run, _OUT)
    return _joined(own, items)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The rows of docs that hold no item, all columns. With a small benchmark no row is exchanged."""
    items = _items(benchmark, item_col, item_text)
    index = _small(items, small_bytes)
    if index is None:
        key = F.xxhash64(F.lit(3), F.coalesce(F.col(text_col), F.lit("")))
        found = written(_joined(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), items).select(F.col("doc_id").alias("id")).distinct(), "found")
        return without(docs.withColumn("_text_key", key), "_text_key", found).drop("_text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = Index(*index.value)
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for lo, _, data, offsets in chunks(b.column(text_col)):
                keep[[lo + d for d, *_ in idx.match(data, offsets)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("item_text"))


def _small(items: DataFrame, small_bytes: int):
    """The items as a broadcast, if their texts have at most small_bytes; None beyond that."""
    size = items.agg(F.sum(F.octet_length("item_text") + 8)).first()[0] or 0
    if size > small_bytes:
        return None
    rows = items.orderBy("item_id", "item_text").collect()  # under small_bytes
    return items.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.item_text for r in rows]))


def _joined(own: DataFrame, items: DataFrame) -> DataFrame:
    """Matches by a shuffled join of windows; a row stands for all rows of its identifier and text, null identifiers too."""
    own = own.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    doc_windows = _windows(own, "_key", "text").select("_key", "w")
    lengths = [r[0] for r in _windows(items, "item_id", "item_text").select("n").distinct().collect()]  # at most WINDOW numbers
    item_windows = _windows(items, "item_id", "item_text").select("item_id", "w").distinct()
    short = [n for n in lengths if n < WINDOW]
    if short:
        doc_windows = doc_windows.unionByName(_windows(own, "_key", "text", short).select("_key", "w"))
    # only windows that some item may hold are exchanged, each once a document: a hot window meets its items' few rows
    held = maybe_in(doc_windows, "w", item_windows.select(F.col("w").alias("id"))).filter("_maybe").select("_key", "w").distinct()
    pairs = written(held.join(item_windows, "w").select("_key", "item_id").distinct(), "candidates")
    wanted = maybe_in(own, "_key", pairs.select(F.col("_key").alias("id"))).filter("_maybe").drop("_maybe")
    candidates = pairs.join(wanted, "_key").join(items, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, text, item, item_text_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item_text")), strict=True):
                data = np.frombuffer((text or "").encode(), dtype=np.uint8)
                found += [(doc, item, *rest) for _, _, *rest in Index([item], [item_text_]).match(data, np.array([0, len(data)]))]
            yield _rows(found)

    return candidates.select("doc_id", "text", "item_id", "item_text").mapInArrow(verify, _OUT)


def _windows(df: DataFrame, id_col: str, text_col: str, lengths: list[int] | None = None) -> DataFrame:
    """(id, window hash w, window length n); without lengths a short text has one window of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(id_col)
            for lo, hi, data, offsets in chunks(b.column(text_col)):
                h, slot, _, _, first, value = templates(data, offsets)
                sizes = np.diff(first)
                for n in lengths or sorted({WINDOW, *(int(x) for x in sizes if 0 < x < WINDOW)}):
                    at, w = windows(h, slot, first, value, n)
                    doc = np.searchsorted(first, at, side="right") - 1
                    keep = np.ones(len(at), bool) if lengths else sizes[doc] >= WINDOW if n == WINDOW else sizes[doc] == n
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(doc[keep])), pa.array(w[keep].view(np.int64)), pa.array(np.full(int(keep.sum()), n))], [id_col, "w", "n"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} bigint, w bigint, n bigint")
