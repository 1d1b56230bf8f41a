"""Where quotes occur in texts: a containment join by rolling fingerprints.

A quote is looked for by its opening of the largest power of two bytes that it has, at most WINDOW. All windows of these
few lengths are fingerprinted where a text is scanned; a map of a fixed number of bits, set by the quotes' fingerprints,
passes those that may begin a quote, and each sends its fingerprint with the bytes that follow. Joined to the quotes by
fingerprint, they are verified byte by byte. So a text is never exchanged, and never repeated for its words.

Scale: what moves is one short row for each text and possible place, once for equal openings within a text; the map is
BITS / 8 bytes, however many quotes there are (a fuller map passes more, and loses none). A quote that is in a third of all
texts gives a row for each of them, which an equi-join may split. Defined results: null and empty quotes are found
nowhere, null texts hold nothing; a quote found several times in a text counts once; quotes and texts without a group
have the same one; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rolling import windows
from ..sources.settled import settled
from ..sources.tables import read

#: Longest window in bytes, bits of the map, bytes of text that are fingerprinted at once.
WINDOW, BITS, CHUNK = 32, 1 << 23, 256 << 10
#: Characters of a quote that must be found.
OPENING = 40


def _opening(n: int) -> int:
    return min(WINDOW, 1 << (n.bit_length() - 1))


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quote, key) with the fingerprint of its opening and that opening's length."""
    for b in batches:
        marks, lengths = [], []
        for k in b.column("key").to_pylist():
            n = _opening(len(k))
            marks.append(int(windows(np.frombuffer(k[:n], dtype=np.uint8), [n])[n][0].view(np.int64)))
            lengths.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.int64()), pa.array(lengths, pa.int32())], [*b.schema.names, "mark", "window"])


def _map_of(quotes: DataFrame) -> tuple[bytes, list[int]]:
    """The map of the quotes' fingerprints, BITS / 8 bytes, and the lengths of openings there are, six at most."""
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    place = F.pmod(F.col("mark"), F.lit(BITS))
    rows = quotes.groupBy(F.shiftright(place, 15).cast("int").alias("row")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"), F.collect_set("window").alias("windows"))
    found: set[int] = set()
    for r in rows.collect():
        bits[r.row * 4096 : (r.row + 1) * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        found.update(r.windows)
    return bits.tobytes(), sorted(found)


def _places(bitmap: bytes, lengths: list[int], longest: int):
    """Openings in texts that the map passes, with up to ``longest`` bytes from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, dtype=np.uint8)

        def of(rows: list[int], b: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])  # of texts, or of pieces that overlap by the longest quote
            whole = b"".join(texts)
            out: dict[tuple, None] = {}
            for n, marks in windows(np.frombuffer(whole, dtype=np.uint8), lengths).items():
                place = marks & np.uint64(BITS - 1)
                hits = np.flatnonzero(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                owner = np.searchsorted(ends, hits, side="right")
                for at, o in zip(hits[hits + n <= ends[owner]].tolist(), owner[hits + n <= ends[owner]].tolist(), strict=True):
                    out[rows[o], int(marks[at].view(np.int64)), whole[at : min(at + longest, int(ends[o]))]] = None
            at, marks, tails = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(at, pa.int64())) for c in ("text_id", "text_group")], pa.array(marks, pa.int64()), pa.array(tails, pa.binary())], ["text_id", "text_group", "mark", "tail"])

        for b in batches:
            rows, texts, held = [], [], 0
            for i in range(b.num_rows):
                t = b.column("text")[i].as_py()
                for at in range(0, len(t or b""), CHUNK):
                    rows.append(i)
                    texts.append(t[at : at + CHUNK + longest])
                    held += len(texts[-1])
                    if held > CHUNK:
                        yield of(rows, b, texts)
                        rows, texts, held = [], [], 0
            if texts:
                yield of(rows, b, texts)

    return run


def contained(texts: DataFrame, quotes: DataFrame, text_id: str, quote_id: str, text: str = "text", quote: str = "quote", group: str | None = None) -> DataFrame:
    """(quote_id, text_id), each once: texts that hold a quote whole, in any case; with group, also the group, and within it only.

    Identifiers are bigint. Only the named columns are read.
    """
    same = (lambda df: F.col(group).cast("string")) if group else (lambda df: F.lit(""))
    keyed = quotes.select(F.col(quote_id).alias("quote_id"), same(quotes).alias("quote_group"), F.encode(F.lower(quote), "UTF-8").alias("key")).filter(F.octet_length("key") > 0).distinct()
    kept = settled(keyed.mapInArrow(_fingerprinted, "quote_id bigint, quote_group string, key binary, mark bigint, window int"))
    bitmap, lengths = _map_of(kept)
    longest = kept.agg(F.max(F.octet_length("key"))).first()[0] or 0
    rows = texts.select(F.col(text_id).alias("text_id"), same(texts).alias("text_group"), F.encode(F.lower(text), "UTF-8").alias("text"))
    places = rows.mapInArrow(_places(bitmap, lengths, longest), "text_id bigint, text_group string, mark bigint, tail binary")
    found = places.join(kept, (places.mark == kept.mark) & (places.text_group == kept.quote_group)).filter(F.expr("substring(tail, 1, octet_length(key)) = key"))
    names = [F.col("quote_id").alias(quote_id), F.col("text_id").alias(text_id), *([F.col("text_group").alias(group)] if group else [])]
    return found.select(*names).distinct()


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose first 40 characters occur in a document, with the documents counted."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, OPENING).alias("quote"))
    return contained(read(spark, sf_dir, "documents"), items, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("docs"))


QUERIES = {"evidence": evidence}
