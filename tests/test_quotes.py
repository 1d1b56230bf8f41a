"""The containment join against Python's own test, for quotes of all lengths."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.functions.rolling import windows
from sitelens.operators import quotes


def found(spark, texts, said, **more):
    t = spark.createDataFrame(texts, "id bigint, text string, site string")
    q = spark.createDataFrame(said, "qid bigint, quote string, site string")
    return sorted(tuple(r) for r in quotes.contained(t, q, "id", "qid", **more).collect())


def test_any_texts_and_quotes(spark):
    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.text("abÄ \n", max_size=40), max_size=8), st.lists(st.text("abÄ \n", max_size=6), max_size=6))
    def run(texts, said):
        got = found(spark, [(i, t, "s") for i, t in enumerate(texts)], [(i, q, "s") for i, q in enumerate(said)])
        assert got == sorted((j, i) for i, t in enumerate(texts) for j, q in enumerate(said) if q and q.lower() in t.lower())

    run()


def test_long_quotes_that_share_an_opening(spark):
    opening = "the quick brown fox jumps over the lazy dog and runs "
    texts = [(1, f"X {opening}home. {opening}away!", "a"), (2, opening.upper() + "HOME", "a"), (3, "a" * 100_000 + opening, "b"), (4, None, "a"), (5, "", "a"), (1, f"X {opening}home.", "a")]
    said = [(1, opening + "home", "a"), (2, opening + "away", "b"), (3, opening, "a"), (3, opening, "b"), (4, None, "a"), (5, "", "a"), (6, "dog", "a"), (7, "aaa", "b")]
    assert found(spark, texts, said) == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3), (6, 1), (6, 2), (6, 3), (7, 3)]
    assert found(spark, texts, said, group="site") == [(1, 1, "a"), (1, 2, "a"), (3, 1, "a"), (3, 2, "a"), (3, 3, "b"), (6, 1, "a"), (6, 2, "a"), (7, 3, "b")]
    assert found(spark, [], said) == [] and found(spark, texts, []) == []


@pytest.mark.parametrize(("bits", "chunk"), [(1 << 15, 4 << 20), (1 << 23, 10)])
def test_a_full_map_and_small_chunks_lose_nothing(spark, monkeypatch, bits, chunk):
    monkeypatch.setattr(quotes, "BITS", bits)
    monkeypatch.setattr(quotes, "CHUNK", chunk)
    texts = [(i, f"passage {i} of many, quoted at length by {i * 7919}", "s") for i in range(300)]
    said = [(i, f"{i} of many, quoted", "s") for i in range(300)]
    assert found(spark, texts, said) == sorted((j, i) for i, t, _ in texts for j, q, _ in said if q in t)


def _found(texts, said, chunk, monkeypatch):
    monkeypatch.setattr(quotes, "CHUNK", chunk)
    bits = np.zeros(quotes.BITS // 8, np.uint8)
    sizes = {k: quotes._opening(len(k)) for k in said}
    for k, n in sizes.items():
        place = int(windows(np.frombuffer(k[:n], np.uint8), [n])[n][0]) & (quotes.BITS - 1)
        bits[place >> 3] |= np.uint8(1 << (place & 7))
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([""] * len(texts)), pa.array(texts, pa.binary())], ["text_id", "text_group", "text"])
    out = quotes._places(bits.tobytes(), sorted(set(sizes.values())), max(map(len, said)))(iter([b]))
    return {(i, k) for o in out for i, tail in zip(o.column("text_id").to_pylist(), o.column("tail").to_pylist(), strict=True) for k in said if tail.startswith(k)}


def test_long_texts_are_read_in_pieces(monkeypatch):
    """A quote across the end of a piece is found, and what is held at once does not follow the text."""
    text = b"".join(b"%07d " % i for i in range(40))
    said = [text[a : a + n] for a in range(0, 280, 7) for n in (5, 20, 40)]
    want = {(i, k) for i, t in enumerate([text, b"", text[100:]]) for k in said if k in t}
    assert _found([text, b"", text[100:], None], said, 50, monkeypatch) == want
    monkeypatch.undo()
    tracemalloc.start()
    assert _found([b"lorem ipsum " * (1 << 20) + b"dolor"], [b"dolor"], quotes.CHUNK, monkeypatch) == {(0, b"dolor")}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # the text is 12 MB
