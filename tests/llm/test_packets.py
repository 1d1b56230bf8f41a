"""Packets that a block sends: what is in them, and that tokens are not put in order by several keys."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitelens.llm import pitman_yor


def _rows(texts, train):
    return pa.record_batch([pa.array(texts, pa.string()), pa.array(train), pa.array(range(len(texts)), pa.int64())], names=["text", "train", "row"])


@pytest.mark.parametrize("shards", [1, 7, 70_000])
@pytest.mark.parametrize("split", [False, True])
def test_packets_hold_every_pair(monkeypatch, shards, split):
    monkeypatch.setattr(np, "lexsort", lambda *a, **k: pytest.fail("tokens sorted by several keys"))
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], n)) for n in rng.integers(0, 30, 60)] + ["", None]
    train = [i % 3 > 0 for i in range(len(texts))]
    batch = _rows(texts, train)
    tokens, first = pitman_yor._tokens(batch.column("text"))
    want, seen = Counter(), set()
    for lo, hi, t in zip(first[:-1].tolist(), first[1:].tolist(), train, strict=True):
        before = pitman_yor._BEGIN
        for w in tokens[lo:hi]:
            seen.add((int(before), int(w)))
            want[int(before), int(w)] += t
            before = w
    hot = np.sort(np.array([tokens[0], pitman_yor._BEGIN], dtype=np.uint64)) if split else np.zeros(0, np.uint64)
    got, last = {}, -1
    for out in pitman_yor._pair_packets(shards, hot)(iter([batch])):
        for shard, payload in zip(out.column("shard").to_pylist(), out.column("payload").to_pylist(), strict=True):
            assert shard > last
            last = shard
            contexts, at, words, counts = pitman_yor._unpack(payload, np.uint64, np.uint32, np.uint64, np.uint32)
            contexts, words = np.cumsum(contexts, dtype=np.uint64), np.cumsum(words, dtype=np.uint64)
            assert (np.diff(words.astype(object)) >= 0).all() and len(set(contexts.tolist())) == len(contexts) == at.max() + 1
            for c, w, n in zip(contexts[at], words, counts.tolist(), strict=True):
                assert (int(c), int(w)) not in got
                got[int(c), int(w)] = n
                key = pitman_yor.mix(np.array([c ^ w])) if c in hot else np.array([c])
                assert pitman_yor._shard(key, shards)[0] == shard
    assert got.keys() == seen and all(got[k] == want[k] for k in seen)


def test_ranks_match_unique():
    rng = np.random.default_rng(4)
    for top, bits in ((50, 6), (1 << 40, 40), (1 << 62, 62)):
        for n in (0, 1, 2, 5000):
            x = rng.integers(0, top, n).astype(np.uint64)
            for got in (pitman_yor._ranked(x, bits), pitman_yor._factored(x)):
                for a, b in zip(got, np.unique(x, return_inverse=True), strict=True):
                    assert (a == b).all()


def test_a_packet_is_compressed_at_once(monkeypatch):
    frames = []

    class Counted:
        def __init__(self, codec):
            self.codec = codec

        def compress(self, *a, **k):
            frames.append(1)
            return self.codec.compress(*a, **k)

        def decompress(self, *a, **k):
            return self.codec.decompress(*a, **k)

    monkeypatch.setattr(pitman_yor, "_ZSTD", Counted(pitman_yor._ZSTD))
    kinds = (np.uint64, np.uint32, np.float64)
    for sizes in ((0, 0, 0), (3, 0, 5), (1, 1, 1), (70_000, 9, 300)):
        arrays = [np.arange(7, 7 + n).astype(kind) for n, kind in zip(sizes, kinds, strict=True)]
        frames.clear()
        for a, b in zip(arrays, pitman_yor._unpack(pitman_yor._pack(*arrays), *kinds), strict=True):
            assert a.dtype == b.dtype and (a == b).all()
        assert len(frames) == any(sizes)


def test_differences_begin_anew_in_each_packet():
    x = np.array([5, 9, 9, 2, 4, 1 << 63], dtype=np.uint64)
    got = pitman_yor._delta(x, [0, 3])
    assert (np.cumsum(got[:3], dtype=np.uint64) == x[:3]).all() and (np.cumsum(got[3:], dtype=np.uint64) == x[3:]).all()
    empty = np.zeros(0, np.uint64)
    assert pitman_yor._cuts(np.zeros(0, np.int64)) == [] and len(pitman_yor._delta(empty, [])) == 0
