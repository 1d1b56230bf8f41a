"""Byte-pair encoding by a deterministic tokenisation automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with a loop for every byte. Merges are applied in rank order, each by
a gadget: for a merge (u, v), each path s -u-> q -v-> t has its first arc redirected to a copy of q that lacks the v arc,
and s gets an arc labelled uv to t. Every state accepts. After the last merge the accepted label strings are exactly the
correct tokenisations, and each byte string has one.

All arcs with one label enter one state, so a gadget moves one entry of ``enters``: the copy q' keeps what q had lost by
then and loses v as well; q itself stays for the labels that still enter it. A state stores only what its own gadgets
took away and the state that it was copied from. What arcs a state has follows: a label made from u is an arc of s if u
was one when the label was made. Labels are numbered in preorder of the tree "made from its left part", children by
rank, so what a state lacks is a few runs of numbers; ``runs`` holds the run boundaries of a state, and a transition is
one binary search in them. States that no text has visited are not expanded.

Encoding steps through a pre-split word once: each prefix has exactly one accepted path, so each place in the word has
one state. A place's state is found from the labels that end there (an Aho-Corasick scan of the bytes yields them): the
only one whose arc leaves the state at its own beginning. There is no backtracking; time and memory grow with the length
of the word. Decoding emits the arcs' labels.

Defined results: null and empty texts have no tokens; the added special token's string in a text is one token, as
the library does; bytes that are no UTF-8 after decoding become U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .parts import Parts, joined

#: The pattern by which byte-level BPE splits a text into words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_EVER = 1 << 60
#: Bytes of encoded parts that a worker keeps in each of two generations.
KEPT_BYTES = 32 << 20
_INT32 = [struct.Struct(f"<{n}i").pack for n in range(32)]


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: bytes that print stand for themselves, the others follow from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenisation automaton of a merge list. State 0 is the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        letters = byte_letters()
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in special and all(c in letters for c in s)}
        self.labels |= {i: s.encode() for s, i in special.items()}
        self.special = special
        bytes_ = [vocab[c] for c in letters if c in vocab]
        self.enters = dict.fromkeys(bytes_, 0)
        self.made: dict[int, tuple[int, int]] = {}  # label: its left part and the merge's rank
        self.lost: list[dict[int, int]] = [{}]  # state: arcs that its own gadgets took, and when
        self.origin: list[tuple[int, int]] = [(-1, 0)]  # state: what it was copied from, and when
        self.users = [len(bytes_) + 1]  # labels that enter a state; the start is one more
        for rank, (u, v) in enumerate(merges):
            if u in vocab and v in vocab and u + v in vocab:
                self.gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.sizes = {i: len(b) for i, b in self.labels.items()}
        self._number(bytes_)
        self._runs: dict[int, list[int]] = {}
        self.scan = ahocorasick.Automaton()
        for y, q in self.enters.items():
            self.scan.add_word(self.labels[y].decode("latin-1"), (len(self.labels[y]), self.number[y], q, y))
        self.scan.make_automaton()
        del self.enters, self.made, self.users  # what only the construction needs

    def _taken(self, state: int, label: int) -> int | None:
        """When an arc was taken from a state or from what it was copied from; None if never."""
        before = _EVER
        while state >= 0:
            rank = self.lost[state].get(label)
            if rank is not None and rank < before:
                return rank
            state, before = self.origin[state][0], min(before, self.origin[state][1])
        return None

    def has_arc(self, state: int, label: int) -> bool:
        """Whether a state has an arc, read off the gadgets applied so far."""
        until = _EVER
        while True:
            rank = self._taken(state, label)
            if rank is not None and rank <= until:
                return False
            if label not in self.made:
                return True
            label, until = self.made[label]

    def gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        """Applies one merge; it changes nothing where the state that u enters has no v arc."""
        q, t = self.enters.get(u), self.enters.get(v)
        if q is None or t is None or not self.has_arc(q, v):
            return
        if uv not in self.enters:
            self.enters[uv] = t
            self.users[t] += 1
            self.made[uv] = (u, rank)
        if self.users[q] > 1:
            self.users[q] -= 1
            self.enters[u] = len(self.lost)
            self.lost.append({v: rank})
            self.origin.append((q, rank))
            self.users.append(1)
        else:
            self.lost[q][v] = rank

    def _number(self, roots: list[int]) -> None:
        """Preorder numbers of the labels, children by rank, and where each label's descendants end."""
        self.children: dict[int, list[tuple[int, int]]] = {}
        for y, (left, rank) in self.made.items():
            self.children.setdefault(left, []).append((rank, y))
        self.number = array("i", bytes(4 * (max(self.labels, default=0) + 1)))
        self.last = array("i", self.number)
        count = 0
        todo = [(y, False) for y in reversed(roots)]
        while todo:
            y, left = todo.pop()
            if left:
                self.last[y] = count
                continue
            self.number[y] = count
            count += 1
            todo.append((y, True))
            todo += [(child, False) for _, child in reversed(self.children.get(y, []))]

    def runs(self, state: int) -> list[int]:
        """Sorted boundaries of the runs of label numbers that a state has no arc for: an odd place is inside a run."""
        known = self._runs.get(state)
        if known is None:
            spans: list[tuple[int, int]] = []
            seen: set[int] = set()
            at, before = state, _EVER
            while at >= 0:
                for label, rank in self.lost[at].items():
                    if rank < before and label not in seen:
                        seen.add(label)
                        n = self.number[label]
                        spans.append((n, n + 1))
                        made = self.children.get(label, [])
                        later = bisect_left(made, (rank, -1))
                        if later < len(made):
                            spans.append((self.number[made[later][1]], self.last[label]))
                at, before = self.origin[at][0], min(before, self.origin[at][1])
            known = []
            for a, b in sorted(spans):
                if known and a <= known[-1]:
                    known[-1] = max(known[-1], b)
                else:
                    known += [a, b]
            self._runs[state] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the only accepted path that spells a word."""
        states, labels, at = [0] * (len(word) + 1), [0] * (len(word) + 1), 0
        runs = self._runs
        for end, (size, number, target, label) in self.scan.iter(word.decode("latin-1")):
            if end < at:
                continue  # this place has its state
            q = states[end + 1 - size]
            boundaries = runs.get(q)
            if boundaries is None:
                boundaries = self.runs(q)
            if not bisect_right(boundaries, number) & 1:
                at = end + 1
                states[at], labels[at] = target, label
        if at < len(word):
            raise ValueError("the vocabulary lacks a byte")
        out = []
        while at:
            label = labels[at]
            out.append(label)
            at -= self.sizes[label]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """Emits the arcs' labels."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """Compiles the automaton of a tokenizers file; kept by each worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Automaton(spec["model"]["vocab"], pairs, {t["content"]: t["id"] for t in spec["added_tokens"]})


class Encoder:
    """Encodes whole texts with one automaton. A part's value is its ids as int32."""

    def __init__(self, path: str) -> None:
        self.automaton = load(path)
        names = sorted(self.automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.parts = Parts(lambda new: [self._value(p) for p in new], [s.encode() for s in names], KEPT_BYTES)
        ids = range(max(self.automaton.labels, default=0) + 1)
        self.decimals = pa.array([f"{i},".encode() for i in ids], pa.large_binary())
        self.emitted = pa.array([self.automaton.labels.get(i, b"") for i in ids], pa.large_binary())

    def _value(self, part: bytes) -> bytes:
        # a space and ASCII letters are one word, which needs no splitting
        ids = self.automaton.encode_word(part) if part[1:].isalpha() and (part[0] == 0x20 or part[:1].isalpha()) else self.encode(part.decode())
        return _INT32[len(ids)](*ids) if len(ids) < len(_INT32) else struct.pack(f"<{len(ids)}i", *ids)

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (first row, where each row's ids begin, ids) for runs of whole texts."""
        for lo, at, raw in self.parts.rows(texts):
            yield lo, at // 4, np.frombuffer(raw, dtype="<i4", count=int(at[-1]) // 4)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, word by word."""
        out: list[int] = []
        for piece in self.special.split(text or "") if self.special else [text or ""]:
            if piece in self.automaton.special:
                out.append(self.automaton.special[piece])
            else:
                for word in SPLIT.findall(piece):
                    out += self.automaton.encode_word(word.encode())
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as array<int>."""

    def made(e: Encoder, first: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))]

    return _map(docs, tokenizer, text_col, [(to, "array<int>")], made)


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of each array of ids; a null array gives an empty text."""
    names = [c for c in docs.columns if c != to]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"`{to}` string"])
    inputs = list(dict.fromkeys([*names, ids_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(tokenizer)
        for b in batches:
            texts = [automaton.decode(x or []) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], [*names, to])

    return docs.select(*inputs).mapInArrow(run, schema)


def _digest(raw: memoryview, lo: int, hi: int) -> str:
    return hashlib.sha256(raw[lo:hi]).hexdigest()


def _text_digest(raw: memoryview, lo: int, hi: int) -> str:
    try:
        str(raw[lo:hi], "utf-8")
    except UnicodeDecodeError:
        return hashlib.sha256(bytes(raw[lo:hi]).decode("utf-8", errors="replace").encode()).hexdigest()
    return _digest(raw, lo, hi)


def round_trip(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes each whole text: keep, n_tokens, ids_sha256, decoded_sha256. No shuffle."""

    def made(e: Encoder, first: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        places = pa.array(ids)
        of, digits = joined(e.decimals, places, first)
        to, text = joined(e.emitted, places, first)
        return [
            pa.array(np.diff(first)),
            pa.array([_digest(digits, a, max(a, b - 1)) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], pa.string()),
            pa.array([_text_digest(text, a, b) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.string()),
        ]

    return _map(docs, tokenizer, text_col, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")], made, keep)


def _map(docs: DataFrame, tokenizer: str, text_col: str, adds: list[tuple[str, str]], made, keep: tuple[str, ...] | None = None) -> DataFrame:
    new = [name for name, _ in adds]
    names = [c for c in (keep or docs.columns) if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), *(f"`{n}` {kind}" for n, kind in adds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            for lo, first, ids in e.rows(b.column(text_col)):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, len(first) - 1) for c in names), *made(e, first, ids)], [*names, *new])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, schema)
