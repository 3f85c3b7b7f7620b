"""Byte-level BPE from a file of ranks: texts to ids and ids to bytes."""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small

REMEMBERED = 1 << 18  # pieces remembered in one Python worker; then it starts afresh
LONG = 1 << 20  # texts of more characters are matched and encoded a block of pieces at a time
BLOCK = 1 << 16  # pieces in such a block
ROWS = 256  # texts encoded or decoded at once
SHORT = 64  # pieces of at most so many bytes are merged many at once
TREES = 8192  # of them at once


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of a piece's bytes after all merges, lowest rank first and leftmost among equals.

    A segment tree has a leaf for each byte position: the rank of the pair that starts there,
    with the position in its low bits, so that the root is the leftmost pair of least rank.
    A merge changes three leaves (the pair itself, the one it leaves behind and the one before)
    and the nodes above them, so n bytes take O(n log n) steps whatever their ranks.
    """
    n = len(piece)
    bits = (n - 1).bit_length()
    size = 1 << bits
    none, low, rank_of = 1 << 32 + bits, size - 1, ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (rank := rank_of(piece[i : i + 2])) is not None:
            tree[size + i] = rank << bits | i
    for at in range(size - 1, 0, -1):
        a, b = tree[2 * at], tree[2 * at + 1]
        tree[at] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) < none:
        i = best & low
        j = after[i]
        k = after[i] = after[j]
        changed = [(j, none), (i, none)]
        if k < n:
            before[k] = i
            if (rank := rank_of(piece[i : after[k]])) is not None:
                changed[1] = i, rank << bits | i
        if (p := before[i]) >= 0:
            rank = rank_of(piece[p:k])
            changed.append((p, none if rank is None else rank << bits | p))
        for at, key in changed:
            at += size
            if tree[at] == key:
                continue
            tree[at] = key
            while at > 1:
                if (other := tree[at ^ 1]) < key:
                    key = other
                at >>= 1
                if tree[at] == key:
                    break
                tree[at] = key
    found, i = [], 0
    while i < n:
        found.append(ranks[piece[i : after[i]]])
        i = after[i]
    return found


class Splitter:
    """The matches of a pattern, with characters classed as the tiktoken library does.

    The regex module may know a later Unicode than the library, so that a character is a letter
    to one and unassigned to the other. The library itself is asked once for the classes of each
    character that occurs; where they differ, matches are found with a stand-in of the library's
    classes in the character's place.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        single = {bytes([b]): b for b in range(256)}
        kinds = sorted(set(re.findall(r"\\[pP]\{\w+\}|\\[sSdDwW]", pattern)))
        self.library = [tiktoken.Encoding("class", pat_str=k, mergeable_ranks=single, special_tokens={}) for k in kinds]
        self.own = [regex.compile(k) for k in kinds]
        self.asked, self.swap, self.odd = {chr(c) for c in range(0x80)}, {}, set()
        usual = [chr(c) for c in range(0xA1, 0x800) if chr(c) not in pattern]
        there, here = self._classes("".join(usual))
        self.stand_ins = {there[c]: c for c in usual if there[c] == here[c]}

    def _classes(self, text: str) -> tuple[dict, dict]:
        found = ([set(x.decode_bytes(x.encode_ordinary(text)).decode()) for x in self.library], [set(p.findall(text)) for p in self.own])
        return tuple({c: tuple(c in f for f in side) for c in text} for side in found)

    def _learn(self, new: set[str]) -> None:
        there, here = self._classes("".join(sorted(new)))
        self.asked |= new
        for c in new:
            if there[c] != here[c]:
                self.swap[ord(c)] = self.stand_ins[there[c]]
                self.odd.add(c)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All matches in order, in one list or, for a very long text, a block at a time."""
        if not text.isascii() and (new := set(text) - self.asked):
            self._learn(new)
        if self.odd and not self.odd.isdisjoint(text):
            found = (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.swap)))
        elif len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block


class Forest:
    """The merges of many short pieces at once: a segment tree for each, one merge of each a round.

    The trees are those of `merge`, rows of one array; a pair is known by the ids of its two
    tokens, and its rank is the id of what they make.
    """

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1) if len(self.keys) else np.full(len(key), -1)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit numbers."""
        n = np.array([len(p) for p in pieces])
        bits = max(1, int(n.max() - 1).bit_length())
        size, none = 1 << bits, np.int64(1) << 62
        data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(-1, size)
        token, place = self.byte[data], np.arange(size)
        inside = place < n[:, None]
        after, before = np.tile(place + 1, (len(n), 1)), np.tile(place - 1, (len(n), 1))
        tree = np.full((len(n), 2 * size), none)
        rank = self._rank(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(len(n), size - 1)
        known = (rank >= 0) & inside[:, 1:]
        tree[:, size : 2 * size - 1][known] = (rank << bits | place[:-1])[known]
        for at in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1], out=tree[:, at])

        def put(row, at, key):
            at = at + size
            tree[row, at] = key
            for _ in range(bits):
                at >>= 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        while len(row := np.flatnonzero(tree[:, 1] < none)):
            best = tree[row, 1]
            i = best & (size - 1)
            j = after[row, i]
            k = after[row, j]
            after[row, i], token[row, i] = k, best >> bits
            inside[row, j] = False
            put(row, j, none)
            more = k < n[row]
            r, here, there = row[more], i[more], k[more]
            before[r, there] = here
            rank = self._rank(token[r, here], token[r, there])
            put(r, here, np.where(rank >= 0, rank << bits | here, none))
            put(row[~more], i[~more], none)
            p = before[row, i]
            r, first, second = row[p >= 0], p[p >= 0], i[p >= 0]
            rank = self._rank(token[r, first], token[r, second])
            put(r, first, np.where(rank >= 0, rank << bits | first, none))
        ids, ends = token[inside].astype(np.int32).tobytes(), np.cumsum(inside.sum(1) * 4).tolist()
        return [ids[first:end] for first, end in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Ids of whole texts, for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.splitter = read_ranks(path), Splitter(pattern)
        self.forest = Forest(self.ranks)
        self.known: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        """The ids of pieces not yet known; pieces of like length are merged together."""
        like: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None or len(raw) > SHORT:
                self.known[piece] = array.array("i", merge(self.ranks, raw) if whole is None else [whole]).tobytes()
            else:
                names, raws = like.setdefault((len(raw) - 1).bit_length(), ([], []))
                names.append(piece)
                raws.append(raw)
        for names, raws in like.values():
            for at in range(0, len(names), TREES):
                self.known.update(zip(names[at : at + TREES], self.forest.merged(raws[at : at + TREES]), strict=True))

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of some lists of pieces; all their new pieces are learnt first."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := set().union(*lists) - self.known.keys():
            self._learn(new)
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in lists]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The texts' ids as 32-bit numbers; a null or empty text has none."""
        out: list[bytes] = [b""] * len(texts)
        usual = [i for i, t in enumerate(texts) if t and len(t) <= LONG]
        lists = [list(chain.from_iterable(self.splitter.pieces(texts[i]))) for i in usual]
        for i, ids in zip(usual, self._ids(lists), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if t and len(t) > LONG:
                out[i] = b"".join([b"".join(self._ids([block])) for block in self.splitter.pieces(t)])
        return out


class Decoder:
    """Bytes of ids, for one file of ranks."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        n = max(ranks.values(), default=-1) + 1
        self.length = np.full(n, -1, np.int64)
        tokens = [b""] * n
        for token, rank in ranks.items():
            tokens[rank], self.length[rank] = token, len(token)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.r_[0, np.cumsum(np.maximum(self.length, 0))][:-1]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of rows of ids that end at `ends`, where each row's bytes end, and which rows are sound."""
        real = (ids >= 0) & (ids < len(self.length))
        safe = np.where(real, ids, 0)
        length = np.where(real, self.length[safe], -1)
        faults = np.r_[0, np.cumsum(length < 0)]
        sound = np.diff(faults[np.r_[0, ends]]) == 0
        length = np.maximum(length, 0)
        stops = np.cumsum(length)
        at = np.arange(int(length.sum())) + np.repeat(self.start[safe] - (stops - length), length)
        return self.data[at].tobytes(), np.r_[0, stops][ends], sound


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder, made once."""
    return Encoder(path, pattern)


@cache
def decoder(path: str) -> Decoder:
    """The worker's decoder, made once."""
    return Decoder(path)


def _encode(path: str, pattern: str):
    def run(batches):
        own = encoder(path, pattern)
        for batch in small(batches, ROWS):
            rows = own.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])
    return run


def _decode(path: str):
    def run(batches):
        own = decoder(path)
        for batch in small(batches, ROWS):
            rows = batch.column("ids")
            ids = rows.flatten()
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = np.where(missing, -1, ids.fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            data, stops, sound = own.decode(ids, ends)
            null = rows.is_null().to_numpy(zero_copy_only=False) | ~sound
            first = np.r_[0, stops]
            decoded = pa.array([None if null[i] else data[first[i] : first[i + 1]] for i in range(len(rows))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row's whole text by the ranks in `path`, without special tokens.

    `docs` needs (doc_id, text); other columns, also one named `ids`, are left out. Each match of
    `pattern` is encoded by itself: it is one token if the file has it whole, and else its bytes
    are merged by the lowest rank first, the leftmost among equals. The file must have all single
    bytes. A null or empty text has an empty list. Repeated rows stay rows of their own, a null
    doc_id keeps its row, and an empty table gives an empty one.

    Rows are not moved. Pieces are remembered in each worker, a bounded number of them; a very
    long text is matched a block of pieces at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(path, pattern), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with the bytes of each row's `ids` as `decoded`.

    A null list and a list with a null or an id that the file lacks give null; an empty list
    gives no bytes. The bytes of a cut list may end inside a character, so they are no string. A column named
    `decoded` is replaced; an empty table gives an empty one.
    """
    encoded = encoded.drop("decoded").withColumn("ids", F.col("ids").cast("array<int>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(path), f"{schema}, decoded binary")
