"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Every distinct pre-token of a batch becomes one row of a matrix: a doubly
linked list of tokens and, above it, a segment tree whose leaf ``i`` holds
``rank(i, next(i)) * width + i``.  The root is then the lowest rank and, among
equal ranks, the leftmost pair.  A merge rewrites three leaves and their paths
to the root.  All rows of a matrix take one merge per step until their roots
are empty.  Pre-tokens are grouped by the power of two above their length, so
a long one costs ``n log n`` and does not widen the others.

Results per text: null counts as empty, empty texts have no ids, any length is
encoded whole, repeated rows give repeated results.  Nothing is shuffled and a
lost task is simply run again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridweave.llm.pretokens import segments, splitter

#: Distinct pre-tokens a worker remembers before it starts anew; only a cache.
CACHE = 100_000
#: Characters of text in one output batch of a task (a longer text is a batch of its own).  Its pre-tokens are held
#: at once, some 20 times as many bytes, and a worker keeps that memory while it serves other steps.
BATCH_CHARS = 300_000
#: Cells of one matrix: small enough to stay in the processor's cache.
CELLS = 1 << 15
EMPTY = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte ids, merge ranks and token bytes of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {i: bytes(letters[c] for c in s) for s, i in ids.items() if s not in self.special}
        self.token_bytes = plain | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.int64(1) << 62)
        self.ranks = np.append(order, 0).astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, ``EMPTY`` where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], EMPTY)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rows(voc: Vocabulary, words: list[bytes], width: int) -> list[bytes]:
    """Token ids (32-bit, packed) of byte strings of at most ``width`` bytes (a power of two)."""
    n, last = len(words), width - 1
    kind = np.int32 if width <= 1 << 14 else np.int64  # rank * width has to fit
    none = np.iinfo(kind).max
    length = np.fromiter(map(len, words), np.int64, n)
    here = np.arange(width) < length[:, None]
    ids = np.full((n, width), -1, np.int32)
    ids[here] = voc.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    nxt = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    nxt[np.arange(n), length - 1] = width  # the end
    prv = np.tile(np.arange(-1, last, dtype=np.int32), (n, 1))
    both = here[:, 1:]

    def leaf(left, right, at):
        rank = voc.rank(left, right)
        return np.where(rank < EMPTY, rank * width + at, none)

    tree = np.full((n, 2 * width), none, kind)
    tree[:, width:-1][both] = leaf(ids[:, :-1][both], ids[:, 1:][both], np.broadcast_to(np.arange(last), both.shape)[both])
    size = width
    while size > 1:
        size //= 2
        np.minimum(tree[:, 2 * size:4 * size:2], tree[:, 2 * size + 1:4 * size:2], out=tree[:, size:2 * size])
    ids, nxt, prv, tree = ids.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
    rows = np.flatnonzero(tree[1::2 * width] < none)
    while rows.size:
        cell, root = rows * width, rows * (2 * width)
        top = tree[root + 1]
        at, made = top & last, voc.merged[top // width]
        gone = nxt[cell + at]
        after = nxt[cell + gone]
        before = prv[cell + at]
        ids[cell + at] = made
        ids[cell + gone] = -1
        nxt[cell + at] = after
        tree[root + width + gone] = none
        has = np.flatnonzero(after < width)
        prv[cell[has] + after[has]] = at[has]
        right = np.full(rows.size, none, kind)
        right[has] = leaf(made[has], ids[cell[has] + after[has]], at[has])
        tree[root + width + at] = right
        led = np.flatnonzero(before >= 0)
        tree[root[led] + width + before[led]] = leaf(ids[cell[led] + before[led]], made[led], before[led])
        path = np.concatenate([gone, at, before[led]]) + width
        up = np.concatenate([root, root, root[led]])
        for _ in range(last.bit_length()):
            path >>= 1
            below = up + 2 * path
            tree[up + path] = np.minimum(tree[below], tree[below + 1])
        rows = rows[tree[root + 1] < none]
    ends = np.concatenate([[0], 4 * np.cumsum(np.add.reduceat(ids >= 0, np.arange(0, n * width, width)))]).tolist()
    flat = ids[ids >= 0].tobytes()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def encode_words(voc: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Packed token ids of each pre-token, grouped by the power of two above its length."""
    out = [b""] * len(words)
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
    for width, where in groups.items():
        step = max(1, CELLS // width)
        for k in range(0, len(where), step):
            part = where[k:k + step]
            for i, got in zip(part, merge_rows(voc, [words[i] for i in part], width), strict=True):
                out[i] = got
    return out


class Encoder:
    """Whole texts to ids; remembers the ids of recent pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.voc, self.split, self.seen = vocabulary(path), splitter(pattern), {}
        self.special = tuple(self.voc.special)

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for part in segments(text, self.special):
            out.extend([part] if part in self.voc.special else self.split(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """All ids in a row, and where each text's ids begin and end."""
        cut = [self.pieces(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        if len(self.seen) > CACHE:
            self.seen.clear()
        self.seen.update((p, np.int32(i).tobytes()) for p, i in self.voc.special.items())
        new = [p for p in set(flat) if p not in self.seen]
        self.seen.update(zip(new, encode_words(self.voc, [p.encode() for p in new]), strict=True))
        got = list(map(self.seen.__getitem__, flat))
        sizes = np.cumsum([0, *map(len, got)])[np.cumsum([0, *map(len, cut)])] // 4
        return np.frombuffer(b"".join(got), np.int32), sizes.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.voc.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, pattern)


def batches(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` characters, or of one row."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text",
                  ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with its token ids and the text decoded from them, as two more columns.

    Columns of the same name are replaced.  Bytes that do not form UTF-8 after
    decoding become U+FFFD, as in the reference decoder.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*keep)
    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
                           T.StructField(decoded, T.StringType())])

    def run(parts):
        import pyarrow as pa

        coder = encoder(path, pattern)
        for batch in parts:
            whole = [t or "" for t in batch.column(keep.index(text)).to_pylist()]
            for a, b in batches(whole):
                flat, ends = coder.encode(whole[a:b])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                back = pa.array([coder.decode(flat[i:j].tolist()) for i, j in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists, back], names=[*keep, ids, decoded])
        coder.seen.clear()  # the worker lives on for other steps

    return source.mapInArrow(run, schema)
