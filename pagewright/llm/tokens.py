"""Problem 6: encoding of texts with a public byte-level BPE vocabulary.

Method: a segment tree over the adjacent pairs of a pretoken. Leaf i holds the merge rank of the pair that starts at
position i, combined with i; the root is then the leftmost pair of the lowest rank. A merge updates three leaves and
their ancestors. Whole batches of distinct pretokens are merged at once, one array row for each tree.

Defined results: null and empty texts have an empty list. Strings that resemble special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text before merges (published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens of at most so many bytes are remembered, up to so many of them, for each Python worker.
CACHED_BYTES, CACHED = 96, 150_000
_NONE = np.int64(1 << 62)


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Where the vocabulary file is; the folder is a parameter, by default that of the installed package."""
    if folder is None:
        folder = os.environ.get("PAGEWRIGHT_TOKENIZERS")
    if folder is None:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.__file__)
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """The published letter of each byte: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SegmentTreeBpe:
    """Encoder of pretokens (bytes) to ids; see the module."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.split = regex.compile(PATTERN).findall
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in _byte_letters().items():
            self.byte_id[b] = vocab[letter]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        # An open-addressed table of the pairs, probed for whole arrays at once.
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.zeros((1 << self.bits) + 64, np.int64)
        self.probes = 1
        for rank, (k, h) in enumerate(zip(keys.tolist(), self._hash(keys).tolist())):
            n = 1
            while self.keys[h] != -1:
                h, n = h + 1, n + 1
            self.keys[h], self.ranks[h], self.probes = k, rank, max(self.probes, n)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """The leaf's value, rank and position, of each pair; right is -1 where there is no pair."""
        keys = (left.astype(np.int64) << 20) | np.maximum(right, 0)
        h = self._hash(keys)
        out = np.full(len(keys), _NONE)
        todo = np.flatnonzero(right >= 0)
        for _ in range(self.probes):
            if not len(todo):
                break
            found = self.keys[h[todo]]
            hit = todo[found == keys[todo]]
            out[hit] = (self.ranks[h[hit]] << shift) | at[hit]
            todo = todo[(found != keys[todo]) & (found != -1)]
            h[todo] += 1
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each pretoken; words of like length share a batch."""
        out: list[list[int]] = [[] for _ in words]
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                classes.setdefault(max(1, (len(w) - 1).bit_length()), []).append(i)
        for level, rows in classes.items():
            step = max(1, (1 << 20) >> level)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._batch([words[i] for i in part], level)):
                    out[i] = ids
        return out

    def _batch(self, words: list[bytes], level: int) -> list[list[int]]:
        n, p = len(words), 1 << level
        size = np.array([len(w) for w in words], np.int64)
        at = np.arange(p, dtype=np.int64)
        inside = at[None, :] < size[:, None]
        token = np.full((n, p + 1), -1, np.int64)
        token[:, :p][inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        nxt = np.tile(np.append(at + 1, p), (n, 1))
        nxt[:, :p] = np.minimum(nxt[:, :p], p)
        prv = np.tile(np.append(at - 1, 0), (n, 1))
        tree = np.full((n, 2 * p), _NONE)
        right = np.where(at[None, :] + 1 < size[:, None], token[:, 1:], -1)
        tree[:, p:] = self._leaf(token[:, :p].ravel(), right.ravel(), np.tile(at, n), level).reshape(n, p)
        for d in range(level - 1, -1, -1):
            lo = 1 << d
            kids = tree[:, 2 * lo : 4 * lo].reshape(n, lo, 2)
            tree[:, lo : 2 * lo] = kids.min(axis=2)
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            pos, rank = root & (p - 1), root >> level
            gone = nxt[rows, pos]
            after = nxt[rows, gone]
            token[rows, pos] = self.merged[rank]
            token[rows, gone] = -1
            nxt[rows, pos] = after
            prv[rows, after] = pos  # column p takes what has no place
            before = prv[rows, pos]
            has = before >= 0
            three_rows = np.concatenate([rows, rows, rows[has]])
            three = np.concatenate([gone, pos, before[has]])
            leaves = np.concatenate([
                np.full(len(rows), _NONE),
                self._leaf(token[rows, pos], token[rows, after], pos, level),
                self._leaf(token[rows[has], before[has]], token[rows[has], pos[has]], before[has], level),
            ])
            tree[three_rows, p + three] = leaves
            node = p + three
            for _ in range(level):
                node >>= 1
                tree[three_rows, node] = np.minimum(tree[three_rows, 2 * node], tree[three_rows, 2 * node + 1])
            rows = rows[tree[rows, 1] != _NONE]
        kept = token[:, :p] >= 0
        flat, ends = token[:, :p][kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        pieces = [self.split(t) if t else [] for t in texts]
        new = list({w for ws in pieces for w in ws} - self.cache.keys())
        known = dict(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new])))
        old = self.cache
        out: list[list[int]] = []
        for ws in pieces:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else old[w]
            out.append(ids)
        if len(old) > CACHED:
            old.clear()
        old.update((w, ids) for w, ids in known.items() if len(w) <= CACHED_BYTES)
        return out


_encoders: dict[str, SegmentTreeBpe] = {}


def encoder(path: str) -> SegmentTreeBpe:
    """The encoder of a vocabulary file, made once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = SegmentTreeBpe(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, name: str, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch that hold about so many bytes of text, so that memory doesn't follow the longest texts."""
    texts = batch.column(batch.schema.get_field_index(name))
    if texts.nbytes <= chars:
        yield batch, texts.to_pylist()
        return
    step = max(1, batch.num_rows * chars // texts.nbytes)
    for k in range(0, batch.num_rows, step):
        part = batch.slice(k, step)
        yield part, part.column(part.schema.get_field_index(name)).to_pylist()


def encode(df: DataFrame, key: str, text: str, path: str | None = None, spread: bool = True) -> DataFrame:
    """key and ids ARRAY<INT> of every row of df; other columns are ignored, rows are neither joined nor dropped.

    spread: first distribute the rows evenly, as a scan's splits follow compressed bytes and not the work.
    """
    path = path or vocabulary_path()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if spread:
        rows = rows.repartition(_parts(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in _slices(batch, "t"):
                ids = enc.encode_batch(texts)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key and tokens INT of every row; 0 for null and empty texts."""
    path = path or vocabulary_path()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).repartition(_parts(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in _slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in enc.encode_batch(texts)], pa.int32())], names=[key, "tokens"])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("tokens", T.IntegerType())]))


def _parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
