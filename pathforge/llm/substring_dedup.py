"""Substring dedup with difference-cover anchors.

A window is ``size`` consecutive words of one document.  A word goes if it lies in a window
whose word sequence also starts in a document with a smaller id, judged on the input.

Anchors: for a cover D modulo ``period`` every difference d has a pair in D, so two equal
runs of ``size`` words, at whatever offsets, hold an equal run of ``size - period + 1`` words
that starts at a cover position of both.  Only those short windows are hashed and compared
across documents (|D| / period of all positions); a full window is built only where it holds
an anchor that some other document has too, and then decides by a longer hash.

Plan: documents are dealt once into blocks of bounded bytes, and that one exchange is reused
by all three passes.  Pass 1 sends each block's distinct anchors, cut into 5-byte keys, to
buckets of bounded size; a bucket answers with one bit an anchor: does another document have
it?  Pass 2 sends each block's distinct candidate windows with their least id, and a bucket
answers with one bit: does a smaller id have it?  Pass 3 removes words.  Each block sends a
key once however often it holds it, so a passage that a third of all documents share costs
a bucket one entry a block.  A false anchor match only adds a candidate; window keys have 88
bits and the bucket's.

Null text: no words.  Null id: the row neither removes nor loses words.  Rows with one id are
one document to each other.  An empty table gives an empty result.  Other columns are carried
through; the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, give_back, mix64, text_bytes, windows, words_of

SIZE = 13
PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 occurs
BLOCK_BYTES = 8 << 20  # of text
BUCKET_BYTES = 48 << 20  # of text whose anchors share a bucket
_KEY = U((1 << 40) - 1)
_BLOCK = "_block"

SENT = "bucket long, block long, keys binary, more binary, ids binary"
BACK = "block long, kind int, bucket long, n long, bits binary"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def check_cover(cover: tuple[int, ...], period: int) -> None:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover must hold every difference modulo the period")


def _comb(value: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket above a 40-bit key: sorted, it runs bucket by bucket."""
    return (((value >> U(40)) % U(buckets)) << U(40)) | (value & _KEY)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)


def _five(comb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(comb).view(np.uint8).reshape(-1, 8)[:, :5]


class Block:
    """The words of one block and its distinct anchors, the same whichever pass asks."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, size: int, period: int, cover: tuple[int, ...], buckets: int):
        self.size, self.period, self.buckets = size, period, buckets
        data, offsets = text_bytes(table.column(text_col))
        self.words = words_of(data, offsets)
        self.hashes = self.words.hashes()
        ids = table.column(id_col).combine_chunks().cast(pa.int64())
        self.known = np.asarray(pc.is_valid(ids))
        self.ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
        at = self.words.at
        first, value = windows(self.hashes, at, size - period + 1)
        text = np.searchsorted(at, first, "right") - 1
        here = np.isin((first - at[text]) % period, cover) & self.known[text]
        self.first, text = first[here], text[here]
        comb = _comb(value[here], buckets)
        self.order = np.argsort(comb, kind="stable")
        comb = comb[self.order]
        self.runs = _runs(comb)
        self.anchors = comb[self.runs]
        if len(comb):
            ids_ = self.ids[text[self.order]]
            self.several = np.minimum.reduceat(ids_, self.runs) < np.maximum.reduceat(ids_, self.runs)
        else:
            self.several = np.empty(0, bool)

    def candidates(self, shared: np.ndarray) -> None:
        """Distinct windows that hold a shared anchor, from the anchors' bits."""
        size, at = self.size, self.words.at
        n = len(self.hashes)
        marked = np.repeat(shared, np.diff(np.append(self.runs, len(self.order))))
        hit = np.zeros(n + 1, np.int64)
        anchors = self.first[self.order[marked]]
        np.add.at(hit, np.maximum(anchors - (self.period - 1), 0), 1)
        np.add.at(hit, anchors + 1, -1)
        start = np.flatnonzero(np.cumsum(hit[:n]) > 0)
        text = np.searchsorted(at, start, "right") - 1
        whole = (start + size <= at[text + 1]) & self.known[text]
        self.start, self.text = start[whole], text[whole]
        lanes = []
        for lane in (0, 1):
            h = self.hashes if lane == 0 else self.words.hashes(1)
            value = np.zeros(len(self.start), U)
            for i in range(size):
                value = value * U(0xA24BAED4963EE407) + h[self.start + i]
            lanes.append(mix64(value))
        comb, extra = _comb(lanes[0], self.buckets), lanes[1] >> U(16)
        self.worder = np.lexsort((extra, comb))
        comb, extra = comb[self.worder], extra[self.worder]
        new = np.ones(len(comb), bool)
        new[1:] = (comb[1:] != comb[:-1]) | (extra[1:] != extra[:-1])
        self.wruns = np.flatnonzero(new)
        self.windows, self.extra = comb[self.wruns], extra[self.wruns]
        wids = self.ids[self.text[self.worder]]
        self.least = np.minimum.reduceat(wids, self.wruns) if len(comb) else np.empty(0, np.int64)

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which words go, from the windows' bits."""
        length = np.diff(np.append(self.wruns, len(self.worder)))
        own = self.ids[self.text[self.worder]]
        gone = self.start[self.worder[(own > np.repeat(self.least, length)) | np.repeat(smaller, length)]]
        n = len(self.hashes)
        cover = np.zeros(n + self.size + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.size, -1)
        return np.cumsum(cover[:n]) > 0


def _of_one(f, **fixed):
    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table, **fixed)
        finally:
            give_back()

    return run


def _of_two(f, **fixed):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right, **fixed)
        finally:
            give_back()

    return run


def _by_bucket(comb: np.ndarray) -> list[tuple[int, int, int]]:
    bucket = (comb >> U(40)).astype(np.int64)
    edges = np.append(_runs(bucket), len(bucket))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _bits(table: pa.Table, kind: int, total: int) -> np.ndarray:
    """A block's answers, bucket by bucket, as one mask."""
    rows = sorted((b, n, bits) for k, b, n, bits in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "n", "bits")), strict=True) if k == kind)
    parts = [np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for _, n, bits in rows]
    mask = np.concatenate(parts) if parts else np.empty(0, bool)
    if len(mask) != total:
        raise RuntimeError("the answers do not fit the block")
    return mask


def _send_anchors(table: pa.Table, *, make) -> pa.Table:
    block, key = make(table), table.column(table.num_columns - 1)[0].as_py()
    keys = _five(block.anchors)
    return _table([(b, key, keys[lo:hi].tobytes(), np.packbits(block.several[lo:hi]).tobytes(), None) for b, lo, hi in _by_bucket(block.anchors)], SENT)


def _read_keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) // 5 for x in blobs])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    return wide.view(U).ravel(), np.concatenate([[0], np.cumsum(sizes)])


def _answer(table: pa.Table, kind: int, mask: np.ndarray, at: np.ndarray) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    return _table([(b, kind, bucket, int(hi - lo), np.packbits(mask[lo:hi]).tobytes()) for b, lo, hi in zip(table.column("block").to_pylist(), at[:-1], at[1:], strict=True)], BACK)


def _match_anchors(table: pa.Table) -> pa.Table:
    keys, at = _read_keys(table.column("keys").to_pylist())
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("more").to_pylist(), np.diff(at), strict=True)])
    order = np.argsort(keys)
    runs = _runs(keys[order])
    length = np.diff(np.append(runs, len(keys)))
    shared = (length > 1) | (np.add.reduceat(several[order].astype(np.int64), runs) > 0)
    mask = np.empty(len(keys), bool)
    mask[order] = np.repeat(shared, length)
    return _answer(table, 0, mask, at)


def _send_windows(docs: pa.Table, back: pa.Table, *, make) -> pa.Table:
    if docs.num_rows == 0:
        return _table([], SENT)
    block, key = make(docs), docs.column(docs.num_columns - 1)[0].as_py()
    block.candidates(_bits(back, 0, len(block.anchors)))
    keys = _five(block.windows)
    extra = np.ascontiguousarray(block.extra).view(np.uint8).reshape(-1, 8)[:, :6]
    return _table([(b, key, keys[lo:hi].tobytes(), extra[lo:hi].tobytes(), block.least[lo:hi].tobytes()) for b, lo, hi in _by_bucket(block.windows)], SENT)


def _match_windows(table: pa.Table) -> pa.Table:
    keys, at = _read_keys(table.column("keys").to_pylist())
    wide = np.zeros((len(keys), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint8).reshape(-1, 6)
    extra = wide.view(U).ravel()
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    order = np.lexsort((extra, keys))
    k, x = keys[order], extra[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    runs = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[order], runs), np.diff(np.append(runs, len(k))))
    mask = np.empty(len(k), bool)
    mask[order] = least < ids[order]
    return _answer(table, 1, mask, at)


def _remove(docs: pa.Table, back: pa.Table, *, make, names: list[str]) -> pa.Table:
    block = make(docs)
    block.candidates(_bits(back, 0, len(block.anchors)))
    gone = block.removed(_bits(back, 1, len(block.windows)))
    w, at = block.words, block.words.at
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[at[1:]] - total[at[:-1]]
    plain = w.data.tobytes()
    kept, spans = [], []
    for d, (lo, hi) in enumerate(zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)):
        parts = plain[lo:hi].split()
        if removed[d]:
            a, b = at[d], at[d + 1]
            mask = np.concatenate([[False], gone[a:b], [False]])
            edge = np.flatnonzero(mask[1:] != mask[:-1]).tolist()
            spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            parts = compress(parts, (~gone[a:b]).tolist())
        else:
            spans.append([])
        kept.append(b" ".join(parts).decode())
    own = {
        "n_words": pa.array(w.counts(), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_text": pa.array(kept, pa.string()),
    }
    return pa.table({n: own[n] if n in own else docs.column(n) for n in names})


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, period: int = PERIOD, cover: tuple[int, ...] = COVER,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_removed, spans (removed words, from start to before end) and
    kept_text (the other words joined by one space)."""
    check_cover(cover, period)
    if not 1 <= period < size:
        raise ValueError("the period must be below the window size")
    own = ["n_words", "n_removed", "spans", "kept_text"]
    names = [c for c in docs.columns if c not in own]
    docs, dealt = docs.select(*names), _BLOCK
    while dealt in {c.lower() for c in names}:
        dealt += "_"
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks, n_buckets = max(1, math.ceil(n_bytes / block_bytes)), max(1, math.ceil(n_bytes / bucket_bytes))
    make = partial(Block, id_col=id_col, text_col=text_col, size=size, period=period, cover=cover, buckets=n_buckets)
    docs = docs.withColumn(dealt, F.pmod(F.xxhash64(id_col, text_col), F.lit(n_blocks)))
    by_block = lambda df, key: df.groupBy(key)
    anchors = by_block(docs, dealt).applyInArrow(_of_one(_send_anchors, make=make), SENT)
    back = anchors.groupBy("bucket").applyInArrow(_match_anchors, BACK)
    sent = by_block(docs, dealt).cogroup(by_block(back, "block")).applyInArrow(_of_two(_send_windows, make=make), SENT)
    back = back.unionByName(sent.groupBy("bucket").applyInArrow(_match_windows, BACK))
    out = T.StructType(
        [f for f in docs.schema if f.name in names]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPANS), T.StructField("kept_text", T.StringType())]
    )
    return by_block(docs, dealt).cogroup(by_block(back, "block")).applyInArrow(_of_two(_remove, make=make, names=out.names), out)
