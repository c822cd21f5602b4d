"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A document is its token ids and one closing id.  One that is longer than a sequence is cut
into full pieces behind a first piece that holds the remainder; nothing else is cut.  A full
piece is a sequence by itself.  The others are dealt by hash into blocks of bounded size;
each block is a packing problem that several islands evolve, each a task of its own.

An individual is a partition of the block's pieces into bins.  The first are best-fit packings
of the pieces in decreasing and in jittered order.  Crossover injects a share of the second
parent's bins, drawn with preference for well-filled ones, into the first; bins of the first
that repeat an injected piece go; displaced pieces are put back best-fit, longest first.
Fitness is the mean of (fill / capacity) squared, which rewards full bins and so fewer bins.
After each epoch an island's elite moves to the next island of its block.  The best island
gives the block's bins; bins below ``TAIL_FILL`` of all blocks are packed once more together.

Null text: empty, so one closing id.  Repeated rows are documents of their own; null ids are
packed like others.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import batchwise, text_bytes

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 16, 6
INJECT = 0.3
TAIL_FILL = 0.97
SLICE = 1 << 20  # characters of a text encoded at once

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(text: str, size: int = SLICE) -> list[str]:
    """The text cut before single spaces between two visible characters, where a byte-level
    tokenizer always begins a word, so the parts' ids join to the text's ids."""
    if len(text) <= size:
        return [text]
    out, lo = [], 0
    while len(text) - lo > size:
        at = lo + size
        while at < len(text) - 1 and not (text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace() and text[at - 1].isalnum()):
            at += 1
        if at >= len(text) - 1:
            break
        out.append(text[lo:at])
        lo = at
    return [*out, text[lo:]]


COMMON = 0x250  # texts with code points from here on go through the library whole
_RARE = re.compile(f"[^\\x00-{chr(COMMON - 1)}]")


def _word_pattern() -> re.Pattern:
    """How the byte-level tokenizer cuts common texts into words: contractions, then letters,
    numbers or other visible signs behind at most one space, then white space, of which the last
    stays with the word that follows.  The classes are spelt out from the Unicode data."""

    def spell(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(COMMON) if test(chr(c)))

    letter, number = (spell(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    white = spell(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


PATTERN = _word_pattern()
KNOWN_WORDS = 500_000  # words whose ids a worker remembers


@lru_cache(1)
def _known(path: str) -> dict[str, bytes]:
    return {}


def _encode(parts: list[str], path: str) -> list[bytes]:
    """The library's ids of each part, packed."""
    out: list[bytes] = []
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= SLICE):
            size += len(parts[hi])
            hi += 1
        out += [pack(f"<{len(e)}I", *e.ids) for e in _tokenizer(path).encode_batch_fast(parts[lo:hi], add_special_tokens=False)]
        lo = hi
    return out


def _by_words(texts: list[str], path: str) -> list[bytes]:
    """The same ids, word by word: merges never cross words, so a word is encoded once."""
    known = _known(path)
    if len(known) > KNOWN_WORDS:
        known.clear()
    split = [PATTERN.findall(t) for t in texts]
    new = list(set().union(*split).difference(known))
    known.update(zip(new, _encode(new, path), strict=True))
    return [b"".join(map(known.__getitem__, ws)) for ws in split]


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Each text's ids and the closing id."""
    special = "<|" if _tokenizer(path).get_added_tokens_decoder() else None
    whole = [bool(_RARE.search(t)) or bool(special and special in t) for t in texts]
    parts = [slices(t) for t in texts]
    flat = [(p, w) for ps, w in zip(parts, whole, strict=True) for p in ps]
    library = iter(_encode([p for p, w in flat if w], path))
    words = iter(_by_words([p for p, w in flat if not w], path))
    packed = [next(library) if w else next(words) for _, w in flat]
    end = np.array([END_ID], "<u4").tobytes()
    out, at = [], 0
    for ps in parts:
        out.append(np.frombuffer(b"".join([*packed[at : at + len(ps)], end]), "<u4"))
        at += len(ps)
    return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(batch: pa.RecordBatch, path: str, capacity: int) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(1))
    plain, edges, ids = data.tobytes(), offsets.tolist(), batch.column(0).to_pylist()
    rows: list[tuple] = []
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 2 * SLICE, "right")) - 1)
        texts = [plain[a:b].decode() for a, b in zip(edges[lo:hi], edges[lo + 1 : hi + 1], strict=True)]
        for doc, found in zip(ids[lo:hi], token_ids(texts, path), strict=True):
            raw = found.tobytes()
            rows += [(doc, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(found), capacity))]
        lo = hi
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


class Bins:
    """Open bins found by their free room: the least room that suffices is one bit scan away."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.free: list[int] = []

    def open(self, free: int) -> int:
        self.free.append(0)
        b = len(self.free) - 1
        self.put(b, free)
        return b

    def put(self, b: int, free: int) -> None:
        self.free[b] = free
        if not self.room[free]:
            self.mask |= 1 << free
        self.room[free].append(b)

    def best_fit(self, size: int) -> int:
        rest = self.mask >> size
        if not rest:
            return self.open(self.capacity - size)
        free = size + (rest & -rest).bit_length() - 1
        b = self.room[free].pop()
        if not self.room[free]:
            self.mask ^= 1 << free
        self.put(b, free - size)
        return b


def fill_in(sizes: list[int], order, assigned: np.ndarray, free: list[int], capacity: int) -> np.ndarray:
    """Put the pieces of ``order`` best-fit into bins with room ``free`` and new ones."""
    bins = Bins(capacity)
    for f in free:
        bins.open(f)
    for i in order:
        assigned[i] = bins.best_fit(sizes[i])
    return assigned


def fills(assigned: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(assigned, sizes)


def fitness(assigned: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    f = fills(assigned, sizes) / capacity
    return float((f * f).mean())


def crossover(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Bins of ``two`` injected into ``one``."""
    fill = fills(two, sizes)
    score = (fill / capacity) ** 8 * rng.random(len(fill))
    taken = np.zeros(len(fill), bool)
    taken[np.argpartition(-score, max(1, int(INJECT * len(fill))) - 1)[: max(1, int(INJECT * len(fill)))]] = True
    injected = taken[two]
    broken = np.zeros(int(one.max()) + 1, bool)
    broken[one[injected]] = True
    stays = ~injected & ~broken[one]
    out = np.full(len(one), -1, np.int64)
    number = np.cumsum(taken) - 1
    out[injected] = number[two[injected]]
    kept = np.unique(one[stays])
    renumber = np.zeros(len(broken), np.int64)
    renumber[kept] = np.arange(len(kept)) + taken.sum()
    out[stays] = renumber[one[stays]]
    there = out >= 0
    load = np.bincount(out[there], sizes[there], int(taken.sum()) + len(kept)).astype(np.int64)
    loose = np.flatnonzero(~there)  # pieces are in order of falling size
    return fill_in(sizes.tolist(), loose.tolist(), out, (capacity - load).tolist(), capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after so many generations, best first.  ``sizes`` fall."""
    rng = np.random.default_rng(seed)
    plain = sizes.tolist()
    if not population:
        population = [fill_in(plain, range(len(plain)), np.zeros(len(plain), np.int64), [], capacity)]
    while len(population) < POPULATION:
        order = np.argsort(-sizes * (1 + 0.1 * rng.random(len(sizes))), kind="stable")
        population.append(fill_in(plain, order.tolist(), np.zeros(len(plain), np.int64), [], capacity))
    least = math.ceil(sizes.sum() / capacity)
    ranked = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))[:POPULATION]
    for g in range(generations):
        if int(ranked[0][2].max()) + 1 <= least or len(sizes) < 2:
            break
        i, j = sorted(rng.choice(len(ranked), 2, replace=False))
        child = crossover(ranked[j][2], ranked[i][2], sizes, capacity, rng) if rng.random() < 0.5 else crossover(ranked[i][2], ranked[j][2], sizes, capacity, rng)
        ranked = sorted([*ranked, (fitness(child, sizes, capacity), len(population) + g, child)], key=lambda x: (-x[0], x[1]))[:POPULATION]
    return [p for _, _, p in ranked]


STATE = "block long, island int, fitness double, people binary"


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["length", "item"], ascending=[False, True], kind="stable")


def _people(raw: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(raw, np.int32).reshape(-1, n).astype(np.int64)) if raw else []


def _epoch(seed: int, capacity: int):
    def run(items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(items):
            return pd.DataFrame({"block": [], "island": [], "fitness": [], "people": []})
        block, island = int(items["block"].iloc[0]), int(items["island"].iloc[0])
        sizes = _sorted(items)["length"].to_numpy()
        population = []
        for raw in state["people"] if len(state) else []:  # its own people and the elite that came
            population += _people(raw, len(sizes))
        got = evolve(sizes, population, capacity, seed * 1_000_003 + block * 31 + island)
        raw = np.stack(got).astype(np.int32).tobytes()
        return pd.DataFrame({"block": [block], "island": [island], "fitness": [fitness(got[0], sizes, capacity)], "people": [raw]})

    return run


def _settle(items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    names = ["item", "bin", "fill", "offset"]
    if not len(items):
        return pd.DataFrame({n: [] for n in names})
    items = _sorted(items)
    best = state.sort_values(["fitness", "island"], ascending=[False, True]).iloc[0]
    one = _people(best["people"], len(items))[0]
    sizes = items["length"].to_numpy()
    order = np.argsort(one, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    first = np.searchsorted(one[order], one[order])
    offset = np.empty(len(items), np.int64)
    offset[order] = before - before[first]
    return pd.DataFrame({"item": items["item"], "bin": int(items["block"].iloc[0]) * BLOCK_PIECES + one, "fill": fills(one, sizes)[one].astype(np.int64), "offset": offset})


def _pack(items: DataFrame, scratch: Scratch, capacity: int, seed: int) -> DataFrame:
    """(item, bin, fill, offset) of items (item, length); bins are numbered across blocks."""
    n_blocks = max(1, math.ceil(items.count() / (BLOCK_PIECES * 3 // 4)))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(n_blocks)))
    on = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = scratch.spark.createDataFrame([], STATE)
    for epoch in range(EPOCHS):
        ran = on.groupBy("block", "island").cogroup(state.groupBy("block", "island")).applyInPandas(_epoch(seed + epoch, capacity), STATE)
        own = scratch.save(ran)
        # the best of an island goes to the next one of its block
        size = F.octet_length("people") / POPULATION
        elite = own.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), "fitness", F.substring("people", F.lit(1), size.cast("int")).alias("people"))
        state = own.union(elite)
    return scratch.save(items.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_settle, "item long, bin long, fill long, offset long"))


def pack_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    ``path`` names the tokenizer file on each executor."""
    scratch = Scratch(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = picked.mapInArrow(lambda batches: batchwise(lambda b: _pieces(b, path, capacity), batches), PIECES)
    pieces = scratch.save(pieces.withColumn("item", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    packed = _pack(rest.select("item", "length"), scratch, capacity, 1)
    loose = packed.where(F.col("fill") < TAIL_FILL * capacity)
    again = _pack(loose.join(rest.select("item", "length"), "item").select("item", "length"), scratch, capacity, 2)
    before, after = (df.select("bin").distinct().count() for df in (loose, again))
    if after < before:
        shift = F.lit(1 << 61)
        packed = packed.where(F.col("fill") >= TAIL_FILL * capacity).select("item", "bin", "offset").union(again.select("item", F.col("bin") + shift, "offset"))
    placed = rest.join(packed.select("item", F.col("bin").alias("sequence_id"), "offset"), "item")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(names).union(placed.select(names))
