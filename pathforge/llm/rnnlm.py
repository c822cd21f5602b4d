"""LM scoring by a gated recurrent network trained here, in numpy.

Tokens are a text's words with A-Z in lower case, then one end.  Documents whose crc32 of the
id as text is not 0 modulo 10 are learnt from; the others, and null ids, are held out.

Counts: tasks count words (by a 64-bit hash) before the shuffle, so N, V and each word's c
cover all training documents.  The ``HEAD`` most frequent words go to every task; a text's
other words are joined with the counts in a shuffle, which grows with the corpus.

Model: a GRU reads the ``CLASSES * WIDTH - 2`` most frequent words, the end and one symbol
for all other words, and predicts through a class-factored softmax: the class, then the word
within it.  An other word has the symbol's probability times its share of the other words'
smoothed counts, so the model is a distribution over all texts.  Training is truncated
backpropagation over windows of ``STEPS`` tokens; a lane's state passes from window to window
and is cleared where a document begins.  Documents are dealt by hash to one of ``ROUNDS``
rounds and to one of its replicas of about ``REPLICA_TOKENS`` tokens, whose number follows
from the training tokens and not from partitions.  Each replica trains on its documents in
the order of their hashes, and Spark averages a round's replicas by tokens, so one table gives
one model however it is partitioned.  Documents of more than ``PIECE`` tokens are learnt in
pieces.

Scoring runs lanes of documents in lockstep, each document whole, and sums log10
probabilities; memory follows the tokens of a chunk, whatever a document's length.  Null text:
empty, so one token.  Repeated rows are scored, and learnt from, each.  An empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import U, chunks, mix64, words_of

SMOOTH = 0.1
FOLDS = 10
HEAD = 1 << 18
STEPS_PER_OCTAVE = 16
CLASSES, WIDTH = 32, 32
HIDDEN = 24
LANES, STEPS = 256, 32
PIECE = 8192  # tokens of a document that are learnt in one run
REPLICA_TOKENS = 4_000_000
RATE = 0.05
ROUNDS = 2
CHUNK = 20 << 20
END, OTHER = 0, 1
END_HASH = -0x5851F42D4C957F2D

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, at): the tokens of each text, its end included, as signed hashes."""
    w = words_of(_LOWER[data], offsets)
    n = len(offsets) - 1
    out = np.empty(len(w.starts) + n, np.int64)
    at = w.at + np.arange(n + 1)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end] = END_HASH
    out[~is_end] = mix64(w.hashes() + U(3)).view(np.int64)
    return out, at


class Vocabulary:
    """The head words by hash: counts and, for the most frequent, the model's symbols."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        rank = np.lexsort((hashes, -counts))
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.symbols = np.full(len(hashes), OTHER, np.int64)
        words = np.flatnonzero(hashes != END_HASH)
        words = words[np.argsort(place[words])][: CLASSES * WIDTH - 2]
        symbol = np.full(len(hashes), OTHER, np.int64)
        symbol[words] = np.arange(len(words)) + 2
        symbol[hashes == END_HASH] = END
        self.symbols = symbol[order]
        self.norm = total + SMOOTH * (distinct + 1)
        known = self.counts[self.symbols != OTHER]
        # the end has a symbol even if nothing was learnt from
        none = END_HASH not in set(hashes.tolist())
        self.other_log = np.log10((self.norm - known.sum() - SMOOTH * (len(known))) / self.norm) if self.norm - known.sum() - SMOOTH * len(known) > 1e-12 else 0.0
        self.unigram = np.full(CLASSES * WIDTH, 0.0)
        self.unigram[self.symbols[self.symbols != OTHER]] = known
        self.unigram[OTHER] = max(total - known.sum(), 0)
        if none:
            self.unigram[END] = 0
        self.table, self.shift = _table(self.hashes)
        known_at = np.flatnonzero(self.symbols != OTHER)
        self.few, self.few_symbols = self.hashes[known_at], self.symbols[known_at]
        self.few_table, self.few_shift = _table(self.few)

    def find(self, tokens_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head or -1, symbol) of each token."""
        place = _find(self.hashes, self.table, self.shift, tokens_)
        symbol = np.append(self.symbols, OTHER)[place]
        symbol[tokens_ == END_HASH] = END
        return place, symbol

    def symbols_of(self, tokens_: np.ndarray) -> np.ndarray:
        """The symbol of each token."""
        symbol = np.append(self.few_symbols, OTHER)[_find(self.few, self.few_table, self.few_shift, tokens_)]
        symbol[tokens_ == END_HASH] = END
        return symbol


def _table(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Slots of a table of at least four times as many, each the place of a hash or -1; a hash
    is in the first free slot from that of its high bits on."""
    bits = max(4, int(4 * len(hashes)).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    slot, todo = hashes.view(U) >> U(64 - bits), np.arange(len(hashes), dtype=np.int32)
    slot = slot.astype(np.int64)
    while len(todo):
        free = table[slot[todo]] < 0
        table[slot[todo[free]]] = todo[free]  # of several one stays
        todo = todo[table[slot[todo]] != todo]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return table, 64 - bits


def _find(hashes: np.ndarray, table: np.ndarray, shift: int, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted hash, or -1."""
    slot = (wanted.view(U) >> U(shift)).astype(np.int64)
    place = table[slot]
    todo = np.flatnonzero(place >= 0)
    todo = todo[hashes[place[todo]] != wanted[todo]]
    while len(todo):  # on from slots that other hashes hold
        slot[todo] = (slot[todo] + 1) & (len(table) - 1)
        place[todo] = table[slot[todo]]
        todo = todo[place[todo] >= 0]
        todo = todo[hashes[place[todo]] != wanted[todo]]
    return place


class Gru:
    """The network; all parameters are views of one float32 vector."""

    SHAPES = {
        "x": (CLASSES * WIDTH, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
        "ww": (CLASSES, HIDDEN, WIDTH), "bw": (CLASSES, WIDTH),
    }
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat = np.ascontiguousarray(flat, np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, unigram: np.ndarray, seed: int = 1) -> Gru:
        """Small random weights, and biases that give the symbols' frequencies."""
        net = cls(np.random.default_rng(seed).normal(0, 0.1, cls.SIZE))
        p = (unigram + 0.5).reshape(WIDTH, CLASSES).T  # symbol s is word s // CLASSES of class s % CLASSES
        net.bc[:] = np.log(p.sum(axis=1) / p.sum())
        net.bw[:] = np.log(p / p.sum(axis=1, keepdims=True))
        return net

    def steps(self, symbols: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step (steps x HIDDEN x lanes), from input symbols (steps x lanes); h
        is the state before.  Lanes lie side by side, so every operation runs along memory."""
        n = HIDDEN
        out = np.empty((len(symbols), n, symbols.shape[1]), np.float32)
        x_all, u, starts = np.ascontiguousarray(self.x[symbols].transpose(0, 2, 1)), np.ascontiguousarray(self.u.T), fresh.any(axis=1)
        for t, x in enumerate(x_all):
            if starts[t]:
                h = h * ~fresh[t]
            a = u @ h
            gate, c = x[: 2 * n], x[2 * n :]
            gate += a[: 2 * n]
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            r, z, a = gate[:n], gate[n:], a[2 * n :]
            c += r * a
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep is not None:
                keep.append((h, r, z, c, a))
            h = new
        return out

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of flat targets, from their states (tokens x HIDDEN); with
        ``grads``, adds the loss's gradients (summed over tokens) and returns that of the states."""
        cls, word = (targets % CLASSES).astype(np.uint8), targets // CLASSES
        order = np.argsort(cls, kind="stable")  # tokens of a class side by side
        states, cls, word = states[order], cls[order], word[order]
        found, d_states = self._softmax(states, cls, self.wc, self.bc, grads and (grads["wc"], grads["bc"]))
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if lo < hi:
                here, d = self._softmax(states[lo:hi], word[lo:hi], self.ww[c], self.bw[c], grads and (grads["ww"][c], grads["bw"][c]))
                found[lo:hi] += here
                if grads:
                    d_states[lo:hi] += d
        out = np.empty_like(found)
        out[order] = found
        if not grads:
            return out, None
        d_out = np.empty_like(d_states)
        d_out[order] = d_states
        return out, d_out

    @staticmethod
    def _softmax(states, target, weights, bias, grads) -> tuple[np.ndarray, np.ndarray | None]:
        e = weights.T @ states.T
        e += bias[:, None]
        e -= e.max(axis=0)
        at = np.arange(len(target))
        found = e[target, at]
        np.exp(e, out=e)
        total = e.sum(axis=0)
        found -= np.log(total)
        if not grads:
            return found, None
        e /= total
        e[target, at] -= 1
        grads[0][...] += (e @ states).T
        grads[1][...] += e.sum(axis=1)
        return found, e.T @ weights.T


class Lanes:
    """Documents dealt to lanes, long ones first; lanes are ordered by falling load.  A lane's
    tokens lie side by side, and a window is gathered when it is read, so memory follows the
    tokens however long a document is."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, lanes: int = LANES):
        sizes = np.diff(at)
        heap = [(0, i) for i in range(min(lanes, max(1, len(sizes))))]
        lane_of = np.empty(len(sizes), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for d, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
            load, lane = heap[0]
            lane_of[d] = lane
            heapq.heapreplace(heap, (load + size, lane))
        loads = np.zeros(len(heap), np.int64)
        for load, lane in heap:
            loads[lane] = load
        rank = np.argsort(-loads, kind="stable")
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        self.loads = loads[rank]
        self.begin = np.cumsum(self.loads) - self.loads
        docs = order[np.argsort(number[lane_of[order]], kind="stable")]  # lane by lane, as they were dealt
        size = sizes[docs]
        first = np.cumsum(size) - size
        self.place = np.repeat(at[:-1][docs] - first, size) + np.arange(len(symbols))  # of each lane token among the symbols
        self.target = symbols[self.place].astype(np.int32)
        self.fresh = np.zeros(len(symbols), bool)
        self.fresh[first[size > 0]] = True
        self.input = np.empty_like(self.target)
        self.input[1:] = self.target[:-1]
        self.input[self.fresh] = END

    def windows(self, steps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(lanes that go on, places, which of them are tokens), places being steps x lanes."""
        for t in range(0, int(self.loads[0]) if len(self.loads) else 0, steps):
            live = int((self.loads > t).sum())
            row = np.arange(t, min(t + steps, int(self.loads[0])))[:, None]
            real = row < self.loads[:live]
            yield live, np.where(real, self.begin[:live] + row, 0), real


class Trainer:
    """Truncated backpropagation with Adagrad."""

    def __init__(self, net: Gru):
        self.net, self.seen = net, 0
        self.square = np.full(Gru.SIZE, 1e-8, np.float32)

    def learn(self, symbols: np.ndarray, at: np.ndarray) -> None:
        """One pass.  A document of more than PIECE tokens is learnt in pieces, so that no lane is
        left alone; scoring reads it whole."""
        cuts = -(-np.diff(at) // PIECE)
        if (cuts > 1).any():
            piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            at = np.append(np.repeat(at[:-1], cuts) + piece * PIECE, at[-1])
        lanes = Lanes(symbols, at)
        h = np.zeros((HIDDEN, len(lanes.loads)), np.float32)
        for live, place, real in lanes.windows(STEPS):
            h = self._window(lanes.input[place], lanes.target[place], lanes.fresh[place] & real, real, h[:, :live])
        self.seen += len(symbols)

    def _window(self, inputs, targets, fresh, real, h) -> np.ndarray:
        net, n = self.net, HIDDEN
        kept: list = []
        states = net.steps(inputs, fresh, h, kept)
        flat = np.zeros(Gru.SIZE, np.float32)
        grads = Gru(flat)
        g = {k: getattr(grads, k) for k in Gru.SHAPES}
        starts = fresh.any(axis=1)
        _, d_real = net.log_probs(states.transpose(0, 2, 1)[real], targets[real].astype(np.int64), g)
        d_states = np.zeros((*inputs.shape, n), np.float32)
        d_states[real] = d_real
        d_states = np.ascontiguousarray(d_states.transpose(0, 2, 1))
        d_x = np.empty((len(inputs), 3 * n, inputs.shape[1]), np.float32)
        d_a = np.empty((3 * n, inputs.shape[1]), np.float32)
        d_h = np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            before, r, z, c, a = kept[t]
            d = d_states[t]
            d += d_h
            rest = 1 - z
            d_r, d_z, d_c = d_x[t, :n], d_x[t, n : 2 * n], d_x[t, 2 * n :]
            np.multiply(d, rest, out=d_c)
            d_c *= 1 - c * c
            np.multiply(d_c, r, out=d_a[2 * n :])
            np.multiply(d_a[2 * n :], a, out=d_r)
            d_r *= 1 - r
            np.subtract(before, c, out=d_z)
            d_z *= d
            d_z *= z
            d_z *= rest
            d_a[: 2 * n] = d_x[t, : 2 * n]
            g["u"] += before @ d_a.T
            d *= z
            d_h = net.u @ d_a
            d_h += d
            if starts[t]:
                d_h *= ~fresh[t]
        ids = inputs.ravel()  # where there is no token the gradient is 0
        for j in range(3 * n):
            g["x"][:, j] += np.bincount(ids, d_x[:, j].ravel(), CLASSES * WIDTH)
        flat /= max(int(real.sum()), 1)
        self.square += flat * flat
        net.flat -= RATE * flat / np.sqrt(self.square)
        return states[-1]


def score_lanes(net: Gru, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of every symbol in its document."""
    lanes = Lanes(symbols, at)
    found = np.empty(len(symbols), np.float32)
    h = np.zeros((HIDDEN, len(lanes.loads)), np.float32)
    for live, place, real in lanes.windows(STEPS):
        states = net.steps(lanes.input[place], lanes.fresh[place] & real, h[:, :live])
        h = states[-1]
        at_real = place[real]
        found[lanes.place[at_real]] = net.log_probs(states.transpose(0, 2, 1)[real], lanes.target[at_real].astype(np.int64))[0]
    return found.astype(np.float64) / np.log(10)


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for _, _, data, offsets in chunks(batch.column(0), CHUNK):
        value, n = np.unique(tokens(data, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["h", "n"])


REPLICA = "i int, w double, n long"


def _train(vocabulary: Vocabulary, flat: np.ndarray):
    return lambda group: _replica(group, vocabulary, flat)


def _replica(group: pa.Table, vocabulary: Vocabulary, flat: np.ndarray) -> pa.Table:
    """The parameters of one replica, times the tokens it learnt from.  Its documents (key,
    text) are read by key, so that their order does not depend on how they came."""
    trainer = Trainer(Gru(flat.copy()))
    for _, _, data, offsets in chunks(group.sort_by("key").column("text"), CHUNK):
        found, at = tokens(data, offsets)
        trainer.learn(vocabulary.symbols_of(found), at)
    n = Gru.SIZE
    return pa.table({"i": pa.array(np.arange(n, dtype=np.int32)), "w": pa.array(trainer.net.flat.astype(np.float64) * trainer.seen), "n": pa.array(np.full(n, trainer.seen, np.int64))})


SCORED = "doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, head_score double, rest array<long>"


def _score(batch: pa.RecordBatch, vocabulary: Vocabulary, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    net = Gru(flat)
    for lo, hi, data, offsets in chunks(batch.column(2), CHUNK):
        found, at = tokens(data, offsets)
        place, symbol = vocabulary.find(found)
        model = score_lanes(net, symbol, at)
        head = place >= 0
        end = ~head & (found == END_HASH)  # nothing was learnt from
        count = np.where(head, vocabulary.counts[place] if len(vocabulary.counts) else 0, 0)
        base = np.where(head | end, np.log10((count + SMOOTH) / vocabulary.norm), 0.0)
        model += np.where(symbol == OTHER, base - vocabulary.other_log, 0.0)
        sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), base, model)]
        rest = ~head & ~end
        rest_at = np.concatenate([[0], np.cumsum(rest)])[at].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at)), *map(pa.array, sums), pa.ListArray.from_arrays(rest_at, pa.array(found[rest]))],
            names=[f.split()[0] for f in SCORED.split(", ")],
        )


def _each(function, *fixed):
    return lambda batches: (out for batch in batches for out in function(batch, *fixed))


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    scratch = Scratch(docs.sparkSession)
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(True))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learnt = docs.where("not held_out")
    counts = learnt.select("text").mapInArrow(_each(_count), "h long, n long")
    counts = scratch.save(counts.groupBy("h").agg(F.sum("n").alias("c")))
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = whole[0] or 0, whole[1]
    # the head is every word from a step of frequency on, found by a histogram of fixed size, so
    # no task sends more than its share of at most HEAD rows; the symbols are always among it
    step = F.floor(F.log2("c") * STEPS_PER_OCTAVE).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    within = int((np.cumsum([n for _, n in sizes]) <= HEAD).sum())
    symbols = counts.orderBy(F.desc("c"), "h").limit(CLASSES * WIDTH)
    top = counts.where((F.col("h") == END_HASH) | ((step >= sizes[within - 1][0]) if within else F.lit(False))).unionByName(symbols).toPandas().drop_duplicates("h")
    vocabulary = Vocabulary(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64), total, distinct)

    flat = Gru.fresh(vocabulary.unigram).flat
    replicas = max(1, -(-total // (REPLICA_TOKENS * rounds)))
    keyed = learnt.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    for r in range(rounds):
        share = keyed.where(F.pmod("key", F.lit(rounds)) == r).withColumn("replica", F.pmod(F.xxhash64("key"), F.lit(replicas)))
        parts = share.groupBy("replica").applyInArrow(_train(vocabulary, flat), REPLICA)
        mean = parts.groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()  # a row a parameter
        if len(mean):
            flat = np.empty(Gru.SIZE, np.float32)
            flat[mean["i"].to_numpy()] = mean["w"].to_numpy()

    scored = scratch.save(docs.mapInArrow(_each(_score, vocabulary, flat), SCORED).withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n")).join(counts, "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = rest.groupBy("row").agg(
        F.sum("n").alias("rest_n"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("n") * F.log10((c + SMOOTH) / F.lit(float(vocabulary.norm)))).alias("rest_base"),
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + zero("rest_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("rest_base")).alias("base_score"),
        (F.col("head_score") + zero("rest_base") - zero("rest_n") * F.lit(float(vocabulary.other_log))).alias("score"),
    )
