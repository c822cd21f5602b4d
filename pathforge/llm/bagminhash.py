"""MinHash near-dedup by BagMinHash: weighted Jaccard of word-shingle multisets.

Weights are discretised at the integers: a shingle found c times owns the unit cells 0 to
c-1.  Cells come in dyadic blocks [0,1), [1,2), [2,4), [4,8), ...; each (shingle, block) is a
Poisson process seeded by its hash whose points carry a time, a signature component and a
cell.  A point counts if its cell is below c, so a block wholly below c is taken as it comes
and only the last is thinned, and c costs O(log c) processes.  A component keeps its least
time; two multisets agree on it with probability sum(min) / sum(max) exactly.  Points are
drawn in time order up to a horizon that hits all components but rarely; a text for which
it does not is drawn again with a later one.

Candidates share a band of ROWS components.  A family of near copies shares bands in numbers
that grow with the square of its size, so pairs are never listed bucket by bucket: (1) each
text is held against the least id of its buckets, and verified links make components; (2) in
each bucket that still holds several components, members are put in the order of their
other bands, which sets the most alike side by side (an LSH forest), and each is held against
the next ones, in TURNS with other bands; (3) the buckets that hold several components even
then are compared whole: members are dealt by hash to blocks of at most BLOCK texts or
BLOCK_BYTES, the largest component apart from the others, and each pair of blocks that may
hold different components meets in one task, which verifies every such pair, a pair of several shared bands in the first of them.  So (1)
and (2) only save work: every pair that shares a band is verified, or its texts are in one
component already.  Links inside a component add nothing and are not looked for.  Each link
is verified by the exact multiset overlap.

Copies: texts with one word sequence are one text, whose id is their least.  A text of one
to four words has one shingle of all its words.  A text without words (null, empty) is alone.
Rows with a null id are left out.  Rows that repeat an id and a text count once; an id with
several texts is held against others by the greatest of them.  An empty table gives an empty
result.  Texts of any length are read whole; other columns are not read, but for ``keep_one``,
which returns them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import U, batchwise, chunks, mix64, text_bytes, windows, words_of

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 30  # a pair at 0.8 shares no band with probability 7e-6
TURNS = ((1, 1), (7, 2))  # (step to the other bands, members looked at)
PART = 1024  # members of a bucket that are ordered together
BLOCK, BLOCK_BYTES = 2048, 8 << 20  # of a bucket's members, in one side of a whole comparison
MEMBERS_A_TASK, BYTES_A_TASK = 256, 16 << 20  # texts that one task holds against one leader
_STEP = 0x9E3779B97F4A7C15


def shingle_bags(hashes: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text."""
    first, value = windows(hashes, at, size)
    text = np.searchsorted(at, first, "right") - 1
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.full(len(short), 7, U)
        for i in range(size - 1):
            has = counts[short] > i
            whole[has] = mix64(whole[has] * U(0xD6E8FEB86659FD93) + hashes[at[short[has]] + i])
        text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    runs = np.flatnonzero(new)
    return text[runs], value[runs], np.diff(np.append(runs, len(text)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _draw(out: np.ndarray, text, shingle, count, block, horizon) -> None:
    """Lower out[text, component] to the least point time of these processes."""
    m = out.shape[1]
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.where(block > 0, low, 1)
    seed = mix64(shingle + (block + 1).astype(U) * U(_STEP))
    time = np.zeros(len(seed))
    rate = 1.0 / (m * width)
    j = 1
    flat = out.reshape(-1)
    while len(seed):
        x = mix64(seed + U(j * 3 * _STEP & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(_uniform(x)) * rate
        live = time <= horizon[text]
        if not live.all():
            seed, text, count, low, width, rate, time, x = (v[live] for v in (seed, text, count, low, width, rate, time, x))
        y = mix64(x + U(_STEP))
        component = ((y >> U(32)) % U(m)).astype(np.int64)
        cell = low + ((y & U(0xFFFFFFFF)).astype(np.int64) % width)
        hit = cell < count
        np.minimum.at(flat, text[hit] * m + component[hit], time[hit])
        j += 1


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int, m: int = ROWS * BANDS) -> np.ndarray:
    """n_texts x m least times; texts without shingles keep infinity."""
    out = np.full((n_texts, m), np.inf)
    weight = np.bincount(text, count, n_texts)
    log2 = np.zeros(len(count), np.int64)
    many = count > 1
    log2[many] = np.floor(np.log2(count[many] - 1)).astype(np.int64) + 1
    row = np.repeat(np.arange(len(count)), log2 + 1)
    block = np.arange(len(row)) - np.repeat(np.cumsum(log2 + 1) - (log2 + 1), log2 + 1)
    todo = weight > 0
    reach = np.log(m) + 3
    while todo.any():
        here = todo[text[row]]
        r = row[here]
        out[todo] = np.inf
        _draw(out, text[r], shingle[r], count[r], block[here], reach / np.maximum(weight, 1))
        todo &= ~np.isfinite(out).all(axis=1)
        reach *= 2
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), -1, rows)
    key = np.broadcast_to(mix64(np.arange(bits.shape[1], dtype=U) + U(_STEP)), bits.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * U(0xD6E8FEB86659FD93) + bits[:, :, i])
    return key.view(np.int64)


SIGNED = "doc_id long, key binary, bands array<long>"


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, bands = [], []
    for _, _, data, offsets in chunks(batch.column(1), 8 << 20):
        w = words_of(data, offsets)
        n = len(offsets) - 1
        sig = signatures(*shingle_bags(w.hashes(), w.at), n)
        some = np.diff(w.at) > 0
        rows = band_keys(sig)
        bands += [r if s else None for r, s in zip(rows.tolist(), some.tolist(), strict=True)]
        plain = data.tobytes()
        for lo, hi, s in zip(offsets[:-1].tolist(), offsets[1:].tolist(), some.tolist(), strict=True):
            keys.append(xxhash.xxh3_128_digest(b" ".join(plain[lo:hi].split())) if s else None)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct shingles, counts) bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


def _bags(column) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for lo, hi, data, offsets in chunks(column):
        w = words_of(data, offsets)
        text, value, count = shingle_bags(w.hashes(), w.at)
        at = np.searchsorted(text, np.arange(hi - lo + 1))
        out += [(value[s:e], count[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
    return out


def _verify(members: pa.Table, lead: pa.Table) -> pa.Table:
    """Links of one leader (its id is column b) with some of its members (column a)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if members.num_rows == 0 or lead.num_rows == 0:
        return schema.empty_table()
    (own,) = _bags(lead.slice(0, 1).column("lead_text"))
    good = [overlap(own, x) >= THRESHOLD for x in _bags(members.column("text"))]
    return members.filter(pa.array(good)).select(["a", "b"]).cast(schema)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts overlap by the threshold.  b is the leader: its text is sent
    once for every MEMBERS_A_TASK members or BYTES_A_TASK of them, a member's once."""
    sized = pairs.join(texts.select(F.col("doc_id").alias("a"), "size"), "a")
    salts = sized.groupBy("b").agg(F.ceil(F.greatest(F.count("*") / MEMBERS_A_TASK, F.sum("size") / BYTES_A_TASK)).alias("n"))
    members = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "n"))
    members = members.join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "b", "salt", "text")
    leads = salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(texts.withColumnRenamed("doc_id", "b"), "b")
    leads = leads.select("b", F.col("salt").cast("long"), "text").toDF("lead", "part", "lead_text")
    return members.groupBy("b", "salt").cogroup(leads.groupBy("lead", "part")).applyInArrow(_verify, "a long, b long")


def _whole(block: pa.Table) -> pa.Table:
    """Links between different components among the members (side, band, rep, root, bands, text)
    of two blocks of a bucket, or of one block (all of side 0).  Once a link is found its two
    components are one; pairs that share an earlier band are left to that band's bucket."""
    n, band = block.num_rows, block.column("band")[0].as_py()
    root = np.unique(block.column("root").to_numpy(), return_inverse=True)[1]
    bags = _bags(block.column("text"))
    # a shingle found c times is c elements, so the multiset overlap is a count of common elements
    sizes = np.array([int(c.sum()) for _, c in bags])
    value = np.concatenate([np.repeat(v, c) for v, c in bags])
    copy = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in bags])
    element = np.unique(mix64(value + copy.astype(U) * U(_STEP)), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    side = block.column("side").to_numpy()
    bands = np.array(block.column("bands").to_pylist(), np.int64)[:, :band]
    held = np.zeros(int(element.max()) + 1, bool)
    two = bool(side.any())
    a, b = [], []
    for i in np.flatnonzero(side == 0) if two else range(n):
        near = np.flatnonzero((side == 1 if two else np.arange(n) > i) & (root != root[i]))
        near = near[np.minimum(sizes[near], sizes[i]) >= THRESHOLD * np.maximum(sizes[near], sizes[i]) - 1e-9]
        near = near[~(bands[near] == bands[i]).any(axis=1)]
        if not len(near):
            continue
        own = element[at[i] : at[i + 1]]
        held[own] = True
        ends = np.cumsum(sizes[near])
        common = held[element[np.repeat(at[near] - ends + sizes[near], sizes[near]) + np.arange(ends[-1])]]
        both = np.add.reduceat(common.astype(np.int64), ends - sizes[near])
        held[own] = False
        for j in near[both / (sizes[near] + sizes[i] - both) >= THRESHOLD].tolist():
            if root[j] != root[i]:
                a.append(i), b.append(j)
                root[root == root[j]] = root[i]
    rep = block.column("rep")
    return pa.table({"a": rep.take(pa.array(a, pa.int64())), "b": rep.take(pa.array(b, pa.int64()))})


def _compared_whole(rows: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the components of every bucket of ``rows`` (key, band, rep, root)."""
    sized = rows.join(texts.select(F.col("doc_id").alias("rep"), "size"), "rep")
    parts = sized.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = F.max(F.struct("n", "size", "root"))  # of the largest component, whose members need not meet each other
    blocks = parts.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    need = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    one = need(F.col("n"), F.col("size")) == 1
    blocks = blocks.select(
        "key", F.when(~one, F.col("main.root")).alias("main"), F.when(one, 0).otherwise(need(F.col("main.n"), F.col("main.size"))).alias("mains"),
        F.when(one, 1).otherwise(need(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))).alias("others"),
    )
    # blocks 0 to others - 1 hold the other components' members, the next ones the main one's
    in_main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    dealt = rows.join(blocks, "key").withColumn("own", F.when(in_main, F.col("others") + spot("mains")).otherwise(spot("others")))
    last = F.col("others") - 1 + F.when(in_main, 0).otherwise(F.col("mains"))
    dealt = dealt.select("key", "band", "rep", "root", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "band", "rep", "root")
    full = dealt.join(reps.select("rep", "bands"), "rep").join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return full.groupBy("key", "i", "j").applyInArrow(_whole, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rep_id, class_id) for each distinct id: the least id with its word sequence, and
    the least id of its class of near copies."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = scratch.save(docs.mapInArrow(lambda batches: batchwise(_sign, batches), SIGNED))
    # one aggregation finds each text's least id and that row's bands
    reps = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("m"))
    reps = scratch.save(reps.select("key", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")))
    copies = reps.select("key", "rep")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("h").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("h", "lead")
    members = scratch.save(banded.join(shared, "h").select("h", "band", "rep", "lead"))
    texts = scratch.save(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")).withColumn("size", F.octet_length("text").cast("long")))

    def apart(roots: DataFrame) -> DataFrame:
        """Rows (key, band, rep, root, n) of the buckets that hold several components."""
        placed = members.join(roots, members["rep"] == roots["node"], "left").select(F.col("h").alias("key"), "band", "rep", F.coalesce("root", "rep").alias("root"))
        split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
        return placed.join(split, "key")

    def neighbours(rows: DataFrame, turn: int, reach: int) -> DataFrame:
        """Pairs of different components that are near in a bucket's order by other bands."""
        other = [F.get(F.col("bands"), F.pmod(F.col("band") + turn * i, F.lit(BANDS)).cast("int")) for i in (1, 2, 3)]
        rows = rows.join(reps.select(F.col("rep").alias("r"), "bands"), F.col("rep") == F.col("r")).select("key", "rep", "root", F.array(*other).alias("near"), F.pmod(other[0], F.ceil(F.col("n") / PART)).alias("part"))
        order = Window.partitionBy("key", "part").orderBy("near", "rep")
        after = F.array(*[F.struct(F.lead("rep", i).over(order).alias("rep"), F.lead("root", i).over(order).alias("root")) for i in range(1, reach + 1)])
        met = rows.select("rep", F.transform(F.filter(after, lambda x: x["root"] != F.col("root")), lambda x: x["rep"]).alias("after")).where(F.size("after") > 0)
        # two texts meet in many bands: a text's neighbours (at most BANDS x reach) are made distinct as one array
        once = met.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("after"))).alias("after")).select("rep", F.explode("after").alias("x"))
        return once.select(F.greatest("rep", "x").alias("a"), F.least("rep", "x").alias("b")).distinct()

    tried = scratch.save(members.groupBy(F.col("rep").alias("a")).agg(F.min("lead").alias("b")).where("b < a"))
    links = scratch.save(_verified(tried, texts))
    roots, met = components(links, scratch), 1
    for turn, reach in TURNS:
        rows = scratch.save(apart(roots))
        if rows.isEmpty():
            break
        pairs = scratch.save(neighbours(rows, turn, reach).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        links = links.union(scratch.save(_verified(pairs, texts)))
        roots, met = components(links, scratch), reach + 1
    # a bucket up to the last reach has been compared whole by the last turn
    rows = scratch.save(apart(roots).where(F.col("n") > met).select("key", "band", "rep", "root"))
    if not rows.isEmpty():
        links = links.union(scratch.save(_compared_whole(rows, reps, texts)))
        roots = components(links, scratch)

    placed = copies.join(roots, copies["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "key").join(placed, "key", "left")
    return out.groupBy("doc_id").agg(F.min(F.coalesce("rep", "doc_id")).alias("rep_id"), F.min(F.coalesce("root", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its class's least, with all columns; null ids stay.  Of
    rows that repeat an id and a text one stays."""
    classes = near_duplicates(docs, id_col, text_col)
    gone = classes.where("class_id < doc_id").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return kept  # no id repeats, so the texts need no second shuffle
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]))
