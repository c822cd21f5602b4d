import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathforge.llm import bagminhash, decontam, fst_tokens, quality, rnnlm, substring_dedup
from pathforge.llm.queries import tokenizer_file
from pathforge.llm.words import text_bytes, words_of

from .helpers import ODD, contained, cut_passages, near_classes, words

SCHEMA = "doc_id long, text string"


def make(spark, rows, clash=()):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\xa0é", max_size=30)), max_size=6))
def test_words_are_the_pattern(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    w = words_of(data, offsets)
    raw = data.tobytes()
    got = [[raw[w.starts[k] : w.ends[k]].decode() for k in range(a, b)] for a, b in zip(w.at[:-1], w.at[1:], strict=True)]
    assert got == [words(t) for t in texts]
    hashes, seen = w.hashes().tolist(), {}
    for word, h in zip([x for ws in got for x in ws], hashes, strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def base_counts(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(3)
    noise = "".join(chr(33 + rng.randrange(90)) + (" " if rng.random() < 0.1 else "") for _ in range(6000))
    rows = [*ODD, (10, prose(rng, 400)), (11, "spam and eggs " * 300), (12, noise), (13, "x y z\nx y z\n\nx y z " + prose(rng, 80)), (14, prose(rng, 20_000, 3000))]
    got = quality.score_quality(make(spark, rows, ["n_words", "kept"])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(i), *base_counts(t)) for i, t in rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        n, *_, rep = base_counts(text)
        assert by[i].base_failed == (n < 50 or 100 * rep > 50 * n) or i == 4
        raw = (text or "").encode()
        if len(raw) >= quality.LEAST_BYTES:
            assert by[i].ratio == len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)
    assert by[10].kept and by[14].kept and not by[11].kept and not by[12].kept and not by[1].kept
    docs = make(spark, rows, ["n_words"])
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_every_byte_of_a_text_stands_in_a_chunk():
    press = zstandard.ZstdCompressor(level=3).compress
    rng = random.Random(5)
    size = quality.CHUNK_BYTES
    for n in (0, 127, size - 1, size, size + 1, 2 * size - 1, 2 * size, 5 * size + 77):
        starts = quality.chunk_starts(n)
        assert set().union(*(range(i, i + size) for i in starts)) == (set(range(n)) if n >= size else set())
    clean = prose(rng, 20_000, 3000).encode()
    clean = clean[: 3 * size]
    low, high = quality.band(len(clean) + size - 1)
    spoilt = clean + b"ab " * ((size - 1) // 3)  # less than a chunk, behind the last whole one
    ratio, n, bad, kept = quality.compression(spoilt, press)
    rates = [len(press(spoilt[i : i + size])) / size for i in (0, size, 2 * size, len(spoilt) - size)]
    assert (n, bad) == (4, sum(not quality.CHUNK_LIMITS[0] <= r <= quality.CHUNK_LIMITS[1] for r in rates)) and rates[-1] < 0.2
    assert kept == (low <= ratio <= high and bad <= quality.BAD_CHUNK_SHARE * 4)


def test_compression_parts_labelled_junk_from_clean_text(spark):
    top = "/root/testdata/sf0.1"
    judged = quality.score_quality(spark.read.parquet(f"{top}/documents.parquet")).join(spark.read.parquet(f"{top}/labels.parquet").select("doc_id", "quality"), "doc_id")
    judged = judged.where("not base_failed").withColumn("size", F.col("word_chars") + F.col("n_words")).collect()
    assert all(r.kept for r in judged if r.quality == 1)
    poor = [r for r in judged if r.quality == 0]
    assert not any(r.kept for r in poor if r.size >= 4200)
    assert sum(not r.kept for r in poor) > 100


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = [(i, " ".join([prose(rng, rng.randrange(5, 40)), *([passage[rng.randrange(40) :]] if i % 3 == 0 else []), prose(rng, 9)])) for i in range(40)]
    rows += [(50, rows[0][1]), (51, edited(rng, rows[3][1], 2)), (52, "same " * 40), (53, "same " * 30), (54, passage * 2 + prose(rng, 30_000))]
    rng.shuffle(rows)
    odd = [(-1 - k, t) for k, (_, t) in enumerate(ODD)] + [(None, passage)]
    df = make(spark, rows + odd, ["kept_text", "lang", "_block"])
    out = substring_dedup.dedup_substrings(df, block_bytes=3000, bucket_bytes=5000)
    assert "lang" in out.columns
    want = cut_passages(rows + odd)
    got = out.collect()
    assert len(got) == len(rows + odd)
    for r in got:
        kept, gone = want[r.doc_id]
        spans = [False] * len(gone)
        for s in r.spans:
            spans[s.start : s.end] = [True] * (s.end - s.start)
        assert (r.n_words, r.n_removed, r.kept_text, spans) == (len(gone), sum(gone), " ".join(kept), gone)
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="cover"):
        substring_dedup.check_cover((0, 1), 7)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    a, b = {}, {}
    for x in rng.integers(0, 2**63, 120):
        a[int(x)], b[int(x)] = int(rng.integers(0, 9)), int(rng.integers(0, 9))
    keys = sorted(a)
    jaccard = sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)
    rows = [(t, k, bag[k]) for t, bag in enumerate((a, b)) for k in keys if bag[k]]
    text, shingle, count = (np.array(c) for c in zip(*rows, strict=True))
    m = 4000
    sig = bagminhash.signatures(text, shingle.astype(np.uint64), count, 2, m)
    assert np.isfinite(sig).all()
    assert abs((sig[0] == sig[1]).mean() - jaccard) < 4 * math.sqrt(jaccard * (1 - jaccard) / m)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for f in range(6):
        text = prose(rng, 120, 2000)
        family = [text]
        for _ in range(14):
            family.append(edited(rng, rng.choice(family), rng.randrange(1, 6)))
        rows += [(f * 100 + i, t) for i, t in enumerate(family)]
    rows += [(900, rows[0][1]), (901, rows[0][1].replace(" ", "\n")), (902, "short one"), (903, "short one"), *[(i and i + 910, t) for i, t in ODD]]
    df = make(spark, rows, ["class_id", "key"])
    got = {r.doc_id: (r.rep_id, r.class_id) for r in bagminhash.near_duplicates(df).collect()}
    assert got == near_classes(rows)
    kept = bagminhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in got.values()})
    assert kept.where("doc_id is null").count() == 1
    assert bagminhash.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_in_a_family_just_under_the_threshold(spark, monkeypatch):
    rng = random.Random(17)
    base = prose(rng, 150, 20_000)
    rows = []
    for i in range(250):  # pairs of near copies; texts of different pairs share bands, but rarely overlap enough
        one = edited(rng, base, 3)
        rows += [(2 * i, one), (2 * i + 1, edited(rng, one, 3))]
    rng.shuffle(rows)
    want = near_classes(rows)
    assert len({c for _, c in want.values()}) > 100
    # the order within buckets only saves work: a poorer one finds the same classes
    monkeypatch.setattr(bagminhash, "TURNS", ((1, 1),))
    monkeypatch.setattr(bagminhash, "BLOCK", 40, raising=False)
    assert {r.doc_id: (r.rep_id, r.class_id) for r in bagminhash.near_duplicates(make(spark, rows)).collect()} == want


ODD_TEXTS = [
    "", "  ", "I'll don't can't''s 's'sx '' 'll'llx 're'", "a1b22 3.5", "<|endoftext|>hi<|startoftext|> <|endoftext", "ÀÉİΣΑΣ ß éx", "日本語のテキスト, 한국어 🙂🙂!!", "x" * 700,
    "ab" * 900 + " z", "!" * 600, "  \x1c\x1dq\x85r", "١٢٣ ²½Ⅷ", "don’t it's", "'" + "s" * 300, "\x00\x01 ﻿",
]


def library_counts(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def all_pairs_classes(rows):
    """{doc_id: class_id} from the overlap of all pairs, as one product of matrices."""
    grams = [Counter(zip(*(words(t)[k:] for k in range(5)), strict=False)) for _, t in rows]
    number = {}
    for g in grams:
        for x, n in g.items():
            for i in range(n):
                number.setdefault((x, i), len(number))
    held = np.zeros((len(rows), len(number)), np.float32)
    for r, g in enumerate(grams):
        held[r, [number[x, i] for x, n in g.items() for i in range(n)]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size - both) - 1e-4
    least = np.array([i for i, _ in rows])
    while True:
        new = np.where(near, least, least.max()).min(axis=1)
        if (new == least).all():
            return {i: int(c) for (i, _), c in zip(rows, least, strict=True)}, int(np.triu(near, 1).sum())
        least = new


@pytest.mark.parametrize("kind", ["template", "dense"])
def test_near_copies_of_one_template_match_all_pairs(spark, kind):
    """Texts that share all but a few words fall into the same large buckets; few or most of
    their pairs are links."""
    rng = random.Random(11)
    base = prose(rng, 150, 5000)
    rows = []
    for i in range(300):
        text = edited(rng, base, 3 if kind == "template" else 2)
        rows.append((10 * i, text))
        if kind == "template":
            rows += [(10 * i + 1, edited(rng, text, 2)), (10 * i + 2, edited(rng, text, 3))]
    want, links = all_pairs_classes(rows)
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(make(spark, rows)).collect()}
    assert links > 300
    assert got == want


def test_transducer_counts_as_the_library(spark):
    path = tokenizer_file("word_bpe_49k.json")
    texts = [t or "" for t in ODD_TEXTS] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    assert fst_tokens.count_tokens(texts, path).tolist() == library_counts(texts)
    got = fst_tokens.token_table(make(spark, ODD, ["n_tokens"]), path, limit=2).collect()
    want = library_counts([t or "" for _, t in ODD])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), n, n > 2) for (i, t), n in zip(ODD, want, strict=True))
    assert fst_tokens.token_table(make(spark, ODD).limit(0), path).count() == 0


@pytest.mark.parametrize("few", [0, 2, 64])
def test_transducer_on_words_that_fill_stripes(monkeypatch, few):
    monkeypatch.setattr(fst_tokens, "FEW", few)
    rng = random.Random(8)
    texts = []
    for n in (254, 255, 256, 257, 511, 512, 513, 3000, 20_000):
        word = "".join(rng.choice("etaoinshrdlué") for _ in range(n))
        texts += [word, f"{word} {word}", f" {word[:7]} {word}!{word[:300]}\n", "x" * n]
    assert fst_tokens.count_tokens(texts, tokenizer_file("word_bpe_49k.json")).tolist() == library_counts(texts)


def test_transducer_time_follows_the_length_of_a_word():
    word = "abcdefghij" * 100_000
    began = time.process_time()
    assert fst_tokens.count_tokens([word], tokenizer_file("word_bpe_49k.json")).tolist() == library_counts([word])
    assert time.process_time() - began < 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcstrevlmd'’ 12!?.,éÉß \n<|>日")), max_size=60), min_size=1, max_size=5))
def test_transducer_on_any_text(texts):
    assert fst_tokens.count_tokens(texts, tokenizer_file("word_bpe_49k.json")).tolist() == library_counts(texts)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(4, 60), 3000)) for i in range(30)] + [(3, None), (None, prose(rng, 20)), (4, "")]
    docs = [(i, prose(rng, 300, 3000)) for i in range(25)]
    docs += [(100 + i, f"{prose(rng, 500)} {edited(rng, t, k)} {prose(rng, 90)}") for i, (_, t) in enumerate(items[:12]) for k in (0,)]
    docs += [(200 + i, f"{prose(rng, 50)}\n{edited(rng, t, 1 + i % 3)}\n") for i, (_, t) in enumerate(items[12:24])] + [*ODD[:4], docs[30]]
    item_df = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))
    df = make(spark, docs, ["h", "w", "item_id", "_gone"])
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontam.contained_items(df, item_df).collect()}
    assert got == contained(docs, items)
    assert len(got) > 12
    kept = decontam.drop_contaminated(df, item_df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in got})
    assert decontam.contained_items(df.limit(0), item_df).count() == 0
    assert decontam.contained_items(df, item_df.limit(0)).count() == 0


def test_language_model_base_and_distribution(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the cat sat", "a dog ran", "The end"]) for _ in range(rng.randrange(1, 60)))) for i in range(1000, 1120)]
    rows += [(2001, "unseen words here"), (2101, "zebra " * 3), *ODD[1:4], (None, "the cat")]
    got = rnnlm.score_texts(make(spark, rows, ["score"])).collect()
    assert len(got) == len(rows)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = lambda t: [*words((t or "").translate(lower)), None]
    count = Counter(x for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for x in tokens(t))
    n, v = sum(count.values()), len(count)
    by = {i: t for i, t in rows}
    for r in got:
        t = tokens(by[r.doc_id])
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        held = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(t), sum(count[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # held-out texts are better predicted
    assert rnnlm.score_texts(make(spark, rows).limit(0)).count() == 0


def test_language_model_counts_with_an_empty_head(spark, monkeypatch):
    monkeypatch.setattr(rnnlm, "HEAD", 0)  # as if the first step of frequency were larger than it
    test_language_model_base_and_distribution(spark)


def test_language_model_is_not_shrunk_to_a_budget():
    assert rnnlm.HIDDEN >= 24 and (rnnlm.CLASSES, rnnlm.WIDTH) == (32, 32)


def scalar_scores(net, symbols):
    """log10 probabilities of one document's symbols, with plain numbers."""
    n, classes, width = rnnlm.HIDDEN, rnnlm.CLASSES, rnnlm.WIDTH
    x, u, wc, ww = (getattr(net, k).astype(float).tolist() for k in ("x", "u", "wc", "ww"))
    bc, bw = net.bc.astype(float).tolist(), net.bw.astype(float).tolist()
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def softmax(logits, target):
        top = max(logits)
        return logits[target] - top - math.log(sum(math.exp(v - top) for v in logits))

    h, before, out = [0.0] * n, rnnlm.END, []
    for s in symbols:
        a = [sum(h[i] * u[i][j] for i in range(n)) for j in range(3 * n)]
        r = [sigmoid(x[before][j] + a[j]) for j in range(n)]
        z = [sigmoid(x[before][n + j] + a[n + j]) for j in range(n)]
        c = [math.tanh(x[before][2 * n + j] + r[j] * a[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(n)]
        k, w = s % classes, s // classes
        p = softmax([sum(h[i] * wc[i][j] for i in range(n)) + bc[j] for j in range(classes)], k)
        p += softmax([sum(h[i] * ww[k][i][j] for i in range(n)) + bw[k][j] for j in range(width)], w)
        out.append(p / math.log(10))
        before = s
    return out


def test_language_model_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = rnnlm.Gru.fresh(np.ones(rnnlm.CLASSES * rnnlm.WIDTH))
    symbols = rng.integers(0, 40, 12)
    at, seen = np.array([0, 7, 12]), {}
    trainer = rnnlm.Trainer(rnnlm.Gru(net.flat.copy()))
    trainer.square = np.zeros(rnnlm.Gru.SIZE, np.float32)
    trainer.learn(symbols, at)
    grad = np.sqrt(trainer.square)  # of one window, without its sign
    loss = lambda flat: -rnnlm.score_lanes(rnnlm.Gru(flat), symbols, at).mean() * math.log(10)
    for i in np.argsort(-grad)[[0, 3, 10, 30, 100, 200]]:
        up, down = net.flat.astype(np.float32).copy(), net.flat.astype(np.float32).copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        seen[i] = (loss(up) - loss(down)) / 2e-2
        assert abs(seen[i]) == pytest.approx(grad[i], rel=0.02, abs=2e-4)


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(rnnlm, "REPLICA_TOKENS", 2_000)
    rng = random.Random(5)
    df = make(spark, [(i, prose(rng, 60)) for i in range(200)])
    one, other = ({r.doc_id: r.score for r in rnnlm.score_texts(d).collect()} for d in (df, df.repartition(5)))
    assert one == pytest.approx(other, abs=1e-6)


def test_language_model_reads_a_long_document_in_bounded_memory():
    import tracemalloc

    rng = random.Random(6)
    texts = [prose(rng, 300_000)] + [prose(rng, 5) for _ in range(255)]
    data, offsets = text_bytes(pa.array(texts))
    found, at = rnnlm.tokens(data, offsets)
    value, count = np.unique(found, return_counts=True)
    vocabulary = rnnlm.Vocabulary(value, count, len(found), len(value))
    net = rnnlm.Gru.fresh(vocabulary.unigram)
    tracemalloc.start()
    scores = rnnlm.score_lanes(net, vocabulary.symbols_of(found), at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == at[-1] and peak < 100 * len(found)
    alone = rnnlm.score_lanes(net, vocabulary.symbols_of(found[at[1] : at[2]]), np.array([0, at[2] - at[1]]))
    assert np.allclose(scores[at[1] : at[2]], alone, atol=1e-4)


def test_language_model_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    net = rnnlm.Gru.fresh(np.ones(rnnlm.CLASSES * rnnlm.WIDTH))
    symbols = rng.integers(0, rnnlm.CLASSES * rnnlm.WIDTH, 300)
    at = np.array([0, 250, 300])
    whole = rnnlm.score_lanes(net, symbols, at)
    # one document alone, number by number, gives the same: state crosses windows and not documents
    assert np.allclose(whole[:250], scalar_scores(net, symbols[:250].tolist()), atol=1e-4)
    assert np.allclose(whole[250:], scalar_scores(net, symbols[250:].tolist()), atol=1e-4)
    state = net.steps(symbols[:1][:, None], np.ones((1, 1), bool), np.zeros((rnnlm.HIDDEN, 1), np.float32))[0, :, 0]
    every = np.arange(rnnlm.CLASSES * rnnlm.WIDTH)
    total = np.exp(net.log_probs(np.repeat(state[None], len(every), axis=0), every)[0].astype(np.float64)).sum()
    assert total == pytest.approx(1, abs=1e-4)
    trainer = rnnlm.Trainer(rnnlm.Gru(net.flat.copy()))
    for _ in range(6):
        trainer.learn(symbols, at)
    assert rnnlm.score_lanes(trainer.net, symbols, at).sum() > whole.sum()
