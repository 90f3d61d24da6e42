import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vecspark.llm import lm
from vecspark.llm.queries import QUERIES, ranks_path

FAST = {"top_words": 2000, "warm_texts": 60, "warm_steps": 60}


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def base(rows):
    out_of = lambda d: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2
    c = Counter(w for d, t in rows if not out_of(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, out_of(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in tokens(t))) for d, t in rows]


def same(got, want):
    key = lambda r: (str(r[0]), *r[1:4])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-6)


def columns(rows):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return QUERIES["op5_lm"](spark, sf_dir).collect()


def test_base_columns(spark, sf_dir, scored):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(columns(scored), base(docs))


def test_scores_are_log_probabilities(scored):
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in scored)


def test_order_of_words_is_learnt(spark):
    """Where the next word follows from the ones before, held-out texts are far likelier than by unigrams."""
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ba", "do", "fi", "gu")]
    text = lambda d: " ".join(words[(d + i * (1 + d % 3)) % 20] for i in range(60))
    df = spark.createDataFrame([(d, text(d)) for d in range(700)], "doc_id long, text string")
    out = [r for r in lm.score(df, ranks_path(), top_words=2000, warm_texts=300, warm_steps=300).collect() if r["held_out"]]
    assert len(out) > 50 and all(r["n_known"] == r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) > 0.6 * sum(r["base_score"] for r in out)


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, four = (sorted((r["doc_id"], r["score"]) for r in lm.score(d, ranks_path(), **FAST).collect()) for d in (docs.coalesce(1), docs.repartition(4, "text")))
    assert [d for d, _ in one] == [d for d, _ in four]
    assert [s for _, s in one] == pytest.approx([s for _, s in four], rel=1e-5)


def test_edges(spark, edge_docs):
    out = lm.score(edge_docs, ranks_path(), **FAST).collect()
    same(columns(out), base([(r["doc_id"], r["text"]) for r in edge_docs.collect()]))
    assert all(math.isfinite(r["score"]) for r in out)
    assert lm.score(edge_docs.limit(0), ranks_path(), **FAST).count() == 0
    held = spark.createDataFrame([(d, "some text") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id long, text string")
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in lm.score(held, ranks_path(), **FAST).collect())


def test_long_texts(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(100_000))
    docs = [(d, long) for d in (1, 2)] + [(d, f"w{d} w1 " * 50) for d in range(3, 60)] + [(60, "x" * 300_000)]
    out = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), ranks_path(), **FAST).collect()
    same(columns(out), base(docs))
    assert {r["n_tokens"] for r in out if r["doc_id"] < 3} == {100_001}
    assert len({round(r["score"], 3) for r in out if r["doc_id"] < 3}) == 1 and all(math.isfinite(r["score"]) for r in out)


def test_words_and_ends_of_texts():
    texts = ["", " A b\tC ", "é\x0bÉ", "one", "\n", "x\u00a0Y z"]
    words, size = lm.tokenize(pa.array(["dropped", *texts]).slice(1))
    want = [tokens(t)[:-1] for t in texts]
    assert [w.decode() for w in words.to_pylist()] == [w for x in want for w in x] and size.tolist() == [len(x) for x in want]
    assert lm.tokenize(pa.array([], pa.string()))[1].tolist() == []


@pytest.fixture(scope="module")
def model(spark):
    texts = [(f"the cat{i % 5} sat on the mat and the dog{i % 3} ran to town{i} again",) for i in range(80)]
    df = spark.createDataFrame(texts, "text string")
    return lm.learn(df, lm.count_words(df), ranks_path(), 50, 40, 40)


def of(w, lex, texts):
    """Class log probabilities of the tokens of texts, and what they are made from."""
    words, size = lm.tokenize(pa.array(texts))
    token, own = lm.with_ends(words, size)
    table = lm.Table(lex, w)
    row = table.rows(own)
    e, cls, win = np.concatenate([table.e[row], np.zeros((1, lm.DIM), "f4")]), np.append(table.cls[row], 0), lm.Windows(token, size + 1)
    return lm.class_log_probabilities(w, e, cls, win), e, cls, win


def test_classes_and_words_are_distributions(model):
    w, lex, of_open, once = model
    got, e, of_word, win = of(w, lex, ["the cat1 sat"])
    p = lm.odds(w, lm.forward(w, e, win.x)[0])
    assert (p > 0).all() and got == pytest.approx(np.log((p / p.sum(axis=1, keepdims=True))[np.arange(len(got)), of_word[win.token]]), abs=1e-4)
    encode = lm._encoder(lex.path)
    cls, lp, _, _ = lex.describe(encode)
    assert np.bincount(cls, np.exp(lp))[np.unique(cls)] == pytest.approx(np.ones(len(np.unique(cls))))
    assert np.exp(lex.spell).sum(axis=1) == pytest.approx(np.ones(lm.SPELT + 2))
    k, lp, _, _ = lex.spelling(encode, pa.array([b"zebra", b"town3"], pa.binary()))
    assert (lp < 0).all() and np.isfinite(lp).all() and (k >= lm.DIRECT + lm.GROUPS).all()
    assert of_open.sum() == once.sum() == 80 and (once <= of_open).all()  # town0 to town79


def test_open_words_score_their_counts(spark):
    """A word beyond the frequent ones is the likelier the more often it was met, and likelier than one never met."""
    docs = [(d, "a b c d " * 10 + ("qqzz " * 3 if d % 2 else "") + ("qqxx" if d == 9 else "")) for d in range(200)]
    held = [d for d in range(1000, 2000) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    docs += [(d, f"a b {w}") for d, w in zip(held, ("qqzz", "qqxx", "qqyy"))]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), ranks_path(), top_words=4, warm_texts=60, warm_steps=60).collect()}
    assert got[held[0]] > got[held[1]] + 1 and got[held[1]] > got[held[2]] - 1


def test_attention_is_causal_and_windows_overlap(model):
    """A token's probability depends on nothing behind it, and windows give each token one score with context."""
    w, lex, *_ = model
    words = ["the", "cat1", "sat", "on", "mat", "ran"] * 20
    whole = of(w, lex, [" ".join(words)])[0]
    assert len(whole) == len(words) + 1
    for n in (1, 31, 32, 33, 50, 90):
        part = of(w, lex, [" ".join(words[:n])])[0]
        assert part[:n] == pytest.approx(whole[:n], abs=1e-4)
    both = of(w, lex, [" ".join(words[:40]), "", " ".join(words)])[0]
    assert both[:40] == pytest.approx(whole[:40], abs=1e-4) and both[42:] == pytest.approx(whole, abs=1e-4)


def test_sums_cover_every_window_and_give_the_gradient(model):
    w, lex, *_ = model
    texts = ["the cat1 sat " * (20 + i) for i in range(30)] + ["dog2 ran " * 40, ""]
    sums = lambda t: lm.output_sums(w, *of(w, lex, t)[1:])
    whole = sums(texts)
    assert sums(texts[:7]) + sums(texts[7:]) == pytest.approx(whole, rel=1e-3, abs=1e-3)
    n = sum(len(tokens(t)) for t in texts)
    assert whole[-lm.CLASSES :].sum() == pytest.approx(n, rel=1e-4) and whole[lm.SUMS - lm.CLASSES - 1] == pytest.approx(n)
    g = whole[: (lm.HIDDEN + 1) * lm.CLASSES].reshape(lm.HIDDEN + 1, lm.CLASSES)
    for at in ((3, 0), (lm.HIDDEN, 2), (lm.HIDDEN, lm.CLASSES - 1)):
        nudge = np.zeros_like(g)
        nudge[at] = 1e-2
        up, down = (of(lm.stepped(w, nudge, r), lex, texts)[0].sum() for r in (1, -1))
        assert (down - up) / 2e-2 == pytest.approx(g[at], rel=0.02, abs=0.5)
    step = lm.newton(w, whole)
    assert of(lm.stepped(w, step, 0.2), lex, texts)[0].sum() > of(w, lex, texts)[0].sum()


def test_rows_of_words_are_forgotten_and_found_again(model):
    w, lex, *_ = model
    table, big = lm.Table(lex, w, limit=5), lm.Table(lex, w)
    for i in range(40):
        words = pa.array([b"", b"the", *[f"new{(i * 3 + j) % 50}".encode() for j in range(4)]], pa.binary())
        a, b = table.rows(words), big.rows(words)
        assert np.array_equal(table.cls[a], big.cls[b]) and np.array_equal(table.e[a], big.e[b]) and np.array_equal(table.lp[a], big.lp[b])
        assert len(table.used) <= table.frequent + 10


def test_all_weights_learn_from_texts_outside_the_sample(spark):
    """The order of words in texts too long for the sample moves embeddings and attention, and not the output layer alone."""
    short = [(f"the cat{i % 5} sat on the mat and the dog{i % 3} ran",) for i in range(40)]
    ends, found = "the cat1 sat on the mat and the dog2 ran".split(), []
    for order in (ends, ends[::-1]):
        df = spark.createDataFrame([*short, *[(" ".join(order * 20) + f" n{i}",) for i in range(20)]], "text string")
        found.append(lm.learn(df, lm.count_words(df), ranks_path(), 50, 40, 40, 200)[0])
    assert all(not np.array_equal(found[0][k], found[1][k]) for k in found[0])


def test_groups_come_from_all_texts(spark):
    texts = ["the cat the dog", "dog", "", "cat cat bird"]
    words, first = pa.array([b"", b"the", b"cat", b"dog"], pa.binary()), np.array([5, 0, 1, 1])
    got = lm._company(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), words, first, 5)
    want = np.zeros((5, lm.DIRECT))
    for t in texts:
        rows = [{b.decode(): i for i, b in enumerate(words.to_pylist())}.get(x) for x in tokens(t)]
        known = [r for r in rows if r is not None]
        share = np.rint(1e6 * np.bincount(known, minlength=lm.DIRECT) / len(known))
        for r in known:
            if first[r] < 5:
                want[first[r]] += share
    assert np.array_equal(got, want)


def test_gradient_by_differences(model):
    w, lex, *_ = model
    w = {k: v.astype("f8") for k, v in w.items()}
    b = lm.Sample(pa.array(["the cat1 sat on zebra " * 9, "dog2"]), lex, lm._encoder(lex.path))
    pick = np.arange(len(b.win.x))
    _, g = lm.gradient(w, b, pick)
    rng = np.random.default_rng(0)
    for k in w:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            if k == "E":
                at = (int(b.slots[0]), at[1])
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (lm.gradient(up, b, pick)[0] - lm.gradient(down, b, pick)[0]) / 2e-5
            assert g[k][at] == pytest.approx(slope, abs=2e-4), k


def _peak(run):
    """MB that a call takes at its peak above what there was before."""
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_many_words_is_bounded():
    """Ids of many words in Python lists, and slots' gradients of all columns at once, filled an executor's memory."""
    rng = np.random.default_rng(3)
    words = pa.array([b"" if i % 1000 == 0 else b"word%d" % i for i in range(60_000)], pa.binary())
    encode = lm._encoder(ranks_path())
    ids, n = lm.subwords(encode, words)
    apart = [lm.subwords(encode, words.slice(i, 1)) for i in range(0, 20_000, 499)]
    begin = np.cumsum(n) - n
    assert all(i.tolist() == ids[begin[k] : begin[k] + n[k]].tolist() for k, (i, _) in zip(range(0, 20_000, 499), apart))
    assert n[0] == 0 and (n[1:1000] > 0).all() and lm.subwords(encode, words.slice(0, 0))[0].dtype == ids.dtype
    assert _peak(lambda: lm.subwords(encode, words)) < 8
    rows, slots = rng.normal(size=(len(n), lm.DIM)), ids % lm.SPELT
    E, end = lm.to_slots(rows, slots, n)
    want = np.zeros((lm.SPELT + 1, lm.DIM))
    np.add.at(want, slots, np.repeat(rows / np.maximum(n, 1)[:, None], n, axis=0))
    assert np.allclose(E, want) and np.allclose(end, rows[n == 0].sum(axis=0))
    assert _peak(lambda: lm.to_slots(rows, slots, n)) < 8


def test_words_take_bounded_memory(spark):
    """Means of many words are taken in parts, and words that do not come again are forgotten."""
    rng = np.random.default_rng(1)
    w = lm.new_weights(np.zeros(lm.CLASSES))
    n = rng.integers(0, 9, 200_000)
    slots = rng.integers(0, lm.SPELT, n.sum())
    tracemalloc.start()
    got = lm.mean_embeddings(w, slots, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * got.nbytes
    ends = np.cumsum(n)
    for i in [*range(40), *range(16_350, 16_420), *range(199_960, 200_000)]:
        assert got[i] == pytest.approx(w["E"][slots[ends[i] - n[i] : ends[i]]].mean(axis=0) if n[i] else w["end"], abs=1e-5)
    size = max(lm.load_ranks(ranks_path()).values()) + 1
    wide = lm.SPELT + 2
    lex = lm.Lexicon(ranks_path(), pa.array([b"", b"the"], pa.binary()), np.array([5, 9]), np.arange(lm.SPELT), np.ones((wide, wide)), np.ones(size), np.arange(size) % lm.GROUPS, np.arange(size) % lm.OPEN)
    own = lm.Table(lex, w)
    for i in range(4):
        words = pa.array([b"the", *(b"w%d" % (30_000 * i + j) for j in range(30_000))], pa.binary())
        row = own.rows(words)
        assert own.words.take(pa.array(row)).equals(words) and len(own.used) <= own.frequent + 50_000


def test_places_of_words():
    known = pa.array([b"", b"the", b"of", "é".encode()], pa.binary())
    for words, want in (([b"of", b"x", b"", "é".encode()], [2, -1, 0, 3]), ([b""], [0]), ([b"y"], [-1]), ([], [])):
        assert lm.places(pa.array(words, pa.binary()), known).tolist() == want
    assert lm.places(pa.array([b"a"], pa.binary()), known.slice(0, 0)).tolist() == [-1]


def test_words_are_encoded_together():
    """A call for each word took most of an encoder's time. White space of other kinds keeps the ids of a word alone."""
    odd = ["x ", " y", " ", "a　b", "", "\u0085z", " ", "  "]
    words = ["plain", *odd, "é", "\x1c", "p\x1fq", "'s", "12ab--", "日本", "x" * 2000, *odd, "ß", *(f"word{i}é" if i % 9 else f"w{i}" for i in range(500))]
    encode, calls = lm._encoder(ranks_path()), []
    alone = [encode(" " + w) if w else [] for w in words]
    one = encode.encode
    encode.encode = lambda text: calls.append(text) or one(text)
    for part in (3, 7, 8192):
        ids, n = lm.subwords(encode, pa.array([w.encode() for w in words], pa.binary()), part)
        assert n.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]
    calls.clear()
    lm.subwords(encode, pa.array([b"w%d" % i for i in range(5000)], pa.binary()))
    assert len(calls) == 1


def test_products_in_parts(model):
    """Products of long arrays, taken in parts, and gradients that windows pass to the ones before, in any chunks."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 300):
        x, y, m = rng.normal(size=(n, 35))[:, :33], rng.normal(size=(n, 7)), rng.normal(size=(33, 5))
        assert np.allclose(lm.times(x, m), x @ m) and np.allclose(lm.summed(x, y), x.T @ y)
    w, lex, *_ = model
    found = []
    _, e, cls, win = of(w, lex, ["the cat1 sat on zebra " * 60, "", "dog2 ran " * 90, "the mat"])
    for chunk in (1, 3, 64):
        below = {k: np.zeros(v) for k, v in lm.BELOW.items()} | {"rows": np.zeros(e.shape)}
        found.append((lm.output_sums(w, e, cls, win, chunk, below), below))
    for sums, below in found[1:]:
        assert sums == pytest.approx(found[0][0], rel=1e-3, abs=1e-3)
        assert all(np.allclose(below[k], found[0][1][k], rtol=1e-3, atol=1e-3) for k in below)
    assert not found[0][1]["rows"][-1].any()
