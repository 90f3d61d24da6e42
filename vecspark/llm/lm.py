"""A causal self-attention language model in numpy on subword ids, and whole texts scored by it.

A token is a lower-cased (A-Z) word, or the end of a text. It goes in as the mean embedding of its subword ids (of a
public vocabulary). One masked attention layer over the tokens before it predicts the class of the next token. The
most frequent words are classes by themselves; the other frequent words (``top_words`` of the corpus in all) fall into
classes by their first subword id and have their corpus share of the class; every other word belongs to one of a few
open classes, again by its first subword id. There its probability mixes its count in the corpus (whatever its rank)
with its spelling, a Markov chain of subword ids; the chain gets the mass of words met once, which stand for words never
met. So the model is a proper distribution over texts, for words never seen as well.

Learning: all words of all training documents are counted (combined in each task, then shuffled), and classes, shares,
open counts and spelling follow from those counts, the groups of first ids from the texts they occur in, all of them.
The weights get their starting values in the driver from a bounded sample (``warm_texts`` texts of at most
``warm_bytes``). Then all of them, embeddings and attention included, are fitted on every window of every training
document: texts fall into ``rounds`` by hash, and after each round the weights move by gradients (and moments for the
output layer) that tasks have summed up. Sums do not depend on how rows are dealt to partitions, and so the scores do
not either (but for rounding in the last digits).

Scoring: texts are cut into windows of SPAN scored tokens behind CONTEXT tokens that an earlier window scored; a batch
of windows goes through masked attention at once, and each token is scored exactly once. Only bounded tables travel
with the tasks; words outside the frequent ones meet their counts in a shuffle join.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, acyclic, load_ranks
from .tables import column, cut, small_batches
from .vectors import spherical_kmeans

DIM, HIDDEN, SPAN, CONTEXT = 16, 32, 32, 16
DIRECT, GROUPS, OPEN = 56, 28, 12  # classes: single words, groups of frequent words, groups of all others
CLASSES = DIRECT + GROUPS + OPEN
SPELT = 512  # subword ids told apart in spelling and embeddings; the others share one more
FIRSTS = 2048  # first ids grouped by the texts they occur in
START = SPELT + 1  # the slot before the first id, and behind the last
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
LOWER[9:14] = 32


def tokenize(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts (a string array without nulls), one after the other, and how many each has."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "i4")[texts.offset : texts.offset + n + 1].astype("i8") if n else np.zeros(1, "i8")
    low = LOWER[np.frombuffer(data, "u1")[at[0] : at[-1]]] if data is not None else np.zeros(0, "u1")
    at = at - at[0]
    inside = low != 32
    first = np.zeros(len(low) + 1, bool)
    first[at] = True
    before = np.concatenate([[False], inside[:-1]])[: len(low)]
    after = np.concatenate([inside[1:], [False]])[: len(low)]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    stops = np.flatnonzero(inside & (~after | first[1:])) + 1
    ends = np.concatenate([[0], np.cumsum(stops - starts)]).astype("i4")
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return words, np.diff(np.searchsorted(starts, at))


class Encoder:
    """Subword ids of a text, by the ranks in ``path``. ``begins``: of each id, whether it starts with a blank."""

    def __init__(self, path: str):
        import tiktoken

        ranks = load_ranks(path)
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def __call__(self, text: str) -> list[int]:
        return self.encode(text)


_encoder = Encoder


@acyclic
def subwords(encode, words: pa.Array, part: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words behind a blank, one after the other, and how many each has; an empty word (an end) has none.

    ``part`` words are encoded at a time, as ids in Python lists take some ten times the memory of an array. They go as
    one text, whose pieces end before each blank; a word that holds white space of other kinds (or nothing) goes alone,
    as the pattern may take such a space together with the blank behind it."""
    flat, sizes = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for i in range(0, len(words), part):
        own = words.slice(i, part).cast(pa.string())
        plain = pa.compute.string_is_ascii(own).to_numpy(zero_copy_only=False) & (pa.compute.binary_length(own).to_numpy() > 0)
        for j in np.flatnonzero(~plain).tolist():
            plain[j] = (w := own[j].as_py()).split() == [w]
        some = own if plain.all() else own.filter(pa.array(plain))
        text = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], "i4"), some), " ")[0].as_py()
        ids, n = np.array(encode(" " + text) if text else [], "i8"), np.zeros(len(own), "i8")
        n[plain] = np.diff(np.flatnonzero(encode.begins[ids]), append=len(ids))
        if len(some) < len(own):
            alone = [encode(" " + w) if w else [] for w in own.filter(pa.array(~plain)).to_pylist()]
            n[~plain] = [len(x) for x in alone]
            whole, of_plain = np.empty(int(n.sum()), "i8"), np.repeat(plain, n)
            whole[of_plain], whole[~of_plain] = ids, [k for x in alone for k in x]
            ids = whole
        flat.append(ids)
        sizes.append(n)
    return np.concatenate(flat), np.concatenate(sizes)


class Lexicon:
    """What the corpus counts say of words: class, share of the class or spelling, and subword ids.

    It holds bounded tables only, and is what a task needs besides the weights.
    """

    def __init__(self, path: str, words: pa.Array, counts: np.ndarray, direct_ids: np.ndarray, pairs: np.ndarray, rest: np.ndarray, group_of: np.ndarray, open_of: np.ndarray):
        """words, counts: the end (an empty word) and the frequent words, most frequent first. pairs: spelling counts
        between slots; rest: of ids. group_of, open_of: the group of each id as a first one."""
        self.path, self.words, self.counts, self.uid = path, words, counts.astype("i8"), uuid.uuid4().hex
        self.slot = np.full(len(rest), SPELT, "i4")
        self.slot[direct_ids] = np.arange(len(direct_ids))
        self.group_of, self.open_of = group_of, open_of
        shared = np.log((rest + 0.5) / (rest + 0.5)[self.slot == SPELT].sum())
        self.in_slot = np.where(self.slot == SPELT, shared, 0.0)
        prior = pairs.sum(axis=0) + 0.1
        prior[SPELT] += 0.5
        smooth = pairs + 2.0 * prior / prior.sum()
        self.spell = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        of_first = np.bincount(open_of, np.exp(self.in_slot + self.spell[START, self.slot]), OPEN)
        self.first = np.log(np.maximum(of_first, 1e-300))

    def describe(self, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the frequent words: class, log share of the class, slots of all subword ids, and how many each has."""
        ids, n = subwords(encode, self.words)
        begin = np.cumsum(n) - n
        first = np.where(n > 0, ids[np.minimum(begin, max(0, len(ids) - 1))], 0) if len(ids) else np.zeros(len(n), "i8")
        cls = np.where(np.arange(len(n)) < DIRECT, np.arange(len(n)), DIRECT + self.group_of[first])
        c = np.maximum(self.counts, 1e-9)
        return cls, np.log(c / np.bincount(cls, c, CLASSES)[cls]), self.slot[ids], n

    def spelling(self, encode, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of other words; the share is that of the spelling alone."""
        ids, n = subwords(encode, words)
        slots = self.slot[ids]
        ends = np.cumsum(n + 1)
        chain = np.full(int(ends[-1]) + 1 if len(n) else 1, START, "i8")
        at = np.delete(np.arange(len(chain) - 1), ends - 1)
        chain[1:][at] = slots
        steps = self.spell[chain[:-1], chain[1:]]
        steps[at] += self.in_slot[ids]
        k = self.open_of[ids[np.cumsum(n) - n]] if len(n) else np.zeros(0, "i8")
        lp = np.add.reduceat(steps, ends - n - 1) - self.first[k] if len(n) else np.zeros(0)
        return DIRECT + GROUPS + k, lp, slots, n


def lists(slots: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("i4")), pa.array(slots.astype("i2")))


def unlisted(of: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return of.flatten().to_numpy().astype("i4"), of.value_lengths().to_numpy().astype("i8")


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where distinct ``words`` stand among ``known`` (distinct too), -1: nowhere. The hash table is that of ``words``, as
    one of all that is known would take most of the time."""
    at = pa.compute.index_in(known, value_set=words)
    row = np.full(len(words), -1)
    row[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return row


class Table:
    """A worker's rows of words: frequent ones for good, others as long as they are met and ``limit`` rows hold them, as
    hardly any of them comes again soon. Row -1 stands for no word."""

    def __init__(self, lex: Lexicon, w: dict, limit: int = 20_000):
        self.lex, self.w, self.limit, self.encode = lex, w, limit, _encoder(lex.path)
        cls, lp, slots, n = lex.describe(self.encode)
        self.frequent = len(cls)
        self.words, self.cls, self.lp, self.slots = lex.words, cls, lp, lists(slots, n)
        self.e = mean_embeddings(w, slots, n)
        self.used = np.ones(len(cls), bool)

    def embed(self, w: dict) -> None:
        """Take other weights."""
        if self.w is not w and not all(np.array_equal(self.w[k], w[k]) for k in ("E", "end")):
            self.e = mean_embeddings(w, *unlisted(self.slots))
        self.w = w

    def rows(self, words: pa.Array) -> np.ndarray:
        """The rows of distinct words, which are learnt if need be."""
        if len(self.used) > self.limit + self.frequent:  # what nothing since the last time has used is forgotten
            keep = self.used[self.frequent :] & (self.used[self.frequent :].sum() <= self.limit)
            few = lambda of: np.concatenate([of[: self.frequent], of[self.frequent :][keep]])
            listed = lambda of: pa.concat_arrays([of.slice(0, self.frequent), of.slice(self.frequent).filter(pa.array(keep))])
            self.words, self.slots, self.cls, self.lp, self.e = listed(self.words), listed(self.slots), few(self.cls), few(self.lp), few(self.e)
            self.used = np.arange(len(self.cls)) < self.frequent
        row = places(words, self.words)
        new = row < 0
        if new.any():
            fresh = words.filter(pa.array(new))
            row = np.where(new, len(self.cls) + np.cumsum(new) - 1, row)
            cls, lp, slots, n = self.lex.spelling(self.encode, fresh)
            self.words = pa.concat_arrays([self.words, fresh])
            self.cls, self.lp = np.concatenate([self.cls, cls]), np.concatenate([self.lp, lp])
            self.e = np.concatenate([self.e, mean_embeddings(self.w, slots, n)])
            self.slots = pa.concat_arrays([self.slots, lists(slots, n)])
            self.used = np.concatenate([self.used, np.zeros(len(cls), bool)])
        self.used[row] = True
        return row


def mean_embeddings(w: dict, slots: np.ndarray, n: np.ndarray, part: int = 16384) -> np.ndarray:
    """Of words with these slots; ``part`` words at a time, as the rows of all slots take some three times the result."""
    out = np.zeros((len(n), DIM), w["E"].dtype)
    begin = np.concatenate([[0], np.cumsum(n)])
    for i in range(0, len(n), part):
        own, first = n[i : i + part], begin[i : i + part + 1]
        some = np.flatnonzero(own)
        if len(some):
            out[i + some] = np.add.reduceat(w["E"][slots[first[0] : first[-1]]], first[some] - first[0], axis=0) / own[some, None]
    out[n == 0] = w["end"]
    return out


_tables: dict[str, Table] = {}


def worker_table(lex: Lexicon, w: dict) -> Table:
    """This worker's table of a lexicon, with these weights."""
    if lex.uid not in _tables:
        _tables.clear()
        _tables[lex.uid] = Table(lex, w)
    _tables[lex.uid].embed(w)
    return _tables[lex.uid]


class Windows:
    """Tokens of some texts, and the windows over them. ``token``: all texts' tokens as numbers of words, -1: none."""

    def __init__(self, token: np.ndarray, size: np.ndarray):
        self.token = token.astype("i4")
        self.begin = np.concatenate([[0], np.cumsum(size)])
        per = -(-size // SPAN)
        self.first = np.concatenate([[0], np.cumsum(per)])
        at = np.arange(len(token)) - np.repeat(self.begin[:-1], size)
        self.place = np.repeat(self.first[:-1] * SPAN, size) + at
        self.y = np.full(int(self.first[-1]) * SPAN, -1, "i4")
        self.y[self.place] = self.token
        before = np.full(len(self.y), -1, "i4")
        before[self.place[1:]] = self.token[:-1]
        if len(size):
            before[self.place[at == 0]] = self.token[-1]  # a text begins behind an end
        before = before.reshape(-1, SPAN)
        self.x = np.full((len(before), SPAN + CONTEXT), -1, "i4")
        self.x[:, CONTEXT:] = before
        if len(before) > 1:
            self.x[1:, :CONTEXT] = before[:-1, SPAN - CONTEXT :]
        self.x[self.first[:-1], :CONTEXT] = -1
        self.y = self.y.reshape(-1, SPAN)


def with_ends(words: pa.Array, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Tokens as numbers of the distinct words that are also returned; an end (the empty word) stands behind each text."""
    numbered = words.dictionary_encode()
    own = pa.concat_arrays([numbered.dictionary, pa.array([b""], pa.binary())])
    token = np.full(len(words) + len(size), len(own) - 1, "i4")
    stops = np.cumsum(size + 1) - 1
    inside = np.ones(len(token), bool)
    inside[stops] = False
    token[inside] = numbered.indices.to_numpy()
    return token, own


def new_weights(prior: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    rng, d = np.random.default_rng(seed), DIM
    w = {k: rng.normal(0, s, shape) for k, s, shape in (("E", 0.7, (SPELT + 1, d)), ("end", 0.7, (d,)), ("q", d**-0.5, (d, d)), ("k", d**-0.5, (d, d)), ("v", d**-0.5, (d, d)), ("a", d**-0.5, (2 * d, HIDDEN)), ("b", 0.1, (HIDDEN, CLASSES)))}
    w |= {"a0": np.zeros(HIDDEN), "place": np.zeros((SPAN, SPAN + CONTEXT)), "out0": prior}
    return {k: v.astype("f4") for k, v in w.items()}


_causal = np.where(np.arange(SPAN + CONTEXT)[None, :] <= np.arange(SPAN)[:, None] + CONTEXT, 0, -1e9).astype("f4")


def times(x: np.ndarray, y: np.ndarray, rows: int = 128) -> np.ndarray:
    """x @ y, for a long x and a small y; parts of so few rows need no packing, which takes a third of the time."""
    n, out = len(x) // rows * rows, np.empty((len(x), y.shape[1]), x.dtype)
    np.matmul(x[:n].reshape(-1, rows, x.shape[1]), y, out=out[:n].reshape(-1, rows, y.shape[1]))
    np.matmul(x[n:], y, out=out[n:])
    return out


def summed(x: np.ndarray, y: np.ndarray, rows: int = 128) -> np.ndarray:
    """x.T @ y, for a long x and y, likewise."""
    n = len(x) // rows * rows
    parts = x[:n].reshape(-1, rows, x.shape[1]).transpose(0, 2, 1) @ y[:n].reshape(-1, rows, y.shape[1])
    return parts.sum(axis=0) + x[n:].T @ y[n:]


def inputs(w: dict, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of the rows of ``e``: queries; keys, values and a one side by side; what the layer behind attention takes, without
    what attention adds; and whether a score may be too great for its exponential."""
    one = np.ones((len(e), 1), e.dtype)
    q, k = e @ (w["q"] * np.float32(DIM**-0.5)), e @ w["k"]
    most = math.sqrt(float((q * q).sum(axis=1).max(initial=0)) * float((k * k).sum(axis=1).max(initial=0))) + float(w["place"].max())
    return q, np.concatenate([k, e @ w["v"], one], axis=1), np.concatenate([e, np.zeros_like(e), one], axis=1), not most < 59


def forward(w: dict, e: np.ndarray, x: np.ndarray, known: tuple | None = None) -> tuple:
    """Hidden states (windows * SPAN, HIDDEN, and a one) that predict the classes behind the last SPAN tokens of ``x``,
    numbers of rows of ``e``, whose last row is for -1. ``known``: the inputs of ``e``, if they are known."""
    queries, kv, both, great = known or inputs(w, e)
    q, both, kv = queries.take(x[:, CONTEXT:], axis=0), both.take(x[:, CONTEXT:], axis=0), kv.take(x, axis=0)
    s = q @ kv[..., :DIM].transpose(0, 2, 1)
    s += w["place"] + _causal
    s[x[:, CONTEXT - 1] < 0, :, :CONTEXT] = -1e9  # a first window has no context
    if great:
        np.minimum(s, np.float32(60), out=s)
    np.exp(s, out=s)  # scores are bounded above, and a token always sees itself
    mixed = s @ kv[..., DIM:]
    total = mixed[..., DIM:]
    total += np.float32(1e-30)
    np.divide(mixed[..., :DIM], total, out=both[..., DIM:-1])
    layer = np.zeros((2 * DIM + 1, HIDDEN + 1), s.dtype)
    layer[:-1, :-1], layer[-1, :-1], layer[-1, -1] = w["a"], w["a0"], 1
    z = times(both.reshape(-1, 2 * DIM + 1), layer)
    np.maximum(z, 0, out=z)
    return z, (q, kv, s, total, both)


def backward(w: dict, cache: tuple, dz: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """From the gradients of the hidden states (without the one, before their bound): those of the layer and of the
    places; at each token of a window, of its key, value and query (a query for the last SPAN only); and of the rows of
    the last SPAN, as far as they enter the layer by themselves. ``cache``: what :func:`forward` left."""
    q, kv, s, total, both = cache
    n = len(q)
    layer = summed(both.reshape(-1, 2 * DIM + 1), dz)
    dboth = times(dz, np.ascontiguousarray(w["a"].T)).reshape(n, SPAN, 2 * DIM)
    dmixed = np.empty((n, SPAN, DIM + 1), dz.dtype)
    np.divide(dboth[..., DIM:], total, out=dmixed[..., :-1])
    np.einsum("wsd,wsd->ws", dmixed[..., :-1], both[..., DIM:-1], out=dmixed[..., -1])
    np.negative(dmixed[..., -1], out=dmixed[..., -1])
    ds = dmixed @ kv[..., DIM:].transpose(0, 2, 1)
    ds *= s
    each = np.empty((n, SPAN + CONTEXT, 3 * DIM), dz.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=each[..., :DIM])
    np.matmul(s.transpose(0, 2, 1), dmixed[..., :-1], out=each[..., DIM : 2 * DIM])
    np.matmul(ds, kv[..., :DIM], out=each[:, CONTEXT:, 2 * DIM :])
    each[:, CONTEXT:, 2 * DIM :] *= dz.dtype.type(DIM**-0.5)
    return {"a": layer[:-1], "a0": layer[-1], "place": ds.sum(axis=0)}, each, dboth[..., :DIM]


def below_attention(w: dict, e: np.ndarray, each: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the maps to keys, values and queries, and of the rows ``e`` that they take, from those of their
    results side by side; ``each`` may end before the queries."""
    flat = each.reshape(-1, each.shape[-1])
    names = ("k", "v", "q")[: flat.shape[1] // DIM]
    g = np.split(summed(e.reshape(-1, DIM), flat), len(names), axis=1)
    return dict(zip(names, g)), times(flat, np.concatenate([w[k].T for k in names]))


def spread(rows: np.ndarray, at: np.ndarray, de: np.ndarray) -> None:
    """Add the rows ``de`` to those of ``rows`` that have the numbers ``at``; the last one is for -1."""
    flat = at.astype("i8").reshape(-1, 1) * DIM + np.arange(DIM)
    np.add.at(rows.reshape(-1), flat.ravel(), de.ravel().astype("f8"))


def to_slots(rows: np.ndarray, slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of E and of the end from those of words with these slots."""
    slots, share = slots.astype("i8"), 1 / np.maximum(n, 1)
    each = [np.bincount(slots, np.repeat(rows[:, j] * share, n), SPELT + 1) for j in range(DIM)]  # a column at a time
    return np.stack(each, axis=1), rows[n == 0].sum(axis=0)


def odds(w: dict, z: np.ndarray) -> np.ndarray:
    """What the classes' probabilities are proportional to, without overflow."""
    p = times(z, np.concatenate([w["b"], w["out0"][None]]))
    top = np.float32(max(0.0, float(p.max(initial=0)) - 60))
    if top:
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    return p


def class_log_probabilities(w: dict, e: np.ndarray, cls: np.ndarray, win: Windows, chunk: int = 64) -> np.ndarray:
    """Natural log probability of each token's class. ``e``, ``cls``: of the distinct words, and of -1 at the end."""
    out, known, ones = np.zeros(win.y.shape), inputs(w, e), np.ones(CLASSES, e.dtype)
    for i in range(0, len(win.x), chunk):
        z, _ = forward(w, e, win.x[i : i + chunk], known)
        p = odds(w, z)
        picked = p.ravel().take(np.arange(0, p.size, CLASSES) + cls[win.y[i : i + chunk].ravel()]) / (p @ ones)
        out[i : i + chunk] = np.log(np.maximum(picked, np.float32(1e-38))).reshape(-1, SPAN)
    return out.ravel()[win.place]


def output_sums(w: dict, e: np.ndarray, cls: np.ndarray, win: Windows, chunk: int = 64, below: dict | None = None) -> np.ndarray:
    """Over all tokens: gradient of the output layer (a row more for its bias), moments of hidden states, expected and
    real counts of classes; as one flat array of sums. ``below`` gets the gradients of all other weights added, those of
    the rows of ``e`` as "rows", and the loss in nats."""
    known, ones, back = inputs(w, e), np.ones(CLASSES, e.dtype), np.ascontiguousarray(w["b"].T)
    grad, moments = np.zeros((HIDDEN + 1, CLASSES)), np.zeros((HIDDEN + 1, HIDDEN + 1))
    later = np.zeros((CONTEXT, 2 * DIM), e.dtype)  # from the window behind, as windows go from the last to the first
    for i in reversed(range(0, len(win.x), chunk)):
        x = win.x[i : i + chunk]
        z, cache = forward(w, e, x, known)
        p = odds(w, z)
        t = win.y[i : i + chunk].ravel()
        total = p @ ones
        share = 1 / total
        if none := np.flatnonzero(t < 0).tolist():
            z[none], share[none] = 0, 0
        at = np.arange(0, p.size, CLASSES) + cls[t]
        real = p.ravel().take(at)
        if below is not None:
            below["loss"] -= np.log(np.maximum(real * share, np.float32(1e-38)))[t >= 0].sum(dtype="f8")
        p.ravel()[at] = real - total  # a token's gradients of logits are its row of p times its share
        share = share[:, None]
        grad += summed(z * share, p)
        moments += z.T @ z
        if below is not None:
            dz = times(p, back)
            dz *= share
            dz *= z[:, :-1] > 0
            g, each, own = backward(w, cache, dz)
            # a window's context is the end of the window before; a first one's gradients there are zero
            each[:-1, SPAN:, : 2 * DIM] += each[1:, :CONTEXT, : 2 * DIM]
            each[-1, SPAN:, : 2 * DIM] += later
            later = each[0, :CONTEXT, : 2 * DIM].copy()
            maps, de = below_attention(w, cache[-1][..., :DIM], each[:, CONTEXT:])
            de += own.reshape(-1, DIM)
            for k, v in (g | maps).items():
                below[k] += v
            spread(below["rows"], x[:, CONTEXT:], de)
    expected = grad[-1] + np.bincount(cls[win.token], minlength=CLASSES)
    return np.concatenate([grad.ravel(), moments.ravel(), expected])


SUMS = (HIDDEN + 1) * CLASSES + (HIDDEN + 1) ** 2 + CLASSES
BELOW = {"a": (2 * DIM, HIDDEN), "a0": (HIDDEN,), "place": (SPAN, SPAN + CONTEXT), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "E": (SPELT + 1, DIM), "end": (DIM,), "loss": ()}
ALL_SUMS = SUMS + sum(math.prod(v) for v in BELOW.values())


def newton(w: dict, sums: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """A step for the output layer and its bias: each class's gradient over its own share of the moments."""
    g, s, c = np.split(sums, [(HIDDEN + 1) * CLASSES, SUMS - CLASSES])
    g, s = g.reshape(HIDDEN + 1, CLASSES), s.reshape(HIDDEN + 1, HIDDEN + 1)
    n = max(1.0, float(s[-1, -1]))
    share = np.clip(c / n, 0, 1)
    scale = np.maximum(share * (1 - share), 1 / n)
    s = s / n
    s = s + ridge * np.diag(np.diag(s)) + 1e-9 * np.eye(len(s))
    return -np.linalg.solve(s, g / n) / scale


def stepped(w: dict, step: np.ndarray, rate: float) -> dict:
    return w | {"b": (w["b"] + rate * step[:-1]).astype("f4"), "out0": (w["out0"] + rate * step[-1]).astype("f4")}


def lowered(w: dict, g: dict, squares: dict, n: float, rate: float) -> dict:
    """The weights below the output layer, after a step against the sums ``g`` over n tokens; a weight moves by ``rate``
    times its gradient's share of the noise it is used to, and by no more than ``rate``."""
    move = {k: np.clip(g[k] / max(1.0, n) / (np.sqrt(squares[k]) + 1e-4), -1, 1) for k in BELOW if k != "loss"}
    return w | {k: (w[k] - rate * m).astype("f4") for k, m in move.items()}


def trusted(step: np.ndarray, sums: np.ndarray, rate: float = 0.2, most: float = 0.05) -> np.ndarray:
    """``rate`` of a Newton step, and less for classes whose logits would move by more than ``most`` (root mean square over
    the moments in ``sums``): whole steps take classes for independent of the hidden state, and overshoot."""
    s = sums[(HIDDEN + 1) * CLASSES : SUMS - CLASSES].reshape(HIDDEN + 1, HIDDEN + 1)
    moved = np.sqrt(np.maximum((step * (s @ step)).sum(axis=0), 0) / max(1.0, s[-1, -1]))
    return step * np.minimum(rate, most / np.maximum(moved, 1e-12))


class Sample:
    """Texts of the bounded sample, as windows over a table of their distinct words with all their slots."""

    def __init__(self, texts: pa.Array, lex: Lexicon, encode):
        words, size = tokenize(texts)
        token, own = with_ends(words, size)
        at = pa.compute.index_in(own, value_set=lex.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        cls, _, slots, n = lex.describe(encode)
        begin = np.cumsum(n) - n
        rows = at.drop_null().to_numpy()
        c1, _, s1, n1 = lex.spelling(encode, own.filter(pa.array(~known)))
        self.cls, self.n_slots = np.zeros(len(own), "i8"), np.zeros(len(own), "i8")
        self.cls[known], self.cls[~known], self.n_slots[known], self.n_slots[~known] = cls[rows], c1, n[rows], n1
        s1 = iter(np.split(s1, np.cumsum(n1)[:-1]) if len(n1) else [])
        of = iter(slots[begin[r] : begin[r] + n[r]] for r in rows)
        self.slots = np.concatenate([next(of) if k else next(s1) for k in known])
        self.win = Windows(token, size + 1)

    def embed(self, w: dict) -> np.ndarray:
        return np.concatenate([mean_embeddings(w, self.slots, self.n_slots), np.zeros((1, DIM), w["E"].dtype)])

    def loss(self, w: dict) -> float:
        """Mean nats of a class."""
        return -float(class_log_probabilities(w, self.embed(w), np.append(self.cls, 0), self.win).mean())


def gradient(w: dict, b: Sample, pick: np.ndarray, table: np.ndarray | None = None) -> tuple[float, dict]:
    """Mean loss in nats over the classes of the picked windows' targets, and its gradient."""
    table = b.embed(w) if table is None else table
    x, y = b.win.x[pick], b.win.y[pick].ravel()
    z, cache = forward(w, table, x)
    logits = z[:, :-1] @ w["b"] + w["out0"]
    logits -= logits.max(axis=-1, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=-1, keepdims=True)
    live, c, rows = y >= 0, b.cls[np.maximum(y, 0)], np.arange(len(y))
    loss, m = float(((np.log(total[:, 0]) - logits[rows, c]) * live).sum()), max(1, int(live.sum()))
    p /= total
    p[rows, c] -= 1
    p *= (live / m).astype(p.dtype)[:, None]
    g, each, own = backward(w, cache, (p @ w["b"].T) * (z[:, :-1] > 0))
    context, before = below_attention(w, table.take(x[:, :CONTEXT], axis=0), each[:, :CONTEXT, : 2 * DIM])
    maps, de = below_attention(w, cache[-1][..., :DIM], each[:, CONTEXT:])
    g |= {"b": z[:, :-1].T @ p, "out0": p.sum(axis=0)} | {k: v + context.get(k, 0) for k, v in maps.items()}
    rows = np.zeros(table.shape)
    spread(rows, x[:, CONTEXT:], de + own.reshape(-1, DIM))
    spread(rows, x[:, :CONTEXT], before)
    g["E"], g["end"] = to_slots(rows[:-1], b.slots, b.n_slots)
    return loss / m, g


def fit(w: dict, samples: list[Sample], steps: int, rate: float, size: int = 96, seed: int = 11) -> tuple[dict, dict]:
    """Adam over random sets of windows, the rate falling to a tenth; and the mean squares of the last gradients."""
    w = {k: v.copy() for k, v in w.items()}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    share = np.array([len(b.win.x) for b in samples], "f8")
    for t in range(1, steps + 1):
        b = samples[int(rng.choice(len(samples), p=share / share.sum()))]
        _, g = gradient(w, b, rng.integers(0, len(b.win.x), size))
        r = rate * (1 - 0.9 * t / steps)
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            w[k] -= (r * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype("f4")
    return {k: v.astype("f4") for k, v in w.items()}, {k: v / (1 - 0.99 ** max(1, steps)) for k, v in s.items()}


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder that is held out; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _freed() -> None:
    """Give back to the system what Arrow and the C library keep of freed memory, where they can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes in the string column ``at``, or one row. What a slice took is freed behind it."""
    for b in batches:
        ends, i = np.cumsum(pa.compute.binary_length(b.column(at)).to_numpy()), 0
        while i < len(ends):
            upto = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, upto - i)
            i = upto
            _freed()


def count_words(texts: DataFrame) -> DataFrame:
    """``word binary, c long`` over ``texts(text)``, an end (the empty word) for each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            all_ = pa.concat_tables(kept).group_by("word").aggregate([("c", "sum")])
            yield from all_.rename_columns(["word", "c"]).to_batches(max_chunksize=100_000)

        for b in slices(batches, 0):
            words, size = tokenize(b.column(0))
            found = pa.compute.value_counts(words)
            ends = pa.table({"word": pa.array([b""], pa.binary()), "c": pa.array([len(size)], pa.int64())})
            kept += [pa.table({"word": found.field("values"), "c": found.field("counts")}), ends]
            rows += len(found)
            if rows > 1_000_000:
                yield from flush()
                kept, rows = [], 0
        if kept:
            yield from flush()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _open_words(counts: DataFrame, path: str, frequent: pa.Array, direct_ids: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Statistics of all training words outside the frequent ones: pairs of slots and ids in their spelling (each word
    once), and by first id their tokens and how many were met once. One pass over the counts, summed in each task."""
    slot = np.full(size, SPELT, "i8")
    slot[direct_ids] = np.arange(len(direct_ids))
    wide = SPELT + 2
    shape = {"pairs": wide * wide, "ids": size, "tokens": size, "once": size}

    def many(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Larger batches, as sums over all pairs of slots cost the same for each."""
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += len(b)
            if n >= rows:
                yield pa.concat_batches(kept)
                kept, n = [], 0
        if kept:
            yield pa.concat_batches(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        sums = {k: np.zeros(n, "i8") for k, n in shape.items()}
        for b in many(batches):
            open_ = pa.compute.invert(pa.compute.is_in(b.column(0), value_set=frequent))
            words, c = b.column(0).filter(open_), b.column(1).filter(open_).to_numpy()
            ids, n = subwords(encode, words)
            if not len(n):
                continue
            ends = np.cumsum(n + 1)
            chain = np.full(int(ends[-1]) + 1, START, "i8")
            chain[1:][np.delete(np.arange(ends[-1]), ends - 1)] = slot[ids]
            sums["pairs"] += np.bincount(chain[:-1] * wide + chain[1:], minlength=wide * wide)
            sums["ids"] += np.bincount(ids, minlength=size)
            first = ids[np.cumsum(n) - n]
            sums["tokens"] += np.bincount(first, c, size).astype("i8")
            sums["once"] += np.bincount(first[c == 1], minlength=size)
        flat = np.concatenate(list(sums.values()))
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["i", "c"])

    rows = counts.mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(sum(shape.values()))
    out[rows.column("i").to_numpy()] = rows.column("c").to_numpy()
    return dict(zip(shape, np.split(out, np.cumsum(list(shape.values()))[:-1])))


def _sample(texts: DataFrame, rows: int, most: int) -> pa.Array:
    """The ``rows`` distinct texts of least hash among those of at most ``most`` bytes; only hashes are sorted."""
    short = texts.where(F.octet_length("text") <= most).select(F.xxhash64("text").alias("h"), "text")
    least = short.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if least is None:
        return pa.array([], pa.string())
    # copies of a text are one row of a task, so a task sends no more than the sample
    found = short.where(F.col("h") <= F.lit(least)).groupBy("h").agg(F.min("text").alias("text")).toArrow()
    return found.sort_by("h").column("text").combine_chunks().cast(pa.string())


def _company(texts: DataFrame, lex_words: pa.Array, first: np.ndarray, ids: int) -> np.ndarray:
    """How often each first id (``first`` of the frequent words, those below ``ids``) stands in a text, times the shares
    of the direct words in it; over all texts, in whole millionths, so that sums are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros((ids, DIRECT)), np.append(first, ids)
        for b in slices(batches, 0):
            words, size = tokenize(b.column(0))
            token, own = with_ends(words, size)
            row = places(own, lex_words)
            row[row < 0] = len(first)
            col, key = np.where(row < min(DIRECT, len(first)), row, DIRECT).astype("i4")[token], of[row].astype("i4")[token]
            ends = np.concatenate([[0], np.cumsum(size + 1)])
            for i in range(0, len(size), 64):
                k = min(64, len(size) - i)
                at = slice(ends[i], ends[i + k])
                doc = np.repeat(np.arange(k, dtype="i4"), size[i : i + k] + 1)
                base = np.bincount(doc * (DIRECT + 1) + col[at], minlength=k * (DIRECT + 1)).reshape(k, -1)[:, :-1]
                share = np.rint(1e6 * base / np.maximum(1, base.sum(axis=1, keepdims=True)))
                times = np.bincount(doc * (ids + 1) + key[at], minlength=k * (ids + 1)).reshape(k, -1)[:, :-1]
                total += times.T.astype("f8") @ share
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype("i8"))], ["i", "c"])

    found = texts.mapInArrow(run, "i long, c long").groupBy("i").agg(F.sum(F.col("c").cast("double")).alias("c")).toArrow()
    out = np.zeros(ids * DIRECT)
    out[found.column("i").to_numpy()] = found.column("c").to_numpy()
    return out.reshape(ids, DIRECT)


def learn(texts: DataFrame, counts: DataFrame, path: str, top_words: int = 250_000, warm_texts: int = 600, warm_steps: int = 400, warm_bytes: int = 20_000, rounds: int = 4, rate: float = 0.03) -> tuple[dict, Lexicon, np.ndarray, np.ndarray]:
    """Weights, lexicon, and of each open class the tokens and the words met once, from ``texts(text)`` and the words'
    counts.

    ``top_words`` words and ``warm_texts`` texts of at most ``warm_bytes`` (by hash) come to the driver, where the weights
    get their starting values. Then each text is in one of ``rounds`` rounds, and each round moves all weights by sums
    over all windows of its texts: the output layer by parts of Newton steps over the moments of all rounds so far,
    each other weight by ``rate`` at most, and less from round to round.
    """
    top = counts.where("c > 1 and word <> x''").orderBy(F.desc("c"), "word").limit(top_words).toArrow()  # words met once stand for words never met
    n_ends = counts.where("word = x''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = pa.concat_arrays([pa.array([b""], pa.binary()), top.column("word").combine_chunks().cast(pa.binary())])
    freq = np.concatenate([[n_ends], top.column("c").to_numpy()])
    size = max(load_ranks(path).values()) + 1
    encode = _encoder(path)
    sample = _sample(texts, warm_texts, warm_bytes)
    ids, n = subwords(encode, words)
    use = np.bincount(ids, np.repeat(freq, n), size)
    direct_ids = np.argsort(-use, kind="stable")[:SPELT]
    rest = _open_words(counts, path, words, direct_ids, size)

    # groups of first ids, by the direct words of the texts they occur in
    first = np.where(n > 0, ids[np.minimum(np.cumsum(n) - n, max(0, len(ids) - 1))], -1) if len(ids) else np.full(len(n), -1)
    often = np.argsort(-np.bincount(first[first >= 0], freq[first >= 0], size), kind="stable")[:FIRSTS]
    rank = np.full(size + 1, FIRSTS)
    rank[often] = np.arange(FIRSTS)
    seen = _company(texts, words, rank[first], FIRSTS)
    some = np.flatnonzero(seen.sum(axis=1) > 0)

    def groups(k: int) -> np.ndarray:
        of = np.arange(size) % k
        if len(some) >= k:
            f = np.sqrt(seen[some] / seen[some].sum(axis=1, keepdims=True))
            of[often[some]] = (f @ spherical_kmeans(f, k).T).argmax(axis=1)
        return of

    lex = Lexicon(path, words, freq, direct_ids, rest["pairs"].reshape(SPELT + 2, SPELT + 2), rest["ids"], groups(GROUPS), groups(OPEN))
    of_open = np.bincount(lex.open_of, rest["tokens"], OPEN)
    once = np.bincount(lex.open_of, rest["once"], OPEN)
    prior = np.bincount(lex.describe(encode)[0], freq, CLASSES) + 1.0
    prior[DIRECT + GROUPS :] += of_open
    w = new_weights(np.log(prior / prior.sum()))
    squares = {k: np.ones_like(v) for k, v in w.items()}
    if len(sample):
        w, squares = fit(w, [Sample(sample.slice(i, 50), lex, encode) for i in range(0, len(sample), 50)], warm_steps, 0.02)
    curve = np.zeros(SUMS - (HIDDEN + 1) * CLASSES)
    for r in range(rounds):
        sums, below = _round(texts.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(rounds)) == r), lex, w)
        curve += sums[(HIDDEN + 1) * CLASSES :]
        so_far = np.concatenate([sums[: (HIDDEN + 1) * CLASSES], curve])
        tokens = sums[SUMS - CLASSES - 1]
        w = lowered(stepped(w, trusted(newton(w, so_far), so_far), 1.0), below, squares, tokens, rate / math.sqrt(r + 1))
    return w, lex, of_open, once


def _round(texts: DataFrame, lex: Lexicon, w: dict) -> tuple[np.ndarray, dict]:
    """The sums of :func:`output_sums` over all windows of ``texts(text)``, and those for the weights below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = worker_table(lex, w), np.zeros(SUMS)
        below = {k: np.zeros(v) for k, v in BELOW.items()}
        for b in slices(batches, 0):
            words, size = tokenize(b.column(0))
            token, distinct = with_ends(words, size)
            row = own.rows(distinct)
            e = np.concatenate([own.e[row], np.zeros((1, DIM), "f4")])
            below["rows"] = np.zeros(e.shape)
            total += output_sums(w, e, np.append(own.cls[row], 0), Windows(token, size + 1), below=below)
            E, end = to_slots(below.pop("rows")[:-1], *unlisted(own.slots.take(pa.array(row))))
            below["E"] += E
            below["end"] += end
        flat = np.concatenate([total, *[below[k].ravel() for k in BELOW]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ALL_SUMS)), pa.array(flat)], ["i", "s"])

    found = texts.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(ALL_SUMS)
    sums[found.column("i").to_numpy()] = found.column("s").to_numpy()
    parts = np.split(sums[SUMS:], np.cumsum([math.prod(v) for v in BELOW.values()])[:-1])
    return sums[:SUMS], {k: x.reshape(BELOW[k]) for k, x in zip(BELOW, parts)}


def score(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    base_score: log10 of add-one unigram probabilities of words and end; score: log10 of the model's probability of
    the text. A null or empty text is its end alone; texts of any length are scored whole. Repeated rows are scored
    (and learnt from) each; ids may be null. Without training documents the weights are the initial ones. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession, 1000)
    d = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    texts = d.where(~held_out(F.col("doc_id"))).select("text")
    counts = cut(count_words(texts), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    w, lex, of_open, once = learn(texts, counts, ranks_path, **how)
    log_all = math.log10(n + v + 1)

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        own = worker_table(lex, w)
        words, size = tokenize(b.column(2))
        token, distinct = with_ends(words, size)
        row = own.rows(distinct)
        e, cls = np.concatenate([own.e[row], np.zeros((1, DIM), "f4")]), np.append(own.cls[row], 0)
        win = Windows(token, size + 1)
        begin, open_ = win.begin[:-1], row >= own.frequent
        nats = class_log_probabilities(w, e, cls, win) + np.where(open_, 0.0, own.lp[row])[token]
        count = np.append(lex.counts, 0)[np.where(open_, len(lex.counts), row)]
        base = np.add.reduceat(np.where(open_, 0.0, np.log10(count + 1))[token], begin) - (size + 1) * log_all
        known = np.add.reduceat((count > 0).astype("i8")[token], begin)
        tail = np.flatnonzero(open_[token])
        key, times = np.unique(np.repeat(np.arange(len(size)), size + 1)[tail] * len(distinct) + token[tail], return_counts=True)
        ends = np.searchsorted(key // len(distinct), np.arange(len(size) + 1)).astype("i4")
        which = key % len(distinct)
        tails = pa.StructArray.from_arrays([distinct.take(pa.array(which)), pa.array(times.astype("i8")), pa.array((cls[which] - DIRECT - GROUPS).astype("i4")), pa.array(own.lp[row][which])], ["word", "n", "k", "lp"])
        cols = [pa.array((size + 1).astype("i8")), pa.array(known), pa.array(base), pa.array(np.add.reduceat(nats, begin) / math.log(10)), pa.ListArray.from_arrays(ends, tails)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["rid", "doc_id", "n_tokens", "n_top", "base", "score", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            yield judge(b)

    rows = d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_tokens long, n_top long, base double, score double, tail array<struct<word:binary,n:long,k:int,lp:double>>")
    rows = cut(rows, "scores")
    # an open word: of the mass of its class, spelling has what words met once had, and counts share the rest
    spelt = (once + 1) / (of_open + 1)
    of = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("k") + 1)
    counted = of((1 - spelt) / np.maximum(of_open, 1)) * F.col("c")
    log_open = F.when(counted > 0, F.log10(counted + of(spelt) * F.exp("lp"))).otherwise(F.col("lp") / math.log(10) + F.log10(of(spelt)))
    tail = rows.select("rid", F.explode("tail").alias("t")).select("rid", "t.*").join(counts, "word", "left")
    more = tail.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("n_more"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base_more"), F.sum(F.col("n") * log_open).alias("score_more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("tail").join(more, "rid", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_top") + zero("n_more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"), (F.col("score") + zero("score_more")).alias("score"),
    )
