"""Exact removal of repeated byte strings by distributed prefix doubling over a sparse suffix array.

Of every window of ``length`` bytes one position speaks: the leftmost 32-byte string of least hash in it. It depends
on the window's content alone, so equal windows have equal anchors at equal distances, and consecutive windows with
the same anchor form one run. The rounds sort (rank of a core, rank of the whole run, document, place):

* the core is what all windows of a node of distances share; it grows from 32 bytes to ``length`` as nodes narrow
  from all distances to a single one, which is the growing offset of prefix doubling;
* a run equal to one that sorts before it holds no first occurrence, all of its windows are repeated, and it is done;
* a run whose core no other run has is unique, all of its windows are first occurrences, and it is done;
* the others are split into narrower nodes and ranked again, until the core is the window itself.

The sort is a range partitioning of all four columns, so that a core, or even a run, that a third of all documents
share is dealt over many tasks. A task decides from its own stretch of the order; what it cannot see, at most one
run at either end, it passes on undecided, and the last round is an exact aggregation. Ranks are 64-bit hashes of
the core and, from other tables, of the run: equal pairs stand for equal strings.

Text is moved twice: to the anchors that the first round leaves, and to the removed ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column, cut, drop, small_batches

GRAM = 32
PLACE = 24  # bits of a window's place in a slice; slices are far below 2**24 bytes
SLICE = 1_000_000  # a scan holds some 150 bytes for each of its bytes
DIST = 10  # bits of a distance between a window and its anchor

_rng = np.random.default_rng(20240131)
TABLE = _rng.integers(0, 1 << 64, (2, 256), "u8")
BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], "u8")
_powers: list = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases and of their inverses modulo 2**64, n + 1 of each at least."""
    if not _powers or len(_powers[0][0]) <= n:
        n = max(n, SLICE + 1_000)
        inverse = np.array([pow(int(b), -1, 1 << 64) for b in BASE], "u8")
        _powers[:] = [tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)]), dtype="u8") for b in bases) for bases in (BASE, inverse)]
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any substrings of a byte array, from prefix sums; independent of where a substring stands."""

    def __init__(self, data: np.ndarray):
        self.up, down = _power(len(data))
        self.sums = []
        for t, d in zip(TABLE, down):
            s = np.zeros(len(data) + 1, "u8")
            np.cumsum(t[data] * d[: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, table: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[table]
        return (s[end] - s[start]) * self.up[table][start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _ranks(h: Hashes, core: tuple, run: tuple, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Rank columns of runs: of the core in its node, and of the whole run with the distances it covers."""
    tag = _mix((node.astype("u8") << np.uint64(32)) + np.uint64(1))
    shape = _mix((low.astype("u8") << np.uint64(DIST)) + high.astype("u8") + np.uint64(7))
    return [_mix(h.of(0, *core) + tag).view("i8"), _mix(h.of(1, *run) + shape).view("i8")]


def _pack(anchor, low, high):
    return (anchor.astype("i8") << (2 * DIST)) + (low.astype("i8") << DIST) + high.astype("i8")


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = (1 << DIST) - 1
    return at >> (2 * DIST), (at >> DIST) & m, at & m


def _anchors(parts: list[tuple[int, int, bytes]], length: int) -> list[np.ndarray]:
    """Runs of the parts (doc, offset, bytes), put one after the other: core, run, doc, at."""
    w = length - GRAM + 1
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join([p[2] for p in parts]), "u1")
    n = len(data) - length + 1
    if n <= 0:
        return [np.zeros(0, "i8")] * 4
    h = Hashes(data)
    grams = np.arange(len(data) - GRAM + 1)
    order = _mix(h.of(0, grams, grams + GRAM))
    order = (order >> np.uint64(PLACE) << np.uint64(PLACE)) | grams.astype("u8")
    rows = np.concatenate([order, np.full(-len(order) % w, (1 << 64) - 1, "u8")]).reshape(-1, w)
    before, after = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64((1 << PLACE) - 1)).astype("i8")
    part = np.repeat(np.arange(len(parts)), sizes)
    inside = part[:n] == part[length - 1 :]
    turn = (anchor[1:] != anchor[:-1]) | (part[1:n] != part[: n - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(inside & np.concatenate([[True], turn]))
    last = np.flatnonzero(inside & np.concatenate([turn, [True]]))
    a = anchor[first]
    low, high = a - last, a - first
    doc, offset = np.array([p[0] for p in parts], "i8")[part[first]], np.array([p[1] for p in parts], "i8")[part[first]]
    return [*_ranks(h, (a, a + GRAM), (first, last + length), np.zeros(len(a), "i8"), low, high), doc, _pack(a - begin[part[first]] + offset, low, high)]


def _scan(length: int):
    """First ranks of all documents. Long ones are cut into overlapping parts, which share no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            return pa.RecordBatch.from_arrays(list(map(pa.array, _anchors(parts, length))), ["core", "run", "doc", "at"])

        for b in batches:
            parts, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_buffer().to_pybytes()
                for at in range(0, max(1, len(data) - length + 1), SLICE // 2):
                    parts.append((doc, at, data[at : at + SLICE // 2 + length - 1]))
                    size += len(parts[-1][2])
                    if size > SLICE // 2:
                        yield flush(parts)
                        parts, size = [], 0
            if parts:
                yield flush(parts)

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a sorted stretch (core, run, doc, at, ...): repeated runs, and open ones whose core may have another run.

    The first and the last core of a stretch may go on in the next one, and count as having another run.
    """
    prev: tuple | None = None  # core and run before this batch
    held: pa.RecordBatch | None = None  # the last distinct run so far, while it is alone with its core
    for b in batches:
        if not b.num_rows:
            continue
        core, run = b.column(0).to_numpy(), b.column(1).to_numpy()
        same = np.concatenate([[prev == (core[0], run[0])], (core[1:] == core[:-1]) & (run[1:] == run[:-1])])
        new = np.flatnonzero(~same)
        if same.any():
            yield _said(b.take(pa.array(np.flatnonzero(same))), True)
        if len(new):
            c = core[new]
            follows = np.concatenate([[prev is None or prev[0] == c[0]], c[1:] == c[:-1]])
            if held is not None:
                if follows[0]:
                    yield _said(held, False)
                held = None
            leads = np.concatenate([c[1:] == c[:-1], [False]])
            if (follows | leads).any():
                yield _said(b.take(pa.array(new[follows | leads])), False)
            if not follows[-1]:
                held = b.slice(int(new[-1]), 1)
        prev = (core[-1], run[-1])
    if held is not None:
        yield _said(held, False)


def _said(b: pa.RecordBatch, repeated: bool) -> pa.RecordBatch:
    cols = [b.column(2), b.column(3), pa.array(np.full(b.num_rows, repeated))]
    ctx = [b.column(4) if not repeated else pa.nulls(b.num_rows, pa.binary())] if b.num_columns > 4 else []
    return pa.RecordBatch.from_arrays(cols + ctx, ["doc", "at", "repeated", "ctx"][: len(cols + ctx)])


def _narrow(spans: int, length: int):
    """Split open runs (doc, at, ctx: the run's bytes) into nodes of at most ``spans`` distances, and rank those."""
    starts = np.arange(0, length - GRAM + 1, spans)
    ends = np.minimum(starts + spans - 1, length - GRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                ctx = b.column(2).to_pylist()
                begin = np.cumsum([0, *map(len, ctx)])[:-1]
                data = np.frombuffer(b"".join(ctx), "u1")
                anchor, low, high = _unpack(b.column(1).to_numpy())
                a, b1 = low // spans, high // spans
                row = np.repeat(np.arange(len(ctx)), b1 - a + 1)
                node = np.arange(len(row)) - np.repeat(np.cumsum(b1 - a + 1) - (b1 - a + 1), b1 - a + 1) + a[row]
                lo, hi = np.maximum(starts[node], low[row]), np.minimum(ends[node], high[row])
                zero = begin[row] + high[row]  # where the anchor stands in data
                span = (zero - hi, zero - lo + length)
                ranks = _ranks(Hashes(data), (zero - starts[node], zero - ends[node] + length), span, node, lo, hi)
                cols = [*map(pa.array, ranks), b.column(0).take(pa.array(row)), pa.array(_pack(anchor[row], lo, hi)), pa.array([data[s:e].tobytes() for s, e in zip(*span)] if spans > 1 else [None] * len(row), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["core", "run", "doc", "at", "ctx"])

    return run


def _contexts(length: int):
    """Bytes of the open runs of a document: (doc, ats, text) to (doc, at, ctx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, at, ctx = [], [], []
            for d, ats, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = text.as_buffer().to_pybytes()
                own = ats.values.to_numpy()
                a, low, high = _unpack(own)
                doc += [d] * len(own)
                at.append(own)
                ctx += [data[s:e] for s, e in zip(a - high, a - low + length)]
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.concatenate(at)), pa.array(ctx, pa.binary())], ["doc", "at", "ctx"])

    return run


def _remove(length: int):
    """Digest of what is left of each text, whose repeated windows start in the ranges ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, ats, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = np.frombuffer(text.as_buffer(), "u1")
                gone = np.zeros(len(data) + 1, "i4")
                if ats.is_valid and len(ats):
                    a, low, high = _unpack(ats.values.to_numpy())
                    np.add.at(gone, a - high, 1)
                    np.add.at(gone, a - low + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(bool(len(gone)) and bool(gone[0]))
                rows.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest(), data[~gone].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["core", "run", "doc", "at"]
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def repeats(docs: DataFrame, length: int = 100, spans: tuple[int, ...] = (18, 5, 1)) -> list[DataFrame]:
    """Tables ``(doc, at)`` of runs of repeated windows, for ``docs(doc long unique, text)`` without nulls."""
    open_ = "doc long, at long, repeated boolean"
    ranked = docs.where(F.octet_length("text") >= length).mapInArrow(_scan(length), "core long, run long, doc long, at long")
    said = cut(_sorted(ranked).mapInArrow(_decide, open_), "runs")
    found = [said.where("repeated").select("doc", "at")]
    ats = said.where("not repeated").groupBy("doc").agg(F.collect_list("at").alias("ats"))  # a document's own anchors
    texts = docs.join(ats.hint("shuffle_hash"), "doc").select("doc", "ats", "text")
    left = contexts = cut(texts.mapInArrow(_contexts(length), "doc long, at long, ctx binary"), "contexts")
    for s in spans[:-1]:
        ranked = left.mapInArrow(_narrow(s, length), "core long, run long, doc long, at long, ctx binary")
        said = cut(_sorted(ranked).mapInArrow(_decide, open_ + ", ctx binary"), "runs")
        if contexts is not None:
            drop(contexts)
            contexts = None
        found.append(said.where("repeated").select("doc", "at"))
        left = said.where("not repeated").select("doc", "at", "ctx")
    last = cut(left.mapInArrow(_narrow(spans[-1], length), "core long, run long, doc long, at long, ctx binary").drop("ctx"), "windows")
    first = last.groupBy("core", "run").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    found.append(cut(last.join(first, ["core", "run"]).where(F.struct("doc", "at") != F.col("first")).select("doc", "at"), "repeats"))
    return found


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary)``, one row per document.

    Every byte covered by a ``length``-byte string that also starts earlier (in a document of smaller id, or earlier
    in the same one; overlaps count) is removed, as judged on the input. Matches never cross documents; a null text
    is empty. Where ids are null or repeated, documents go in the order of id (null first), then text, and each row
    is one document. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    unsure = d.select("doc_id").groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if unsure:
        d = cut(d.orderBy("doc_id", "text").withColumn("doc", F.monotonically_increasing_id()), "ordered")
    else:
        d = d.withColumn("doc", F.col("doc_id"))
    found, *more = repeats(d.select("doc", "text"), length)
    for x in more:
        found = found.unionByName(x)
    ats = found.groupBy("doc").agg(F.collect_list("at").alias("ats"))  # a document's own ranges
    joined = d.select("doc", "text").join(ats.hint("shuffle_hash"), "doc", "left").select("doc", "ats", "text")
    out = joined.mapInArrow(_remove(length), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if unsure:
        return out.join(d.select("doc", "doc_id"), "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out.withColumnRenamed("doc", "doc_id")
