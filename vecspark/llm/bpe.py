"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database per Python worker.

Encoding: a text is cut at blanks and line ends into parts, which Arrow numbers a batch at a time; only parts that a
worker has not met before go on. These are cut into the pieces of the tokenizer's pattern, and the pieces go through one
recursive query: their token-position rows join the merge table, the leftmost pair of least rank of each word is
contracted, and so on until no pair of any word is in the table. Decoding joins token-position rows with the vocabulary
and concatenates them by an ordered aggregation. Answers for recent parts are kept in a bounded table, which
only saves time. No data is shuffled, a text never leaves its row.

A piece longer than WINDOW bytes goes through the query as overlapping windows. A sequence of tokens is the encoding of
its bytes if and only if each two neighbours are the encoding of their own bytes; so two windows that share a token can
be joined there, all neighbours being neighbours within a window. Windows that share none are made twice as long.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column, small_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: ws(w, ids): words as token ids. pos counts from 1; a key orders by rank, then by place. Of each word the last step stays.
CONTRACT = """
WITH RECURSIVE bpe(w, ids) USING KEY (w) AS (
    SELECT w, ids FROM ws
  UNION
    SELECT w, list_concat(list_append(bpe.ids[:best.k % 4294967296 - 1], (best.k // 4294967296)::INT), bpe.ids[best.k % 4294967296 + 2:])
    FROM bpe JOIN (
        SELECT w, min(merged::BIGINT * 4294967296 + pos) AS k
        FROM (SELECT w, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, unnest(generate_series(1, len(ids) - 1)) AS pos FROM bpe)
        JOIN merges USING (a, b) GROUP BY w) best USING (w)
)
SELECT array_to_string(ids, ' ') || ' ' AS ids, len(ids) AS n FROM bpe ORDER BY w
"""
#: Bytes of a piece that the query takes as they are.
WINDOW = 96
#: seqs(s, ids): sequences of token ids. One sort of all rows orders every sequence for the aggregation; the
#: connection has one thread, so the rows reach it in that order.
DECODE = """
SELECT s, string_agg(t, '') AS t, count(*) = count(t) AS found FROM (
    SELECT s, t FROM (SELECT s, unnest(ids) AS id, unnest(generate_series(1, len(ids))) AS pos FROM seqs) LEFT JOIN vocab USING (id)
    ORDER BY s, pos)
GROUP BY s ORDER BY s
"""
#: Texts that are not cut into parts at each blank and line end, but into pieces one by one: with three of these in a row, two
#: at the end, or other white space. (Of two in a row the pattern always takes the first by itself.)
ODD = "[ \n]{3}|[ \n]{2}\\z|[\x00" + "".join(chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "]"


def load_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Recent(dict):
    """A dictionary that forgets what two generations of at most ``limit`` entries have not used."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def missing(self, keys: Iterable) -> list:
        """The keys that are in neither generation; the others are in the newer one afterwards."""
        out = []
        for k in keys:
            if k not in self:
                v = self.old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def acyclic(method):
    """Run without the collector of cycles: there are none here, and it would walk all kept entries again and again."""

    @functools.wraps(method)
    def run(*args):
        on = gc.isenabled()
        gc.disable()
        try:
            return method(*args)
        finally:
            if on:
                gc.enable()

    return run


def joined(values: pa.Array, codes: pa.Array, ends: np.ndarray) -> pa.Array:
    """Of lists of numbers, which end at ``ends`` (from 0), the values (string or binary) one after the other."""
    got = values.take(codes)
    _, offsets, data = got.buffers()
    at = np.frombuffer(offsets, "i4")[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, "i4")
    return pa.Array.from_buffers(got.type, len(ends) - 1, [None, pa.py_buffer(at[ends].astype("i4")), data if data is not None else pa.py_buffer(b"")])


def sums(n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(n)])[ends]).astype("i8")


def views(texts: pa.Array) -> Iterator[memoryview]:
    _, offsets, data = texts.buffers()
    view, at = memoryview(data), np.frombuffer(offsets, "i4")[: len(texts) + 1].tolist()
    return (view[i:j] for i, j in zip(at, at[1:]))


class Parts(NamedTuple):
    """Texts as lists of numbers of distinct parts, and what is known of these."""

    ends: np.ndarray  # where each text's numbers end, from 0
    codes: pa.Array
    ids: pa.Array  # of each distinct part the decimal ids, a blank behind each
    n: np.ndarray  # how many
    raw: pa.Array  # what they decode to

    def lengths(self) -> np.ndarray:
        return sums(self.n[self.codes.to_numpy()], self.ends)

    def lists(self) -> pa.Array:
        """The ids of each text, as lists."""
        own = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(self.n)]).astype("i4"), numbers(self.ids))
        ends = np.concatenate([[0], np.cumsum(self.lengths())]).astype("i4")
        return pa.ListArray.from_arrays(ends, own.take(self.codes).flatten())


def numbers(ids: pa.Array) -> pa.Array:
    """All ids of an array of decimal ids, a blank behind each."""
    return pa.array(np.array("".join(ids.to_pylist()).split(), "i4"))


class Codec:
    """Encoder and decoder of one vocabulary, with one single-threaded DuckDB connection that never spills."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, limit: int = 600_000, memory: str = "512MB"):
        import duckdb
        import regex

        self.find, self.limit = regex.compile(pattern).findall, limit
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], "i4")
        self.tokens, self.names = pa.array(list(ranks), pa.binary()), pa.array([f"{r} " for r in ranks.values()])
        self.length = {str(r): len(t) for t, r in ranks.items()}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._load("merges", pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("a", "b", "merged"), zip(*rows) if rows else ((), (), ()))}))
        # a byte stands as the character of the same number, so that text functions keep arbitrary bytes
        self._load("vocab", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "t": pa.array([t.decode("latin-1") for t in ranks])}))
        self.known = pa.table({"part": pa.array([], pa.string()), "ids": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "raw": pa.array([], pa.binary())})
        self.used = np.zeros(0, bool)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _ask(self, view: str, rows: pa.Table, sql: str) -> pa.Table:
        self.con.register(view, rows)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(view)
        return out.combine_chunks()

    def contract(self, words: pa.Array, window: int = WINDOW) -> tuple[pa.Array, np.ndarray]:
        """The ids of each word (bytes of one piece, not empty): decimal, a blank behind each; and how many."""
        token = pa.compute.index_in(words, value_set=self.tokens)
        size = pa.compute.binary_length(words).to_numpy()
        whole = token.is_valid().to_numpy(zero_copy_only=False)
        some, far = np.flatnonzero(~whole & (size <= window)), np.flatnonzero(~whole & (size > window))
        texts, counts, place = [self.names.take(token.drop_null())], [np.ones(int(whole.sum()), "i8")], [np.flatnonzero(whole)]
        for rows in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[some]) // 2_000_000)) + 1):  # so many bytes a query
            if len(rows):
                chosen = words.take(pa.array(rows))
                ids = self.bytes[np.frombuffer(chosen.buffers()[2], "u1")[: int(size[rows].sum())]]
                ends = np.concatenate([[0], np.cumsum(size[rows])]).astype("i4")
                got = self._ask("ws", pa.table({"w": pa.array(np.arange(len(rows), dtype="i4")), "ids": pa.ListArray.from_arrays(ends, pa.array(ids))}), CONTRACT)
                texts.append(got.column("ids").chunk(0).cast(pa.string()))
                counts.append(got.column("n").to_numpy().astype("i8"))
                place.append(rows)
        for i in far:
            ids = self._long(words[i].as_py(), window)
            texts.append(pa.array([" ".join(ids) + " "]))
            counts.append(np.array([len(ids)]))
            place.append(np.array([i]))
        order = np.argsort(np.concatenate(place))
        return pa.concat_arrays(texts).take(pa.array(order)), np.concatenate(counts)[order]

    def _long(self, word: bytes, window: int) -> list[str]:
        """The ids of a word, from windows that overlap by half."""
        starts = range(0, len(word) - window // 2, window // 2)
        cuts = [word[s : s + window] for s in starts]
        distinct = list(dict.fromkeys(cuts))
        known = {c: ids.split() for c, ids in zip(distinct, self.contract(pa.array(distinct, pa.binary()), window)[0].to_pylist())}
        tokens, ends = [], [0]  # a token and where it ends
        for s, c in zip(starts, cuts):
            own, at = known[c], s
            place = {}
            for j, t in enumerate(own):
                place[at, at + self.length[t]] = j
                at += self.length[t]
            i = len(tokens) - 1
            while i >= 0 and ends[i] >= s and (ends[i], ends[i + 1]) not in place:
                i -= 1
            if tokens and (i < 0 or ends[i] < s):  # no token in common
                return self.contract(pa.array([word], pa.binary()), 2 * window)[0][0].as_py().split()
            after = place[ends[i], ends[i + 1]] + 1 if tokens else 0
            del tokens[i + 1 :], ends[i + 2 :]
            for t in own[after:]:
                tokens.append(t)
                ends.append(ends[-1] + self.length[t])
        return tokens

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each text's parts end, and the parts, none of them empty."""
        odd = pa.compute.match_substring_regex(texts, ODD)
        plain = texts.filter(pa.compute.invert(odd))
        marked = pa.compute.replace_substring(pa.compute.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        lists = pa.compute.split_pattern(marked, "\0")
        if len(plain) < len(texts):
            lists = self._both(odd, lists, pa.array([self.find(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string())))
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
        flat = lists.flatten()
        some = pa.compute.binary_length(flat).to_numpy() > 0
        if not some.all():
            flat, ends = flat.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[ends]
        return ends.astype("i8"), flat

    @staticmethod
    def _both(second: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        """Rows of ``b`` where ``second``, of ``a`` elsewhere, in order."""
        at = second.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([a, b]).take(pa.array(np.where(at, len(a) + np.cumsum(at) - 1, np.cumsum(~at) - 1)))

    def _pieces(self, parts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where each part's pieces end, and the pieces. ASCII letters are one piece, and so is white space; the others are
        searched all in one go between line ends."""
        plain = pa.compute.match_substring_regex(parts, r"\A ?[A-Za-z]+\z")
        rest = parts.filter(pa.compute.invert(plain)).to_pylist()
        found: list[list[str]] = []
        for x in self.find("\n".join([p for p in rest if not p.isspace()])):
            if x == "\n":
                found.append([])
            elif found:
                found[-1].append(x)
            else:
                found = [[x]]
        at = iter(found)
        own = pa.array([[p] if p.isspace() else next(at) for p in rest], pa.list_(pa.string()))
        alone = parts.filter(plain)
        lists = self._both(pa.compute.invert(plain), pa.ListArray.from_arrays(np.arange(len(alone) + 1, dtype="i4"), alone), own)
        return np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())]).astype("i8"), lists.flatten()

    def _learn(self, parts: pa.Array) -> pa.Table:
        ends, pieces = self._pieces(parts)
        numbered = pieces.dictionary_encode()
        ids, n = self.contract(numbered.dictionary.cast(pa.binary()))
        raw = self.decode(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype("i4"), numbers(ids)))
        codes = numbered.indices
        return pa.table({"part": parts, "ids": joined(ids, codes, ends), "n": pa.array(sums(n[codes.to_numpy()], ends)), "raw": joined(raw, codes, ends)})

    @acyclic
    def encode(self, texts: pa.Array) -> Parts:
        """The parts of each text of a string array without nulls, with their ids and what the ids decode to."""
        ends, flat = self._split(texts)
        numbered = flat.dictionary_encode()
        own = numbered.dictionary
        at = pa.compute.index_in(own, value_set=self.known.column("part").combine_chunks())
        new = at.is_null().to_numpy(zero_copy_only=False)
        if new.any():
            learnt = self._learn(own.filter(pa.array(new)))
            row = np.where(new, len(self.used) + np.cumsum(new) - 1, at.fill_null(0).to_numpy())
            self.known = pa.concat_tables([self.known, learnt]).combine_chunks()
            self.used = np.concatenate([self.used, np.zeros(len(learnt), bool)])
        else:
            row = at.to_numpy()
        self.used[row] = True
        got = self.known.take(pa.array(row)).combine_chunks()
        if len(self.used) > self.limit:  # what no text since the last time has used is forgotten
            self.known = self.known.filter(pa.array(self.used)).combine_chunks() if self.used.sum() <= self.limit else got.slice(0, self.limit)
            self.used = np.zeros(len(self.known), bool)
        column = lambda c: got.column(c).combine_chunks()
        return Parts(ends, numbered.indices, column("ids"), got.column("n").to_numpy(), column("raw"))

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of lists of ids (null: none), as a binary array."""
        rows = pa.table({"s": pa.array(np.arange(len(ids), dtype="i4")), "ids": ids})
        got = self._ask("seqs", rows, DECODE)
        if not pa.compute.all(got.column("found"), min_count=0).as_py():
            bad = got.filter(pa.compute.invert(got.column("found"))).column("s")[0].as_py()
            raise ValueError(f"ids outside the vocabulary: {str(ids[bad].as_py())[:80]}")
        text = got.column("t").combine_chunks().cast(pa.string())
        sizes = np.zeros(len(ids), "i8")
        sizes[got.column("s").to_numpy()] = pa.compute.utf8_length(text).to_numpy()
        raw = "".join(text.to_pylist()).encode("latin-1")
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.py_buffer(raw)])


_codecs: dict = {}


def codec(ranks_path: str, pattern: str, limit: int = 600_000) -> Codec:
    """This worker's codec; a path is on every executor, like the installed tokenizer files."""
    if (ranks_path, pattern, limit) not in _codecs:
        _codecs[ranks_path, pattern, limit] = Codec(load_ranks(ranks_path), pattern, limit)
    return _codecs[ranks_path, pattern, limit]


def _slices(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text or of ids, or one row."""
    c = batch.column(1)
    lengths = pa.compute.multiply(pa.compute.list_value_length(c), 4) if pa.types.is_list(c.type) else pa.compute.binary_length(c)
    ends = np.cumsum(lengths.fill_null(0).to_numpy())
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession, 2000)
    return docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, ids array<int>)`` per row, as an ordinary encoder without special tokens gives them.

    A null or empty text has no ids. Repeated rows are encoded each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in (s for x in batches for s in _slices(x)):
            yield pa.RecordBatch.from_arrays([b.column(0), own.encode(b.column(1)).lists()], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id long, text binary)``: the bytes that each row's ids stand for (null: none).

    An id that the vocabulary lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for b in (s for x in batches for s in _slices(x)):
            yield pa.RecordBatch.from_arrays([b.column(0), own.decode(b.column(1))], ["doc_id", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select(column(id_col).cast("long").alias("doc_id"), column(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, limit: int = 600_000) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: encode, then decode the ids, in one pass.

    ids_sha256 is over the decimal ids joined by one blank, decoded_sha256 over the decoded bytes. ``with_ids`` adds
    the ids (array<int>). ``limit`` bounds the memory of recent answers, some 100 bytes an entry. A null or empty text has no ids; repeated rows are encoded each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(ranks_path, pattern, limit), lambda x: hashlib.sha256(x).hexdigest()
        for b in (s for x in batches for s in _slices(x)):
            got = own.encode(b.column(1))
            digests = [sha(t[:-1]) for t in views(joined(got.ids, got.codes, got.ends))]  # without the last blank
            back = [sha(t) for t in views(joined(got.raw, got.codes, got.ends))]
            out = [b.column(0), pa.array(got.lengths()), pa.array(digests), pa.array(back)]
            if with_ids:
                out.append(got.lists())
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
