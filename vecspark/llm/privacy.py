"""Personal data: pattern spans, and an information-theoretic pass over the words of the texts that hold them.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Their values are the protected
entities. Over the corpus, a word t that shares n_et documents with an entity e, of n_t that hold t (outside base spans)
and n_e that hold e, discloses PMI(t; e) = log2(n_et N / (n_t n_e)) bits of IC(e) = log2(N / n_e). Words that disclose at least
``generalise_at`` of it are replaced by a general term, those that disclose ``remove_at`` (all of it) are removed,
wherever they stand in a text that holds the entity.
Everything is DataFrame functions: no Python runs on the executors. Counts are aggregated before they are shuffled,
so that an entity or a word that a third of all documents share is one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import let
from .tables import column, cut, drop

#: Possessive loops, so that Java matches them without recursion; an address starts a run of its characters, or
#: where the last match ended, and digits start a run of digits, so no start is tried in vain inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
WORD = r"[\p{L}\p{N}]+"
RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"  # all of a text
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def walk(text: Column, pattern: str, kind: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """Matches of a pattern as spans in code points (end exclusive), from the matches and the texts between them.

    Matches that are not ``ok`` are dropped; the search goes on behind them.
    """
    empty = F.array().cast(SPAN)

    def place(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.char_length(x["between"])
            end = start + F.char_length(x["found"])
            span = F.array(F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), x["found"].alias("value")))
            out = F.concat(acc["out"], span) if ok is None else F.when(ok(x["found"]), F.concat(acc["out"], span)).otherwise(acc["out"])
            return F.struct(end.cast("int").alias("at"), out.alias("out"))

        pairs = F.zip_with(between, found, lambda b, m: F.struct(b.alias("between"), m.alias("found")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, empty).otherwise(place(found)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, twice).otherwise(n)

    marks = F.transform(F.split(F.reverse(digits), ""), lambda d: d)
    values = F.transform(F.filter(marks, lambda d: d != ""), add)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.length(d).between(16, 19) & luhn(d))


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 4) & (F.coalesce(F.when(q == "", 0).otherwise(F.try_to_number(q, F.lit("999")).cast("int")), F.lit(0)) <= 255)))


def base_spans(text: Column) -> Column:
    """All base spans of a text without nulls, by kind as listed, then by start."""
    ok = {"email": None, "ip": _ip, "card": _card, "phone": lambda v: F.length(_digits(v)).between(8, 15)}
    needs = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    empty = F.array().cast(SPAN)
    each = [walk(text, PATTERNS[k], k, ok[k]) if needs[k] is None else F.when(F.contains(text, F.lit(needs[k])), walk(text, PATTERNS[k], k, ok[k])).otherwise(empty) for k in KINDS]
    return F.concat(*each)


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with the characters of its spans blanked, so that all places stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(acc["at"], s["start"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(gap, blank)).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    return let(done, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.char_length(text))))


def _places(held: DataFrame) -> DataFrame:
    """``rid, start, end, term``: every word of ``held(rid, masked)``, lower-cased, with its place in the text."""
    runs = held.select("rid", F.posexplode(F.regexp_extract_all("masked", F.lit(RUNS), 0)).alias("pos", "run"))
    before = Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = runs.withColumn("end", F.sum(F.char_length("run")).over(before).cast("int"))
    return placed.where(F.col("run").rlike(WORD) & (F.char_length("run") > 2)).select("rid", (F.col("end") - F.char_length("run")).alias("start"), "end", F.lower("run").alias("term"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.8, remove_at: float = 1.0, min_support: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rid, doc_id, base, terms``: base and term spans of every row; a column c in ``keep`` follows as k_c.

    rid numbers the rows. A null text has no spans; repeated rows have spans each and count as documents each; a
    word can disclose an entity from ``min_support`` common documents on (one: also entities of a single document,
    whose words disclose 1 - log n_t / log N); an empty table gives no rows.
    """
    d = docs.select(F.monotonically_increasing_id().alias("rid"), column(id_col).cast("long").alias("_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("_text"), *[column(c).alias(f"k_{c}") for c in keep])
    d = d.withColumn("base", base_spans(F.col("_text"))).withColumn("masked", F.when(F.size("base") > 0, mask(F.col("_text"), F.col("base"))))
    long = F.filter(F.regexp_extract_all(F.coalesce("masked", "_text"), F.lit(WORD), 0), lambda w: F.char_length(w) > 2)
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    spans = cut(d.select("rid", F.col("_id").alias("doc_id"), "base", entities.alias("entities"), "masked", F.array_distinct(F.transform(long, lambda w: F.lower(w))).alias("said"), *[column(f"k_{c}") for c in keep]), "spans")
    total = F.log2(F.lit(float(max(1, spans.count()))))

    held = spans.where(F.size("base") > 0)
    of = held.select("rid", F.explode("entities").alias("entity"))
    # entities of the very same documents disclose the same: they count as one
    same = of.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("rid")).alias("e1"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("e2"))
    entity = ["n_e", "e1", "e2"]
    of = of.join(same, "entity").select("rid", *entity).distinct()
    occurs = held.select("rid", "said").join(of, "rid").select("rid", *entity, F.explode("said").alias("term"))
    n_et = cut(occurs.groupBy(*entity, "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_support), "pairs")
    n_t = spans.select(F.explode("said").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    share = (F.log2("n_et") + total - F.log2("n_t") - F.log2("n_e")) / (total - F.log2("n_e"))
    telling = n_et.where(total > F.log2("n_e")).join(n_t, "term").withColumn("share", share).where(F.col("share") >= generalise_at - 1e-9)
    telling = cut(telling.select(*entity, "term", "share"), "telling")
    drop(n_et)
    told = occurs.join(telling.select(*entity, "term", "share"), [*entity, "term"]).groupBy("rid", "term").agg(F.max("share").alias("share"))
    hits = _places(held.select("rid", "masked")).join(told, ["rid", "term"])
    action = F.when(F.col("share") >= remove_at - 1e-9, "remove").otherwise("generalise")
    terms = hits.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", action.alias("value")))).alias("terms"))
    terms = cut(terms, "terms")
    drop(telling)
    # a row without base spans holds no entity: it needs no join
    typed = F.coalesce(F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"))), F.array().cast(SPAN))
    with_ = held.join(terms, "rid", "left").withColumn("terms", typed)
    without = spans.where(F.size("base") == 0).withColumn("terms", F.array().cast(SPAN))
    cols = ["rid", "doc_id", "base", "terms", *[column(f"k_{c}") for c in keep]]
    return with_.select(cols).unionByName(without.select(cols))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find`'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "terms")).alias("spans"))


def apply(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind, and terms by ``[TERM]`` or by nothing; overlaps count once."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"] == "remove", "").otherwise("[TERM]").alias("by"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(inside, F.array().cast("array<string>")).otherwise(F.array(gap, s["by"]))).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(let(done, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.char_length(text)))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with personal data and disclosing words out of their texts; columns and rows as they were.

    A null text stays null.
    """
    found = find(docs, id_col, text_col, keep=tuple(docs.columns), **how)
    text = column(f"k_{text_col}")
    clean = F.when(text.isNotNull(), apply(text, F.concat("base", "terms")))
    return found.select(*[(clean if c == text_col else column(f"k_{c}")).alias(c) for c in docs.columns])
