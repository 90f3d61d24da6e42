"""Tool calls of conversations: linked to results by identifier, ordered, validated, and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). The order is topological over the references
between calls: depth 0 has no reference, any other call is one deeper than the deepest call it refers to. A call with
one open reference is a link of a chain; chains are shortened by pointer doubling, in as many rounds as the logarithm of
their length. What is left are calls with several open references, which are settled layer by layer, each layer over
chains of any length. (depth, position) is the order, so no conversation is ever gathered in one place, however long.
Rows are validated and serialised one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, drop, new_path, small_batches

KEY = ["conv_id", "call_id"]
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: What a schema may say; the last line only describes.
KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items"}
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}


def canonical(value) -> str:
    """Sorted keys, no blanks, Unicode as it is (a lone surrogate, which UTF-8 cannot hold, as an escape), no NaN."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = "".join(f"\\u{ord(c):04x}" if "\ud800" <= c <= "\udfff" else c for c in text)
    return text


def check_schema(schema: dict, at: str = "$") -> None:
    """Raise ValueError for a type or keyword that :func:`violations` does not know, at any depth."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema is an object")
    if unknown := sorted(set(schema) - KEYWORDS - NOTES):
        raise ValueError(f"{at}: unknown keywords {unknown}")
    kinds = schema.get("type", [])
    if odd := sorted(set([kinds] if isinstance(kinds, str) else kinds) - {*TYPES, "integer", "number"}):
        raise ValueError(f"{at}: unknown types {odd}")
    for k, s in schema.get("properties", {}).items():
        check_schema(s, f"{at}.{k}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties is true or false")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, bounds, lengths, required, properties, items, additionalProperties."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in [canonical(v) for v in schema["enum"]]:
        out.append(f"{at}: not in enum")
    if _is(value, "number"):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _jumps(links: DataFrame) -> DataFrame:
    """``links(conv_id, call_id, ref, d, c)``, one row a call, with ref moved on to the first call that is no link.

    A row says depth = max(c, depth(ref) + d). Links on a cycle, or that lead to one, are left out: they are those that
    still refer to a link after as many steps as the largest conversation has links.
    """
    longest = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    chain, steps = links, 1
    while steps < longest:
        ahead = chain.select("conv_id", F.col("call_id").alias("ref"), F.col("ref").alias("r2"), F.col("d").alias("d2"), F.col("c").alias("c2"))
        moved = chain.select(*KEY, "ref", "d", "c").join(ahead, ["conv_id", "ref"], "left").select(
            *KEY, F.coalesce("r2", "ref").alias("ref"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            F.greatest("c", F.col("c2") + F.col("d")).alias("c"), F.col("r2").isNotNull().alias("moved"),
        )
        moved = cut(moved, "chain")
        if chain is not links:
            drop(chain)
        chain, steps = moved, 2 * steps
        if not chain.where("moved").limit(1).count():
            break
    heads = links.select("conv_id", F.col("call_id").alias("ref"))
    return chain.select(*KEY, "ref", "d", "c").join(heads, ["conv_id", "ref"], "left_anti").select(*KEY, "ref", "d", "c")


def _depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` of every distinct call that lies on no cycle and leads to none; unknown references
    do not count."""
    spark, kept, layer = calls.sparkSession, new_path(calls.sparkSession, "depths"), "conv_id long, call_id string, depth long"
    nodes = calls.select(*KEY).where("conv_id is not null and call_id is not null").distinct()
    edges = calls.select(*KEY, F.explode(F.array_distinct("refs")).alias("ref")).distinct()
    edges = edges.join(nodes.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"])
    sizes = edges.groupBy(*KEY).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    open_ = cut(edges.join(sizes, KEY).select(*KEY, "ref", F.lit(1).cast("long").alias("d"), zero.alias("c"), "n"), "refs")
    nodes.join(open_.select(*KEY), KEY, "left_anti").withColumn("depth", zero).write.parquet(f"{kept}/0")
    rounds = 1
    while open_.limit(1).count():
        jumps = cut(_jumps(open_.where("n = 1").drop("n")), "jumps")
        ahead = jumps.select("conv_id", F.col("call_id").alias("ref"), F.col("ref").alias("r2"), F.col("d").alias("d2"), F.col("c").alias("c2"))
        several = open_.where("n > 1").join(ahead, ["conv_id", "ref"], "left").select(*KEY, F.coalesce("r2", "ref").alias("ref"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.greatest("c", F.col("c2") + F.col("d")).alias("c"))
        several = several.groupBy(*KEY, "ref").agg(F.max("d").alias("d"), F.max("c").alias("c"))
        # only the last layer can meet a reference: those to earlier layers have gone with them
        last = spark.read.schema(layer).parquet(f"{kept}/{rounds - 1}").withColumnRenamed("call_id", "ref")
        met = jumps.unionByName(several).join(last, ["conv_id", "ref"], "left")
        met = cut(met.select(*KEY, "ref", "d", F.greatest("c", F.col("depth") + F.col("d")).alias("c"), F.col("depth").isNull().alias("open")), "met")
        floors = cut(met.groupBy(*KEY).agg(F.max("c").alias("c"), F.count_if("open").alias("n")), "floors")
        floors.where("n = 0").select(*KEY, F.col("c").alias("depth")).write.parquet(f"{kept}/{rounds}")
        rounds += 1
        before, open_ = open_, cut(met.where("open").select(*KEY, "ref", "d").join(floors.where("n > 0"), KEY), "refs")
        settled = spark.read.schema(layer).parquet(f"{kept}/{rounds - 1}").limit(1).count()
        for t in (before, jumps, met, floors):
            drop(t)
        if not settled:  # of the calls that can be settled, one without an open reference would have been
            break
    drop(open_)
    return spark.read.schema(layer).parquet(*[f"{kept}/{i}" for i in range(rounds)])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without call.

    ``calls(conv_id long, call_id string, position long, name string, arguments string, refs array<string>)`` and
    ``results(conv_id, call_id, position, content)`` give ``conv_id, call_id, position, depth, status, problems,
    result_position, n_results, json``. The first result of a call is linked. status: ok, pending (no result),
    duplicate (its id came before in the conversation; not linked), cycle (no topological place; depth null),
    early (its result stands before it), orphan (a result without call). problems: schema violations and unknown
    references. json: null where the arguments are no JSON or nest deeper than Python's parser follows (some thousand
    levels). A null conv_id or call_id links with nothing. Empty tables give no rows; repeated rows are duplicates;
    other columns are ignored, whatever their names; texts of any length are taken whole. A schema with a type or
    keyword beyond ``KEYWORDS`` is a ValueError here, before any row is read.
    """
    for name, s in schemas.items():
        check_schema(s, name)
    small_batches(calls.sparkSession)
    calls = calls.select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("position").cast("long"), F.col("name").cast("string"), F.col("arguments").cast("string"), F.coalesce(F.col("refs"), F.array().cast("array<string>")).alias("refs"))
    calls = cut(calls.withColumn("nr", F.monotonically_increasing_id()), "calls")
    first = calls.groupBy(*KEY).agg(F.min(F.struct("position", "nr")).alias("first"))
    found = results.groupBy(*KEY).agg(F.min(F.struct("position", "content")).alias("r"), F.count("*").alias("n_results"))
    known = calls.select(*KEY).distinct()
    asked = calls.select(*KEY, F.explode("refs").alias("ref")).join(known.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("known")), ["conv_id", "ref"], "left")
    lost = asked.where("known is null").groupBy(*KEY).agg(F.collect_set("ref").alias("lost"))
    # all joins are on one key, so that arguments and contents are shuffled once
    rows = calls.withColumn("call", F.lit(True)).join(first, KEY, "left").join(_depths(calls), KEY, "left").join(lost, KEY, "left").withColumnsRenamed({"conv_id": "c"})
    rows = rows.withColumn("dup", ~F.coalesce(F.struct("position", "nr") == F.col("first"), F.lit(True)))
    right = found.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rid"), "r", "n_results")
    both = rows.join(right, (rows["c"] == right["rc"]) & (rows["call_id"] == right["rid"]), "full_outer")
    mine = lambda c: F.when(~F.coalesce("dup", F.lit(False)), F.col(c))  # noqa: E731  (a duplicate call is not linked)
    both = both.withColumns({"r": mine("r"), "rc": mine("rc"), "n_results": mine("n_results"), "lost": F.array_sort(F.array_intersect("refs", "lost"))})
    # a result whose call exists always meets the first call of its id, so what is left alone is an orphan
    cid, pos, rpos = F.coalesce("call_id", "rid"), F.col("position"), F.col("r.position")
    is_call, has_result = F.col("call").isNotNull(), F.col("rc").isNotNull()
    placed = F.col("depth").isNotNull() | cid.isNull() | F.col("c").isNull()
    status = F.when(~is_call, "orphan").when(F.col("dup"), "duplicate").when(~placed, "cycle").when(~has_result, "pending").when(F.coalesce(rpos < pos, F.lit(False)), "early").otherwise("ok")
    both = both.select(
        F.coalesce("c", "rc").cast("long").alias("conv_id"), cid.alias("call_id"), pos.alias("position"), F.col("depth").cast("int").alias("depth"), status.alias("status"), rpos.cast("long").alias("result_position"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), is_call.alias("call"), has_result.alias("here"), "name", "arguments", F.col("r.content").cast("string").alias("content"), "lost",
    )
    n = 7  # the columns that pass through

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            problems, texts = [], []
            for cid, call, here, name, arguments, content, lost in zip(b.column(1).to_pylist(), *(c.to_pylist() for c in b.columns[n:])):
                bad, text = [], None
                if call:
                    bad = [f"unknown reference {x}" for x in lost or []]
                    try:
                        args = json.loads(arguments or "", parse_constant=_no_constant)
                        message = {"arguments": args, "id": cid, "name": name}
                        text = canonical(message | {"result": content} if here else message)
                        bad += violations(args, schemas[name]) if name in schemas else [f"unknown tool {name}"]
                    except RecursionError:
                        bad.append("arguments nest too deep")
                    except ValueError:
                        bad.append("arguments are no JSON")
                else:
                    text = canonical({"content": content, "role": "tool", "tool_call_id": cid})
                problems.append(bad)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(problems, pa.list_(pa.string())), pa.array(texts, pa.string())], [*b.schema.names[:n], "problems", "json"])

    out = both.mapInArrow(judge, "conv_id long, call_id string, position long, depth int, status string, result_position long, n_results long, problems array<string>, json string")
    return out.select("conv_id", "call_id", "position", "depth", "status", "problems", "result_position", "n_results", "json")


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


REPLY = {"type": "object", "required": ["turn", "text"], "additionalProperties": False, "properties": {"turn": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 1}, "after": {"type": "object", "required": ["$ref"], "properties": {"$ref": {"type": "string"}}}}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: an assistant's turn calls ``reply``, and the turn after it, if it
    is not an assistant's, is the result. A call refers to the one of the assistant's turn two places before."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = lambda turn: F.concat_ws("-", F.lit("call"), "conv_id", turn)
    said = t.where("role = 'assistant'")
    before = said.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("again")).distinct()
    ref = F.when(F.col("again"), name(F.col("turn") - 2))
    calls = said.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text", F.when(ref.isNotNull(), F.struct(ref.alias("$ref"))).alias("after"))).alias("arguments"),
        F.when(ref.isNotNull(), F.array(ref)).otherwise(F.array().cast("array<string>")).alias("refs"),
    )
    results = t.where("role <> 'assistant' and turn > 0").join(said.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct(), ["conv_id", "turn"], "left_semi")
    return calls, results.select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))


def from_messages(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of turns whose text is a JSON message: ``{"tool_calls": [{"id", "function": {"name",
    "arguments"}}]}`` of an assistant, ``{"tool_call_id", "content"}`` of role tool. References are the ids in
    ``{"$ref": id}`` values of the arguments. Other turns are not calls. A position is turn * 2^32 plus the place of the
    call within its turn (turns below 2^31)."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    shape = "struct<tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,content:string>"
    m = t.withColumn("m", F.from_json("text", shape))
    calls = m.where("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("n", "c"))
    args = F.col("c.function.arguments")
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), (F.shiftleft("turn", 32) + F.col("n")).alias("position"), F.col("c.function.name").alias("name"), args.alias("arguments"), F.regexp_extract_all(args, F.lit(r'\{\s*"\$ref"\s*:\s*"([^"\\]+)"\s*\}'), 1).alias("refs"))
    results = m.where("role = 'tool'").select("conv_id", F.col("m.tool_call_id").alias("call_id"), F.shiftleft("turn", 32).alias("position"), F.col("m.content").alias("content"))
    return calls, results
