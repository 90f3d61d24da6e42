import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.llm import chat, mixing
from vecspark.llm.queries import QUERIES, TARGETS


def shares(rows, name, what):
    total, by = 0.0, {}
    for r in rows:
        by[r[f"m_{name}"]] = by.get(r[f"m_{name}"], 0.0) + what(r)
        total += what(r)
    return {k: v / total for k, v in by.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_weights_probabilities_and_draws_meet_every_marginal(spark, sf_dir, sf):
    sf_dir = sf_dir.replace("sf0.001", sf)
    rows = QUERIES["op1_mixing"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for what, within in ((lambda r: r["weight"] * r["n_tokens"], 1e-6), (lambda r: r["probability"] * r["n_tokens"], 1e-6), (lambda r: r["sampled"] * r["n_tokens"], 0.01)):
        for name, want in TARGETS.items():
            have = shares(rows, name, what)
            assert set(have) == set(want)
            assert have == pytest.approx(want, abs=within)
    total = sum(r["n_tokens"] for r in rows)
    kept = sum(r["probability"] * r["n_tokens"] for r in rows) / total
    assert 0.4 < kept <= 0.5 + 1e-9
    assert sum(r["sampled"] * r["n_tokens"] for r in rows) / total == pytest.approx(kept, abs=0.005)
    assert all(0 <= r["probability"] <= 1 and 0 <= r["draw_probability"] <= 1 for r in rows)


def test_query_equals_brute_force(spark, sf_dir):
    """Counts by hand, weights by plain raking, and probabilities by their definition: a factor a value, cut at one."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_mixing"](spark, sf_dir).collect()
    names, cells = list(TARGETS), {}
    for r in rows:
        d = docs[r["doc_id"]]
        text = d["text"] or ""
        topic = "tabular" if " | " in text else "note" if len(text) < 600 else "article" if len(text) < 4000 else "long"
        assert (r["m_source"], r["m_lang"], r["m_topic"]) == (d["source"] if d["source"] in TARGETS["source"] else "*", d["lang"], topic)
        assert r["n_tokens"] == len(text.encode().split())
        c = cells.setdefault(tuple(r[f"m_{n}"] for n in names), [0, r["weight"], r["probability"]])
        c[0] += r["n_tokens"]
        assert c[1:] == [r["weight"], r["probability"]]
    total = sum(c[0] for c in cells.values())
    w = {k: c[0] / total for k, c in cells.items()}
    for _ in range(500):
        for i, n in enumerate(names):
            now = {}
            for k, x in w.items():
                now[k[i]] = now.get(k[i], 0) + x
            w = {k: x * TARGETS[n][k[i]] / now[k[i]] for k, x in w.items()}
    some = {k: c for k, c in cells.items() if c[0]}
    assert {k: c[1] for k, c in some.items()} == pytest.approx({k: w[k] * total / c[0] for k, c in some.items()}, rel=1e-6)
    open_ = [k for k, c in some.items() if c[2] < 1 - 1e-9]  # log p is a sum of a number for each value, and 1 where that is beyond 0
    values = sorted({(n, v) for k in some for n, v in zip(names, k)})
    at = np.array([[(n, v) in zip(names, k) for n, v in values] for k in open_], float)
    logs = np.log([some[k][2] for k in open_])
    x, *_ = np.linalg.lstsq(at, logs, rcond=None)
    assert np.abs(at @ x - logs).max() < 1e-4
    for r in rows:
        assert r["sampled"] or r["draw_probability"] < 1


def test_sampling_follows_the_probabilities(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"))
    rows = mixing.mix(docs, {"source": {"hot": 0.5, "*": 0.5}}, fraction=0.4).collect()
    drawn = [r for r in rows if r["sampled"]]
    assert len(drawn) == pytest.approx(8000, rel=0.05)
    assert sum(r["m_source"] == "hot" for r in drawn) == pytest.approx(4000, rel=0.07)
    again = {r["doc_id"] for r in mixing.mix(docs.repartition(7), {"source": {"hot": 0.5, "*": 0.5}}, fraction=0.4).where("sampled").collect()}
    assert again == {r["doc_id"] for r in drawn}


def test_rake_and_bounds_by_hand():
    w = mixing.rake(np.array([[10.0, 30.0], [40.0, 20.0]]), [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    assert w.sum(axis=1) == pytest.approx([0.5, 0.5]) and w.sum(axis=0) == pytest.approx([0.3, 0.7])
    assert w[0, 0] * w[1, 1] / (w[0, 1] * w[1, 0]) == pytest.approx(10 * 20 / (30 * 40))  # odds ratios stay
    with pytest.raises(ValueError, match="no value with a target"):
        mixing.rake(np.array([1.0, 0.0]), [np.array([0.0, 1.0])])
    with pytest.raises(ValueError, match="cannot meet all targets"):  # the empty cell contradicts the targets
        mixing.rake(np.array([[1.0, 1.0], [1.0, 0.0]]), [np.array([0.1, 0.9]), np.array([0.1, 0.9])])
    tokens = np.array([[100.0, 0.0], [10.0, 90.0]])
    p, off = mixing.bounded(tokens, np.ones((2, 2)), [np.array([50.0, 50.0]), np.array([60.0, 40.0])])
    assert off < 1e-7 and p[0, 0] == pytest.approx(0.5) and p[1, 0] == pytest.approx(1.0, abs=1e-3)
    assert mixing._factors(np.array([[10.0, 90.0]]), np.array([[9.0, 1.0]]), np.array([55.0])) == pytest.approx([0.5])  # full, and a half


def test_infeasible_budgets_are_lowered_and_contradictions_told(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("x").alias("a.b"), F.lit(None).cast("int").alias("rid"), F.lit(1).alias("size"))
    rows = mixing.mix(docs, {"a.b": {"rare": 0.5, "*": 0.5}}, keep=tuple(docs.columns)).collect()
    assert shares(rows, "a.b", lambda r: r["probability"]) == pytest.approx({"rare": 0.5, "*": 0.5}, abs=1e-6)
    assert sum(r["probability"] for r in rows) == pytest.approx(600, rel=2e-3)  # not 1500: there are 300 rare ones
    rows = mixing.mix(docs, {"a.b": {"rare": 0.5, "*": 0.5}}, scarce="yield").collect()  # all rare ones, and others up to the half
    assert sum(r["probability"] for r in rows) == pytest.approx(1500) and all(r["probability"] > 0.995 for r in rows if r["m_a.b"] == "rare")
    assert mixing.attainable(np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.32, 9.0])) == pytest.approx([0.1, 0.32, 0.58])
    two = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "p").otherwise("q").alias("a"), F.when(F.col("doc_id") % 2 == 0, "r").otherwise("s").alias("b"))
    targets = {"a": {"p": 0.3, "q": 0.7}, "b": {"r": 0.6, "s": 0.4}}
    with pytest.raises(ValueError, match="cannot meet all targets"):
        mixing.mix(two, targets, strict=True)
    with pytest.warns(UserWarning, match="nearest fit"):
        assert mixing.mix(two, targets).count() == 3000


def test_mixing_edges(spark, edge_docs):
    out = mixing.mix(edge_docs, TARGETS, {"topic": mixing.form()}, keep=tuple(edge_docs.columns))
    assert out.count() == edge_docs.count()
    assert mixing.mix(edge_docs.limit(0), TARGETS, {"topic": mixing.form()}).count() == 0
    blank = edge_docs.where("text is null")
    assert mixing.mix(blank, TARGETS, {"topic": mixing.form()}).count() == blank.count()


CALL = "conv_id long, call_id string, position long, name string, arguments string, refs array<string>"
RESULT = "conv_id long, call_id string, position long, content string"
SCHEMAS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", "y"]}, "c": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "additionalProperties": False}}


def linked(spark, calls, results):
    df = chat.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMAS)
    return sorted(df.collect(), key=lambda r: (str(r["conv_id"]), str(r["call_id"]), r["position"] or 0))


def test_links_orders_and_validates(spark):
    calls = [
        (1, "a", 0, "f", '{"b": "x", "a": 1}', []), (1, "b", 2, "f", '{"a": -1}', ["a"]), (1, "c", 4, "f", "{bad", ["b", "a"]), (1, "c", 5, "f", '{"a": 1}', []),
        (1, "x", 6, "f", '{"a": 1}', ["y"]), (1, "y", 7, "f", '{"a": 1}', ["x"]), (1, "z", 8, "g", '{"q": [1, {"é": null}]}', ["nowhere"]), (1, "e", 9, "f", '{"a": 1.0, "c": ["abc", 3], "d": NaN}', []),
        (2, "a", 0, "f", '{"a": true, "b": "w", "k": 0, "c": ["abc", 3]}', []), (None, "a", 0, "f", '{"a": 1}', []), (1, None, 0, "f", None, None),
    ]
    results = [(1, "a", 1, "r1"), (1, "a", 3, "r2"), (1, "b", 1, "early"), (1, "lost", 9, "o"), (None, "a", 1, "n"), (2, "lost", 0, None)]
    out = {(r["conv_id"], r["call_id"], r["position"]): r for r in linked(spark, calls, results)}
    assert len(out) == len(calls) + 3  # two lost ones and the one without conversation
    a = out[1, "a", 0]
    assert (a["status"], a["depth"], a["n_results"], a["problems"]) == ("ok", 0, 2, [])
    assert a["json"] == '{"arguments":{"a":1,"b":"x"},"id":"a","name":"f","result":"r1"}'
    assert (out[1, "b", 2]["status"], out[1, "b", 2]["depth"], out[1, "b", 2]["problems"]) == ("early", 1, ["$.a: below minimum"])
    assert (out[1, "c", 4]["depth"], out[1, "c", 4]["json"], out[1, "c", 4]["problems"]) == (2, None, ["arguments are no JSON"])
    assert out[1, "c", 5]["status"] == "duplicate"
    assert {out[1, k, p]["status"] for k, p in (("x", 6), ("y", 7))} == {"cycle"} and out[1, "x", 6]["depth"] is None
    z = out[1, "z", 8]
    assert z["status"] == "pending" and z["problems"] == ["unknown reference nowhere", "unknown tool g"] and json.loads(z["json"])["arguments"] == {"q": [1, {"é": None}]}
    assert out[2, "a", 0]["problems"] == ["$.a: not integer", "$.b: not in enum", "$.k: unknown", "$.c[0]: too long", "$.c[1]: not string"]
    assert out[1, "e", 9]["problems"] == ["arguments are no JSON"]
    assert out[1, "lost", None]["status"] == "orphan" and out[None, "a", 0]["status"] == "pending" and out[1, None, 0]["status"] == "pending"


def depths_by_hand(calls):
    """Longest path of references of each distinct call; calls on a cycle, or that lead to one, have none."""
    refs = {}
    for conv, cid, _, _, _, ref in calls:
        refs.setdefault((conv, cid), set()).update((conv, r) for r in ref or [])
    refs = {k: {r for r in v if r in refs} for k, v in refs.items()}
    out = {}
    while ready := [k for k, v in refs.items() if k not in out and all(r in out for r in v)]:
        out |= {k: max((out[r] + 1 for r in refs[k]), default=0) for k in ready}
    return out


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(chat, "cut", lambda df, name, f=chat.cut: written.append(name) or f(df, name))
    calls = [(1, f"c{i}", i, "f", '{"a": 1}', [f"c{i - 1}"] if i else []) for i in range(5000)]
    assert [r["depth"] for r in sorted(linked(spark, calls, []), key=lambda r: r["position"])] == list(range(5000))
    assert written.count("chain") <= 13


def test_depths_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    calls = []
    for conv in range(40):
        n = int(rng.integers(1, 40))
        for i in range(n):
            some = rng.integers(0, n if conv % 4 == 0 else max(i, 1), int(rng.choice([0, 1, 1, 1, 2, 3])))  # every fourth may have cycles
            calls.append((conv, f"c{i}", i, "f", "{}", [f"c{k}" for k in some if k != i or conv % 8 == 0] + ["nowhere"] * (i % 7 == 0)))
    calls += [(50, f"l{i}", i, "f", "{}", [f"l{i - 1}", f"l{i - 2}"]) for i in range(9)]  # each call has two references
    calls += [(51, f"s{i}", i, "f", "{}", ["s0"] if i else None) for i in range(300)]  # all refer to one
    calls += [(52, "a", 0, "f", "{}", ["a"]), (52, "b", 1, "f", "{}", ["a"]), (52, "c", 2, "f", "{}", ["b", "d"]), (52, "d", 3, "f", "{}", [])]
    want = depths_by_hand(calls)
    got = linked(spark, calls, [])
    assert len(got) == len(calls)
    for r in got:
        assert r["depth"] == want.get((r["conv_id"], r["call_id"])), r
        assert r["status"] == ("pending" if (r["conv_id"], r["call_id"]) in want else "cycle")


def test_odd_arguments(spark):
    long = json.dumps({"a": 1, "k": "é" * 300_000}, ensure_ascii=False)
    calls = [(9007199254740993, "s", 0, "f", '{"a": "\\ud800"}', []), (None, "d", 1, "f", "[" * 200_000 + "]" * 200_000, []), (1, "l", 2, "f", long, []), (1, "n", 3, None, "", []), (1, "h", 4, "f", '{"a": 1e999}', [])]
    out = {r["call_id"]: r for r in linked(spark, calls, [])}
    assert out["s"]["conv_id"] == 9007199254740993  # beyond what a double holds, beside a null
    assert out["s"]["json"] == '{"arguments":{"a":"\\ud800"},"id":"s","name":"f"}' and json.loads(out["s"]["json"])["arguments"] == {"a": "\ud800"}
    assert out["d"]["json"] is None and out["d"]["problems"] == ["arguments nest too deep"]
    assert json.loads(out["l"]["json"])["arguments"]["k"] == "é" * 300_000 and out["l"]["problems"] == ["$.k: unknown"]
    assert out["n"]["problems"] == ["arguments are no JSON"] and out["h"]["problems"] == ["arguments are no JSON"]


@pytest.mark.parametrize("schema", [{"type": "int"}, {"pattern": "x"}, {"properties": {"a": {"items": {"oneOf": []}}}}, {"additionalProperties": {}}, []])
def test_unknown_schemas_are_refused(spark, schema):
    with pytest.raises(ValueError):
        chat.link(spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT), {"f": schema})


def test_chat_query_equals_brute_force(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    said = {(r["conv_id"], r["turn"]): r["text"] or "" for r in turns if r["role"] == "assistant"}
    other = {(r["conv_id"], r["turn"]): r["text"] or "" for r in turns if r["role"] != "assistant"}
    assert len(said) + len(other) == len(turns)
    want = set()
    for (conv, turn), text in said.items():
        depth = 0
        while (conv, turn - 2 * depth - 2) in said:
            depth += 1
        args = {"turn": turn, "text": text} | ({"after": {"$ref": f"call-{conv}-{turn - 2}"}} if depth else {})
        answer = other.get((conv, turn + 1))
        message = {"arguments": args, "id": f"call-{conv}-{turn}", "name": "reply"} | ({} if answer is None else {"result": answer})
        problems = [] if text else ["$.text: too short"]
        want.add((conv, message["id"], turn, depth, "pending" if answer is None else "ok", tuple(problems), None if answer is None else turn + 1, int(answer is not None), json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    out = QUERIES["op8_chat"](spark, sf_dir).collect()
    assert len(out) == len(want) and {(*r[:5], tuple(r[5]), *r[6:]) for r in out} == want


def test_many_calls_in_a_turn_keep_their_places(spark):
    many = json.dumps({"tool_calls": [{"id": f"k{i}", "function": {"name": "f", "arguments": "{}"}} for i in range(1500)]})
    calls, _ = chat.from_messages(spark.createDataFrame([(1, 0, "assistant", many), (1, 1, "assistant", many)], "conv_id long, turn long, role string, text string"))
    at = [r["position"] for r in calls.collect()]
    assert len(set(at)) == 3000 and sorted(at)[1500] == 1 << 32


def test_messages_and_empty_tables(spark):
    turns = [(1, 0, "assistant", json.dumps({"tool_calls": [{"id": "k", "function": {"name": "f", "arguments": '{"a": {"$ref": "j"}}'}}]})), (1, 1, "tool", json.dumps({"tool_call_id": "k", "content": "done"})), (1, 2, "user", "hi"), (1, 3, "assistant", None), (None, None, None, None)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, name int")
    calls, results = chat.from_messages(df)
    assert [tuple(r) for r in calls.collect()] == [(1, "k", 0, "f", '{"a": {"$ref": "j"}}', ["j"])]
    assert [r["content"] for r in results.collect()] == ["done"]
    for make in (chat.from_messages, chat.from_turns):
        c, r = make(df.limit(0))
        assert chat.link(c, r, SCHEMAS).count() == 0
        c, r = make(df)
        assert chat.link(c, r, {"reply": chat.REPLY}).count() >= 1
