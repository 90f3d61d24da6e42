import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vecspark.llm import rules
from vecspark.llm.queries import QUERIES


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    ws = word.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws)


def got(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_query_equals_plain_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert got(r) == base(texts[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_odd_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab \n\t\r\v\f#|😀é ", k=rng.randint(0, 300))) for _ in range(300)]
    texts += [None, "", "\n\n", "a b c " * 40, "a b c a b c", "\x0b\x0c", "line\nline\n line\nline ", "x " * 20_000, "\x1c\x85 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.features(df).collect():
        assert got(r) == base(texts[r["doc_id"]]), texts[r["doc_id"]]


def _corpus(n=900, seed=6):
    """Bad: many digits and long words, or many symbols. Good: neither."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = i % 4
        ws = [f"w{'ord' * rng.randint(0, 2)}{rng.choice('abcdefgh')}{i}q{j}" if kind == 0 else rng.choice("abcdefghij") * rng.randint(2, 6) + "xyz"[j % 3] + chr(97 + j % 26) + chr(97 + j // 26 % 26) for j in range(rng.randint(60, 120))]
        if kind == 1:
            ws = [w + ("#" if rng.random() < 0.5 else "") for w in ws]
        docs.append((i, " ".join(ws)))
        labels.append((i, int(kind > 1)))
    return docs, labels


def test_learned_list_generalises(spark):
    docs, labels = _corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = dict(labels)
    taught = spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, quality int")
    out = rules.judge(d, taught).collect()
    test = [r for r in out if r["doc_id"] % 3 == 0 and not r["base_failed"]]
    wrong = sum(r["kept"] != bool(y[r["doc_id"]]) for r in test)
    assert len(test) > 200 and wrong <= 0.03 * len(test)
    assert {r["rule"] for r in out if r["rule"]} and all(re.fullmatch(r"\w+ (>=|<) \S+( AND \w+ (>=|<) \S+)*", r["rule"]) for r in out if r["rule"])
    kept = rules.accepted(d.withColumn("f", F.lit(1)), taught)
    assert kept.columns == ["doc_id", "text", "f"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["kept"])


def test_nothing_to_learn(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = rules.judge(edge_docs, none)
    assert out.count() == edge_docs.count() and out.where("kept = base_failed").count() == 0
    for r, t in zip(sorted(map(got, out.collect())), sorted(base(r["text"]) for r in edge_docs.collect())):
        assert r == t
    odd = spark.createDataFrame([(1, None), (None, 0), (5, 0), (5, 1), (99, 7)], "doc_id long, quality int")
    assert rules.judge(edge_docs, odd).count() == edge_docs.count()
    assert rules.judge(edge_docs.limit(0), odd).count() == 0
    assert rules.accepted(edge_docs, none).columns == edge_docs.columns


def test_rules_are_ordered():
    a = rules.Rule((rules.Condition("symbols", True, 2.0),), 3, 0)
    assert str(a) == "symbols >= 2" and "CASE" in rules.decide([a, a])._jc.toString().upper()
