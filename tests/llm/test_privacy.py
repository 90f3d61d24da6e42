import hashlib
import re

from pyspark.sql import functions as F

from vecspark.llm import privacy
from vecspark.llm.queries import QUERIES

#: The contract's patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(v):
    return re.sub(r"[^0-9]", "", v)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def ok(kind, v):
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(digits(v)) <= 19 and luhn(digits(v))
    return kind == "email" or 8 <= len(digits(v)) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "", re.ASCII) if ok(k, m.group())]


def row(text):
    s = spans(text)
    return tuple(sum(x[0] == k for x in s) for k in BASE) + (hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(),)


def digest(df):
    return [(r["doc_id"], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in df.collect()]


def test_query_equals_regular_expressions(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = digest(QUERIES["op6_privacy"](spark, sf_dir))
    assert dict(out) == {d: row(t) for d, t in texts.items()} and len(out) == len(texts)


def test_odd_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f.g", "a@@b.c", "x.y%z+w-@a-b.c.d.", "a@b", "a@b..c", "@a.b", "a@b.c@d.e", "é@b.cd 😀 a@b.cd",
        "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0004", "1.2.3.4.5", "99999999999999999999.1.1.1", "1.2.3", "0.0.0.0x1.1.1.1",
        "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111112", "5 5-5 5", "0000000000000000000",
        "+1 2345678", "+49 (0)30-12.34.56", "+1234567", "++12345678", "+1 234567890123456", "+12 ", "+1-", "+1(23) 45 67 89 +1(23) 45 67 89",
        "+" * 50, "1" * 5000, "a" * 5000 + "@", "1." * 3000, "+1 " * 3000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = dict(digest(privacy.digest(privacy.find(df))))
    for i, t in enumerate(texts):
        assert out[i] == row(t), (t or "")[:60]


def test_telling_words_go(spark):
    """A word that only ever stands beside one address discloses it; common words do not."""
    rows = [(i, f"please write to zorro at zed@mail.org about item{i} today") for i in range(4)] + [(i, f"please write to the office about item{i} today") for i in range(4, 60)]
    rows += [(60, None), (None, ""), (3, "please write to zorro at zed@mail.org about item3 today")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("t")).withColumn("n_e", F.lit(1))
    clean = privacy.sanitise(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    texts = [r["text"] for r in clean.collect() if r["doc_id"] == 1]
    assert "zed@" not in texts[0] and "zorro" not in texts[0] and "[EMAIL]" in texts[0] and "please write to" in texts[0]
    assert [r["text"] for r in clean.collect() if r["doc_id"] == 10] == [rows[10][1]]
    assert [r["text"] for r in clean.collect() if r["doc_id"] == 60] == [None]
    found = privacy.find(df).where("doc_id = 1").first()
    assert {t["kind"] for t in found["terms"]} == {"term"} and len(found["base"]) == 1


def test_disclosure_by_hand(spark):
    """n_et = n_t = n_e: the word discloses all of IC(e) and is removed; a word of twice the documents is not."""
    rows = [(i, f"secretword common a{i}@b.cd") for i in range(0)] + [(i, "secretword common q@b.cd") for i in range(4)] + [(i, "common text only") for i in range(4, 64)]
    found = privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()
    assert [(t["start"], t["end"], t["value"]) for t in found["terms"]] == [(0, 10, "remove")]


def test_telling_words_go_throughout_the_text(spark):
    """A second mention far from the address goes as well, and so does a word that never stands near it."""
    far = "common text " * 40
    rows = [(i, f"Zorro q@b.cd {far} zorro {far} Elsewhere") for i in range(4)] + [(i, "common text only") for i in range(4, 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [r["text"] for r in privacy.sanitise(df).where("doc_id < 4").collect()]
    assert len(clean) == 4 and all("orro" not in t and "lsewhere" not in t and t.count("common text") == 80 for t in clean)
    found = privacy.find(df).where("doc_id = 2").first()
    text = rows[2][1]
    assert [text[t["start"] : t["end"]] for t in found["terms"]] == ["Zorro", "zorro", "Elsewhere"]


def test_entities_of_a_single_document(spark):
    """A word that only the one document with the address holds is removed, a rare one generalised, a common one stays."""
    rows = [(0, "quixote windmill common q@b.cd")] + [(i, f"{'windmill' if i < 2 else ''} common text") for i in range(1, 64)]
    found = privacy.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 0").first()
    assert [(t["start"], t["end"], t["value"]) for t in found["terms"]] == [(0, 7, "remove"), (8, 16, "generalise")]


def test_edges(spark, edge_docs):
    assert sorted((str(d), r) for d, r in digest(privacy.digest(privacy.find(edge_docs)))) == sorted((str(r["doc_id"]), row(r["text"])) for r in edge_docs.collect())
    assert privacy.find(edge_docs.limit(0)).count() == 0
    assert privacy.sanitise(edge_docs).columns == edge_docs.columns
