import random

import corpus_pipeline
from vecspark.llm import similar, simhash


def grams(text):
    words = (text or "").lower().split()
    return {" ".join(words)} if len(words) < 5 else {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """The ids that stay, of (doc_id, text) with distinct ids."""
    parent, sets = list(range(len(rows))), [grams(t) for _, t in rows]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_replaced_words_are_found(spark):
    """The pipeline's stage finds every pair of similarity 0.8, with 1 to 5 replaced words as well."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((8, 60, 200)))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, changed(rng, words, min(len(words) // 40 + i % 2, 5))), (3 * i + 2, changed(rng, words, len(words) // 8))]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    expected = brute(rows)
    assert len(expected) < 160
    assert sorted(r["doc_id"] for r in out.collect()) == expected


def test_large_groups_and_common_passages(spark):
    """Buckets beyond the bound: one group of near copies, chains, and a passage that dissimilar texts share."""
    rng = random.Random(5)
    base, passage = [f"b{i}" for i in range(80)], [f"p{i}" for i in range(40)]
    rows = [(i, changed(rng, base, i % 4)) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"t{i}-{j}" for j in range(i % 12)])) for i in range(40)]
    rows += [(200 + i, " ".join(f"c{j}" for j in range(3 * i, 3 * i + 60))) for i in range(30)] + [(300, ""), (301, None), (302, "one"), (303, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (1, 8, 64):
        assert sorted(r["doc_id"] for r in simhash.deduplicated(df, small=small, similarity=0.8).collect()) == brute(rows), small


def test_texts_that_cannot_be_similar_are_not_paired(spark, monkeypatch):
    """A group that shares most shingles, where too little is left behind the own ones for any pair: no row of a join."""
    rng, rows, met, plain = random.Random(6), [], [], similar.cut
    for i in range(300):
        words = [f"g{j}" for j in range(150)]
        for at in (10, 40, 70, 100, 130):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))

    def cut(df, name):
        out = plain(df, name)
        if name == "pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(similar, "cut", cut)
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).count()
    assert kept == len(brute(rows)) and met == [0]


def test_near_copies_of_one_text_are_joined_by_it(spark, monkeypatch):
    """Most near copies of a text are not similar to each other; once all have met it, no pair of them is listed."""
    rng, met, plain = random.Random(7), [], similar.cut
    base = [f"g{j}" for j in range(150)]
    rows = [(i, changed(rng, base, 2)) for i in range(300)] + [(300, " ".join(base))]

    def cut(df, name):
        out = plain(df, name)
        if name == "pairs":
            met.append(out.count())
        return out

    monkeypatch.setattr(similar, "cut", cut)
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()]
    assert kept == brute(rows) == [0] and met == [0]


def test_edges(spark, edge_docs):
    kept = simhash.deduplicated(edge_docs, similarity=0.8)
    assert kept.columns == edge_docs.columns and 0 < kept.count() < edge_docs.count()
    assert simhash.deduplicated(edge_docs.limit(0), similarity=0.8).count() == 0
