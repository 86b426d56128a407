"""Long lists of the near-duplicate join."""

from itertools import combinations

from hexloom.llm import ngram_join


def test_pairs_of_long_lists_are_no_rows(spark, monkeypatch):
    """Texts made of three of twenty passages share frequent shingles and are alike in none but these; a few have a word changed."""
    passages = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(20)]
    texts = [" ".join(passages[k] for k in three) for three in combinations(range(20), 3)]
    texts += [t.replace("w13", "x", 1) for t in texts[::97]]
    tables = []

    def counted(df, cut=ngram_join.cut_lineage):
        out = cut(df)
        if df.columns in (["a", "b", "score"], ["ca", "cb", "la", "lb"]):
            tables.append(out.count())
        return out

    for name, value in (("FREQUENT", 8), ("NEAR", 1), ("cut_lineage", counted)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    n = len(texts) - len(texts[:1140:97])
    assert found == {i: i if i < n else 97 * (i - n) for i in range(len(texts))}
    assert max(tables) < 12 * len(texts)


def test_sketches_never_part_what_links():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = rng.sample(range(1 << 40), n)
        b = a[: rng.randint(0, n)] + rng.sample(range(1 << 40), rng.randint(0, 20))
        a, b = (np.unique(np.array(s, np.int64)) for s in (a, b or [1]))
        sketch = ngram_join._sketched(pa.array([a, b], pa.list_(pa.int64())))
        assert not ngram_join.linked(a, b) or ngram_join.sketches_fit(np.int64(len(a)), np.int64(len(b)), sketch[0], sketch[1])
