import numpy as np

from quillon.llm import ngramjoin


def test_candidates_follow_the_members_not_their_pairs(spark, monkeypatch):
    """120 near copies share nearly all shingles: the candidates of all rounds are a few a member, and all are linked."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 10**6, 300)
    texts = []
    for _ in range(120):
        words = base.copy()
        words[rnd.choice(300, 3, replace=False)] = rnd.integers(10**6, 10**9, 3)
        texts.append(" ".join(f"w{x}" for x in words))
    made, stash = [], ngramjoin.stash

    def counted(df, name, *more):
        out = stash(df, name, *more)
        if name == "candidates":
            made.append(out.where("a >= 0").count())
        return out

    monkeypatch.setattr(ngramjoin, "stash", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ngramjoin.jaccard_components(docs).collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(root))
    assert sum(made) <= 8 * 120, made
