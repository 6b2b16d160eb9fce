"""The query fuzzy_ocr against brute force: every scene scored, the best ten of at least 0.35."""

from sceneloom.functions import text as T
from sceneloom.queries import ranking


def test_query_equals_brute_force(spark, monkeypatch):
    # thirty scenes hold the query's trigrams in long words and come first in the shortlist, before the better ones
    noise = [(f"n{i:02}", f"gunaaaaa bbbbung cayaaaaa bbbbcay muobbbbb bbbbuoi manaaaaa bbbbman x{i}") for i in range(30)]
    near = [(f"s{i:02}", f"gunq cayy muoj mann {'z' * i}") for i in range(5)]
    other = [("o0", "hoan toan khac"), ("o1", "gung")]
    asked = [("q", "gung cay muoi man")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    docs = spark.createDataFrame(noise + near + other, "doc_id string, text string")
    monkeypatch.setattr(ranking, "_ocr", lambda *_: (queries, docs))
    scores = [(round(T.fuzzy_score(asked[0][1], t), 6), i) for i, t in noise + near + other]
    best = sorted(((-s, i) for s, i in scores if s >= 0.35))[:10]
    got = sorted((r["rank"], r.doc_id, r.score) for r in ranking.fuzzy_ocr(spark, "").collect())
    assert got == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert {i for i, _ in near} & {i for _, i, _ in got}


def test_scores_below_the_least_are_not_matched_in_full(monkeypatch):
    # matching in full is long work; a pair that can't reach the least score is left after cheap upper bounds
    import difflib

    full = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: full.append(1) or ratio(self))
    texts = ["gung cay muoi man", "gunq cayy muoj mann", "xe tai nho", "cau lac bo", "man hinh gung", "muoi hai con vit di qua cau", ""]
    for q in texts[:3]:
        for t in texts:
            exact = T.fuzzy_score(q, t)
            for least in (0.0, 0.35, exact, exact + 1e-4):
                got = T.fuzzy_score(q, t, least)
                assert got == exact if exact >= least else got < least
    full.clear()
    assert T.fuzzy_score("gung cay muoi man", "quet xop zzz kkkk", 0.35) < 0.35
    assert not full


def test_many_pairs_are_scored_as_one_by_one(monkeypatch):
    # F1: the same scores to the last digit, without a SequenceMatcher for each pair of texts
    import difflib
    import random

    from sceneloom.functions import likeness

    rng = random.Random(3)
    made = lambda: "".join(rng.choice(rng.choice(["ab", "abc ", "abcdefgh   ", "aбcдeжз  中"])) for _ in range(rng.choice([0, 1, 8, 20, 60, 150, 260])))
    queries = ["gung cay muoi man", "", " a  b ", *(made() for _ in range(25))]
    texts = ["gunq cayy muoj mann va xe tai", "a b a b", "", *(made() for _ in range(25)), *(q + " " + q[::-1] + q for q in queries[3:13])]
    q, t = ([i for i in range(len(queries)) for _ in texts], list(range(len(texts))) * len(queries))
    exact = [T.fuzzy_score(queries[a], texts[b]) for a, b in zip(q, t)]
    for least in (0.0, 0.35, 0.6):
        got = likeness.fuzzy_scores(queries, texts, q, t, least)
        assert all(x == y if y >= least else x < least for x, y in zip(got.tolist(), exact))
    T.alike.cache_clear()
    asked = []
    init = difflib.SequenceMatcher.__init__
    monkeypatch.setattr(difflib.SequenceMatcher, "__init__", lambda self, j=None, a="", b="", autojunk=True: asked.append((a, b)) or init(self, j, a, b, autojunk))
    assert likeness.fuzzy_scores(["gung cay muoi man"], ["gung cay muoi mun"], [0], [0], 0.35)[0] > 0.8
    assert all(" " not in a + b for a, b in asked)


def test_same_texts_at_the_border_of_the_shortlist(spark):
    # documents of one text are searched as one, yet the shortlist is cut among documents, by their ids
    from sceneloom.operators import retrieval

    asked = [("q1", "gung cay muoi man"), ("q2", "gung cay muoi man")]
    docs = [(f"d{i:02}", ("gung cay muoi", "cay muoi gung", "gung cay muoi man")[i % 3 if i > 3 else i % 2]) for i in range(30)]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    held = spark.createDataFrame(docs, "doc_id string, text string")
    for shortlist in (3, 11, 17, 40):
        short = retrieval.trigram_top(queries, held, shortlist).collect()
        scores = sorted((r.query_id, -round(T.fuzzy_score(asked[0][1], dict(docs)[r.doc_id]), 6), r.doc_id) for r in short)
        want = [(q, d, -s) for q, s, d in scores if -s >= 0.35]
        want = [x for q in ("q1", "q2") for x in [y for y in want if y[0] == q][:10]]
        got = retrieval.fuzzy_search(queries, held, shortlist, 10).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.doc_id, r.score) for r in got] == want
