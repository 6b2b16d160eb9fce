"""Problems 2 and 7: forms of texts and leaked items, against plain Python."""

import re
import unicodedata as ud

import pytest

from sceneloom.llm import leakage, normalize, words
from sceneloom.llm.charmap import fold, form

ODD = ["", " ", "​", "ﬁne ofﬁce", "Ｆｕｌｌ　ｗｉｄｔｈ，１２", "Те́st", "cà phế", "a b c", "Ðông Ɖông Đông", "x² ½ ①", "ѕсоре", "‍zero⁠ width\xad", "´ acute", "Ｌ̣", "ﷺ", "it's 'quoted'", "line\nbreak\ttab", "ΑΒΕ ο ν"]


def test_sql_form_equals_the_plain_one(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "long " * 50_000 + "ＥＮＤ"])]
    got = {r.id: r.form for r in normalize.with_form(spark.createDataFrame(rows, "id long, text string"), "text", "form").collect()}
    assert got == {i: None if t is None else form(t) for i, t in rows}


def test_what_looks_the_same():
    assert form("ﬁ Ｈｉ а​b") == "fi Hi ab"
    assert form("ế") == "ế" and form("Ð") == form("Ɖ") == "Đ"
    for a, b in (("a", "á"), ("A", "a"), ("1", "2"), ("²", "2"), (".", ","), ("d", "đ"), ("“", '"')):
        assert form(a) != form(b)


def test_pairs_of_look_alikes(spark):
    left = spark.createDataFrame([("q1", "sail"), ("q2", "sail"), ("q3", None), ("q4", "​"), (None, "sail"), ("q1", "sail")], "q string, text string")
    right = spark.createDataFrame([("k1", "ѕail"), ("k2", "sail"), ("k3", "Sail"), ("k1", "sail"), ("k4", ""), ("k5", None)], "k string, text string")
    assert sorted(map(tuple, normalize.same_look(left, "q", right, "k").collect())) == [("q1", "k1"), ("q2", "k1")]
    assert normalize.same_look(left.limit(0), "q", right, "k").count() == 0


def plain_words(t):
    return "".join(map(fold, t)).split()


def test_word_hashes_tell_words_apart():
    texts = [t for t in ODD if t] + ["the same the same", "ﬁn fin"]
    hashes, owner, chars, starts = words.words(texts)
    want = [(i, w) for i, t in enumerate(texts) for w in plain_words(t)]
    assert [i for i, _ in want] == owner.tolist()
    assert len({w for _, w in want}) == len(set(hashes.tolist())) and len(want) == len(hashes)
    assert [words.word_text(chars[a:b]).split() for a, b in zip(starts, starts[1:])] == [plain_words(t) for t in texts]


def brute_leaks(docs, items, n=10):
    grams = {i: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for i, t in items if t for w in [plain_words(t)]}
    out = set()
    for d, t in docs:
        w = plain_words(t or "")
        have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        out |= {(d, i) for i, g in grams.items() if g & have}
    return sorted(out)


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_leaks_equal_brute_force(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/eval_items.parquet")
    got = sorted(map(tuple, leakage.leaked_items(docs, items, broadcast_bytes=limit).collect()))
    assert got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_leak_cases(spark):
    item = "Một hai ba bốn năm sáu bảy tám chín mười mười một"
    rows = [(1, "x " + item.upper() + " y"), (2, re.sub(" ", " - ", ud.normalize("NFD", item))), (3, " ".join(item.split()[:9])), (4, None), (5, ""), (None, item), (1, item), (6, "w " * 100_000 + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (7, item)], "item_id long, text string")
    assert sorted(map(tuple, leakage.leaked_items(docs, items).collect())) == [(1, 7), (2, 7), (6, 7)]
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0 and leakage.leaked_items(docs.limit(0), items).count() == 0
