"""Token counts, against greedy longest-match."""

import random

from vectriage.llm import wordpiece
from vectriage.llm.queries import vocabulary


def greedy(begin, follow, word):
    n, at = 0, 0
    while at < len(word):
        own = begin if at == 0 else follow
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in own), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_automaton_against_greedy():
    rnd = random.Random(1)
    for _ in range(150):
        begin = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 12))}
        follow = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 12))}
        m = wordpiece.Matcher(sorted(begin), sorted(follow))
        for _ in range(60):
            word = "".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randint(1, 14)))
            assert m[word] == greedy(begin, follow, word), (begin, follow, word)


def test_edges(spark, monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t ", 5), (4, "the the", 5), (4, "the the", 5), (5, "日本 ☃zz", 5), (6, "q" * 300000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [(r.doc_id, r.n_tokens) for r in wordpiece.count_tokens(df, path).collect()]
    begin, follow = map(set, wordpiece.pieces_of(path))
    want = [(i, sum(greedy(begin, follow, w) for w in (t or "").split())) for i, t, _ in rows[:-1]]
    assert got[:-1] == want and got[-1][1] > 1
    assert wordpiece.count_tokens(df.limit(0), path).count() == 0
    monkeypatch.setattr(wordpiece, "MEMO_WORDS", 2)
    m = wordpiece.Matcher(["a"], ["b"])
    assert [m[w] for w in ("a", "ab", "abb", "a", "x")] == [1, 2, 3, 1, 1] and len(m) <= 2


def test_query(spark, sf_dir):
    from vectriage.llm.queries import QUERIES

    begin, follow = map(set, wordpiece.pieces_of(vocabulary("piece_bpe_32k.model")))
    memo = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {}
    for r in docs:
        for w in set(r.text.split()):
            if w not in memo:
                memo[w] = greedy(begin, follow, w)
        want[r.doc_id] = sum(memo[w] for w in r.text.split())
    assert {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()} == want
