import random

import pytest

from fotolake.llm import leaks as l


def run(spark, items, docs):
    i = spark.createDataFrame(items, "item_id long, split_name string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    return {(r.item_id, r.doc_id): r for r in l.leaked_items(i, d).collect()}


Q = "The quick brown fox, jumps over 13 lazy dogs while Élodie's cat_sits on a warm mat near the old harbour wall"


def test_runs_and_edits(spark):
    w = Q.split()
    docs = [
        (1, "Intro. " + Q.upper().replace(" ", "\r\n") + " outro", "x"), (2, " ".join(l.words(Q)[:12]), "x"), (3, "zzz " + " ".join(w[2:15]) + " zzz", "x"),
        (4, Q.replace("lazy", "sleepy").replace("warm", "cold").replace("while", "as"), "x"), (5, None, "x"), (6, "", "x"), (7, "nothing here", "x"),
    ]
    got = run(spark, [(1, "test", Q), (2, "dev", Q + "!"), (3, None, None), (4, "t", ""), (5, "t", "nothing here")], docs)
    n = len(l.words(Q))
    assert got[1, 1].longest_run == n and got[1, 1].similarity == 1.0 and got[2, 1].longest_run == n
    assert got[1, 3].longest_run >= 13
    assert all(r.longest_run < 13 for (i, d), r in got.items() if d in (2, 4))
    assert got[1, 4].similarity >= 0.75
    assert got[5, 7].similarity == 1.0
    assert not [k for k in got if k[1] in (5, 6)]


def test_empty(spark):
    assert run(spark, [], [(1, Q, "")]) == {} and run(spark, [(1, "", Q)], []) == {}


def brute(items, docs):
    out = set()
    for i, _, t in items:
        iw = l.words(t)
        grams = {tuple(iw[k : k + 13]) for k in range(len(iw) - 12)}
        for d, x, _ in docs:
            dw = l.words(x)
            if any(tuple(dw[k : k + 13]) in grams for k in range(len(dw) - 12)):
                out.add((i, d))
    return out


@pytest.mark.parametrize("shuffle", [False, True])
def test_equals_brute_force(spark, shuffle, monkeypatch):
    if shuffle:
        monkeypatch.setattr(l, "BROADCAST_GRAMS", 3)
    rng = random.Random(6)
    word = lambda: rng.choice("a b c d e f g h red blue".split())
    items = [(k, "t", " ".join(word() for _ in range(rng.randrange(3, 30)))) for k in range(25)]
    docs = []
    for k in range(60):
        t = [word() for _ in range(rng.randrange(0, 60))]
        src = items[rng.randrange(25)][2].split()
        a = rng.randrange(len(src))
        docs.append((k, " ".join(t[:20] + src[a : a + rng.randrange(8, 20)] + t[20:]), ""))
    got = run(spark, items, docs)
    assert {k for k, r in got.items() if r.longest_run >= 13} == brute(items, docs)


def test_alignment():
    assert l.align(list("abcdef"), list("xxabcdefyy")) == (12, 6)
    assert l.align(list("abcdef"), list("abcXdef")) == (11, 3)
    assert l.align(list("abcdef"), list("abdef")) == (9, 3)
    assert l.align([], ["a"]) == (0, 0) and l.align(["a"], ["b"]) == (0, 0)


@pytest.mark.parametrize("shuffle", [False, True])
def test_edited_copies_are_found_in_any_number_of_documents(spark, shuffle, monkeypatch):
    if shuffle:
        monkeypatch.setattr(l, "BROADCAST_GRAMS", 3)
    item = [f"w{k}" for k in range(20)]
    edited = " ".join(item[:10] + ["other"] + item[11:])
    docs = [(0, " ".join(item), "")] + [(k, edited, "") for k in range(1, 1201)]
    got = run(spark, [(1, "t", " ".join(item))], docs)
    assert {d for _, d in got} == set(range(1201))
    assert {r.similarity for (_, d), r in got.items() if d} == {0.925}


@pytest.mark.parametrize("shuffle", [False, True])
def test_edited_copies_without_five_words_in_a_row(spark, shuffle, monkeypatch):
    if shuffle:
        monkeypatch.setattr(l, "BROADCAST_GRAMS", 3)
    w = [f"w{k}" for k in range(20)]
    spaced = [x for k, v in enumerate(w, 1) for x in ([v, "new"] if k % 4 == 0 and k < 20 else [v])]
    items = [(1, "t", " ".join(w[:8])), (2, "t", " ".join(w[:9])), (3, "t", " ".join(w))]
    docs = [(1, " ".join(w[:4] + ["x"] + w[5:8]), ""), (2, " ".join(w[:4] + ["x"] + w[5:9]), ""), (3, " ".join(spaced), "")]
    got = run(spark, items, docs)
    assert [round(got[k, k].similarity, 4) for k in (1, 2, 3)] == [0.8125, 0.8333, 0.9]


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_all_alignments_over_the_least_are_found(spark, least):
    rng = random.Random(11)
    word = lambda: rng.choice("a b c d e f g h i j k l m n o p q r s t u".split())
    items = [(k, "t", " ".join(word() for _ in range(rng.randrange(1, 24)))) for k in range(40)]
    docs = []
    for k in range(120):
        src = rng.choice(items)[2].split()
        for _ in range(rng.randrange(0, 1 + int(0.45 * len(src)))):
            at = rng.randrange(len(src) + 1)
            src[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        docs.append((k, " ".join([word() for _ in range(rng.randrange(9))] + src + [word() for _ in range(rng.randrange(9))]), ""))
    score = {(i, d): l.align(l.words(t), l.words(x))[0] / (2 * len(l.words(t))) for i, _, t in items for d, x, _ in docs}
    i = spark.createDataFrame(items, "item_id long, split_name string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = {(r.item_id, r.doc_id): r.similarity for r in l.leaked_items(i, d, least=least).collect() if r.similarity >= least}
    want = {k: v for k, v in score.items() if v >= least}
    assert got == want and len(want) > 60
