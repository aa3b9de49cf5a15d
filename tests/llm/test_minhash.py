import random
import re

import pytest

from marlstone.llm.minhash import NearDuplicates, circulant_signature, keep_one, near_duplicates, shingle_set


def brute(rows, words, fold, num=80, den=100):
    """All pairs over plain Python sets, then a plain union of what links."""
    def shingles(t):
        t = t or ""
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold else t
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, groups, size, spread):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = [None, "", " \n ", "one", "One", "two words", "two words", "TWO words"]
    for _ in range(groups):
        base = r.choices(vocab, k=r.randint(3, 120))
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, max(1, int(len(t) * spread)))):
                t[r.randrange(len(t))] = r.choice(vocab)
            texts.append(" ".join(t))
    return list(enumerate(texts))


@pytest.mark.parametrize("words,fold,groups,size,spread", [(2, True, 40, 4, 0.1), (5, False, 30, 4, 0.04), (2, True, 2, 90, 0.09)])
def test_components_equal_brute_force(spark, words, fold, groups, size, spread):
    rows = corpus(3, groups, size, spread)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, NearDuplicates(words=words, fold_case=fold)).collect()}
    assert got == brute(rows, words, fold)


def test_rounds_and_fallback_lose_nothing(spark):
    rows = corpus(5, 1, 60, 0.14)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 3):
        p = NearDuplicates(words=2, small_bucket=4, rounds=rounds)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, p).collect()}
        assert got == brute(rows, 2, False)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (2, "x y z q r s"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, NearDuplicates(words=2, fold_case=True)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 1), (2, 1), (3, 3)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in keep_one(df, NearDuplicates(words=2, fold_case=True)).collect()) == ["1", "1", "3", "None"]


def test_signature_estimates_similarity():
    r = random.Random(1)
    words = [str(r.random()) for _ in range(3000)]
    a, b = (shingle_set(" ".join(w), 1) for w in (words[:2000], words[500:2500]))
    same = (circulant_signature(a, 1024) == circulant_signature(b, 1024)).mean()
    assert abs(same - 1500 / 2500) < 0.06
