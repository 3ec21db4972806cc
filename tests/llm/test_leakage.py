import itertools
import random

import numpy as np

from ledgerloom.llm import leakage as L


def covered(length, changes):
    for errors in itertools.combinations(range(length), changes):
        if not any(not ({s + o for o in m} & set(errors)) for m in L.MASKS for s in range(length - m[-1])):
            return False
    return True


def test_masks_are_lossless():
    assert covered(20, 2) and covered(30, 3)


def brute(doc, item):
    a, b = L.words_of(doc), L.words_of(item)
    for i in range(len(a)):
        for j in range(len(b)):
            wrong = 0
            for n in range(min(len(a) - i, len(b) - j)):
                wrong += a[i + n] != b[j + n]
                if n + 1 >= 20 and wrong * 10 <= n + 1:
                    return True
    return False


def test_equals_brute_force(spark):
    random.seed(8)
    word = lambda: random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(random.randint(0, 30))
    items = [(k, " ".join(word() for _ in range(random.randint(10, 60)))) for k in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for k in range(120):
        own = random.choice(items[:12])[1].split()
        a = random.randint(0, max(0, len(own) - 15))
        part = own[a : a + random.randint(15, 45)]
        for _ in range(random.choice((0, 1, 2, 3, 5))):
            part[random.randrange(len(part))] = "changed"
        if k % 3 == 0:
            part = [p.upper() + random.choice((",", "", "…")) for p in part]
        docs.append((k, ("\n" if k % 4 else "  ").join([word() for _ in range(random.randint(0, 30))] + part + [word() for _ in range(random.randint(0, 9))])))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (203, "x " * 50_000 + items[0][1] + " y" * 10)]
    want = {(d, i) for d, t in docs if d != 203 for i, x in items if t and x and brute(t, x)}
    if len(items[0][1].split()) >= 20:
        want.add((203, 0))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in L.leaked_items(df, it).collect()} == want
    assert L.leaked_items(df.limit(0), it).count() == 0 and L.leaked_items(df, it.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEMS_PER_PASS", 2)
    text = " ".join(f"w{k}" for k in range(25))
    items = spark.createDataFrame([(k, text) for k in range(5)], "item_id bigint, text string")
    assert L.leaked_items(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items).count() == 5


def test_longest_passage():
    assert L.longest_passage(np.array([1] * 19)) == 0
    assert L.longest_passage(np.array([1] * 20)) == 20
    assert L.longest_passage(np.array([1] * 10 + [0] + [1] * 9 + [0])) == 21
    assert L.longest_passage(np.array([1] * 9 + [0, 0, 0] + [1] * 9)) == 0
