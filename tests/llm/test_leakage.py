import random

import pytest

from quernwork.llm import leakage as K

ITEM = [f"w{i}" for i in range(40)]


def has(doc, unit=K.WORDS):
    return K._runs(ITEM, doc, unit)


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        (["x", *ITEM[3:17], "y"], True), ([*ITEM[3:16]], False), ([*ITEM[3:10], "zz", *ITEM[11:17]], True), ([*ITEM[3:9], *ITEM[10:17]], True), ([*ITEM[3:10], "zz", *ITEM[10:17]], True),
        ([*ITEM[3:8], "zz", *ITEM[9:12], "zz", *ITEM[13:18]], False), ([], False), (["w1"] * 50, False), ([*ITEM[0:7], "a", "b", *ITEM[7:14]], False),
    ],
)
def test_runs(doc, want):
    assert has(doc) is want


def test_against_brute_force(spark):
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(30)]
    items = [(n, " ".join(rnd.choice(vocab) for _ in range(25))) for n in range(6)]
    docs = []
    for d in range(150):
        body = [rnd.choice(vocab) for _ in range(30)]
        if rnd.random() < 0.6:
            i = rnd.choice(items)[1].split()
            a = rnd.randrange(0, 10)
            part = i[a : a + rnd.randrange(10, 18)]
            if rnd.random() < 0.7:
                k = rnd.randrange(len(part))
                part = rnd.choice([part[:k] + part[k + 1 :], [*part[:k], "new", *part[k:]], [*part[:k], "new", *part[k + 1 :]]])
            body[10:10] = part
        t = " ".join(body)
        docs.append((d, rnd.choice([t, t.upper(), t.replace(" ", "\n"), t.replace(" ", ", "), t.replace("v1", "v­1")]), "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, "  ", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    its = spark.createDataFrame([*items, items[0], (77, None), (78, "too short")], "item_id long, text string")
    got = {tuple(r) for r in K.leaks(df, its, K.WORDS).collect()}
    import re

    from quernwork.functions.text import fold_py

    want = {(d, i) for d, t, _ in docs if t for i, x in items if K._runs(x.split(), re.findall(r"[^\W_]+", fold_py(t)), K.WORDS)}
    assert got == want and len(want) > 10
    assert K.leaks(df.limit(0), its, K.WORDS).count() == 0 and K.leaks(df, its.limit(0), K.WORDS).count() == 0


def test_characters(spark):
    item = "設問35では、検査員が25個の瓶を誤った棚に置き、湿度0.2％のまま7時間も放置した理由"
    docs = spark.createDataFrame([(1, "前文。" + item[6:34].replace("、", "") + "後文"), (2, item[6:20]), (3, "english only " * 10)], "doc_id long, text string")
    its = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in K.leaks(docs, its, K.CHARS).collect()] == [(1, 5)]


def test_items_in_several_parts(spark, monkeypatch):
    """More items than are searched at once find the same, in one index."""
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(n, f"before {t} behind") for n, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    monkeypatch.setattr(K, "MOST_ITEMS", 12)
    index = K.build_index(docs, K.WORDS)
    assert sorted(tuple(r) for r in K.leaks(docs, items, K.WORDS, index=index).collect()) == [(n, n) for n in range(20)]
