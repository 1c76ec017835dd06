import random
import re

from sparkpoison.llm import decontaminate as D


def shingles(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            found = len(want & have)
            if want and 1000 * found >= 800 * len(want):
                out.add((d, i, len(want), found))
    return out


def fixture():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta Épsilon zeta eta theta iota kappa la mu nu xi omikron pi".split()) + rng.choice(["", "", "s", "x"])
    run = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(run(rng.randint(1, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "one two three four"), (93, "a b c d e"), (None, "a b c d e")]
    docs = [(1, None), (2, ""), (3, "a b c d e"), (3, "A, B; c (d) e!"), (None, "x a b c d e y"), (4, "a b c d e"), (4, "a b c d e")]
    for k in range(60):
        item = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 4)):
            item[rng.randrange(len(item))] = "changed"
        docs.append((100 + k, " ".join(run(rng.randint(0, 400)) + item + run(rng.randint(0, 400)))))
    docs.append((200, " ".join(run(30_000)) + " a b c d e"))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, k1 int")
    it = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = {tuple(r)[2:] for r in D.find_contained(df, it).collect()}
    assert got == brute(docs, [i for i in items if i[0] is not None])
    kept = sorted(map(repr, D.drop_contaminated(df, it).collect()))
    bad = {d for d, *_ in brute([(k, t) for k, (_, t) in enumerate(docs)], [i for i in items if i[0] is not None])}
    assert kept == sorted(repr(r) for k, r in enumerate(df.collect()) if k not in bad)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contained(docs, items).count() == 0 and D.drop_contaminated(docs, items).count() == 1
    assert D.find_contained(docs.limit(0), items).count() == 0


def test_drop_needs_no_item_id(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y"), (2, "v w x y z"), (3, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d e"), (7, "q r s t u")], "item_id long, text string")
    assert [r["doc_id"] for r in D.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [2, 3]
    assert D.find_contained(docs, items).count() == 0  # a result names its item


def test_drop_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 4, 5, 6), (2, "quite another text of some words", 4, 5, 6)], "doc_id long, text string, _k1 int, k1 int, c0 int")
    items = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    assert [tuple(r) for r in D.drop_contaminated(docs, items).collect()] == [(2, "quite another text of some words", 4, 5, 6)]
