import random
import re

import numpy as np
import pytest

from sparkpoison.llm import jaccard_join as J


def shingle_set(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4, percent=85):
    """{(doc_id, size, component)}; all pairs of different sets that share a shingle."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, n)) for i, t in rows]
    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for a, (i, s) in enumerate(sets):
        shared = {}
        for x in s:
            for b in holders[x]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b, common in shared.items():
            if 100 * common >= percent * (len(s) + len(sets[b][1]) - common):
                lo, hi = sorted((root(i), root(sets[b][0])))
                parent[hi] = lo
    return sorted((i, len(s), root(i)) for i, s in sets)


def cases():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("qrstvwxyz")
    rows, at = [(0, None), (1, ""), (2, " \t\n"), (3, "A B c"), (4, "a b C"), (5, "a b"), (6, "a b c d")], 10
    for size in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 20, 30, 45, 60, 100, 160, 300, 700, 2000):
        for _ in range(12 if size < 100 else 4):
            base = [word() for _ in range(size)]
            for _ in range(rng.randint(2, 6)):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    k = rng.randrange(len(w))
                    rng.choice([lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k) if len(w) > 1 else None])()
                rows.append((at, " ".join(w)))
                at += 1
    passage = " ".join(word() for _ in range(60))
    for _ in range(80):
        rows.append((at, passage + " " + " ".join(word() for _ in range(rng.randint(2, 60)))))
        at += 1
    rows += [(at + k, rows[30][1]) for k in range(50)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS f1", "2 AS component_id").repartition(8)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 70)])
def test_equals_all_pairs(spark, n, percent):
    rows = cases()
    assert sorted(map(tuple, J.near_duplicates(frame(spark, rows), n, percent).collect())) == brute(rows, n, percent)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = cases()
    assert sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect())) == brute(rows)


def test_op7(spark):
    d = "/root/testdata/sf0.01"
    rows = list(map(tuple, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, J.op7_jaccard_join(spark, d).collect())) == brute(rows)


def test_every_linkable_pair_shares_a_key():
    """The pigeonhole, tried on sets that differ as much as they may."""
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, *range(4, 40), 64, 100, 150, 333]:
        for trial in range(40 if size < 40 else 5):
            a = [f"w{x}" for x in rng.integers(0, 1 << 60, size)]
            out, into = rng.integers(0, size // 6 + 1), rng.integers(0, size // 6 + 1)
            b = a[out:] + [f"v{x}" for x in rng.integers(0, 1 << 60, into)]
            both = len(a) - out
            if 100 * both < 85 * (len(a) + into) or not b:
                continue
            s = J.Sets([" ".join(a).encode(), " ".join(b).encode()], 1)
            owner, key = s.keys(85, np.ones(2, bool))
            assert set(key[owner == 0]) & set(key[owner == 1]), (size, out, into)


def test_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, "")]
    got = sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1), (3, 0, 3), (4, 0, 4)], key=repr)
    kept = J.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "f1", "component_id"]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "4", "None"]
    assert J.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(2, a), (5, a), (5, b), (9, b + " more"), (11, "something else altogether here"), (5, a)]
    assert sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect())) == brute(rows)
    assert {c for i, _, c in brute(rows) if i != 11} == {2}
    assert sorted(r["doc_id"] for r in J.drop_near_duplicates(frame(spark, rows)).collect()) == [2, 11]


def relatives(n_docs, words, changed, seed=3):
    """Texts with one origin, each with its own changed words: the origin is no member."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(words)]
    rows = []
    for k in range(n_docs):
        w = list(base)
        for at in rng.sample(range(words), changed):
            w[at] = word()
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("changed", [6, 8, 9])
def test_family_around_the_limit(spark, monkeypatch, changed):
    """Few, some, and hardly any of a family's pairs link; rows out of the blocks stay below those that go in."""
    seen = {}

    def watch(name):
        call = getattr(J, name)

        def watched(rows, *rest):
            out = call(rows, *rest)
            seen[name] = rows.count(), out.count()
            return out

        monkeypatch.setattr(J, name, watched)

    for name in ("_across", "_open_members", "_within"):
        watch(name)
    rows = relatives(150, 300, changed)
    assert sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect())) == brute(rows)
    assert all(out <= into for into, out in seen.values()) and {"_across", "_open_members"} <= set(seen)


@pytest.mark.parametrize("block_bytes", [J.BLOCK_BYTES, 20_000])
def test_long_texts_of_one_family(spark, monkeypatch, block_bytes):
    """Sketches longer than the folded ones, which let every pair of such texts pass; sizes of one family differ."""
    monkeypatch.setattr(J, "BLOCK_BYTES", block_bytes)
    rows = relatives(24, 6000, 60, seed=4)  # near 0.85
    rows += [(100 + k, t + " " + t[: len(t) * k // 12]) for k, (_, t) in enumerate(rows[:12])]
    rows += [(200 + k, t[: len(t) // 2]) for k, (_, t) in enumerate(rows[:4])]
    assert sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect())) == brute(rows)


def test_whole_sketches_lose_no_pair():
    """Every linked pair of different parts is among those that the sketches let pass, in both sorts of blocks."""
    rows = relatives(60, 700, 7, seed=5) + [(60 + k, t) for k, (_, t) in enumerate(relatives(20, 5000, 50, seed=6))]
    sets = J.Sets([t.encode() for _, t in rows], 4)
    held = J._Held(sets.lists())
    links = {(i, j) for i in range(80) for j in range(i) if held.link(np.array([i]), np.array([j]), 85)[0]}
    assert links
    for block in (np.zeros(80, int), np.arange(80) % 2):
        found = {(max(p), min(p)) for i, j in J._alike(sets.size, block, np.arange(80), sets.sketch(), 85) for p in zip(i.tolist(), j.tolist())}
        assert {p for p in links if block.max() == 0 or block[p[0]] != block[p[1]]} <= found
