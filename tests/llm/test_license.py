import math
import re

from sparkpoison.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, coverage=0.8):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    at, base, score = [], set(), 0.0
    for phrase, label in L.BASE:
        p = phrase.split()
        places = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += places
        if places:
            base.add(label)
            score = 1.0
    labels = set(base)
    for label, notice, phrases in L.TEMPLATES:
        run = notice.split()
        fixed = set()
        for phrase in phrases:
            part = phrase.split()
            i = next(i for i in range(len(run)) if run[i : i + len(part)] == part)
            fixed |= set(range(i, i + len(part)))
        for start in range(1 - len(run), len(words)):
            same = {k for k in range(len(run)) if 0 <= start + k < len(words) and words[start + k] == run[k]}
            if len(same) >= math.ceil(coverage * len(run) - 1e-9) and fixed <= same:
                labels.add(label)
                score = max(score, len(same) / len(run))
    join = lambda s: ",".join(sorted(s))
    return len(words), len(at), min(at, default=None), max(at, default=None), join(base), join(labels), round(score, 9)


def same(got, texts):
    for r in got:
        assert (*tuple(r)[1:7], round(r["score"], 9)) == brute(texts[r["doc_id"]]), (r, texts[r["doc_id"]])


def test_small(spark):
    texts = [
        None, "", "CC BY", "cc-by cc by", "all rights reserved. ALL RIGHTS\nRESERVED all rights", "Licensed under the Apache License, Version 2.0.",
        "under the Apache License, Version 2.0 x", "licensed under the apache xx license version 2.0", "Released under the MIT License.", "MIT License",
        "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3.", "é" * 100_000 + " licensed under the gnu general public license version 3",
        "licensed to under the gnu general public license version 3 and licensed under the apache license version 2 0", "ccby cc by", "ÀLL rights reserved",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS labels", "2 AS score")
    got = L.scan_licenses(df, ["doc_id"]).collect()
    assert len(got) == len(texts)
    same(got, texts)
    assert L.scan_licenses(df.limit(0), ["doc_id"]).count() == 0


def test_op3(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = L.op3_license_scan(spark, sf_dir).collect()
    assert len(got) == len(texts)
    same(got, texts)
