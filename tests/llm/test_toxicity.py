import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from meadowlark.llm import queries, toxicity
from meadowlark.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_held_out_recall_and_alarms(spark):
    """False alarms and recall apart. Of the labels, about half mark texts without any sign of toxicity; those that
    can be told are found: held-out toxic rows with a word that only toxic rows have been seen with, several times."""
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    texts = {r.doc_id: set((r.text or "").lower().split()) for r in table(spark, SF, "documents").collect()}
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    seen, clean = Counter(), set()
    for d, toxic in labels.items():
        if d in texts and not out(d):
            if toxic:
                seen.update(texts[d])
            else:
                clean |= texts[d]
    learned = sum(v for d, v in labels.items() if d in texts and not out(d))
    signs = {w for w, n in seen.items() if n >= max(5, learned / 10) and w not in clean}
    rows = queries.op7_toxicity(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    told = {r.doc_id: r.predicted for r in rows if r.held_out and r.doc_id in labels}
    toxic, fine = [d for d in told if labels[d]], [d for d in told if not labels[d]]
    plain = [d for d in toxic if texts[d] & signs]
    assert learned >= 100 and len(plain) >= 50 and len(fine) > 1000
    assert sum(told[d] for d in plain) >= 0.9 * len(plain) and sum(told[d] for d in toxic) >= 0.7 * len(toxic)
    assert sum(told[d] for d in fine) <= 0.002 * len(fine)


def plain_grams(text):
    """Distinct n-grams of a text by their definition."""
    cased = re.sub(r"\s+", " ", f" {text.lower()} ")
    return {cased[k : k + n] for n in toxicity.GRAMS for k in range(len(cased) - n + 1)}


def test_fit_against_plain_version():
    """Log-count ratios and logistic weights by dictionaries and slow descent: nearly the same scores."""
    rng = random.Random(6)
    words = [f"{a}{b}o" for a in "bcdfg" for b in "aeiu"]
    texts = [" ".join([*rng.choices(words, k=8), *(["rotten"] if bad and rng.random() < 0.9 else [])]) for bad in [0, 1] * 40]
    y = [0, 1] * 40
    model = toxicity.fit([np.unique(toxicity.grams(t)) for t in texts], np.array(y), least_ratio=0.5)
    sets = [plain_grams(t) for t in texts]
    count = [Counter(g for s, v in zip(sets, y, strict=True) if v == side for g in s) for side in (0, 1)]
    ratio = {g: math.log((count[1][g] + 0.5) / 41) - math.log((count[0][g] + 0.5) / 41) for g in count[0] | count[1]}
    ratio = {g: r for g, r in ratio.items() if count[0][g] + count[1][g] >= 4 and abs(r) >= 0.5}
    rows = [[g for g in s if g in ratio] for s in sets]
    w, b = dict.fromkeys(ratio, 0.0), 0.0
    for _ in range(2500):
        err = [1 / (1 + math.exp(-b - sum(w[g] * ratio[g] for g in r))) - v for r, v in zip(rows, y, strict=True)]
        grad = dict.fromkeys(ratio, 0.0)
        for r, e in zip(rows, err, strict=True):
            for g in r:
                grad[g] += ratio[g] * e / len(rows)
        for g in ratio:
            w[g] -= 0.02 * (grad[g] + 1e-4 * w[g])
        b -= 0.02 * sum(err) / len(rows)
    plain = np.array([b + sum(w[g] * ratio[g] for g in r) for r in rows])
    own = np.array([model.score(t) for t in texts])
    logit = np.log(own / (1 - own))
    assert np.corrcoef(plain, logit)[0, 1] > 0.95 and ((plain > np.median(plain)) == (logit > np.median(logit))).mean() > 0.95
    # a score by hand
    weight = dict(zip(np.frombuffer(model.places, np.uint32).tolist(), np.frombuffer(model.weights, np.float32).tolist(), strict=True))
    z = model.bias + sum(weight.get(h, 0) for h in set(toxicity.grams(texts[1]).tolist()))
    assert abs(own[1] - 1 / (1 + math.exp(-z))) < 1e-5


def test_bounded_sample(spark):
    """Rows beyond the bounds aren't learned from; all are scored."""
    docs = spark.createDataFrame([(k, "calm words here" if k % 2 else "vile words here") for k in range(40)] + [(99, "z" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)] + [(99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most_bytes=200)
    assert toxicity.train(docs, labels, 0, 0).score("vile") == toxicity.fit([], np.zeros(0)).score("vile")
    assert model.score("z" * 50) == model.score("q")
    assert docs.select(toxicity.toxicity_score(F.col("text"), model).alias("s")).where("s BETWEEN 0 AND 1").count() == 41


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot scum"), (4, "x" * 300_000)], "doc_id long, text string").selectExpr("*", "'own' AS score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels)
    assert got.count() == 4 and got.where("score BETWEEN 0 AND 1").count() == 4
    assert toxicity.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_only_the_text_counts():
    texts = ["good horse and rider"] * 30 + ["you stupid loser horse"] * 30
    model = toxicity.fit([np.unique(toxicity.grams(t)) for t in texts], np.array([0] * 30 + [1] * 30))
    assert model.score("a stupid loser") > 0.7 > model.score("a good rider") and model.score(None) == model.score("")
    assert toxicity.fit([np.unique(toxicity.grams("a b c d"))], np.array([1])).score("x") > 0.7
