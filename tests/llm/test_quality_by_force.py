"""The weak-label model, its scorer and its lexicon from their definitions, row by row, against the classifier."""

import collections
import math

import numpy as np

from tessera.llm import quality


def posteriors(patterns, rounds=100):
    """Expectation-maximisation over rows, not over patterns with counts."""
    names = list(quality.LABELLERS)
    votes = [[(p // 3 ** (len(names) - 1 - k)) % 3 for k in range(len(names))] for p in patterns]
    wrong, right, good = [0.05] * len(names), [0.4] * len(names), 0.8
    for _ in range(rounds):
        found = []
        for row in votes:
            odds = math.log(good / (1 - good))
            for k, v in enumerate(row):
                odds += 0 if not v else math.log(wrong[k] / right[k]) if v == quality.BAD else math.log((1 - wrong[k]) / (1 - right[k]))
            found.append(1 / (1 + math.exp(-max(-500, min(500, odds)))))
        for k in range(len(names)):
            bad_of_good = sum(p for p, row in zip(found, votes) if row[k] == quality.BAD)
            bad_of_bad = sum(1 - p for p, row in zip(found, votes) if row[k] == quality.BAD)
            said_good, said_bad = sum(p for p, row in zip(found, votes) if row[k]), sum(1 - p for p, row in zip(found, votes) if row[k])
            wrong[k] = min(0.5, (bad_of_good + 0.5) / (said_good + 10))
            right[k] = min(1 - 1e-6, max(wrong[k] + 1e-6, (bad_of_bad + 4) / (said_bad + 10)))
        good = min(1 - 1e-3, max(1e-3, (sum(found) + 8) / (len(found) + 10)))
    return found, good


def vector(text):
    """A text's features as one dense row."""
    looks, out = quality.Looks(text), np.zeros(quality.FEATURES)
    shape = [int(quality._SHAPE[b]) for b in looks.bytes]
    times = collections.Counter((sum(shape[k + j] << 8 * j for j in range(4)) * 0x9E3779B1 % 2**32) >> 20 for k in range(len(shape) - 3))
    for place, n in times.items():
        out[place] += math.sqrt(n / len(shape))
    for k, (v, scale) in enumerate([(looks.caps, 10), (looks.rare, 50), (looks.shouts, 10), (looks.bars, 10), (looks.again, 10), (looks.variety, 10), (looks.short, 10), (looks.runs, 10), (looks.stops, 10), (math.log2(looks.n + 1), 0.5)]):
        out[(1_000_003 * (k + 1) + 7919 * min(9, int(v * scale))) * 0x9E3779B1 % 2**32 >> 20] += 0.5
    return out


def trained(rows, labels, prior):
    x = np.stack(rows)
    w, bias = np.zeros(x.shape[1]), math.log(prior / (1 - prior))
    speed, speed_of_bias = np.zeros_like(w), 0.0
    weight = labels / labels.sum() + (1 - labels) / (1 - labels).sum()
    weight /= weight.sum()
    for _ in range(300):
        error = weight * (1 / (1 + np.exp(-(x @ w + bias))) - labels)
        speed = 0.9 * speed - 2 * (x.T @ error + 1e-4 * w)
        speed_of_bias = 0.9 * speed_of_bias - 2 * error.sum()
        w, bias = w + speed, bias + speed_of_bias
    return w, bias


def marks(texts):
    """texts: distinct texts with whether they are toxic."""
    clean = lambda text: {w.strip(b".,;:!?|*$%&#\"'()") for w in (text or "").encode().lower().split()}
    yes, no = ([clean(t) for t, y in texts.items() if y == side] for side in (1, 0))
    out = {}
    for word in set().union(*yes):
        k, other = sum(word in t for t in yes), sum(word in t for t in no)
        n, p = k + other, len(yes) / (len(yes) + len(no))
        weight = math.log((k + 0.5) / (len(yes) + 1)) - math.log((other + 0.5) / (len(no) + 1))
        if not word or k < 5 or other > 0.05 * k or weight < quality.TOXIC or k <= p * n:
            continue
        if n * (k / n * math.log(k / n / p) + (other / n * math.log(other / n / (1 - p)) if other else 0)) >= -math.log(quality.CHANCE):
            out[word] = weight
    return out


def test_classifier_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_001, None), (10_002, "  ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in quality.classify(table, quality.learn(table, labels)).collect()}
    soft, good = posteriors([quality.pattern_of(quality.Looks(t)) for _, t in rows])
    used = [(vector(t), p) for (_, t), p in zip(rows, soft) if t and t.strip()]
    w, bias = trained([x for x, _ in used], np.array([p for _, p in used]), good)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    lexicon = marks({t: toxic[i] for i, t in rows if i in toxic})
    for (i, text), p in zip(rows, soft):
        r = found[i]
        assert abs(r.weak_posterior - p) < 1e-6
        if not text or not text.strip():
            assert (r.score, r.toxic_weight, r.keep) == (0.0, 0.0, False)
            continue
        score = 1 / (1 + math.exp(-float(vector(text) @ w + bias)))
        own = sum(lexicon.get(x, 0.0) for x in {x.lower().strip(b".,;:!?|*$%&#\"'()") for x in text.encode().split()})
        assert abs(r.score - score) < 1e-3 and abs(r.toxic_weight - own) < 1e-9, i
        assert r.keep == (r.score >= 0.5 and own < quality.TOXIC)
    assert 0 < sum(r.keep for r in found.values()) < len(rows)
