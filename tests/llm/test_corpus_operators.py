"""Suffix tree, neighbours, classifier, line dedup, near-duplicates, pipeline: against brute force and on edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, cross_polytope, line_dedup, ngram_join, quality, queries, suffix_tree

DOCS = "doc_id long, text string, node string, sig string, code int, mark int, place int, h int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in rows], DOCS)


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def base_scores(rows):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count = collections.Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [(i, h, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for (i, t), h in zip(rows, held)]


def test_suffix_tree_scores(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9_000_001, None), (9_000_002, ""), (9_000_003, rows[0][1]), (9_000_003, rows[0][1]), (9_000_004, "unseen zzz words É")]
    found = suffix_tree.score(docs(spark, rows), held()).collect()
    want = sorted(base_scores(rows))
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-9 * max(1, abs(w[5])) for g, w in zip(got, want))
    others = [r for r in found if r.held_out]
    assert sum(r.score for r in others) > sum(r.base_score for r in others) and all(math.isfinite(r.score) for r in found)


def test_every_state_is_a_distribution(spark, sf, monkeypatch):
    trees, grown = [], suffix_tree.grown
    monkeypatch.setattr(suffix_tree, "grown", lambda *a: trees.append(grown(*a)) or trees[-1])
    queries.op1_suffix_tree_scoring(spark, sf)
    tree = trees[0]
    symbols = np.arange(1, tree.n_symbols)
    assert abs(tree.root[1:].sum() - 1) < 1e-9
    for depth in range(1, len(tree.contexts) + 1):
        for k in np.flatnonzero(tree.kept[depth - 1])[:5]:
            chain, own = [], int(k)
            for d in range(depth, 0, -1):
                chain.insert(0, np.full(len(symbols), own))
                own = int(tree.contexts[d - 1][own]) & ((1 << suffix_tree.BITS) - 1) if d > 1 else own
            assert abs(tree._probability(np.full(len(symbols), depth), chain, symbols).sum() - 1) < 1e-9
    # scores of a sequence equal those of its states, looked up one by one
    sequence = np.array([1, 5, 9, 5, 9, 5, 2])
    first = np.array([True] + [False] * 6)
    ids = tree.context_ids(sequence, first)
    state = np.zeros(7, np.int64)
    for d, found in enumerate(ids, 1):
        state[[k for k in range(7) if found[k] >= 0 and tree.kept[d - 1][found[k]]]] = d
    chain = [np.maximum(f, 0).astype(np.int64) for f in ids]
    assert np.allclose(tree.log_probabilities(sequence, first), np.log10(tree._probability(state, chain, sequence)))


def test_contexts_of_enough_occurrences_stay_however_large_the_corpus(spark):
    """What occurs 1000 (word), 200 (context) and 4 times (transition) is kept among 10^10 tokens."""
    codes = np.array([11, 22, 33], np.uint64)
    tree = suffix_tree.Tree(10**10, 3, codes, np.array([5000, 5000, 1000]), np.zeros(suffix_tree.CLASSES), np.zeros(suffix_tree.CLASSES))
    assert list(tree.symbol_codes) == list(codes)
    end = tree.n_symbols - 1
    texts = [[1, 2, 3, end]] * 300 + [[1, 1, 2, 1, 1]] * 5 + [[3, 3, 2, end]] * 3
    made = suffix_tree.grown(tree, spark.createDataFrame([(np.array(t, np.uint32).tobytes(),) for t in texts], "symbols binary"))
    bits, mask = suffix_tree.BITS, (1 << suffix_tree.BITS) - 1
    strings = [[(int(k),) for k in made.contexts[0]]]
    for keys in made.contexts[1:]:
        strings.append([(int(k) >> bits, *strings[-1][int(k) & mask]) for k in keys])
    assert [sorted(x) for x in strings[1:]] == [[(0, 1), (1, 2), (2, 3)], [(0, 1, 2), (1, 2, 3)]]
    followed = {(strings[0][int(m) >> bits], int(m) & mask) for m in made.moves[0]}
    assert ((1,), 2) in followed and ((3,), end) in followed and ((3,), 3) not in followed and ((3,), 2) not in followed


def test_slices_of_the_tree_score_as_the_whole(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows += [(9_000_001, None), (9_000_003, rows[0][1]), (9_000_003, rows[0][1])]
    got = []
    for size in (10**9, 2_000):
        monkeypatch.setattr(suffix_tree, "SLICE", size)
        calls, slices = [], suffix_tree.slices
        monkeypatch.setattr(suffix_tree, "slices", lambda *a, f=slices: calls.append(f(*a)) or calls[-1])
        got.append(sorted((r.doc_id, r.n_tokens, r.score) for r in suffix_tree.score(docs(spark, rows), held()).collect()))
        monkeypatch.setattr(suffix_tree, "slices", slices)
        assert (len(calls[0]) > 2) == (size == 2_000)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-9 * max(1, abs(a[2])) for a, b in zip(*got)) and len(got[0]) == len(got[1])


def test_suffix_tree_without_training(spark):
    assert suffix_tree.score(docs(spark, []), held()).collect() == []
    found = suffix_tree.score(docs(spark, [(1, "a b")]), F.lit(True)).collect()[0]
    assert (found.n_tokens, found.n_known, found.train_tokens, found.base_score) == (3, 0, 0, 0.0)


def nearest_by_force(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            best = {}
            for i, y in good:
                if i != q and len(y) == len(x):
                    s = float(np.sqrt(((x - y) ** 2).sum()))
                    best[i] = min(s, best.get(i, s))
            out[q] = sorted((s, i) for i, s in best.items())[:k]
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "tiny"])
def test_neighbours(spark, kind):
    draw = np.random.default_rng(3)
    if kind == "random":
        rows = [(i, draw.normal(size=16).tolist()) for i in range(1500)]
    elif kind == "copies":
        rows = [(i, [1.0, 2.0, 2.0, 0.0]) for i in range(300)] + [(300 + i, [1.0, 2.0, 2.0, 0.001 * i]) for i in range(300)]
    else:
        rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [0.5, 0.0]), (100, [1.0, 1.0, 2.0]), (None, [1.0, 0.0]), (200, None), (1, [3.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cell int, ids string")
    found = collections.defaultdict(list)
    for r in cross_polytope.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    want = nearest_by_force(rows)
    if kind == "random":
        hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
        assert hits >= 0.9 * 10 * len(want) and all(len(found[q]) == 10 for q in want)
    else:
        assert {q: v for q, v in want.items() if v} == dict(found)


def test_neighbours_recall_and_empty(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = nearest_by_force(rows)
    found = collections.defaultdict(set)
    for r in queries.op3_cross_polytope(spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    assert sum(len({i for _, i in want[q]} & found[q]) for q in want) >= 0.9 * 10 * len(want)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cross_polytope.nearest(empty, F.col("vec_id") % 100 == 0).collect() == []


def test_hot_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "PART", 16)
    rows = [(i, [1.0, 1e-4 * i, 0.0, 0.0]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in cross_polytope.nearest(table, F.col("vec_id") % 100 == 0).orderBy("rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    assert dict(found) == nearest_by_force(rows)


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r for r in found if r.quality == 1 and r.toxic == 0]
    bad = [r for r in found if r.quality == 0]
    assert sum(r.keep for r in clean) >= 0.98 * len(clean)
    assert sum(r.score < 0.5 for r in bad) >= 0.95 * len(bad)


def test_estimates_find_the_better_labellers():
    draw = np.random.default_rng(0)
    good = draw.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.7, 0.6, 0.9, 0.8, 0.95]
    patterns = np.zeros(len(good), np.int64)
    for a in accuracy:
        right = draw.random(len(good)) < a
        vote = np.where(draw.random(len(good)) < 0.2, 0, np.where(right == good, quality.GOOD, quality.BAD))
        patterns = patterns * 3 + vote
    pattern, count = np.unique(patterns, return_counts=True)
    posterior, votes, share = quality.estimate(pattern, count)
    assert abs(share - 0.8) < 0.02 and np.abs(votes[1] - accuracy).max() < 0.05
    assert ((posterior[np.searchsorted(pattern, patterns)] >= 0.5) == good).mean() > 0.97


def test_classifier_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A fine day for a walk, said the man, and went to the shore."), (4, "A fine day for a walk, said the man, and went to the shore."), (None, "x"), (5, "word " * 100_000)]
    model = quality.learn(docs(spark, rows), spark.createDataFrame([(77, 1), (None, 1), (4, None)], "doc_id long, toxic int"))
    found = quality.classify(docs(spark, rows), model).collect()
    assert len(found) == len(rows) and not any(r.keep for r in found if r.doc_id in (1, 2, 3)) and len({r.score for r in found if r.doc_id == 4}) == 1
    empty = docs(spark, [])
    assert quality.classify(empty, quality.learn(empty, None)).collect() == [] and quality.keep_good(empty, model).columns == empty.columns


def dedup_by_force(rows, p=9, q=10, after=lambda text: 0):
    """Texts after removal: a line goes if any earlier one is similar. after: the order of the texts of one id; equal rows count once."""
    earlier, done = [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, after(r[1]))):
        if text is None:
            done[i, text] = None
            continue
        kept = []
        for line in text.split("\n"):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            if not words:
                kept.append(line)
                continue
            if not any((p + q) * len(words & e) >= p * (len(words) + len(e)) for e in earlier if 10 * min(len(words), len(e)) >= 9 * max(len(words), len(e))):
                kept.append(line)
            earlier.append(words)
        done[i, text] = "\n".join(kept)
    return [(i, done[i, t]) for i, t in rows]


def lines_of_many_kinds():
    draw = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    base = [draw.sample(words, n) for n in (8, 9, 10, 17, 19, 20, 30, 30, 60)]
    rows = []
    for k in range(150):
        lines = [" ".join(draw.sample(words, draw.randint(1, 25))) for _ in range(2)]
        for _ in range(2):
            near = list(draw.choice(base))
            for _ in range(draw.randint(0, max(1, len(near) // 10))):
                near[draw.randrange(len(near))] = draw.choice(words)
            lines.append(" ".join(near[draw.randint(0, 1) :]))
        lines += ["", "the same line in all of them", "  the\tsame line of all in them"]
        draw.shuffle(lines)
        rows.append((k * 3, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("bounds", [(3, 4, 64), (3, 4, 1 << 18), (256, 512, 1 << 18)])
def test_line_dedup(spark, monkeypatch, bounds):
    for name, value in zip(("MEET", "PART", "SKETCH"), bounds):  # low bounds let lines meet in blocks, too
        monkeypatch.setattr(line_dedup, name, value)
    rows = lines_of_many_kinds() + [(9001, None), (9002, ""), (9003, "\n\n"), (None, "first of all")]
    found = line_dedup.dedup_lines(docs(spark, rows))
    assert sorted((r.doc_id or -1, r.text or "") for r in found.collect()) == sorted((i or -1, t or "") for i, t in dedup_by_force(rows))
    assert found.columns == [*docs(spark, []).columns, "n_removed"]
    assert found.where("doc_id = 9001 and text is null and n_removed = 0").count() == 1


def test_line_dedup_of_repeated_and_null_ids(spark):
    rows = [(r[0] // 30 if r[0] % 7 else None, r[1]) for r in lines_of_many_kinds()]
    rows += rows[:40] + [(1, "x y z"), (7, "x y z"), (7, "other line"), (7, None), (None, None), (None, "x y z\nmore of it"), (None, "x y z\nmore of it"), (8, "long " * 200_000 + "\nother line")]
    table = spark.createDataFrame([(i, t, "a", 5) for i, t in rows], "doc_id long, text string, N_Removed string, __mask int")
    order = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    found = line_dedup.dedup_lines(table)
    assert found.columns == ["doc_id", "text", "N_Removed", "__mask", "n_removed_"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=key) == sorted(dedup_by_force(rows, after=order.get), key=key)


def test_line_dedup_of_nothing_and_equal_rows(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []
    found = line_dedup.dedup_lines(docs(spark, [(1, "a b\na b\nc"), (1, "a b\na b\nc"), (2, "c")])).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in found) == [(1, "a b\nc", 1), (1, "a b\nc", 1), (2, "", 1)]


def test_texts_that_keep_all_lines_are_not_shuffled(spark):
    rows = [(1, "a b c\n\n\nd e f\n"), (2, "g h i"), (3, "\nj k l\ng h i"), (4, " \nm n o"), (5, "p q r\np q r"), (6, None), (7, ""), (8, "\n\n"), (9, "a b c")]
    found = line_dedup.dedup_lines(docs(spark, rows))
    assert sorted((r.doc_id, r.text, r.n_removed) for r in found.collect()) == [(1, rows[0][1], 0), (2, "g h i", 0), (3, "\nj k l", 1), (4, rows[3][1], 0), (5, "p q r", 1), (6, None, 0), (7, "", 0), (8, "\n\n", 0), (9, "", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    whole = [x for x in plan.split("\n") if "Join" in x]
    assert len(whole) == 1 and plan.lstrip().startswith("Union")  # one side of the union has no join


def components_by_force(rows):
    """The number of each row's component."""
    return groups_by_force([(k, t) for k, (_, t) in enumerate(rows)], ordered=False)


def groups_by_force(rows, ordered=True):
    def shingled(text):
        w = tokens(text)[:-1]
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    if not ordered:
        return [find(k) for k in range(len(rows))]
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted(((i, len(sets[k]), smallest.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("bounds", [(512, 400_000, 256.0), (6, 400, 2.0)])
def test_near_duplicates(spark, monkeypatch, bounds):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", bounds[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", bounds[1])
    if bounds[2] < 256:  # nearly every shingle is of the frequent class
        real = ngram_join.signatures
        monkeypatch.setattr(ngram_join, "signatures", lambda codes, counts, frequent: real(codes, counts, bounds[2]))
    draw = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([3, 6, 12, 30, 47, 60, 200]))]
        for _ in range(draw.randint(1, 14)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "Short TEXT"), (2004, "short text"), (2004, "short text"), (2005, "a b c d e"), (2006, "x " * 30_000)]
    found = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == groups_by_force(rows)


def near_texts():
    """Texts of a few families, with null ids, ids that repeat, and rows that do."""
    draw = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(8):
        base = [draw.choice(words) for _ in range(100)]
        for k in range(6):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2])):
                text[draw.randrange(100)] = draw.choice(words)
            rows.append((draw.choice([None, None, g, 100 + draw.randrange(5), 200 + len(rows)]), " ".join(text)))
    return rows + rows[:10] + [(3, "A"), (5, "A"), (5, "B"), (5, "B"), (None, "C"), (None, "C"), (None, None), (None, ""), (7, None), (7, None), (8, "long " * 150_000 + "end")]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = near_texts()
    found = ngram_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == groups_by_force(rows)


def test_one_row_of_each_component_stays(spark):
    rows = near_texts()
    table = spark.createDataFrame([(i, t, k % 2, k % 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, worded int")
    found = ngram_join.one_of_each(table)
    assert found.columns == table.columns
    left = [(r.doc_id, r.text) for r in found.collect()]
    component = [(i, t, c) for (i, t), c in zip(rows, components_by_force(rows))]
    empty = [(i, t) for i, t in rows if not (t or "").split()]
    assert sorted(((i, t) for i, t in left if not (t or "").split()), key=str) == sorted(empty, key=str)
    worded = [(i, t) for i, t in left if (t or "").split()]
    of = {(i, t): c for i, t, c in component}
    assert sorted(of[x] for x in worded) == sorted({c for i, t, c in component if (t or "").split()})
    for i, t in worded:  # no row of the component has a smaller id
        assert i is None and all(j is None for j, _, c in component if c == of[i, t]) or i == min(j for j, _, c in component if c == of[i, t] and j is not None)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).collect() == []


def test_prefixes_share_enough_signatures():
    """Any two similar sets share a signature, and as many as the filter asks for."""
    draw = np.random.default_rng(5)
    for _ in range(300):
        m = int(draw.integers(4, 300))
        universe = draw.integers(0, 2**63, m * 2).astype(np.uint64)
        counts = dict(zip(universe.tolist(), draw.choice([1, 2, 300, 1000], len(universe)).tolist()))
        a = np.unique(universe[:m])
        change = int(draw.integers(0, max(1, m // 9) + 1))
        b = np.unique(np.concatenate([draw.permutation(a)[change:], universe[m : m + int(draw.integers(0, change + 1))]]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        (sa, _, na), (sb, _, nb) = (ngram_join.signatures(x, np.array([counts[c] for c in x.tolist()]), 256.0) for x in (a, b))
        shared = len(np.intersect1d(sa, sb))
        assert shared >= max(1, na, nb)


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: find(k) for k in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.good_quality(spark, docs_, sf)
    assert left.columns == docs_.columns
    lined = corpus_pipeline.without_repeated_lines(spark, docs_, sf)
    assert lined.columns == docs_.columns and dict(lined.dtypes) == dict(docs_.dtypes)
    want = dict(dedup_by_force([(r.doc_id, r.text) for r in docs_.collect()]))
    assert {r.doc_id: r.text for r in lined.collect()} == {i: t for i, t in want.items() if t.strip()}
    single = {r.doc_id for r in corpus_pipeline.one_of_near_duplicates(spark, docs_, sf).collect()}
    assert single == {c for _, _, c in groups_by_force([(r.doc_id, r.text) for r in docs_.collect()])}
    found = corpus_pipeline.run(spark, sf)
    assert found.count() > 0 and {r.doc_id for r in found.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs_.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_duplicates", "decontamination", "packing"]
    none = docs_.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_stages_on_odd_rows(spark, sf):
    """Nulls, repeated ids and rows, a very long text, and columns with names that the operators use themselves."""
    import corpus_pipeline

    fine = "The river bends twice before it meets the northern road, and nobody minds it at all, said the man by the gate on Monday."
    other = "Her garden, though small, was full of apples in the autumn; we used to pick them after school, and eat most on the way."
    texts = [(None, None), (None, ""), (1, " \n"), (1, fine), (1, fine), (1, other), (None, other), (2, fine + "\n" + fine), (3, "$$$$ #### @@@@ ****" * 20), (4, (fine + " ") * 4000), (5, None), (5, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, key string, row long, worded boolean, place int, edits int, label int, _id int, token string, codes int, h int"
    table = spark.createDataFrame([(i, t, None, "s", len(t or ""), 7, "k", k, None, 1, 2, 3, 4, "t", 5, 6) for k, (i, t) in enumerate(texts)], columns)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
        left[name] = sorted(((r.doc_id, r.text, r.row) for r in out.collect()), key=str)
    assert all(t in (fine, other, fine + "\n" + fine) or t == texts[9][1] for _, t, _ in left["quality_classifier"]) and {fine, other} <= {t for _, t, _ in left["quality_classifier"]}
    assert [(i, t) for i, t, _ in left["decontamination"]] == sorted(((i, t) for i, t in texts), key=str) or len(left["decontamination"]) == len(texts)
    single = left["near_duplicates"]
    # a text that repeats itself has four shingles more than its 20
    assert sorted(t for _, t, _ in single if t and t.strip()) == sorted({fine, other, texts[8][1]}) and sum(not (t or "").strip() for _, t, _ in single) == 5
    lined = left["line_dedup"]
    assert sum(1 for _, t, _ in lined if t == fine) == 2 and sum(1 for _, t, _ in lined if t == other) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
    assert sum(r.piece == 0 for r in packed) == len(texts)


def test_rare_words_are_looked_up_by_a_join(spark, sf, monkeypatch):
    """With hardly any word in the head, the scores are the same."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(9_000_001, None), (9_000_004, "unseen zzz words")]
    got = []
    for head in (suffix_tree.HEAD, 1e-2):
        monkeypatch.setattr(suffix_tree, "HEAD", head)
        monkeypatch.setattr(suffix_tree, "SYMBOL_SHARE", 2e-2)
        got.append(sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_tree.score(docs(spark, rows), held()).collect()))
    for a, b in zip(*got):
        assert a[:4] == b[:4] and all(abs(x - y) <= 1e-9 * max(1, abs(x)) for x, y in zip(a[4:], b[4:]))
    assert len(got[0]) == len(rows)


def tree_by_force(texts, depth):
    """How often each string of symbols occurs, and each string with its next symbol. texts: lists of symbols; 0 stands before each."""
    strings, moves = collections.Counter(), collections.Counter()
    for t in texts:
        padded = [0, *t]
        for d in range(1, depth + 1):
            for k in range(len(padded) - d + 1):
                strings[tuple(padded[k : k + d])] += 1
                if k + d < len(padded):
                    moves[tuple(padded[k : k + d]), padded[k + d]] += 1
    return strings, moves


@pytest.mark.parametrize("part", [suffix_tree.PART, 300])
def test_tree_counts_equal_brute_force(spark, part, monkeypatch):
    """Candidates, their transitions and the scores of a small tree against counts by hand; in one part, and in parts that common contexts exceed."""
    monkeypatch.setattr(suffix_tree, "PART", part)
    draw = random.Random(4)
    codes = np.array([11, 22, 33, 44], np.uint64)
    texts = []
    for _ in range(120):
        text = [1, 2]
        for _ in range(draw.randint(1, 30)):  # the next symbol depends on the two before
            text.append((text[-1] + 2 * text[-2]) % 3 + 1 if draw.random() < 0.7 else draw.choice([1, 1, 2, 3]))
        texts.append([*text, 4])
    total = sum(map(len, texts))
    counts = np.array([sum(t.count(s) for t in texts) for s in (1, 2, 3, 4)])
    tree = suffix_tree.Tree(total, 4, codes, counts, np.zeros(suffix_tree.CLASSES), np.zeros(suffix_tree.CLASSES))
    made = suffix_tree.grown(tree, spark.createDataFrame([(np.array(t, np.uint32).tobytes(),) for t in texts], "symbols binary"))
    strings, moves = tree_by_force(texts, 3)
    bits, mask = suffix_tree.BITS, (1 << suffix_tree.BITS) - 1
    known = [[(int(k),) for k in made.contexts[0]]]
    for keys in made.contexts[1:]:
        known.append([(int(k) >> bits, *known[-1][int(k) & mask]) for k in keys])
    for d, own in enumerate(known, 1):
        followed = {c for c, _ in moves if len(c) == d}
        assert {c for c in own if c in followed} == {c for c in followed if strings[c] >= 2 and all(strings[c[k:]] >= 2 for k in range(d))}
    # probabilities from the definition, context by context
    root = {s: float(made.root[s]) for s in range(1, 5)}
    kept = {c for d, own in enumerate(known, 1) for c, k in zip(own, made.kept[d - 1]) if k}

    def probability(context, symbol):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return root[symbol]
        n = strings[context]
        nexts = {x: moves[context, x] for x in range(1, 5) if moves[context, x]}
        prior = 3.0 + 2.0 * len(nexts)
        rest = max(n - sum(nexts.values()), 0)
        return (nexts.get(symbol, 0) + (rest + prior) * probability(context[1:], symbol)) / (n + prior)

    sequence = texts[0]
    got = made.log_probabilities(np.array(sequence), np.array([True] + [False] * (len(sequence) - 1)))
    want = [math.log10(probability(tuple([0, *sequence][max(0, k - 2) : k + 1]), x)) for k, x in enumerate(sequence)]
    assert np.allclose(got, want) and len(kept) > 3
