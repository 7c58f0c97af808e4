"""Licence scans and resampling: against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import license_scan, resample

DOCS = "doc_id long, text string, row int, score int, id string, n int, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, "y") for i, t in rows], DOCS)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


# Licence scans

NOTICE = {t.label: t.text for t in license_scan.TEMPLATES}


def scan_by_force(text):
    """n_words, n_base, first_word, last_word, base_labels of the contract."""
    said, places, labels = words(text), [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        for i in range(len(said) - len(p) + 1):
            if said[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(said), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", " \n", "MIT License", "mit\nlicense MIT-license, mit license mit mit license", "The GNU General Public\tLicense.", "gnu general public gnu general public license license",
    "Kit licenſe, ＭＩＴ license, miTK license", "cc by cc by-nc 4.0 and Apache License, Version 2.0", "apachelicense mit_license mit5license", "x" * 70_000 + " mit license", NOTICE["mit-notice"],
    "word " * 9_999 + "mit license " + "é" * 60_000 + " apache license " + "z " * 70_000 + "gnu general public license", "cc by " * 30_000,
]


@pytest.mark.parametrize("piece", [license_scan.PIECE, 40])
def test_base_places_equal_brute_force(spark, monkeypatch, piece):
    """Also where nearly every text is cut into pieces."""
    monkeypatch.setattr(license_scan, "PIECE", piece)
    draw = random.Random(3)
    vocabulary = ["gnu", "general", "public", "license", "License,", "mit", "MIT", "cc", "BY", "apache", "\n", "of", "ünder"]
    rows = list(enumerate(TEXTS if piece > 40 else [t for t in TEXTS if len(t or "") < 500])) + [(100 + k, " ".join(draw.choices(vocabulary, k=draw.randint(0, 40)))) for k in range(150)]
    found = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == scan_by_force(text), (i, text and text[:80])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) >= bool(r.n_base)


def test_long_notices_are_found_with_edits_and_not_by_their_parts(spark):
    notice = NOTICE["bsd-notice"].split()
    swapped, added, missing = list(notice), list(notice), notice[:8] + notice[9:]
    swapped[10] = "minor"
    added.insert(7, "compiled")
    rows = [(1, " ".join(notice)), (2, " ".join(swapped)), (3, " ".join(added)), (4, " ".join(missing)), (5, " ".join(notice[:9])), (6, " ".join(reversed(notice))), (7, "x ".join(notice)), (8, " ".join(notice[:10] + ["far"] * 60 + notice[10:]))]
    found = {r.doc_id: (r.labels, round(r.score, 3)) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert found[1] == ("bsd-notice", 1.0)
    assert [found[k][0] for k in (2, 3, 4)] == ["bsd-notice"] * 3 and all(0.8 <= found[k][1] < 1 for k in (2, 4))
    assert [found[k] for k in (5, 6, 7, 8)] == [("", 0.0)] * 4


def test_every_notice_finds_itself(spark):
    rows = [(k, f"Before it, {t.text} and behind.") for k, t in enumerate(license_scan.TEMPLATES)]
    for r in license_scan.scan(docs(spark, rows)).collect():
        assert license_scan.TEMPLATES[r.doc_id].label in r.labels.split(",") and r.score == 1


def test_repeated_and_null_ids_stay_rows_of_their_own(spark):
    rows = [(1, "mit license"), (1, "mit license"), (1, None), (None, "cc by"), (None, None)]
    found = sorted((r.doc_id or 0, r.n_words, r.n_base) for r in license_scan.scan(docs(spark, rows)).collect())
    assert found == [(0, 0, 0), (0, 2, 1), (1, 0, 0), (1, 2, 1), (1, 2, 1)]
    assert license_scan.scan(docs(spark, [])).collect() == []
    assert license_scan.scan(docs(spark, rows)).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


# Resampling


def test_crc_of_joined_parts():
    draw = random.Random(1)
    parts = [(draw.randbytes(draw.randint(0, 20)), draw.randbytes(n)) for n in [0, 1, 5, 62, 63, 64, 65, 127, 128, 1000, 70_000] * 3]
    got = resample.behind(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts])) ^ np.array([zlib.crc32(b) for _, b in parts], np.uint32)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_features_equal_plain_hashes():
    texts = ["A b c", "", None, "one", "Two words", "é" * 90 + " x É y", "a_b-c9 \x00z", "w" * 300 + " v " + "u" * 64]
    for array in (pa.array(texts), pa.array(["first", *texts, "last"]).slice(1, len(texts))):
        sizes, found = resample.features(array)
        assert sizes.tolist() == [len(words(t)) for t in texts]
        ends = np.cumsum(sizes)
        for text, n, end in zip(texts, sizes, ends):
            assert sorted(buckets(text)) == sorted(int(b) for begin, bucket in found for p, b in zip(begin, bucket) if end - n <= p < end)


def resampled_by_force(rows, target, share=5, least=20):
    s, t = ([0] * 10_000 for _ in range(2))
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in buckets(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000.0) / ((s[b] + 1) * (sum(t) + 10_000.0)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        out.append([i, len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("share", [0, 5, 40, 100])
def test_resampling_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(resample, "RUN", 3)  # copies in several runs
    draw = random.Random(share)
    said = ["the", "of", "Word", "naïve", "x9", "theorem", "lemma", "proof"]
    rows = [(k, " ".join(draw.choices(said, k=draw.randint(0, 60)))) for k in range(150)] + [(7, "the of " * 15)] * 9 + [(None, "proof " * 25)] * 2 + [(900, None), (901, ""), (902, "lemma " * 30_000)]
    target = [" ".join(draw.choices(said[4:], k=30)) for _ in range(20)] + [None]
    got = resample.resample(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), share=share).collect()
    assert sorted((tuple(r) for r in got), key=str) == resampled_by_force(rows, target, share)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs(spark, []), none).collect() == []
    rows = [(k, f"w{k} " * 25) for k in range(40)]
    assert sorted((tuple(r) for r in resample.resample(docs(spark, rows), none).collect()), key=str) == resampled_by_force(rows, [])


def test_hot_scores_are_ranked_by_id(spark, monkeypatch):
    """All rows of one weight and, without the hash, of one score."""
    monkeypatch.setattr(resample, "gumbel", lambda column, seed: column * 0)
    rows = [(draw * 7 % 400, "same " * 20) for draw in range(400)]
    got = resample.resample(docs(spark, rows), spark.createDataFrame([("same",)], "text string"), share=10).where("rank is not null").orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(k, k + 1) for k in range(40)]
