"""Alignment of two tokenizers: against the libraries and every pair of byte ranges."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import align

DOCS = "doc_id long, text string, row int, pairs int, id string, n_a int"
A = Tokenizer.from_file(public_tokenizers.path(align.A_FILE))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_FILE))
ENTRY = {i: e for e, i in A.get_vocab().items()}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], DOCS)


def by_force(rows):
    """Every column, by all pairs of tokens of whole texts."""
    made, held = [], collections.Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
        raw_a, raw_b = [align.byte_level(ENTRY[x]) for x in a], [align.piece_bytes(B.id_to_piece(x)) for x in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            made.append((i, [], [], [], []))
            continue
        spans = [[(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))] for raw in (raw_a, raw_b)]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for begin, end in zip([0, *ends], ends):
            groups.append([[x for x, (s, e) in zip(ids, of) if begin <= s and e <= end] for ids, of in zip((a, b), spans)])
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, f) in zip(b, spans[1]) if max(s, t) < min(e, f)]
        held.update(set(links))
        made.append((i, a, b, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups, links in made:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a\n", "\n\na", "a  b \n c\t\td", "It's the <|endoftext|> and <s>that</s>", "▁mark", "a ▁ b", "naïve Straße 日本語 🙂👍🏽 é", "a\x00b\x1c c", "x y  z 　 w", "\r\n x\r\ny \v\f",
    "tokenisation unbelievably counterrevolutionary", "    if x == 1:\n\treturn  y", "1234567890 12,345.67", "ﬁne é ｆｕｌｌ", "ab" * 300,
]


def texts():
    draw = random.Random(2)
    alphabet = [*"abcdefg EATon's  \n\t.,<>é日🙂1", " the", " of", "ing", "tion", " ", "\x1d", "<s>", "\r"]
    return [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, "".join(draw.choices(alphabet, k=draw.randint(0, 60)))) for k in range(250)] + [(1, "a"), (1, "a"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("bounds", [(align.SLICE, align.BROADCAST, align.Aligner.REMEMBERED), (7, 40, 20), (7, 0, 20)])
def test_alignment_equals_brute_force(spark, monkeypatch, bounds):
    """Also in small slices, with hardly anything remembered, and with rare or all pairs joined by a shuffle."""
    monkeypatch.setattr(align, "SLICE", bounds[0])
    monkeypatch.setattr(align, "BROADCAST", bounds[1])
    monkeypatch.setattr(align.Aligner, "REMEMBERED", bounds[2])
    rows = texts()
    found = align.align(docs(spark, rows))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_force(rows)


def test_whole_texts_align_like_parts():
    """Cuts change nothing: one part for a text gives the same groups and pairs."""
    tool = align.aligner(align.A_FILE, align.B_FILE)
    assert tool.usable
    whole = align.Aligner(public_tokenizers.path(align.A_FILE), public_tokenizers.path(align.B_FILE))
    whole.usable = False
    for _, text in texts():
        if text:
            (n, said, keys, times), (m, told, others, count) = align._aligned(tool, tool.parts(text)), align._aligned(whole, whole.parts(text))
            assert (n, said, keys.tolist(), times.tolist()) == (m, told, others.tolist(), count.tolist()), text


def test_long_texts_come_in_slices(spark):
    text = " ".join(f"word{k % 977}" for k in range(400_000))
    tool = align.aligner(align.A_FILE, align.B_FILE)
    assert len(list(tool.parts(text))) == 2
    n, said, _, _ = align._aligned(tool, tool.parts(text))
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    assert n[:2] == [len(a), len(b)] and len(said) == 64
    assert align._aligned(tool, tool.parts("x " * 10))[0][2] == 11


def test_transitions_depend_on_suffix_and_token():
    made = align.Transducer([b"ab", b"c", b"d"], [b"a", b"bc", b"cd"])
    assert made.align([0, 1], [0, 1]) == (["0,1|0,1"], [0 << align.BITS | 0, 0 << align.BITS | 1, 1 << align.BITS | 1])
    assert [set(x) for x in made.states] == [{b"ab", b"b"}, {b"c"}] and len(made.moves) == 4
    assert made.align([0, 1], [0, 1])[1] and len(made.moves) == 4
    assert made.align([0], [0]) is None and made.align([0, 2], [0, 1]) is None and made.align([], []) == ([], [])


def test_alignment_of_nothing(spark):
    assert align.align(docs(spark, [])).collect() == []
