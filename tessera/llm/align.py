"""Alignment of two tokenizers' tokens on the same bytes, by a transducer on the dangling suffix.

A state is which side leads and the bytes of its last token that the other side has not reached yet. The side behind takes
its next token; the new state depends on the state and that token alone and is remembered. Where the suffix is empty, both
sides end together and a group closes. Two tokens overlap exactly if one is taken while the other's suffix dangles, so
every step from a state with a suffix is a link.

A text is cut where both vocabularies provably begin a new token: in front of a space, or a control character that no longer
piece of B holds, behind a character that is no white space. A's pattern ends a token there, since none of its
alternatives has white space behind other characters; no merge of B crosses it (`token_counts.provable_cuts`). There the
suffix is empty, so the path over such a part, its groups and links, is remembered as a whole, up to a bound, and most
text costs a look-up. If cuts cannot be proved, texts are aligned whole.

What a pair of ids counts, the rows that hold it linked, comes from a stored table of each row's distinct pairs and how often
they occur in it. Pairs and counts go back to the rows by a join: those of the highest counts, BROADCAST pairs at most, are
broadcast; the others, if any, are joined by a shuffle, in which no pair is hot, since hot ones were broadcast.

Edge cases: a text that is null, empty, or not what the joined bytes of either side spell (B spells its mark as a space, so a
text that holds the mark itself) has no tokens: zeros, and '' for its groups; strings of special tokens are plain text; rows
with equal or null ids are rows of their own; an empty table gives an empty result; other columns are ignored. A part between
two cuts is held in memory whole; texts are taken in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import runs_of_texts, stored
from tessera.llm.token_counts import MARK, provable_cuts

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: An id of B has that many bits in a pair; either id has that many in a transition.
BITS, TOKEN_BITS = 15, 17
#: Pairs that travel to all executors, 17 bytes each.
BROADCAST = 1 << 21
#: Parts that are looked up at once; parts that A encodes at once.
SLICE, JOINED = 200_000, 100


class Transducer:
    """States are numbers; 0 has no suffix. A state leads for A (1), B (2) or none (0). A transition's key is state and token in one number."""

    REMEMBERED = 1_000_000

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.said = tuple([str(k) for k in range(len(x))] for x in self.bytes)
        self.forget()

    def forget(self) -> None:
        self.states: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        self.leads: list[int] = [0]
        self.suffix: list[bytes] = [b""]
        self.moves: dict[int, int] = {}

    def _state(self, lead: int, suffix: bytes) -> int:
        if not suffix:
            return 0
        known = self.states[lead - 1]
        state = known.get(suffix)
        if state is None:
            state = known[suffix] = len(self.leads)
            self.leads.append(lead)
            self.suffix.append(suffix)
        return state

    def _moved(self, state: int, token: int) -> int:
        """The state after the side behind (A, if none leads) has taken a token; -1 if its bytes are not those that dangle."""
        lead, suffix = self.leads[state], self.suffix[state]
        own = 2 if lead == 1 else 1
        new = self.bytes[own - 1][token]
        if suffix.startswith(new):
            return self._state(lead, suffix[len(new) :])
        return self._state(own, new[len(suffix) :]) if new.startswith(suffix) else -1

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """The groups as text, and the links as pairs of ids in one number; None if the bytes differ."""
        moves, leads = self.moves, self.leads
        said_a, said_b = self.said
        groups, links, of_a, of_b = [], [], [], []
        state = i = j = last_a = last_b = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            if leads[state] == 1:
                if j == m:
                    return None
                token = last_b = b[j]
                links.append(last_a << BITS | token)
                of_b.append(said_b[token])
                j += 1
            else:
                if i == n:
                    return None
                token = last_a = a[i]
                if state:
                    links.append(token << BITS | last_b)
                of_a.append(said_a[token])
                i += 1
            key = state << TOKEN_BITS | token
            state = moves.get(key, -2)
            if state == -2:
                state = moves[key] = self._moved(key >> TOKEN_BITS, token)
            if state < 0:
                return None
            if not state:
                groups.append(f"{','.join(of_a)}|{','.join(of_b)}")
                of_a, of_b = [], []
        return (groups, links) if not state else None


def byte_level(entry: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on, in order."""
    return bytes(map(BYTE_OF.__getitem__, entry))


PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace(MARK, " ").encode()


class Aligner:
    """Parts of texts, numbered as they are met: their counts, groups and pairs."""

    REMEMBERED = 300_000

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n = self.b.get_piece_size()
        if n > 1 << BITS or self.a.get_vocab_size() > 1 << min(31 - BITS, TOKEN_BITS):
            raise ValueError("a vocabulary is too large for pairs of 31 bits")
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        entries = self.a.get_vocab(with_added_tokens=False)
        of_a = [b""] * self.a.get_vocab_size()
        for entry, i in entries.items():
            of_a[i] = byte_level(entry)
        self.transducer = Transducer(of_a, [piece_bytes(p) for p in pieces])
        self.a_sizes = np.fromiter(map(len, of_a), np.int64, len(of_a))
        by_mark, single = provable_cuts([p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_byte(i) or self.b.is_unknown(i))])
        self.mark = [i for i in (self.b.piece_to_id(MARK),) if pieces[i] == MARK]
        self.usable = by_mark and bool(self.mark) and self._plain_a(a_file) and self.b.encode("a", out_type=str)[0].startswith(MARK)
        cut = " " + single
        self.pattern = re.compile(rf"[\s\S][^{cut}]*(?:(?<=[\s{MARK}])[{cut}][^{cut}]*)*")
        self.clear()

    @staticmethod
    def _plain_a(a_file: str) -> bool:
        """A is byte-level with the pattern that this library builds in, and rewrites no text before."""
        with open(a_file, encoding="utf-8") as file:
            said = json.load(file)
        before = said.get("pre_tokenizer") or {}
        return said.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether bytes differ
        self.ends = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def parts(self, text: str) -> Iterator[list[str]]:
        """A space and the text, in parts, SLICE at a time."""
        if not self.usable:
            yield [" " + text]
        elif len(text) < 10 * SLICE:
            yield self.pattern.findall(" " + text)
        else:
            found = self.pattern.finditer(" " + text)
            while some := [m[0] for m in islice(found, SLICE)]:
                yield some

    def _b_ids(self, parts: list[str]) -> list[list[int]]:
        """B puts its mark in front of what it is given: it is the space with which a part begins, or one too many."""
        ids = self.b.encode([p.removeprefix(" ") for p in parts], num_threads=1)
        return [self.mark if p == " " else x if p[0] == " " else x[1:] for p, x in zip(parts, ids)]

    def forget(self) -> None:
        """Beyond a bound, numbers given so far are given up."""
        if len(self.places) > self.REMEMBERED:
            self.clear()

    def _a_ids(self, parts: list[str]) -> list[list[int]]:
        """A's ids of each part. Parts begin where a token does, behind whatever ends with another character than white space: so they are encoded JOINED at once, and told apart by their bytes."""
        out: list[list[int]] = [[]] * len(parts)
        joined = [k for k, p in enumerate(parts) if self.usable and not p[-1].isspace()]
        alone = sorted(set(range(len(parts))) - set(joined))
        sizes = self.a_sizes
        runs = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
        for run, found in zip(runs, self.a.encode_batch_fast(["".join([parts[k] for k in run]) for run in runs], add_special_tokens=False)):
            ids = found.ids
            ends = np.cumsum(sizes[ids])
            want = np.cumsum([len(parts[k].encode()) for k in run])
            cut = np.searchsorted(ends, want)
            if ends[-1] != want[-1] or (ends[cut] != want).any():  # not what the proof says: each by itself
                alone += run
                continue
            begin = 0
            for k, end in zip(run, (cut + 1).tolist()):
                out[k] = ids[begin:end]
                begin = end
        for k, found in zip(alone, self.a.encode_batch_fast([parts[k] for k in alone], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def learn(self, parts: Iterable[str]) -> None:
        """Gives numbers to parts."""
        places = self.places
        new = [p for p in dict.fromkeys(parts) if p not in places]
        if not new:
            return
        if len(self.transducer.moves) > Transducer.REMEMBERED:
            self.transducer.forget()
        align, bytes_a = self.transducer.align, self.transducer.bytes[0].__getitem__
        sizes, pairs, ends = [], [], []
        for p, a, b in zip(new, self._a_ids(new), self._b_ids(new)):
            # A spells the part, and B what A spells
            found = align(a, b) if b"".join(map(bytes_a, a)) == p.encode() else None
            if found is None:
                sizes += 0, 0, 0, 0, 1
                self.groups.append("")
            else:
                groups, links = found
                sizes += len(a), len(b), len(groups), len(links), 0
                pairs += links
                self.groups.append(";".join(groups))
            ends.append(len(pairs))
            places[p] = len(places)
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64).reshape(-1, 5)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.array(ends, np.int64)])
        self.pairs = np.concatenate([self.pairs, np.array(pairs, np.int64)])

    def linked(self, at: np.ndarray) -> np.ndarray:
        """The pairs of parts, one part's after the other's."""
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.pairs[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


@lru_cache(2)
def aligner(a_file: str, b_file: str) -> Aligner:
    import public_tokenizers

    return Aligner(*(f if os.path.isabs(f) else public_tokenizers.path(f) for f in (a_file, b_file)))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(times, begin) if len(begin) else times


def _aligned(tool: Aligner, slices: Iterable[list[str]], known: bool = False) -> tuple[list[int], str, np.ndarray, np.ndarray]:
    """Counts, hash, distinct pairs and how often they are linked, of one text in slices of parts. known: whether the parts have been learnt."""
    total, said, keys, times = np.zeros(5, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k, parts in enumerate(slices):
        if not known:
            if k:
                tool.forget()
            tool.learn(parts)
        places = list(map(tool.places.__getitem__, parts))
        at = np.array(places, np.int64)
        total += tool.sizes[at].sum(axis=0)
        said.update((";" * bool(k) + ";".join(map(tool.groups.__getitem__, places))).encode())
        pairs = tool.linked(at)
        keys, times = _summed(np.concatenate([keys, pairs]), np.concatenate([times, np.ones(len(pairs), np.int64)]))
    if total[4] or not total[0]:
        return [0] * 4, "", keys[:0], times[:0]
    return total[:4].tolist(), said.hexdigest(), keys, times


def align_rows(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """docs: an id and a text. The id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every row."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_file, b_file)
        for batch in batches:
            done = 0
            for texts in runs_of_texts(batch.column(1)):
                counts, hashes, pairs, times = [], [], [], []
                tool.forget()
                cut = [tool.parts(t) if t else () for t in texts.to_pylist()]
                if together := len(cut) > 1:  # texts of a run are short enough to be cut and looked up together
                    cut = [list(x) for x in cut]
                    tool.learn(chain.from_iterable(chain.from_iterable(cut)))
                for slices in cut:
                    n, said, keys, count = _aligned(tool, slices, together)
                    counts.append(n)
                    hashes.append(said)
                    pairs.append(np.asarray(keys, np.int32))
                    times.append(np.asarray(count, np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, x[0].dtype), *x]))) for x in (pairs, times)]
                columns = [pa.array(x, pa.int64()) for x in zip(*counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *columns, pa.array(hashes), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                done += len(texts)

    return docs.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (of the rows that hold it linked), best (whether it is the highest of its A id)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    # an id of A has at most as many pairs as B has ids
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", BITS))))


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    aligned = stored(align_rows(rows, a_file, b_file).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(aligned))
    size = F.floor(F.log2("count")).cast("int").alias("size")
    left, least = BROADCAST, 0
    for r in sorted(counts.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["size"]):  # a row for each power of two
        left -= r["n"]
        if left < 0:
            least = 2 << r["size"]
            break
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    found = links.join(F.broadcast(counts.where(F.col("count") >= least)), "pair", "left" if least else "inner")
    if least:
        rare = found.where(F.col("count").isNull()).select("row", "pair", "times").join(counts.where(F.col("count") < least), "pair")
        found = found.where(F.col("count").isNotNull()).select("row", "times", "count", "best").unionByName(rare.select("row", "times", "count", "best"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
