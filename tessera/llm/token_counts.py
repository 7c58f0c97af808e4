"""Token counts with a whole-token shortcut.

Offline, once per worker, the vocabulary is examined:

* cuts: a merge can only build a vocabulary string, so no merge crosses a place that no vocabulary string crosses.
  `provable_cuts` checks that no string has the space mark after another character, and which control characters occur
  in no longer string; texts are cut there into pre-tokens.
* whole tokens: the strings that the library, given the string alone, encodes as one token.

A pre-token among the whole tokens counts as one without any merging; only the others go through the library's merges,
remembered up to a bound. Texts without provable cuts are encoded whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; white space, strings such as "<s>" and characters outside the
vocabulary count as the library counts them; rows are independent, so repeated rows repeat; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def provable_cuts(pieces: list[str]) -> tuple[bool, str]:
    """Whether a cut before each run of marks is safe, and the control characters around which cuts are safe."""
    before_mark = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)
    inside_longer = set().union(*(set(piece) for piece in pieces if len(piece) > 1))
    return before_mark, "".join(c for c in "\t\n\v\f\r" if c not in inside_longer)


class Counter(dict):
    """Pre-token -> number of tokens. Starts with the whole tokens, merges the rest on demand, forgets beyond a bound."""

    REMEMBERED = 400_000

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        self.by_mark, self.single = provable_cuts(pieces)
        # A control character that is no piece itself is spelt in bytes, the same in every context.
        self.lead = next(iter(self.single), "")
        self.usable = self.by_mark and bool(self.lead) and self._plain()
        if self.usable:
            self.pattern = re.compile(f"{MARK}*[^{MARK}{self.single}]+|{MARK}+|[{self.single}]")
            self.lead_cost = len(self.library.encode(self.lead))
            self.whole = {piece: 1 for piece in pieces if self._merged(piece) == 1}
            self.update(self.whole)

    def _plain(self) -> bool:
        """The library adds one mark in front, keeps all spaces and rewrites nothing else."""
        return [self.library.decode(self.library.encode(t)) for t in ("a  b ", "ﬁ é")] == ["a  b ", "ﬁ é"] and self.library.encode("a", out_type=str)[0].startswith(MARK)

    def _merged(self, piece: str) -> int:
        if piece.startswith(MARK):
            return len(self.library.encode(piece[1:])) if len(piece) > 1 else 1
        return len(self.library.encode(self.lead + piece)) - self.lead_cost

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.REMEMBERED:
            self.clear()
            self.update(self.whole)
        # A run of marks with nothing after it: the mark in front that the library adds is one of them.
        value = self[piece] = self._merged(piece)
        return value

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.usable:
            return len(self.library.encode(text))
        text = MARK + text.replace(" ", MARK)
        if len(text) < 1_000_000:
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        total, found = 0, self.pattern.finditer(text)
        while part := [m[0] for m in islice(found, 100_000)]:
            total += sum(map(self.__getitem__, part))
        return total


@lru_cache(1)
def counter(model: str) -> Counter:
    import os

    if not os.path.isabs(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    return Counter(model)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. `model`: a file name of the tokenizer package, or an absolute path present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, n_bytes long, n_tokens long, over_limit boolean")
