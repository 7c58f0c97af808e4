"""Text scoring with a probabilistic suffix tree.

Tokens are the words of a text, A-Z lower-cased, and one end. The tree is over symbols: a word that occurs SYMBOL times or
more is a symbol of its own; the others share CLASSES symbols by a hash of their last two characters.

1. Count all words of the training rows. N tokens, V words.
2. For each depth up to DEPTH: candidate contexts are symbol strings that occur CONTEXT times or more; count what follows
   them. Transitions seen less than TRANSITION times are pooled in a context's rest. The minimum counts are absolute, so
   the tree grows with the corpus; where a share of N is less, in small corpora, that share is the minimum. A context
   backs off only to contexts that end in the same symbol, so the tree falls into slices by that symbol, of about SLICE
   training tokens each: one slice at a time is grown and broadcast, and each further slice is one more pass over the
   symbols. Known everywhere are the symbols; a slice of a single symbol may be larger than SLICE.
3. A candidate s is kept if its next-symbol counts diverge from those of its longest kept suffix p: with n occurrences and
   r retained transitions, n KL(s || p) >= (r + 1) / 2 ln n.
4. Smoothing: P(x | s) = (c(s x) + (rest(s) + b) P(x | p)) / (n + b), b = 3 + 2 r; at the root add-one counts. A word of a
   shared symbol has (c + 1) / (C + V + 1/CLASSES) of it, with C, V the tokens and words of the symbol, so that the root
   alone gives the base score. The symbols of each state sum to one; so do a shared symbol's known words and a share of
   1/CLASSES of the one unknown word. A word that is unknown counts as the whole of that, here as in the base score.
5. Every token is scored in the longest kept suffix state. Words from HEAD of all tokens on, and all symbols, have their counts in the
   broadcast; rarer ones are looked up by a join on the word, summed up by text.

Edge cases: a null or empty text is one end token; copies are scored alike; repeated rows and ids are scored row by row; a
null id trains; without training rows every count is 0 and the base score is that of V = N = 0; an empty table gives an
empty result; other columns are ignored. Different words share a 64-bit code with probability 2^-64.
"""

from __future__ import annotations

import copy
import functools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import checkpoint_dir, cut, runs_of_texts, split_words, stored

HEAD = 2.5e-7
#: Minimum counts, and shares of all tokens that take their place where they are less.
SYMBOL, SYMBOL_SHARE = 1000, 5e-5
CONTEXT, CONTEXT_SHARE = 200, 1e-5
TRANSITION, TRANSITION_SHARE = 4, 2e-7
SLICE = 150_000_000
#: Places in texts whose contexts and next symbols are summed up together; contexts of more places are dealt out.
PART = 1_000_000
#: Transitions whose probabilities the driver looks up at a time.
RUN = 250_000
CLASSES = 256
DEPTH = 3
#: Symbols that are no words: the place before a text, in contexts only.
BEFORE = 0
#: Bits of a symbol, or of a context's number within its slice and depth, in a key.
BITS = 24
#: Marks the keys of longer contexts among those of transitions.
AHEAD = 1 << 60
#: The end token's place in a vocabulary; no word is empty.
END = b""


def least_symbol(tokens: int) -> float:
    return min(SYMBOL, SYMBOL_SHARE * tokens)


def least_head(tokens: int) -> float:
    """Every symbol is in the head."""
    return min(HEAD * tokens, SYMBOL)


class Vocabulary(dict):
    """word -> number, with a code and a class for each number."""

    LIMIT = 300_000

    def __init__(self) -> None:
        super().__init__()
        self.codes: list[int] = []
        self.classes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.codes)
        self.codes.append(xxhash.xxh3_64_intdigest(word))
        self.classes.append(xxhash.xxh32_intdigest(word.decode()[-2:]) % CLASSES if word else 0)
        return n

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts in a row, and how many each has."""
        at, sizes, words = split_words(texts)
        own = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        sizes = sizes + 1
        out = np.full(len(at) + len(sizes), self[END])
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = own[at]
        return out, sizes

    def code_array(self, begin: int = 0) -> np.ndarray:
        return np.array(self.codes[begin:], np.uint64)

    def class_array(self, begin: int = 0) -> np.ndarray:
        return np.array(self.classes[begin:], np.int64)


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether the wanted ones are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _spread(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys in a table of 2^bits."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Finder:
    """Finds (front << BITS | back) among distinct keys: an open-addressing table of their places, at most half full."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, (2 * len(keys)).bit_length())
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, place = np.arange(len(keys), dtype=np.int32), _spread(keys, self.bits)
        while len(left):
            free = self.at[place] < 0
            self.at[place[free]] = left[free]  # of several, one stays
            lost = self.at[place] != left
            left, place = left[lost], (place[lost] + 1) & (len(self.at) - 1)

    def find(self, front: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Places among the keys, -1 where there is none."""
        wanted = (front << BITS) | back
        out = np.full(len(wanted), -1, np.int64)
        left, place = np.arange(len(wanted)), _spread(wanted, self.bits)
        while len(left):
            held = self.at[place]
            some = np.flatnonzero(held >= 0)
            left, place, held = left[some], place[some], held[some]
            found = self.keys[held] == wanted[left]
            out[left[found]] = held[found]
            left, place = left[~found], (place[~found] + 1) & (len(self.at) - 1)
        return out


def _marks(keys: np.ndarray) -> np.ndarray:
    """A filter of at least 8 bits a key."""
    bits = max(6, (8 * len(keys)).bit_length())
    out = np.zeros(1 << bits, bool)
    out[_spread(keys, bits)] = True
    return np.packbits(out, bitorder="little")


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = _spread(keys, len(marks).bit_length() + 2)
    return (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


class Tree:
    """The model, or a slice of it: arrays that go to the executors."""

    def __init__(self, tokens: int, words: int, head: np.ndarray, head_counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray):
        """head: sorted codes of words from least_head on; class_*: of the words that are no symbols of their own."""
        self.tokens, self.words, self.total = tokens, words, tokens + words + 1
        self.head, self.head_counts = head, head_counts
        own = head_counts >= least_symbol(tokens)
        self.symbol_codes = head[own]
        self.n_symbols = 1 + len(self.symbol_codes) + CLASSES
        assert self.n_symbols < 1 << BITS
        self.class_tokens = class_tokens
        self.class_total = class_tokens + class_words + 1 / CLASSES
        root = np.concatenate([[0.0], head_counts[own] + 1.0, self.class_total]) / self.total
        self.root_log = np.log10(np.where(root > 0, root, 1.0))
        self.root = root
        #: by depth - 1: sorted context keys, kept flags, depth of the longest kept suffix, log10 of the backed-off share, sorted transition keys and their log10 probabilities
        self.contexts: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []
        self.suffix: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.moves: list[np.ndarray] = []
        self.move_log: list[np.ndarray] = []
        self.finders: dict[tuple[str, int], Finder] = {}

    def bare(self) -> Tree:
        """Another tree with the same root alone."""
        out = copy.copy(self)
        out.contexts, out.kept, out.suffix, out.back, out.moves, out.move_log, out.finders = [], [], [], [], [], [], {}
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finders": {}}  # built where they are used

    def finder(self, kind: str, depth: int) -> Finder:
        """Of the contexts, or moves, of a depth."""
        if (kind, depth) not in self.finders:
            self.finders[kind, depth] = Finder((self.moves if kind == "moves" else self.contexts)[depth - 1])
        return self.finders[kind, depth]

    def symbols(self, codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        at, there = _look_up(self.symbol_codes, codes)
        return np.where(there, 1 + at, 1 + len(self.symbol_codes) + classes)

    def context_ids(self, symbols: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> list[np.ndarray]:
        """By depth - 1, the number of the context before each of the symbols at the given places (all by default), or -1. first: where texts begin. A context never reaches beyond the place before its text."""
        at = np.arange(len(symbols)) if at is None else at
        place = _places(first)[at]
        out: list[np.ndarray] = []
        for depth in range(1, len(self.contexts) + 1):
            found = np.full(len(at), -1, np.int64)
            if depth == 1:
                found = self.finder("contexts", 1).find(np.int64(0), _before(symbols, place, at, 1))
            else:
                live = np.flatnonzero((out[-1] >= 0) & (place >= depth - 1))
                found[live] = self.finder("contexts", depth).find(_before(symbols, place[live], at[live], depth), out[-1][live])
            out.append(found)
        return out

    def log_probabilities(self, symbols: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Of the symbols at the given places, all by default."""
        ids = self.context_ids(symbols, first, at)
        if at is not None:
            symbols = symbols[at]
        state = np.zeros(len(symbols), np.int8)
        for depth, found in enumerate(ids, 1):
            live = np.flatnonzero(found >= 0)
            state[live[self.kept[depth - 1][found[live]]]] = depth
        out, open_ = np.zeros(len(symbols)), np.ones(len(symbols), bool)
        for depth in range(len(ids), 0, -1):
            here = np.flatnonzero(open_ & (state == depth))
            if not len(here):
                continue
            own = ids[depth - 1][here]
            found = self.finder("moves", depth).find(own, symbols[here])
            there = found >= 0
            out[here[there]] += self.move_log[depth - 1][found[there]]
            open_[here[there]] = False
            left = here[~there]
            out[left] += self.back[depth - 1][own[~there]]
            state[left] = self.suffix[depth - 1][own[~there]]
        rest = np.flatnonzero(open_)
        out[rest] += self.root_log[symbols[rest]]
        return out

    def _probability(self, depth: np.ndarray, ids: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """P(symbol | state) for states given by depth and, by depth - 1, number."""
        out, open_, depth = np.zeros(len(symbols)), np.ones(len(symbols), bool), depth.copy()
        for d in range(len(ids), 0, -1):
            here = np.flatnonzero(open_ & (depth == d))
            own = ids[d - 1][here]
            at, there = _look_up(self.moves[d - 1], (own << BITS) | symbols[here])
            out[here[there]] += self.move_log[d - 1][at[there]]
            open_[here[there]] = False
            out[here[~there]] += self.back[d - 1][own[~there]]
            depth[here[~there]] = self.suffix[d - 1][own[~there]]
        return 10 ** np.where(open_, out + self.root_log[symbols], out)

    def grow(self, keys: np.ndarray, occurrences: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> None:
        """Adds a depth. keys, occurrences: its sorted candidates. moves, counts: sorted transition keys (candidate << BITS | symbol)."""
        depth = len(self.contexts) + 1
        n, owner, symbol = len(keys), moves >> BITS, moves & ((1 << BITS) - 1)
        # by shorter depths, the number of each candidate's suffix
        chain: list[np.ndarray] = []
        below = keys & ((1 << BITS) - 1) if depth > 1 else np.empty(n, np.int64)
        for d in range(depth - 1, 0, -1):
            chain.insert(0, below)
            if d > 1:
                below = self.contexts[d - 1][below] & ((1 << BITS) - 1)
        parent = np.zeros(n, np.int64)
        for d in range(1, depth):
            parent[self.kept[d - 1][chain[d - 1]]] = d
        under = np.empty(len(moves))
        for begin in range(0, len(moves), RUN):
            run = slice(begin, begin + RUN)
            of = owner[run]
            under[run] = self._probability(parent[of], [c[of] for c in chain], symbol[run])
        held = np.bincount(owner, counts, n)
        retained = np.bincount(owner, minlength=n)
        rest = np.maximum(occurrences - held, 0.0)
        left = np.maximum(1.0 - np.bincount(owner, under, n), 1e-12)
        share = counts / occurrences[owner]
        gain = np.bincount(owner, counts * np.log(share / under), n) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / occurrences / left), 0.0)
        kept = gain >= (retained + 1) / 2 * np.log(np.maximum(occurrences, 2))
        prior = 3.0 + 2.0 * retained
        scale = (rest + prior) / (occurrences + prior)
        self.contexts.append(keys)
        self.kept.append(kept)
        self.suffix.append(parent)
        self.back.append(np.log10(scale))
        use = kept[owner]
        self.moves.append(moves[use])
        self.move_log.append(np.log10(counts / (occurrences + prior)[owner] + scale[owner] * under)[use])


def _places(first: np.ndarray) -> np.ndarray:
    """The place of each symbol in its text."""
    begins = np.flatnonzero(first)
    return np.arange(len(first)) - np.repeat(begins, np.diff(np.append(begins, len(first))))


def _before(symbols: np.ndarray, place: np.ndarray, at: np.ndarray, back: int) -> np.ndarray:
    """The symbol so many places before each of those at the given places, BEFORE where that is no place of the text."""
    return np.where(place >= back, symbols[at - back], BEFORE)


def _dealt(occurrences: np.ndarray, parts: int) -> np.ndarray:
    """Of each context, the part that sums up its counts: neighbours go together. -1: key by key, as the context alone would fill a part."""
    alone = occurrences > PART
    sizes = np.where(alone, 0.0, occurrences)
    ends = np.cumsum(sizes)
    return np.where(alone, -1, (ends - sizes) * parts // max(sizes.sum(), 1.0)).astype(np.int32)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, as differences, and their counts, byte by byte: high bytes, mostly zero, lie together and compress well."""
    steps = np.diff(keys, prepend=0)
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes, "zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """size: how many keys there are."""
    planes = np.frombuffer(pa.decompress(packed, 12 * size, "zstd"), np.uint8).reshape(12, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.int64).ravel()), np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel().astype(np.int64)


def _frequent(table: pa.Table, least: float, least_move: float) -> pa.Table:
    """The summed counts of a part's keys, those that reach the minimum."""
    found = [_unpacked(x, n) for x, n in zip(table.column("counts").to_pylist(), table.column("size").to_pylist())]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.bincount(at.ravel(), np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
    use = counts >= np.where(keys >= AHEAD, least, least_move)
    return pa.table({"key": keys[use], "n": counts[use]})


def _first(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes)[:-1]] = True
    out[0] = True
    return out


class _Symbols:
    """A vocabulary with the tree's symbols for its numbers."""

    def __init__(self, tree: Tree):
        self.tree, self.words, self.known = tree, Vocabulary(), np.empty(0, np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers, symbols, sizes."""
        if len(self.words) > Vocabulary.LIMIT:
            self.words, self.known = Vocabulary(), np.empty(0, np.int64)
        numbers, sizes = self.words.numbers(texts)
        new = len(self.known)
        if new < len(self.words):
            self.known = np.concatenate([self.known, self.tree.symbols(self.words.code_array(new), self.words.class_array(new))])
        return numbers, self.known[numbers], sizes


def word_counts(training: DataFrame) -> DataFrame:
    """code, class, c: of every word and of the end, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Vocabulary(), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.code_array().view(np.int64)), pa.array(words.class_array().astype(np.int32)), pa.array(counts)], names=["code", "class", "c"])

        for batch in batches:
            for texts in runs_of_texts(batch.column(0)):
                numbers, _ = words.numbers(texts)
                added = np.bincount(numbers, minlength=len(words))
                added[: len(counts)] += counts
                counts = added
                if len(words) > Vocabulary.LIMIT:
                    yield out()
                    words, counts = Vocabulary(), np.zeros(0, np.int64)
        yield out()

    return stored(training.select("text").mapInArrow(run, "code long, class int, c long").groupBy("code").agg(F.first("class").alias("class"), F.sum("c").alias("c")))


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    found = df.toArrow()
    return [found.column(n).to_numpy(zero_copy_only=False) if found.column(n).type == pa.bool_() else found.column(n).to_numpy() for n in names]


def rooted(counts: DataFrame) -> Tree:
    """A tree of the root alone."""
    tokens, words = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    code, c = _columns(counts.where(F.col("c") >= least_head(tokens)).select("code", "c"), "code", "c")  # at most 1 / HEAD rows, and all symbols
    code = code.view(np.uint64)
    order = np.argsort(code)
    shared = counts.where(F.col("c") < least_symbol(tokens)).groupBy("class").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("w"))
    kind, t, w = _columns(shared, "class", "t", "w")  # at most CLASSES rows
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    class_tokens[kind], class_words[kind] = t, w
    return Tree(tokens, words, code[order], c[order], class_tokens, class_words)


def _sequences(column: pa.Array, kind: str, limit: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols of texts in a row, and where texts begin, in runs of about `limit` tokens. kind: the type of the symbols in the column."""
    run, size, width = [], 0, np.dtype(kind).itemsize
    for x in column.to_pylist():
        run.append(x)
        size += len(x) // width
        if size >= limit:
            yield np.frombuffer(b"".join(run), kind).astype(np.int64), _first(np.array([len(r) // width for r in run]))
            run, size = [], 0
    if run:
        yield np.frombuffer(b"".join(run), kind).astype(np.int64), _first(np.array([len(r) // width for r in run]))


def _occurrences(tree: Tree, texts: int) -> np.ndarray:
    """Of each symbol in the training rows, the place before a text included."""
    own = tree.head_counts[tree.head_counts >= least_symbol(tree.tokens)]
    return np.concatenate([[float(texts)], own, tree.class_tokens])


def slices(tree: Tree, texts: int) -> list[np.ndarray]:
    """Whether each symbol is in a slice: runs of about SLICE tokens at most."""
    occurrences = _occurrences(tree, texts)
    of, size, k = np.zeros(len(occurrences), np.int64), 0.0, 0
    for symbol, n in enumerate(occurrences.tolist()):
        if size and size + n > SLICE:
            size, k = 0.0, k + 1
        of[symbol], size = k, size + n
    return [of == x for x in range(k + 1)]


def grown(tree: Tree, training: DataFrame, depth: int = DEPTH, own: np.ndarray | None = None, kind: str = "u4") -> Tree:
    """The tree with its contexts. training: symbols, those of each training text, of a numpy type. own: the symbols that contexts may end in, all by default.

    A transition of a context is no more frequent than that of the context's suffix. So only what follows a context as a
    transition that its suffix retained is counted; the others would be pooled in any case.
    """
    session, tokens = training.sparkSession, tree.tokens
    least = max(min(CONTEXT, CONTEXT_SHARE * tokens), 2.0)
    least_move = max(min(TRANSITION, TRANSITION_SHARE * tokens), 1.0)
    keys = np.arange(tree.n_symbols, dtype=np.int64)
    occurrences = _occurrences(tree, training.count())
    whole = own is None or bool(own.all())
    marks = None
    for d in range(1, depth + 1):
        use = occurrences >= least
        if d == 1:  # the end is no context: nothing follows it
            end = int(tree.symbols(np.array([xxhash.xxh3_64_intdigest(END)], np.uint64), np.zeros(1, np.int64))[0])
            if end <= len(tree.symbol_codes):
                use[end] = False
            if own is not None:
                use &= own
        keys, occurrences = keys[use], occurrences[use].astype(np.float64)
        assert len(keys) < 1 << BITS
        # a part's counts are summed up in one task: each is of PART places in the texts on average, whatever the slice
        parts = int(occurrences.sum()) // PART + 1
        sent = session.sparkContext.broadcast((tree.contexts, keys, _dealt(occurrences, parts), marks, None if whole else own))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, parts=parts, longer=d < depth and not whole) -> Iterator[pa.RecordBatch]:
            """What follows a candidate, and, with `ahead`, what stands before it."""
            known, candidates, dealt, marks, mine = sent.value
            probe = Tree.__new__(Tree)
            probe.contexts, probe.finders = [*known, candidates], {}
            waiting: list[np.ndarray] = []
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                if waiting:
                    k, n = np.unique(np.concatenate(waiting), return_counts=True)
                    waiting.clear()
                    of = dealt[np.where(k >= AHEAD, k & ((1 << BITS) - 1), k >> BITS & ((1 << BITS) - 1))].astype(np.int64)
                    of[of < 0] = _spread(k[of < 0], 32) % parts
                    order = np.argsort(of.astype(np.uint16) if parts < 1 << 16 else of, kind="stable")
                    held, begins = np.unique(of[order], return_index=True)
                    runs = np.split(order, begins[1:])
                    blobs = [_packed(k[at], n[at]) for at in runs]
                    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(map(len, runs), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "size", "counts"])

            for batch in batches:
                for symbols, first in _sequences(batch.column(0), kind):
                    place, at = _places(first), None
                    if mine is not None:
                        at = np.flatnonzero(mine[_before(symbols, place, np.arange(len(symbols)), 1)])
                        place = place[at]
                    ids = probe.context_ids(symbols, first, at)
                    met = np.flatnonzero(ids[-1] >= 0)
                    at, found = met if at is None else at[met], ids[-1][met]
                    following = symbols[at]
                    if longer:
                        beyond = place[met] < len(ids)
                        waiting.append((AHEAD | (_before(symbols, place[met], at, len(ids) + 1) << BITS) | found)[~beyond])
                    if marks is not None:
                        seen = _marked(marks, (ids[-2][met] << BITS) | following)
                        found, following = found[seen], following[seen]
                    waiting.append((found << BITS) | following)
                    size += len(found)
                    if size > 2_000_000:
                        yield from out()
                        size = 0
            yield from out()

        counted = training.select("symbols").mapInArrow(run, "part int, size int, counts binary").groupBy("part").applyInArrow(lambda table: _frequent(table, least, least_move), "key long, n long")
        key, n = _columns(counted, "key", "n")
        order = np.argsort(key)
        ahead = key[order] >= AHEAD
        moves, longer = order[~ahead], order[ahead]
        tree.grow(keys, occurrences, key[moves], n[moves].astype(np.float64))
        sent.destroy()
        marks = _marks(key[moves]) if least_move > 1 else None
        # contexts of the next depth: one more symbol in front of a candidate. Of a slice they are counted as such; in a
        # whole tree they are also what this depth has as context and next symbol, if their suffix is a candidate.
        if whole and d < depth:
            longer = moves[n[moves] >= least]
            strings = [*_unrolled(tree, d, key[longer] >> BITS), key[longer] & ((1 << BITS) - 1)]
            suffix, there = _look_up(tree.contexts[0], strings[-1])
            for k in range(2, d + 1):
                suffix, ok = _look_up(tree.contexts[k - 1], (strings[-k] << BITS) | suffix)
                there = there & ok
            keys, occurrences = ((strings[0] << BITS) | suffix)[there], n[longer][there].astype(np.float64)
            order = np.argsort(keys)
            keys, occurrences = keys[order], occurrences[order]
        else:
            keys, occurrences = key[longer] & ~AHEAD, n[longer].astype(np.float64)
        if not len(keys):
            break
    return tree


def _unrolled(tree: Tree, depth: int, ids: np.ndarray) -> list[np.ndarray]:
    """The symbols of contexts of a depth, first symbol first."""
    out = []
    for d in range(depth, 1, -1):
        key = tree.contexts[d - 1][ids]
        out.append(key >> BITS)
        ids = key & ((1 << BITS) - 1)
    out.append(tree.contexts[0][ids])
    return out


def score(docs: DataFrame, held_out: F.Column, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Rows for which held_out is true don't train."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = word_counts(rows.where(~F.col("held_out")))
    tree = rooted(counts)
    symbol_kind = "u2" if tree.n_symbols <= 1 << 16 else "u4"
    sent = docs.sparkSession.sparkContext.broadcast(tree)
    kind, id_type = docs.schema[id_column].dataType.simpleString(), to_arrow_type(docs.schema[id_column].dataType)
    layout = f"id {kind}, held_out boolean, text_code long, n_tokens long, n_head long, base double, model double, symbols binary, code long, times int, sent int"
    types = [id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in layout.split(", ")]

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(columns["text_code"])
        return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with its symbols, without `code`; and one for each text and word that is not in the head."""
        own = sent.value
        reader, seen = _Symbols(own), set()
        head_log = np.log10(np.append(own.head_counts + 1.0, 1.0))
        class_log = np.log10(np.concatenate([np.ones(1 + len(own.symbol_codes)), own.class_total]))
        for batch in batches:
            at = 0
            for texts in runs_of_texts(batch.column(1)):
                numbers, symbols, sizes = reader.of(texts)
                begins, n = np.cumsum(sizes) - sizes, len(texts)
                codes = reader.words.code_array()
                place, in_head = _look_up(own.head, codes)
                head = head_log[np.where(in_head, place, len(own.head))]
                known = in_head[numbers]
                text_codes = np.array([xxhash.xxh3_64_intdigest(t or b"") - 2**63 for t in texts.cast(pa.binary()).to_pylist()], np.int64)
                counted = head[numbers]
                # of a shared symbol: the word's count over the symbol's; the count of a word beyond the head is added later
                of_symbol = np.add.reduceat(np.where(symbols > len(own.symbol_codes), counted - class_log[symbols], 0.0), begins)
                heads = np.add.reduceat(known.astype(np.int64), begins)
                base = np.add.reduceat(counted, begins) - heads * math.log10(own.total)
                short = symbols.astype(symbol_kind)
                packed = pa.array([short[b : b + k].tobytes() for b, k in zip(begins, sizes)], pa.binary())
                yield rows_of(id=batch.column(0).slice(at, n), held_out=batch.column(2).slice(at, n), text_code=text_codes, n_tokens=sizes, n_head=heads, base=base, model=of_symbol, symbols=packed)
                at += n
                new = np.zeros(n, bool)
                for k, code in enumerate(text_codes.tolist()):
                    if code not in seen:
                        seen.add(code)
                        new[k] = True
                tail = np.flatnonzero(~known & np.repeat(new, sizes))
                if len(tail):
                    key, times = np.unique(np.repeat(np.arange(n), sizes)[tail] * len(codes) + numbers[tail], return_counts=True)
                    of_text, word = key // len(codes), key % len(codes)
                    yield rows_of(text_code=text_codes[of_text], code=codes[word].view(np.int64), times=times.astype(np.int32), sent=np.append(1, np.diff(of_text) != 0).astype(np.int32))
                if len(seen) > 500_000:
                    seen.clear()

    path = f"{checkpoint_dir(docs.sparkSession)}/scores-{uuid.uuid4()}"
    rows.mapInArrow(run, layout).write.parquet(path)
    made = docs.sparkSession.read.schema(layout).parquet(path)
    texts = made.where("code is null")
    training = texts.where("not held_out").select("symbols")
    parts = slices(tree, training.count())

    def scoring(own: np.ndarray, to: Callable) -> tuple[Callable, Broadcast]:
        """The scores of what follows the symbols of a slice, handed to a function of batch and scores; and the slice."""
        whole = docs.sparkSession.sparkContext.broadcast((grown(tree.bare(), training, depth, own, symbol_kind), None if own.all() else own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grown_tree, mine = whole.value
            for batch in batches:
                found = []
                for symbols, first in _sequences(batch.column(7), symbol_kind):
                    at, logs = None, np.zeros(len(symbols))
                    if mine is not None:
                        at = np.flatnonzero(mine[_before(symbols, _places(first), np.arange(len(symbols)), 1)])
                    logs[slice(None) if at is None else at] = grown_tree.log_probabilities(symbols, first, at)
                    found.append(np.add.reduceat(logs, np.flatnonzero(first)))
                yield to(batch, np.concatenate(found) if found else np.empty(0))

        return run, whole

    def first_slice(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(scores + batch.column(6).to_numpy())], names=batch.schema.names[:7])

    def further(batch: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(scores)], names=["text_code", "further"])

    scored, _ = scoring(parts[0], first_slice)
    others = []
    for own in parts[1:]:
        run_further, whole = scoring(own, further)
        others.append(cut(texts.select(*names[:8]).mapInArrow(run_further, "text_code long, further double")))
        whole.destroy()
    local = texts.select(*names[:8]).mapInArrow(scored, ", ".join(layout.split(", ")[:7]))
    tails = made.where("code is not null").select("text_code", "code", "times", "sent")
    looked_up = tails.join(counts.where(F.col("c") < least_head(tree.tokens)).select("code", "c"), "code", "left")
    times, c = F.col("times"), F.coalesce(F.col("c"), F.lit(0))
    sums = {"tail_log": F.sum(times * F.log10(c + 1)), "tail_known": F.sum(F.when(c > 0, times).otherwise(0)), "tail_n": F.sum(times)}
    # a task sends a text once; copies in other tasks are sent again, and divided out
    summed = looked_up.groupBy("text_code").agg(*[(x / F.sum("sent")).alias(name) for name, x in sums.items()])
    joined = local.join(summed, "text_code", "left")
    if others:  # a row of each copy of a text from each slice
        rest = functools.reduce(DataFrame.union, others).groupBy("text_code").agg((F.sum("further") * len(others) / F.count(F.lit(1))).alias("further"))
        joined = joined.join(rest, "text_code", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return joined.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_head") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_log") - zero("tail_n") * math.log10(tree.total)).alias("base_score"),
        (F.col("model") + zero("tail_log") + (zero("further") if others else 0)).alias("score"),
    )
