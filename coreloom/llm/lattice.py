"""Subword-lattice language model.

An existing vocabulary's pieces, weighted by unigram scores, span a lattice over each word; the forward recursion in
log space sums over all its segmentations, and the sums of all words and of the text's end make the marginal
probability of the text. The vocabulary's own scores (ranks) are where the weights start; the training documents'
words then re-estimate them by expected counts, so that the model follows the corpus it is given. Pieces are never
added or removed: the tokenizer isn't trained.

A null text is empty: the end alone. A null doc_id counts as the empty text for the split. Repeated rows are scored
row by row, and all train. Very long words go through the same recursion, linear in their length. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The end of a text, as a word and as a piece. No word is empty.
END = b""
MARK = "▁"
#: The words that most training text is made of: their counts and scores are sent to every task, those of other words
#: joined. A fixed number, whatever the corpus; it decides the way, not the result.
COMMON = 50_000
#: Words of more bytes aren't sent, but joined. Memory only.
COMMON_BYTES = 64
#: Words that a task counts before it hands them on.
MEMORY = 100_000
#: Words of one length that go through the lattice side by side, and bytes beyond which a word goes alone.
SIDE_BY_SIDE, LONG = 4096, 48
ROUNDS = 2
LOG10 = math.log(10)


def load_vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """Piece -> log weight from the vocabulary's rank. Word-start marks become a space; byte pieces cover the rest."""
    import sentencepiece

    if not Path(path).exists():
        raise FileNotFoundError(f"no vocabulary at {path}")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            piece = bytes([int(model.id_to_piece(i)[3:5], 16)])
        elif model.is_control(i) or model.is_unknown(i):
            continue
        else:
            piece = model.id_to_piece(i).replace(MARK, " ").encode()
            if b" " in piece[1:] or piece != piece.lower():  # spans words, or holds letters that lower-casing leaves none of
                continue
        pieces[piece] = max(pieces.get(piece, -math.inf), -math.log(2.0 + i))  # Zipf's law over ranks
    pieces.setdefault(b" ", -math.log(2.0 + len(pieces)))
    pieces[END] = -math.log(2.0)
    return normalised(pieces)


def normalised(pieces: dict[bytes, float]) -> dict[bytes, float]:
    total = math.log(math.fsum(math.exp(v) for v in pieces.values()))
    return {k: v - total for k, v in pieces.items()}


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def forward(word: bytes, pieces: dict[bytes, float], longest: int) -> list[float]:
    """alpha[i]: log probability of the word's first i bytes (with the space before it), over all segmentations."""
    text = b" " + word
    alpha = [0.0] + [-math.inf] * len(text)
    get = pieces.get
    for j in range(1, len(text) + 1):
        terms = [alpha[i] + s for i in range(max(0, j - longest), j) if (s := get(text[i:j])) is not None and alpha[i] > -math.inf]
        if terms:
            top = max(terms)
            alpha[j] = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
    return alpha


def log_prob(word: bytes, pieces: dict[bytes, float], longest: int) -> float:
    return pieces[END] if word == END else forward(word, pieces, longest)[-1]


def expected(word: bytes, count: float, pieces: dict[bytes, float], longest: int, into: dict[bytes, float]) -> None:
    """Adds the expected number of times that each piece is used in `count` occurrences of the word."""
    if word == END:
        into[END] = into.get(END, 0.0) + count
        return
    text, alpha = b" " + word, forward(word, pieces, longest)
    n, total = len(text), alpha[-1]
    beta = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, min(n, i + longest) + 1):
            if (s := pieces.get(text[i:j])) is not None and beta[j] > -math.inf:
                through = s + beta[j]
                beta[i] = _add(beta[i], through)
                share = math.exp(min(0.0, alpha[i] + through - total))
                if share > 1e-9:
                    into[text[i:j]] = into.get(text[i:j], 0.0) + count * share


class Lattice:
    """The forward and backward recursions for many words at once: words of one length are the rows of a matrix, and
    the pieces between two of its columns are found by a rolling hash."""

    BASE, SPREAD, BITS = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.names = pieces, list(pieces)
        self.scores = np.array([*pieces.values(), -math.inf])  # the last is that of no piece
        self.longest = max(map(len, pieces))
        self.powers = np.array([pow(int(self.BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        size = 1 << self.BITS
        self.keys, self.ids, self.probes = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 1
        for at, piece in enumerate(self.names):
            if piece == END:
                continue
            h = np.uint64(self.hash(piece))
            slot, tries = int(self.slot(np.array([h], np.uint64))[0]), 1
            while self.ids[slot] >= 0:
                slot, tries = (slot + 1) % size, tries + 1
            self.keys[slot], self.ids[slot], self.probes = h, at, max(self.probes, tries)

    def hash(self, piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + c + 1) & ((1 << 64) - 1)
        return h

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h * self.SPREAD >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash's piece; -1 for none."""
        slot = self.slot(h)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        for _ in range(1, self.probes):
            left = np.nonzero((out < 0) & (self.ids[slot] >= 0))  # a slot that another piece holds
            if not len(left[0]):
                break
            slot[left] = (slot[left] + 1) % len(self.ids)
            out[left] = np.where(self.keys[slot[left]] == h[left], self.ids[slot[left]], -1)
        return out

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in words, matrix of their bytes with the space in front) of words of LONG bytes or fewer."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1) : np.searchsorted(size[order], LONG, "right")]
        for n in np.unique(size[order]):
            own = order[np.searchsorted(size[order], n) : np.searchsorted(size[order], n, "right")]
            for at in range(0, len(own), SIDE_BY_SIDE):
                part = own[at : at + SIDE_BY_SIDE]
                flat = np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), n)
                yield part, np.concatenate((np.full((len(part), 1), 32, np.uint8), flat), axis=1)

    def forward(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """alpha (log probability of each word's first j bytes), and for each j the pieces that end there."""
        n, length = text.shape
        prefix = np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * self.BASE + text[:, j] + np.uint64(1)
        alpha, found = np.full((n, length + 1), -np.inf), []
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            i = max(0, j - self.longest)
            ids = self.find(prefix[:, j : j + 1] - prefix[:, i:j] * self.powers[j - i : 0 : -1])
            terms = alpha[:, i:j] + self.scores[ids]
            top = np.maximum(terms.max(axis=1), -1e300)
            with np.errstate(divide="ignore"):
                alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
            found.append(ids)
        return alpha, found

    def log_probs(self, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words), self.pieces[END])
        for at, text in self.batches(words):
            out[at] = self.forward(text)[0][:, -1]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = log_prob(w, self.pieces, self.longest)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected to be used, in `counts` occurrences of the words."""
        uses = np.zeros(len(self.names))
        for at, text in self.batches(words):
            alpha, found = self.forward(text)
            beta, total, c = np.full(alpha.shape, -np.inf), alpha[:, -1:], counts[at][:, None]
            beta[:, -1] = 0
            for j in range(text.shape[1], 0, -1):
                ids = found[j - 1]
                i = j - ids.shape[1]
                through = self.scores[ids] + beta[:, j : j + 1]
                beta[:, i:j] = np.logaddexp(beta[:, i:j], through)
                real = ids >= 0
                uses += np.bincount(ids[real], (c * np.exp(np.minimum(0, alpha[:, i:j] + through - total)))[real], len(uses))
        more: dict[bytes, float] = {}
        for w, c in zip(words, counts):
            if len(w) > LONG or w == END:
                expected(w, float(c), self.pieces, self.longest, more)
        place = {p: k for k, p in enumerate(self.names)} if more else {}
        for p, c in more.items():
            uses[place[p]] += c
        return uses


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # on bytes: A-Z alone, and exactly the white space of the word rule


def count_words(docs: DataFrame, trains: Column) -> DataFrame:
    """word (binary), c: of all words and ends in docs, counted where `trains` holds; 0 for those only found elsewhere."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, other = Counter(), set()

        def table() -> pd.DataFrame:
            zero = [w for w in other if w not in seen]
            return pd.DataFrame({"word": [*seen.keys(), *zero], "c": [*seen.values(), *([0] * len(zero))]})

        for b in batches:
            for t, own in zip(b.text, b.trains):
                if own:
                    seen.update(words(t))
                    seen[END] += 1
                else:
                    other.update(words(t))
                    other.add(END)
                if len(seen) + len(other) > MEMORY:
                    yield table()
                    seen.clear()
                    other.clear()
        if seen or other:
            yield table()

    return docs.select(F.col("text").cast("binary").alias("text"), trains.alias("trains")).mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(counts: DataFrame, pieces: dict[bytes, float], rounds: int = ROUNDS) -> dict[bytes, float]:
    """Weights re-estimated from (word, c); what comes to the driver is a number for each piece of the vocabulary."""
    sc, names = counts.sparkSession.sparkContext, list(pieces)
    for _ in range(rounds):
        now = sc.broadcast(pieces)  # of the vocabulary's size, whatever the corpus

        def run(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            lattice = Lattice(now.value)
            uses = np.zeros(len(lattice.names))
            for b in batches:
                uses += lattice.expected(list(b.word), b.c.to_numpy(np.float64))
            at = np.flatnonzero(uses)
            yield pd.DataFrame({"piece": at, "n": uses[at]})

        found = counts.where("c > 0").mapInPandas(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        used = {names[p]: n for p, n in found}
        if not used:
            return pieces
        # a hundredth of a use for each piece keeps every text possible
        pieces = normalised({p: math.log(used.get(p, 0.0) + 0.01) for p in pieces})
    return pieces


def word_scores(counts: DataFrame, pieces: dict[bytes, float]) -> DataFrame:
    """(word, c) with lp, the log10 probability of the word: every word goes through the lattice once."""
    sent = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(sent.value)
        for b in batches:
            yield b.assign(lp=lattice.log_probs(list(b.word)) / LOG10)

    return counts.mapInPandas(run, "word binary, c long, lp double")


def common_words(scored: DataFrame) -> dict[bytes, tuple[int, float, float]]:
    """The COMMON most frequent words of COMMON_BYTES at most: count, its logarithm, log probability."""
    rows = scored.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("c"), "word").limit(COMMON).collect()
    return {bytes(w): (c, math.log10(c + 1), lp) for w, c, lp in rows}


def score(docs: DataFrame, vocabulary: str = VOCABULARY, split: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark, "lattice")
    held_out = crc_mod("doc_id", split) == held
    counts = scratch.put("counts", count_words(docs, ~held_out))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    scored = scratch.put("scored", word_scores(counts, train(counts, load_vocabulary(vocabulary))))
    scratch.drop("counts")
    common = common_words(scored)
    sent = sc.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sent.value.get
        for b in batches:
            out = []
            for t in b.pop("text"):
                tokens = words(t)
                have = 0
                sure = model = 0.0
                rare_w, rare_n = [], []
                tf = Counter(tokens)
                tf[END] = 1
                for w, m in tf.items():
                    if (known := often(w)) is None:
                        rare_w.append(w)
                        rare_n.append(m)
                    else:
                        c, log_c, lp = known
                        have += m if c else 0
                        sure += m * log_c
                        model += m * lp
                out.append((len(tokens) + 1, have, sure, model, rare_w, rare_n))
            yield b.assign(**{c: [o[i] for o in out] for i, c in enumerate(("n_tokens", "have", "sure", "model", "rare_w", "rare_n"))})

    src = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    fields = "doc_id long, held_out boolean, n_tokens long, have long, sure double, model double, rare_w array<binary>, rare_n array<int>"
    rows = scratch.put("rows", src.mapInPandas(run, fields).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.inline(F.arrays_zip("rare_w", "rare_n"))).select("row", F.col("rare_w").alias("word"), F.col("rare_n").alias("m"))
    m, c = F.col("m"), F.col("c")
    more = rare.join(scored, "word").groupBy("row").agg(F.sum(F.when(c > 0, m).otherwise(0)).alias("have2"), F.sum(m * F.log10(c + F.lit(1.0))).alias("sure2"), F.sum(m * F.col("lp")).alias("model2"))
    full = rows.drop("rare_w", "rare_n").join(more, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("have") + zero(F.col("have2"))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sure") + zero(F.col("sure2")) - F.col("n_tokens") * F.lit(scale_of(total, distinct))).alias("base_score"), (F.col("model") + zero(F.col("model2"))).alias("score"),
    )


def scale_of(total: int, distinct: int) -> float:
    """log10 of N + 1 * (V + 1): every word known and one for all others count once more than they were seen."""
    return math.log10(total + 1 * (distinct + 1))
