"""Operator 9 - language-model scoring with a gated recurrent model.

1. All tokens of all training texts are counted (partial counts per task, one
   shuffle by word); the vocabulary stays distributed.
2. The ``HEAD`` most frequent words go to every task. Texts are written once as
   16-bit head numbers plus their other words.
3. The recurrent model predicts the ``SYMBOLS`` - 1 most frequent words and one
   symbol for all others, whose probability is shared out by their counts. Every
   training text is used for one pass of truncated backpropagation, in ROUNDS
   rounds: each task trains on its own texts from the common model, and the
   models are averaged by their number of tokens.
4. Whole texts are scored with the state carried from window to window. Words
   outside the head get their counts by a join on the word, which no frequent
   word takes part in.

Defined cases: null text is the empty text (one end token); without training
texts every token scores 0; repeated rows repeat; a null id is held out if its
fold is null, and carried; very long texts are scored whole; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru_model as gru
from .shared import only, written

HEAD, SYMBOLS, SMOOTH = 65_000, 4096, 0.1
#: Shares of the training texts (by hash of the text) that the rounds use; together all of them.
ROUNDS = (0.25, 1.0)
END = b"\n"
FLUSH_WORDS, BLOCK_TOKENS, CHUNK = 400_000, 1 << 22, 1 << 12
OTHER = 65_535


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then one end."""
    return [*(text or b"").lower().split(), END]


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()
    for frame in frames:
        for text in frame["text"]:
            counts.update(tokens(text))
            if len(counts) >= FLUSH_WORDS:
                yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                counts.clear()
    yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})


def _most_frequent(vocabulary: DataFrame) -> pd.DataFrame:
    """At most HEAD words, by falling count: all words above a level of the count."""
    level = F.floor(F.log2("c") * 16).cast("int")
    room, least = HEAD, 1 << 30
    for row in sorted(vocabulary.groupBy(level.alias("e")).count().collect(), reverse=True):
        if row["count"] > room:
            break
        least, room = row["e"], room - row["count"]
    return vocabulary.where(level >= least).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def _encode(head: dict[bytes, int]):
    """Head numbers of each text, and its other words with how often it holds them."""

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            return OTHER

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        number = Numbers(head).__getitem__
        for frame in frames:
            ids, others, times = [], [], []
            for text in frame["text"]:
                words = tokens(text)
                own = np.fromiter(map(number, words), np.uint16, len(words))
                ids.append(own.tobytes())
                rare = Counter(compress(words, (own == OTHER).tolist()))
                others.append(list(rare))
                times.append(list(rare.values()))
            yield frame.drop(columns="text").assign(ids=ids, others=others, times=times)

    return encode


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of about BLOCK_TOKENS; a text is never cut."""
    held, size = [], 0
    for frame in frames:
        for k in range(0, len(frame), 256):
            part = frame.iloc[k : k + 256]
            held.append(part)
            size += int(part["ids"].map(len).sum()) // 2
            if size >= BLOCK_TOKENS:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class Model:
    """What every task needs: symbols of the head, shape, weights and the counts of the rest."""

    def __init__(self, head: pd.DataFrame, tokens_in_all: int, words_in_all: int):
        counts = head["c"].to_numpy(np.float64)
        known = counts[: SYMBOLS - 1]
        self.rest_tokens, self.rest_words = tokens_in_all - int(known.sum()), words_in_all - len(known)
        # Symbols by falling count, so that classes are ranges; the rest takes its place among them.
        masses = np.append(known, max(self.rest_tokens, SMOOTH))
        order = np.argsort(-masses, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.rest = int(place[-1])
        self.symbol_of = np.full(1 << 16, self.rest, np.int32)
        self.symbol_of[: len(known)] = place[:-1]
        words = head["word"].map(bytes).tolist()
        self.first = int(self.symbol_of[words.index(END)]) if END in words else self.rest
        self.shape = gru.Shape(len(order), gru.class_starts(masses[order]))
        self.weights = gru.flat(gru.initial(self.shape, masses[order]))
        self.n_head = len(head)
        self.log_count = np.log10(np.append(counts, np.zeros((1 << 16) - len(counts))) + SMOOTH)


def _trainer(model: Model):
    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = gru.unflat(model.weights, model.shape)
        memory = {k: np.full_like(v, 1e-6) for k, v in weights.items()}
        seen = 0
        for frame in _blocks(frames):
            texts = [model.symbol_of[np.frombuffer(x, np.uint16)] for x in frame["ids"]]
            gru.train(weights, model.shape, texts, model.first, memory)
            seen += sum(map(len, texts))
        if seen:
            values = gru.flat(weights) - model.weights
            parts = [values[k : k + CHUNK].tobytes() for k in range(0, len(values), CHUNK)]
            yield pd.DataFrame({"part": range(len(parts)), "branch": TaskContext.get().partitionId() % 64, "seen": seen, "values": parts})

    return fit


def _average(frame: pd.DataFrame) -> pd.DataFrame:
    """The token-weighted mean of some models' changes to one part of the weights."""
    weight = frame["seen"].to_numpy(np.float64)
    total = sum(np.frombuffer(v, np.float32) * w for v, w in zip(frame["values"], weight, strict=True)) / weight.sum()
    return pd.DataFrame({"part": frame["part"].iloc[:1], "branch": frame["branch"].iloc[:1], "seen": [int(weight.sum())], "values": [total.astype(np.float32).tobytes()]})


def _scorer(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = gru.unflat(model.weights, model.shape)
        for frame in _blocks(frames):
            ids = [np.frombuffer(x, np.uint16) for x in frame["ids"]]
            every, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
            known, logs = every < model.n_head, model.log_count[every]
            rest = model.symbol_of[every] == model.rest
            loglik = gru.score(weights, model.shape, [model.symbol_of[x] for x in ids], model.first)
            add = lambda x: np.add.reduceat(x, starts)
            yield frame.drop(columns="ids").assign(
                n_tokens=[len(x) for x in ids], head_known=add(known.astype(np.int64)), head_log=add(np.where(known, logs, 0)),
                rest_log=add(np.where(known & rest, logs, 0)), n_rest=add(rest.astype(np.int64)), model_log=loglik / np.log(10),
            )

    return run


def language_model_scores(df: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.coalesce(training, F.lit(False)).alias("learn"), F.col(text).cast("binary").alias("text"))
    counted = rows.where("learn").select("text").mapInPandas(_word_counts, "word binary, c long")
    vocabulary = written(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = _most_frequent(vocabulary)
    numbers = {bytes(w): k for k, w in enumerate(head["word"])}
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(1000)))
    encoded = written(numbered.mapInPandas(_encode(numbers), f"id {kind}, learn boolean, row long, part long, ids binary, others array<binary>, times array<long>"), "lm-encoded")

    model, low = Model(head, total["n"], total["v"]), 0
    for high in (int(1000 * r) for r in ROUNDS):
        share = encoded.where(F.col("learn") & (F.col("part") >= low) & (F.col("part") < high)).select("ids")
        schema = "part int, branch int, seen long, values binary"
        trained = share.mapInPandas(_trainer(model), schema).groupBy("part", "branch").applyInPandas(_average, schema)
        merged = trained.groupBy("part").applyInPandas(_average, schema).toPandas().sort_values("part")
        if len(merged):
            model.weights = model.weights + np.frombuffer(b"".join(map(bytes, merged["values"])), np.float32)
        low = high

    fields = "n_tokens long, head_known long, head_log double, rest_log double, n_rest long, model_log double"
    scored = encoded.select("id", "learn", "row", "ids").mapInPandas(_scorer(model), f"id {kind}, learn boolean, row long, {fields}")
    words = encoded.select("row", F.explode(F.arrays_zip(F.col("others").alias("word"), F.col("times").alias("k"))).alias("x")).select("row", "x.word", "x.k")
    others = words.join(vocabulary, "word", "left")
    of_row = others.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("other_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("other_known"))
    n, v = total["n"], total["v"]
    whole, rest = float(np.log10(n + SMOOTH * (v + 1))), float(np.log10(model.rest_tokens + SMOOTH * (model.rest_words + 1)))
    other_log = F.coalesce("other_log", F.lit(0.0))
    return scored.join(of_row, "row", "left").select(
        F.col("id").alias(key), (~F.col("learn")).alias("held_out"), "n_tokens",
        (F.col("head_known") + F.coalesce("other_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + other_log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model_log") + F.col("rest_log") + other_log - F.col("n_rest") * rest).alias("score"),
    )
