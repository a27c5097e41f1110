"""Operator 6 - language identification by multinomial naive Bayes.

Character 1- to 3-grams of the lower-cased text are hashed into ``BUCKETS``.
Training sums the hashed counts of every labelled training row per language on
the executors; the log-probability matrix (languages x BUCKETS doubles, the
languages being the distinct labels) goes to every task with the function. A
batch of texts is scored as a sparse product: the matrix entries of all n-grams
are gathered and summed by row.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, and
for all texts if there is no labelled training row; rows with a null label are
scored but not learnt from; ties go to the first language in alphabetical order;
repeated rows count as often as they occur; a null id is carried like any other;
an empty table gives an empty result; other columns are ignored, whatever their
names. Texts, very long ones too, are read whole, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import only

BUCKETS, ORDERS, SMOOTHING = 1 << 15, 3, 0.1
#: More labels than this are refused: the matrix would outgrow its stated bound (200 x 32768 doubles).
MAX_LANGUAGES = 200
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_PAD = " " * (ORDERS - 1)
BLOCK_CHARS, SLICE_ROWS = 1 << 19, 1024


def hashed_grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the bucket of the n-gram that begins at each code point, and where each text begins."""
    texts = [f" {t.lower()}{_PAD}" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    mixed, out = np.zeros(len(codes), np.uint32), []
    for n in range(ORDERS):
        mixed[: len(codes) - n] += (codes[n:] + np.uint32(n + 1)) * _FACTORS[n]
        h = mixed ^ mixed >> np.uint32(15)
        out.append((h * np.uint32(739982445)) >> shift)
    return out, starts


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK_CHARS, each with the place of its first; a longer text is a run of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def train(df: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log prior and log-probability matrix, from all rows with a text and a label."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for frame in frames:
            for lang, own in frame.groupby("lang")["t"]:
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                rows[lang] = rows.get(lang, 0) + len(own)
                for _, run in blocks(own.tolist()):
                    for grams in hashed_grams(run)[0]:
                        total += np.bincount(grams, minlength=BUCKETS)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(used, -1), "n": np.append(total[used], rows[lang])})

    labelled = df.select(F.col(text).alias("t"), F.col(label).alias("lang")).where("t is not null and lang is not null")
    counts = labelled.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    most = MAX_LANGUAGES * (BUCKETS + 1)
    found = counts.limit(most + 1).toPandas()
    langs = sorted(found["lang"].unique())
    if len(langs) > MAX_LANGUAGES or len(found) > most:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix, prior = np.full((len(langs), BUCKETS), SMOOTHING), np.ones(len(langs))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        matrix[k, grams["bucket"].to_numpy()] += grams["n"].to_numpy()
        prior[k] = own.loc[own["bucket"] < 0, "n"].sum()
    return langs, np.log(prior / max(prior.sum(), 1)), np.log(matrix / matrix.sum(axis=1, keepdims=True))


def score_texts(texts: list[str], prior: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text, by its place, and its posterior probability."""
    best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for at, run in blocks(texts):
        grams, starts = hashed_grams(run)
        total = np.tile(prior[:, None], (1, len(run)))
        for k in range(len(prior)):
            for h in grams:
                total[k] += np.add.reduceat(matrix[k].take(h), starts)
        odds = np.exp(total - total.max(axis=0))
        odds /= odds.sum(axis=0)
        best[at : at + len(run)] = odds.argmax(axis=0)
        share[at : at + len(run)] = odds.max(axis=0)
    return best, share


def language_of(df: DataFrame, training: Column | None = None, text: str = "text", label: str = "lang") -> Column:
    """A struct of lang_pred and score for the rows of ``df``, from a model trained on it.

    ``training`` selects the rows to learn from (default: all). Only the text goes
    to Python, all other columns stay where they are; the label of a row is never
    an input of its prediction.
    """
    langs, prior, matrix = train(df.where(training) if training is not None else df, text, label)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only()
        for batch in batches:
            pred, score = [], []
            for at in range(0, len(batch), SLICE_ROWS):
                texts = [t or "" for t in batch.slice(at, SLICE_ROWS).to_pylist()]
                known = [k for k, t in enumerate(texts) if langs and _LETTER.search(t)]
                names, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    for k, best, share in zip(known, *score_texts([texts[k] for k in known], prior, matrix), strict=True):
                        names[k], shares[k] = langs[best], float(share)
                pred += names
                score += shares
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    # Not deterministic to the optimizer only, so that it is never run twice for a row.
    return F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()(F.col(text))


def identify_languages(df: DataFrame, training: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Per row: ``key``, lang_pred and score; see ``language_of``."""
    found = df.select(F.col(key).alias("id"), language_of(df, training, text, label).alias("found"))
    return found.select(F.col("id").alias(key), "found.lang_pred", "found.score")
