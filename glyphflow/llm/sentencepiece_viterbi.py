"""Operator 3 - SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces of a vocabulary runs once over the
text; each match that its output links give relaxes the best score at the end of
the match. A character that no piece covers falls back to its byte pieces. As no
piece holds a word mark after another character, the text is cut before each run
of marks and the cuts are encoded one by one, short ones from a bounded store.

The segmentation is the one of greatest total score (on ties the longest last
piece). A vocabulary made by merging has ranks for scores, which are no
log-probabilities and don't add up; there the score of a piece is estimated from
its rank by the law of Zipf and Mandelbrot, -log(rank + OFFSET). Ids may differ
from those of merging in order. Decoding gives the text back, save that the word
mark U+2581 itself comes back as a blank; ``restored`` is false for such a text.

Defined cases: null text is the empty text and has no ids; repeated rows repeat;
a null id is carried; very long texts are read whole; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TwoGenerations, only

MARK = "▁"
_CUTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEEP_ENTRIES, KEEP_CHARS = 400_000, 48
#: How much worse than the worst piece a character of byte pieces is.
FALLBACK = 10.0
#: What is added to a merge rank before its logarithm is taken.
OFFSET = 100.0


class Pieces(TwoGenerations):
    """The pieces of a model file with their automaton; as a dictionary, the ids of a cut as 32-bit bytes."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(KEEP_ENTRIES, KEEP_CHARS)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.byte_value = {i: int(p[3:5], 16) for i, p in enumerate(self.text) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_value.items()}
        self.unknown = model.unk_id()
        usual = [i for i in range(len(self.text)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in usual])
        if len(scores) and (scores == np.round(scores)).all():  # merge ranks
            scores = -np.log(np.maximum(-scores, 0) + OFFSET)
        self.score = {self.text[i]: (i, s) for i, s in zip(usual, scores.tolist(), strict=True)}
        self.worst = min((s for _, s in self.score.values() if s > -1e6), default=0.0) - FALLBACK
        self.automaton = ahocorasick.Automaton()
        for piece, (i, s) in self.score.items():
            self.automaton.add_word(piece, (len(piece), i, s))
        self.automaton.make_automaton()
        self.plain = [p.replace(MARK, " ") for p in self.text]

    def viterbi(self, cut: str) -> list[int]:
        n = len(cut)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        done = 0

        def fall(to: int) -> None:
            """Characters that are no piece themselves may take byte pieces, up to ``to``."""
            nonlocal done
            while done < to:
                done += 1
                if cut[done - 1] not in self.score and best[done - 1] + self.worst > best[done]:
                    best[done], back[done] = best[done - 1] + self.worst, (done - 1, -1)

        for last, (length, i, s) in self.automaton.iter(cut):
            end = last + 1
            if end > done + 1:
                fall(end - 1)
            if best[end - length] + s > best[end]:
                best[end], back[end] = best[end - length] + s, (end - length, i)
        fall(n)
        out, at = [], n
        while at:
            start, i = back[at]
            out.extend([i] if i >= 0 else [self.byte_id.get(b, self.unknown) for b in reversed(cut[start:at].encode())])
            at = start
        return out[::-1]

    def make(self, cut: str) -> bytes:
        return np.array(self.viterbi(cut), "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, _CUTS.findall(MARK + text.replace(" ", MARK))))

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.byte_value.keys().isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids))[1:]
        raw = b"".join(bytes([self.byte_value[i]]) if i in self.byte_value else self.plain[i].encode() for i in ids)
        return raw.decode("utf-8", "replace")[1:]


@cache
def pieces(path: str) -> Pieces:
    """Once per worker."""
    return Pieces(path)


def encode(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """Per row: ``key``, n_ids and ids; with ``check`` also restored, whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        only(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [model.encode(t) for t in texts]
                sizes = np.array([len(r) // 4 for r in rows], np.int32)
                ids = pa.array(np.frombuffer(b"".join(rows), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), ids)
                out = {"k": part.column(0), "n_ids": pa.array(sizes, pa.int64()), "ids": lists}
                if check:
                    out["restored"] = pa.array([model.decode(np.frombuffer(r, "<i4").tolist()) == t for r, t in zip(rows, texts, strict=True)])
                yield pa.RecordBatch.from_pydict(out)

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_ids long, ids array<int>" + ", restored boolean" * check).withColumnRenamed("k", key)


def decode(df: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: ``key`` and text. Null ids give the empty text; ids outside the vocabulary raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            rows = [model.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["k", "text"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
