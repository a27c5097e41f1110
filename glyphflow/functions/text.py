"""Column expressions on texts: normalising, encoding, distances, display."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def chars(text: Column) -> Column:
    """The code points of a text; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def unicode_strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_spaces(text: Column, space: str = " ") -> Column:
    """Runs of the space character become one; none at the ends. Other white space stays."""
    return F.array_join(F.filter(F.split(text, re.escape(space)), lambda x: x != ""), space)


def unknown_chars(text: Column, alphabet: Column) -> Column:
    """Distinct characters outside the alphabet, sorted."""
    return F.array_sort(F.array_except(chars(text), alphabet))


def text_problem(text: Column, alphabet: Column, longest: int) -> Column:
    """Why a text can't be a label, or the empty string."""
    odd = unknown_chars(text, alphabet)
    return (
        F.when(F.char_length(text) == 0, F.lit("empty"))
        .when(F.size(odd) > 0, F.concat(F.lit("unknown: "), missing_chars_text(odd)))
        .when(F.char_length(text) > longest, F.lit("too long"))
        .otherwise(F.lit(""))
    )


def encode(text: Column, alphabet: Column, length: int) -> Column:
    """Class ids (places in the alphabet) filled with 0 to ``length``; the text's own length is kept apart."""
    ids = F.transform(chars(text), lambda c: F.array_position(alphabet, c).cast("int") - 1)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, F.greatest(F.size(ids), F.lit(length)))


def _class(alphabet: str) -> str:
    """The characters of an alphabet inside a class of a pattern."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in alphabet)


def only_known(text: Column | str, alphabet: str) -> Column:
    """The text without the characters outside the alphabet; runs of them go at once."""
    return F.regexp_replace(text, f"[^{_class(alphabet)}]+", "")


def holds_known(text: Column | str, alphabet: str) -> Column:
    """Whether a text has any character of the alphabet."""
    return F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(f"[{_class(alphabet)}]"))


def encode_text(text: Column, alphabet: str, length: int) -> Column:
    """As ``encode``, for an alphabet that is given as text: one search per character instead of one comparison per class."""
    ids = F.transform(chars(text), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, F.greatest(F.size(ids), F.lit(length)))


#: How single characters are shown (fixed values).
SHOWN = {" ": "<space>", "\t": "<tab>", "\n": "<newline>"}


def display_char(ch: Column, shown: dict[str, str] = SHOWN) -> Column:
    out = ch
    for raw, name in shown.items():
        out = F.when(ch == raw, F.lit(name)).otherwise(out)
    return out


def class_label(class_id: Column, alphabet: Column) -> Column:
    """The character of a class for display, or ``<id>`` for an unknown class."""
    ch = F.get(alphabet, class_id)
    return F.coalesce(display_char(ch), F.concat(F.lit("<"), class_id.cast("string"), F.lit(">")))


def missing_chars_text(missing: Column, shown: int = 24) -> Column:
    """``a, b, c +k``: the first characters of a list and how many more there are."""
    head = F.array_join(F.transform(F.slice(missing, 1, shown), lambda c: display_char(c)), ", ")
    return F.when(F.size(missing) > shown, F.concat(head, F.lit(" +"), (F.size(missing) - shown).cast("string"))).otherwise(head)


def char_accuracy(gt: Column, pred: Column, distance: Column | None = None) -> Column:
    """1 - distance / length, at least 0; for an empty truth 1 if nothing was predicted, else 0."""
    share = F.greatest(F.lit(0.0), 1 - (F.levenshtein(gt, pred) if distance is None else distance) / F.char_length(gt))
    return F.when(F.char_length(gt) == 0, (F.char_length(pred) == 0).cast("double")).otherwise(share)


def _digest(seed: int, row: Column, draw: Column | int) -> Column:
    """The eight hexadecimal digits of a draw."""
    text = F.concat_ws(":", F.lit(str(seed)), row.cast("string"), draw.cast("string") if isinstance(draw, Column) else F.lit(str(draw)))
    return F.substring(F.md5(text), 1, 8)


def hash_draw(seed: int, row: Column, draw: Column | int) -> Column:
    """A whole number from 0 to 2**32 - 1 for a row and a draw; the same in any partitioning."""
    return F.conv(_digest(seed, row, draw), 16, 10).cast("long")


def hash_uniform(seed: int, row: Column, draw: Column | int) -> Column:
    """A draw from [0, 1)."""
    return hash_draw(seed, row, draw) / F.lit(4294967296.0)


def hash_below(seed: int, row: Column, draw: Column | int, share: float) -> Column:
    """Whether ``hash_uniform`` is below a share from 0 to less than 1, told by its digits."""
    return _digest(seed, row, draw) < F.lit(f"{math.ceil(share * 4294967296):08x}")


#: MD5's constants and rotations; each step takes one word of the message.
_STEPS = [
    (np.uint32(int(abs(math.sin(i + 1)) * 4294967296)), np.uint32(((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4]), (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16)
    for i in range(61)
]
#: Draws that are taken at once: their words stay in the cache.
DRAWS = 1 << 14


def _leading(messages: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 of each message, as a whole number; messages (rows of bytes, ended by 128, at most 56) are of one block."""
    words = dict(enumerate(np.ascontiguousarray(messages.view("<u4").T))) | {14: bits.astype(np.uint32)}
    a, b, c, d = (np.full(len(bits), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i, (add, turn, k) in enumerate(_STEPS):  # the last three of 64 steps don't change the first four bytes
        mixed = _mixed(i // 16, b, c, d)
        mixed += a
        mixed += add
        if k in words:
            mixed += words[k]
        a, d, c, b = d, c, b, b + ((mixed << turn) | (mixed >> (np.uint32(32) - turn)))
    return (b + np.uint32(0x67452301)).byteswap()


def _mixed(quarter: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if quarter == 0:
        return d ^ (b & (c ^ d))
    if quarter == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if quarter == 2 else c ^ (b | ~d)


@F.arrow_udf(ArrayType(IntegerType()))
def _below(row: pa.Array, n: pa.Array, seed: pa.Array, limit: pa.Array) -> pa.Array:
    many = np.maximum(0, n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.cumsum(many)
    heads = [f"{s}:" if r is None else f"{s}:{r}:" for s, r in zip(seed.to_pylist(), row.to_pylist(), strict=True)]
    tails = np.array([b"%d\x80" % x for x in range(int(many.max(initial=0)))] or [b"\x80"])
    wide = tails.dtype.itemsize
    long = np.array([len(h) for h in heads], np.int64)
    room = -(-(int(long.max(initial=0)) + wide) // 4) * 4
    head = np.array(heads or [""], f"S{room}").view(np.uint8).reshape(-1, room)
    tail, digits = tails.view(np.uint8).reshape(-1, wide), np.char.str_len(tails) - 1
    lines, places = [], []
    for first in range(0, int(ends[-1]) if len(ends) else 0, DRAWS):
        at = np.arange(first, min(first + DRAWS, ends[-1]))
        line = np.searchsorted(ends, at, side="right")
        x = at - (ends[line] - many[line])
        text = head[line]
        np.put_along_axis(text, long[line, None] + np.arange(wide), tail[x], axis=1)
        hit = np.flatnonzero(_leading(text, 8 * (long[line] + digits[x])) < limit[0].as_py())
        lines.append(line[hit])
        places.append(x[hit])
    counts = np.bincount(np.concatenate(lines), minlength=len(many)) if lines else np.zeros(len(many), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(places) if places else np.zeros(0), pa.int32()))


def places_below(seed: int, row: Column, n: Column, share: float) -> Column:
    """The x from 0 to n - 1 with ``hash_below(seed, row, x, share)``, for a whole batch of rows at once."""
    return _below(row.cast("string"), n.cast("int"), F.lit(str(seed)), F.lit(math.ceil(share * 4294967296)))
