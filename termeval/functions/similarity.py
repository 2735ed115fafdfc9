"""String and vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64
# Bytes of letter masks computed at once, save for a single pair.
_GROUP_BYTES = 16 * 1024 * 1024
# Pairs compared at once times the letters of the longest text, save for a single pair.
_GROUP_LETTERS = 512 * 1024


def exact_match(predicted: Column, actual: Column) -> Column:
    """1 where both are equal, else 0, NULLs included."""
    return F.coalesce(predicted == actual, F.lit(False)).cast("int")


def exact_match_float(predicted: Column, actual: Column) -> Column:
    """:func:`exact_match` for floats, where NaN does not equal itself."""
    return F.when(F.isnan(predicted) | F.isnan(actual), F.lit(0)).otherwise(
        exact_match(predicted, actual)
    )


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and the length of each."""
    # Lone halves of surrogate pairs are letters like any other.
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.fromiter(map(len, texts), np.int64, len(texts))


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the position in it of every element of rows of these sizes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _lcs(xs: list[str], ys: list[str]) -> np.ndarray:
    """LCS lengths of many pairs at once; a text of ``ys`` takes as many words as it needs.

    A bit vector holds, for every letter of ``y``, whether the LCS grows there.
    The letters of all ``xs`` are taken in step; the sum that carries a change
    from one word of a vector to the next is done for all pairs at once.
    """
    x_points, x_len = _points(xs)
    y_points, y_len = _points(ys)
    words = max(1, -(-int(y_len.max(initial=0)) // _WORD))
    letters, codes = np.unique(np.concatenate([x_points, y_points]), return_inverse=True)
    x_codes, y_codes = codes[: len(x_points)], codes[len(x_points) :]
    row, at = _places(y_len)
    # The positions of each letter in each y; those of one word come one after the other.
    masks = np.zeros((len(xs), len(letters) + 1, words), dtype=np.uint64)
    np.bitwise_or.at(masks, (row, y_codes, at // _WORD), np.uint64(1) << (at % _WORD).astype(np.uint64))
    row, at = _places(x_len)
    # The last letter stands for those behind the end of x: it is in no y.
    steps = np.full((int(x_len.max(initial=0)), len(xs)), len(letters))
    steps[at, row] = x_codes
    left = np.clip(y_len[:, None] - _WORD * np.arange(words), 0, _WORD)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.where(left > 0, ones >> np.minimum(_WORD - left, _WORD - 1).astype(np.uint64), np.uint64(0))
    state, pairs = full.copy(), np.arange(len(xs))
    for step in steps:
        used = state & masks[pairs, step]
        total = state + used
        carry = total < used
        while words > 1 and carry[:, :-1].any():
            total[:, 1:] += carry[:, :-1]
            # A word that took one and is 0 now was full, so it hands one on.
            carry[:, 1:] = carry[:, :-1] & (total[:, 1:] == 0)
            carry[:, 0] = False
        state = (total | (state & ~used)) & full
    return y_len - np.bitwise_count(state).sum(axis=1, dtype=np.int64)


def _groups(pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Numbers of pairs of like lengths, as many as ``_GROUP_BYTES`` of masks and ``_GROUP_LETTERS`` allow; the shorter text first."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    group: list[int] = []
    letters: set[str] = set()
    for i in order:
        x, y = pairs[i]
        more = letters.union(x, y)
        words = -(-len(y) // _WORD)
        # Pairs of a group take as many words as its last; no group holds one and its double.
        wide = group and words > 2 * -(-len(pairs[group[0]][1]) // _WORD)
        wide = wide or len(y) * (len(group) + 1) > _GROUP_LETTERS
        if group and (wide or 8 * words * (len(more) + 1) * (len(group) + 1) > _GROUP_BYTES):
            yield group
            group, more = [], set(x + y)
        group.append(i)
        letters = more
    if group:
        yield group


def _indel_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """100 * (1 - indel distance / total length) of each pair."""
    total = np.array([len(x) + len(y) for x, y in pairs], dtype=np.int64)
    lcs = np.zeros(len(pairs), dtype=np.int64)
    differ = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            lcs[i] = len(x)
        elif x and y:
            differ.append(i)
    ordered = [pairs[i] if len(pairs[i][0]) <= len(pairs[i][1]) else pairs[i][::-1] for i in differ]
    for group in _groups(ordered):
        found = _lcs([ordered[k][0] for k in group], [ordered[k][1] for k in group])
        lcs[[differ[k] for k in group]] = found
    distance = total - 2 * lcs
    return 100.0 * (1.0 - distance / np.maximum(total, 1))


@F.pandas_udf(T.DoubleType())
def _indel_ratio(predicted: pd.Series, actual: pd.Series) -> pd.Series:
    # Names repeat within a batch: each distinct pair is compared once.
    known = (predicted.notna() & actual.notna()).to_numpy()
    pairs = list(zip(predicted[known], actual[known]))
    index = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
    scores = np.full(len(predicted), np.nan)
    if pairs:
        distinct = _indel_ratios(list(index))
        scores[known] = distinct[[index[pair] for pair in pairs]]
    return pd.Series(scores)


def fuzzy_ratio(predicted: Column, actual: Column) -> Column:
    """Indel similarity of the lower-cased texts, from 0 to 100."""
    return _indel_ratio(F.lower(predicted), F.lower(actual))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; lengths must agree."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda z, x: z + x)
    return F.when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))
    ).otherwise(total)


def norm(a: Column) -> Column:
    squares = F.aggregate(
        a, F.lit(0.0), lambda z, x: z + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NaN where a vector has no length."""
    return cosine_with_norms(a, b, norm(a), norm(b))


def cosine_with_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """:func:`cosine` with norms already at hand, as one dot product."""
    scale = norm_a * norm_b
    return F.when(scale == 0.0, F.lit(float("nan"))).otherwise(
        F.try_divide(dot(a, b), scale)
    )
