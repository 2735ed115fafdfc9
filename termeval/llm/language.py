"""Language by rank-order profiles: the language whose profile is least out of place.

A profile is the list of the most frequent character n-grams (1 to 3 letters,
words padded with blanks) of all training texts of a language, by rank. A
document's own list is compared with each profile: every n-gram adds how far
its two ranks lie apart, or the profile's length where the profile lacks it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm.shared import buffer_of, map_slices, slices

# N-grams in a profile.
PROFILE = 300
# Languages whose profiles are sent to the tasks at once.
MOST_LANGUAGES = 4096
# Distinct n-grams that a task gathers before it hands their counts on.
GATHERED = 500_000

UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for all other code points."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for p in range(0x110000):
        if unicodedata.category(c := chr(p))[0] in "LM":
            lower[p] = ord(folded) if len(folded := c.lower()) == 1 else p
    return lower


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """Whether a code point is a letter; marks alone are none."""
    return np.array([unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)])


def ngrams(points: np.ndarray) -> np.ndarray:
    """The codes of all 1- to 3-grams of one text; 21 bits per letter, words end in a blank.

    Runs of anything but letters count as one blank; blanks alone are no n-gram.
    """
    lower = letters()[points].astype(np.uint64)
    padded = np.concatenate([[0], lower, [0]]).astype(np.uint64)
    kept = (padded[1:] != 0) | (padded[:-1] != 0)
    padded = np.concatenate([padded[:1], padded[1:][kept]])
    padded = np.where(padded == 0, np.uint64(32), padded)
    one = padded[padded != 32]
    two = (padded[:-1] << np.uint64(21)) | padded[1:]
    three = (two[:-1] << np.uint64(21)) | padded[2:]
    # A trigram with a blank in the middle joins two words; it is left out.
    return np.concatenate([one, two, three[padded[1:-1] != 32]])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[edges], np.diff(np.append(edges, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent codes; the smaller code comes first among equal counts."""
    if len(codes) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.argsort(-counts, kind="stable")][:PROFILE]


def _points(batch: pa.RecordBatch) -> list[np.ndarray]:
    data, lengths = buffer_of(batch.column("text"))
    edges = np.cumsum(np.append(0, lengths)).tolist()
    return [
        np.frombuffer(data[a:b].decode().encode("utf-32-le"), dtype=np.uint32) for a, b in zip(edges, edges[1:])
    ]


def profiles(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The profile of each language: ``lang``, ``code long``, ``rank int`` from 0.

    Counts cover every text with a language; rows without one, and null or
    empty texts, add nothing. Each task sums its own counts first.
    """

    def counts(batches):
        gathered: dict[str, list] = {}
        held = 0

        def out():
            for lang, parts in gathered.items():
                codes, places = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(places, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(total)],
                    names=["lang", "code", "n"],
                )
            gathered.clear()

        for batch in slices(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, points in zip(batch.column("lang").to_pylist(), _points(batch)):
                by_lang.setdefault(lang, []).append(ngrams(points))
            for lang, found in by_lang.items():
                own = counted(np.concatenate(found))
                gathered.setdefault(lang, []).append(own)
                held += len(own[0])
            if held > GATHERED:
                # Sum what is held; hand it on if it is still as much.
                for lang, parts in gathered.items():
                    codes, places = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    gathered[lang] = [(codes, np.bincount(places, weights=np.concatenate([p[1] for p in parts])))]
                held = sum(len(p[0][0]) for p in gathered.values())
                if held > GATHERED // 2:
                    yield from out()
                    held = 0
        yield from out()

    texts = training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    texts = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = texts.mapInArrow(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return (
        # The limit stands by itself, so that tasks apply it before the shuffle.
        totals.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= PROFILE)
        .select("lang", "code", (F.col("place") - 1).cast("int").alias("rank"))
    )


class Profiles:
    """Some languages' profiles: of each n-gram the languages that have it, and its ranks there."""

    def __init__(self, names: list[str], lang: np.ndarray, code: np.ndarray, rank: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.names, self.lang, self.rank = names, lang[order].astype(np.int32), rank[order].astype(np.int32)
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)

    def saved(self, own: np.ndarray) -> np.ndarray:
        """Of each language, what its ranks of ``own`` n-grams take from the greatest distance."""
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == own)
        n = self.count[at[place]]
        index = np.repeat(self.first[at[place]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        apart = np.abs(self.rank[index] - np.repeat(place, n))
        return np.bincount(self.lang[index], weights=PROFILE - apart, minlength=len(self.names))


def predict(
    df: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()
) -> DataFrame:
    """``id_col``, ``lang_pred string``, ``score double`` (0 to 1) of every text.

    ``lang_pred`` is ``und``, with score 0, where the text is null, has no letter
    or the model is empty. Of equally near profiles the first name wins. The
    score is 1 less the distance as a part of the greatest one possible. Profiles
    are sent to the tasks in blocks of about ``MOST_LANGUAGES`` languages, one pass
    each. Repeated rows come out as often as they went in.
    """
    spark = df.sparkSession
    languages = model.select("lang").distinct().count()
    blocks = languages // MOST_LANGUAGES + 1
    of_block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    # Kept columns travel as one, so that none of their names can clash.
    kept = F.struct(F.col(id_col), *keep)
    rows = df.select(
        F.col(text_col).alias("text"), kept.alias("kept"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")
    )
    for block in range(blocks):
        known = model.where(of_block == block).toArrow()
        names = sorted(set(known.column("lang").to_pylist()))
        if not names:
            continue
        place = {name: i for i, name in enumerate(names)}
        lang = np.array([place[x] for x in known.column("lang").to_pylist()], dtype=np.int64)
        code, rank = known.column("code").to_numpy().astype(np.uint64), known.column("rank").to_numpy()
        rows = _judged(rows, spark.sparkContext.broadcast(Profiles(names, lang, code, rank)), with_text=blocks > 1)
        if blocks > 1:
            rows = materialise(rows, "languages")
    return rows.select("kept.*", "lang_pred", "score")


def _judged(rows: DataFrame, shipped, with_text: bool) -> DataFrame:
    """``rows`` with the nearer of the language they have and the nearest of the profiles that are sent."""
    schema = rows.schema if with_text else rows.drop("text").schema

    def make():
        profiles = shipped.value

        def judge(points: np.ndarray, name: str, score: float) -> tuple[str, float]:
            if not is_letter()[points].any():
                return name, score
            own = ranked(*counted(ngrams(points)))
            saved = profiles.saved(own)
            best, most = int(saved.argmax()), PROFILE * len(own)
            found = profiles.names[best], 1.0 - float(most - saved[best]) / most
            if name == UNKNOWN or found[1] > score or (found[1] == score and found[0] < name):
                return found
            return name, score

        def run(batch):
            before = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist())
            judged = [judge(points, *x) for points, x in zip(_points(batch), before)]
            columns = {"text": batch.column("text")} if with_text else {}
            columns |= {
                "kept": batch.column("kept"),
                "lang_pred": pa.array([x[0] for x in judged], pa.string()),
                "score": pa.array([x[1] for x in judged], pa.float64()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return run

    return map_slices(rows, make, schema)
