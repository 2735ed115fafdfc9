"""Toxicity by class-conditional Kneser-Ney models of letters.

Two models, one of toxic and one of ordinary text, give each letter a
probability after the four before it. Both discount their own five-letter counts
and hand the rest to one shared model of shorter contexts, built from how many
different letters each was seen after in either class (Kneser-Ney), so a rare
expression is judged by what both classes know of it. A text's features are its
log-likelihood ratio per letter, per square root of its length, and that of its
most telling passage; a logistic fit on texts the models have not seen turns
them into a score.

Letters of all scripts are themselves, in lower case. The model is a table of
n-grams, as text, which grows with the corpus; for scoring, hashes of 64 bits
stand for n-grams. A model of checked size is sent to the tasks that read the
texts; of a larger one, buckets of texts of bounded size get the ratios of their
own n-grams by a join. Both give the same scores.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termeval.durable import materialise
from termeval.llm.language import _points
from termeval.llm.shared import ODD, fold, map_slices, mixed, release, slices

ORDER = 5
# Discounts are estimated from the counts; this stands for one that cannot be.
DISCOUNT = 0.75
# Letters in the most telling passage.
PASSAGE = 32
# A model of up to so many ratios (16 bytes each) is sent to every task.
BROADCAST_RATIOS = 2_000_000
# Bytes of text that are scored together otherwise, save for a single longer text.
BUCKET_BYTES = 4_000_000
# Different n-grams a task gathers before it hands them on, and how many it hands on at once.
GATHERED, HANDED = 250_000, 50_000
# Bytes of text whose n-grams are counted or looked up at once, save for a single longer text.
COUNTED_CHARS = 250_000
# Up to so many labels are sent to every task; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
# Rows the logistic fit takes at most: a bounded sample of labelled texts, by hash of the id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
BLANK = 32


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point: one for all blanks, one for all digits, else itself in lower case."""
    found = np.arange(0x110000, dtype=np.uint32)
    for p in range(0x110000):
        c = chr(p)
        lower = c.lower()
        if c.isspace():
            found[p] = BLANK
        elif unicodedata.category(c)[0] == "N":
            found[p] = ord("0")
        elif len(lower) == 1:
            found[p] = ord(lower)
    # Text ends at a zero in numpy.
    found[0] = BLANK
    return found


def padded(points: np.ndarray) -> np.ndarray:
    """The symbols of a text behind ``ORDER`` blanks; runs of blanks count as one."""
    own = symbols()[points]
    if len(own):
        own = own[np.concatenate([[True], (own[1:] != BLANK) | (own[:-1] != BLANK)])]
    return np.concatenate([np.full(ORDER, BLANK, dtype=np.uint32), own])


def hashes_of(own: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram of ``order`` symbols that ends at each symbol, from the last of the padding on."""
    n = len(own) - ORDER + 1
    wide = own.astype(np.uint64) + np.uint64(1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(order):
        total += wide[ORDER - 1 - i : ORDER - 1 - i + n] * np.uint64(pow(int(ODD), i, 1 << 64))
    return mixed(total + np.uint64(order)).view(np.int64)


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Hashes, parts, counts and symbols, each hash of a part once."""
    keys, parts, counts, grams = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((keys, parts))
    keys, parts = keys[order], parts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])]))
    return keys[first], parts[first], np.add.reduceat(counts[order], first), grams[order[first]]


def count(texts: DataFrame) -> DataFrame:
    """How often each n-gram of ``ORDER`` letters occurs: ``gram``, ``part`` and ``n``.

    ``texts`` has ``text`` and ``part``, a small number by which counts are kept
    apart. Tasks count what they have read before they hand it on.
    """

    def shown(_, parts, counts, grams):
        for at in range(0, len(grams), HANDED):
            some = slice(at, at + HANDED)
            texts = np.ascontiguousarray(grams[some]).view(f"<U{ORDER}").ravel().tolist()
            columns = [pa.array(texts, pa.string()), pa.array(parts[some], pa.int64()), pa.array(counts[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "part", "n"])

    def run(batches):
        held, size, bound = [], 0, GATHERED
        for batch in slices(batches, chars=COUNTED_CHARS):
            parts = batch.column("part").to_numpy()
            found = [padded(x) for x in _points(batch)]
            sizes = [len(x) - ORDER for x in found]
            if not sum(sizes):
                continue
            keys = np.concatenate([hashes_of(x, ORDER)[1:] for x in found])
            grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, ORDER)[1:] for x in found])
            held.append(_merged([(keys, np.repeat(parts, sizes), np.ones(len(keys), dtype=np.int64), grams)]))
            size += len(held[-1][0])
            if size >= bound:
                held = [_merged(held)]
                size = len(held[0][0])
                if size >= GATHERED:
                    yield from shown(*held[0])
                    held, size = [], 0
                bound = size + GATHERED
        if held:
            yield from shown(*_merged(held))
        held.clear()
        release()

    found = texts.select("text", F.col("part").cast("long").alias("part")).mapInArrow(run, "gram string, part long, n long")
    return found.groupBy("gram", "part").agg(F.sum("n").alias("n"))


def discount(counts: DataFrame, column: str) -> float:
    """The estimate of absolute discounting, from how many counts are 1 and 2."""
    once, twice = counts.agg(F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)).first()
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def _discounted(column: str, by: float) -> Column:
    return F.greatest(F.col(column) - by, F.lit(0.0))


def _shared(grams: DataFrame) -> DataFrame:
    """``end`` and ``shared``, the shared probability of its last letter, from kinds of letters before it.

    ``end`` has the last ``ORDER - 1`` letters of n-grams.
    """
    kinds, above = {}, grams.select("gram")
    for k in range(ORDER - 1, 0, -1):
        above = above.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.count("*").alias("kinds"))
        above = kinds[k] = materialise(above, "letter-kinds")
    total, letters = kinds[1].agg(F.sum("kinds"), F.count("*")).first()
    total = max(total or 0, 1)
    # One more stands for all letters that were never seen.
    by = discount(kinds[1], "kinds")
    even = by * letters / total / (letters + 1)
    found = kinds[1].select("gram", (_discounted("kinds", by) / total + even).alias("shared"))
    for k in range(2, ORDER):
        by = discount(kinds[k], "kinds")
        own = kinds[k].withColumns({"history": F.left("gram", F.lit(k - 1)), "end": F.right("gram", F.lit(k - 1))})
        totals = own.groupBy("history").agg(F.sum("kinds").alias("total"), F.count("*").alias("types"))
        value = (_discounted("kinds", by) + by * F.col("types") * F.col("shared")) / F.col("total")
        found = own.join(totals, "history").join(found.withColumnRenamed("gram", "end"), "end")
        found = found.select("gram", value.alias("shared"))
    return found.withColumnRenamed("gram", "end")


def keyed(ratios: DataFrame) -> DataFrame:
    """``key``, the hash of ``gram``, and ``ratio``."""

    def run(batches):
        for batch in batches:
            keys = np.zeros(batch.num_rows, dtype=np.int64)
            sizes = pa.compute.utf8_length(batch.column("gram")).to_numpy()
            points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                total = np.zeros(len(at), dtype=np.uint64)
                for i in range(size):
                    symbol = points[starts[at] + size - 1 - i].astype(np.uint64) + np.uint64(1)
                    total += symbol * np.uint64(pow(int(ODD), i, 1 << 64))
                keys[at] = mixed(total + np.uint64(size)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("ratio")], names=["key", "ratio"])

    return ratios.select("gram", "ratio").mapInArrow(run, "key long, ratio double")


class Model:
    """``ratios``, the log ratio (``ratio``) of each n-gram and of any other by its history (``key``), and the logistic fit."""

    def __init__(self, ratios: DataFrame, weights=None):
        self.ratios, self.weights = ratios, weights


def model_of(counts: DataFrame, toxic: set[int], ordinary: set[int]) -> Model:
    """The model of the given parts of ``counts``."""

    def of(parts: set[int]) -> Column:
        return F.sum(F.when(F.col("part").isin(list(parts)), F.col("n")).otherwise(0))

    sides = ("1", "0")
    grams = counts.where(F.col("part").isin(list(toxic | ordinary))).groupBy("gram")
    grams = materialise(grams.agg(of(toxic).alias("n1"), of(ordinary).alias("n0")), "letter-grams")
    grams = grams.withColumns({"history": F.left("gram", F.lit(ORDER - 1)), "end": F.right("gram", F.lit(ORDER - 1))})
    by = {x: discount(grams, f"n{x}") for x in sides}
    histories = grams.groupBy("history").agg(
        *(F.sum(f"n{x}").alias(f"total{x}") for x in sides), *(F.count_if(F.col(f"n{x}") > 0).alias(f"kinds{x}") for x in sides)
    )
    rest = {x: F.when(F.col(f"total{x}") > 0, by[x] * F.col(f"kinds{x}") / F.col(f"total{x}")).otherwise(1.0) for x in sides}
    histories = histories.withColumns({f"rest{x}": rest[x] for x in sides})
    log = {
        x: F.log(
            _discounted(f"n{x}", by[x]) / F.greatest(F.col(f"total{x}"), F.lit(1)) + F.col(f"rest{x}") * F.col("shared")
        )
        for x in sides
    }
    seen = grams.join(histories, "history").join(_shared(grams), "end").select("gram", (log["1"] - log["0"]).alias("ratio"))
    other = histories.select(F.col("history").alias("gram"), (F.log("rest1") - F.log("rest0")).alias("ratio"))
    return Model(materialise(keyed(seen.unionByName(other)), "letter-ratios"))


def _asked(rows: pa.Table) -> pa.Table:
    """The different n-grams and histories of a bucket."""
    found = [padded(x) for batch in rows.to_batches() for x in _points(batch)]
    own = np.unique(np.concatenate([hashes_of(x, ORDER)[1:] for x in found]))
    history = np.unique(np.concatenate([hashes_of(x, ORDER - 1)[:-1] for x in found]))
    keys = np.concatenate([own, history])
    return pa.table({"bucket": pa.array(np.full(len(keys), rows.column("bucket")[0].as_py()), pa.int64()), "key": pa.array(keys, pa.int64())})


def _features(values: np.ndarray) -> tuple[float, float, float]:
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    span = min(PASSAGE, n)
    best = (sums[span:] - sums[:-span]).max() / span
    return sums[-1] / n, sums[-1] / np.sqrt(n), float(best)


class Ratios:
    """The ratio of each n-gram, or of its history where the model lacks it, or 0."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        # The last one stands for all that the model does not know.
        self.keys, self.ratios = keys[order], np.append(ratios[order], 0.0)

    def place(self, asked: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.keys, asked)
        hit = found < len(self.keys)
        hit[hit] = self.keys[found[hit]] == asked[hit]
        return np.where(hit, found, len(self.keys))

    def features(self, texts: list[np.ndarray]) -> list[tuple[float, float, float]]:
        """The features of texts, given as padded symbols."""
        if not texts:
            return []
        # Texts follow each other, so that the hashes of all are made at once: what is
        # before a text is its own padding.
        whole = np.concatenate(texts)
        edges = np.cumsum([len(x) for x in texts])
        inside = np.concatenate([np.arange(b - len(x) + ORDER, b) for x, b in zip(texts, edges.tolist())])
        own, first, inverse = np.unique(
            hashes_of(whole, ORDER)[inside - ORDER + 1], return_index=True, return_inverse=True
        )
        at = self.place(own)
        unknown = np.flatnonzero(at == len(self.keys))
        history = hashes_of(whole, ORDER - 1)[inside[first[unknown]] - ORDER]
        at[unknown] = self.place(history)
        values = self.ratios[at][inverse]
        return [_features(x) for x in np.split(values, np.cumsum([len(x) - ORDER for x in texts])[:-1])]


def features(df: DataFrame, model: Model, keep: tuple[Column, ...]) -> DataFrame:
    """``kept``, a struct of ``keep``, and ``features array<double>`` of the column ``text``."""
    # Kept columns travel as one, so that none of their names can clash.
    rows = df.select("text", F.struct(*keep).alias("kept"))
    schema = rows.select("kept", F.lit(None).cast("array<double>").alias("features")).schema

    def shown(kept: pa.Array, found: list) -> list:
        return [kept, pa.array(found, pa.list_(pa.float64()))]

    if model.ratios.limit(BROADCAST_RATIOS + 1).count() <= BROADCAST_RATIOS:
        known = model.ratios.select("key", "ratio").toArrow()
        shipped = df.sparkSession.sparkContext.broadcast((known.column("key").to_numpy(), known.column("ratio").to_numpy()))

        def make():
            ratios = Ratios(*shipped.value)

            def run(batch):
                found = ratios.features([padded(x) for x in _points(batch)])
                return pa.RecordBatch.from_arrays(shown(batch.column("kept"), found), names=["kept", "features"])

            return run

        return map_slices(rows, make, schema, chars=COUNTED_CHARS)

    buckets = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES + 1
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("text", "kept"), F.lit(buckets)))
    asked = dealt.groupBy("bucket").applyInArrow(_asked, "bucket long, key long")
    known = asked.join(model.ratios, "key").select("bucket", "key", "ratio")

    def scored(rows: pa.Table, known: pa.Table) -> pa.Table:
        ratios = Ratios(known.column("key").to_numpy(), known.column("ratio").to_numpy())
        found = ratios.features([padded(x) for batch in rows.to_batches() for x in _points(batch)])
        return pa.Table.from_arrays(shown(rows.column("kept").combine_chunks(), found), names=["kept", "features"])

    return dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(scored, schema)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Means, deviations and weights of a logistic fit by Newton's steps, lightly held to 0."""
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    w = np.zeros(z.shape[1])
    hold = np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + hold @ w
        bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + hold
        w -= np.linalg.solve(bend, slope)
    return np.array([mean, deviation, w[1:], np.full(x.shape[1], w[0])])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Both models and the fit, from rows with a label of 0 or 1; other labels are left out.

    Counts cover every labelled text. For the fit, models without the rows whose
    crc32 of the id, mod 4, is 3 score a sample of at most ``FIT_ROWS`` of those.
    Without labelled rows of both kinds every text scores the share of toxic ones.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(text_col).alias("text"),
        F.col(label_col).cast("int").alias("toxic"),
        fold(F.col(id_col)).alias("fold"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("order"),
    )
    apart = F.col("fold") == 3
    counts = materialise(
        count(rows.select("text", (F.col("toxic") * 2 + apart.cast("int")).alias("part"))), "letter-counts"
    )
    without = model_of(counts, {2}, {0})
    sample = features(rows.where(apart), without, (F.col("toxic"), F.col("order"))).select("kept.*", "features").orderBy("order").limit(FIT_ROWS)
    found = sample.toPandas()
    model = model_of(counts, {2, 3}, {0, 1})
    x = np.array(found["features"].tolist(), dtype=float).reshape(-1, 3)
    y = found["toxic"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(x, y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        base = np.log((share + 1e-6) / (1 - share + 1e-6))
        model.weights = np.array([[0.0] * 3, [1.0] * 3, [0.0] * 3, [base] * 3])
    return model


def score(df: DataFrame, model: Model, keep: tuple[Column, ...] = (), text_col: str = "text") -> DataFrame:
    """``keep``, ``score double`` (0 to 1) and ``predicted int`` of every text.

    Null and empty texts have features of 0 and the score that belongs to them.
    Repeated rows come out as often as they went in; only ``keep`` is kept.
    """
    mean, deviation, weights, base = model.weights.tolist()
    found = features(df.withColumn("text", F.col(text_col)), model, keep)
    total = F.lit(base[0])
    for i, (m, d, w) in enumerate(zip(mean, deviation, weights)):
        total = total + (F.col("features")[i] - m) / d * w
    found = found.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0)))))
    return found.select("kept.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def labelled(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``id_col``, ``text`` and the label of the documents that have one; the least of several labels."""
    own = labels.groupBy(id_col).agg(F.min(label_col).alias(label_col)).where(F.col(label_col).isNotNull())
    if labels.count() <= BROADCAST_LABELS:
        own = F.broadcast(own)
    return documents.select(id_col, "text").join(own, id_col)
