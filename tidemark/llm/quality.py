"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, a feature at a time, then a pair of features at a time; their
sums are lookup tables, one for each feature and one for each pair, over quantile bins.  A score
is the logistic function of the tables' entries added up.  Features are counts of a text's own
bytes, words and lines, computed with numpy for a run of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, bounded_batches, byte_slices, map_arrow, prefix_hash, span_hash, units

#: Labelled documents that the model is fitted on at most: those whose ids have the smallest hashes.
TRAIN_ROWS = 20_000

FEATURES = ("log_bytes", "upper", "digits", "symbols", "bars", "shouts", "stops", "other_punct", "not_ascii", "word_bytes", "line_bytes", "distinct_words", "same_as_previous", "distinct_lines", "marked_words", "no_space_run")


def _class_masks() -> list[np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        mask = np.zeros(256, bool)
        mask[list(chars)] = True
        return mask

    upper = of(bytes(range(65, 91)))
    not_ascii = np.arange(256) >= 128
    return [upper, of(b"0123456789"), of(b"*$%&#@^~=+<>\\{}[]_"), of(b"|"), of(b"!"), of(b".,;:?"), of(b"'\"()-/`"), not_ascii]


CLASSES = _class_masks()
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.logical_or.reduce(CLASSES[2:5])


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner."""
    if not len(owner):
        return np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    first = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(o[first], minlength=n).astype(float)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty one has all zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / some

    out = [np.log1p(size), *[share(mask[data]) for mask in CLASSES]]
    prefix = prefix_hash(data)
    starts, ends, owner = units(SPACE[data], offsets)
    words = np.bincount(owner, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    value = span_hash(prefix, starts, ends)
    out.append(np.bincount(owner, weights=ends - starts, minlength=n) / per_word)
    lines_start, lines_end, lines_owner = units(data == 10, offsets)
    lines = np.bincount(lines_owner, minlength=n).astype(float)
    per_line = np.maximum(lines, 1)
    out.append(np.log1p(np.bincount(lines_owner, weights=lines_end - lines_start, minlength=n) / per_line))
    out.append(_distinct(owner, value, n) / per_word)
    again = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    out.append(np.bincount(owner[1:][again], minlength=n) / per_word)
    out.append(_distinct(lines_owner, span_hash(prefix, lines_start, lines_end), n) / per_line)
    odd = np.concatenate([[0], np.cumsum(ODD[data], dtype=np.int64)])
    out.append(np.bincount(owner[odd[ends] > odd[starts]], minlength=n) / per_word)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, ends - starts)
    out.append(np.log1p(longest))
    return np.nan_to_num(np.stack(out, axis=1))


@dataclass
class AdditiveModel:
    """Bin edges, a table for each feature, and a table for each pair of features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _leaves(gradient: np.ndarray, weight: np.ndarray, splits: int, penalty: float, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: the value of the leaf of each bin."""
    cuts = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    for _ in range(splits):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            left_g, left_h, right_g, right_h = g[at] - g[a], h[at] - h[a], g[b] - g[at], h[b] - h[at]
            gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + penalty)
            gain[(left_h < least) | (right_h < least)] = -1
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), int(at[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + penalty)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, penalty: float = 1.0) -> AdditiveModel:
    """Boost trees of three splits, features in turn, then trees over the pairs that gain most.

    Without rows the score is one half; with one class it is that class's smoothed share.
    """
    model = AdditiveModel()
    ones = float(y.sum())
    model.intercept = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    if ones in (0, len(y)):
        return model
    n_features = x.shape[1]
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(n_features)]
    # values beyond the middle of the distribution also get bins: rare marks are what counts
    for k in range(n_features):
        most = x[:, k].max()
        more = np.linspace(x[:, k].min(), most, 17)[1:-1]
        low = np.array([np.nextafter(x[:, k].min(), np.inf)])
        model.edges[k] = np.unique(np.concatenate([model.edges[k], more, low]))
    binned = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    raw = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(n_features):
            g, h = slope()
            step = rate * _leaves(np.bincount(binned[:, k], g, sizes[k]), np.bincount(binned[:, k], h, sizes[k]), 3, penalty, 1e-3)
            step = np.clip(step, -0.5, 0.5)
            model.tables[k] += step
            raw += step[binned[:, k]]
    # pairs by how much of the residual a table over both explains beyond the two alone
    g, h = slope()

    def explained(codes: np.ndarray, n: int) -> float:
        return float((np.bincount(codes, g, n) ** 2 / (np.bincount(codes, h, n) + penalty)).sum())

    gains = []
    alone = [explained(binned[:, k], sizes[k]) for k in range(n_features)]
    for a in range(n_features):
        for b in range(a + 1, n_features):
            gains.append((explained(binned[:, a] * sizes[b] + binned[:, b], sizes[a] * sizes[b]) - alone[a] - alone[b], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            codes, n = binned[:, a] * sizes[b] + binned[:, b], sizes[a] * sizes[b]
            grid_g, grid_h = np.bincount(codes, g, n).reshape(sizes[a], -1), np.bincount(codes, h, n).reshape(sizes[a], -1)
            # a tree that splits on the first feature and, in each half, on the second
            step = np.empty_like(table)
            halves = _leaves(grid_g.sum(1), grid_h.sum(1), 1, penalty, 1e-3)
            for value in np.unique(halves):
                rows = halves == value
                step[rows] = _leaves(grid_g[rows].sum(0), grid_h[rows].sum(0), 1, penalty, 1e-3)
            step = np.clip(rate * step, -0.5, 0.5)
            table += step
            raw += step.ravel()[codes]
    return model


def id_remainder(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """CRC-32 of doc_id as text (null: the empty text), modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and features (array of doubles) of every text; null text: as empty."""
    schema = T.StructType.fromDDL("doc_id long, features array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column("text")):
                rows = text_features(data, offsets)
                arrays = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), arrays.cast(target.field(1).type)], schema=target)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold, at most ``rows`` of them.

    Labels with a null doc_id or quality teach nothing; a repeated label counts once.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (id_remainder() != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    # features of at most ``rows`` labelled ids go to the driver; repeated rows of one id count once
    table = feature_rows(texts).groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas()
    x = np.stack(table["features"].to_list()) if len(table) else np.zeros((0, len(FEATURES)))
    return fit(x, table["quality"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row.

    Null and empty texts are scored by their (zero) features.  Equal texts have equal scores.
    """
    schema = T.StructType.fromDDL("doc_id long, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column("text")):
                score = shared.value.score(text_features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(score)], schema=target)

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema)
    return scored.select("doc_id", (id_remainder() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score at least ``threshold``."""

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        out = [shared.value.score(text_features(data, offsets)) for _, _, data, offsets in byte_slices(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.filter(score(F.coalesce("text", F.lit(""))) >= threshold)
