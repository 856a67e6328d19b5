"""Operator 8. Quality classifier: histogram gradient-boosted trees over document statistics.

Learning takes at most ``sample`` labelled rows, those of the smallest id hash among the rows outside the
held-out fold; statistics of whole texts are computed on executors, and every document is scored in Arrow
batches by flat arrays of trees.

Defined cases: null and blank texts have all statistics 0 and are scored like any other; labels other than
0 and 1 and null ids teach nothing; rows of one doc_id in the labels are averaged; without labels of both
kinds the score is the share of label 1 (0.5 without labels).  Rows that repeat each get a row.  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut, drawn, held_out, slices
from corvane.llm.trees import Trees, boost

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH[128:] = True
#: Marks counted one by one.
_MARKS = np.frombuffer(b".,!?|#$%&*=<>{}[]()/\\@_-:;\"'", dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text."""
    if not text:
        return [0.0] * WIDTH
    raw = text.encode("utf-8", "surrogatepass")
    bins = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    share = bins / n
    seen = share[share > 0]
    words = text.split()
    count = Counter(words)
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    k = max(1, len(lines))
    letters = max(1, n - int(bins[_SPACE].sum()))
    top = count.most_common(3)
    lengths = np.fromiter(map(len, count), dtype=np.int64, count=len(count)) if count else np.zeros(1, np.int64)
    times = np.fromiter(count.values(), dtype=np.int64, count=len(count)) if count else np.ones(1, np.int64)
    mean = float((lengths * times).sum()) / m
    line_count = Counter(lines)
    ends = sum(x.rstrip()[-1] in ".!?:" for x in lines)
    marks = bins[_MARKS] / letters
    return [
        np.log1p(n), np.log1p(len(words)), mean, float(lengths.max()),
        float(np.sqrt(max(0.0, float((lengths**2 * times).sum()) / m - mean * mean))),
        bins[_UPPER].sum() / letters, bins[_LOWER].sum() / letters, bins[_DIGIT].sum() / letters, bins[_HIGH].sum() / letters,
        1 - (bins[_UPPER].sum() + bins[_LOWER].sum() + bins[_DIGIT].sum() + bins[_HIGH].sum()) / letters,
        float(-(seen * np.log2(seen)).sum()), len(count) / m, (top[0][1] / m) if top else 0.0, sum(c for _, c in top) / m,
        float((times == 1).sum()) / m, np.log1p(len(lines)), len(words) / k, len(line_count) / k,
        (max(line_count.values()) / k) if line_count else 0.0, ends / k, bins[10] / n, text.count(". ") / m,
        text.count("!! ") / m, len(raw) / max(1, len(text)), *marks.tolist(),
    ]


WIDTH = 24 + len(_MARKS)


def _features(batches):
    for part in (part for batch in batches for part in slices(batch, "text")):
        rows = np.array([statistics(t) for t in part.column(1).to_pylist()], dtype=np.float64).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def _scorer(model: Trees):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = np.array([statistics(t) for t in part.column(1).to_pylist()], dtype=np.float64).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.predict(x))], ["doc_id", "score"])

    return run


def sampled_labels(labels: DataFrame, label_col: str, folds: int, fold: int, sample: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``sample`` rows ``doc_id, y`` outside the held-out fold, by the order of a hash of the id."""
    ok = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)")
    one = ok.filter(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    return drawn(one, "doc_id", sample, one.count())


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 4, fold: int = 2, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """The boosted trees of a bounded sample of labelled rows."""
    some = sampled_labels(labels, label_col, folds, fold, sample, id_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the sample has a fixed bound, so it may be broadcast; documents are read once and not shuffled
    texts = texts.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    rows = texts.mapInArrow(_features, "doc_id long, x array<double>").join(F.broadcast(some), "doc_id")
    # rows that repeat an id and its text teach once; written out, so that the driver gets these rows alone
    rows = cut(rows.groupBy("doc_id", "x").agg(F.first("y").alias("y"))).toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["doc_id"].iat[i], list(rows["x"].iat[i])))]
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, WIDTH)
    return boost(x, rows["y"].to_numpy())


def score(docs: DataFrame, model: Trees, folds: int = 4, fold: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Trees, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                x = np.array([statistics(t) for t in part.column(place).to_pylist()], dtype=np.float64).reshape(-1, WIDTH)
                yield part.filter(pa.array(model.predict(x) >= least))

    return docs.mapInArrow(run, schema)
