"""Weak labels: spans from a dictionary table and from patterns, overlaps settled by weight, and tags of the tokens.

A span weighs its priority times its characters.  Of spans that overlap those are kept that weigh most together; of equal choices the
one that the spans' order by end, start and label gives first.  Overlapping spans form clusters, which are settled one at a time as the sorted
spans pass, so that no text's spans are held as a whole.

Defined cases: null and empty texts have no spans; spans that repeat, or differ in label alone, overlap each other; a span without a whole
token gives no tag; empty matches of a pattern are none; very long texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.dictionary import likely_matches, token_places, with_runs


def _pattern_spans(patterns: Sequence[tuple]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(label, re.compile(p), weight, signs) for label, p, weight, *signs in patterns]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, m.start(), m.end(), label, weight) for i, t in enumerate(part.column(1).to_pylist()) if t for label, p, weight, signs in known if not signs or any(x in t for x in signs) for m in p.finditer(t) if m.end() > m.start()]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32())],
                    ["key", "start", "end", "label", "priority"],
                )

    return run


def weak_spans(df: DataFrame, key: str, text: str, terms: DataFrame, patterns: Sequence[tuple]) -> DataFrame:
    """``key, start, end, label, priority``: every span that a term of ``terms(term, label, priority)`` or a pattern finds.

    A pattern is a label, a regular expression and a priority; pieces of text may follow, of which each match holds one at least, so that texts
    without them need not be searched.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string"))
    known = terms.select(F.col("term").cast("string")).filter(F.col("term").rlike(r"\S")).distinct()
    named = with_runs(known).join(terms, "term").select("run", "label", "priority").distinct()
    found = likely_matches(df, key, text, known).join(named, "run").select("key", "start", "end", "label", F.col("priority").cast("int").alias("priority"))
    shaped = rows.mapInArrow(_pattern_spans(patterns), f"key {kind}, start int, end int, label string, priority int")
    return found.unionByName(shaped).withColumnRenamed("key", key)


def heaviest(spans: list[tuple]) -> list[tuple]:
    """The spans without overlap that weigh most together; spans are (start, end, label, priority, whatever else) in order of end, start, label."""
    ends, best, take = [s[1] for s in spans], [0], []
    for i, (start, end, _, priority, *_) in enumerate(spans):
        before = bisect_right(ends, start, 0, i)
        with_it = best[before] + priority * (end - start)
        take.append(before if with_it > best[i] else -1)
        best.append(max(best[i], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by key and start: each cluster of overlapping ones to its heaviest choice, which takes one of equal spans."""
    last, reach, waiting = object(), 0, []  # of the cluster that is open: the key, how far it reaches, its spans

    def closed(stops: np.ndarray) -> pa.RecordBatch:
        """The choice from the spans that wait; clusters end before the places in ``stops``."""
        rows, sizes = pa.concat_batches(waiting), np.diff(stops, prepend=0)
        start, end, priority = (rows.column(i).to_numpy() for i in (1, 2, 4))
        met = np.repeat(sizes, sizes) > 1
        kept = ~met & (priority.astype(np.int64) * (end - start) > 0)
        places = np.flatnonzero(met)
        spans = list(zip(end[met].tolist(), start[met].tolist(), rows.column(3).take(pa.array(places)).to_pylist(), priority[met].tolist(), places.tolist(), strict=True))
        done = 0
        for n in sizes[sizes > 1].tolist():
            cluster = [(a, b, label, weight, place) for b, a, label, weight, place in sorted(spans[done : done + n])]
            kept[[s[4] for s in heaviest(cluster)]] = True
            done += n
        return rows.filter(pa.array(kept)).select(["key", "start", "end", "label"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        row = np.cumsum([a != b for a, b in zip(keys, [last, *keys], strict=False)]) << 32  # another key begins beyond all places of the one before
        reaches = np.maximum.accumulate(np.concatenate(([reach], row + batch.column(2).to_numpy())))
        opens = np.flatnonzero(row + batch.column(1).to_numpy() >= reaches[:-1])
        last, reach = keys[-1], reaches[-1] - row[-1]
        if len(opens):
            stops = opens + sum(w.num_rows for w in waiting)
            waiting.append(batch.slice(0, opens[-1]))
            if stops[-1]:
                yield closed(stops[stops > 0])
            waiting = []
        waiting.append(batch.slice(opens[-1] if len(opens) else 0))
    if waiting:
        yield closed(np.array([sum(w.num_rows for w in waiting)]))


def settled(spans: DataFrame, key: str) -> DataFrame:
    """``key, start, end, label`` of the spans that are kept."""
    kind = spans.schema[key].dataType.simpleString()
    dealt = spans.select(F.col(key).alias("key"), "start", "end", "label", "priority").repartition("key").sortWithinPartitions("key", "start")
    return dealt.mapInArrow(_settle, f"key {kind}, start int, end int, label string").withColumnRenamed("key", key)


def _tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags of texts from their spans, sorted: a token belongs to the first span that ends behind its start, if that holds it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            start, end, label = part.column(2).flatten().flatten()
            label, n_spans = label.dictionary_encode(), pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy()
            start, end, code, names = start.to_numpy(), end.to_numpy(), label.indices.to_numpy(), label.dictionary.to_pylist()
            tags, n_tokens, done = [np.zeros(0, dtype=np.int64)], [], 0
            for text, n in zip(part.column(1).to_pylist(), n_spans.tolist(), strict=True):
                a, b = token_places(text)
                out = np.zeros(len(a), dtype=np.int64)
                if n:
                    s = slice(done, done := done + n)
                    i = np.searchsorted(np.maximum.accumulate(end[s]), a, "right")
                    inside = np.flatnonzero(i < n)
                    inside = inside[(start[s][i[inside]] <= a[inside]) & (b[inside] <= end[s][i[inside]])]
                    i = i[inside]
                    out[inside] = 1 + code[s][i] + len(names) * (i == np.concatenate(([-1], i[:-1])))
                tags.append(out)
                n_tokens.append(len(a))
            known = pa.array(["O", *[f"B-{x}" for x in names], *[f"I-{x}" for x in names]])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_tokens))), pa.int32()), known.take(pa.array(np.concatenate(tags))))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "tags"])


def tags(df: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """``key, tags``: a tag for each token (words and single signs), B- where a span begins, I- within, O elsewhere."""
    by = spans.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("s"))
    met = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(by, F.col("key").eqNullSafe(F.col("_key")), "left")
    kind = df.schema[key].dataType.simpleString()
    return met.select("key", "_text", "s").mapInArrow(_tagged, f"key {kind}, tags array<string>").withColumnRenamed("key", key)
