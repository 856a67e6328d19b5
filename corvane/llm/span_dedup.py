"""Operator 5. Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in ``.``, ``!`` or ``?`` or that a line feed follows.  Every run of ``run``
consecutive sentences is hashed (three unless the caller says otherwise, however short they are), over words with ASCII letters lower-cased;
longer repeats are met by the runs they hold.  All runs of all documents meet in one aggregation; of equal runs the
first by (doc_id, place) stays, and every sentence that any other covers is removed.
Equal runs are counted before they are joined back, and a run that a large part of all documents share is
one row on the small side, so that its occurrences can be split.

Passages that hold no such run (one or two long sentences, or cut off inside sentences) are met word by word: of every
50 words of a text the piece of 38 words with the smallest hash goes into the same aggregation, so two copies of
any 50 words share a piece.  Later copies of a piece are removed too; of a repeat of 50 words or more at most
12 words at each end stay.  A copy that overlaps the first within its document is removed from behind it.

Defined cases: null text stays null and empty text empty, without sentences; texts under ``run`` sentences stay whole
unless they have 50 words; very long texts are handled whole.  A document is an id with a text: rows equal in both are one document (equal
places in them are one occurrence, so they keep or lose the same), rows that share an id alone are documents of their own, and so are
rows without an id, which come last and are removed from like others.  Only marks of a document's own places are gathered, so a
cell grows with its text alone.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut, slices
from corvane.llm.wordhash import mix64, scan_words

_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Words of a piece, and neighbouring pieces of which the one with the smallest hash is taken: 38 + 13 - 1 = 50 words.
PIECE, REACH = 38, 13


def _sentences(texts: list[str | None]):
    """Word hashes, first word of each sentence (and the total at the end), text of each sentence, word byte starts, buffer."""
    hashes, starts, raw, counts = scan_words(texts)
    n = len(hashes)
    if n == 0:
        return hashes, np.zeros(1, np.int64), np.zeros(0, np.int64), starts, raw
    # the last byte of each word, and whether a line feed stands before the next word
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    gap = np.flatnonzero(space[1:] & ~space[:-1])
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    ends = _ENDS[raw[gap]] | (feeds[np.append(starts[1:], len(raw))] > feeds[gap])
    owner = np.repeat(np.arange(len(counts)), counts)
    ends[:-1] |= owner[1:] != owner[:-1]
    ends[-1] = True
    first = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return hashes, first, owner[first[:-1]], starts, raw


def _spans(texts: list[str | None], run: int):
    """Of all runs: hash, text, first sentence (in the text), number of sentences; the same of pieces, with the first word
    and 0; and of each sentence its text and bytes."""
    hashes, first, owner, starts, raw = _sentences(texts)
    n = len(owner)
    none = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), none, none, none, owner, first, starts, raw
    word_text = np.repeat(owner, np.diff(first))
    head = np.searchsorted(owner, owner, side="left")
    a = np.flatnonzero(owner[: n - run + 1] == owner[run - 1 :]) if n >= run else none  # runs that stay in their text
    b = a + run
    # prefix sums of words times powers give the hash of any run; the power of its first word is divided out
    with np.errstate(over="ignore"):
        power, back = _powers(len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
        value = (sums[first[b]] - sums[first[a]]) * back[first[a]]
        value = mix64(value + (first[b] - first[a]).astype(np.uint64))
        pieces = mix64((sums[PIECE:] - sums[:-PIECE]) * back[: len(hashes) - PIECE + 1] ^ _STEP) if len(hashes) >= PIECE else sums[:0]
    at = _lowest(pieces, word_text)
    text = np.concatenate([owner[a], word_text[at]])
    order = np.argsort(text, kind="stable")
    place = np.concatenate([a - head[a], at - np.searchsorted(word_text, word_text[at], side="left")])
    size = np.concatenate([b - a, np.zeros(len(at), np.int64)])
    return np.concatenate([value, pieces[at]])[order], text[order], place[order], size[order], owner, first, starts, raw


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``n`` neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = f(x[:-step], x[step:]), have + step
    return x


def _lowest(pieces: np.ndarray, word_text: np.ndarray) -> np.ndarray:
    """First words of the pieces that have the smallest hash of some ``REACH`` neighbours of one text."""
    if len(pieces) < REACH:
        return np.zeros(0, np.int64)
    low = _slide(pieces, REACH, np.minimum)
    low = np.where(word_text[: len(low)] == word_text[PIECE + REACH - 2 :], low, np.uint64(0))
    best = _slide(np.pad(low, REACH - 1), REACH, np.maximum)
    return np.flatnonzero((best == pieces) & (best > 0))


_TABLE = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    global _TABLE
    if len(_TABLE[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _TABLE = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x)]), dtype=np.uint64) for x in (_STEP, inverse))
    return _TABLE[0][:n], _TABLE[1][:n]


def _emit(run: int):
    def go(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value, text, start, n, *_ = _spans(part.column(2).to_pylist(), run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), *(part.column(i).take(pa.array(text)) for i in (0, 1)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["span", "doc_id", "row", "at", "n"]
                )

    return go


def _apply(run: int):
    def go(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts, marks = part.column(1).to_pylist(), part.column(2)
                value, text, start, n, owner, first, starts, raw = _spans(texts, run)
                sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
                heads = np.cumsum(sizes) - sizes
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                base = np.concatenate([[0], np.cumsum([0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts])])
                removed, dropped, ranges, origins = [], [], [], []
                for i in range(len(texts)):
                    found = marks[i].as_py()
                    # sentence k of the text has its words edge[k] to edge[k + 1]
                    edge = first[heads[i] : heads[i] + sizes[i] + 1]
                    edge = edge - edge[0]
                    gone = np.zeros(edge[-1], dtype=bool)
                    own, spans = [], set()
                    if found:
                        lo, hi = bounds[i], bounds[i + 1]
                        here = {(int(s), int(k)): int(v) for s, k, v in zip(start[lo:hi], n[lo:hi], value[lo:hi].view(np.int64), strict=True)}
                        for f in found:
                            if here.get((f["at"], f["n"])) == f["span"]:
                                if f["n"]:
                                    gone[edge[f["at"]] : edge[f["at"] + f["n"]]] = True
                                else:
                                    gone[f["since"] : f["at"] + PIECE] = True
                                spans |= {f["first"]} - {None}
                    if gone.any():
                        # a word runs from its first byte to the next word's
                        offset, w = base[i] + i, first[heads[i]]
                        byte = np.append(starts[w : w + len(gone)] - offset, base[i + 1] - base[i])
                        data = raw[offset : offset + byte[-1]].tobytes()
                        flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        kept, last = [], 0
                        for s, e in zip(byte[flips[::2]], byte[flips[1::2]], strict=True):
                            own.append({"start": len(data[:s].decode("utf-8", "surrogatepass")), "end": len(data[:e].decode("utf-8", "surrogatepass"))})
                            kept.append(data[last:s])
                            last = e
                        texts[i] = b"".join([*kept, data[last:]]).decode("utf-8", "surrogatepass")
                    removed.append(int(np.logical_or.reduceat(gone, edge[:-1]).sum()) if sizes[i] else 0)
                    dropped.append(int(gone.sum()))
                    ranges.append(own)
                    origins.append(sorted(spans))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(dropped, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(origins, pa.list_(pa.int64())), pa.array(texts, pa.string())],
                    ["doc_id", "n_sentences", "n_removed", "words_removed", "removed", "first_in", "text"],
                )

    return go


def remove_repeats(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_sentences, n_removed`` (sentences that lose words), ``words_removed``,
    ``removed`` (character ranges of the given text), ``first_in`` (documents that keep what was removed)
    and ``text`` without the removed ranges."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    spans = cut(source.mapInArrow(_emit(run), "span long, doc_id long, row long, at int, n int"))
    # counts alone decide which runs go on; written out, so that the join's sides are plain shuffles, of which adaptive execution can split a hot one
    repeated = cut(spans.groupBy("span").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("span"))
    again = cut(spans.join(repeated, "span"))
    first = again.groupBy("span").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row", "at")).alias("first"))
    first = cut(first.select("span", F.col("first.doc_id").alias("first"), F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")))
    later = again.join(first, "span").filter("row <> first_row or at <> first_at")
    since = F.when(F.col("row") == F.col("first_row"), F.greatest("at", F.col("first_at") + PIECE)).otherwise(F.col("at"))
    marks = later.groupBy("row").agg(F.collect_set(F.struct("at", "n", "span", "first", since.alias("since"))).alias("marks"))
    joined = source.join(marks, "row", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_apply(run), "doc_id long, n_sentences long, n_removed long, words_removed long, removed array<struct<start:long,end:long>>, first_in array<long>, text string")
