"""Terms of a large dictionary table found in texts: longest matches from the left, and what is left of the text.

A text is a run of tokens, each a word or one other sign; a term matches where its tokens stand, in any case, with white space where
it has some (any kind and number) and none where it has none, so whole words only: 'java' is not found in 'javascript', 'c++' is
found in 'C++,'.  Where matches overlap, the one that begins first is taken, of those the longest, and the search goes on behind it.

Plan: texts are read in Arrow batches, where rolling hashes of all runs of up to the longest term's tokens are looked up in a bitmap.
That is the only thing sent to all tasks, and its size is fixed, whatever the dictionary's.  Runs that pass are joined to the
dictionary by their text, so the bitmap's false hits end there.  Overlaps are settled in one pass over the matches sorted by text and
place; positions alone are held.

Defined cases: null and empty texts have no matches and keep as remainder what they are ('' for null); blank and null terms and
repeated ones count for nothing; an empty dictionary finds nothing; keys must be unique for remainders; texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: A token: a word, or a sign that is neither part of a word nor white space.
TOKEN = r"\w+|[^\w\s]"
_BITS = 1 << 24
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What a character is: part of a word, one whose lower case hangs on its neighbours or is longer, a sign; not met yet.
_SPACE, _WORD, _ODD, _SIGN, _NEW = 0, 1, 3, 4, 255
#: By code point, filled as characters are met: what it is, and its lower case (0 for white space).
_KINDS = np.full(0x110000, _NEW, dtype=np.uint8)
_NUMBERS = np.zeros(0x110000, dtype=np.uint64)


def _squeezed(term: str) -> str:
    """A term as it is compared: lower case, white space as one space, none around signs' ends."""
    return " ".join(term.lower().split())


def _met(points: np.ndarray) -> np.ndarray:
    """What each of the characters is."""
    kinds = _KINDS[points]
    if (new := kinds == _NEW).any():
        for p in np.unique(points[new]).tolist():
            c = chr(p)
            odd = c == "\u03a3" or len(c.lower()) > 1  # capital sigma, dotted capital I
            _KINDS[p] = _SPACE if re.match(r"\s", c) else _SIGN if not re.match(r"\w", c) else _ODD if odd else _WORD
            if _KINDS[p] != _SPACE and not odd:
                _NUMBERS[p] = ord(c.lower())
        kinds = _KINDS[points]
    return kinds


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _places(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner, last = np.zeros(len(kinds), dtype=bool), kinds != _SPACE
    inner[1:] = kinds[1:] & kinds[:-1] & _WORD  # a word goes on
    starts = np.flatnonzero(last & ~inner)
    last[:-1] &= ~inner[1:]
    return starts, np.flatnonzero(last) + 1


def token_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the text's tokens begin and end, as ``TOKEN`` finds them."""
    return _places(_met(_points(text)))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a number, and those that undo them."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n - 1, x, dtype=np.uint64)))) for x in (_STEP, pow(int(_STEP), -1, 1 << 64)))


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' starts and ends, and a number of each token's lower case that also says whether white space stands before it."""
    points = _points(text)
    kinds = _met(points)
    starts, ends = _places(kinds)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    powers, undone = _powers(1 << len(points).bit_length())
    codes = np.add.reduceat(_NUMBERS[points] * powers[: len(points)], starts) * undone[starts]
    odd = kinds == _ODD
    for i in np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1).tolist() if odd.any() else ():
        low = _points(text[starts[i] : ends[i]].lower())
        _met(low)
        codes[i] = (_NUMBERS[low] * powers[: len(low)]).sum()
    spaced = starts > np.concatenate(([0], ends[:-1]))
    return starts, ends, (codes ^ codes >> np.uint64(32)) << np.uint64(1) | spaced.astype(np.uint64)


def _runs(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 1, 2, ...: hashes of the runs of n tokens that begin at each token; white space before the first does not count."""
    with np.errstate(over="ignore"):
        own = (codes >> np.uint64(1)) * _STEP
        value = own ^ (own >> np.uint64(29))
        for n in range(1, min(longest, len(codes)) + 1):
            if n > 1:
                value = value[:-1] * _STEP + codes[n - 1 :]
                value ^= value >> np.uint64(32)
            yield n, (value * _STEP) >> np.uint64(40)  # 24 bits


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the bits of its terms, and the number of tokens of the longest."""
    bits, longest = np.zeros(_BITS, dtype=bool), 0
    for batch in batches:
        for term in batch.column(0).to_pylist():
            *_, codes = _codes(term)
            longest = max(longest, len(codes))
            bits[[int(h[0]) for n, h in _runs(codes, len(codes)) if n == len(codes)]] = True
    yield pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], ["longest", "bits"])


def _with_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms beside the form in which they are compared, made as it is for texts."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_squeezed(t) for t in batch.column(0).to_pylist()], pa.string())], ["term", "run"])


def _bitmap(terms: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of the whole dictionary: at most 2 MB a task, of a bounded number of tasks."""
    parts = terms.coalesce(16).mapInArrow(_bitmaps, "longest long, bits binary").collect()
    bits = np.zeros(_BITS // 8, dtype=np.uint8)
    for p in parts:
        bits |= np.frombuffer(zlib.decompress(p["bits"]), dtype=np.uint8)
    return max((p["longest"] for p in parts), default=0), bits


def _candidates(longest: int, bits: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, starts, ends, runs = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    begin, end, codes = _codes(text or "")
                    for n, h in _runs(codes, longest):
                        hit = np.flatnonzero(bits[h >> np.uint64(3)] >> (np.uint8(7) - (h & np.uint64(7)).astype(np.uint8)) & 1)
                        a, b = begin[hit].tolist(), end[hit + n - 1].tolist()
                        keys += [i] * len(a)
                        starts += a
                        ends += b
                        runs += [_squeezed(text[x:y]) for x, y in zip(a, b, strict=True)]
                taken = part.column(0).take(pa.array(keys, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(runs, pa.string())], ["key", "start", "end", "run"])

    return run


def _leftmost(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of matches sorted by key, start and length (longest first) those that no earlier one overlaps."""
    last, end = object(), -1
    for batch in batches:
        keep = []
        for key, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != last:
                last, end = key, -1
            keep.append(a >= end)
            if a >= end:
                end = b
        yield batch.filter(pa.array(keep, pa.bool_()))


def likely_matches(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``key, start, end, run`` of every run of words that may be a term of ``terms(term)``; a join by ``run`` leaves those that are."""
    longest, bits = _bitmap(terms)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string"))
    return rows.mapInArrow(_candidates(longest, bits), f"key {kind}, start int, end int, run string")


def all_matches(df: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``key, start, end, run`` of every place where a term of the dictionary stands, overlapping ones too; ``run`` is its compared form."""
    known = terms.select(F.col(term).cast("string").alias("term")).filter(F.col("term").rlike(r"\S")).distinct()
    return likely_matches(df, key, text, known).join(with_runs(known).select("run").distinct(), "run").select("key", "start", "end", "run")


def with_runs(terms: DataFrame) -> DataFrame:
    """``term, run``: terms (one column) beside the form in which they are compared."""
    return terms.mapInArrow(_with_runs, "term string, run string")


def find_terms(df: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``key, start, end, term``: the matches taken, with offsets in characters from 0 and the dictionary's spelling (the least of equals)."""
    spelt = with_runs(terms.select(F.col(term).cast("string")).filter(F.col(term).rlike(r"\S"))).groupBy("run").agg(F.min("term").alias("term"))
    found = all_matches(df, key, text, terms, term)
    dealt = found.repartition("key").sortWithinPartitions("key", "start", F.desc("end"))
    kind = df.schema[key].dataType.simpleString()
    taken = dealt.select("key", "start", "end", "run").mapInArrow(_leftmost, f"key {kind}, start int, end int, run string")
    return taken.join(spelt, "run").select(F.col("key").alias(key), "start", "end", "term")


@pandas_udf(StringType())
def _without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    def rest(t: str, a: list[int], b: list[int]) -> str:
        if a is None:
            return " ".join(t.split())
        return " ".join(" ".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True)).split())

    return pd.Series([rest(t, a, b) for t, a, b in zip(text, starts, ends, strict=True)])


def matched_and_rest(df: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``key, terms, n_matches, remainder``: each text's terms (once each, sorted) and what is left of it, white space squeezed."""
    found = find_terms(df, key, text, terms, term)
    spans: Column = F.array_sort(F.collect_list(F.struct("start", "end")))
    by = found.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set("term")).alias("terms"), spans.alias("s"))
    met = df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(by, F.col(key).eqNullSafe(F.col("_key")), "left")
    none = F.array().cast("array<string>")
    return met.select(key, F.coalesce("terms", none).alias("terms"), F.coalesce(F.size("s"), F.lit(0)).alias("n_matches"), _without("_text", F.col("s.start"), F.col("s.end")).alias("remainder"))
