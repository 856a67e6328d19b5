"""Operator 2. Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

1. Examples: of the labelled rows outside the held-out fold, at most ``sample`` of each label, those of the
   smallest id hash.  Texts that repeat count once.  All of them are indexed.
2. Terms: all words of the examples.  A term weighs (1 + ln tf) * idf, with document frequencies counted over all documents.
3. Each text becomes its vector of length 1 over these terms.  The examples' inverted lists are cut into blocks
   of examples, which were ordered so that like ones are neighbours; per term and block the index keeps the largest weight.
   The sum of these maxima bounds every cosine of a block.  The best blocks give a k-th cosine; then every block
   whose bound reaches it is read, and the others are skipped: the neighbours are exact.
4. The ``k`` nearest examples vote, each with weight 1 / (1 - cosine + 0.01) times the label's say: the mean, over the words that it
   shares with the text and by their part in the cosine, of how much the word tells the labels apart (the square of the least lift
   that the examples support, 1 for a word that tells nothing).  So neighbours are those of the plain cosine, and of these the ones near
   for words that matter count most.  Votes become probabilities by isotonic regression on the examples' own votes (each left out of
   its own), weighted back to the labels' true shares.

Defined cases: null and empty texts, and others that share no word with an example, have no neighbours and no evidence;
they get the share of toxic rows among examples like them, or among all where there is none.  Labels other than
0 and 1 and null ids teach nothing; without labels of both kinds every score is the share of label 1 (0.5 without labels).
Equal cosines go to the smaller example id.  Rows that repeat each get a row; very long texts are read
whole.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut, drawn, held_out, list_rows, slices

_TOKEN = re.compile(r"\w+")
#: Examples in a block.
BLOCK = 64


def terms_of(text: str | None) -> Counter:
    """Words of a whole text, in lower case, with their frequencies."""
    return Counter(_TOKEN.findall(text.lower())) if text else Counter()


class BlockMaxIndex:
    """Exact top-k by inner product over sparse rows of length 1, given as (terms, weights); the smaller of ``names`` breaks ties.

    Terms that more than a share ``dense`` of the rows hold are kept as a matrix, whose products are taken for many queries at once;
    the others as inverted lists in blocks with their maxima.  A block is read if the best of its rows so far, with these maxima, can
    reach the k-th.  Sums in single precision choose rows with a margin, the chosen ones are summed again in double precision.
    """

    MARGIN = 1e-5

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, names: np.ndarray | None = None, dense: float = 1 / 16):
        self.names = np.arange(len(rows)) if names is None else names
        self.n, self.blocks, self.terms = len(rows), -(-len(rows) // BLOCK), terms
        sizes = np.array([len(t) for t, _ in rows], dtype=np.int64)
        term = np.concatenate([t for t, _ in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in rows] or [np.zeros(0)])
        row = np.repeat(np.arange(self.n), sizes)
        common = np.flatnonzero(np.bincount(term, minlength=terms) > dense * self.n)
        self.column = np.full(terms, -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        often = self.column[term] >= 0 if len(term) else np.zeros(0, dtype=bool)
        self.matrix = np.zeros((len(common), self.n))
        self.matrix[self.column[term[often]], row[often]] = weight[often]
        self.rough = self.matrix.astype(np.float32)
        term, row, weight = term[~often], row[~often], weight[~often]
        order = np.lexsort((row, term))
        term, self.row, self.weight = term[order], row[order].astype(np.int32), weight[order]
        # a run is the part of a term's list that lies in one block
        key = term * max(1, self.blocks) + self.row // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.start = np.append(first, len(key)).astype(np.int64)
        self.block = (key[first] % max(1, self.blocks)).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.runs = np.searchsorted(term[first], np.arange(terms + 1))

    def common_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each query's sums over the common terms, a row a query."""
        q = np.zeros((len(queries), len(self.matrix)), dtype=np.float32)
        for i, (t, w) in enumerate(queries):
            c = self.column[t]
            q[i, c[c >= 0]] = w[c >= 0]
        return q @ self.rough

    def search(self, query: tuple[np.ndarray, np.ndarray], k: int, skip: int = -1, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of the ``k`` nearest rows with a positive cosine, without row ``skip``; and the number of blocks read."""
        rows, sims, _, read = self.nearest(query, k, skip, sums)
        return rows, sims, read

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, skip: int, sums: np.ndarray | None, say: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As ``search``, with the cosines' sums over again where each term's part is multiplied by ``say``."""
        terms, weights = query
        if self.n == 0 or len(terms) == 0:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0
        sims = (self.common_part([query])[0] if sums is None else sums).astype(np.float64)
        run, n = _ranges(self.runs[terms], self.runs[terms + 1])
        asked, block = np.repeat(np.arange(len(terms)), n), self.block[run]
        if skip >= 0:
            sims[skip] = -4.0
        pad = np.full(self.blocks * BLOCK, -4.0)
        pad[: self.n] = sims
        rare = np.bincount(block, weights[asked] * self.top[run], self.blocks)
        bound = pad.reshape(self.blocks, BLOCK).max(1) + rare
        ahead = np.zeros(self.blocks, dtype=bool)
        ahead[np.argsort(-bound, kind="stable")[: 1 + 2 * k // BLOCK]] = True
        found = [self._read(run, asked, weights, ahead[block])]
        sims += np.bincount(found[0][0], found[0][1], self.n)
        least = np.partition(sims, -k)[-k] if self.n > k else -1.0
        rest = (rare > 0) & (bound >= least - self.MARGIN) & ~ahead
        if rest.any():
            found.append(self._read(run, asked, weights, rest[block]))
            sims += np.bincount(found[1][0], found[1][1], self.n)
            least = np.partition(sims, -k)[-k] if self.n > k else -1.0
        rows = np.flatnonzero((sims > 0) & (sims >= least - self.MARGIN))
        exact, told = self._sums(query, rows, found, say)
        exact = np.round(exact, 12)
        some = np.flatnonzero(exact > 0)
        best = some[np.lexsort((self.names[rows[some]], -exact[some]))[:k]]
        return rows[best], exact[best], told[best], int((ahead | rest).sum())

    def _read(self, run: np.ndarray, asked: np.ndarray, weights: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, products and query's terms of the entries of some runs."""
        run, asked = run[some], asked[some]
        at, n = _ranges(self.start[run], self.start[run + 1])
        asked = np.repeat(asked, n)
        return self.row[at], weights[asked] * self.weight[at], asked

    def _sums(self, query: tuple[np.ndarray, np.ndarray], rows: np.ndarray, found: list, say: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows' inner products in double precision, and those with each term's part times ``say``."""
        terms, weights = query
        c = self.column[terms]
        w, part = weights[c >= 0], self.matrix[np.ix_(c[c >= 0], rows)]
        exact, told = w @ part, (w * say[terms[c >= 0]]) @ part if say is not None else None
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        for row, product, asked in found:
            own = np.flatnonzero(place[row] >= 0)
            exact += np.bincount(place[row[own]], product[own], len(rows))
            if say is not None:
                told += np.bincount(place[row[own]], product[own] * say[terms[asked[own]]], len(rows))
        return exact, exact if told is None else told


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), one after another, and how many each has."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum())), n


def like_order(rows: list[tuple[np.ndarray, np.ndarray]], terms: int, seed: int = 7) -> np.ndarray:
    """An order that brings like rows together: halves are split by the sign of a few power steps towards the main direction."""
    if len(rows) <= BLOCK:
        return np.arange(len(rows))
    rng = np.random.default_rng(seed)

    def split(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= BLOCK:
            return [at]
        sizes = np.array([len(rows[i][0]) for i in at])
        term, weight = np.concatenate([rows[i][0] for i in at]), np.concatenate([rows[i][1] for i in at])
        own = np.repeat(np.arange(len(at)), sizes)
        x = rng.normal(size=len(at))
        for _ in range(4):
            x -= x.mean()
            x = np.bincount(own, np.bincount(term, weight * x[own], terms)[term] * weight, len(at))
        order = np.argsort(x, kind="stable")
        half = -(-len(at) // (2 * BLOCK)) * BLOCK  # whole blocks on the left
        return split(at[order[:half]]) + split(at[order[half:]])

    return np.concatenate(split(np.arange(len(rows))))


class Model:
    """Terms with their weights, the index of all examples, and the calibration of votes."""

    def __init__(self, terms: dict[str, int], weight: np.ndarray, say: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], k: int, prior: float):
        self.terms, self.weight, self.say, self.k = terms, weight, say, k
        self.none, self.x, self.y = prior, np.array([0.0, 1.0]), np.array([prior, prior])
        self.hold(rows, ids, labels)

    def hold(self, rows: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray) -> None:
        """The examples and their index."""
        self.ids, self.labels = ids, labels
        self.index = BlockMaxIndex(rows, len(self.terms), ids)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts = terms_of(text)
        t = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        c = np.fromiter(counts.values(), np.float64, len(counts))[t >= 0]
        t = t[t >= 0]
        v = (1 + np.log(c)) * self.weight[t]
        return t, v / max(np.sqrt((v * v).sum()), 1e-300)

    def vote(self, query: tuple[np.ndarray, np.ndarray], skip: int = -1, sums: np.ndarray | None = None) -> tuple[float | None, np.ndarray]:
        rows, sims, told, _ = self.index.nearest(query, self.k, skip, sums, self.say)
        if len(rows) == 0:
            return None, rows
        w = told / sims / (1 - np.minimum(sims, 1) + 0.01)
        return float((w * self.labels[rows]).sum() / w.sum()), rows

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int]]]:
        """Score and evidence of each text."""
        for at in range(0, len(texts), 32):
            queries = [self.vector(t) for t in texts[at : at + 32]]
            for query, sums in zip(queries, self.index.common_part(queries), strict=True):
                raw, rows = self.vote(query, sums=sums)
                yield (self.none if raw is None else float(np.interp(raw, self.x, self.y))), self.ids[rows].tolist()


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of y on x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, x low, x high
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([b, c, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, n, _, hi = blocks.pop()
            blocks[-1][0] = (blocks[-1][0] * blocks[-1][1] + m * n) / (blocks[-1][1] + n)
            blocks[-1][1] += n
            blocks[-1][3] = hi
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([v for b in blocks for v in (b[0], b[0])])


def _words(batches):
    """Distinct words of each example's text."""
    for batch in batches:
        for part in slices(batch, "text"):
            ys, words = [], []
            for y, t in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
                own = terms_of(t)
                ys += [y] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.float64()), pa.array(words, pa.string())], ["y", "word"])


def _frequencies(terms: dict[str, int]):
    """Of each task's documents, how many hold each term; and, as the last term, how many documents there are."""

    def run(batches):
        total, seen = np.zeros(len(terms) + 1, dtype=np.int64), Counter()

        def fold() -> None:
            for w, n in seen.items():
                if (i := terms.get(w)) is not None:
                    total[i] += n
            seen.clear()

        for batch in batches:
            total[-1] += batch.num_rows
            for part in slices(batch, "text"):
                for t in part.column(0).to_pylist():
                    if t:
                        seen.update(set(_TOKEN.findall(t.lower())))
                if len(seen) > 200_000:
                    fold()
        fold()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return run


def label_say(a: np.ndarray, c: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """The label's say of terms that ``a`` of ``n1`` toxic and ``c`` of ``n0`` other examples hold: the square of the lift, two standard errors lower."""
    lift = np.log((a + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
    return np.exp(2 * np.maximum(0, lift - 2 * np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))))


def _vectors(model: Model):
    def run(batches):
        for part in (part for batch in batches for part in slices(batch, "text")):
            rows = [model.vector(t) for t in part.column(2).to_pylist()]
            sizes = np.array([len(t) for t, _ in rows])
            cells = [list_rows(np.concatenate([r[i] for r in rows]), sizes, kind) for i, kind in ((0, pa.int64()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cells], ["doc_id", "y", "t", "w"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, fold: int = 1, sample: int = 2000, k: int = 50, longest: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """The index of a bounded sample of labelled rows (``sample`` a label, none over ``longest`` bytes), with document frequencies of the whole corpus."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    both = [drawn(known.filter(F.col("y") == y), "doc_id", sample, share.get(y, 0)) for y in (0.0, 1.0)]
    some = F.broadcast(both[0].union(both[1]))  # at most 2 * sample rows of an id and a label
    total = sum(share.values())
    prior = share.get(1.0, 0) / total if total else 0.5
    empty = Model({}, np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), [], k, prior)
    if len(share) < 2:
        return empty
    rows = texts.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)).join(some, "doc_id").select("doc_id", "y", "text")
    rows = cut(rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("doc_id", "y", "text")).alias("m")).select("m.*"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return empty
    words = rows.select("y", "text").mapInArrow(_words, "y double, word string")
    # the words of at most 2 * sample examples
    counts = words.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("c")).orderBy("word").toArrow()
    terms = {w: i for i, w in enumerate(counts.column("word").to_pylist())}
    say = label_say(counts.column("a").to_numpy(), counts.column("c").to_numpy(), n[1.0], n[0.0])
    freq = texts.select("text").mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(terms) + 1)
    seen[freq.column("term").to_numpy()] = freq.column("n").to_numpy()
    model = Model(terms, 1 + np.log((1 + seen[-1]) / (1 + seen[:-1])), say, np.zeros(0, np.int64), np.zeros(0), [], k, prior)
    found = rows.select("doc_id", "y", "text").mapInArrow(_vectors(model), "doc_id long, y double, t array<long>, w array<double>").orderBy("doc_id").toArrow().combine_chunks()
    return _fitted(model, found, share)


def _fitted(model: Model, found: pa.Table, share: dict[float, int]) -> Model:
    """``model`` with its index over the examples found and its calibration by their votes."""
    ids, ys = found.column("doc_id").to_numpy(), found.column("y").to_numpy()
    t, w = (found.column(c).combine_chunks() for c in ("t", "w"))
    at, t, w = t.offsets.to_numpy(), t.values.to_numpy(), w.values.to_numpy()
    rows = [(t[a:b], w[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    order = like_order(rows, len(model.terms))
    rows = [rows[i] for i in order]
    model.hold(rows, ids[order], ys[order])
    weight = np.where(model.labels == 1, share[1.0] / (ys == 1).sum(), share[0.0] / (ys == 0).sum())
    raw = np.array([np.nan if (v := model.vote(r, skip=j)[0]) is None else v for j, r in enumerate(rows)])
    lone = np.isnan(raw)
    if lone.any():
        model.none = float((weight * model.labels)[lone].sum() / weight[lone].sum())
    if not lone.all():
        model.x, model.y = isotonic(raw[~lone], model.labels[~lone], weight[~lone])
    return model


def score(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` (the nearest examples' ids) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(model.scores(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
