"""Operator 1. Bounded-space online packing of token sequences.

Each partition packs the documents it reads as they come, with at most ``open_windows`` windows open:
a piece goes into the window it fits best; when none fits and all are open, the fullest takes the head
of the piece to its brim and is emitted.  Pieces of a whole window are emitted at once.  The windows
left open are then merged in groups of ``fan`` partitions, and the groups' last windows again, until one
group is left; only these windows' tokens move between executors, never the texts.

Defined cases: a null text is empty; every document ends with the separator id, so an empty one is that
id alone.  Each input row is packed on its own, also when a doc_id repeats or is null.  A text holding
the tokenizer's special string is encoded as the tokenizer does it (one special id).  Very long texts
are cut at window ends.  Other columns are ignored; an empty table gives no rows.
Sequence ids name round, partition and place, so a rerun of a lost task gives the same ones.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut, group_starts, whole_groups

#: Distinct word pieces whose ids a worker remembers.
CACHE = 400_000
SPECIAL = "<|endoftext|>"
_PIECE = re.compile(r" ?[^ \n]+|\n")
_ODD = re.compile(r"\s\s| \Z")


class Encoder(dict):
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer never joins characters over a single space or line feed that stands
    between two other characters, so such a text is the concatenation of its pieces, and the ids of
    frequent pieces are remembered.  Texts with runs of white space are encoded whole.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.exact = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __missing__(self, piece: str) -> bytes:
        out = self._bytes(self.plain(piece))
        if len(self) < CACHE:
            self[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return self._bytes(self.exact.encode(text, add_special_tokens=False).ids)
        if _ODD.search(text):
            return self._bytes(self.plain(text))
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Encoder:
    return Encoder(tokenizer_path, ranks_path, pattern)


class _Packer:
    """Windows of ``size`` tokens, at most ``most`` open; closed ones' pieces gather in ``out``."""

    def __init__(self, size: int, most: int, first_id: int, with_ids: bool):
        self.size, self.most, self.next, self.with_ids = size, most, first_id, with_ids
        self.open: list[tuple[int, list]] = []  # room, pieces
        self.out: list[tuple] = []

    def _emit(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, is_open, bytes(ids) if is_open or self.with_ids else None))
            offset += n
        self.next += 1

    def add(self, doc, start: int, ids, total: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                self._emit([(doc, start, ids[: 4 * self.size], total)])
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            fits = [k for k, w in enumerate(self.open) if w[0] >= n]
            if fits:
                k = min(fits, key=lambda k: self.open[k][0])
                room, pieces = self.open[k]
                pieces.append((doc, start, ids, total))
                if room == n:
                    self._emit(self.open.pop(k)[1])
                else:
                    self.open[k] = (room - n, pieces)
                return
            if len(self.open) < self.most:
                self.open.append((self.size - n, [(doc, start, ids, total)]))
                return
            room, pieces = self.open.pop(min(range(len(self.open)), key=lambda k: self.open[k][0]))
            pieces.append((doc, start, ids[: 4 * room], total))
            self._emit(pieces)
            start, ids = start + room, ids[4 * room :]

    def close(self, is_open: bool) -> None:
        for _, pieces in self.open:
            self._emit(pieces, is_open)
        self.open = []

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES.values(), strict=True)], list(_TYPES))


_TYPES = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(), "open": pa.bool_(), "ids": pa.binary(),
}
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"


def _first_round(paths: tuple, size: int, most: int, separator: bytes, with_ids: bool):
    def run(batches):
        enc = encoder(*paths)
        packer = _Packer(size, most, TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()) + separator
                packer.add(doc, 0, memoryview(ids), len(ids) // 4)
            yield packer.take()
        packer.close(True)
        yield packer.take()

    return run


def _merge_round(level: int, size: int, with_ids: bool, last: bool):
    def run(batches):
        for tab in whole_groups(batches, ["grp"]):
            bounds = group_starts(tab, ["grp"])
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                rows = tab.slice(s, e - s)
                packer = _Packer(size, 1, (level << 56) | (rows.column("grp")[0].as_py() << 32), with_ids)
                for doc, start, total, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                    packer.add(doc, start, memoryview(ids), total)
                packer.close(not last)
                yield packer.take()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    open_windows: int = 32,
    fan: int = 64,
    separator: int = 0,
    with_ids: bool = True,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, ``ids`` (little-endian 32-bit ids).  The vocabulary's two files hold the same ids, as a
    tokenizer and as ranks; both paths are parameters."""
    import public_tokenizers

    paths = (
        tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern or public_tokenizers.PATTERN,
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(texts.mapInArrow(_first_round(paths, size, open_windows, separator.to_bytes(4, "little"), with_ids), _SCHEMA))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    done, left = rows.filter("not open").select(columns), rows.filter("open")
    top = left.agg(F.max(F.shiftright("sequence_id", 32))).first()[0]
    level = 0
    while top is not None:
        level, top = level + 1, top // fan
        grouped = left.withColumn("grp", F.floor(F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1)), 32) / fan).cast("long"))
        grouped = grouped.repartition("grp").sortWithinPartitions("grp", "sequence_id", "offset")
        merged = cut(grouped.mapInArrow(_merge_round(level, size, with_ids, top == 0), _SCHEMA))
        done = done.union(merged.filter("not open").select(columns))
        left = merged.filter("open")
        if top == 0:
            break
    return done
