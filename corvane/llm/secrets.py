"""Operator 6. Secret scans: candidates from whole texts, false positives removed by a random forest.

Candidates are runs of token characters that hold a digit or change their case several times and reach ``shortest`` characters,
whatever follows a credential word and ``=`` or ``:``, and the password of an address ``scheme://user:password@host``.

The forest looks at length, kinds of characters, how likely the transitions between characters are among the corpus's own
words, how much of the candidate the corpus's frequent words cover, path and address marks and the neighbouring words.  The
dictionary is the ``words`` most frequent words of all documents (a bounded result of a count over the whole corpus).

It is trained from labelled findings, a table ``before, candidate, after, label``.  Where the caller has none,
``labelled_findings`` makes them from the formats that services publish for their keys (label 1) and from things that look
alike (label 0), in sentences of the corpus's words; ``tests/llm`` gives catch and false-positive rates for formats withheld from training.

Defined cases: null and empty texts have no candidates; very long texts are scanned whole; a document may
have many findings and repeated rows each get theirs; null ids are kept.  Without labelled findings of both
kinds every candidate scores the share of label 1.  A corpus without words gives an empty dictionary.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._common import cut, slices
from corvane.llm.trees import Trees, forest

_DIGITS = re.compile(r"[0-9]")
_NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)\w*[ \t]*[=:][ \t]*[\"']?([^\s\"']{6,})", re.I)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@]*:([^\s/@]{3,})@", re.I)
_RUN = re.compile(r"[A-Za-z0-9_+/.~@$-]+(?:=+(?![A-Za-z0-9_+/.~@$-]))?")
_LETTERS = re.compile(r"[A-Za-z_+/-]{16,}")
_CASE = re.compile(r"[a-z][A-Z]")
_EDGE = ".@-/"
_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login")
_OTHER = ("commit", "sha", "revision", "uuid", "guid", "version", "order", "phone", "tel", "mail", "checksum", "md5", "isbn", "card", "address", "http", "doi", "build", "file")
_HEX = frozenset("0123456789abcdef")


def candidates(text: str | None, shortest: int = 8) -> list[tuple[int, int]]:
    """Start and end of each candidate of a whole text, in order, without overlaps."""
    if not text:
        return []
    spans, at, end = [], 0, len(text)
    while (m := _DIGITS.search(text, at)) is not None:
        lo = m.start()
        while lo and text[lo - 1] not in " \t\n\r\v\f":
            lo -= 1
        hi = m.end()
        while hi < end and text[hi] not in " \t\n\r\v\f":
            hi += 1
        for r in _RUN.finditer(text, lo, hi):
            s, e = r.span()
            while s < e and text[s] in _EDGE:
                s += 1
            while e > s and text[e - 1] in ".@-":
                e -= 1
            if e - s >= shortest and _DIGITS.search(text, s, e):
                spans.append((s, e))
        at = hi
    spans += [m.span(1) for m in _NAMED.finditer(text)]
    spans += [m.span() for m in _LETTERS.finditer(text) if len(_CASE.findall(m.group())) > 2]
    inner = [m.span(1) for m in _ADDRESS.finditer(text)] if "://" in text else []
    # the password of an address stands alone
    spans = [x for x in spans if not any(x[0] < e and s < x[1] for s, e in inner)]
    out: list[tuple[int, int]] = []
    for s, e in sorted({*spans, *inner}, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
        elif e > out[-1][1]:  # two that overlap are one
            out[-1] = (out[-1][0], e)
    return out


class Lexicon:
    """A corpus's frequent words, and the likelihood of each letter after another in them."""

    def __init__(self, counts: dict[str, int]):
        self.words = frozenset(w for w in counts if len(w) > 3)
        pairs = np.ones((27, 27))
        for w, n in counts.items():
            k = _letters(w)
            np.add.at(pairs, (k[:-1], k[1:]), n)
        self.log = np.log(pairs / pairs.sum(1, keepdims=True))
        self.usual = float((self.log * pairs).sum() / pairs.sum())

    def coverage(self, low: str) -> float:
        """Share of the letters that words of the lexicon cover, longest first from the left."""
        at, covered, letters, n = 0, 0, sum(map(str.isalpha, low)), len(low)
        while at < n:
            for k in range(min(16, n - at), 3, -1):
                if low[at : at + k] in self.words:
                    covered, at = covered + k, at + k
                    break
            else:
                at += 1
        return covered / max(1, letters)

    def transitions(self, low: str) -> tuple[float, float]:
        """Mean and smallest (over runs of eight letters) log-likelihood of letters after letters, against that of the corpus."""
        found = [self.log[k[:-1], k[1:]] for k in (_letters(x) for x in re.findall(r"[^\W\d_]{2,}", low))]
        if not found:
            return 0.0, 0.0
        means = [np.convolve(x, np.ones(min(7, len(x))) / min(7, len(x)), "valid").min() for x in found]
        return float(np.concatenate(found).mean()) - self.usual, float(min(means)) - self.usual


def _letters(word: str) -> np.ndarray:
    return np.array([ord(c) - 97 if "a" <= c <= "z" else 26 for c in word], dtype=np.int64)


def lexicon(docs: DataFrame, words: int = 20_000, text_col: str = "text") -> dict[str, int]:
    """The ``words`` most frequent words of three letters and more over all documents, with their counts."""
    every = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("word"))
    # written out first, so that the driver gets these rows alone and not each task's candidates
    top = cut(every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(words))
    return {r["word"]: r["n"] for r in top.collect()}


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(before: str, candidate: str, after: str, lex: Lexicon) -> list[float]:
    """What the forest sees of one candidate with up to 40 characters on each side."""
    n = max(1, len(candidate))
    kinds = [_kind(c) for c in candidate]
    share = [kinds.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    chars = {c: candidate.count(c) for c in set(candidate)}
    entropy = -sum(v / n * np.log2(v / n) for v in chars.values())
    low = candidate.lower()
    left, near = before.lower(), " ".join(before.lower().split()[-3:])
    gap = left.rstrip("\"' ")
    mean, least = lex.transitions(low)
    return [
        float(n), *share, moves, entropy, len(chars) / n, lex.coverage(low), mean, least,
        float(set(low) <= _HEX), float(candidate.isdigit()), float("@" in candidate), float("/" in candidate), candidate.count(".") / n, candidate.count("-") / n,
        float(candidate[:1].isupper()), float(low != candidate and candidate.upper() == candidate), float(any(w in near for w in _WORDS)), float(any(w in near for w in _OTHER)),
        float(gap.endswith(("=", ":"))), float(before[-1:] in "\"'" and bool(before)), float(after[:1] in "\"'" and bool(after)),
        float(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low) is not None), float(low.startswith(("http", "www", "//"))),
        float(re.search(r"://[^\s/:@]*:$", left) is not None and after[:1] == "@"), float("_" in candidate[:12] or "-" in candidate[:6] or "." in candidate[:4]),
        float(max((len(x) for x in re.split(r"[^A-Za-z0-9]", candidate)), default=0)),
    ]


_LOW, _UP, _DIG, _HEXES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_ANY = _LOW + _UP + _DIG
_Made = tuple[str, str, str]


def _secret_formats(r: random.Random, word: Callable[[], str]) -> dict[str, Callable[[], _Made]]:
    """Published formats of keys: what stands before, the key, what stands behind."""
    text = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    assign = lambda: r.choice([" = \"", "=\"", ": ", "=", " = '", " = ", ":"])
    named = lambda names: r.choice(names) + assign()
    return {
        "aws_id": lambda: ("", r.choice(["AKIA", "ASIA"]) + text(_UP + _DIG, 16), ""),
        "aws_secret": lambda: (named(["secret_key", "aws_secret_access_key", "secret"]), text(_ANY + "/+", 40), ""),
        "hex_token": lambda: (named(["token", "api_key", "secret", "access_token", "auth"]), text(_HEXES, r.choice([32, 40, 64])), ""),
        "password": lambda: (named(["password", "passwd", "pwd", "db_password", "PASSWORD"]), text(_LOW + _DIG + r.choice(["", _UP, _UP + "!#%&*"]), r.randint(8, 20)), ""),
        "word_password": lambda: (named(["password", "passwd", "pwd", "secret"]), r.choice([str.title, str.lower])(word()) + r.choice(["", "!", "_", "#"]) + text(_DIG, r.randint(2, 5)), ""),
        "git_host": lambda: ("", r.choice(["ghp_", "gho_", "ghs_", "github_pat_"]) + text(_ANY, 36), ""),
        "git_lab": lambda: ("", "glpat-" + text(_ANY + "_-", 20), ""),
        "pay": lambda: ("", r.choice(["sk_live_", "sk_test_", "rk_live_", "sk-"]) + text(_ANY, r.choice([24, 48])), ""),
        "chat": lambda: ("", r.choice(["xoxb-", "xoxp-", "xoxa-"]) + text(_DIG, 11) + "-" + text(_ANY, 24), ""),
        "cloud_key": lambda: ("", "AIza" + text(_ANY + "_-", 35), ""),
        "mail_key": lambda: ("", "SG." + text(_ANY + "_-", 22) + "." + text(_ANY + "_-", 43), ""),
        "package": lambda: ("", r.choice(["npm_", "pypi-", "dop_v1_"]) + text(_ANY, r.choice([36, 64])), ""),
        "phone_api": lambda: (r.choice(["", "auth_token="]), r.choice(["SK", "AC"]) + text(_HEXES, 32), ""),
        "bearer": lambda: (r.choice(["Authorization: Bearer ", "bearer ", "token "]), "eyJ" + text(_ANY, 30) + "." + "eyJ" + text(_ANY, 40) + "." + text(_ANY + "_-", 43), ""),
        "address": lambda: (r.choice(["postgres", "mysql", "amqp", "redis", "https", "mongodb+srv"]) + "://" + r.choice([word(), "root", "admin", ""]) + ":", r.choice([text(_ANY, r.randint(8, 16)), word().title() + text(_DIG, 3)]), "@" + word() + r.choice([".com/", ":5432/", ".internal/"]) + word()),
        "key_block": lambda: (r.choice(["-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\n"]), text(_ANY + "+/", 64), "\n" + text(_ANY, 10)),
        "letters": lambda: (named(["token", "api_key", "client_secret"]), text(_LOW + _UP, r.choice([24, 32, 40])), ""),
    }


def _other_formats(r: random.Random, word: Callable[[], str]) -> dict[str, Callable[[], _Made]]:
    """Things that look like keys and are none."""
    text = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    return {
        "mail": lambda: ("", f"{word()}{r.choice(['.', '_', ''])}{r.randint(1, 99)}@{word()}{r.choice(['', str(r.randint(1, 9))])}.{word()}.{r.choice(['com', 'org', 'net', 'de'])}", ""),
        "ip": lambda: ("", ".".join(str(r.randint(1, 255)) for _ in range(4)), ""),
        "number": lambda: (r.choice(["", "order ", "card ", "isbn "]), text(_DIG, r.randint(8, 19)), ""),
        "phone": lambda: (r.choice(["", "tel ", "phone: "]), f"+{r.randint(1, 99)}-{text(_DIG, 3)}-{text(_DIG, 3)}-{text(_DIG, 4)}", ""),
        "hash": lambda: (r.choice(["commit ", "sha ", "revision ", "checksum ", "md5 "]), text(_HEXES, r.choice([32, 40, 64])), ""),
        "uuid": lambda: (r.choice(["", "id ", "uuid "]), "-".join(text(_HEXES, k) for k in (8, 4, 4, 4, 12)), ""),
        "date": lambda: ("", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" + r.choice(["", f"T{r.randint(10, 23)}:{r.randint(10, 59)}"]), ""),
        "path": lambda: (r.choice(["", "/", "file "]), "/".join(word() for _ in range(r.randint(2, 4))) + f"/{word()}{r.randint(1, 99)}.{r.choice(['txt', 'py', 'html'])}", ""),
        "page": lambda: (r.choice(["https://", "http://"]), f"www.{word()}.com/{word()}/{r.randint(1, 9999)}", ""),
        "query": lambda: ("https://", f"{word()}.org/{word()}", f"?page={r.randint(1, 99)}&{word()}={r.randint(1, 99)}"),
        "version": lambda: (r.choice(["", "version "]), f"v{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-beta{r.randint(1, 9)}", ""),
        "name": lambda: ("", word() + word() + str(r.randint(1, 2030)), ""),
        "camel": lambda: ("", word() + word().title() + word().title() + r.choice(["", word().title() + "Of" + word().title(), str(r.randint(1, 9))]), r.choice(["", "()"])),
        "snake": lambda: ("", f"{word()}_{word()}_{r.randint(1, 999)}", ""),
        "placeholder": lambda: (r.choice(["token: ", "password: ", "key=", "secret = "]), r.choice(["required", "optional", "changeme", "<password>", "YOUR_KEY_HERE", "********", "example", "none", "${DB_PASSWORD}", "os.environ"]), ""),
        "prose": lambda: (r.choice(["token: ", "password: ", "secret: "]), word() + word() + r.choice(["", ".", ","]), ""),
        "code": lambda: ("", (word() + word())[:10].upper() + "-" + text(_DIG, 4), ""),
        "doi": lambda: (r.choice(["", "doi "]), f"10.{r.randint(1000, 9999)}/{word()}.{r.randint(1900, 2030)}.{r.randint(1, 9999)}", ""),
    }


_SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "st", "en", "le", "un", "de", "ar", "os", "ch", "ei", "qu", "ion", "ble", "ment")


def labelled_findings(n: int = 6000, seed: int = 11, words: list[str] | None = None) -> list[tuple[str, str, str, int, str]]:
    """``n`` labelled findings ``(before, candidate, after, label, format)``, half of them secrets; the same for the same seed
    and words, which the sentences around them are made of."""
    r = random.Random(seed)
    made = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    word = (lambda: r.choice(words) if r.random() < 0.5 else made()) if words else made
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 7)))
    both, out = (_other_formats(r, word), _secret_formats(r, word)), []
    for i in range(n):
        kind = list(both[i % 2])[i // 2 % len(both[i % 2])]
        b, c, a = both[i % 2][kind]()
        b = prose() + " " + b
        a = (b[-1] if b[-1] in "\"'" else "") + a + " " + prose()
        out.append((b.upper() if r.random() < 0.1 else b, c.upper() if not i % 2 and r.random() < 0.05 else c, a, i % 2, kind))
    return out


class Model:
    """The forest and the lexicon its features are taken with."""

    def __init__(self, trees: Trees, lex: Lexicon):
        self.trees, self.lex = trees, lex

    def predict(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """Scores of candidates with what stands before and behind them."""
        rows = [features(b[-40:], c, a[:40], self.lex) for b, c, a in found]
        return self.trees.predict(np.array(rows, dtype=np.float64)) if rows else np.zeros(0)


def train(docs: DataFrame | None = None, findings: list[tuple] | None = None, words: int = 20_000, text_col: str = "text") -> Model:
    """A forest of labelled findings (a bounded, hand-checked table by nature) with the lexicon of ``docs``."""
    counts = {} if docs is None else lexicon(docs, words, text_col)
    rows = labelled_findings(words=[w for w in counts if len(w) > 3] or None) if findings is None else findings
    lex = Lexicon(counts or _words_of(rows))
    x = np.array([features(b[-40:], c, a[:40], lex) for b, c, a, *_ in rows], dtype=np.float64).reshape(len(rows), -1)
    return Model(forest(x, [r[3] for r in rows]), lex)


def _words_of(rows: list[tuple]) -> dict[str, int]:
    """Without a corpus: the words around the findings."""
    out: dict[str, int] = {}
    for b, _, a, *_ in rows:
        for w in re.findall(r"[^\W\d_]{3,}", f"{b} {a}".lower()):
            out[w] = out.get(w, 0) + 1
    return out


def _scan_texts(texts: list[str | None], model: Model, least: float):
    """For each text, its findings (start, end, score) that the forest lets stand; and the number of candidates."""
    spans = [candidates(t) for t in texts]
    score = model.predict([(t[max(0, s - 40) : s], t[s:e], t[e : e + 40]) for t, own in zip(texts, spans, strict=True) for s, e in own])
    out, at = [], 0
    for own in spans:
        out.append(([(s, e, float(v)) for (s, e), v in zip(own, score[at : at + len(own)], strict=True) if v >= least], len(own)))
        at += len(own)
    return out


def scan(docs: DataFrame, model: Model | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_candidates, n_secrets, secrets`` (start, end, score and the text of each)."""
    model = model or train(docs, text_col=text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("secret", pa.string())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(1).to_pylist()
                found = _scan_texts(texts, model, least)
                cells = [[{"start": s, "end": e, "score": v, "secret": t[s:e]} for s, e, v in own] for t, (own, _) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([len(c) for c in cells], pa.int64()), pa.array(cells, kind)], ["doc_id", "n_candidates", "n_secrets", "secrets"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start:long,end:long,score:double,secret:string>>")


def redact(docs: DataFrame, model: Model | None = None, least: float = 0.5, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with each secret of the text replaced by ``mark``."""
    model = model or train(docs, text_col=text_col)
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(place).to_pylist()
                for i, (own, _) in enumerate(_scan_texts(texts, model, least)):
                    for s, e, _ in reversed(own):
                        texts[i] = texts[i][:s] + mark + texts[i][e:]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(run, schema)
