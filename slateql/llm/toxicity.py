"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel. Two words are compared by their common subsequences of three and four
characters, gaps allowed: a subsequence that spans d characters more than it
has counts ``DECAY`` ** d, up to ``SPAN`` characters in all, so ``i.d.i.o.t``
still shares most of ``idiot``. Words carry start and end marks, and three or more single letters in a row,
as in ``i d i o t``, are one word. The sum is
divided by a norm of each word's length. The kernel is approximate: subsequences are hashed into 2^20
cells, where about a tenth of those of four letters a-z share one with another, and other characters than
a-z go by 35 codes. A sentence is compared with a
landmark word by the mean over its words (a convolution kernel).

Nyström. Landmarks are training words whose document frequency speaks most
for or against toxic documents; a sentence maps to K_mm^(-1/2) K_m(sentence),
and a linear support vector machine (squared hinge) is fitted there. Only
documents are labelled, so toxic documents are bags: after a first fit their
sentences of low score stop counting as toxic, and the machine is fitted again.

Score. The machine is linear in the landmarks and every landmark is linear in
its subsequences, so the decision collapses to one weight per subsequence; a
word's value is a sum of table entries. Document statistics of word values and
sentence decisions give the score by a logistic fit on the same training
documents.

Bound. The fit uses at most ``max_toxic`` + ``max_clean`` labelled documents of at
most ``max_chars`` characters, taken by the hash of their ids; of an id with several texts one is used. Scoring covers every whole text.

Defined cases: null and empty texts have the statistics 0 and get the score of
those; repeated rows are scored alike, and long texts whole. An empty table gives no rows. A ``keep`` column named like the score is
returned as ``input_...``; other columns are not read. A null id is not held out. A label is toxic if any row of the id
says so; null labels are ignored. Without labels of both classes every score is
the toxic share of the labels (0 without labels).
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateql.llm.exprs import kept_as
from slateql.llm.process import per_process, tidy

DECAY, SPAN = 0.6, 6
TABLE_BITS = 20
LONGEST = 40  # longer words are read in pieces of this many characters
_OFFSETS = [(0, *o) for size in (2, 3) for o in combinations(range(1, SPAN), size)]
_WEIGHTS = [DECAY ** (o[-1] + 1 - len(o)) for o in _OFFSETS]
_START, _END = 1, 2
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_](?!\w)){2,}")
_TWO_SPACED = re.compile(r" [^\W\d_] [^\W\d_](?!\w)")
_TRIM = ".,;:!?\"'()[]{}|*#$%&<>"


def joined(text: str) -> str:
    """Three or more single letters, a space between each, as one word."""
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text) if _TWO_SPACED.search(text) else text


def _codes(words: list[str]) -> np.ndarray:
    """Characters as 1..63, marks around each word, 0 behind it."""
    longest = max(map(len, words)) + 2
    out = np.zeros((len(words), longest), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letter = (flat >= 97) & (flat <= 122)
    flat = np.where(letter, flat - 94, 29 + (flat * np.uint32(2654435761) >> np.uint32(16)) % 35).astype(np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    rows = np.repeat(np.arange(len(words)), n)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
    out[rows, columns] = flat
    out[:, 0] = _START
    out[np.arange(len(words)), n + 1] = _END
    return out


def _features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
    """(table indices, weight, validity), each of shape (words, positions), per set of offsets."""
    width = codes.shape[1]
    padded = np.pad(codes, ((0, 0), (0, SPAN)))
    for offsets, weight in zip(_OFFSETS, _WEIGHTS):
        code = np.full(codes.shape, len(offsets), np.uint32)
        for o in offsets:
            code = code * np.uint32(64) + padded[:, o : o + width]
        valid = padded[:, offsets[-1] : offsets[-1] + width] > 0
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS), weight, valid


def _norms(codes: np.ndarray) -> np.ndarray:
    n = (codes > 0).sum(1)
    total = sum(w * w * np.maximum(0, n - o[-1]) for o, w in zip(_OFFSETS, _WEIGHTS))
    return np.sqrt(np.maximum(total, 1e-9)).astype(np.float32)


def _blocks(words: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of words of similar length, the longest cut into pieces."""
    pieces = [(k, w[i : i + LONGEST]) for k, w in enumerate(words) for i in range(0, max(1, len(w)), LONGEST)]
    pieces.sort(key=lambda x: len(x[1]))
    for i in range(0, len(pieces), size):
        part = pieces[i : i + size]
        yield np.array([k for k, _ in part]), _codes([w for _, w in part])


def kernel_to(words: list[str], landmarks: list[str]) -> np.ndarray:
    """K(word, landmark), of shape (words, landmarks)."""
    columns = np.full(1 << TABLE_BITS, -1, np.int32)
    entries: dict[int, dict[int, float]] = {}
    for at, codes in _blocks(landmarks, 256):
        norm = _norms(codes)
        for index, weight, valid in _features(codes):
            for r, c in zip(*np.nonzero(valid)):
                own = entries.setdefault(int(index[r, c]), {})
                own[int(at[r])] = own.get(int(at[r]), 0.0) + weight / norm[r]
    table = np.zeros((len(entries) + 1, len(landmarks)), np.float32)
    for k, (code, own) in enumerate(entries.items()):
        columns[code] = k
        table[k, list(own)] = list(own.values())
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at, codes in _blocks(words, 1024):
        found = np.zeros((len(at), len(landmarks)), np.float32)
        for index, weight, valid in _features(codes):
            column = np.where(valid, columns[index], -1)
            rows, where = np.nonzero(column >= 0)
            if len(rows):
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                found[rows[starts]] += weight * np.add.reduceat(table[column[rows, where]], starts, axis=0)
        np.add.at(out, at, found / _norms(codes)[:, None])
    return out


@dataclass
class Model:
    table: np.ndarray | None  # one weight per subsequence
    bias: float
    cuts: tuple[float, ...]
    scale: np.ndarray  # (statistics, 2): mean and spread
    logistic: np.ndarray  # weights, then the constant
    landmarks: tuple[str, ...] = ()  # what the table was made of, with one weight each
    beta: np.ndarray | None = None

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.float32)
        for at, codes in _blocks(words, 4096):
            found = np.zeros(len(at), np.float32)
            for index, weight, valid in _features(codes):
                found += np.float32(weight) * (self.table[index] * valid).sum(1)
            np.add.at(out, at, found / _norms(codes))
        return out

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(statistics), self.bias)
        z = (statistics - self.scale[:, 0]) / self.scale[:, 1]
        return 1 / (1 + np.exp(-np.clip(z @ self.logistic[:-1] + self.logistic[-1], -30, 30)))


_SENTENCE, _BREAK = 1000.0, 2000.0


class WordValues:
    """word -> its value, plus ``_SENTENCE`` if it ends a sentence; two generations of ``limit`` words."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit = model, limit
        self.held, self.old = {"\n": _BREAK}, {}
        self.bare: dict[str, float] = {}

    def _learn(self, unseen: list[str]) -> None:
        again = [w for w in unseen if w in self.old]
        self.held.update((w, self.old[w]) for w in again)
        fresh = [w for w in unseen if w not in self.old]
        bare = [w.strip(_TRIM).lower() for w in fresh]
        if len(self.bare) > self.limit:
            self.bare = {}
        new = list({b for b in bare if b not in self.bare})
        self.bare.update(zip(new, self.model.values(new).tolist() if new else ()))
        for w, b in zip(fresh, bare):
            self.held[w] = self.bare[b] + (_SENTENCE if w.rstrip("\"')]}*#$%&|<>")[-1:] in (".", "!", "?") else 0.0)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        split = [joined(t).replace("\n", " \n ").split(" ") for t in texts]
        found = [list(map(self.held.get, ws)) for ws in split]
        unseen = {w for ws, xs in zip(split, found) if None in xs for w, x in zip(ws, xs) if x is None}
        if unseen:
            self._learn(list(unseen))
            found = [list(map(self.held.get, ws)) if None in xs else xs for ws, xs in zip(split, found)]
        if len(self.held) > self.limit:
            self.old, self.held = self.held, {"\n": _BREAK}
        return [np.array([x for x in xs if x == x], np.float64) for xs in found]


def statistics(values: np.ndarray, bias: float, cuts: tuple[float, ...]) -> list[float]:
    """Of one text's word values: shares above the cuts, and the sentences' mean, positive part and maximum."""
    ends = values > _SENTENCE / 2
    word = values < _BREAK - _SENTENCE / 2
    plain = np.where(ends, values - _SENTENCE, values)[word]
    if not len(plain):
        return [0.0] * (len(cuts) + 4)
    sentence = (np.cumsum(ends) - ends)[word]
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    lengths = np.diff(np.r_[starts, len(plain)])
    decisions = np.add.reduceat(plain, starts) / lengths + bias
    shares = [float((plain > c).mean()) for c in cuts]
    return [*shares, float(np.maximum(plain - cuts[0], 0).mean()), float(decisions.mean()), float(np.maximum(decisions, 0).mean()), float(decisions.max())]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Squared-hinge support vector machine in the primal, by Newton steps; the constant comes last."""
    size = x.shape[1] + 1
    w = np.zeros(size)
    eye = ridge * np.eye(size)
    eye[-1, -1] = 1e-6
    active = weight > 0
    for _ in range(rounds):
        gram, right = eye.copy(), np.zeros(size)
        for i in range(0, len(x), 4096):  # by blocks, to keep copies small
            a = active[i : i + 4096]
            xa = np.c_[x[i : i + 4096][a], np.ones(a.sum(), np.float32)]
            wa = weight[i : i + 4096][a].astype(np.float32)
            weighted = xa * wa[:, None]
            gram += weighted.T @ xa
            right += weighted.T @ y[i : i + 4096][a].astype(np.float32)
        w = np.linalg.solve(gram, right)
        now = (y * (x @ w[:-1].astype(np.float32) + w[-1]) < 1) & (weight > 0)
        if (now == active).all():
            break
        active = now
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + eye, x.T @ (y - p) - eye @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _tokens(text: str) -> list[list[str]]:
    """Sentences of trimmed, lower-cased words."""
    out, now = [], []
    for w in joined(text or "").replace("\n", " \n ").split(" "):
        if w and w != "\n":
            now.append(w.strip(_TRIM).lower())
        if now and (w == "\n" or w.rstrip("\"')]}*#$%&|<>")[-1:] in (".", "!", "?")):
            out.append(now)
            now = []
    return out + [now] if now else out


def fit(texts: list[str], toxic: list[int], landmarks: int = 144, share: float = 1.0) -> Model:
    """A model from labelled texts; ``share`` is returned as the score if a class is missing."""
    y = np.array(toxic)
    if not 0 < y.sum() < len(y):
        return Model(None, share if len(y) else 0.0, (), np.zeros((0, 2)), np.zeros(1))
    documents = [_tokens(t) for t in texts]
    by_class = [Counter(), Counter()]
    for sentences, label in zip(documents, y):
        by_class[label].update({w for s in sentences for w in s})
    n_toxic, n_clean = y.sum(), (1 - y).sum()
    lean = {}
    for w in by_class[0].keys() | by_class[1].keys():
        a, b = by_class[1][w], by_class[0][w]
        if a + b >= 3 and len(w) <= LONGEST:
            p, q = (a + 0.5) / (n_toxic + 1), (b + 0.5) / (n_clean + 1)
            lean[w] = (p - q) / (p / n_toxic + q / n_clean) ** 0.5
    ranked = sorted(lean, key=lambda w: (-lean[w], w))
    chosen = ranked[: landmarks * 3 // 5]
    rest = sorted((w for w in ranked[len(chosen) :] if lean[w] < 1), key=lambda w: (lean[w], w))
    if rest and chosen:  # the clean words most like a toxic landmark, then the most common
        frequent = sorted(rest, key=lambda w: (-by_class[0][w], w))[: landmarks // 8]
        alike = kernel_to(rest[:20_000], chosen).max(1)
        close = [rest[k] for k in np.argsort(-alike, kind="stable")[:landmarks]]
        chosen = list(dict.fromkeys([*chosen, *frequent, *close]))[:landmarks]
    if not chosen:
        return Model(None, share, (), np.zeros((0, 2)), np.zeros(1))

    vocabulary = sorted({w for sentences in documents for s in sentences for w in s})
    position = {w: k for k, w in enumerate(vocabulary)}
    spectrum, basis = np.linalg.eigh(kernel_to(chosen, chosen).astype(np.float64))
    kept = spectrum > 1e-4 * spectrum.max()
    root = (basis[:, kept] / np.sqrt(spectrum[kept])) @ basis[:, kept].T
    mapped, narrow = kernel_to(vocabulary, chosen), root.astype(np.float32)
    for i in range(0, len(mapped), 4096):
        mapped[i : i + 4096] = mapped[i : i + 4096] @ narrow

    owner = np.array([k for k, sentences in enumerate(documents) for _ in sentences])
    x = np.empty((len(owner), len(chosen)), np.float32)
    for k, s in enumerate(s for sentences in documents for s in sentences):
        x[k] = mapped[[position[w] for w in s]].mean(0)
    del mapped, documents, position, vocabulary
    label = y[owner]
    positive = label == 1
    for _ in range(4):
        weight = np.where(positive, (label == 0).sum() / max(1, positive.sum()), 1.0) * (positive | (label == 0))
        w = _svm(x, np.where(positive, 1.0, -1.0), weight)
        decision = x @ w[:-1].astype(np.float32) + w[-1]
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, decision)
        positive = (label == 1) & ((decision > 0) | (decision >= best[owner]))
    del x

    beta = root @ w[:-1]
    table = np.zeros(1 << TABLE_BITS, np.float32)
    for at, codes in _blocks(chosen, 256):
        norm = _norms(codes)
        for index, weight_, valid in _features(codes):
            np.add.at(table, index[valid], np.broadcast_to((weight_ * beta[at] / norm)[:, None], index.shape)[valid])
    model = Model(table, float(w[-1]), (), np.zeros((0, 2)), np.zeros(1), tuple(chosen), beta)
    values = WordValues(model, limit=10**9).of(texts)
    flat = np.concatenate([v[v < _BREAK - _SENTENCE / 2] for v in values])
    flat = np.where(flat > _SENTENCE / 2, flat - _SENTENCE, flat)
    model.cuts = tuple(float(c) for c in np.quantile(flat, (0.97, 0.98, 0.99, 0.995)))
    found = np.array([statistics(v, model.bias, model.cuts) for v in values])
    model.scale = np.c_[found.mean(0), found.std(0) + 1e-9]
    model.logistic = _logistic((found - model.scale[:, 0]) / model.scale[:, 1], y)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int, doc_id: str, text: str, toxic: str) -> list[tuple[str, int]]:
    """Labelled texts by class, in the order of a hash of their ids."""
    known = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    chosen = None
    for label, most in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("toxic").cast("int") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").where(F.length("text") <= max_chars)
    one = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    found = one.select(F.xxhash64("id").alias("h"), "id", "text", "toxic").collect()
    return [(r.text, r.toxic) for r in sorted(found, key=lambda r: (r.h, r.id, r.text))]


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 800, max_clean: int = 1_200, max_chars: int = 20_000, landmarks: int = 144, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    sample = training_sample(docs, labels, max_toxic, max_clean, max_chars, doc_id, text, toxic)
    share = sum(y for _, y in sample) / max(1, len(sample))
    return fit([t for t, _ in sample], [y for _, y in sample], landmarks, share)


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """The ``keep`` columns and the score, as ``name``, of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.bias, model.cuts, model.scale, model.logistic))
    read = [*keep, *([] if text in keep else [text])]
    at, n = read.index(text), len(keep)
    ddl = ", ".join([f"`__k{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["score double"])
    seen = f"word values {uuid.uuid4()}"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        words = per_process(seen, lambda: WordValues(own)) if own.table is not None else None
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 64):
                part = [t or "" for t in batch.column(at)[i : i + 64].to_pylist()]
                found += [statistics(v, own.bias, own.cuts) for v in words.of(part)] if words else [[]] * len(part)
            scored = pa.array(own.score(np.array(found).reshape(len(found), -1)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], scored], names=[*[f"__k{i}" for i in range(n)], "score"])

    out = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(read)]).mapInArrow(tidy(emit), ddl)
    return out.select(*kept_as(keep, [name]), F.col("score").alias(name))


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label must not be learned: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
