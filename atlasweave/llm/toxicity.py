"""Toxicity by a subsequence string kernel: a Nyström support vector machine over words, and a calibrated score for texts.

Two words are alike in the three-letter subsequences they share, each weighted less for every letter
it skips, so an insult keeps its features when letters are inserted or the word is stretched by marks or
blanks. Words of labelled sentences train a squared-hinge machine in the space of landmark words. As every
landmark is a sum over subsequences, so is the trained machine: its margin for a word is a table
lookup per subsequence. How high and how dense the margins of a text are decides its score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave.llm.frames import plain

#: Labelled rows that training sees at most, drawn by hash; a model needs no more, and the driver holds no more.
TRAINING_ROWS = 3000
LANDMARKS = 96
SPAN, DECAY = 7, 0.6
LONGEST = 32
REMEMBERED = 400_000
_CODES = 64
#: Signs that stand in for letters.
_LETTERS = str.maketrans("013457@$!", "oieastasi")
_SEED = 7


def _clean(token: str) -> str:
    """The letters of a token, signs that pass for letters read as such; a token without letters has none."""
    letters = "".join(filter(str.isalpha, token))
    return letters if letters == token or not letters else "".join(filter(str.isalpha, token.rstrip("!").translate(_LETTERS))) if len(letters) > 1 else letters


def tokens(text: str) -> list[str]:
    """Lower-cased words of a text; runs of three or more single letters are one more word, to read i d i o t."""
    words = text.lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1 and w.isalpha()]
    start = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start >= 3:
                words.append("".join(words[i] for i in single[start:k]))
            start = k
    return words


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _triples(n: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i - 2)) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]


def _by_length(words: list[str], codes: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, character codes with a sign for either end) of the words of each length."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        matrix = np.array([codes.get(c, 2) for i in at.tolist() for c in words[i]], np.int32).reshape(len(at), n)
        yield at, np.pad(matrix, ((0, 0), (1, 1)), constant_values=1)


def _apply(words: list[str], codes: dict[str, int], table: np.ndarray) -> np.ndarray:
    """For each word, the sum of ``table`` over its subsequences, scaled by the weight of all of its length."""
    out = np.zeros((len(words), *table.shape[1:]), np.float32)
    place = None
    if table.ndim > 1:  # few rows of a table of landmarks are used
        filled = np.flatnonzero(table.any(axis=1))
        place = np.full(len(table), len(filled), np.int32)
        place[filled] = np.arange(len(filled))
        table = np.concatenate([table[filled], np.zeros((1, table.shape[1]), np.float32)])
    for at, chars in _by_length(words, codes):
        triples = _triples(chars.shape[1])
        total = np.zeros((len(at), *table.shape[1:]), np.float32)
        for i, j, k, weight in triples:
            code = (chars[:, i] * _CODES + chars[:, j]) * _CODES + chars[:, k]
            total += np.float32(weight) * table[code if place is None else place[code]]
        out[at] = total / np.sqrt(sum(w * w for *_, w in triples) or 1)
    return out


def _feature_table(words: list[str], codes: dict[str, int]) -> np.ndarray:
    """One column of subsequence weights for each word."""
    table = np.zeros((_CODES**3, len(words)), np.float32)
    for column, word in enumerate(words):
        (_, chars), *_ = _by_length([word], codes)
        triples = _triples(chars.shape[1])
        scale = np.sqrt(sum(w * w for *_, w in triples) or 1)
        for i, j, k, weight in triples:
            table[(chars[0, i] * _CODES + chars[0, j]) * _CODES + chars[0, k], column] += weight / scale
    return table


@dataclass
class ToxicityModel:
    codes: dict[str, int]
    table: np.ndarray
    bias: float
    weights: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        parts = [(i, w) for i, word in enumerate(words) for w in _windows(_clean(word)) if w]
        out = np.full(len(words), self.bias, np.float32)
        if parts:
            found = _apply([w for _, w in parts], self.codes, self.table) + self.bias
            np.maximum.at(out, np.array([i for i, _ in parts]), found)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(features) @ self.weights, -30, 30)))


def _summary(margins: np.ndarray) -> tuple[float, ...]:
    """(highest margin, shares of words with margins above -0.4, 0 and 0.4) of a text."""
    if not len(margins):
        return -1.0, 0.0, 0.0, 0.0
    return float(margins.max()), *(float((margins > level).mean()) for level in (-0.4, 0.0, 0.4))


def _design(features: np.ndarray) -> np.ndarray:
    top = np.clip(features[:, 0], -1.5, 1.5)
    return np.stack([np.ones(len(features)), top, np.maximum(top - 0.4, 0) * 3, *(np.sqrt(features[:, 1:]) * 5).T], axis=1)


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the primal: only rows inside the margin count."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * cost[active, None]
        new = np.linalg.solve(xa.T @ x[active] + ridge * np.eye(x.shape[1]), xa.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> ToxicityModel:
    """A model from labelled texts. With one class only, every score is that class's share."""
    toxic = np.asarray(toxic, bool)
    listed = [[w for t in tokens(text) for w in _windows(_clean(t)) if w] for text in texts]
    rng = np.random.default_rng(_SEED)
    letters = Counter(c for words in listed for w in words for c in w)
    codes = {c: i + 3 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[: _CODES - 3])}
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    share = n_bad / max(1, n_bad + n_good)
    base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    constant = ToxicityModel(codes, np.zeros(_CODES**3, np.float32), -1.0, np.array([base, 0, 0, 0, 0, 0]))
    bad, good = Counter(), Counter()
    for words, is_bad in zip(listed, toxic, strict=True):
        (bad if is_bad else good).update(set(words))
    # words whose sentences are toxic far more often than all are give the landmarks and must be in training
    seen = {w: (bad[w] + good[w]) * share for w in bad}
    excess = {w: (bad[w] - e) / np.sqrt(e * (1 - share) + 0.25) for w, e in seen.items()}
    marked = sorted((w for w, z in excess.items() if bad[w] >= 3 and z >= 4), key=lambda w: (-excess[w], w))
    if not n_bad or not n_good or not marked:
        return constant
    chosen = set(marked)
    rest = sorted(w for w in bad | good if w not in chosen)
    rest = [rest[i] for i in rng.permutation(len(rest))[:60_000]]
    marks = [*marked[: landmarks * 2 // 3], *rest[: landmarks - min(len(marked), landmarks * 2 // 3)]]
    table = _feature_table(marks, codes)
    gram = _apply(marks, codes, table).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3))  # to the Nyström features
    alphabet = sorted(codes)
    pure, stretched = [w for w in marked if not good[w]], []
    for word in pure:
        for _ in range(3):
            at = int(rng.integers(1, max(2, len(word))))
            stretched.append((word[:at] + (word[at - 1] if rng.random() < 0.5 else alphabet[int(rng.integers(len(alphabet)))]) + word[at:], bad[word] / 6))
    # every word stands for its sentences: once as toxic, once as clean, with the share of either class that holds it
    used = [*marked, *rest[:8000]]
    for last in (False, True):
        words = [*used, *(w for w, _ in stretched)]
        x = np.c_[_apply(words, codes, table) @ root, np.ones(len(words))]
        up = np.array([bad[w] / n_bad for w in used] + [n / n_bad for _, n in stretched])
        down = np.array([good[w] / n_good for w in used] + [0.0] * len(stretched))
        scale = 3000
        w = _squared_hinge(np.r_[x, x], np.r_[np.ones(len(words)), -np.ones(len(words))], np.r_[up * 0.5, down] * scale)
        model = ToxicityModel(codes, (table @ (root @ w[:-1])).astype(np.float32), float(w[-1]), np.zeros(6))
        if last:
            break
        known, hard = set(used), np.argsort(-model.margins(rest))[:3000]
        used += [rest[i] for i in hard.tolist() if rest[i] not in known]
    worded = [tokens(text) for text in texts]
    distinct = list({w for words in worded for w in words})
    margin = dict(zip(distinct, model.margins(distinct).tolist(), strict=True))
    features = np.array([_summary(np.array([margin[w] for w in words])) for words in worded])
    model.weights = _logistic(_design(features), toxic.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + keep + 1e-6 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def draw_hashes(count: int) -> int:
    """Hash values that ``count`` labels are drawn by: more of them for more labels, so that the share to draw never rounds to none."""
    return 1_000_000 * max(1, count // 100_000_000)


def train_from_tables(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAINING_ROWS) -> ToxicityModel:
    """A model of at most about ``rows`` labelled rows, drawn by a hash of the id; rows with crc32(id) mod 3 = 1 are held out.

    Ids without a document, null ids and null labels teach nothing; a null text counts as empty.
    """
    known = plain(labels, id=id_col, label=label_col).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    known = known.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) != 1)
    count = known.count()
    hashes = draw_hashes(count)
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(hashes)) < int(hashes * min(1.0, rows / max(1, count))))
    source = plain(docs, id=id_col, text=text_col)
    found = source.join(F.broadcast(drawn), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "label")
    found = found.toPandas().sort_values(["id", "text"])  # about ``rows`` rows
    return train(found["text"].tolist(), found["label"].to_numpy() > 0)


#: Margins of known words, for the model a worker scored with last.
_MEMORY: dict[str, dict[str, float]] = {}


def score_texts(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``: the probability, 0 to 1, that the whole text is toxic. Every row stays.

    Null and empty texts get the score of a text without words. An input column named like ``out`` is replaced.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 1 MB
    key = uuid4().hex
    names = [*docs.columns, out]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if key not in _MEMORY:
            _MEMORY.clear()
        memory = _MEMORY.setdefault(key, {})
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                listed = [tokens(t or "") for t in part.column(at).to_pylist()]
                if len(memory) > REMEMBERED:
                    memory.clear()
                new = list({w for words in listed for w in words}.difference(memory))
                memory.update(zip(new, model.margins(new).tolist(), strict=True))
                features = np.array([_summary(np.fromiter(map(memory.__getitem__, words), np.float32, len(words))) for words in listed])
                scores = pa.array(model.probability(features), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.DoubleType())]))
