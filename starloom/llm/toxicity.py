"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text
with the ordinary one's most frequent part behind it. A window is one word
inside a fixed carrier phrase that both dictionaries hold, so that the window's
two compressed lengths differ by what the word itself is worth to either. The
margins of a document's windows, counted by size, are weighed by a logistic
threshold calibrated on documents the dictionaries were not made from.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import free_name

#: At most so many labelled rows of either class teach the model (those of least hash).
TRAIN_ROWS = 3000
#: Bytes of the toxic part, of the ordinary part they share, and remembered words of a task.
TOXIC_BYTES, SHARED_BYTES, VOCABULARY = 16384, 24576, 1 << 19
GRAM, TOP = 5, 8
#: Parts of TOXIC_BYTES that the toxic part may fill; held-out likelihood picks one.
FILLS = (1 / 32, 1 / 8, 1)


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _frequencies(docs: list[list[bytes]]) -> Counter:
    out: Counter = Counter()
    for words in docs:
        out.update(set(words))
    return out


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word  # a word too short for a gram is one itself
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def _gram_frequencies(docs: list[list[bytes]]) -> Counter:
    out: Counter = Counter()
    for words in docs:
        seen: set[bytes] = set()
        for w in set(words):
            seen |= _grams(w)
        out.update(seen)
    return out


def _join(words: list[bytes], size: int) -> bytes:
    """The first words that fit, the first of them last: zstandard reaches the end of a dictionary most cheaply."""
    out, n = [], 0
    for w in words:
        n += len(w) + 1
        if n > size:
            break
        out.append(b" " + w)
    return b"".join(reversed(out))


def _rank(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[list[bytes], list[bytes]]:
    """(toxic words, the most telling first; ordinary words, the most frequent first).

    A gram that toxic documents have more often weighs its likelihood ratio
    statistic, which grows with purity and with frequency; no gram is too rare
    to weigh something. Greedy cover: a gram counts for the first word that
    holds it, so a frequent stem's many forms do not crowd out rarer stems.
    """
    wt, wo = _frequencies(toxic), _frequencies(ordinary)
    gt, go = _gram_frequencies(toxic), _gram_frequencies(ordinary)
    nt, no = max(1, len(toxic)), max(1, len(ordinary))
    weight = {}
    for g, k in gt.items():
        q, both = go[g], (k + go[g]) / (nt + no)
        if k * no > q * nt:
            weight[g] = 2 * (k * math.log(k / nt / both) + (q * math.log(q / no / both) if q else 0))
    held = {w: (found, n**0.5) for w, n in wt.items() if (found := sorted(weight.keys() & _grams(w)))}
    queue = [(-r * sum(weight[g] for g in found), w) for w, (found, r) in held.items()]
    heapq.heapify(queue)
    telling, room = [], TOXIC_BYTES
    while queue and room > 0:
        score, w = heapq.heappop(queue)
        found, r = held[w]
        now = -r * sum(weight[g] for g in found)
        if now != score and queue and (now, w) > queue[0]:  # scores only fall: wait for its turn
            heapq.heappush(queue, (now, w))
            continue
        telling.append(w)
        room -= len(w) + 1
        for g in found:
            weight[g] = 0.0
    return telling, [w for w, _ in sorted(wo.items(), key=lambda x: (-x[1], x[0]))]


def _contents(telling: list[bytes], frequent: list[bytes], size: int) -> tuple[bytes, bytes, bytes]:
    special = _join(telling, size)
    shared = _join(frequent, SHARED_BYTES)
    rest = _join(frequent[shared.count(b" ") :], max(len(special), 1))
    return special + shared, rest + shared, shared[-300:-252] + shared[-600:-576]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], fill: float = 1) -> tuple[bytes, bytes, bytes]:
    """(toxic, ordinary, carrier): contents of equal structure and the phrase for windows.

    The toxic part holds the most telling words, as many as fit in ``fill`` of its bytes.
    """
    return _contents(*_rank(toxic, ordinary), int(TOXIC_BYTES * fill))


class Margins(dict):
    """Word to (ordinary length - toxic length), remembered up to a bound."""

    def __init__(self, toxic: bytes, ordinary: bytes, carrier: bytes):
        self.pair = [self._compressor(x) for x in (ordinary, toxic)]
        # The word stands between two stretches: no match can begin in a window's last bytes.
        self.carrier = carrier[:48] + b" ", b" " + carrier[48:]

    @staticmethod
    def _compressor(content: bytes) -> zs.ZstdCompressor:
        params = zs.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return zs.ZstdCompressor(compression_params=params, dict_data=held)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        window = self.carrier[0] + word + self.carrier[1]
        a, b = (len(c.compress(window)) for c in self.pair)
        self[word] = a - b
        return a - b


def features(margins: Margins, words: list[bytes]) -> np.ndarray:
    """Counts and rates of windows by margin, the greatest margin, and the length."""
    if not words:
        return np.zeros(2 * TOP + 2)
    m = np.clip(np.fromiter(map(margins.__getitem__, words), np.int64, len(words)), 0, TOP)
    at_least = np.cumsum(np.bincount(m, minlength=TOP + 1)[::-1])[::-1][1:]
    return np.concatenate([np.log1p(at_least), 30 * at_least / (len(words) + 30), [m.max(), np.log1p(len(words))]])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    carrier: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def margins(self) -> Margins:
        return Margins(self.toxic, self.ordinary, self.carrier)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(t: list[list[bytes]], o: list[list[bytes]], share: float | None = None) -> Model:
    """A model of two samples of documents' words; ``share`` is the part of toxic rows among all labelled ones.

    Half of either sample makes dictionaries that measure the other half, and
    the reverse, so thresholds are calibrated on documents not yet seen, and the
    fill of least loss is taken; the final dictionaries are made from all. With either sample empty every score is 0.
    """
    if not t or not o:
        return Model(b" ", b" ", b" ", np.r_[-30.0, np.zeros(2 * TOP + 2)], np.zeros(2 * TOP + 2), np.ones(2 * TOP + 2))
    ranked = [_rank(t[part::2], o[part::2]) for part in (0, 1)]
    tried = []
    for fill in FILLS:
        xs, ys = [], []
        for part in (0, 1):
            made = Margins(*_contents(*ranked[part], int(TOXIC_BYTES * fill)))
            for label, docs in ((1, t), (0, o)):
                seen = docs[1 - part :: 2]
                xs += [features(made, d) for d in seen]
                ys += [label] * len(seen)
        x, y = np.array(xs), np.array(ys, float)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = _logistic(z, y)
        tried.append((np.logaddexp(0, (1 - 2 * y) * (z @ w)).sum(), fill, w, mean, scale))
    _, fill, w, mean, scale = min(tried, key=lambda r: r[:2])
    if share is not None:  # samples of other proportions move the intercept only
        w[0] += np.log(share / (1 - share)) - np.log(len(t) / len(o))
    return Model(*train_dictionaries(t, o, fill), w, mean, scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows of each class, those whose id has the least hash.

    Rows whose ``crc32(id as text) mod 5`` is 0 are held out. Null labels, ids
    and texts teach nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter("crc32(encode(cast(id as string), 'utf-8')) % 5 <> 0").distinct()
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id", F.lit("toxicity")), "id"]
    picked = known.filter("y = 1").orderBy(*order).limit(rows).union(known.filter("y = 0").orderBy(*order).limit(rows))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")
    # One text an id, the least, so that repeated ids cannot pass the bound of 2 * rows.
    found = own.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y").repartition(1)
    total = sum(count.values())
    share = min(max(count.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}  # one object a word keeps the sample small
        seen = []
        for batch in batches:
            for i, text, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "y")), strict=True):
                seen.append((i.as_py(), y.as_py(), [known.setdefault(w, w) for w in _words(text.as_py())]))
        seen.sort(key=lambda r: (r[0], r[2]))
        model = fit([w for _, y, w in seen if y == 1], [w for _, y, w in seen if y == 0], share)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # A task trains, so the driver holds no text; what comes back is two dictionaries and some weights.
    made = found.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], [], None)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double ``name``: 0 to 1, higher the likelier toxic; every window of every text counts.

    Null and empty texts get the score of no windows at all. Other columns pass
    through; if ``name`` is one of them the new one gets underscores before it.
    """
    name = free_name(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    columns = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of under 64 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = held.value.margins()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            parts = (texts.slice(at, 64).cast(pa.large_binary()).to_pylist() for at in range(0, len(texts), 64))
            x = np.array([features(margins, _words(t)) for part in parts for t in part]).reshape(len(texts), 2 * TOP + 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(x))], [*columns, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted (1 if score >= 0.5).

    Repeated rows get equal scores; a null id is not held out; no rows: no rows.
    """
    model = train(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")), model)
    held = F.coalesce(F.expr(f"crc32(encode(cast(`{id_col}` as string), 'utf-8')) % 5 = 0"), F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
