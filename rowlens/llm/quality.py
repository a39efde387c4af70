"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (hashed to ``WORD_BUCKETS``, weighted by the
root of their counts), and one of a few steps for each statistic of its
structure (shares of capitals, symbols, digits, stop words, repeats, ...) and
of its length. The score is

    sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)),

which gives all pairwise interactions in time linear in the features. It is
fitted on the driver by AdaGrad on at most ``SAMPLE`` labelled rows, chosen by a
hash of doc_id; the model, WORD_BUCKETS and some more rows of FACTORS + 1
numbers whatever the corpus, is broadcast, and every text is scored whole.
Neither labels nor lang, source or doc_id are features.

Defined cases: a null text counts as empty; an empty text has the score of its
statistics alone; labels that are null or contradict each other for a doc_id
are not learned from; without labels of both kinds the score is the share of
label 1 (0.5 if there is none); equal texts have equal scores; an empty table
gives an empty result; ``score`` ignores other columns and ``keep`` keeps them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import aliased, claim, fields, plain, ship, sliced, text_of
from rowlens.llm.html_text import STOP_WORDS
from rowlens.llm.jaccard_join import _HASHES, _WORD

#: Most labelled rows that the model is fitted on.
SAMPLE = 6000
WORD_BUCKETS, FACTORS = 1 << 15, 8
ACCEPTED = 0.7
#: Rows with this remainder of crc32(doc_id as text) by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 64, 0.05, 1e-4, 11

_EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 0.95])
_STATS = (
    "upper letter digit space stop_mark bang hash dollar percent amp star bar other_symbol other "
    "word_length distinct same_as_last same_as_fifth top_word stop_words lines distinct_lines length"
).split()
_STEPS = len(_EDGES) + 1
SIZE = WORD_BUCKETS + len(_STATS) * _STEPS


def _byte_kinds() -> np.ndarray:
    """The number of the first statistics by byte; bytes of longer characters are letters."""
    kinds = np.full(256, _STATS.index("other"), np.int64)
    for i in range(256):
        c = chr(i)
        if i >= 128 or c.isalpha():
            kinds[i] = _STATS.index("upper" if i < 128 and c.isupper() else "letter")
        elif c.isdigit():
            kinds[i] = _STATS.index("digit")
        elif c.isspace():
            kinds[i] = _STATS.index("space")
        elif c in ".,;:?'\"()-":
            kinds[i] = _STATS.index("stop_mark")
        elif c.isprintable():
            marks = {"!": "bang", "#": "hash", "$": "dollar", "%": "percent", "&": "amp", "*": "star", "|": "bar"}
            kinds[i] = _STATS.index(marks.get(c, "other_symbol"))
    return kinds


_KINDS = _byte_kinds()
_COUNTED = _STATS.index("word_length")
_STOPS = frozenset(_HASHES[w] for w in STOP_WORDS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, each once, and values of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    claim("words", _HASHES.clear)
    share = np.zeros(len(_STATS))
    n = max(1, len(raw))
    share[:_COUNTED] = np.bincount(_KINDS[raw], minlength=_COUNTED) / n
    found = _WORD.findall(text.lower())
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    words, counts = np.unique(h, return_counts=True)
    m = max(1, len(h))
    lines = text.split("\n")
    stops = sum(int(c) for w, c in zip(words.tolist(), counts.tolist()) if w in _STOPS) if len(h) else 0
    share[_COUNTED:] = (
        sum(map(len, found)) / m / 20,
        len(words) / m,
        float((h[1:] == h[:-1]).sum()) / m,
        float((h[5:] == h[:-5]).sum()) / m,
        float(counts.max()) / m if len(h) else 0.0,
        stops / m,
        min(1.0, 40 * len(lines) / n),
        len(set(lines)) / len(lines),
        np.log2(1 + len(text)) / 20,
    )
    steps = np.searchsorted(_EDGES, share, "right")
    own = WORD_BUCKETS + np.arange(len(_STATS)) * _STEPS + steps
    buckets, back = np.unique((words % np.uint64(WORD_BUCKETS)).astype(np.int64), return_inverse=True)
    weight = np.sqrt(np.bincount(back, counts, len(buckets))) if len(buckets) else np.zeros(0)
    norm = np.sqrt((weight**2).sum()) or 1.0
    return np.concatenate([buckets, own]).astype(np.int32), np.concatenate([weight / norm, np.full(len(own), 0.5)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid of rows that begin at starts, and their factor sums; every row has a feature."""
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def score(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, values, starts)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> Machine:
    rng = np.random.Generator(np.random.PCG64(seed))
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.01, (SIZE, FACTORS)).astype(np.float32))
    ones = int(labels.sum())
    if not 0 < ones < len(labels):
        share = ones / len(labels) if len(labels) else 0.5
        machine.bias = float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30))
        machine.factors[:] = 0
        return machine
    machine.bias = float(np.log(ones / (len(labels) - ones)))
    seen_linear, seen_factors, seen_bias = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            sizes = np.array([len(rows[k][0]) for k in pick])
            starts = np.cumsum(sizes) - sizes
            ids, values = np.concatenate([rows[k][0] for k in pick]), np.concatenate([rows[k][1] for k in pick])
            raw, sums = machine.raw(ids, values, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]).astype(np.float32)
            own = np.repeat(np.arange(len(pick)), sizes)
            e = error[own] * values
            touched, at = np.unique(ids, return_inverse=True)
            g = np.bincount(at, e, len(touched)).astype(np.float32) + DECAY * machine.linear[touched]
            each = e[:, None] * (sums[own] - machine.factors[ids] * values[:, None])
            gf = np.stack([np.bincount(at, each[:, f], len(touched)) for f in range(FACTORS)], 1).astype(np.float32) + DECAY * machine.factors[touched]
            gb = float(error.sum())
            seen_linear[touched] += g * g
            seen_factors[touched] += gf * gf
            seen_bias += gb * gb
            machine.linear[touched] -= RATE * g / np.sqrt(seen_linear[touched])
            machine.factors[touched] -= RATE * gf / np.sqrt(seen_factors[touched])
            machine.bias -= RATE * gb / float(np.sqrt(seen_bias))
    return machine


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1):
        found = [features(t) for t in batch.column(1).to_pylist()]
        ids, values = ([x[i].tobytes() for x in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["label", "ids", "values"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits a model on at most ``sample`` documents that are not held out."""
    ship(docs.sparkSession)
    docs, labels = fields(docs, "doc_id", "text"), fields(labels, "doc_id", "quality")
    known = labels.filter(labels["quality"].isin(0, 1) & labels["doc_id"].isNotNull()).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("label"), F.max("quality").alias("_most")).filter("label = _most").select("doc_id", "label")
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(known), "doc_id")  # at most `sample` rows
    # a doc_id may have several rows; which are kept is settled by their hash
    texts = texts.select("label", "text", F.xxhash64("doc_id").alias("_a"), F.xxhash64("text").alias("_b"))
    chosen = texts.select("label", "text", "_a", "_b").orderBy("_a", "_b").limit(sample)
    rows = chosen.select("label", "text").mapInArrow(_featured, "label int, ids binary, values binary").collect()
    found = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i]["ids"]), rows[i]["label"]))
    return fit([found[i] for i in order], np.array([rows[i]["label"] for i in order], np.float32))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = model.value
        for batch in sliced(batches, 2):
            found = [features(t) for t in batch.column(2).to_pylist()]
            scores = np.zeros(len(found))
            for i in range(0, len(found), 512):
                part = found[i : i + 512]
                sizes = np.array([len(x[0]) for x in part])
                ids, values = (np.concatenate([x[k] for x in part]) for k in (0, 1))
                scores[i : i + 512] = machine.score(ids, values, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= ACCEPTED).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    docs = fields(docs, "doc_id", "text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text_of(docs).alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int")


def _sieve(model, text: int):
    score_batches = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            n = len(batch)
            texts = pa.RecordBatch.from_arrays([pa.nulls(n), pa.nulls(n), batch.column(text)], names=["a", "b", "c"])
            kept = np.concatenate([b.column(3).to_numpy() == 1 for b in score_batches(iter([texts]))])
            yield batch.select(list(range(text))).filter(pa.array(kept))

    return run


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    from pyspark.sql.types import StructField, StructType

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows, column = aliased(docs)
    names = rows.columns
    rows = rows.select(*names, plain(column("text")).alias("_text"))
    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(names, docs.schema.fields)])
    return rows.mapInArrow(_sieve(model, len(names)), schema).toDF(*docs.columns)
