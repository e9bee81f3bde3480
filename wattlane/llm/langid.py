"""Language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 slide over the UTF-8 bytes of fixed-length windows; the
largest activation of each filter in a window feeds a softmax. The network is trained in
numpy on the driver, on a bounded sample of labelled rows (``SAMPLE_ROWS`` texts, three
windows of each), and applied to all windows of every text inside the tasks. A text gets
the mean of its windows' probabilities, weighted by their bytes.

Null texts and texts without a letter are ``und`` with score 0. Without any labelled row
every text is ``und``. Ties go to the label that sorts first. Repeated rows get equal
results; rows keep all other columns, except that columns named like the two results are
replaced.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import bound_batches

WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bytes of a window, and zero bytes at least after each text.
WINDOW, PAD = 256, 4
#: Most labelled texts that a model is fitted on, and most labels (the most frequent ones).
SAMPLE_ROWS, MAX_LABELS = 4_000, 1_000
#: Small samples are gone through more often, for this many steps.
LEAST_STEPS = 400
UNKNOWN = "und"
#: Bytes whose activations are held at once.
CHUNK = 1 << 20


@dataclass
class Model:
    labels: list[str]
    tables: list[np.ndarray]  # per width and offset: 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray  # features x labels
    out_bias: np.ndarray


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each filled up with zeros to whole windows; window counts; lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = (lengths + PAD + WINDOW - 1) // WINDOW
    flat = np.zeros(int(counts.sum()) * WINDOW + PAD, np.uint8)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        flat[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * WINDOW
    return flat, counts, lengths


def _pairs(model: Model) -> list[tuple[list[tuple[int, np.ndarray, bool]], np.ndarray]]:
    """Per width: (offset, table, of two bytes); neighbouring offsets share a table of byte pairs."""
    out, at = [], 0
    for k, width in enumerate(WIDTHS):
        own, parts = model.tables[at:at + width], []
        for o in range(0, width - 1, 2):
            parts.append((o, (own[o + 1][:, None, :] + own[o][None, :, :]).reshape(-1, FILTERS).copy(), True))
        if width % 2:
            parts.append((width - 1, own[-1], False))
        out.append((parts, model.bias[k]))
        at += width
    return out


def _pooled(flat: np.ndarray, tables) -> np.ndarray:
    """(windows, features): the largest activation of each filter in each window."""
    n = len(flat) - PAD
    out = np.empty((n // WINDOW, len(WIDTHS) * FILTERS), np.float32)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        one = flat[start:stop + PAD].astype(np.uint16)
        two = one[:-1] | (one[1:] << 8)
        for k, (parts, bias) in enumerate(tables):
            total = None
            for offset, table, double in parts:
                rows = np.take(table, (two if double else one)[offset:offset + stop - start], axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            best = total.reshape(-1, WINDOW, FILTERS).max(axis=1) + bias
            out[start // WINDOW:stop // WINDOW, k * FILTERS:(k + 1) * FILTERS] = np.maximum(best, 0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def classify(model: Model, tables, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): probabilities; whole texts, window by window."""
    out = np.zeros((len(texts), len(model.labels)))
    if not texts:
        return out
    flat, counts, lengths = _flat(texts)
    p = _softmax(_pooled(flat, tables) @ model.out + model.out_bias)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    filled = np.clip(lengths[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, 0, WINDOW)
    for j in range(p.shape[1]):
        out[:, j] = np.bincount(owner, p[:, j] * filled, len(texts))
    return out / np.maximum(lengths, 1)[:, None]


def fit(texts: list[bytes], labels: list[str], epochs: int = 8, seed: int = 7) -> Model:
    """Train on windows of at most ``WINDOW - PAD`` bytes each."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(names, labels)
    x = np.zeros((len(texts), WINDOW + PAD), np.uint8)
    for i, t in enumerate(texts):
        cut = t[:WINDOW - PAD]
        x[i, :len(cut)] = np.frombuffer(cut, np.uint8)
    params = [rng.normal(0, 0.3, (256, FILTERS)) for w in WIDTHS for _ in range(w)]
    params += [np.zeros((len(WIDTHS), FILTERS)), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))), np.zeros(len(names))]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(y) / len(names) / np.maximum(np.bincount(y, minlength=len(names)), 1))[y]
    batches = max(1, len(y) // 64)
    for _ in range(max(epochs, LEAST_STEPS // batches)):
        order = rng.permutation(len(y))
        for part in np.array_split(order, batches):
            bytes_, truth = x[part], y[part]
            rows, feats, places, at = np.arange(len(part))[:, None], [], [], 0
            for k, width in enumerate(WIDTHS):
                total = sum(params[at + o][bytes_[:, o:o + WINDOW]] for o in range(width))
                place = total.argmax(axis=1)
                places.append(place)
                feats.append(total[rows, place, np.arange(FILTERS)] + params[-3][k])
                at += width
            raw = np.hstack(feats)
            hidden = np.maximum(raw, 0)
            delta = _softmax(hidden @ params[-2] + params[-1])
            delta[np.arange(len(part)), truth] -= 1
            delta *= weight[part][:, None] / len(part)
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = hidden.T @ delta, delta.sum(axis=0)
            back, at = (delta @ params[-2].T) * (raw > 0), 0
            for k, width in enumerate(WIDTHS):
                own = back[:, k * FILTERS:(k + 1) * FILTERS]
                grads[-3][k] = own.sum(axis=0)
                for o in range(width):
                    np.add.at(grads[at + o], (bytes_[rows, places[k] + o], np.arange(FILTERS)[None, :]), own)
                at += width
            step += 1
            for i, g in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                params[i] = params[i] - 0.01 * (m1[i] / (1 - 0.9 ** step)) / (np.sqrt(m2[i] / (1 - 0.999 ** step)) + 1e-8)
    f32 = [p.astype(np.float32) for p in params]
    return Model(names, f32[:-3], f32[-3], f32[-2], f32[-1])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from an even sample of the labels; None if no row has a label and a letter.

    A label gives up to its share of ``sample_rows`` different texts, so copies of one text
    count once and crowd out nothing.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & has_letter(F.col("text")))
    rows = rows.withColumn("r", F.xxhash64("text", "label"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("r").alias("texts")).orderBy(
        F.desc("texts"), "label").limit(MAX_LABELS).collect()
    if not counts:
        return None
    each = sample_rows / len(counts)
    share = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(min(1.0, 1.25 * each / max(r["texts"], 1)))) for r in counts])
    chosen = rows.where(F.pmod("r", F.lit(1_000_000)) < share * 1_000_000).withColumn("n", F.length("text"))
    cuts = [F.substring("text", 1 + F.pmod(F.shiftright("r", s), F.greatest(F.col("n") - size, F.lit(1))).cast("int"), size)
            for s, size in ((3, WINDOW - PAD), (11, 60), (19, 20))]
    texts = chosen.select("r", "label", F.array(*[c.substr(F.lit(1), F.lit(WINDOW)) for c in cuts]).alias("cuts")).dropDuplicates(["r", "label"])
    first = texts.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("r"))).where(F.col("i") <= math.ceil(each))
    sample = first.select("r", "label", F.explode("cuts").alias("cut")).where(has_letter(F.col("cut"))).orderBy(
        "r", "label", "cut").limit(3 * sample_rows).collect()
    return fit([r["cut"].encode() for r in sample], [r["label"] for r in sample]) if sample else None


def predict(documents: DataFrame, model: Model | None, text_col: str = "text",
            label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The rows with the predicted label and its probability."""
    kept = documents.select([F.col(f"`{c}`") for c in documents.columns if c not in (label_out, score_out)])
    if model is None:
        return kept.withColumns({label_out: F.lit(UNKNOWN), score_out: F.lit(0.0)})
    bound_batches(documents.sparkSession)
    schema = T.StructType([*kept.schema.fields, T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = _pairs(model), np.array(model.labels, object)
        for batch in batches:
            texts = [x or b"" for x in batch.column(text_col).cast(pa.large_binary()).to_pylist()]
            p = np.vstack([classify(model, tables, texts[i:i + 256]) for i in range(0, len(texts), 256)]) if texts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[p.argmax(axis=1)].tolist(), pa.string()), pa.array(p.max(axis=1, initial=0).clip(0, 1))],
                names=schema.names)

    known = has_letter(F.col(text_col))
    return kept.mapInArrow(run, schema).withColumns({
        label_out: F.when(known, F.col(label_out)).otherwise(UNKNOWN),
        score_out: F.when(known, F.col(score_out)).otherwise(0.0)})


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is set aside for evaluation; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out; predict all of them."""
    return predict(documents, train(documents.where(~held_out() & F.col("doc_id").isNotNull())))


def keep_known(documents: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The documents, with their columns, whose language was recognised."""
    marked = predict(documents, train(documents.where(~held_out() & F.col("doc_id").isNotNull())), label_out="__lang", score_out="__score")
    return marked.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score)).drop("__lang", "__score")
