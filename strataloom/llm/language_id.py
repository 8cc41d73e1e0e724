"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3, blended) that both contain,
over the geometric mean of the numbers that each contains. Letters are compared in lower case, all
else counts as space, and a gram of spaces alone is none. Grams are hashed into a presence vector with a
range of its own for every n, so that every gram of every script counts, seen in the fit or not. Ridge
regression in this kernel is fitted one language against the rest, on a Nyström approximation by
landmark texts. The presence kernel is an inner product of 0/1 vectors, so scores of a batch of texts
are products of its presence matrix with the landmarks' weights.

A text in none of the languages shares fewer grams with them than their own texts do. How many those share depends on
the length, so the fit also cuts pieces of all lengths from its sample, and keeps for every class of length the score
that nearly all pieces reach (``floor``). A text below the floor of its class resembles no learned language.

The fit takes a bounded sample of labelled rows (``per_language`` each, by hash of identifier and
text); predictions read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import keep

PER_LANGUAGE = 400
LANDMARKS = 256
MAX_LANGUAGES = 200  # each brings its sample to the driver; more stop the fit with an error
RIDGE = 0.1
BITS = (10, 13, 15)  # hashed places for one, two and three characters
FLOOR_QUANTILE = 0.005
FLOOR_SHARE = 0.6
CLASSES = 24  # classes of length, by doublings of the number of places
BATCH = 64  # texts per matrix product
_CHUNK = 1 << 20
_SPACE = 32
_STARTS = np.cumsum([0, *(1 << b for b in BITS)])
SIZE = int(_STARTS[-1])
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def in_fold(id_: Column) -> Column:
    """True if the row is held out: crc32 of the identifier as text is divisible by 5."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> Iterator[np.ndarray]:
    """Code points in lower case, other characters as spaces, in chunks that overlap by two."""
    text = text.lower()
    for at in range(0, max(len(text), 1), _CHUNK):
        codes = np.frombuffer(f" {text[at:at + _CHUNK + 2]} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        yield np.where(_letters()[codes], codes, np.uint64(_SPACE))


def places(codes: np.ndarray) -> np.ndarray:
    """Hashed places of the grams of one chunk, with repetitions; grams without a letter have none."""
    letter = codes != _SPACE
    one, out = codes, []
    for n, bits in enumerate(BITS, start=1):
        if len(codes) < n:
            break
        gram = one[: len(codes) - n + 1] * np.uint64(_MIX[0])
        held = letter[: len(gram)].copy()
        for i in range(1, n):
            gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(_MIX[i]) + codes[i: len(codes) - n + 1 + i]
            held |= letter[i: i + len(gram)]
        gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(_MIX[-1])
        out.append(((gram >> np.uint64(64 - bits)).astype(np.int64) + _STARTS[n - 1])[held])
    return np.concatenate(out)


def fill(row: np.ndarray, text: str) -> bool:
    """Set the places of ``row`` that ``text`` holds; False if it has no letter."""
    found = False
    for codes in _codes(text):
        at = places(codes)
        row[at] = 1
        found = found or len(at) > 0
    return found


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed presence vectors of the texts that have letters."""
    for batch in batches:
        bits = []
        for text in batch.column(0).to_pylist():
            row = np.zeros(SIZE, np.uint8)
            bits.append(np.packbits(row).tobytes() if fill(row, text) else None)
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(bits, pa.binary())], names=["lang", "rank", "bits"])


def pieces(text: str, rank: int) -> list[str]:
    """The text, a half, a quarter and so on, each from a place that the rank decides."""
    out, n = [text], len(text)
    while n > 8:
        n //= 2
        at = (rank * 7919) % (len(text) - n + 1)
        out.append(text[at:at + n])
    return out


def _piece_scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Number of places and score for their own language, of all pieces of the texts."""
    for batch in batches:
        for text, lang, rank in zip(*(c.to_pylist() for c in batch.columns)):
            parts = pieces(text, rank)
            x = np.zeros((len(parts), SIZE), np.float32)
            lettered = np.array([fill(row, part) for row, part in zip(x, parts)])
            own = model.scores(x)[:, model.languages.index(lang)] if lang in model.languages else np.zeros(len(parts))
            yield pa.record_batch([pa.array(x.sum(axis=1)[lettered].astype(float)), pa.array(own[lettered].astype(float))], names=["size", "own"])


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised presence kernel between the rows of two 0/1 matrices."""
    nx, ny = np.sqrt(np.maximum(x.sum(axis=1), 1)), np.sqrt(np.maximum(y.sum(axis=1), 1))
    return (x @ y.T) / nx[:, None] / ny[None, :]


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(sizes, 1))).astype(int), CLASSES - 1)


class Model:
    """``weights``: one column per language, over the hashed places; ``floors``: one score per class of length."""

    def __init__(self, languages: list[str], weights: np.ndarray, floors: np.ndarray):
        self.languages, self.weights, self.floors = languages, weights, floors

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def _floors(sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Score that nearly all pieces of a class reach; classes without pieces take that of the next shorter ones."""
    floors, last = np.zeros(CLASSES), 0.0
    classes = length_class(sizes)
    for c in range(CLASSES):
        scores = own[classes == c]
        if len(scores):
            last = max(last, FLOOR_SHARE * float(np.quantile(scores, FLOOR_QUANTILE)))
        floors[c] = last
    return floors


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE,
) -> Model | None:
    """A model from rows that are not held out and have text and language; None if there are none.

    What reaches the driver is bounded: ``per_language`` packed vectors for each language, and two numbers for every
    halving of their texts; over ``MAX_LANGUAGES`` languages are an error. Rows that repeat identifier, language and
    text count once.
    """
    id_, text = F.col(id_col), F.col(text_col)
    usable = docs.where(text.isNotNull() & F.col(lang_col).isNotNull() & id_.isNotNull() & ~in_fold(id_))
    usable = usable.select(id_.alias("id"), F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(id_, text).alias("h"))
    # a share of each language by hash, about four times what is needed, so that no task ranks a whole language
    sizes = keep(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if sizes.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    share = F.lit(float(4 * per_language << 20)) / F.col("n")
    drawn = usable.select("id", "lang", "h").join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "id", "h")
    chosen = drawn.select("id", "lang", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    sample = keep(usable.join(F.broadcast(keep(chosen)), ["id", "lang", "h"]).dropDuplicates(["lang", "rank"]).select("text", "lang", "rank"))
    rows = [r for r in sample.mapInArrow(_presence, "lang string, rank int, bits binary").collect() if r["bits"] is not None]
    if not rows:
        return None
    rows.sort(key=lambda r: (r["rank"], r["lang"]))  # languages take turns as landmarks
    languages = sorted({r["lang"] for r in rows})
    packed = np.stack([np.frombuffer(r["bits"], np.uint8) for r in rows])
    y = np.array([[float(r["lang"] == c) for c in languages] for r in rows])
    marks = np.unpackbits(packed[:landmarks], axis=1).astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    use = values > 1e-8 * values[-1]
    root = vectors[:, use] / np.sqrt(values[use])
    parts = (np.unpackbits(packed[at:at + 256], axis=1).astype(np.float32) for at in range(0, len(packed), 256))
    phi = np.concatenate([kernel(x, marks).astype(np.float64) @ root for x in parts])
    beta = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    normed = marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    model = Model(languages, (normed.T @ (root @ beta)).astype(np.float32), np.zeros(CLASSES))
    found = sample.mapInArrow(partial(_piece_scores, model=model), "size double, own double").toPandas()
    model.floors = _floors(found["size"].to_numpy(), found["own"].to_numpy())
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, carried: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    languages = np.array(model.languages, object)
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            texts = part.column(text_at).to_pylist()
            best, top = np.full(len(texts), "und", object), np.zeros(len(texts))
            x = np.zeros((len(texts), SIZE), np.float32)
            lettered = np.array([fill(row, t or "") for row, t in zip(x, texts)])
            scores = model.scores(x)
            best[lettered] = languages[scores.argmax(axis=1)[lettered]]
            top[lettered] = np.clip(scores.max(axis=1)[lettered], 0.0, 1.0)
            familiar = lettered & (scores.max(axis=1) >= model.floors[length_class(x.sum(axis=1))])
            yield pa.record_batch([*(part.column(i) for i in carried), pa.array(best, pa.string()), pa.array(top), pa.array(familiar)], names=names)


def identify(
    docs: DataFrame, model: Model | None = None, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", pred_col: str = "lang_pred", score_col: str = "score", familiar_col: str = "familiar", **fitting,
) -> DataFrame:
    """One row per row of ``docs``: the columns of ``carry`` (the identifier alone), ``lang_pred, score, familiar``.

    ``score`` is the winning regression value cut to 0..1; ``familiar`` tells whether it reaches the floor of the text's
    length. Texts that are null or have no letter get ``und``, 0 and false, and so do all rows if there is nothing to
    learn from. Columns that are not carried are not read.
    """
    carry = carry or [id_col]
    model = model or fit(docs, id_col, text_col, lang_col, **fitting)
    if model is None:
        return docs.select(*(F.col(f"`{c}`") for c in carry), F.lit("und").alias(pred_col), F.lit(0.0).alias(score_col), F.lit(False).alias(familiar_col))
    read = carry if text_col in carry else [*carry, text_col]
    rows = docs.select(*(F.col(f"`{c}`") for c in read))
    new = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType()), T.StructField(familiar_col, T.BooleanType())]
    schema = T.StructType([rows.schema[c] for c in carry] + new)
    predict = partial(_predict, model=model, text_at=read.index(text_col), carried=[read.index(c) for c in carry], names=schema.names)
    return rows.mapInArrow(predict, schema)
