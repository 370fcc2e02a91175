"""A quality classifier by compression with zstandard dictionaries.

One dictionary is built from pieces of good and one from pieces of bad labelled texts. A text is
compressed in pieces under both; the difference of the sizes, over the text's length, says which of
the two it resembles. A logistic curve, fitted on labelled texts that no dictionary has seen, makes
that difference a probability.

Fitting takes a bounded sample of the labelled rows: SAMPLE_DOCS texts a class at most, and of them
SAMPLE_PIECES pieces a class for a dictionary. Scoring reads every whole text and shuffles nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import doc_remainder, map_slices, read_table, with_fields

SAMPLE_DOCS = 3_000
SAMPLE_PIECES = 4_000
#: Code points of a piece for a dictionary; bytes of a piece that is scored.
SAMPLE_PIECE = 2_000
PIECE = 400
DICTIONARY_BYTES = 112_640
LEVEL = 1
CUT = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good texts, and the curve 1 / (1 + exp(-(slope * x + base)))."""

    bad: bytes
    good: bytes
    slope: float
    base: float


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or of too few pieces to train one all of them, as they are."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)


class Contrast:
    """(bad size - good size) / (bytes + 1) of texts."""

    def __init__(self, bad: bytes, good: bytes) -> None:
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (bad, good)]

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode()
        pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
        bad, good = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        return (bad - good) / (len(raw) + 1)


def logistic(x: list[float], y: list[int]) -> tuple[float, float]:
    """Slope and base of the likeliest curve, by Newton's method with a slight ridge."""
    scale = max(map(abs, x), default=0.0) or 1.0
    a = b = 0.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-3 * b, 1e-3, 0.0, 1e-3
        for u, v in zip(x, y, strict=True):
            u /= scale
            p = probability(a * u + b)
            w = p * (1 - p)
            ga, gb, haa, hab, hbb = ga + (v - p) * u, gb + v - p, haa + w * u * u, hab + w * u, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        limit = max(1.0, abs(da) / 4, abs(db) / 4)
        a, b = a + da / limit, b + db / limit
        if abs(da) + abs(db) < 1e-9:
            break
    return a / scale, b


def probability(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))


def _contrasts(bad: bytes, good: bytes):
    contrast = Contrast(bad, good)
    return lambda labels, texts: (labels, [contrast(t) for t in texts])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Fitted on labelled rows of docs; labels has (key, label), label 1 for good and 0 for bad.

    A key with both labels, a null key or a null label teaches nothing; of a key's repeated rows in
    docs the one of the least text does. Without labelled rows of both classes, each text gets the classes' prior.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high").select("key", F.col("low").cast("int").alias("good"))
    chosen = None
    for good in (0, 1):
        part = known.where(F.col("good") == good).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.union(part)
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # 2 * SAMPLE_DOCS rows of two numbers at most
    sample = own.join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("good").alias("good"), F.min("text").alias("text")).persist()
    try:
        teaches = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(3)) > 0
        cut = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(SAMPLE_PIECE)), lambda at: F.struct(at.alias("at"), F.substr("text", at + 1, F.lit(SAMPLE_PIECE)).alias("piece"))))
        pieces = sample.where(teaches).select("key", "good", cut.alias("x")).select("key", "good", "x.*").where("piece <> ''")
        taught = {good: [r.piece.encode() for r in pieces.where(F.col("good") == good).orderBy(F.xxhash64("key", "at"), "key", "at").limit(SAMPLE_PIECES).select("piece").collect()] for good in (0, 1)}
        counts = {r.good: r["count"] for r in sample.groupBy("good").count().collect()}
        prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
        if not taught[0] or not taught[1]:
            return Model(b"", b"", 0.0, prior)
        bad, good = dictionary(taught[0]), dictionary(taught[1])
        seen = map_slices(sample.where(~teaches).select("good", "text"), "good int, x double", _contrasts, bad, good).collect()
        if len({r.good for r in seen}) < 2:
            return Model(b"", b"", 0.0, prior)
        return Model(bad, good, *logistic([r.x for r in seen], [r.good for r in seen]))
    finally:
        sample.unpersist()


def _scorer(model: Model, cut: float):
    contrast = Contrast(model.bad, model.good) if model.slope else lambda t: 0.0

    def apply(keys, held, texts):
        scores = [probability(model.slope * contrast(t) + model.base) for t in texts]
        return keys, held, scores, [int(s >= cut) for s in scores]

    return apply


def score_quality(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(key, held_out, score, predicted) for each row of df, repeated rows included.

    held_out is true where the key's crc32 modulo 4 is 2 (a null key counts as ''). Null and empty
    texts have no contrast, and get the curve's value at 0. Other columns are ignored.
    """
    schema = with_fields(df.select(df[key]).schema, "held_out boolean, score double, predicted int")
    return map_slices(df.select(df[key], doc_remainder(df[key], 4) == 2, df[text].cast("string")), schema, _scorer, model, cut)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score_quality(docs, fit(docs, labels.where(doc_remainder(F.col("doc_id"), 4) != 2)))
