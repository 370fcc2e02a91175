"""Language identification by words first, character n-grams for the rest.

A known word is scored by its log frequency in each language. An unseen word falls back to its
character n-grams, longest first: the 4-grams of the word with its borders if any is known, else the
3-grams, 2-grams, single characters. A text's scores are the sums over its words, and the posterior
of the best language is its score. Letters decide; a text without one is ``und``.

The tables hold every word and n-gram of a bounded sample of the labelled rows, chosen by a hash of
lang and text, so that the same rows teach however they are partitioned. All languages share the
sample alike: one that is rare is learned from as many rows as it has. So what goes to the workers is
bounded by the sample and the number of languages. Identification shuffles nothing.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import doc_remainder, hash_share, keep_rows, map_slices, read_table, with_fields

#: Labelled rows that teach, in expectation, and bytes of their texts; each language has an equal part of both, and at least one row.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 24 << 20
GRAM_SIZES = (4, 3, 2, 1)
#: Unseen words whose scores a worker remembers; at more, it forgets them and starts anew.
REMEMBERED = 50_000
UND = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, size: int) -> list[str]:
    marked = f"^{word}$" if size > 1 else word
    return [marked[at : at + size] for at in range(len(marked) - size + 1)]


class Model:
    """Log frequencies by word and by n-gram, a row for each with a column for each language."""

    def __init__(self, languages: list[str], words: pa.Table, grams: dict[int, pa.Table]) -> None:
        """Tables are (token, lang, n), lang being a place in languages."""
        self.languages = languages
        self.words, self.word_rows = self._rows(words)
        found = {size: self._rows(table) for size, table in grams.items()}
        self.grams = {size: tokens for size, (tokens, _) in found.items()}
        self.gram_rows = {size: rows for size, (_, rows) in found.items()}

    def _rows(self, table: pa.Table) -> tuple[dict[str, int], np.ndarray]:
        tokens = pc.unique(table["token"]).sort()
        n = np.zeros((len(tokens), len(self.languages)))
        n[pc.index_in(table["token"], tokens).to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
        rows = np.log((n + 0.5) / (n.sum(0) + 0.5 * (len(n) + 1)))
        return {w: k for k, w in enumerate(tokens.to_pylist())}, (rows - rows.max(1, keepdims=True, initial=-np.inf)).astype(np.float32)


class Identifier:
    """Made once a worker; remembers unseen words' scores, boundedly."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}  # of words that no table holds, after those
        self.rows = self.model.word_rows

    def _learn(self, words: list[str]) -> None:
        """Rows of unseen words: the mean over the known n-grams of the longest size that has any."""
        fresh = np.zeros((len(words), len(self.model.languages)), np.float32)
        rest = list(range(len(words)))
        for size in GRAM_SIZES:
            known, owner, at = self.model.grams.get(size, {}), [], []
            missed = []
            for k in rest:
                found = [known[g] for g in grams_of(words[k], size) if g in known]
                if found:
                    at += found
                    owner += [k] * len(found)
                else:
                    missed.append(k)
            if at:
                starts = np.flatnonzero(np.r_[True, np.diff(owner) != 0])
                sums = np.add.reduceat(self.model.gram_rows[size][at], starts, axis=0)
                fresh[np.array(owner)[starts]] = sums / np.diff(np.r_[starts, len(owner)])[:, None]
            rest = missed
        self.place.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.rows = np.concatenate([self.rows, fresh])

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.place) > REMEMBERED:
            self._reset()
        split, known = [words_of(t) for t in texts], self.model.words
        met = set(chain.from_iterable(split)) if self.model.languages else set()
        if unseen := sorted(met.difference(known, self.place)):
            self._learn(unseen)
        places = {w: known[w] if w in known else self.place[w] for w in met}
        out = []
        for words in split:
            if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):
                out.append((UND, 0.0))
                continue
            sums = self.rows[list(map(places.__getitem__, words))].sum(0, dtype=float)
            best = int(sums.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(sums - sums[best]).sum())))
        return out


def sample_of(df: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], DataFrame]:
    """The languages, by falling number of rows, and (lang, text) of the rows that teach: lang as a place in the list, texts distinct.

    A language's part of the rows is chosen by hash; of these, in the order of that hash, those within
    its part of the bytes stay, and the first in any case.
    """
    own = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    # one row a language, as the tables have one column a language
    counts = [(r.lang, r["count"]) for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    if not counts:
        return [], own.select(F.lit(0).alias("lang"), "text")
    quota = max(1.0, sample_rows / len(counts))
    shares = F.from_json(F.lit(json.dumps([{"lang": name, "at": k, "share": min(1.0, quota / n)} for k, (name, n) in enumerate(counts)])), "array<struct<lang:string,at:int,share:double>>")
    of_lang = F.map_from_entries(F.transform(shares, lambda x: F.struct(x["lang"], F.struct(x["at"], x["share"]))))[F.col("lang")]
    chosen = own.where(F.col("text").isNotNull()).withColumn("of", of_lang).where(hash_share(F.col("of.share"), "lang", "text"))
    chosen = chosen.select(F.col("of.at").alias("lang"), "text").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1)
    before = chosen.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(order), F.lit(0)))
    return [name for name, _ in counts], before.where((F.col("before") == 0) | (F.col("before") + F.octet_length("text") <= sample_bytes / len(counts))).select("lang", "text")


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Tables from a bounded sample of df's rows with a text and a lang; every such lang is learned."""
    languages, sample = sample_of(df, text, lang, sample_rows, sample_bytes)
    if not languages:
        none = pa.table({"token": pa.array([], pa.string()), "lang": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        return Model([], none, {})
    split = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    # of a bounded sample, and so bounded
    counted = sample.select("lang", split.alias("token")).groupBy("token", "lang").agg(F.count("*").alias("n")).persist()
    try:
        grams = {}
        for size in GRAM_SIZES:
            marked = F.concat(F.lit("^"), "token", F.lit("$")) if size > 1 else F.col("token")
            long_enough = counted.select("lang", "n", marked.alias("marked")).where(F.char_length("marked") >= size)
            starts = F.sequence(F.lit(1), F.char_length("marked") - (size - 1))
            each = long_enough.select("lang", "n", "marked", F.explode(starts).alias("at")).select("lang", "n", F.substr("marked", "at", F.lit(size)).alias("token"))
            grams[size] = each.groupBy("token", "lang").agg(F.sum("n").alias("n")).toArrow()
        return Model(languages, counted.toArrow(), grams)
    finally:
        counted.unpersist()


def _identify(broadcast):
    identifier = Identifier(broadcast.value)

    def apply(keys, held, texts):
        found = identifier.identify(texts)
        return keys, held, [lang for lang, _ in found], [score for _, score in found]

    return apply


def identify(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) for each row of df, repeated rows included.

    held_out is true where the key's crc32 modulo 5 is 0 (a null key counts as ''). A null text, one
    without a letter, and any text if the model has no language is ``und`` with score 0. Of languages
    that tie, the one with more rows is taken, and of these the lesser name. Other columns are ignored.
    """
    schema = with_fields(df.select(df[key]).schema, "held_out boolean, lang_pred string, score double")
    return map_slices(df.select(df[key], doc_remainder(df[key], 5) == 0, df[text].cast("string")), schema, _identify, df.sparkSession.sparkContext.broadcast(model))


def _accepts(broadcast, languages: list[str] | None, least: float):
    identifier = Identifier(broadcast.value)
    return lambda texts: [lang != UND and score >= least and (languages is None or lang in languages) for lang, score in identifier.identify(texts)]


def accepted(df: DataFrame, model: Model, text: str = "text", languages: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """df's rows, all columns untouched, whose text is in a known (or listed) language with a score of least or more.

    A null or empty text, one without a letter, and any text if the model has no language, goes. Repeated
    rows are each judged alike; other columns, clashing names included, are kept as they are.
    """
    return keep_rows(df, [text], _accepts, df.sparkSession.sparkContext.broadcast(model), languages, least)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(doc_remainder(F.col("doc_id"), 5) != 0)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(learning_rows(docs)))
