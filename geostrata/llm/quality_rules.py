"""Quality rules: counts of words, symbols and repeats, and divergence from the languages' histograms.

All of it is DataFrame expressions within a row; only the references take an aggregation. A reference
holds, for one language, the shares of character classes and of its most common words over all
documents of that language. A text is compared with the language whose common words it is nearest
to, by the Jensen-Shannon distance (base 2, so 0 to 1), of the words where it has at least
``least_words`` of them and of the character classes where it has at least ``least_chars``.

All words but the common ones are one class, so a text with none of them is no farther from a language
than its *bare* distance, which the shares of the common words bound. Languages are therefore compared
by the share of their bare distance, and the cut is a share of it too.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import WORD_BREAK, read_table
from geostrata.llm.secrets import let, let_all

WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: Upper-case letters of ASCII and Latin-1.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
MARKS = ".,;:!?'\"()-"
CLASSES = ("white", "symbol", "digit", "capital", "mark", "rest")

COMMON_WORDS = 16
#: The minimum lengths, in code points and words, from which a text's histograms say enough to be judged.
LEAST_CHARS = 400
LEAST_WORDS = 56
MOST_CLASS_DISTANCE = 0.25
MOST_WORD_DISTANCE = 0.45
#: Of the distance of a text without common words, the share from which a text's words fail.
MOST_BARE_SHARE = 0.9
#: Common words that a text of its length must be expected to hold, for its words to be judged.
LEAST_COMMON = 8


@dataclass(frozen=True)
class Reference:
    """One language: shares of CLASSES, its common words, their shares and at last that of all other words."""

    lang: str
    classes: tuple[float, ...]
    words: tuple[str, ...]
    shares: tuple[float, ...]

    @property
    def bare(self) -> float:
        """The word distance of a text with none of the common words."""
        rest = self.shares[-1]
        return math.sqrt(max(0.0, (1 - rest + math.log2(2 / (1 + rest)) + (rest * math.log2(2 * rest / (1 + rest)) if rest > 0 else 0.0)) / 2))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


#: Stand-ins for the characters of each of CLASSES but the last; a text's own control characters of these codes count as the rest.
MARKERS = "\x01\x02\x03\x04\x05"


def class_counts(text: Column) -> Column:
    """An array of the code points of each of CLASSES but the last: one pass marks the classes, then each mark's bytes are counted."""
    groups = (WHITE, SYMBOLS, DIGITS, CAPITALS, MARKS)
    marked = F.translate(text, MARKERS + "".join(groups), "r" * len(MARKERS) + "".join(m * len(g) for m, g in zip(MARKERS, groups, strict=True)))
    return let(marked, lambda t: F.array(*[F.octet_length(t) - F.octet_length(F.replace(t, F.lit(m), F.lit(""))) for m in MARKERS]))


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text has twice or more.

    Windows of unlike hashes differ; only of those whose hash is met again are the words compared.
    """

    def covered(w: Column, hashes: Column) -> Column:
        def of(found: Column) -> Column:
            # sorted by hash: those that have an equal neighbour, then sorted by their words
            again = F.filter(found, lambda x, k: F.coalesce(x["h"] == F.get(found, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(found, k + 1)["h"], F.lit(False)))
            return let(F.sort_array(F.transform(again, lambda x: F.struct(F.concat_ws(" ", F.get(w, x["at"]), F.get(w, x["at"] + 1), F.get(w, x["at"] + 2)).alias("window"), x["at"].alias("at")))), alike)

        def alike(found: Column) -> Column:
            same = F.filter(found, lambda x, k: F.coalesce(x["window"] == F.get(found, k - 1)["window"], F.lit(False)) | F.coalesce(x["window"] == F.get(found, k + 1)["window"], F.lit(False)))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"))
            return F.aggregate(F.sort_array(F.transform(same, lambda x: x["at"])), zero, step)["n"]

        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), of)

    def of(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(w, h)))

    return let(words, of)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def js_distance(pairs: Column) -> Column:
    """Jensen-Shannon distance of an array of struct<p,q> of shares."""

    def part(x: Column, middle: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def references(df: DataFrame, text: str = "text", lang: str = "lang", common_words: int = COMMON_WORDS) -> list[Reference]:
    """Counted over all rows with a text and a lang, for every language, by falling number of rows.

    Ties go to the lesser language and word. What reaches the driver is common_words + 1 rows a language.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sized = known.select("lang", F.char_length("text").alias("size"), F.regexp_count("text", F.lit(WORD)).alias("n"), class_counts(F.col("text")).alias("classes"))
    sums = sized.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("size").alias("size"), F.sum("n").alias("n"), *[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) - 1)])
    chosen = sums.orderBy(F.desc("rows"), "lang").collect()
    counts = known.select("lang", F.explode(words_of(F.lower("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    # a word without a letter is none of the common ones, but counts among all
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.when(F.col("word").rlike(r"\p{L}"), F.col("n")).desc_nulls_last(), "word"))
    top: dict[str, list] = {}
    for r in counts.withColumn("rank", place).where((F.col("rank") <= common_words) & F.col("word").rlike(r"\p{L}")).collect():
        top.setdefault(r.lang, []).append((r["rank"], r.word, r.n))
    found = []
    for r in chosen:
        seen = [r[f"c{k}"] for k in range(len(CLASSES) - 1)]
        words = sorted(top.get(r.lang, []))
        shares = [n / r.n for _, _, n in words]
        found.append(Reference(r.lang, tuple(n / max(r["size"], 1) for n in [*seen, r["size"] - sum(seen)]), tuple(w for _, w, _ in words), (*shares, max(0.0, 1 - sum(shares)))))
    return found


TABLE = "array<struct<lang:string,classes:array<double>,words:array<string>,shares:array<double>,bare:double,cut:double,judged_from:double>>"


def measured(df: DataFrame, found: list[Reference], text: str, key: str, least_words: int, most_word_distance: float, most_bare_share: float, least_common: float, lang: str | None) -> DataFrame:
    """For each row of df: key, the base counts, unknown (its lang has no reference), and nearest, word_distance, words_pass, class_distance (null without a reference)."""
    rows = []
    for r in found:
        held = 1 - r.shares[-1]
        cut = min(most_bare_share, most_word_distance / r.bare) if r.bare > 0 else most_bare_share
        rows.append({"lang": r.lang, "classes": r.classes, "words": r.words, "shares": r.shares, "bare": r.bare, "cut": cut, "judged_from": max(float(least_words), least_common / held) if held > 0 else 1e300})
    table = F.from_json(F.lit(json.dumps(rows)), TABLE)  # a constant, as long as there are languages
    content = F.coalesce(F.col("text"), F.lit(""))
    unknown = F.coalesce(~df[lang].cast("string").isin([r.lang for r in found]), F.lit(False)) if lang in df.columns else F.lit(False)
    own = df.select(df[key].alias("key"), df[text].cast("string").alias("text"), unknown.alias("unknown")).select("key", "unknown", content.alias("text"), F.char_length(content).alias("size"), words_of(content).alias("words"))
    union = sorted({w for r in found for w in r.words})
    common = F.transform(F.filter("words", lambda w: F.lower(w).isin(union)), F.lower) if union else F.array().cast("array<string>")
    step = own.select(
        "key", "unknown", "size", F.size("words").alias("n_words"), class_counts(F.col("text")).alias("classes"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), common.alias("common"),
    )
    step = step.withColumn("of_word", let(F.col("common"), lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda w: F.struct(w, (F.size(c) - F.size(F.array_remove(c, w))).cast("double"))))))
    n, size = F.greatest("n_words", F.lit(1)), F.greatest("size", F.lit(1))
    shares = [F.col("classes")[k] / size for k in range(len(CLASSES) - 1)]
    shares.append(F.greatest(F.lit(0.0), 1 - sum(shares[1:], shares[0])))

    # what a lambda refers to is bound first: the optimizer would move its making into the lambda
    def word_distance(r: Column, of_word: Column, n: Column) -> Column:
        own_shares = let(F.transform(r["words"], lambda w: F.coalesce(of_word[w], F.lit(0.0)) / n), lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), F.aggregate(p, F.lit(1.0), lambda s, x: s - x)))))
        return js_distance(F.zip_with(own_shares, r["shares"], lambda p, q: F.struct(p.alias("p"), q.alias("q"))))

    def nearest(of_word: Column, n: Column, n_words: Column) -> Column:
        near = F.array_min(F.transform(table, lambda r: let(word_distance(r, of_word, n), lambda d: F.struct(F.when(r["bare"] > 0, F.round(d / r["bare"], 9)).otherwise(1.0).alias("bare_share"), r["lang"].alias("lang"), d.alias("d"), r.alias("r")))))
        return let(near, lambda b: F.struct(b["lang"].alias("nearest"), b["d"].alias("word_distance"), ((n_words < b["r"]["judged_from"]) | (b["bare_share"] <= b["r"]["cut"])).alias("words_pass"), b["r"]["classes"].alias("reference")))

    best = let_all([F.col("of_word"), n, F.col("n_words")], nearest)
    class_distance = js_distance(F.zip_with(F.array(*shares), F.col("best.reference"), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    done = step.withColumns({"word_chars": F.col("size") - F.col("classes")[0], "n_symbols": F.col("classes")[1], "best": best})
    return done.select(F.col("key").alias(key), *counts, F.col("size").cast("long").alias("n_chars"), "unknown", "best.nearest", "best.word_distance", "best.words_pass", class_distance.alias("class_distance"))


def judge(
    df: DataFrame, found: list[Reference], text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS,
    most_word_distance: float = MOST_WORD_DISTANCE, most_class_distance: float = MOST_CLASS_DISTANCE,
    most_bare_share: float = MOST_BARE_SHARE, least_common: float = LEAST_COMMON, lang: str | None = "lang",
) -> DataFrame:
    """One row for each row of df: key, the base counts, base_failed, kept, and the distances.

    Of languages as near, to nine digits, the lesser name is nearest. A null text has no words, and so fails the base rules. A text under the minimum lengths is not
    judged by the distance in question, nor is any text without a reference, of a lang without one
    included (lang is used where df has it). The bare share counts
    where least_common of the language's common words are expected at least. Repeated rows stay;
    other columns, clashing names included, are ignored.
    """
    m = measured(df, found, text, key, least_words, most_word_distance, most_bare_share, least_common, lang)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.coalesce(F.col("words_pass"), F.lit(True))
    classes = (F.col("n_chars") < least_chars) | F.coalesce(F.col("class_distance") <= most_class_distance, F.lit(True))
    own = (key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.select(*own, failed.alias("base_failed"), (~failed & (F.col("unknown") | (words & classes))).alias("kept"), "nearest", "word_distance", "class_distance")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
