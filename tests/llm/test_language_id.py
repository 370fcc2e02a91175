"""Language identification against a plain version of the backoff, and the sample that it learns from."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geostrata.llm import language_id as li


def plain_tables(rows):
    """(languages, words, grams by size): counts by token and language of distinct (lang, text)."""
    languages = [k for k, _ in sorted(Counter(lang for _, lang in rows if lang is not None).items(), key=lambda x: (-x[1], x[0]))]
    words = defaultdict(Counter)
    for text, lang in {(t, k) for t, k in rows if t is not None and k is not None}:
        for w in li.WORD.findall(text.lower()):
            words[w][lang] += 1
    grams = {size: defaultdict(Counter) for size in (4, 3, 2, 1)}
    for w, n in words.items():
        for size, table in grams.items():
            marked = f"^{w}$" if size > 1 else w
            for at in range(len(marked) - size + 1):
                for lang, k in n.items():
                    table[marked[at : at + size]][lang] += k
    return languages, words, grams


def scored(table, languages):
    totals = {k: sum(n[k] for n in table.values()) for k in languages}
    rows = {}
    for token, n in table.items():
        logs = [math.log((n[k] + 0.5) / (totals[k] + 0.5 * (len(table) + 1))) for k in languages]
        rows[token] = [x - max(logs) for x in logs]
    return rows


def plain_identify(tables):
    languages, words, grams = tables
    words, grams = scored(words, languages), {size: scored(t, languages) for size, t in grams.items()}

    def word_row(w):
        if w in words:
            return words[w]
        for size in (4, 3, 2, 1):
            marked = f"^{w}$" if size > 1 else w
            found = [grams[size][g] for at in range(len(marked) - size + 1) if (g := marked[at : at + size]) in grams[size]]
            if found:
                return [sum(c) / len(found) for c in zip(*found, strict=True)]
        return [0.0] * len(languages)

    def identify(text):
        found = li.WORD.findall((text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        sums = [sum(c) for c in zip(*map(word_row, found), strict=True)]
        best = max(sums)
        return languages[sums.index(best)], 1 / sum(math.exp(x - best) for x in sums)

    return identify


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(900001, None, "en"), (900002, "", None), (900003, "123 _ $", "fr"), (900004, "zzqqxx wörterbüchern unbekannt", None), (900005, "日本語 テキスト", None), (900006, "the of", "en"), (900006, "the of", "en"), (900007, "palabra " * 30_000, None)]
    return own.union(spark.createDataFrame(more, "doc_id long, text string, lang string")).withColumns({"score": F.lit("clash"), "held": F.lit(1)}).persist()


def test_scores_equal_a_plain_backoff(docs):
    learning = li.learning_rows(docs)
    identify = plain_identify(plain_tables([(r.text, r.lang) for r in learning.collect()]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = li.identify(docs, li.fit(learning)).collect()
    assert len(found) == docs.count()
    for r in found:
        lang, score = identify(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_accepted_keeps_columns_and_drops_what_has_no_language(docs):
    kept = li.accepted(docs, li.fit(li.learning_rows(docs)))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not {900001, 900002, 900003} & ids and 900006 in ids
    assert li.accepted(docs, li.fit(docs.limit(0))).count() == 0


@pytest.mark.parametrize("rows,size", [(60, 1 << 30), (8000, 40_000)])
def test_sample_is_the_same_however_partitioned(docs, rows, size):
    def taken(df):
        names, sample = li.sample_of(df, sample_rows=rows, sample_bytes=size)
        return names, sorted(tuple(r) for r in sample.collect())

    (names, a), b = taken(docs.repartition(3)), taken(docs.repartition(7, "doc_id"))
    assert (names, a) == b and 0 < len(a) < docs.count()
    assert {lang for lang, _ in a} == set(range(len(names)))  # the rarest language teaches too
    for k in range(len(names)):
        own = [len(t.encode()) for lang, t in a if lang == k]
        assert len(own) == 1 or sum(own) <= size / len(names)


def test_forty_languages(spark):
    words = lambda k: " ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{'uvwxyz'[j % 6]}{'aeiou'[j % 5]}" for j in range(30))
    df = spark.createDataFrame([(100 * k + j, words(k), f"l{k:02}") for k in range(40) for j in range(1 + k % 3)], "doc_id long, text string, lang string")
    model = li.fit(df)
    assert sorted(model.languages) == [f"l{k:02}" for k in range(40)]
    assert all(r.lang_pred == f"l{r.doc_id // 100:02}" for r in li.identify(df, model).collect())


def test_ties_go_to_the_language_with_more_rows(spark):
    df = spark.createDataFrame([(1, "same words", "bb"), (2, "same words", "aa"), (3, "same words", "cc"), (4, "same words", "cc")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in li.identify(df, li.fit(df)).collect()} == {"cc"}
    assert {r.lang_pred for r in li.identify(df, li.fit(df.where("doc_id < 3"))).collect()} == {"aa"}
