"""The quality rules' references, distances and verdicts against a plain version."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geostrata.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GROUPS = (" \t\n\x0b\x0c\r", rules.SYMBOLS, rules.DIGITS, rules.CAPITALS, rules.MARKS)


def classes(text):
    n = [sum(c in g for c in text) for g in GROUPS]
    return [*n, len(text) - sum(n)]


def distance(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(0.0, total))


def plain_references(rows):
    sizes, seen, words = Counter(), defaultdict(lambda: [0] * 6), defaultdict(Counter)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            sizes[lang] += 1
            seen[lang] = [a + b for a, b in zip(seen[lang], classes(text), strict=True)]
            words[lang].update(WORD.findall(text.lower()))
    found = {}
    for lang in sizes:
        top = sorted((-n, w) for w, n in words[lang].items() if any(map(str.isalpha, w)))[:16]
        total = sum(words[lang].values())
        shares = [-n / total for n, _ in top]
        found[lang] = ([n / max(sum(seen[lang]), 1) for n in seen[lang]], [w for _, w in top], [*shares, max(0.0, 1 - sum(shares))])
    return found


def plain_verdict(text, found):
    """nearest, word distance, class distance, whether both let the text pass."""
    words, best = WORD.findall(text), None
    n = max(len(words), 1)
    for lang, (_, common, shares) in found.items():
        count = Counter(w.lower() for w in words)
        p = [count[w] / n for w in common]
        bare, held = distance([0.0] * len(common) + [1.0], shares), 1 - shares[-1]
        d = distance([*p, max(0.0, 1 - sum(p))], shares)
        best = min(best or (math.inf,), (round(d / bare, 9) if bare else 1.0, lang, d, bare, held))
    share, lang, d, bare, held = best
    seen = classes(text)
    p = [x / max(len(text), 1) for x in seen[:-1]]
    apart = distance([*p, max(0.0, 1 - sum(p))], found[lang][0])  # an empty text counts as all rest
    judged = len(words) >= max(rules.LEAST_WORDS, rules.LEAST_COMMON / held)
    words_pass = not judged or share <= min(rules.MOST_BARE_SHARE, rules.MOST_WORD_DISTANCE / bare)
    return lang, d, apart, words_pass and (len(text) < rules.LEAST_CHARS or apart <= rules.MOST_CLASS_DISTANCE)


def base_failed(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return len(words) < 50 or 100 * len({i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}) > 50 * len(words)


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(900001, None, "en"), (900002, "", "en"), (900003, "a b c " * 40, None), (900004, "#*$ " * 90, "en"), (900005, "0123 " * 63, "fr"), (900006, "the of and to zzz" * 30, None), (None, "x " * 64, "de")]
    return own.union(spark.createDataFrame(more, "doc_id long, text string, lang string")).persist()


def test_references(docs):
    expected = plain_references([tuple(r) for r in docs.collect()])
    found = rules.references(docs)
    assert {r.lang for r in found} == set(expected)
    for r in found:
        seen, words, shares = expected[r.lang]
        assert list(r.words) == words and r.classes == pytest.approx(seen) and r.shares == pytest.approx(shares)


def test_distances_and_kept(docs):
    found = plain_references([tuple(r) for r in docs.collect()])
    judged = {r.doc_id: r for r in rules.judge(docs, rules.references(docs)).collect()}
    kept = Counter()
    for k, text, _ in [tuple(r) for r in docs.collect()]:
        lang, near, apart, passes = plain_verdict(text or "", found)
        r = judged[k]
        assert r.nearest == lang and r.word_distance == pytest.approx(near, abs=1e-9) and r.class_distance == pytest.approx(apart, abs=1e-9)
        assert r.base_failed == base_failed(text or "") and r.kept == (passes and not r.base_failed)
        kept[r.kept] += 1
    assert kept[True] > 100 and kept[False] > 0


def test_forty_languages(spark):
    """As many references as languages; each text is nearest to its own, and none goes unjudged."""
    words = lambda k: " ".join(f"w{k}x{j}" if j < 12 else f"n{k}x{i}x{j}" for i in range(12) for j in range(24))
    df = spark.createDataFrame([(k, words(k), f"l{k:02}") for k in range(40)], "doc_id long, text string, lang string")
    found = rules.references(df)
    assert len(found) == 40
    for r in rules.judge(df, found).collect():
        assert r.nearest == f"l{r.doc_id:02}" and r.kept


def test_guards_act(spark, docs):
    """Texts that pass the base rules but are shorter than a minimum are not judged by that histogram."""
    found = rules.references(docs)
    strange = lambda n: " ".join(f"qx{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}zv" for k in range(n))
    df = spark.createDataFrame([(0, strange(rules.LEAST_WORDS - 1), None), (1, strange(rules.LEAST_WORDS), None), (2, "### " * 30 + strange(52), None)], "doc_id long, text string, lang string")
    at = {r.doc_id: r for r in rules.judge(df, found).collect()}
    assert not at[0].base_failed and at[0].kept and not at[1].base_failed and not at[1].kept


def test_windows_are_told_apart_by_their_words(spark):
    """As if all hashes were equal: the words decide."""
    texts = ["a b c d a b c e", "a b c", "x " * 70, "a b c a b c", "one two three four"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = F.xxhash64
    try:
        rules.F.xxhash64 = lambda *columns: F.size(F.array(*columns)).cast("long")
        found = {r.doc_id: r.n for r in df.select("doc_id", rules.repeated_words(rules.words_of(F.col("text"))).alias("n")).collect()}
    finally:
        rules.F.xxhash64 = kept
    assert found == {0: 6, 1: 0, 2: 70, 3: 6, 4: 0}


def test_no_reference_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert [r.nearest for r in rules.judge(df, []).collect()] == [None, None]
    assert rules.references(df.limit(0)) == [] and rules.judge(df.limit(0), []).count() == 0
