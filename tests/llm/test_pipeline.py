"""The pipeline's whole result against plain versions of its stages, and what each stage does with odd rows."""

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_brute_force import fingerprint, linked, lower
from test_language_id import plain_identify, plain_tables
from test_secrets import plain_cut, plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
from geostrata.llm import common, language_id, packing, secrets
from geostrata.llm.common import read_table, written_and_reread

SF_DIR = "/root/testdata/sf0.001"
ODD = [(None, None, None, None, None), (900001, None, "en", "a", 0), (900002, "", None, "a", 0), (900003, "12 34", "en", "a", 5), (900004, "the end of the day", None, "b", 18), (900004, "the end of the day", None, "b", 18), (900005, "the house and the garden in the evening " * 5_000, None, "b", 200_000)]


def documents(spark, odd=True):
    docs = read_table(spark, SF_DIR, "documents")
    return docs.union(spark.createDataFrame(ODD, docs.schema)) if odd else docs


def benchmark_windows(items):
    word, found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for text in items:
        words = word.findall(lower(text or ""))
        found |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12)) if words}
    return found


def contaminated(text, windows):
    words, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or "")), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_run_equals_plain_stages(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in documents(spark, odd=False).collect()]
    learning = language_id.learning_rows(documents(spark, odd=False)).collect()
    identify = plain_identify(plain_tables([(r.text, r.lang) for r in learning]))
    kept = [(k, t) for k, t, _ in rows if identify(t)[0] != "und" and identify(t)[1] >= 0.5]
    fps = {k: fingerprint(t) for k, t in kept}
    root, best = linked(list(fps.values())), {}
    for k, f in fps.items():
        best[root[f]] = min(k, best.get(root[f], k))
    kept = [(k, t) for k, t in kept if best[root[fps[k]]] == k]
    windows = benchmark_windows([r.text for r in read_table(spark, SF_DIR, "benchmark").collect()])
    kept = [(k, t) for k, t in kept if not contaminated(t, windows)]
    table = secrets.fit(spark.createDataFrame(kept, "doc_id long, text string"))
    kept = [(k, plain_cut(t, plain_spans(t, table))) for k, t in kept]
    library, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for k, t in kept:
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 2], 0
        for n in packing.cut_lengths(len(ids)):
            expected[k, at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + n])), len(ids)] += 1
            at += n
    found = corpus_pipeline.run(spark, SF_DIR)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found.collect()) == expected
    assert len(expected) > 100


@pytest.mark.parametrize("extra", [False, True])
def test_stages_and_odd_rows(spark, extra):
    docs = documents(spark)
    if extra:  # names that stages might use themselves
        docs = docs.withColumns({name: F.lit("clash") for name in ("tag", "row", "row_number", "fp", "key", "spans", "score", "n_words")})
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written_and_reread(stage(spark, docs, SF_DIR))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before.count()
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    assert not {None, 900001, 900002, 900003} & set(ids["language_id"]) and ids["language_id"].count(900004) == 2
    assert ids["near_duplicates"].count(900004) == 1 and 900005 in ids["near_duplicates"]
    assert sorted(ids["secrets"]) == sorted(ids["decontamination"]) and set(ids["packing"]) == set(ids["secrets"])


def test_stages_take_nulls(spark):
    """Each stage by itself over rows that an earlier one would have dropped."""
    docs = documents(spark)
    n = docs.count()
    assert corpus_pipeline.decontaminate(spark, docs, SF_DIR).where("text IS NULL OR doc_id >= 900000").count() == len(ODD)
    assert corpus_pipeline.redact_secrets(spark, docs, SF_DIR).count() == n
    once = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()]
    assert None not in once and len(set(once) & {900001, 900002}) <= 1
    assert corpus_pipeline.pack(spark, docs, SF_DIR).where("doc_id IS NULL").select("length").collect()[0].length == 1


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written_and_reread(stage(spark, docs, SF_DIR))
        assert docs.count() == 0, name


def test_run_deletes_what_stages_wrote(spark):
    begun = len(common.WRITTEN)
    corpus_pipeline.run(spark, SF_DIR).count()
    assert len(common.WRITTEN) == begun + len(corpus_pipeline.STAGES)
