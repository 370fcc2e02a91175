"""The compression classifier's contrast and curve, and the table's filling, against plain versions; odd rows of both."""

import hashlib
import math
import random
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from geostrata.llm import quality_classifier as qc
from geostrata.llm import sharding


def samples(n=150):
    rng = random.Random(4)
    good = ["the", "house", "stands", "near", "a", "quiet", "river", "and", "people", "walk"]
    bad = ["buy", "now!!!", "click", "$$$", "free", "win", "xxx", "###"]
    make = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
    return [(k, make(good if k % 2 else bad), k % 2) for k in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = samples()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    return rows, docs, labels, qc.fit(docs, labels)


def plain_contrast(model, text):
    raw, sizes = (text or "").encode(), []
    for d in (model.bad, model.good):
        press = zstandard.ZstdCompressor(level=qc.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(press.compress(raw[at : at + qc.PIECE])) for at in range(0, len(raw), qc.PIECE)))
    return (sizes[0] - sizes[1]) / (len(raw) + 1)


def test_scores_equal_a_plain_version(spark, fitted):
    rows, docs, _, model = fitted
    assert model.slope > 0
    odd = [(None, None), (9001, ""), (9002, None), (9003, "é𝒳" * 3000), (9004, "the river " * 100_000), (9005, "same"), (9005, "same")]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit("clash"))
    expected = Counter((k, round(qc.probability(model.slope * plain_contrast(model, t) + model.base), 9)) for k, t in [(k, t) for k, t, _ in rows] + odd)
    found = qc.score_quality(both, model).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in found) == expected
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_same_model_however_partitioned_and_repeated(fitted):
    _, docs, labels, model = fitted
    again = docs.union(docs.limit(20)).repartition(7)
    assert qc.fit(again, labels.repartition(5)) == model


def test_curve_is_the_likeliest():
    rng = random.Random(1)
    x = [rng.gauss(0.02 * (k % 2), 0.03) for k in range(300)]
    y = [k % 2 for k in range(300)]
    a, b = qc.logistic(x, y)
    likelihood = lambda s, t: sum(math.log(qc.probability((1 if v else -1) * (s * u + t))) for u, v in zip(x, y, strict=True))
    best = likelihood(a, b)
    assert all(best >= likelihood(a * f, b + d) - 1e-6 for f, d in ((1.05, 0), (0.95, 0), (1, 0.1), (1, -0.1)))


def test_labels_that_teach_nothing(spark, fitted):
    _, docs, _, _ = fitted
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 5)], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    assert model.slope == 0 and {r.score for r in qc.score_quality(docs, model).collect()} == {0.5}


def plain_fill(names, size):
    orders = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        at, step = int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1
        orders.append([(at + k * step) % size for k in range(size)])
    table, turn = {}, 0
    while len(table) < size:
        table[next(slot for slot in orders[turn % len(names)] if slot not in table)] = turn % len(names)
        turn += 1
    return [table[k] for k in range(size)]


@pytest.mark.parametrize("shards,size", [(1, 2), (3, 7), (5, 101), (16, 499)])
def test_fill_by_whole_permutations(shards, size):
    names = sharding.shard_names(shards)
    assert sharding.fill_table(names, size) == plain_fill(names, size)


def test_placement_of_odd_rows(spark):
    rows = [(None, None), (None, "a"), (None, "b"), (1, "a"), (1, "a"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slot": F.lit("clash"), "shard": F.lit("clash"), "shard_name": F.lit("clash")})
    names = sharding.shard_names(sharding.SHARDS)
    table = sharding.fill_table(names)
    slot = lambda k, t: int(hashlib.md5((str(k) if k is not None else t or "").encode()).hexdigest()[:8], 16) % sharding.TABLE_SIZE
    found = sharding.place(df, "doc_id", spread_by="text").collect()
    assert Counter(map(tuple, found)) == Counter((k, slot(k, t), table[slot(k, t)], names[table[slot(k, t)]]) for k, t in rows)
    assert sharding.place(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 7)
