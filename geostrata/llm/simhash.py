"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at 3 or fewer differing bits. Each is cut into two segments of 32 bits,
so that of a linked pair's segments one differs by one bit at most. Every fingerprint is indexed
under each segment with each one of its bits wild: 64 variants, one of which a linked pair shares.
Variants are met by equality and candidates verified on all bits.

Only distinct fingerprints are indexed, so exact copies cost one row, whatever their number. A key
that more than BLOCK fingerprints share is keyed anew by the other segment, cut and made wild in the
same way (16-bit halves, then 8-bit quarters); what then shares a key differs in 11 bits at most, so
that no group outgrows 2,048 fingerprints. A group gives its links as a spanning forest, never all
pairs. Components come from alternating star contraction over those links, all of it joins and
aggregations with a reliable checkpoint a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from geostrata.llm.common import checkpointed, heavy_join, read_table, slices, unused, written_and_reread

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Fingerprints of one key that a task compares with one another.
BLOCK = 4096
#: Tasks that a node's links are dealt to.
SALTS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of the word shingles' XXH64; 0 for a text without a word."""
    # a bytes object lower-cases A-Z alone and splits at just the contract's white space
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """df and a column of fingerprints as signed longs."""
    schema = StructType([*df.schema, StructField(name, LongType())])
    fields, at = to_arrow_schema(schema), df.columns.index(text)

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                found = np.array([fingerprint(t, shingle) for t in piece.column(at).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found)], schema=fields)

    return df.mapInArrow(run, schema)


def forest(values: np.ndarray, distance: int = DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (member, least member) that connect just what links of the values connect."""
    left, right = [], []
    rest = np.sort(values.view(np.int64)).view(np.uint64)
    while len(rest):
        root, queue, members, rest = rest[0], [rest[0]], [], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= distance
            if near.any():
                found = rest[near]
                queue.extend(found)
                members.append(found)
                rest = rest[~near]
        if members:
            left.append(np.concatenate(members))
            right.append(np.full(len(left[-1]), root))
    return left, right


def _forests(batches):
    for batch in batches:
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        groups = batch.column(0)
        for k in range(len(groups)):
            a, b = forest(groups[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            left += a
            right += b
        edges = np.unique(np.stack([np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["u", "v"])


def _halves(value: Column, bits: int) -> Column:
    """Keys of both halves of ``value``'s low ``bits`` bits with each bit wild.

    A key is the wild bit's number among all bits, the low half's first, and then its half's bits.
    """
    half = bits // 2
    ones = (1 << half) - 1
    low = value.bitwiseAND(F.lit(ones))
    high = F.shiftrightunsigned(value, half).bitwiseAND(F.lit(ones))
    keys = [part.bitwiseAND(F.lit(ones & ~(1 << p))).bitwiseOR(F.lit((first + p) << half).cast("long")) for first, part in ((0, low), (half, high)) for p in range(half)]
    return F.array(*keys)


def _met(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (keys..., fp): links of the groups of two, links of the larger groups, rows of groups beyond block."""
    keys = [c for c in rows.columns if c != "fp"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = checkpointed(sizes)
    two = sizes.where(F.col("n") == 2).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select(F.col("v").alias("u"), F.col("u").alias("v"))
    more = rows.join(sizes.where("n > 2").select(*keys, "n"), keys)
    groups = more.where(F.col("n") <= block).groupBy(*keys).agg(F.collect_list("fp").alias("group")).select("group")
    return two, groups.mapInArrow(_forests, "u long, v long"), more.where(F.col("n") > block).select(*keys, "fp")


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v), v < u as signed longs: a graph over fps' distinct column fp with the components of its links."""
    keyed = fps.select(F.explode(_halves(F.col("fp"), 64)).alias("k1"), "fp")
    two, larger, hot = _met(keyed, block)
    found = two.union(larger)
    # k1 >> 32 is the variant's number: from 32 on the high segment was keyed, and the low one is next
    if hot.limit(1).count():
        high = F.shiftright(F.col("k1"), 32) >= 32
        other = F.when(high, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit((1 << 32) - 1))
        hot = hot.select("k1", "fp", F.explode(_halves(other, 32)).alias("k2"))
        two, larger, hotter = _met(hot, block)
        found = found.union(two).union(larger)
        if hotter.limit(1).count():
            other = F.when(high, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
            other = F.when(F.shiftright(F.col("k2"), 16) >= 16, other).otherwise(F.shiftrightunsigned(other, 16)).bitwiseAND(F.lit((1 << 16) - 1))
            hotter = hotter.select("k1", "k2", "fp", F.explode(_halves(other, 16)).alias("k3"))
            two, larger, _ = _met(hotter, max(block, 2048))
            found = found.union(two).union(larger)
    return found.distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node u that is not the least of its component, and that least node v.

    A hub's links go to SALTS tasks, and each node's least neighbour to as many.
    """
    edges = checkpointed(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        upward = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = upward.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def fingerprinted(df: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(key, tag, fp) of each row of df, computed once; tag is a hash of the text."""
    content = df[text].cast("string")
    own = df.select(df[key].alias("key"), F.xxhash64(F.coalesce(content, F.lit(""))).alias("tag"), content.alias("text"))
    return written_and_reread(with_fingerprint(own, "text", "fp", shingle).select("key", "tag", "fp"))


def components(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp, n, best) for each distinct fp of keyed (key, tag, fp): n of its rows, and best of its component.

    best has key, the smallest reachable, and tag: that of the row that stands for the component, which
    is of the smallest key, and of those of the smallest fp and then tag.
    """
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fp", "tag"))
    fps = checkpointed(keyed.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")))
    roots = stars(links(fps.select("fp"), block))
    rooted = checkpointed(fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("v", "fp").alias("root")))
    best = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("members")))
    return checkpointed(heavy_join(rooted, best, "root", "members").select("fp", "n", "best"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint, component_id) for each row of df, repeated rows included.

    component_id is the smallest key reachable over links, null only if all keys reachable are null.
    Null, empty and wordless texts have fingerprint zero and link like others. Other columns,
    clashing names included, are ignored; an empty df gives no rows.
    """
    keyed = fingerprinted(df, text, key, shingle)
    found = heavy_join(keyed, components(keyed, block), "fp", "n")
    return found.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.key").alias("component_id"))


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """df's rows, all columns untouched, one of each component.

    That is a row of the smallest key; of rows of one key, that of the smallest fingerprint, then of the
    smallest hash of its text; of rows with the same key and text, any one. Null, empty and wordless texts
    are one component; null keys come after all others. An empty df gives no rows.
    """
    best = components(fingerprinted(df, text, key, shingle), block).select("best").distinct()
    tag = unused("tag", df.columns)
    tagged = df.withColumn(tag, F.xxhash64(F.coalesce(df[text].cast("string"), F.lit(""))))
    kept = tagged.join(best, tagged[key].eqNullSafe(best.best["key"]) & (tagged[tag] == best.best["tag"]), "left_semi")
    return kept.dropDuplicates([key, tag]).drop(tag)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
