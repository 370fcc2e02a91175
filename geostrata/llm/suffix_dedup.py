"""Removal of repeated passages with enhanced suffix arrays.

Every byte under a string of ``least`` bytes that also starts anywhere else goes. Suffix arrays are
built where repeats can be, in parts of bounded size:

1. Anchors. Of the GRAM-byte strings in a window of ``least`` bytes, the one with the least hash
   (leftmost of ties) is the window's anchor. Equal windows have equal anchors at equal places, so
   each window start belongs to one anchor, and repeats share its key, the hash of its gram.
2. Contexts. An anchor's context is the text under its own windows. Equal contexts are fetched and
   sorted once, with the number of their places. A key with one context only needs no sorting, as the
   windows of one context all differ: its tree is leaves, and that at the context's beginning, if it
   has several places, is the one that cannot be extended to the left.
3. Suffix arrays. The contexts of a key, of many keys at once, get an enhanced suffix array over
   their window starts: order and longest common prefixes by rank doubling. A stack scan yields its
   common-prefix intervals; those of ``least`` or more that can be extended to the left in different
   ways are the maximal repeats, with all their occurrences, and these cover the bytes that go.
4. A key with more than BLOCK different contexts (a passage in very many texts) would not fit an array.
   Of its tree only the nodes at depth ``least`` are made, by the hash of each window, with counts
   combined before the shuffle, so that no task gets the whole key.

repeat_groups() gives the repeats with all their places, remove_repeats() the spans that they cover.
Repeats are maximal within an anchor's context; a longer one is a chain of groups that overlap. Any
place of a group's text has the same windows, so the same anchor, and is in the group.

Nothing is capped or sampled, and matches never cross documents. Anchors are computed once and texts
compressed once; both are written, and the compressed texts shuffled twice, to fetch contexts and to
cut. Hashes have 64 bits, and contexts count as equal only if both their own and their gram's agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import heavy_join, map_slices, read_table, with_fields, written_and_reread

LEAST = 200
GRAM = 40
#: Different contexts of one key that go into one suffix array.
BLOCK = 2048
#: Bytes of a text that are hashed at once; longer texts are cut, with overlaps of least - 1.
SEGMENT = 1 << 20
#: Bytes of contexts in one suffix array, unless one key has more, and arrays of one task.
ARRAY_BYTES = 4 << 20
ARRAYS = 16

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
LOW = U(SEGMENT - 1)
_powers = np.ones(0, np.uint64)


def powers() -> np.ndarray:
    global _powers
    if not len(_powers):
        _powers = np.full(SEGMENT + 1, BASE)
        _powers[0] = 1
        _powers = np.multiply.accumulate(_powers)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U(1)) * powers()[: len(raw)], out=sums[1:])
    return sums


def segment_anchors(raw: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each anchor: key, context hash, first window start, number of windows; of at most SEGMENT bytes."""
    p = powers()
    sums = prefix_hashes(raw)
    grams = mixed((sums[gram:] - sums[:-gram]) * p[::-1][: len(raw) - gram + 1])
    low = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width, have = least - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: have - width], low[width - have :])
    anchor = (low & LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    at = anchor[first]
    whole = (sums[first + count - 1 + least] - sums[first]) * p[SEGMENT - first]
    shape = ((at - first) << 20 | count).astype(np.uint64)
    return grams[at], mixed(whole ^ mixed(shape)), first, count


def text_anchors(raw: bytes, least: int, gram: int) -> tuple[np.ndarray, ...]:
    bytes_, found = np.frombuffer(raw, np.uint8), []
    for at in range(0, max(len(bytes_) - least + 1, 0), SEGMENT - least + 1):
        key, context, first, count = segment_anchors(bytes_[at : at + SEGMENT], least, gram)
        found.append((key, context, first + at, count))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _anchors(least: int, gram: int):
    def apply(keys, tags, texts):
        found = [text_anchors((t or "").encode(), least, gram) for t in texts]
        grams, contexts, first, windows = (np.concatenate([f[k] for f in found]) for k in range(4))
        row = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        return [[keys[k] for k in row.tolist()], pa.array(np.array(tags)[row]), pa.array(grams.view(np.int64)), pa.array(contexts.view(np.int64)), pa.array(first), pa.array(windows)]

    return apply


def _compressed(keys, tags, texts):
    pack = zstandard.ZstdCompressor(level=1)
    return keys, tags, [pack.compress((t or "").encode()) for t in texts]


def compressed(docs: DataFrame) -> DataFrame:
    """(key, tag, packed) of docs (key, tag, text)."""
    return map_slices(docs, with_fields(docs.select("key").schema, "tag long, packed binary"), _of, _compressed)


def _of(f):
    return f


# --- enhanced suffix array


STEP = 7  # symbols of 9 bits in one long


class SuffixArray:
    """Window starts of fragments in order of their text, with longest common prefixes.

    A symbol is a byte plus one; 0 ends a fragment. Ranks of 7, 14, 28, ... symbols are made until they
    see more than the longest fragment; what they see beyond a fragment's end only orders what is equal
    up to there.
    """

    def __init__(self, fragments: list[bytes], least: int) -> None:
        lengths = self.lengths = np.array([len(f) for f in fragments])
        sizes = [STEP]
        while sizes[-1] <= lengths.max(initial=0):
            sizes.append(2 * sizes[-1])
        self.base = np.r_[0, np.cumsum(lengths + 1)[:-1]]
        symbols = np.zeros(int((lengths + 1).sum()) + 2 * sizes[-1], np.int64)
        spread = np.arange(lengths.sum()) + np.repeat(np.arange(len(fragments)), lengths)
        symbols[spread] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.int64) + 1
        self.symbols = symbols
        windows = np.maximum(lengths - least + 1, 0)
        self.owner = np.repeat(np.arange(len(fragments)), windows)
        starts = np.arange(windows.sum()) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
        packed = np.zeros(len(symbols) - STEP + 1, np.int64)
        for k in range(STEP):
            packed = packed << 9 | symbols[k : len(symbols) - STEP + 1 + k]
        ranks = [np.unique(packed, return_inverse=True)[1].astype(np.int32)]
        for size in sizes[:-1]:
            last = ranks[-1]
            pair = last[:-size].astype(np.int64) * (int(last.max()) + 1) + last[size:]
            ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
        places = self.base[self.owner] + starts
        order = np.argsort(ranks[-1][places], kind="stable")
        self.places, self.owner, self.starts = places[order], self.owner[order], starts[order]
        room = lengths[self.owner] - self.starts
        self.prefix = np.zeros(len(order) + 1, np.int64)  # [k]: of entries k - 1 and k
        a, b = self.places[:-1].copy(), self.places[1:].copy()
        common = np.zeros(len(a), np.int64)
        for size, rank in [*zip(reversed(sizes[:-1]), reversed(ranks[:-1]), strict=True), *[(1, symbols)] * (STEP - 1)]:
            same = rank[a] == rank[b]
            common, a, b = common + size * same, a + size * same, b + size * same
        if len(order):
            self.prefix[1:-1] = np.minimum(common, np.minimum(room[:-1], room[1:]))

    def left(self) -> np.ndarray:
        """The symbol before each entry; 0 at a fragment's beginning."""
        return np.where(self.starts > 0, self.symbols[np.maximum(self.places - 1, 0)], 0)


DIVERSE = -1


def maximal_repeats(array: SuffixArray, least: int, times: np.ndarray | None = None) -> np.ndarray:
    """Rows (length, from, to): entries [from, to) share a prefix of just length, least or more, and differ to the left.

    One scan with a stack of open intervals of the common-prefix tree. A fragment's beginning counts
    as different from anything, as the text goes on there beyond what is seen; where a fragment stands
    for several places and begins no other, that entry alone is a repeat as well.
    """
    prefix, left, found = array.prefix, array.left(), []
    deep = prefix >= least
    run_from = np.flatnonzero(deep[1:] & ~deep[:-1])  # entry before the first deep prefix
    run_to = np.flatnonzero(deep[:-1] & ~deep[1:])  # last entry of the run
    pairs = run_to == run_from + 1
    low = run_from[pairs]
    low = low[(left[low] == 0) | (left[low] != left[low + 1])]
    rows = [np.stack([prefix[low + 1], low, low + 2], 1)]
    if times is not None:
        whole = array.lengths[array.owner]
        alone = np.flatnonzero((array.starts == 0) & (times[array.owner] > 1) & (prefix[:-1] < whole) & (prefix[1:] < whole))
        rows.append(np.stack([whole[alone], alone, alone + 1], 1))
    for low, high in zip(run_from[~pairs].tolist(), run_to[~pairs].tolist(), strict=True):
        heights, lefts = prefix[low + 1 : high + 1].tolist(), left[low : high + 1].tolist()
        stack: list[list[int]] = []  # [length, from, left symbol or DIVERSE]
        for k in range(len(lefts)):
            height = heights[k] if k < len(heights) else 0
            mark = lefts[k] or DIVERSE
            begin = k
            while stack and stack[-1][0] > height:
                length, begin, seen = stack.pop()
                mark = seen if seen == mark else DIVERSE
                if mark == DIVERSE:
                    found.append((length, low + begin, low + k + 1))
            if stack and stack[-1][0] == height:
                stack[-1][2] = mark if stack[-1][2] == mark else DIVERSE
            elif height >= least:
                stack.append([height, begin, mark])
    return np.concatenate([*rows, np.array(found, np.int64).reshape(-1, 3)])


def repeat_covers(array: SuffixArray, repeats: np.ndarray) -> list[tuple[int, int] | None]:
    """For each fragment, the bytes [from, to) between its first and last repeat's ends; None without one."""
    deepest = np.zeros(len(array.owner), np.int64)
    for length, begin, end in repeats[np.argsort(repeats[:, 0], kind="stable")].tolist():
        deepest[begin:end] = length
    low, high = np.full(len(array.lengths), 1 << 60), np.full(len(array.lengths), -1)
    met = np.flatnonzero(deepest)
    np.minimum.at(low, array.owner[met], array.starts[met])
    np.maximum.at(high, array.owner[met], array.starts[met] + deepest[met])
    return [(a, b) if b >= 0 else None for a, b in zip(low.tolist(), high.tolist(), strict=True)]


# --- the distributed plan


def _fragments(least: int):
    def apply(keys, tags, wanted, packed):
        unpack = zstandard.ZstdDecompressor()
        out = [[], [], [], [], []]
        for requests, blob in zip(wanted, packed, strict=True):
            raw = unpack.decompress(blob)
            for r in requests:
                for column, x in zip(out, (r["gram"], r["context"], r["times"], r["contexts"], raw[r["first"] : r["first"] + r["windows"] - 1 + least]), strict=True):
                    column.append(x)
        return out

    return apply


def _of_arrays(least: int, give):
    """Groups of contexts (one key's each), as many as fit, through one suffix array; give(held, array, repeats) makes rows."""

    def apply(groups):
        rows: list[tuple] = []
        held: list[dict] = []

        def flush():
            if held:
                array = SuffixArray([x["bytes"] for x in held], least)
                rows.extend(give(held, array, maximal_repeats(array, least, np.array([x["times"] for x in held]))))
            held.clear()

        for group in groups:
            if sum(len(x["bytes"]) for x in held) > ARRAY_BYTES:
                flush()
            held.extend(group)
        flush()
        return [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]

    return apply


def _array_covers(least: int):
    return _of_arrays(least, lambda held, array, repeats: [(x["gram"], x["context"], *cover) for x, cover in zip(held, repeat_covers(array, repeats), strict=True) if cover])


def _array_groups(least: int):
    def give(held, array, repeats):
        for n, (length, begin, end) in enumerate(repeats[np.lexsort(repeats.T[::-1])].tolist()):
            for owner, start in zip(array.owner[begin:end].tolist(), array.starts[begin:end].tolist(), strict=True):
                x = held[owner]
                yield x["gram"], x["context"], start, {"n": n, "length": length}

    return _of_arrays(least, give)


def _window_hashes(least: int):
    def apply(grams, contexts, fragments, times):
        out = [[], [], [], [], []]
        for gram, context, raw, n in zip(grams, contexts, fragments, times, strict=True):
            sums, p = prefix_hashes(np.frombuffer(raw, np.uint8)), powers()
            found = mixed((sums[least:] - sums[:-least]) * p[SEGMENT - np.arange(len(raw) - least + 1)]).view(np.int64)
            out[0] += [gram] * len(found)
            out[1] += [context] * len(found)
            out[2] += range(len(found))
            out[3] += found.tolist()
            out[4] += [n] * len(found)
        return out

    return apply


class Plan:
    """Where the rows (key, tag, text) of docs may have repeats: what is written once and read by both outputs."""

    def __init__(self, docs: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK) -> None:
        self.least, self.block = least, block
        placed = written_and_reread(map_slices(docs, with_fields(docs.select("key").schema, "tag long, gram long, context long, first long, windows long"), _anchors, least, gram))
        self.packed = written_and_reread(compressed(docs))
        contexts = written_and_reread(placed.groupBy("gram", "context").agg(F.count("*").alias("times")))
        several = contexts.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1")
        wanted = contexts.join(several, "gram", "left").select("gram", "context", "times", F.coalesce("contexts", F.lit(1)).alias("contexts")).where("times > 1 OR contexts > 1")
        #: (key, tag, gram, context, first, windows, times, contexts) of each place of a context that is met again or whose key is
        self.shared = written_and_reread(heavy_join(placed, written_and_reread(wanted), ["gram", "context"], "times"))

    def fragments(self) -> DataFrame:
        """(gram, context, times, contexts, bytes): one of each context of the keys that have several."""
        one = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tag", "first", "windows")).alias("one")
        chosen = self.shared.where("contexts > 1").groupBy("gram", "context", "times", "contexts").agg(one)
        requests = chosen.select("one.key", "one.tag", F.struct("gram", "context", "one.first", "one.windows", "times", "contexts").alias("request")).groupBy("key", "tag").agg(F.collect_list("request").alias("wanted"))
        packed = self.packed
        met = requests.join(packed, requests.key.eqNullSafe(packed.key) & (requests.tag == packed.tag)).select(requests.key, requests.tag, "wanted", "packed")
        found = map_slices(met, "gram long, context long, times long, contexts long, bytes binary", _of, _fragments(self.least))
        return written_and_reread(found.dropDuplicates(["gram", "context"]))  # repeated rows of docs each answered

    def arrays(self, fragments: DataFrame, schema: str, make) -> DataFrame:
        """Rows that make yields of the suffix arrays of the keys with block contexts at most."""
        small = fragments.where(F.col("contexts") <= self.block)
        total = small.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
        # a number of tasks of our own: by bytes alone, too few would be made for so much work
        tasks = max(int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (ARRAYS * ARRAY_BYTES))
        grouped = small.repartition(tasks, "gram").groupBy("gram").agg(F.collect_list(F.struct("gram", "context", "times", "bytes")).alias("group"))
        return map_slices(grouped.select("group"), schema, _of, make(self.least))

    def windows(self, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the keys with more than block contexts: (gram, context, at, window) and, of the windows met again, (gram, window, n)."""
        hot = fragments.where(F.col("contexts") > self.block)
        # times is 1 or more a context, so that one context with several places is met again
        windows = map_slices(hot.select("gram", "context", "bytes", "times"), "gram long, context long, at long, window long, times long", _of, _window_hashes(self.least))
        often = windows.groupBy("gram", "window").agg(F.count("*").alias("n"), F.sum("times").alias("met")).where("met > 1").drop("met")
        return windows.drop("times"), written_and_reread(often)

    def covers(self) -> DataFrame:
        """(key, tag, covers): the byte ranges that go, unmerged, of the rows that have any."""
        whole = self.shared.where("times > 1").select("key", "tag", F.struct(F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + self.least).alias("end")).alias("cover"))
        fragments = self.fragments()
        found = self.arrays(fragments, "gram long, context long, low long, high long", _array_covers)
        windows, often = self.windows(fragments)
        if often.limit(1).count():
            found = found.union(heavy_join(windows, often, ["gram", "window"], "n").groupBy("gram", "context").agg(F.min("at").alias("low"), (F.max("at") + self.least).alias("high")))
        # a context met once has one place; one met more often goes as a whole
        part = self.shared.where("contexts > 1 AND times = 1").join(found, ["gram", "context"])
        part = part.select("key", "tag", F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high")).alias("end")).alias("cover"))
        return whole.union(part).groupBy("key", "tag").agg(F.collect_set("cover").alias("covers"))

    def groups(self) -> DataFrame:
        """(group, length, key, start)."""
        alone = self.shared.where("contexts = 1").select(F.concat(F.hex("gram"), F.lit("-0")).alias("group"), (F.col("windows") - 1 + self.least).alias("length"), "key", F.col("first").alias("start"))
        fragments = self.fragments()
        found = self.arrays(fragments, "gram long, context long, at long, of struct<n:long,length:long>", _array_groups)
        named = found.select("gram", "context", "at", F.concat(F.hex("gram"), F.lit("-"), "of.n").alias("group"), "of.length")
        windows, often = self.windows(fragments)
        if often.limit(1).count():
            hot = heavy_join(windows, often, ["gram", "window"], "n")
            named = named.union(hot.select("gram", "context", "at", F.concat(F.hex("gram"), F.lit("-w"), F.hex("window")), F.lit(self.least).cast("long")))
        named = written_and_reread(named)
        # how many places each context's rows meet, so that a context met very often does not gather on one task
        sized = self.shared.where("contexts > 1").groupBy("gram", "context").agg(F.count("*").alias("places"))
        listed = named.groupBy("gram", "context").agg(F.collect_list(F.struct("group", "length", "at")).alias("of")).join(sized, ["gram", "context"])
        met = heavy_join(self.shared.where("contexts > 1").select("key", "first", "gram", "context"), written_and_reread(listed), ["gram", "context"], "places")
        met = met.select("key", "first", F.explode("of").alias("of")).select("of.group", "of.length", "key", (F.col("first") + F.col("of.at")).alias("start"))
        return alone.union(met)


def _docs(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(df[key].alias("key"), F.xxhash64(F.coalesce(df[text].cast("string"), F.lit(""))).alias("tag"), df[text].cast("string").alias("text"))


def merged(covers: list[dict] | None) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted((c["start"], c["end"]) for c in covers or ()):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _cut(with_text: bool):
    def apply(keys, covers, packed):
        unpack = zstandard.ZstdDecompressor()
        out = [[], [], [], [], [], []]
        for key, found, blob in zip(keys, covers, packed, strict=True):
            raw, runs = unpack.decompress(blob), merged(found)
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            row = (key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in runs])
            for column, x in zip(out, row, strict=True):
                column.append(x)
            if with_text:
                out[6:] = [[*out[6], kept] if len(out) > 6 else [kept]]
        return out if not with_text or len(out) > 6 else [*out, []]

    return apply


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, block: int = BLOCK, with_bytes: bool = False) -> DataFrame:
    """One row for each row of df: key, n_bytes, n_removed, n_spans, kept_sha256, removed (runs of bytes), with_bytes also kept.

    A null text counts as empty. Rows that are repeated, texts included, are each other's repeats.
    Texts under ``least`` bytes lose nothing. kept are bytes, as a cut may part a character's bytes.
    Other columns, clashing names included, are ignored; an empty df gives no rows.
    """
    plan = Plan(_docs(df, text, key), least, block=block)
    found, packed = plan.covers(), plan.packed
    both = packed.join(found, packed.key.eqNullSafe(found.key) & (packed.tag == found.tag), "left").select(packed.key, "covers", "packed")
    schema = with_fields(both.select("key").schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>" + ", kept binary" * with_bytes)
    return map_slices(both, schema, _of, _cut(with_bytes)).withColumnRenamed("key", key)


def repeat_groups(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """One row for each place of each maximal repeat: group, length, key, start (both in bytes).

    The places of a group hold the same ``length`` bytes, ``least`` or more, and are all that do; none
    can be extended to both sides within its anchor's context without losing places. Groups of a key
    with more than ``block`` different contexts have ``least`` bytes each. A null text counts as empty;
    rows that are repeated are places each. Other columns, clashing names included, are ignored.
    """
    return Plan(_docs(df, text, key), least, block=block).groups().withColumnRenamed("key", key)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("removed")
