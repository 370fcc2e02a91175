"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton's alphabet is the benchmark's words: every window of 13 words of a test item (question
and answer alike; a shorter item as a whole) is one pattern, and a document is scanned once, as the
sequence of its words. A match's word positions are mapped back to code points of the original text.

The automaton goes to each worker as a broadcast. Its source is gathered only in blocks of items
whose texts keep within ``block_bytes`` together, by the counted bytes of the benchmark. A larger
benchmark is scanned for block after block, one in memory at a time, documents being read once a
block and each one's hits and items united.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import LOWER, UPPER, keep_rows, map_slices, read_table, unused, with_fields, written_and_reread

WINDOW = 13
#: Bytes of item texts that one automaton holds; an automaton takes some 20 times that in a worker.
BLOCK_BYTES = 4 << 20

TO_LOWER = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


#: Of UTF-8: A-Z lower-cased, and a blank for all ASCII that is in no word.
WORD_BYTES = bytes(0x20 if c < 0x80 and not chr(c).isalnum() else c for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """WORD's matches in the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(WORD_BYTES).split()


class Scanner:
    """The automaton over all windows of the items; made once a worker."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for at in range(max(len(ids) - window, 0) + 1):
                if ids:
                    owners[tuple(ids[at : at + window])].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, found in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(found)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, runs [from, to) of hit words, items with occurring windows."""
        words = words_of(text)
        if self.empty:
            return len(words), [], set()
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (length, found) in self.automaton.iter(tuple(map(self.ids.get, words, [0] * len(words)))):
            items.update(found)
            start = end + 1 - length
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, end + 1))
        return len(words), runs, items

    def spans(self, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Code point offsets [from, to) of runs of words."""
        found = [m.span() for m in WORD.finditer(text.translate(TO_LOWER))] if runs else []
        return [(found[a][0], found[b - 1][1]) for a, b in runs]


_MADE: dict[str, Scanner] = {}


def _scanner(broadcast, window: int) -> Scanner:
    """This worker's automaton; only the latest is kept."""
    tag, items = broadcast.value
    if tag not in _MADE:
        _MADE.clear()
        _MADE[tag] = Scanner(items, window)
    return _MADE[tag]


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(broadcast, window: int):
    scanner = _scanner(broadcast, window)

    def apply(keys, texts):
        found = [scanner.scan(t) for t in texts]
        hits = [[{"start": a, "end": b} for a, b in runs] for _, runs, _ in found]
        spans = [[{"start": a, "end": b} for a, b in scanner.spans(t or "", runs)] for t, (_, runs, _) in zip(texts, found, strict=True)]
        n_hit = [sum(b - a for a, b in runs) for _, runs, _ in found]
        bad = [contaminated(h, n) for h, (n, _, _) in zip(n_hit, found, strict=True)]
        return keys, [n for n, _, _ in found], n_hit, [len(i) for _, _, i in found], [_digest(i) for _, _, i in found], bad, [sorted(i) for _, _, i in found], hits, spans

    return apply


def _unite(window: int):
    def apply(keys, n_words, items, hits, spans):
        out = [keys, n_words, [], [], [], [], [], [], []]
        for n, blocks, runs, where in zip(n_words, items, hits, spans, strict=True):
            found = set().union(*blocks)
            runs, where = _united(runs), _united(where)
            n_hit = sum(b - a for a, b in runs)
            for column, x in zip(out[2:], (n_hit, len(found), _digest(found), contaminated(n_hit, n), sorted(found), [{"start": a, "end": b} for a, b in runs], [{"start": a, "end": b} for a, b in where]), strict=True):
                column.append(x)
        return out

    return apply


def _united(blocks: list[list[dict]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for block in blocks for r in block):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


class ItemBlocks:
    """Broadcasts of (tag, [(item, text), ...]), each gathered within block_bytes; one stands at a time."""

    def __init__(self, benchmark: DataFrame, text: str, key: str, block_bytes: int) -> None:
        self.items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
        total = self.items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        # half full on average, so that chance does not overfill one
        self.count = 1 if total <= block_bytes else -(-(total + 1) // max(block_bytes // 2, 1))

    def broadcast(self, block: int):
        items = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == block)
        return self.items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, r.text) for r in items.collect()]))


FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_words array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: key, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_words, spans.

    items lists the ids (as strings, a null id as '') of test items with a window in the text;
    hit_words are runs of hit words and spans the same in code points of the original text, ends
    exclusive. A null or empty text has no words, and is not contaminated; an item without words has
    no window; an empty benchmark hits nothing. Repeated rows and repeated items are each treated as
    they stand. Other columns are ignored.
    """
    base = df.select(df[key], df[text].cast("string"))
    schema = with_fields(df.select(df[key]).schema, FOUND)
    blocks = ItemBlocks(benchmark, item_text, item_key, block_bytes)
    if blocks.count == 1:
        return map_slices(base, schema, _scan, blocks.broadcast(0), window)
    row = unused("row", base.columns)
    numbered = written_and_reread(base.withColumn(row, F.monotonically_increasing_id()))
    parts = None
    for block in range(blocks.count):
        held = blocks.broadcast(block)
        part = map_slices(numbered.select(row, text), with_fields(numbered.select(row).schema, FOUND), _scan, held, window)
        part = written_and_reread(part if parts is None else part.where("n_hit > 0"))  # the first gives each row's words
        held.destroy()
        parts = part if parts is None else parts.union(part)
    met = parts.groupBy(row).agg(F.max("n_words").alias("n_words"), F.collect_list("items").alias("items"), F.collect_list("hit_words").alias("hits"), F.collect_list("spans").alias("spans"))
    back = numbered.select(row, key).join(met, row).select(key, "n_words", "items", "hits", "spans")
    return map_slices(back, schema, _unite, window)


def _clean(broadcast, window: int):
    scanner = _scanner(broadcast, window)

    def apply(texts):
        found = [scanner.scan(t) for t in texts]
        return [not contaminated(sum(b - a for a, b in runs), n) for n, runs, _ in found]

    return apply


def uncontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df's rows, all columns untouched, without those that decontaminate() calls contaminated.

    Null and wordless texts stay, repeated rows are each judged alike; an empty benchmark drops nothing.
    """
    blocks = ItemBlocks(benchmark, item_text, item_key, block_bytes)
    if blocks.count == 1:
        return keep_rows(df, [text], _clean, blocks.broadcast(0), window)
    row = unused("row_number", df.columns)
    numbered = written_and_reread(df.withColumn(row, F.monotonically_increasing_id()))
    verdicts = decontaminate(numbered, benchmark, text, row, item_text, item_key, window, block_bytes)
    return numbered.join(verdicts.where(~F.col("contaminated")).select(row), row, "left_semi").drop(row)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
