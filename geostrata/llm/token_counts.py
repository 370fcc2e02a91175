"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged array of symbol ids. Each round looks up the
rank of every adjacent pair at once, finds each sequence's lowest rank, and applies that pair at all
its places in the sequence simultaneously (leftmost first where places overlap); sequences without a
pair left are finished, and the symbols that survive are their token counts. Merging all places of
the lowest rank at once equals merging them one by one, as a pair made by a merge always has a
higher rank than the merge.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from geostrata.llm.common import map_slices, read_table, with_fields

#: Pre-tokens whose counts a worker remembers; at more, it forgets all and starts anew.
REMEMBERED = 250_000
#: Bytes merged together in one array.
BLOCK_BYTES = 1 << 18
NONE = np.int64(1 << 40)

#: The byte-level pre-tokenizer's pattern (fixed value), with its properties spelled out.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of these characters only, for which the standard library's classes agree with the properties.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
PLAIN_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class RankMerger:
    """Counts tokens of pre-tokens; made once a worker from the vocabulary's file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.known: dict[str, int] = {}

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the words, none of which is empty."""
        counts = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = 0
        ends = np.cumsum(lengths)
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES)))
            self._merge(self.of_byte[np.frombuffer(b"".join(words[at:to]), np.uint8)], np.repeat(np.arange(at, to), lengths[at:to]), counts)
            at = to
        return counts

    def _merge(self, ids: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
        while len(ids):
            rank = np.full(len(ids), NONE)
            if len(ids) > 1:
                key = ids[:-1] << 32 | ids[1:]
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = (self.keys[spot] == key) & (owner[:-1] == owner[1:])
                rank[:-1][found] = self.ranks[spot[found]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NONE
            counts[owner[starts[over]]] = sizes[over]
            if over.all():
                return
            lowest = np.repeat(lowest, sizes)
            place = np.flatnonzero((rank == lowest) & (rank < NONE))
            fresh = np.r_[True, np.diff(place) != 1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - first) % 2 == 0]  # every other one of those that overlap
            ids[place] = self.made[rank[place]]
            stay = lowest < NONE
            stay[place + 1] = False
            ids, owner = ids[stay], owner[stay]

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings stand in it; those are one token each."""
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        found = [(PLAIN_PRE_TOKEN if PLAIN.fullmatch(x) else PRE_TOKEN).findall(x) for x in parts]
        return (found[0] if len(found) == 1 else list(chain.from_iterable(found))), len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.pre_tokens(t) for t in texts]
        fresh = list(set().union(*(words for words, _ in split)).difference(self.known))
        if fresh:
            self.known.update(zip(fresh, self.merged_lengths([w.encode("utf-8", "surrogatepass") for w in fresh]).tolist(), strict=True))
        return [sum(map(self.known.__getitem__, words)) + special for words, special in split]


def _counter(path: str, limit: int):
    merger = RankMerger(path)

    def apply(ids, texts):
        texts = [t or "" for t in texts]
        counts = merger.count(texts)
        return ids, [len(t.encode()) for t in texts], counts, [n > limit for n in counts]

    return apply


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of df, repeated rows included.

    path names a byte-level BPE file of the tokenizers library that each executor can read. A null
    text counts as empty: 0 bytes, 0 tokens. The vocabulary's special strings inside texts are one
    token each, as is the library's default. Other columns, clashing names included, are ignored.
    """
    schema = with_fields(df.select(df[key]).schema, "n_bytes long, n_tokens long, over_limit boolean")
    return map_slices(df.select(df[key], df[text].cast("string")), schema, _counter, path or public_tokenizers.path("byte_bpe_50k.json"), limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
