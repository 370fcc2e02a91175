"""Packing by power-of-two decomposition.

A document's ids are cut into as many pieces of ``max_len`` as fit, then into the powers of two of
the rest, largest first. Each piece is a sequence of its own, so no sequence crosses documents and
none needs padding; batches are made from one bucket of equal lengths. Nothing is shuffled: pieces
leave the task that tokenized the document.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geostrata.llm.common import map_slices, read_table, with_fields

MAX_LEN = 4096
END_ID = 2
#: Words whose ids a worker remembers, from one task of a call to the next (some 200 MB); at more, it forgets all and starts anew.
REMEMBERED = 1_000_000

#: Characters below U+0250 for which lower-casing and the standard library's classes agree with the library; NFC leaves them as they are.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ɏ]*")
#: The letters of lower-cased texts of PLAIN; a class that lists them is matched faster than one by category.
LETTERS = "".join(sorted({c for at in range(0x250) if PLAIN.fullmatch(chr(at)) for c in chr(at).lower() if re.fullmatch(r"[^\W\d_]", c)}))
#: The vocabulary's pre-tokenizer pattern, for lower-case texts of PLAIN only; letters, the commonest, are tried first.
PLAIN_WORD = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")


def cut_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of a document's pieces, in order; all are powers of two if max_len is."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class WordIds:
    """Ids of texts as the library gives them; words seen before are looked up, new ones go to the library together."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a word that the vocabulary ends otherwise
            self.known.update((w, self._whole(w)) for w in words)
            return
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, [0, *cuts], cuts, strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [None if any(s in t for s in self.special) or not PLAIN.fullmatch(t) else PLAIN_WORD.findall(t.lower()) for t in texts]
        if fresh := list(set(chain.from_iterable(w for w in words if w)).difference(self.known)):
            self._learn(fresh)
        return [self._whole(t) if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, words, strict=True)]


@lru_cache(maxsize=1)
def word_ids(path: str, tag: str) -> WordIds:
    """This worker's words of one call of pack(), which tag names; only the latest call's are kept."""
    return WordIds(path)


def _packer(path: str, tag: str, max_len: int, end_id: int, with_ids: bool):
    coder, end = word_ids(path, tag), np.array([end_id], "<u4").tobytes()

    def apply(keys, texts):
        row, start, length, crc, total, ids = [], [], [], [], [], []
        for k, raw in enumerate(coder.encode([t or "" for t in texts])):
            raw += end
            at = 0
            for n in cut_lengths(len(raw) // 4, max_len):
                piece = raw[4 * at : 4 * (at + n)]
                row.append(keys[k])
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(piece))
                total.append(len(raw) // 4)
                if with_ids:
                    ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                at += n
        return [row, start, length, crc, total] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids

    return apply


def pack(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, with_ids also ids.

    A sequence is one piece, at offset 0; bucket is the logarithm of its length. A null text counts
    as empty and gives the closing id alone. Repeated rows are packed each by itself. sequence_id
    differs for all rows of the result. Other columns, clashing names included, are ignored.
    """
    schema = with_fields(df.select(df[key]).schema, "start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    pieces = map_slices(df.select(df[key], df[text].cast("string")), schema, _packer, path or public_tokenizers.path("word_bpe_49k.json"), uuid.uuid4().hex, max_len, end_id, with_ids)
    own = ["ids"] if with_ids else []
    return pieces.select(
        *[c for c in pieces.columns if c != "ids"], F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"), *own,
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
