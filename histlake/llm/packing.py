"""Packing by power-of-two decomposition.

A document of n tokens is cut into the powers of two that sum to n, longest
first, none over 2048; each piece is a sequence of its own, in the bucket of
its length, so no sequence crosses documents and none needs padding. The bucket
leads the sequence's id: in the order of ids, sequences of equal length stand
together, as batches want them. ``write_buckets`` stores each bucket's sequences
in a folder of its own.

Tokens: the ids of a public BPE vocabulary (its path is a parameter) and an end
id. The vocabulary splits a text into words by a fixed rule and encodes each
word by itself, so ids are kept by word within a task (a bounded table). Texts
with characters beyond U+017F go through the tokenizer whole: its normalisation
then needs more than lower case.

Cases: a null or empty text is the end id alone; repeated rows and null ids are
documents of their own; an empty table gives no rows; any length of text is cut
the same way; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

END_ID = 1
MAX_LENGTH = 2048
#: Words a task keeps the ids of, besides those of the batch at hand; beyond it the table starts anew.
WORDS_KEPT = 500_000
#: Characters of texts taken at once.
CHARS_AT_ONCE = 2_000_000
PLAIN_LAST = "\u017f"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(kinds: str) -> str:
    """The characters up to PLAIN_LAST of these Unicode categories, as a regex class body."""
    return "".join(re.escape(chr(c)) for c in range(ord(PLAIN_LAST) + 1) if unicodedata.category(chr(c))[0] in kinds)


@lru_cache(maxsize=1)
def _vocabulary(path: str):
    """The vocabulary for words that are normalised and split already, and which of its tokens end a word."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    bare = Tokenizer.from_file(path)
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(bare.get_vocab_size(), dtype=bool)
    for token, k in bare.get_vocab().items():
        last[k] = token.endswith("</w>")
    return bare, last


class WordTokenizer:
    """Ids of whole texts, as the tokenizer of the file gives them without special tokens added."""

    def __init__(self, path: str):
        self.path = path
        self.bare, self.last = _vocabulary(path)
        letters, numbers = _class("L"), _class("N")
        space = "\\t-\\r \\x85\\xa0"
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.beyond = re.compile(f"[^\\x00-{PLAIN_LAST}]|İ").search
        self.known: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The tokenizer as it is, for texts that are not plain."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def odd(self, text: str) -> bool:
        """Whether the text must go through the tokenizer whole."""
        if "<|" in text and ("<|startoftext|>" in text or "<|endoftext|>" in text):
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.beyond(text) is not None
        return False

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: they are encoded as one spaced text, which each word's last token divides."""
        ids = np.frombuffer(self._encode(self.bare, [" ".join(words)])[0], dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self._encode(self.whole, words)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if self.odd(t) else self.split(t.lower()) for t in texts]
        known = self.known
        new = list({w for words in split if words for w in words if w not in known})
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = list({w for words in split if words for w in words})
        if new:
            known.update(zip(new, self._words(new), strict=True))
        return [self._encode(self.whole, [t])[0] if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, split, strict=True)]


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Powers of two, at most ``most``, longest first, that sum to n."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """A row per piece, with its ids (little-endian unsigned 32 bits) if asked for."""
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        tokenizer = WordTokenizer(path)
        end = np.uint32(END_ID).tobytes()

        def encoded(texts: list[str | None]) -> Iterator[bytes]:
            part, chars = [], 0
            for k, text in enumerate(texts, 1):
                part.append(text or "")
                chars += len(part[-1])
                if chars > CHARS_AT_ONCE or k == len(texts):
                    yield from (ids + end for ids in tokenizer.ids(part))
                    part, chars = [], 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: dict[str, list] = {n: [] for n in names}
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist()), strict=True):
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n):
                    piece = ids[4 * start : 4 * (start + length)]
                    cols["doc_id"].append(doc_id)
                    cols["start"].append(start)
                    cols["length"].append(length)
                    cols["ids_crc32"].append(zlib.crc32(piece))
                    cols["doc_tokens"].append(n)
                    cols["bucket"].append(length.bit_length() - 1)
                    if with_ids:
                        cols["ids"].append(piece)
                    start += length
            kinds = {"bucket": pa.int32(), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()], names=names)

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


#: Bits of a sequence's id below its bucket: the task's number and the place within the task.
ID_BITS = 58


def pack(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there.

    A piece is a whole sequence. Its id is its bucket, the task's number and the
    place within the task, the same again if a lost task is run anew over the table.
    """
    number = F.shiftleft(F.col("bucket").cast("long"), ID_BITS) + F.monotonically_increasing_id()
    return pieces(docs, path, with_ids).withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(docs: DataFrame, path: str, folder: str) -> None:
    """The sequences with their ids, as Parquet below ``folder/bucket=k`` for length 2**k: a reader of one bucket batches them without padding.

    Nothing is shuffled: a task writes one file for each bucket it has pieces of.
    """
    pack(docs, path, with_ids=True).write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
