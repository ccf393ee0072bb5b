"""Byte-level BPE over Arrow batches.

A rank file (base64 token, rank) is turned into a ``tokenizers`` BPE model: bytes map to printable characters, and each
token of two bytes or more gives one merge for every split into two known tokens, in rank order. ``encode`` returns ids
and byte offsets; ``decode`` reverses the byte table, so ids that end inside a character still give the right bytes.

Nulls are empty texts and give no ids. Repeated rows are encoded once per row. Columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Texts encoded in one call, and pieces remembered (a few tens of MB).
GROUP, REMEMBERED = 64, 200_000
#: Finds a character outside the blocks that are full since long.
UNSETTLED = re.compile("[^\x00-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u0481\u048a-\u052f\u2000-\u2064\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]").search
#: Spark's tasks keep the cores busy; threads of the library's own would only contend.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@functools.cache
def byte_chars() -> list[str]:
    """The character for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class ByteBPE:
    """Encoder and decoder for one rank file's content. Pieces met before are looked up, up to ``REMEMBERED`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t, _ in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                merges += [(shown[t[:i]], shown[t[i:]]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.tokenizer.pre_tokenizer = self.byte_level  # given one piece at a time
        self.table = {r: t for t, r in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def split_text(self, text: str) -> list[str]:
        """The pattern's matches. Two libraries agree on the settled characters; others take the slower one, whose
        classes are those of the encoders that such rank files come from."""
        if text.isascii() or not UNSETTLED(text):
            return self.pieces(text)
        return [x for x, _ in self.split.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split_text(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(itertools.chain.from_iterable(split)).difference(known))
        if new:
            known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4") for pieces in split]

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the byte range [start, end) of each in the text's UTF-8 form."""
        ids = self.encode([text])[0].tolist()
        ends = np.cumsum([len(self.table[i]) for i in ids]).tolist()
        return ids, list(zip([0, *ends[:-1]], ends, strict=True)) if ids else []

    def decode_bytes(self, ids) -> bytes:
        """The ids' bytes, whole characters or not."""
        return b"".join(map(self.table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def _loaded(name: str, pattern: str) -> ByteBPE:
    with open(SparkFiles.get(name), "rb") as f:
        return ByteBPE(read_ranks(f.read()), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>, offsets array<struct<start,end>> in bytes, decoded binary) for each row."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(name, pattern)
        offset = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                part = b.slice(lo, GROUP)
                both = [bpe.encode_with_offsets(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in both], pa.list_(offset)), pa.array([bpe.decode_bytes(x[0]) for x in both], pa.binary())],
                    ["id", "ids", "offsets", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<bigint>, offsets array<struct<start: bigint, end: bigint>>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; the same encoder, without building offsets."""
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(name, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                part = b.slice(lo, GROUP)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
