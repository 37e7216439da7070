"""Operator 2: token ids in binary files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunks of the ids that have one, and a bitmap
in which a set bit says that the id goes on at the next level; a directory of ranks every 512 bits tells in constant
time where. So token i is read from i, its bits' ranks and a byte a level, and no block is decoded.

A file is a Parquet file of segments, written by Spark's own committed writer (so to any store, and whole after a lost
executor). A segment holds whole documents: part (place of the file in ascending doc_id order), seq, start (tokens of
the part before it), doc_ids, lengths and codes, the bytes of `encode`.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshqa.llm.bpe import byte_letters, packed
from meshqa.llm.common import new_path, table, tokenizer_path

MAGIC = b"DAC1"
CHUNK_BITS = 8
RANK_BITS = 512
END_ID = 2
#: A segment is closed once it has so many tokens.
SEGMENT = 1 << 18
#: What the splitter of the vocabulary's format never joins to what is beside it: Latin letters up to something else than
#: a letter or digit, or else a run without white space, with a blank before them; white space up to the last of it, and
#: that. Python's \s also has four separators (1C to 1F) that are none there.
UNITS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?!\w)| ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
LONGEST, REMEMBERED = 64, 400_000
SCHEMA = "part int, seq int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def encode(ids: np.ndarray) -> bytes:
    """uint32 ids as levels: a header (magic, levels), then for each level its length, chunks, bitmap and rank directory."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >= 1 << CHUNK_BITS
        levels.append(((rest & (2**CHUNK_BITS - 1)).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    out = [MAGIC, struct.pack("<I", len(levels))]
    for chunks, more in levels:
        blocks = -(-len(chunks) // RANK_BITS)
        bits = np.zeros(blocks * RANK_BITS, np.uint8)
        bits[: len(more)] = more
        ones = bits.reshape(blocks, RANK_BITS).sum(1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)]).astype("<u8")
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), np.packbits(bits, bitorder="little").tobytes(), ranks.tobytes()]
    return b"".join(out)


class Codes:
    """Codes as written, for reading single tokens or all."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no directly addressable codes")
        (n,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            blocks = -(-size // RANK_BITS)
            chunks = np.frombuffer(data, np.uint8, size, at + 8)
            bitmap = np.frombuffer(data, np.uint8, blocks * RANK_BITS // 8, at + 8 + size)
            at += 8 + size + len(bitmap)
            self.levels.append((chunks, bitmap, np.frombuffer(data, "<u8", blocks + 1, at)))
            at += 8 * (blocks + 1)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK_BITS * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            first = block * RANK_BITS // 8
            whole = int(np.bitwise_count(bitmap[first : i >> 3]).sum()) if i >> 3 > first else 0
            i = int(ranks[block]) + whole + (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out, at = np.zeros(len(self), np.uint32), np.arange(len(self))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out


class Units(dict):
    """unit -> its ids, by the splitter and the model of the tokenizers library."""

    def __init__(self, library):
        super().__init__()
        if library.normalizer is not None:
            raise ValueError("a normalizer may change units across their ends")
        self.split, self.model = library.pre_tokenizer.pre_tokenize_str, library.model.tokenize
        self.shown = {b: c for c, b in byte_letters().items()}

    def __missing__(self, unit: str) -> bytes:
        if unit[unit[0] == " " :].isalpha():
            # letters alone are one piece; it is only written in the vocabulary's letters for bytes
            tokens = self.model(unit.encode().decode("latin-1").translate(self.shown))
        else:
            tokens = [t for piece, _ in self.split(unit) for t in self.model(piece)]
        ids = packed([t.id for t in tokens])
        if len(unit) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = ids
        return ids


class Ids:
    """Ids of whole texts by the tokenizers library. A text is handed to it in units that its splitter never joins: runs
    without white space, with a blank before them, and the white space between. What it gives for a unit of up to LONGEST
    characters is remembered, REMEMBERED of them at a time. Special strings are cut out first, as the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.ids = {s: packed([i]) for s, i in special.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = Units(library)

    def of(self, text: str) -> bytes:
        if not any(s in text for s in self.ids):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.ids[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, UNITS.findall(text)))


@lru_cache(maxsize=4)
def _ids(path: str) -> Ids:
    return Ids(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text of docs (doc_id, text) and write token files to path, in ascending doc_id order.

    Null text is an empty document (the end id alone); texts of any length are encoded whole, and a segment holds whole
    documents, so a very long one has a segment to itself or ends one. Null ids come last; rows of equal ids stand side
    by side, ordered by a hash of their texts. Columns of other names are not read. An empty table gives files without
    segments.
    """

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, part = _ids(tokenizer), packed([end_id]), TaskContext.get().partitionId()
        ids, doc_ids, lengths, held, seq, start = [], [], [], 0, 0, 0

        def closed() -> pd.DataFrame:
            row = [part, seq, start, held, doc_ids, lengths, encode(np.frombuffer(b"".join(ids), "<u4"))]
            return pd.DataFrame([row], columns=["part", "seq", "start", "n_tokens", "doc_ids", "lengths", "codes"])

        for batch in batches:
            known = batch["known"].to_numpy()
            for doc, here, text in zip(batch["doc_id"].to_numpy(), known, batch["text"]):
                raw = enc.of(text or "") + end
                n = len(raw) // 4
                ids.append(raw)
                doc_ids.append(int(doc) if here else None)
                lengths.append(n)
                held += n
                if held >= SEGMENT:
                    yield closed()
                    ids, doc_ids, lengths, seq, start, held = [], [], [], seq + 1, start + held, 0
        if doc_ids:
            yield closed()

    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    (
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
        .mapInPandas(segments, SCHEMA)
        .write.parquet(path)
    )


def starts(files: DataFrame) -> dict[int, int]:
    """The tokens before each file, by its part. A sum for each file comes to the driver."""
    before, out = 0, {}
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect())):
        out[part], before = before, before + n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row a document from token files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before = starts(files)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                raw = Codes(r.codes).all().astype("<u4").tobytes()
                lengths = np.asarray(r.lengths, np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                known = pd.array([None if d is None or d != d else int(d) for d in r.doc_ids], "Int64")
                yield pd.DataFrame({"doc_id": known, "start": before[r.part] + r.start + ends - lengths, "n_tokens": lengths, "ids_crc32": sums})

    return files.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(spark: SparkSession, path: str, i: int) -> int:
    """Token i of all: its file is found by the starts, the segment by its own start, and one code is read in place."""
    files = spark.read.schema(SCHEMA).parquet(path)
    part, before = max(((p, n) for p, n in starts(files).items() if n <= i), key=lambda x: (x[1], x[0]), default=(-1, 0))
    here = files.where((F.col("part") == part) & (F.col("start") <= i - before) & (F.col("start") + F.col("n_tokens") > i - before)).select("start", "codes").first()
    if here is None:
        raise IndexError(i)
    return Codes(bytes(here.codes))[i - before - here.start]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read(spark, path)
