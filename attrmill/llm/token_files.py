"""Token ids in binary files: frequency-ranked ids, byte-aligned variable length.

Ids are replaced by their rank by frequency (over all documents, ties by id), so
that frequent ids are small. Four ranks share one control byte (two bits each:
one to four bytes); the control bytes of a document stand apart from its data
bytes. Decoding takes a control byte's four lengths and the masks from numpy tables,
without a loop over the ids.

File (little endian), one for each range of documents in ascending doc_id order:

    magic b"FRVB", version u32, documents u64
    per document  i64 id, u64 first token's number, u64 tokens, u64 place of its block
    blocks        control bytes, then data bytes
    the rank table is one file beside them: u32 ids in rank order

Each attempt of a task writes files of its own, and only those of the attempt that
succeeds are in the list. Reading starts from the files alone.

Rows: null texts are empty and have the end id alone. Rows with one doc_id are
neighbours, in the order of their token bytes. A null doc_id cannot be ordered or
stored and is refused. Other columns are not read.
"""

from __future__ import annotations

import functools
import gc
import io
import re
import string
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrmill.llm.bpe import byte_alphabet
from attrmill.llm.common import BATCH_ROWS, Memo, Workspace, arrow_stage
from attrmill.llm.files import open_read, write_file

MAGIC, VERSION = b"FRVB", 1
#: Text bytes that go into one file, about.
FILE_BYTES = 32_000_000
#: Ids that are packed or unpacked at once; a longer document alone.
RUN_IDS = 1_000_000
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)  # by control byte
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def runs(counts: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring documents (from, to) that hold at most RUN_IDS ids together, or one document."""
    out, start, held = [], 0, 0
    for i, n in enumerate(counts.tolist()):
        if i > start and held + n > RUN_IDS:
            out.append((start, i))
            start, held = i, 0
        held += n
    return out + [(start, len(counts))] if len(counts) else out


def pack_all(ranks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Of each run of ``counts`` numbers, in order: its block, control bytes, then data bytes."""
    n, wide = len(ranks), int(ranks.max(initial=0)).bit_length() + 7 >> 3 or 1  # bytes of the largest
    size = np.ones(n, np.uint8)
    for k in range(1, wide):
        size += ranks >= 1 << 8 * k
    groups = -(-counts // 4)
    ends, control_ends = np.cumsum(counts), np.cumsum(groups)
    code = np.zeros(int(groups.sum()) * 4, np.uint8)  # a run begins with a new control byte
    code[np.arange(n) + np.repeat(4 * (control_ends - groups) - (ends - counts), counts)] = size - 1
    code = code.reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes()
    keep = np.arange(wide, dtype=np.uint8) < size[:, None]
    data = ranks.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)[:, :wide][keep].tobytes()
    data_ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends].tolist() if len(counts) else []
    out, c, d = [], 0, 0
    for c_end, d_end in zip(control_ends.tolist(), data_ends):
        out.append(control[c:c_end] + data[d:d_end])
        c, d = c_end, d_end
    return out


def pack(ranks: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of unsigned 32-bit numbers."""
    return pack_all(np.ascontiguousarray(ranks, "<u4"), np.array([len(ranks)]))[0]


def unpack_all(raw: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the blocks at ``places`` of ``raw`` (bytes, four more at the end), one run after
    another: lengths by table lookup on control bytes, then gathers."""
    groups = -(-counts // 4)
    control_at = np.arange(int(groups.sum())) + np.repeat(places - (np.cumsum(groups) - groups), groups)
    held = np.arange(4, dtype=np.uint8) < np.minimum(np.repeat(counts, groups) - 4 * (control_at - np.repeat(places, groups)), 4)[:, None]
    size = _LENGTHS[raw[control_at]][held]
    at = np.cumsum(size, dtype=np.int64) - size
    first = np.cumsum(counts) - counts
    some = counts > 0
    at += np.repeat((places + groups)[some] - at[first[some]], counts[some])
    word = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        word |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return word & _MASK[size]


def unpack(block: bytes, n: int) -> np.ndarray:
    """The numbers of ``pack``."""
    return unpack_all(np.frombuffer(block + b"\0" * 4, np.uint8), np.zeros(1, np.int64), np.array([n]))


#: The splitter of byte-level BPE. A fixed value.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class may differ between Unicode versions or libraries: such stretches go to the library as they are.
ODD = re.compile("[^\t-\r -~\xa1-\u024f]")
class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, memoised by stretches.

    A space between two characters that are no white space always begins a new word
    of the splitter, so a text may be encoded stretch by stretch there, and a stretch
    of letters is one word, alone or before punctuation. Stretches with white space at
    their ends are joined with their neighbours; texts with a special token go to the
    library as a whole."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.tokenize = self.lib.model.tokenize
        self.by_byte = dict(enumerate(byte_alphabet()))
        self.space = self.by_byte[32]
        self.memo = Memo(self._stretch, 1_500_000)  # stretches, without the space before them
        self.pieces = Memo(self._piece, 200_000)

    def _stretch(self, s: str) -> bytes | None:
        """Ids of a stretch with the space before it; None if it cannot stand alone."""
        plain = s.isascii() and s.isprintable() or not ODD.search(s)
        if plain and s.isalpha():
            return self._bpe(self.space + s) if s.isascii() else self._piece(" " + s)
        if not s or s[0].isspace() or s[-1].isspace():
            return None
        word = s.rstrip(string.punctuation)
        if plain and word.isalpha():
            return self.memo[word] + self.pieces[s[len(word) :]]
        return self._ids(" " + s)

    def _ids(self, stretch: str) -> bytes:
        if ODD.search(stretch):
            return self._library(stretch)
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(stretch)))

    def _piece(self, piece: str) -> bytes:
        """One word of the splitter through the library's BPE model, without the cost of its pipeline."""
        return self._bpe(piece.encode().decode("latin-1").translate(self.by_byte))

    def _bpe(self, symbols: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(symbols)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array(self.code, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``width`` bytes."""
        if any(s in text for s in self.special):
            return self._library(text)
        head, *rest = text.split(" ")
        try:
            found = b"".join(map(self.memo.__getitem__, rest))
        except TypeError:  # a stretch that cannot stand alone
            found = None
        if rest and (not head or head[-1].isspace() or found is None):
            parts = [head]
            for s in rest:
                if parts[-1] and s and not s[0].isspace() and not parts[-1][-1].isspace():
                    parts.append(" " + s)
                else:
                    parts[-1] += " " + s
            return b"".join([self._ids(p) for p in parts])
        return self._ids(head) + found


@functools.lru_cache(maxsize=1)
def _encoder(spec: str) -> ChunkEncoder:
    """One encoder for each Python worker: what it has met serves its later tasks too. Its memos are
    kept out of the collections at the end of every task, which would visit all their entries."""
    encoder = ChunkEncoder(spec)
    gc.freeze()
    return encoder


def _encode(batches, spec, end_id):
    encoder = _encoder(spec.value)
    end = end_id.to_bytes(encoder.width, "little")
    for b in batches:
        out = [encoder.encode(text) + end if text else end for text in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])


def _frequencies(batches, kind):
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
        if len(c) > len(total):
            total = np.pad(total, (0, len(c) - len(total)))
        total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])


def _write(batches, folder, ranks, kind):
    """One file for each partition; where a partition has several ranges, one for each."""
    table = ranks.value
    heads, blocks, place, tokens, name = [], io.BytesIO(), 0, 0, None

    def close():
        first = heads[0][0]
        size = 16 + 32 * len(heads)
        index, start = [], 0
        for doc, n, at in heads:
            index.append(struct.pack("<qQQQ", doc, start, n, size + at))
            start += n
        raw = MAGIC + struct.pack("<IQ", VERSION, len(heads)) + b"".join(index)
        path = write_file(folder, f"{name:08d}", "frvb", [raw, blocks.getvalue()])
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([path], pa.string()), pa.array([first], pa.int64()), pa.array([start], pa.int64())], ["part", "path", "first", "tokens"])

    for b in batches:
        raws = b.column(2).to_pylist()
        counts = np.fromiter(map(len, raws), np.int64, len(raws)) // np.dtype(kind).itemsize
        packed = (x for s, e in runs(counts) for x in pack_all(table[np.frombuffer(b"".join(raws[s:e]), kind)], counts[s:e]))
        for part, doc, n, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), counts.tolist(), packed):
            if name is not None and part != name:
                yield close()
                heads, blocks, place = [], io.BytesIO(), 0
            name = part
            heads.append((doc, n, place))
            blocks.write(block)
            place += len(block)
    if heads:
        yield close()


def _read(batches, ranks_path):
    """(doc_id, start, n_tokens, ids_crc32) from the files themselves."""
    with open_read(ranks_path) as f:
        ids_of = np.frombuffer(f.read(), "<u4")
    for b in batches:
        for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with open_read(path) as f:
                raw = f.read()
            if raw[:4] != MAGIC:
                raise ValueError(f"{path} is no token file")
            n = struct.unpack_from("<Q", raw, 8)[0]
            index = np.frombuffer(raw, "<u8", 4 * n, 16).reshape(-1, 4)
            held = np.frombuffer(raw + b"\0" * 4, np.uint8)
            for i in range(0, n, BATCH_ROWS):
                part = index[i : i + BATCH_ROWS].astype(np.int64)
                crc = []
                for s, e in runs(part[:, 2]):
                    ids = ids_of[unpack_all(held, part[s:e, 3], part[s:e, 2])]
                    ends = np.cumsum(part[s:e, 2])
                    crc += [zlib.crc32(ids[x:y]) for x, y in zip((ends - part[s:e, 2]).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, 0]), pa.array(part[:, 1] + before), pa.array(part[:, 2]), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes ``docs``, writes the files into ``folder`` (a new one in the shared folder
    if none) and returns their list: part, path, first, tokens, before (tokens of all
    files before it)."""
    spark = docs.sparkSession
    work = Workspace(spark)
    folder = folder or work.dir
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    sent = spark.sparkContext.broadcast(spec)
    kind = "<u2" if _vocabulary_size(spec) <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.filter("doc_id is null").limit(1).count():
        raise ValueError("a document without doc_id cannot be stored")
    ids = work.save(arrow_stage(rows, functools.partial(_encode, spec=sent, end_id=end_id), "doc_id long, ids binary"), "ids", compression="zstd")
    counts = arrow_stage(ids.select("ids"), functools.partial(_frequencies, kind=kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]  # at most the vocabulary
    ranks_path = write_file(folder, "ranks", "u32", [np.array(order, "<u4").tobytes()])
    table = np.zeros(max(order, default=0) + 1, np.uint32)
    table[order] = np.arange(len(order), dtype=np.uint32)
    size = ids.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, -(-size // (FILE_BYTES // 4)))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "ids")
    files = work.save(
        arrow_stage(ordered, functools.partial(_write, folder=folder, ranks=spark.sparkContext.broadcast(table), kind=kind), "part long, path string, first long, tokens long"), "files"
    )
    before, rows = 0, []
    for r in files.orderBy("part").collect():  # one row for each file
        rows.append((r.part, r.path, r["first"], r.tokens, before, ranks_path))
        before += r.tokens
    return spark.createDataFrame(rows, "part long, path string, first long, tokens long, before long, ranks string")


def _vocabulary_size(spec: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec).get_vocab_size()


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    first = files.select("ranks").first()
    if first is None:
        return spark.createDataFrame([], schema)
    n = files.count()
    return arrow_stage(files.select("path", "before").repartition(n), functools.partial(_read, ranks_path=first.ranks), schema)
