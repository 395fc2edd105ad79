"""Token-ID output (operator 9): shard files of separately compressed documents
under one shared zstandard dictionary.

The dictionary is trained on the serialized id arrays of a bounded sample of
documents (``SAMPLE_DOCS`` in expectation, by a hash of the id, the first
``SAMPLE_BYTES`` of each array). Every document is encoded and compressed on its own
in the task that reads it; the frames are then range-partitioned and sorted by
doc_id, and each partition is written as one shard file. A task writes under a
name of its own attempt, and only names in the manifest, which Spark commits as a
table, count: a repeated or lost attempt leaves at most a file nobody reads.

A shard file: ``MAGIC``, the frames one after another, the index (an Arrow stream of
doc_id, offset, length, n_tokens and start, the ids of the shard before the
document), the index's length as 8 bytes, the 32 bytes of the dictionary's
sha256, ``MAGIC``. Ids are little-endian, 2 bytes if the vocabulary fits, else 4.
The dictionary is a file beside the shards, named by its hash, which readers check.

Defined cases: a null or empty text is the end id alone; null doc_ids sort
first; repeated ids are documents each, in the order of their frames; an empty
table gives no shard and no rows; with too few samples for a dictionary an empty one is used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.session import shared_path

from .common import file_system, qualified, saved, ship, table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 1500, 16 << 10, 64 << 10, 3
MAGIC = b"VTGTOK01"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Pieces whose pre-tokens are plain to see: printable ASCII and Latin-1 letters.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: What a tokenizer file must say for plain pieces to be taken apart here: how it normalises, splits and marks
#: the ends of words (fixed values). Any other file is encoded by the tokenizer alone.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "end_of_word_suffix": "</w>",
}
#: That pattern over the lower case of plain pieces, and the space between them.
_PARTS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+")


def _gather(pool: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``which`` of those that lie in ``pool`` with lengths ``n``, put one after
    another, and where each of them ends."""
    each = n[which]
    ends = np.cumsum(each)
    at = np.repeat((np.cumsum(n) - n)[which] - ends + each, each)
    at += np.arange(len(at))
    return pool[at], ends


class Encoder:
    """Whole texts to id arrays. The tokenizer's pre-tokenizer never joins
    characters across ASCII white space, so Arrow numbers the pieces between it, each
    distinct one is encoded once a chunk, and the ids of the texts are gathered
    from those of their pieces. If the file says that it splits as ``_KNOWN`` does, plain pieces are taken apart into pre-tokens; these
    are kept up to a size bound, and new ones are encoded many at a time as one
    text: the end-of-word mark of the vocabulary tells where each ends."""

    LIMIT, JOINED, CHUNK = 350_000, 2000, 8 << 20
    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        said = json.loads(self.tokenizer.to_str())
        said["end_of_word_suffix"] = said["model"].get("end_of_word_suffix")
        self.plain = all(said.get(k) == v for k, v in _KNOWN.items())
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, self.dtype) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), self.JOINED):
            some = parts[i:i + self.JOINED]
            ids = self._ids([" ".join(some)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, width = ids.tobytes(), ids.itemsize
                at = [0, *(ends * width).tolist()]
                self.parts.update((p, raw[a:b]) for p, a, b in zip(some, at, at[1:]))
            else:
                self.parts.update((p, x.tobytes()) for p, x in zip(some, self._ids(some)))

    def _plain_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces one after another, and how many each has."""
        import pyarrow.compute as pc
        row = pa.LargeListArray.from_arrays(pa.array([0, len(pieces)], pa.int64()), pieces)
        coded = pa.array(_PARTS.findall(pc.binary_join(row, " ")[0].as_py().lower()), pa.string()).dictionary_encode()
        parts, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.parts) > self.LIMIT:
            self.parts.clear()
        self.parts[" "] = b""
        self._learn([p for p in parts if p not in self.parts])
        lists = [self.parts[p] for p in parts]
        n = np.fromiter(map(len, lists), np.int64, len(lists)) // np.dtype(self.dtype).itemsize
        ids, ends = _gather(np.frombuffer(b"".join(lists), self.dtype), n, which)
        space = np.flatnonzero(which == parts.index(" ")) if len(pieces) > 1 else []
        return ids, np.diff(ends[space], prepend=0, append=ends[-1])

    def __call__(self, texts: pa.Array | list[str | None], end_id: int = END_ID) -> list[bytes]:
        import pyarrow.compute as pc
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary
        plain = pc.match_substring_regex(pieces, _PLAIN).to_numpy(zero_copy_only=False) & self.plain
        plain &= pc.invert(pc.match_substring(pieces, "<|")).to_numpy(zero_copy_only=False)
        ids, n = self._plain_ids(pieces.filter(pa.array(plain))) if plain.any() else (np.zeros(0, self.dtype), [])
        rest = self._ids(pieces.filter(pa.array(~plain)).to_pylist())
        order = np.empty(len(pieces), np.int64)
        order[np.append(np.flatnonzero(plain), np.flatnonzero(~plain))] = np.arange(len(pieces))
        n = np.append(n, [len(x) for x in rest]).astype(np.int64)
        ids, ends = _gather(np.concatenate([ids, *rest]), n, order[coded.indices.to_numpy()])
        sizes = pc.list_value_length(split).to_numpy()
        cuts = np.append(0, ends)[np.append(0, np.cumsum(sizes))] * ids.itemsize
        raw, end = ids.tobytes(), np.array([end_id], self.dtype).tobytes()
        return [raw[a:b] + end for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Start and length of runs of rows of about ``CHUNK`` bytes, one row at least."""
        import pyarrow.compute as pc
        total = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + self.CHUNK, "right")) - 1)
            yield at, to - at
            at = to


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    import zstandard
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    lot = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        enc = Encoder.of(path)
        for b in batches:
            for i, k in enc.runs(b.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[:SAMPLE_BYTES] for x in enc(b.column(0).slice(i, k))], pa.binary())], names=["ids"])
    # at most SAMPLE_DOCS * SAMPLE_BYTES = 24 MB in expectation
    sample = docs.where(lot < share).select("text").mapInArrow(run, "ids binary").collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(bytes(r.ids) for r in sample)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes):
    import zstandard
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def write_shards(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shard files under ``folder``; returns the
    manifest: part, path, docs, tokens, bytes."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def compress(batches):
        enc, (pack, _) = Encoder.of(tokenizer), _codec(dictionary)
        width = np.dtype(enc.dtype).itemsize
        for b in batches:
            for i, k in enc.runs(b.column(1)):
                ids = enc(b.column(1).slice(i, k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, k), pa.array([len(x) // width for x in ids], pa.int64()),
                     pa.array([pack.compress(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "frame"])
    frames = saved(docs.mapInArrow(compress, f"doc_id {id_type}, n_tokens long, frame binary"), "op9-frames")

    def write(batches):
        from pyspark import TaskContext
        part, out, name = TaskContext.get().partitionId(), None, None
        ids, offsets, lengths, counts = [], [], [], []
        where = len(MAGIC)
        for b in batches:
            if b.num_rows and out is None:
                fs, at = file_system(folder)
                name = f"shard-{part:06d}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{at}/{name}")
                out.write(MAGIC)
            ids.append(b.column(0))
            counts += b.column(1).to_pylist()
            for f in b.column(2):
                f = f.as_buffer()
                offsets.append(where)
                lengths.append(f.size)
                out.write(f)
                where += f.size
        if out is None:
            return
        n = np.array(counts, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(ids), "offset": pa.array(offsets, pa.int64()),
                          "length": pa.array(lengths, pa.int64()), "n_tokens": n, "start": np.cumsum(n) - n})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        tail = sink.getvalue()
        out.write(tail)
        out.write(len(tail).to_bytes(8, "little") + digest + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"],
                                          "docs": [len(n)], "tokens": [int(n.sum())], "bytes": [where]})
    return saved(frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "frame")
                 .mapInArrow(write, "part int, path string, docs long, tokens long, bytes long"), "op9-manifest")


class Shard:
    """A shard file, opened for reading; ``ids(i)`` reads one document alone."""

    def __init__(self, path: str, dtype: str):
        fs, at = file_system(path)
        self.dtype, self.file = dtype, fs.open_input_file(at)
        size = self.file.size()
        foot = self.file.read_at(48, size - 48)
        if foot[40:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no shard file")
        n, digest = int.from_bytes(foot[:8], "little"), foot[8:40]
        with fs.open_input_stream(f"{at.rsplit('/', 1)[0]}/dictionary-{digest.hex()}") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path}: the dictionary is not the one it was written with")
        self.unpack = _codec(dictionary)[1]
        self.index = pa.ipc.open_stream(self.file.read_at(n, size - 48 - n)).read_all()
        self.offset, self.length = (self.index[c].to_numpy() for c in ("offset", "length"))

    def ids(self, i: int) -> np.ndarray:
        frame = self.file.read_at(int(self.length[i]), int(self.offset[i]))
        return np.frombuffer(self.unpack.decompress(frame), self.dtype).astype("<u4")


def read_shards(manifest: DataFrame, tokenizer: str, id_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    before = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")  # a row per shard
    # a task a shard by name: the table of shards is small, and would be taken together by its size
    todo = manifest.select("part", "path", before.alias("base"))
    todo = todo.repartitionByRange(max(1, manifest.count()), "part").select("path", "base")

    def run(batches):
        import zlib
        dtype = Encoder.of(tokenizer).dtype
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(path, dtype)
                for i in range(0, len(shard.length), 4096):
                    some = shard.index.slice(i, 4096).combine_chunks()
                    ids = [shard.ids(j) for j in range(i, i + some.num_rows)]
                    yield pa.RecordBatch.from_arrays([
                        some["doc_id"].chunk(0), pa.array(some["start"].to_numpy() + base, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return todo.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def write_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    tokenizer = tokenizer_path()
    folder = qualified(spark, shared_path(spark, "op9-shards"))
    manifest = write_shards(docs, folder, tokenizer)
    return read_shards(manifest, tokenizer, docs.schema["doc_id"].dataType.simpleString())


def op9_tokens(spark, sf_dir):
    """Start, length and checksum of every document's ids, as read back from the files."""
    return write_and_read(spark, table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline stage (the last): the documents as shard files, and their index."""
    return write_and_read(spark, docs)
