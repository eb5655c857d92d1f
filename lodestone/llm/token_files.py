"""Token ids in Arrow IPC files of fixed-size lists.

A shard is a pair of files in the shared folder. `*.arrow` holds the ids of all its
documents, one after another, cut into sequences of SEQUENCE ids: a column `ids`
of fixed-size lists and a column `mask` of fixed-size lists of booleans, false
only for the padding after the shard's last id. All record batches but the last
hold BATCH sequences, so sequence i lies in batch i // BATCH at i % BATCH and is
reached without reading or copying anything else. `*.index.arrow` holds doc_id,
start (in the shard) and n_tokens of its documents. Ids are stored as unsigned
16-bit integers if the vocabulary allows, else as 32-bit integers.

Documents are ordered by doc_id over all shards (null first; repeated ids by a
hash of their text; equal rows are interchangeable). A null or empty text gives
the end id alone. A very long text is encoded whole, in one go, so that a worker
needs some ten times its size. An empty table gives an empty manifest and no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import releasing, scratch_path, small_batches, staged

END_ID = 1
SEQUENCE = 2048
BATCH = 128
#: Texts are encoded so many bytes at a time.
SLICE_BYTES = 8_000_000
#: A worker remembers the ids of pieces up to about this many bytes.
CACHE_BYTES = 24_000_000

MANIFEST = "part long, path string, index_path string, docs long, tokens long, sequences long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"

# A word of letters with plain punctuation about it. Letters are ASCII or precomposed Latin-1, which
# normalisation leaves alone and lower-casing maps one to one; "<" could begin a special token and an
# apostrophe a contraction, so words with them go the long way.
_MARKS = r"""[!-&(-/:;=-@\[-`{-~]*"""
_PLAIN = rf"^(?P<before>{_MARKS})(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>{_MARKS})$"
_BYTE_CHARS = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_BYTE_CHARS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTE_CHARS)}


#: Fixed value: the split of the tokenizers that work word by word. No alternative takes white space in.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def splits_on_white_space(tokenizer) -> bool:  # noqa: ANN001
    """Whether a tokenizer maps a text to the ids of its white-space separated words in a row.

    True for a BPE over pieces that a Split keeps, when no piece spans white space
    and each normalizer works on its own characters and their marks. Asks the parts
    for their settings, so that the vocabulary is not read a second time.
    """
    parts = [json.loads(x.__getstate__()) if x is not None else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    kinds = [n.get("type") for n in parts[0].get("normalizers", [])]
    steps = parts[1].get("pretokenizers", [])
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and len(steps) == 2
        and steps[0].get("type") == "Split"
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert") is True
        and steps[0].get("pattern", {}).get("Regex") == _SPLIT
        and steps[1].get("type") == "ByteLevel"
        and steps[1].get("add_prefix_space") is False
        and steps[1].get("use_regex") is False
        and type(tokenizer.model).__name__ == "BPE"
        and not tokenizer.model.dropout
    )


class Remembered:
    """Ids of pieces in arrays: the pieces, the ids of all in a row, the number of each. Beyond CACHE_BYTES only what the
    last slice used is kept."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, dtype), np.zeros(0, np.int32)

    @property
    def weight(self) -> int:
        return self.keys.nbytes + self.ids.nbytes + self.sizes.nbytes

    def find(self, keys: pa.Array, make: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each entry, the entry of each key) of distinct keys; those not known are made."""
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(pc.is_null(at))
        lists = make(new.to_pylist())
        known = len(self.keys)
        entry = pc.fill_null(at, -1).to_numpy().copy()
        entry[entry < 0] = known + np.arange(len(new))
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), self.ids.dtype)])
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, lists), np.int32, len(lists))])
        self.keys, self.ids, self.sizes = pa.concat_arrays([self.keys, new]), ids, sizes
        if self.weight > CACHE_BYTES:
            used = np.unique(entry)
            self.keys = self.keys.take(pa.array(used))
            self.ids, self.sizes = ids[_runs((np.cumsum(sizes) - sizes)[used], sizes[used])], sizes[used]
        return ids, sizes, entry


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first[i], first[i] + 1, ... of size[i] each, in a row. Those of one slice fit into 32 bits."""
    ends = np.cumsum(size)
    out = np.repeat((first - (ends - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library.

    Where the tokenizer works word by word, the distinct words of a slice are cut
    into their letters and the marks about them, each distinct piece goes to the
    library's BPE once, and the ids are put together by index. Other words go
    through the library's whole pipeline. Results equal those of the whole
    pipeline on whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = splits_on_white_space(self.tokenizer)
        self.dtype = np.dtype(np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 2**16 else np.uint32)
        self.pieces, self.others = Remembered(self.dtype), Remembered(self.dtype)

    def _pieces(self, found: list[str]) -> list[list[int]]:
        """Ids of lower-case letters or of marks, by the BPE alone."""
        byte_char, bpe = _BYTE_CHARS.__getitem__, self.model.tokenize
        mapped = (s if s.isascii() else "".join(map(byte_char, s.encode())) for s in found)
        return [[t.id for t in bpe(s)] if s else [] for s in mapped]

    def _words(self, found: list[str]) -> list[list[int]]:
        """Ids of any words, by the whole pipeline."""
        return [self.tokenizer.encode(w, add_special_tokens=False).ids for w in found]

    def _table(self, values: pa.Array, held: Remembered, make: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the entries in a row, the number of ids of each entry, the entry of each value)."""
        coded = values.dictionary_encode()
        ids, sizes, entry = held.find(coded.dictionary, make)
        return ids, sizes, entry[coded.indices.to_numpy()]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in a row, the number of ids of each)."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(parts)
        kept = parts.filter(plain)
        before, letters, after = (kept.field(k) for k in ("before", "letters", "after"))
        data, size, at = self._table(pa.concat_arrays([before, pc.utf8_lower(letters), after]), self.pieces, self._pieces)
        odd_data, odd_size, odd_at = self._table(words.filter(pc.invert(plain)), self.others, self._words)
        # A word is three entries of one table: its pieces, or itself and twice the empty entry at the end.
        n, plain = len(kept), plain.to_numpy(zero_copy_only=False)
        size = np.concatenate([size, odd_size, [0]])
        entry = np.full((len(words), 3), len(size) - 1)
        entry[plain] = at.reshape(3, n).T
        entry[~plain, 0] = odd_at + (len(size) - 1 - len(odd_size))
        first = np.cumsum(size) - size
        flat = entry.ravel()
        return np.concatenate([data, odd_data])[_runs(first[flat], size[flat])], size[entry].sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), self.dtype, int(sizes.sum())), sizes
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        flat, size = self._distinct(coded.dictionary)
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        return flat[_runs(first[at], n)], upto[bounds[1:] - bounds[0]] - upto[bounds[:-1] - bounds[0]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its caches outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of about SLICE_BYTES, over the bounds of batches; a longer text is a slice of its own."""
    ids, texts, held = [], [], 0
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(size):
            if held and held + n > SLICE_BYTES:
                ids.append(b.column(0).slice(at, i - at))
                texts.append(b.column(1).slice(at, i - at))
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, held, at = [], [], 0, i
            held += n
        ids.append(b.column(0).slice(at))
        texts.append(b.column(1).slice(at))
    if sum(map(len, ids)):
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def shard_schema(dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes one shard, a batch of sequences at a time."""

    def __init__(self, store, path: str, dtype: np.dtype):  # noqa: ANN001
        self.schema, self.dtype = shard_schema(dtype), dtype
        self.files = [store.open_output_stream(path), store.open_output_stream(path.removesuffix(".arrow") + ".index.arrow")]
        self.out = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], INDEX)
        self.held: list[np.ndarray] = []
        self.held_ids = self.tokens = self.docs = self.sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
        self.held.append(ids)
        self.held_ids += len(ids)
        self.tokens += len(ids)
        self.docs += len(sizes)
        if self.held_ids >= BATCH * SEQUENCE:
            data = np.concatenate(self.held)
            whole = len(data) // (BATCH * SEQUENCE) * BATCH * SEQUENCE
            for i in range(0, whole, BATCH * SEQUENCE):
                self._batch(data[i : i + BATCH * SEQUENCE], BATCH * SEQUENCE)
            self.held = [data[whole:].copy()]
            self.held_ids = len(self.held[0])

    def _batch(self, data: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(data), SEQUENCE)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(data)) < real), SEQUENCE)
        self.out.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))
        self.sequences += len(data) // SEQUENCE

    def close(self) -> None:
        if self.held_ids:
            data = np.concatenate(self.held)
            padded = np.zeros(-(-len(data) // SEQUENCE) * SEQUENCE, self.dtype)
            padded[: len(data)] = data
            self._batch(padded, len(data))
        self.out.close()
        self.index.close()
        for f in self.files:
            f.close()


def write_tokens(docs: DataFrame, tokenizer_path: str | Callable[[], str], end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) to shards in ascending doc_id order; the manifest has a row for each.

    tokenizer_path: a path that every executor has, or a function that finds it there.
    folder: where the files go, shared by driver and executors; by default beside the
    staged tables.
    """
    spark = docs.sparkSession
    folder = folder.rstrip("/") if folder else scratch_path(spark, "tokens")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        enc = encoder(tokenizer_path() if callable(tokenizer_path) else tokenizer_path)
        shard = None
        name = f"{uuid.uuid4().hex}.arrow"
        for doc_ids, texts in text_slices(batches):
            if shard is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                shard = ShardWriter(store, f"{root}/{name}", enc.dtype)
            ids, sizes = enc.encode(texts)
            ends = np.cumsum(sizes)
            shard.add(doc_ids, np.insert(ids, ends, end_id), sizes + 1)
        if shard is not None:
            shard.close()
            path = f"{folder}/{name}"
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "path": [path], "index_path": [path.removesuffix(".arrow") + ".index.arrow"], "docs": [shard.docs], "tokens": [shard.tokens], "sequences": [shard.sequences]}
            )

    # Equal rows are told apart by their place, so that a row repeated without end does not fill one range.
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # A row for each shard: one file holds them.
    return staged(ordered.mapInArrow(releasing(write), MANIFEST).repartition(1), "token-manifest")[0]


def sequence_at(shard: pa.ipc.RecordBatchFileReader, i: int) -> tuple[pa.Array, pa.Array]:
    """Sequence i of an open shard and its mask: views into the file's memory if the shard is memory-mapped."""
    b = shard.get_batch(i // BATCH)
    return b.column("ids")[i % BATCH].values, b.column("mask")[i % BATCH].values


def document_ids(shard: pa.ipc.RecordBatchFileReader, spans: Iterator[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The ids of documents (start, n_tokens), in ascending order of start. Holds the batches that a document spans."""
    held = np.zeros(0, np.uint16)
    low = k = 0
    for start, n in spans:
        while low + len(held) < start + n:
            b = shard.get_batch(k)
            real = pc.sum(b.column("mask").flatten()).as_py()
            ids = b.column("ids").flatten().to_numpy()[:real]
            keep = max(0, min(len(held), start - low))
            held, low, k = np.concatenate([held[keep:], ids]) if len(held) > keep else ids, low + keep, k + 1
        yield held[start - low : start - low + n]


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files.

    start counts the ids of all documents before it, over all shards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, index_path, base in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, root = fs.FileSystem.from_uri(path)
                _, index_root = fs.FileSystem.from_uri(index_path)
                with store.open_input_file(root) as f, store.open_input_file(index_root) as g:
                    shard, index = pa.ipc.open_file(f), pa.ipc.open_file(g)

                    def crcs(shard=shard, index=index) -> Iterator[int]:  # noqa: ANN001
                        spans = (s for i in range(index.num_record_batches) for s in zip(*(index.get_batch(i).column(c).to_pylist() for c in (1, 2)), strict=True))
                        for ids in document_ids(shard, spans):
                            yield zlib.crc32(ids.astype("<u4").tobytes())

                    found = crcs()
                    for i in range(index.num_record_batches):
                        x = index.get_batch(i)
                        crc = [next(found) for _ in range(x.num_rows)]
                        yield pa.RecordBatch.from_arrays([x.column(0), pc.add(x.column(1), base), x.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.select("path", "index_path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(n).mapInArrow(releasing(read), READ)
