"""Token ids of all documents in Arrow stream files of fixed-size lists.

Documents are range-partitioned and sorted by id. Each task writes two files: the
ids of its documents as one run, cut into rows of ``SEQUENCE`` ids with a mask
(the last row is padded, its mask is false there), and the place of each document
in that run. All record batches of a file but the last have equal size, so a
memory-mapped file gives any sequence and mask without copying.

Edge cases: a NULL or empty text is the end id alone; rows that repeat an id
stand next to each other, ordered by a hash of their texts; a NULL id comes
first; an empty table gives no rows; a special token's string in a text is that token, as the
library has it by default; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm.common import keep, partitions, small_batches, trimmed, work_path
from starfold.llm.spans import PAD, hash_spans

SEQUENCE, BATCH_SEQUENCES, END_ID = 1024, 256, 0
#: Pieces of text kept with their ids by one worker (further ones are encoded anew each time), and those it gathers before it sorts them in.
CACHE_PIECES, RECENT_PIECES = 2_000_000, 200_000
#: Bytes of new pieces that the library is given in one string.
JOINED_BYTES = 8_192

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 13]] = True
#: Bytes that end no white space, in whatever character: a blank behind them begins a piece.
_SOLID = ~_BLANK
_SOLID[:32] = False
_SOLID[[*range(0x80, 0x90), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cuts_at_blanks(library) -> bool:
    """Whether the tokenizer keeps all bytes and never joins a blank to what stands before it."""
    made = json.loads(library.to_str())
    split = made.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
    added = made.get("added_tokens") or []
    odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    return bool(plain and not odd and made["model"]["type"] == "BPE")


class _Known:
    """Pieces with the places of their ids in the store, sorted by hash."""

    def __init__(self):
        self.key = self.check = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is known, place and number of its ids."""
        if not len(self.key):
            none = np.zeros(len(key), np.int64)
            return none > 0, none, none
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[i] == key) & (self.check[i] == check), self.at[i], self.size[i]

    def add(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        key = np.concatenate([self.key, key])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.check, self.at, self.size = (
            np.concatenate(both)[order] for both in ((self.check, check), (self.at, at), (self.size, size))
        )


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece once per worker.

    Texts are cut before blanks; pieces are known by two hashes of 64 bits each. New pieces that
    begin with a blank and end without go to the library in one string; the lengths of the
    tokens, which keep every byte, tell where each piece ends.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cuts = _cuts_at_blanks(self.library)
        if self.cuts:
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            added = {t.content for t in self.library.get_added_tokens_decoder().values()}
            self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            for token, i in vocabulary.items():  # one letter stands for each byte
                self.width[i] = len(token.encode()) if token in added else len(token)
        self.known, self.recent = _Known(), _Known()
        #: ids of all known pieces; the first is the end id
        self.store, self.filled = np.full(1 << 16, END_ID, dtype=self.dtype), 1

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, strings: list[str]) -> list[np.ndarray]:
        run = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, dtype=self.dtype) for e in run(strings, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id behind each, and the number of ids of each (with the end id)."""
        found = self._by_pieces(texts) if self.cuts else None
        if found is not None:
            return found
        ids = self._library([t.decode() for t in texts])
        end = np.array([END_ID], dtype=self.dtype)
        return np.concatenate([x for i in ids for x in (i, end)]), np.array([len(i) + 1 for i in ids], dtype=np.int64)

    def _by_pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        data = np.frombuffer(b"".join([*texts, bytes(PAD)]), dtype=np.uint8)
        length = np.array([len(t) for t in texts], dtype=np.int64)
        bound = np.cumsum(length)
        solid, blank = _SOLID[data], _BLANK[data]
        solid[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)  # an accented Latin letter
        begins = np.append(False, blank[1:] & solid[:-1])
        begins[(bound - length)[length > 0]] = True
        begins[len(data) - PAD :] = False
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data) - PAD)[: len(start)]
        key, check = (hash_spans(data, start, end, np.uint64(s)) for s in (1, 2))
        one, first, which = np.unique(key, return_index=True, return_inverse=True)
        other = check[first]
        if (other[which] != check).any():
            return None  # two pieces of one hash
        hit, at, size = self.known.find(one, other)
        hit2, at2, size2 = self.recent.find(one, other)
        at, size = np.where(hit2, at2, at), np.where(hit2, size2, size)
        new = np.flatnonzero(~(hit | hit2))
        before = self.filled
        if len(new):
            a, b = start[first[new]], end[first[new]]
            at[new], size[new] = self._encode_new([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], blank[a] & solid[b - 1])
        # the pieces of all texts in order, with the end id behind each text
        n_pieces = np.searchsorted(start, bound) - np.searchsorted(start, bound - length)
        place = np.arange(len(start)) + np.repeat(np.arange(len(texts)), n_pieces)
        from_, count = np.zeros(len(start) + len(texts), np.int64), np.ones(len(start) + len(texts), np.int64)
        from_[place], count[place] = at[which], size[which]
        stop = np.cumsum(count)
        run = self.store[np.repeat(from_ - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.cumsum(n_pieces + 1) - 1
        sizes = np.diff(stop[ends], prepend=0)
        if len(new):
            if len(self.known.key) + len(self.recent.key) + len(new) <= CACHE_PIECES:
                self.recent.add(one[new], other[new], at[new], size[new])
                if len(self.recent.key) > RECENT_PIECES:
                    self.known.add(self.recent.key, self.recent.check, self.recent.at, self.recent.size)
                    self.recent = _Known()
            else:
                self.filled = before
        return run, sizes

    def _encode_new(self, pieces: list[bytes], joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of ``pieces`` into the store; place and number of each."""
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        at, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        joined, single = np.flatnonzero(joins), np.flatnonzero(~joins)
        stop = np.cumsum(length[joined])
        if len(joined):
            cut = np.append(np.flatnonzero(np.diff(stop // JOINED_BYTES)) + 1, len(joined)).tolist()
            strings = [b"".join([pieces[i] for i in joined[a:b].tolist()]).decode() for a, b in zip([0, *cut], cut)]
            ids = np.concatenate(self._library(strings))
            bytes_ = np.cumsum(self.width[ids])
            last = np.minimum(np.searchsorted(bytes_, stop), len(bytes_) - 1)
            if len(bytes_) and bytes_[-1] == stop[-1] and (bytes_[last] == stop).all():
                base = self._put(ids)
                size[joined] = np.diff(last, prepend=-1)
                at[joined] = base + last + 1 - size[joined]
            else:
                single = np.arange(len(pieces))
        ids = self._library([pieces[i].decode() for i in single.tolist()])
        if ids:
            size[single] = [len(i) for i in ids]
            at[single] = self._put(np.concatenate(ids)) + np.cumsum(size[single]) - size[single]
        return at, size

    def _put(self, ids: np.ndarray) -> int:
        base, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(self.filled, len(self.store)), dtype=self.dtype)])
        self.store[base : self.filled] = ids
        return base


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (pafs.LocalFileSystem(), uri)


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


_PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _RunWriter:
    """Collects ids and writes them in full record batches."""

    def __init__(self, sink, dtype: np.dtype):
        self.dtype, self.kind = dtype, pa.from_numpy_dtype(dtype)
        self.out = pa.ipc.new_stream(sink, _schema(self.kind))
        self.held: list[np.ndarray] = []
        self.size, self.full = 0, BATCH_SEQUENCES * SEQUENCE

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.full:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        run = np.concatenate(self.held) if self.held else np.zeros(0, dtype=self.dtype)
        per = BATCH_SEQUENCES * SEQUENCE
        cut = len(run) if last else len(run) // per * per
        for at in range(0, cut, per):
            part = run[at : min(at + per, cut)]
            rows = -(-len(part) // SEQUENCE)
            ids = np.zeros(rows * SEQUENCE, dtype=self.dtype)
            ids[: len(part)] = part
            mask = np.arange(rows * SEQUENCE) < len(part)
            self.out.write_batch(pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(ids), SEQUENCE),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE),
                ],
                schema=_schema(self.kind),
            ))
        rest = run[cut:].copy()
        self.held, self.size = ([rest] if len(rest) else []), len(rest)

    def close(self) -> None:
        self._write(last=True)
        self.out.close()


def write_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text); returns one row per file: part, path, n_docs, n_tokens.

    A file is written under a name of its task attempt and then renamed, so a task
    that runs again replaces it by equal bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    root = work_path(spark, "tokens")
    tie = F.xxhash64("text").alias("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer or default_tokenizer())
        task = TaskContext.get()
        part, try_ = task.partitionId(), task.taskAttemptId()
        files, folder = _open(root)
        writer, places, at, n_docs = None, None, 0, 0
        names = [f"{folder}/{kind}-{part:06d}.arrows" for kind in ("ids", "docs")]
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(folder, recursive=True)
                sinks = [files.open_output_stream(f"{name}.{try_}") for name in names]
                writer, places = _RunWriter(sinks[0], encoder.dtype), pa.ipc.new_stream(sinks[1], _PLACES)
            ids, sizes = encoder.encode([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            writer.add(ids)
            starts = at + np.cumsum(sizes) - sizes
            places.write_batch(pa.record_batch(
                [batch.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=_PLACES
            ))
            at, n_docs = at + int(sizes.sum()), n_docs + batch.num_rows
        if writer is not None:
            writer.close()
            places.close()
            for name, sink in zip(names, sinks):
                sink.close()
                files.move(f"{name}.{try_}", name)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [root], "n_docs": [n_docs], "n_tokens": [at]}
            )

    written = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie)
        .repartitionByRange(partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(trimmed(write), "part int, path string, n_docs long, n_tokens long")
    )
    return keep(written, "token-parts")


class TokenFile:
    """Random access to one part: memory-mapped where the file system is local."""

    def __init__(self, root: str, part: int):
        files, folder = _open(root)

        def stream(kind):
            name = f"{folder}/{kind}-{part:06d}.arrows"
            local = isinstance(files, pafs.LocalFileSystem)
            return pa.ipc.open_stream(pa.memory_map(name) if local else files.open_input_file(name))

        self.rows, self.places = stream("ids").read_all(), stream("docs").read_all()

    def sequence(self, i: int) -> np.ndarray:
        """Row ``i`` as a view of the file."""
        chunk, at = divmod(i, BATCH_SEQUENCES)
        column = self.rows.column("ids").chunk(chunk)
        return column.flatten().to_numpy(zero_copy_only=True)[at * SEQUENCE : (at + 1) * SEQUENCE]

    def mask(self, i: int) -> pa.BooleanArray:
        chunk, at = divmod(i, BATCH_SEQUENCES)
        return self.rows.column("mask").chunk(chunk).flatten().slice(at * SEQUENCE, SEQUENCE)

    def run(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on; a view unless the run crosses record batches."""
        per, out = BATCH_SEQUENCES * SEQUENCE, []
        while n:
            chunk, at = divmod(start, per)
            ids = self.rows.column("ids").chunk(chunk).flatten().to_numpy(zero_copy_only=True)[at : at + n]
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_tokens(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start over all documents, n_tokens, ids_crc32.

    The driver holds one row per file.
    """
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    before = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, row_in_file long"
    if not rows:
        return spark.createDataFrame([], schema).drop("row_in_file")
    files = spark.createDataFrame(
        [(r["part"], r["path"], b) for r, b in zip(rows, before)], "part int, path string, base long"
    ).repartition(len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                file = TokenFile(f["path"], f["part"])
                for places in file.places.to_batches():
                    starts, sizes = (places.column(c).to_numpy() for c in ("start", "n_tokens"))
                    crc = [
                        zlib.crc32(file.run(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes)
                    ]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": places.column("doc_id"),
                        "start": pa.array(starts + f["base"]),
                        "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array(crc, pa.int64()),
                        "row_in_file": pa.array(starts),
                    })

    return files.mapInArrow(trimmed(read), schema).drop("row_in_file")


def encode_corpus(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and describe every document as read back from them."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer))
