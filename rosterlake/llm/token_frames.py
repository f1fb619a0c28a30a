"""Token ids in files of independent zstandard frames.

A file holds one zstandard frame per document, one skippable frame with the
doc_ids, and the seek table of the public seekable format at its end: for each
frame its compressed size, its size, and the low 32 bits of the XXH64 of its
content. A reader seeks to the frames it wants, decompresses only those and
checks each against its checksum. Ids are little-endian unsigned integers of 16
bits where the vocabulary has at most 65,536 ids, else of 32.

Documents stand in ascending order of doc_id over all files: one range
exchange, one file per task, another when it has ``FILE_BYTES``. A task writes
under a name of its own and reports it; the manifest, a table that Spark commits as
a whole, names the files that count, so repeated and lost tasks leave no trace in
what is read. Files are written through pyarrow's file systems to a
folder that all executors share.

* Null and empty texts have only the end id. Repeated rows are all written.
* A null doc_id sorts first and reads back as null.
* An empty table gives a manifest without files and an empty result.
* Texts of any length are encoded whole; extra columns aren't read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 0
FILE_BYTES = 512 << 20
#: Distinct words, and runs between spaces, whose ids a worker remembers.
MEMORY = 800_000
LEVEL = 3

# fixed values of the zstandard frame format and its seekable extension
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
IDS_MAGIC = 0x184D2A50
WITH_CHECKSUMS = 0x80

# The split into words of byte-level BPE, for texts of common Latin characters
# only; other texts go to the tokenizer whole. Fixed by the vocabulary file.
WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼½¾]+"
    "| ?[^\t-\r \xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+"
    "|[\t-\r \xa0]+(?![^\t-\r \xa0])|[\t-\r \xa0]+"
)
ODD_BLANK = re.compile("[\t\x0b-\r \xa0]")
OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9fɐ-\U0010ffff]")


class Encoder:
    """Whole texts to ids, by a tokenizer file of the tokenizers library.

    In a byte-level BPE vocabulary words are encoded independently, so
    the ids of a word are asked of the library once and remembered. Where no two
    blanks meet, a line feed is a word of its own and a space begins one, so the
    runs between them can be remembered as well.
    """

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self._end = array(self._code, [end_id]).tobytes()
        with open(path) as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self._by_word = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and (spec.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
        )
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self._added = re.compile("|".join(added)) if added else None
        self._words: dict[str, bytes] = {}
        # the characters that stand for bytes in such vocabularies: visible ones for themselves
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        self._letters = {b: b for b in visible} | {b: 256 + k for k, b in enumerate(hidden)}
        self._model = self._tokenizer.model
        self._feed = self._ask(["\n"])[0]
        self._forget_runs()

    def _forget_runs(self) -> None:
        # None: a text with this run, or with blanks that meet, isn't put together from runs
        self._runs: dict[str, bytes | None] = {"": None}
        self._spaced: dict[str, bytes | None] = {"": None}

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self._code, e.ids).tobytes() for e in found]

    def _ask_word(self, word: str) -> bytes:
        """The same for one word: the library's model without what goes around it."""
        tokens = self._model.tokenize(word.encode().decode("latin-1").translate(self._letters))
        return array(self._code, [t.id for t in tokens]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text and the end id."""
        if not text:
            return self._end
        if not self._by_word:
            return self._ask([text])[0] + self._end
        lines = [line.split(" ") for line in text.split("\n")]
        try:
            return self._joined(lines)
        except KeyError:
            self._learn(lines)
        except TypeError:
            pass
        try:
            return self._joined(lines)
        except TypeError:
            pass
        if self._beyond(text):
            return self._ask([text])[0] + self._end
        return self._of_words([text])[0] + self._end

    def _joined(self, lines: list[list[str]]) -> bytes:
        runs, spaced = self._runs, self._spaced
        return self._feed.join([runs[line[0]] + b"".join([spaced[r] for r in line[1:]]) for line in lines]) + self._end

    def _beyond(self, text: str) -> bool:
        return bool(OTHER.search(text) or (self._added and self._added.search(text)))

    def _learn(self, lines: list[list[str]]) -> None:
        if len(self._runs) + len(self._spaced) > MEMORY:
            self._forget_runs()
        runs, spaced = self._runs, self._spaced
        for known, before, new in (
            (runs, "", {line[0] for line in lines if line[0] not in runs}),
            (spaced, " ", {run for line in lines for run in line[1:] if run not in spaced}),
        ):
            plain = [run for run in new if not ODD_BLANK.search(run) and not self._beyond(run)]
            known.update(dict.fromkeys(new))
            known.update(zip(plain, self._of_words([before + run for run in plain]), strict=True))

    def _of_words(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that begin and end where words do."""
        words = [WORDS.findall(text) for text in texts]
        known = self._words
        new = list({w for own in words for w in own if w not in known})
        if new:
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list({w for own in words for w in own})
            known.update((w, self._ask_word(w)) for w in new)
        return [b"".join([known[w] for w in own]) for own in words]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """A worker's encoder; its memory serves later tasks too."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class FrameWriter:
    def __init__(self, stream, width: int) -> None:
        self._stream, self._width = stream, width
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self._seeks: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []
        self.bytes = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._zstd.compress(ids)
        self._stream.write(frame)
        self._seeks.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self._ids.append(doc_id)
        self.bytes += len(frame)
        self.tokens += len(ids) // self._width

    def close(self) -> None:
        n = len(self._ids)
        null = np.packbits([i is None for i in self._ids]).tobytes()
        ids = np.array([0 if i is None else i for i in self._ids], "<i8").tobytes()
        body = struct.pack("<BI", self._width, n) + null + ids
        self._stream.write(struct.pack("<II", IDS_MAGIC, len(body)) + body)
        self._seeks.append((8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = np.array(self._seeks, "<u4").tobytes() + struct.pack("<IBI", len(self._seeks), WITH_CHECKSUMS, SEEKABLE_MAGIC)
        self._stream.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)
        self._stream.close()


class FrameReader:
    """Random access to the documents of a file that can seek."""

    def __init__(self, file) -> None:
        self._file = file
        size = file.size()
        file.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not kind & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        self._seeks = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self._offsets = np.concatenate(([0], np.cumsum(self._seeks[:, 0])))
        file.seek(int(self._offsets[n - 1]) + 8)
        self.width, docs = struct.unpack("<BI", file.read(5))
        null = np.unpackbits(np.frombuffer(file.read((docs + 7) // 8), np.uint8), count=docs)
        ids = np.frombuffer(file.read(8 * docs), "<i8")
        self.doc_ids: list[int | None] = [None if x else int(i) for x, i in zip(null, ids, strict=True)]
        #: Ids of the documents before each one in the file.
        self.starts = np.concatenate(([0], np.cumsum(self._seeks[:docs, 1] // self.width)))
        self._zstd = zstandard.ZstdDecompressor()

    def tokens(self, place: int) -> np.ndarray:
        """The ids of the document at a place, decompressing only its frame."""
        packed, size, checksum = self._seeks[place].tolist()
        self._file.seek(int(self._offsets[place]))
        data = self._zstd.decompress(self._file.read(packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {place} doesn't match its checksum")
        return np.frombuffer(data, f"<u{self.width}")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = "part int, file int, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode all texts, write them under ``folder`` and return the manifest."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        system.create_dir(f"{root}/data", recursive=True)
        encode = encoder(tokenizer, end_id)
        part, writer, file, done = TaskContext.get().partitionId(), None, 0, []

        def finish() -> None:
            writer.close()
            ids = [i for i in writer._ids if i is not None]
            row = (part, file, name, min(ids, default=None), max(ids, default=None), len(writer._ids), writer.tokens, writer.bytes)
            done.append(row)

        for batch in batches:
            for key, own in zip(batch["k"], batch["t"], strict=True):
                if writer is None:
                    name = f"part-{part:05d}-{file:05d}-{uuid.uuid4().hex}.tok.zst"
                    writer = FrameWriter(system.open_output_stream(f"{root}/data/{name}", compression=None), encode.width)
                writer.add(None if pd.isna(key) else int(key), encode.encode(own))
                if writer.bytes >= FILE_BYTES:
                    finish()
                    writer, file = None, file + 1
        if writer is not None:
            finish()
        frame = pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
        yield frame.astype({"first_id": "Int64", "last_id": "Int64"})

    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    ordered.mapInPandas(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, with the number of ids in all files before each."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(spark: SparkSession, folder: str, make, schema: str) -> DataFrame:
    """Rows that ``make(doc_id, start, ids)`` gives, of all documents."""
    files = manifest(spark, folder)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for name, before in zip(batch["path"], batch["before"], strict=True):
                with system.open_input_file(f"{root}/data/{name}") as file:
                    frames = FrameReader(file)
                    rows, size = [], 0
                    for place, key in enumerate(frames.doc_ids):
                        ids = frames.tokens(place)
                        rows.append(make(key, int(before + frames.starts[place]), ids))
                        size += len(ids)
                        if size > 1 << 20:
                            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    tasks = max(1, spark.read.parquet(f"{folder}/manifest").count())
    return files.repartitionByRange(tasks, "part", "file").mapInPandas(read, schema)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and tokens of all documents."""
    return _read(spark, folder, lambda k, at, ids: (k, at, ids.astype(np.int32)), "doc_id long, start long, tokens array<int>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as 32-bit integers."""
    return _read(
        spark,
        folder,
        lambda k, at, ids: (k, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())),
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def look_up(spark: SparkSession, folder: str, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and tokens of the wanted documents: only their frames are read.

    The list of files (some hundred bytes for each ``FILE_BYTES``) goes to all tasks.
    """
    files = [tuple(r) for r in manifest(spark, folder).where("first_id is not null").select("path", "first_id", "last_id").collect()]

    @F.pandas_udf("array<string>")
    def places(keys: pd.Series) -> pd.Series:
        return pd.Series([[p for p, low, high in files if low <= k <= high] for k in keys], dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _file_system(folder)
        opened, frames, at = None, None, {}
        for batch in batches:
            rows = []
            for path, key in zip(batch["path"], batch["k"], strict=True):
                if path != opened:
                    frames, opened = FrameReader(system.open_input_file(f"{root}/data/{path}")), path
                    at = {}
                    for place, own in enumerate(frames.doc_ids):
                        at.setdefault(own, []).append(place)
                rows += [(key, frames.tokens(p).astype(np.int32)) for p in at.get(key, [])]
            yield pd.DataFrame(rows, columns=["doc_id", "tokens"])

    keys = wanted.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("k")).distinct()
    by_file = keys.withColumn("path", F.explode(places("k"))).repartition("path").sortWithinPartitions("path", "k")
    return by_file.mapInPandas(read, "doc_id long, tokens array<int>")
