"""Token ids in binary shards with a shared zstandard dictionary.

A shard holds documents in ascending order of doc_id::

    "TOKIDS01" | frame | frame | ... | index | footer

Each frame is one document's ids, little-endian, compressed on its own with the shared
dictionary, so that a short document needs only its own frame. The index has doc_id, a null
mark, the frame's offset and the number of ids for each document. The footer has the
dictionary's SHA-256, the width of an id, the number of documents and of ids, and where the
index begins. The dictionary is trained on serialized ids of a bounded sample and lies
beside the shards.

Texts are cut at white space, and where letters, digits and marks meet, into pieces that the
tokenizer would never join. Each distinct piece is looked up once for about a million
characters, and encoded once per worker while it is kept. That holds for byte-level pairs that are split
by their usual pattern and not normalised; with any other tokenizer every text is encoded
whole, and so are texts with other white space than ASCII's and texts that hold one of the
tokenizer's added tokens.

Defined cases: null text counts as empty and has the end id only; rows with a null doc_id
come first; rows with the same doc_id are in the order of their texts' hashes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.scratch import filesystem, materialize, new_path, write_whole

MAGIC = b"TOKIDS01"
FOOTER = "<32sIQQQ8s"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("n_ids", "<u4")])
#: The dictionary's sample: so many documents at most, and of a longer one so many slices spread over all of its ids.
SAMPLE_DOCS, SAMPLE_SLICES, SLICE_BYTES, DICTIONARY_BYTES = 2000, 8, 512, 112_640
#: Bytes of each of two generations of a worker's cache of pieces, and the longest piece that is kept.
CACHE_BYTES, LONGEST_KEPT = 130 << 20, 200
#: What a piece takes beside its letters and ids: the objects of its text and its ids, and its place in the table.
PIECE_BYTES = 170

#: New words that go to the tokenizer's model together.
WORDS = 32

#: Kinds of bytes: a space, other white space, letters up to U+024F, digits, marks but the apostrophe, all others.
_SPACE, _BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KINDS[list(b"0123456789")] = _DIGIT
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
_KINDS[list(b"\t\n\x0b\x0c\r")] = _BLANK
_KINDS[ord(" ")] = _SPACE
_OTHER_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]")
#: Letters, digits or marks alone: what the usual pattern takes as one, if nothing else stands between.
_RUN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")
_WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ɏ]+")
_tokenizers: dict[str, object] = {}
_pieces: dict[str, Kept] = {}


@dataclass
class Kept:
    """Ids of pieces: a younger and an older generation, and about how many bytes the younger has."""

    young: dict[str, bytes]
    old: dict[str, bytes]
    bytes: int = 0


def _has_other_space(text: str) -> bool:
    """Whether a text has white space beyond ASCII's six, or the four separators that Python takes for it."""
    if text.isascii():
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return _OTHER_SPACE.search(text) is not None


def whole_texts(definition: str) -> re.Pattern:
    """Finds something in each text that a tokenizer, given as its JSON, must get whole."""
    said = json.loads(definition)
    split, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    usual = (
        split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not said.get("normalizer") and not said.get("truncation")
    )
    added = [x["content"] for x in said.get("added_tokens", ())]
    return re.compile("|".join(map(re.escape, added)) or r"(?!)") if usual else re.compile("")


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts' UTF-8, one text after the other; ``ends`` are those of the texts, none of them empty.

    A piece ends before white space, or where letters, digits and marks meet each other: the
    usual pattern never has two of these in one. A space goes with what follows it; of a run
    of white space before something else, only the last is split off.
    """
    kinds = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    first, second = data[lead], data[lead + 1]
    lead = lead[~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F))]
    kinds[lead] = kinds[lead + 1] = _LETTER
    blank = kinds <= _BLANK
    before_text = np.append(~blank[1:], False)
    before_text[ends - 1] = False
    begins = np.zeros(len(data), bool)
    both = ~(blank[1:] | blank[:-1])
    begins[1:] = both & (kinds[1:] != kinds[:-1]) & (kinds[1:] != _OTHER) & (kinds[:-1] != _OTHER)
    begins[1:] |= blank[1:] & (~blank[:-1] | before_text[1:])
    begins[1:] |= ~blank[1:] & (kinds[:-1] == _BLANK)
    begins[0] = True
    begins[ends[:-1]] = True
    return np.flatnonzero(begins)


def apart(definition: str, letters: dict[int, str]) -> np.ndarray | None:
    """Which ids begin with a space, if a tokenizer's model, given as JSON, encodes words that begin with one each on its own.

    That holds where no token has such a space after a letter: then no pair ever joins two
    words. ``letters`` are the model's for each byte.
    """
    model = json.loads(definition).get("model") or {}
    space, vocabulary = letters[ord(" ")], model.get("vocab") or {}
    if model.get("type") != "BPE" or space not in vocabulary or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    signs = "".join(c for c in map(chr, range(ord("A"), 0x250)) if _WORD.fullmatch(" " + c))
    inside = set(signs.encode().decode("latin-1").translate(letters) + space)
    if any(space in t.lstrip(space) and inside.issuperset(t) for t in vocabulary):
        return None
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
    return begins


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, given as its JSON."""

    def __init__(self, definition: str, cached: int = CACHE_BYTES):
        self.cached = cached
        self.key = hashlib.sha256(definition.encode()).hexdigest()
        if self.key not in _tokenizers:
            from tokenizers import Tokenizer, pre_tokenizers

            marks = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            letters = dict(zip(bytes(range(128)).decode(), marks.pre_tokenize_str(bytes(range(128)).decode())[0][0], strict=True))
            for c in map(chr, range(0x80, 0x800)):  # two bytes each; all bytes of UTF-8 up to U+024F are among them
                letters |= zip(c.encode().decode("latin-1"), marks.pre_tokenize_str(c)[0][0], strict=True)
            letters = str.maketrans(letters)
            _tokenizers[self.key] = Tokenizer.from_str(definition), whole_texts(definition), letters, apart(definition, letters)
            _pieces[self.key] = Kept({}, {})
        (self.tokenizer, self.uncut, self.letters, self.begins), self.kept = _tokenizers[self.key], _pieces[self.key]
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def tokenize(self, run: str) -> list[int]:
        """The model's ids for text that needs no more splitting, with bytes as its letters."""
        return [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece.

        What consists of runs that the usual pattern separates goes to the tokenizer's model at
        once, one run after the other.
        """
        runs = _RUN.findall(piece)
        if "".join(runs) == piece:
            return array("I", [i for run in runs for i in self.tokenize(run)]).tobytes()
        return self.whole(piece)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each of several words that begin with a space, which go to the model in one text."""
        ids = np.array(self.tokenize("".join(words)), "<u4")
        raw, at = ids.tobytes(), (4 * np.flatnonzero(self.begins[ids])).tolist()
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, which are kept from now on, but for those of more than ``LONGEST_KEPT`` characters."""
        young, old, words, size = self.kept.young, self.kept.old, [], 0
        found = list(map(young.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i in new:
            piece = pieces[i]
            ids = found[i] = old.get(piece)
            if ids is None:
                if self.begins is not None and len(piece) <= LONGEST_KEPT and _WORD.fullmatch(piece):
                    words.append(i)
                else:
                    found[i] = self.piece(piece)
        for k in range(0, len(words), WORDS):
            some = words[k : k + WORDS]
            for i, ids in zip(some, self.words([pieces[i] for i in some]), strict=True):
                found[i] = ids
        for i in new:
            piece, ids = pieces[i], found[i]
            if len(piece) <= LONGEST_KEPT:
                young[piece] = ids
                size += PIECE_BYTES + 4 * len(piece) + len(ids)
        self.kept.bytes += size
        return found

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Encoded pieces are kept in two generations: when the younger is full, the older goes.
        """
        cut = [None if _has_other_space(t) or self.uncut.search(t) else t.encode() for t in texts]
        encoded = self.cut(list(filter(None, cut)))
        for text, data in zip(texts, cut, strict=True):
            yield self.whole(text) if data is None else next(encoded) if data else b""
        if self.kept.bytes > self.cached:
            self.kept.young, self.kept.old, self.kept.bytes = {}, self.kept.young, 0

    def cut(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts in UTF-8, none of them empty; each distinct piece of all of them is looked up once."""
        if not texts:
            return
        data, ends = b"".join(texts), np.cumsum(list(map(len, texts)))
        at = cuts(np.frombuffer(data, np.uint8), ends)
        offsets = np.append(at, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        found = self.look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths, which = np.fromiter(map(len, found), np.int64, len(found)) // 4, pieces.indices.to_numpy()
        starts, sizes = np.cumsum(lengths) - lengths, lengths[which]
        stops = np.cumsum(sizes)
        shift = np.repeat(starts[which] - stops + sizes, sizes)
        ids = np.frombuffer(b"".join(found), "<u4")[shift + np.arange(len(shift))].tobytes()
        begin = 0
        for stop in stops[np.searchsorted(at, ends) - 1].tolist():
            yield ids[4 * begin : 4 * stop]
            begin = stop

    def rest(self) -> None:
        """Let the older generation go where little is to be kept: workers live on after their task."""
        if self.cached < CACHE_BYTES:
            self.kept.old = {}


def _width(definition: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def texts_of(batch: pa.RecordBatch, limit: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, about ``limit`` characters at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(i.as_py())
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _spread(ids: np.ndarray) -> bytes:
    """All ids of a short document, or slices from its beginning to its end."""
    raw = ids.tobytes()
    last = len(raw) - SLICE_BYTES
    if len(raw) <= SAMPLE_SLICES * SLICE_BYTES:
        return raw
    starts = [k * last // (SAMPLE_SLICES - 1) // ids.itemsize * ids.itemsize for k in range(SAMPLE_SLICES)]
    return b"".join(raw[at : at + SLICE_BYTES] for at in starts)


def train_dictionary(docs: DataFrame, definition: str, end_id: int, width: int, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the ids of the ``SAMPLE_DOCS`` documents with the smallest hashes.

    Where these are too few or too much alike to train one, their ids themselves are the
    dictionary; it is empty for an empty table alone.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    # SAMPLE_DOCS ids at most; of rows that share a doc_id one is taken
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition)
        for batch in batches:
            for _, texts in texts_of(batch):
                got = [_spread(np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(f"<u{width}")) for x in encoder.batch(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["ids"])

    samples = sorted(sample.mapInArrow(encode, "ids binary").toArrow()["ids"].to_pylist())
    total = sum(map(len, samples))
    if len(samples) >= 10:
        try:
            return zstandard.train_dictionary(max(256, min(size, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if len(dictionary) >= 8 else {}


def write_shards(docs: DataFrame, folder: str, definition: str, end_id: int, shards: int | None = None, cached: int = CACHE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards below ``folder``; returns their manifest.

    The manifest has shard (ascending doc_id), path, n_docs, n_ids, and start: the ids in all
    shards before. ``shards`` is their number; by default that of the session's shuffles or of
    the input's partitions, whichever is more. A worker caches about two times ``cached`` bytes
    of pieces, and half of that after its task where ``cached`` is less than ``CACHE_BYTES``.
    """
    spark = docs.sparkSession
    width = _width(definition, end_id)
    sent = spark.sparkContext.broadcast(definition)
    dictionary = train_dictionary(docs, definition, end_id, width)
    write_whole(f"{folder}/dictionary.zstd", lambda out: out.write(dictionary))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # rows of one doc_id, or without any, may fill several shards
    rows = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, compress = Encoder(sent.value, cached), zstandard.ZstdCompressor(level=3, write_content_size=True, **_codec(dictionary))
        end = np.array([end_id], "<u4").tobytes()
        fs, root = filesystem(folder)
        path, out, at, index = "", None, len(MAGIC), []
        for batch in batches:
            for ids, texts in texts_of(batch):
                if out is None:
                    path = f"{uuid.uuid4().hex}.tok"  # a name no other attempt has; the manifest tells which count
                    out = fs.open_output_stream(f"{root}/{path}")
                    out.write(MAGIC)
                for doc_id, encoded in zip(ids, encoder.batch(texts), strict=True):
                    raw = np.frombuffer(encoded + end, "<u4")
                    frame = compress.compress(raw.astype("<u2").tobytes() if width == 2 else raw.tobytes())
                    index.append((doc_id or 0, doc_id is None, at, len(raw)))
                    out.write(frame)
                    at += len(frame)
        encoder.rest()
        if out is None:
            return
        table = np.array(index, INDEX)
        n_ids = int(table["n_ids"].sum(dtype=np.int64))
        out.write(table.tobytes())
        out.write(struct.pack(FOOTER, hashlib.sha256(dictionary).digest(), width, len(table), n_ids, at, MAGIC))
        out.close()
        shard = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{path}"], "n_docs": [len(table)], "n_ids": [n_ids]})

    written = materialize(rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    manifest = written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return materialize(manifest, "manifest")


class Shard:
    """One shard for reading: its index, and each document's ids."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(FOOTER))
        digest, self.width, n_docs, self.n_ids, self.index_at, magic = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        self.file.seek(self.index_at)
        self.index = np.frombuffer(self.file.read(n_docs * INDEX.itemsize), INDEX)
        with fs.open_input_stream(at.rpartition("/")[0] + "/dictionary.zstd") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{path} was written with another dictionary")
        self.decompress = zstandard.ZstdDecompressor(**_codec(dictionary))

    def ids(self, i: int, frame: bytes | None = None) -> np.ndarray:
        """Ids of document ``i`` of the shard as unsigned 32-bit integers."""
        if frame is None:
            at, to = self.span(i)
            self.file.seek(at)
            frame = self.file.read(to - at)
        got = np.frombuffer(self.decompress.decompress(frame), f"<u{self.width}").astype("<u4")
        if len(got) != self.index["n_ids"][i]:
            raise ValueError("a frame differs from its index")
        return got

    def span(self, i: int) -> tuple[int, int]:
        return int(self.index["offset"][i]), int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.index_at

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents with this doc_id, without reading any other frame."""
        live = self.index[self.index["is_null"] == 0]
        skip = len(self.index) - len(live)
        low, high = (np.searchsorted(live["doc_id"], doc_id, side) + skip for side in ("left", "right"))
        return [self.ids(i) for i in range(low, high)]

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        self.file.seek(len(MAGIC))
        for i, row in enumerate(self.index):
            at, to = self.span(i)
            yield (None if row["is_null"] else int(row["doc_id"])), self.ids(i, self.file.read(to - at))


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the shards: doc_id, start (ids before it), n_tokens, ids_crc32, and ids if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for doc_id, ids in Shard(path).all():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids))
                    start, held = start + len(ids), held + len(ids)
                    if held > 2_000_000:
                        yield give(rows)
                        rows, held = [], 0
                if rows:
                    yield give(rows)

    def give(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
        if with_ids:
            lengths = np.cumsum([0, *map(len, columns[4])], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(columns[4]).astype(np.int64))))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    fields = [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)
    files = manifest.select("path", "start")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInArrow(read, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, with_ids: bool = False, cached: int = CACHE_BYTES) -> DataFrame:
    """Write all documents to new shards and read them back."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    return read_shards(write_shards(docs, new_path(docs.sparkSession, "tokens"), definition, end_id, cached=cached), with_ids)
