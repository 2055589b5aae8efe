"""Token ids as seekable compressed files.

One file holds the documents of one range of ids, in order:

    zstandard frame ...        whole documents, about `frame_tokens` ids each; a longer
                               document is a frame by itself. Every frame carries the
                               content checksum of the zstandard format.
    skippable frame 0x184D2A50 document index: per document its id (int64), frame
                               (uint32), first id inside the frame (uint64), number of
                               ids (uint64), flags (uint8: 1 = the id is null), in columns
    skippable frame 0x184D2A5E seek table of the seekable zstandard format: per frame the
                               compressed and decompressed size and the low 32 bits of the
                               XXH64 of its content, then the footer

so a reader fetches the tail of a file, then only the frames that hold the documents it
wants, and verifies each of them. Ids are little-endian, 2 bytes wide if the vocabulary
allows it and 4 otherwise.

Every task writes a file under a name of its own attempt and returns one manifest row;
the written manifest is the commit. A lost or doubled attempt leaves a file nobody lists.

Defined cases. A null text is an empty one and has the end id alone. A null document id
sorts first. Repeated ids are separate documents, ordered by text. An empty table gives
no file and an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from almagest.llm.common import bytes_of, settled, sliced, text_or_empty
from almagest.session import shared_dir

# fixed values of the seekable zstandard format
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
# first of the skippable magic numbers, for the document index
INDEX_MAGIC = 0x184D2A50

FRAME_TOKENS = 1 << 17
END_ID = 2
#: Pieces remembered by a Python worker, and the longest of them in bytes.
CACHED_PIECES = 500_000
CACHED_BYTES = 40
#: Bytes of text that are cut and encoded at a time; a longer text is taken whole.
ENCODED_BYTES = 4 * 1024**2
#: Characters that the library gets at a time; it takes much memory for each token.
PASSED_CHARS = 256 * 1024

# classes of bytes; what is in none of them may be anything
_ANY, _LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _BREAK = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _ANY, dtype=np.uint8)
    for chars, kind in (
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _LETTER),
        (b"0123456789", _DIGIT),
        (b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', _SIGN),
        (b"'", _QUOTE),
        (b" ", _SPACE),
        (b"\t\n\r", _BREAK),
    ):
        out[list(chars)] = kind
    return out


_CLASS = _classes()
#: First bytes of two-byte letters: Latin, Cyrillic; of those with 0xC3 two are signs.
_LETTER_LEADS = np.isin(np.arange(256), [0xC3, 0xC4, 0xC5, 0xD0, 0xD1])


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts that lie end to end are cut into pieces, as ascending offsets with both ends.

    The byte-level pre-tokenizer takes a run of letters, of digits or of other signs, each
    with one space before it, or a run of white space without the space that belongs to
    what follows; an apostrophe may begin a contraction. Cut is only where one of its
    matches begins whatever else the text holds. Characters not known here are never cut
    off, and neither is an apostrophe: their pieces hold several matches.
    """
    kind = _CLASS[data]
    after = data[1:]
    pair = _LETTER_LEADS[data[:-1]] & ~((data[:-1] == 0xC3) & ((after == 0x97) | (after == 0xB7)))
    kind[:-1][pair] = _LETTER
    kind[1:][pair] = _LETTER
    seen = (kind >= _LETTER) & (kind <= _QUOTE)  # surely no white space
    run = seen & (kind != _QUOTE)
    space = kind >= _SPACE
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = run[:-1] & run[1:] & (kind[:-1] != kind[1:])
    cut[1:-1] |= seen[:-1] & space[1:]
    cut[:-2] |= space[:-1] & seen[1:]
    cut[1:-1] |= (kind[:-1] == _BREAK) & seen[1:]
    # across the end of a text nothing follows
    last = offsets[offsets > 1] - 1
    last = last[space[last]]
    cut[last] = seen[last - 1]
    cut[offsets] = True
    return np.flatnonzero(cut)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of every run, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Ids of whole texts, with the ids of pieces remembered.

    Merges never cross the pieces of a byte-level pre-tokenizer, so the ids of a text are
    those of its pieces in a row (see `cuts`). The library encodes each piece of a batch
    once, unless it is remembered. Texts that hold an added token go through the library in
    one piece, and so do all texts if the tokenizer is another than plain byte-level BPE.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.width = 2 if highest < 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_pieces = plain_byte_level(json.loads(self.tokenizer.to_str()))
        self.known: dict[bytes, int] = {}
        # of the known pieces, in order: ids, first id, number of ids
        self.ids = np.zeros(0, dtype=self.dtype)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        ids, counts = [np.zeros(0, dtype=self.dtype)], [np.zeros(0, dtype=np.int64)]
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + PASSED_CHARS, side="right")))
            encoded = self.tokenizer.encode_batch_fast(texts[start:end], add_special_tokens=False)
            counts.append(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)))
            ids.append(np.fromiter(chain.from_iterable(e.ids for e in encoded), dtype=self.dtype, count=int(counts[-1].sum())))
            start = end
        return np.concatenate(ids), np.concatenate(counts)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As `whole`, for distinct pieces."""
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        new = np.flatnonzero(at < 0)
        fresh = [pieces[k] for k in new.tolist()]
        fresh_ids, fresh_counts = self.whole([p.decode() for p in fresh])
        first, count = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        old = at >= 0
        first[old], count[old] = self.first[at[old]], self.count[at[old]]
        fresh_first = np.cumsum(fresh_counts) - fresh_counts
        first[new], count[new] = fresh_first + len(self.ids), fresh_counts
        ids = np.concatenate((self.ids, fresh_ids))[runs(first, count)]
        room = CACHED_PIECES - len(self.known)
        kept = [k for k, p in enumerate(fresh) if len(p) <= CACHED_BYTES][: max(room, 0)]
        if kept:
            kept_counts = fresh_counts[kept]
            self.known.update(zip([fresh[k] for k in kept], range(len(self.known), len(self.known) + len(kept)), strict=True))
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(kept_counts) - kept_counts))
            self.count = np.concatenate((self.count, kept_counts))
            self.ids = np.concatenate((self.ids, fresh_ids[runs(fresh_first[kept], kept_counts)]))
        return ids, count

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = bytes_of(texts) if len(texts) else (b"", None)
        if not len(data):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(texts), dtype=np.int64)
        at = cuts(data, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        distinct, ends = bytes_of(coded.dictionary)
        raw = distinct.tobytes()
        ids, count = self._pieces([raw[a:b] for a, b in pairwise(ends.tolist())])
        piece = coded.indices.to_numpy()
        counts = count[piece]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return ids[runs((np.cumsum(count) - count)[piece], counts)], np.diff(ends[np.searchsorted(at, offsets)])

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as bytes."""
        apart = np.full(len(texts), not self.by_pieces)
        for added in self.added if self.by_pieces else ():
            apart |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        cut = self._by_pieces(texts.filter(pa.array(~apart)))
        one = self.whole(texts.filter(pa.array(apart)).to_pylist())
        at = [0, 0]
        data = [cut[0].tobytes(), one[0].tobytes()]
        counts = [iter((c * self.width).tolist()) for c in (cut[1], one[1])]
        for k in apart.tolist():
            end = at[k] + next(counts[k])
            yield data[k][at[k] : end]
            at[k] = end


def plain_byte_level(tokenizer: dict) -> bool:
    """Whether a tokenizer, as its file says, encodes the matches of the byte-level pattern one by one."""
    split, model = tokenizer["pre_tokenizer"] or {}, tokenizer["model"]
    return (
        model["type"] == "BPE"
        and not model.get("dropout")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not any(tokenizer.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in tokenizer["added_tokens"])
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def write_file(out, documents: Iterable[tuple[int | None, bytes]], width: int, frame_tokens: int = FRAME_TOKENS, level: int = 3) -> tuple[int, int]:
    """Write (id, ids as bytes) in the file format; returns numbers of documents and ids."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    seek, ids, frames, firsts, counts, nulls = [], [], [], [], [], []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            raw = b"".join(held)
            packed = packer.compress(raw)
            out.write(packed)
            seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            held, size = [], 0

    for doc, data in documents:
        n = len(data) // width
        if held and size + n > frame_tokens:
            flush()
        ids.append(doc or 0)
        nulls.append(doc is None)
        frames.append(len(seek))
        firsts.append(size)
        counts.append(n)
        held.append(data)
        size += n
    flush()
    index = struct.pack("<QB", len(ids), width)
    for values, kind in ((ids, "<i8"), (frames, "<u4"), (firsts, "<u8"), (counts, "<u8"), (nulls, "<u1")):
        index += np.array(values, dtype=kind).tobytes()
    out.write(skippable(INDEX_MAGIC, index))
    table = b"".join(struct.pack("<III", *s) for s in seek) + struct.pack("<IBI", len(seek), 1 << 7, SEEKABLE_MAGIC)
    out.write(skippable(SEEK_TABLE_MAGIC, table))
    return len(ids), sum(counts)


class TokenFile:
    """Reader over a random-access file; decompresses only what is asked for."""

    def __init__(self, source, size: int):
        self.source, self.frames_read = source, 0
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 1 << 7:
            raise ValueError("not a seekable file with checksums")
        table_at = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(table_at, 8)) != (SEEK_TABLE_MAGIC, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.seek = np.frombuffer(self._at(table_at + 8, 12 * n), dtype="<u4").reshape(n, 3)
        self.at = np.concatenate(([0], np.cumsum(self.seek[:, 0].astype(np.int64))))
        head = int(self.at[-1])
        magic, length = struct.unpack("<II", self._at(head, 8))
        if magic != INDEX_MAGIC or head + 8 + length != table_at:
            raise ValueError("damaged document index")
        body = self._at(head + 8, length)
        docs, self.width = struct.unpack("<QB", body[:9])
        self.dtype, columns, at = np.dtype("<u2" if self.width == 2 else "<u4"), [], 9
        for kind in ("<i8", "<u4", "<u8", "<u8", "<u1"):
            columns.append(np.frombuffer(body, dtype=kind, count=docs, offset=at))
            at += docs * np.dtype(kind).itemsize
        self.ids, self.frame, self.first, self.count, self.null = columns

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(int(offset))
        data = self.source.read(int(n))
        if len(data) != n:
            raise ValueError("file is cut short")
        return data

    def frame_content(self, k: int) -> bytes:
        packed = self._at(self.at[k], self.seek[k, 0])
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.seek[k, 1]))
        if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"checksum of frame {k} does not match")
        self.frames_read += 1
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, ids) of all documents, or of those at the given positions of the index."""
        open_frame, raw = -1, b""
        for k in range(len(self.ids)) if wanted is None else sorted(wanted):
            if self.frame[k] != open_frame:
                open_frame = int(self.frame[k])
                raw = self.frame_content(open_frame)
            ids = np.frombuffer(raw, dtype=self.dtype, count=int(self.count[k]), offset=int(self.first[k]) * self.width)
            yield (None if self.null[k] else int(self.ids[k])), ids


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder or file; Spark writes local folders as file:/x or /x."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def open_file(uri: str) -> TokenFile:
    store, path = file_system(uri)
    return TokenFile(store.open_input_file(path), store.get_file_info(path).size)


MANIFEST = "part int, path string, first_doc long, n_docs long, n_tokens long, n_bytes long"


def write_tokens(df: DataFrame, path: str, end_id: int | None = END_ID, folder: str | None = None, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode (doc_id, text) into files in ascending doc_id order; returns the manifest."""
    folder = folder or shared_dir(df.sparkSession, "tokens")
    store, place = file_system(folder)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path)
        end = b"" if end_id is None else np.array([end_id], dtype=coder.dtype).tobytes()
        seen: list[int | None] = []

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in sliced(batches, 1, ENCODED_BYTES):
                ids = batch.column(0).to_pylist()
                seen.extend(ids[:1] if not seen else ())
                for doc, data in zip(ids, coder.encode(batch.column(1)), strict=True):
                    yield doc, data + end

        rows = documents()
        head = next(rows, None)
        if head is None:
            return
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ztok"
        store, place = file_system(name)

        def again() -> Iterator[tuple[int | None, bytes]]:
            yield head
            yield from rows

        with store.open_output_stream(place) as out:
            docs, tokens = write_file(out, again(), coder.width, frame_tokens)
            size = out.tell()
        columns = [[part], [name], [seen[0]], [docs], [tokens], [size]]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return settled(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start, n_tokens, ids_crc32, and its file.

    `start` counts all ids before the document in the order of the files.
    """
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = open_file(path)
                starts = base + np.concatenate(([0], np.cumsum(file.count.astype(np.int64))))[:-1]
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.documents()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.ids.astype(np.int64), mask=file.null.astype(bool)),
                        pa.array(starts.astype(np.int64)),
                        pa.array(file.count.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                        pa.array([part] * len(sums), pa.int32()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )

    # a number of its own: left to itself, Spark merges rows this small into one task
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
