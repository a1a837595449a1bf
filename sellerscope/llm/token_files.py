"""Token-ID files: one independent zstandard frame per document, a trailing seek table, a checksum per frame.

A file is frames of little-endian unsigned 32-bit ids, a skippable frame with the documents' ids, and the seek
table of the published seekable format as a last skippable frame; so a reader fetches the tail, and then only the
frames it wants.  A manifest table has one row per file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_kind, open_fs, shared_path, ship, worker_state, written

ship(__name__)

END_ID = 1
#: Fixed values of the seekable format: magic numbers of the two skippable frames and of the footer; the flag "with checksums".
IDS_MAGIC, SEEK_MAGIC, FOOT_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A new file begins after so many compressed bytes.
FILE_BYTES = 128 << 20
LEVEL = 1
#: Words and pieces whose ids a Python worker remembers.
CACHE = 150_000
MANIFEST = "part int, seq int, path string, bytes long, n_docs long, n_tokens long"


class Encoder:
    """Ids of whole texts by the tokenizers library, remembered by word.

    Where the file's normalizer, pre-tokenizer and special tokens are those of CUTS, it drops white space and never joins
    words across it, so a text's ids are those of its words.  Words of ASCII and Latin-1 letters are then cut into
    the pieces of its pattern and go to its BPE model; all others, and texts that spell a special token, go through
    its full encoder.  Any other tokenizer encodes whole texts by its full encoder.
    """

    #: Fixed values, as the tokenizer file has them: what the cuts below rest on.
    CUTS = {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}

    SIMPLE = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
    PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        spec = json.loads(self.full.to_str())
        self.by_word = (all(spec[k] == v for k, v in self.CUTS.items()) and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
                        and spec["truncation"] is None and spec["padding"] is None
                        and all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"]))
        self.words, self.old, self.pieces = {}, {}, {}
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the byte-level alphabet's rule
        rest = [b for b in range(256) if b not in set(own)]
        self.sign = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def piece(self, p: str) -> bytes:
        """Ids of one piece of the pattern, by the BPE model."""
        spelt = p if p.isascii() else "".join([self.sign[b] for b in p.encode()])
        t = self.model.tokenize(spelt)
        return struct.pack(f"<{len(t)}I", *[x.id for x in t])

    def word(self, w: bytes) -> bytes:
        if not self.SIMPLE.fullmatch(w):
            return np.array(self.full.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.PIECE.findall(w.decode().lower())
        if len(parts) == 1:  # the word is its own piece, and remembered as such
            return self.pieces.get(parts[0]) or self.piece(parts[0])
        return b"".join([self.pieces.get(p) or self.pieces.setdefault(p, self.piece(p)) for p in parts])

    def miss(self, w: bytes) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            ids = self.old.pop(w, None)
            self.words[w] = ids = self.word(w) if ids is None else ids
        return ids

    def text(self, t: bytes) -> bytes:
        if not self.by_word or b"<|" in t:
            return np.array(self.full.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        words = t.lower().split()
        ids = list(map(self.words.get, words))
        if None in ids:
            miss = self.miss
            ids = [x if x is not None else miss(w) for x, w in zip(ids, words)]
        if len(self.words) > CACHE:
            self.words, self.old = {}, self.words
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        return b"".join(ids)


class Writer:
    """Frames of one file in the making."""

    def __init__(self, folder: str, name: str):
        import zstandard
        self.fs, where = open_fs(folder)
        self.fs.create_dir(where, recursive=True)
        self.path, self.out = f"{folder}/{name}", self.fs.open_output_stream(f"{where}/{name}", compression=None)
        self.zip, self.seek, self.ids, self.size, self.tokens = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), [], [], 0, 0

    def add(self, doc_id, ids: bytes):
        import xxhash
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.seek.append(struct.pack("<3I", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.size += len(frame)
        self.tokens += len(ids) // 4

    def close(self):
        import xxhash
        names = self.zip.compress(json.dumps(self.ids).encode())
        self.out.write(struct.pack("<2I", IDS_MAGIC, len(names)) + names)
        self.seek.append(struct.pack("<3I", 8 + len(names), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, FOOT_MAGIC)
        self.out.write(struct.pack("<2I", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        return self.path, self.size + 16 + len(names) + len(table), len(self.ids), self.tokens


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the files in ascending id order (null ids first; of equal ids, in order of the text's hash) and returns
    the manifest.  A retried task writes files of new names; only those in the manifest count."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        enc, now, seq, done = worker_state(f"encoder:{tokenizer}", lambda: Encoder(tokenizer)), None, 0, []

        def closed():
            return (task.partitionId(), seq, *now.close())
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                if now is None:
                    now = Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}.ids.zst")
                now.add(i, enc.text(t.as_py() or b"") + end)
                if now.size >= FILE_BYTES:
                    done.append(closed())
                    now, seq = None, seq + 1
        if now is not None:
            done.append(closed())
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "bytes", "n_docs", "n_tokens"), x)) for x in done], schema=pa.schema(
            [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def read_file(path: str, wanted=None):
    """Yields (place in the file, document id, tokens before it in the file, ids as bytes) of the wanted places, or all.

    Reads the tail, then the byte ranges of the wanted frames, and checks each frame's checksum.
    """
    import xxhash
    import zstandard
    fs, where = open_fs(path)
    with fs.open_input_file(where) as f:
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != FOOT_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path}: no seek table")
        seek = np.frombuffer(f.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(seek[:, 0])])
        before = np.concatenate([[0], np.cumsum(seek[:, 1])]) // 4
        unzip = zstandard.ZstdDecompressor()
        ids = json.loads(unzip.decompress(f.read_at(int(seek[-1, 0]) - 8, int(at[n - 1]) + 8)))
        for k in range(n - 1) if wanted is None else sorted(wanted):
            raw = unzip.decompress(f.read_at(int(seek[k, 0]), int(at[k])))
            if len(raw) != seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != seek[k, 2]:
                raise ValueError(f"{path}: frame {k} is damaged")
            yield k, ids[k], int(before[k]), raw


def read_token_files(manifest: DataFrame, kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` adds the tokens of earlier files: a running sum over the manifest, one row per file.
    """
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = written(manifest.withColumn("base", before).select("path", "base", "n_docs"), "files")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

        def batch(rows):
            cols = list(zip(*rows))
            kinds = [arrow_kind(kind), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, held = [], 0
                for _, i, s, raw in read_file(path):
                    rows.append((i, base + s, len(raw) // 4, zlib.crc32(raw)) + (raw,) * with_ids)
                    held += len(raw) if with_ids else 64
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
    out = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return files.select("path", "base").repartition(n, "path").mapInArrow(run, out)


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files in the shared folder, reads them back and returns doc_id, start, n_tokens, ids_crc32.

    Null or empty text: the end id alone.  Null ids come first; rows of one id stand in order of the text's hash.
    Empty table: no file, no row.  Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    return read_token_files(write_token_files(docs, tokenizer, shared_path(docs.sparkSession, "tokens"), doc_id, text), kind)
