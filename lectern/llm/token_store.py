"""Content-addressed store of token ids.

Each document's id stream is cut into chunks where a rolling hash over the last ids says so, so that equal passages
give equal chunks wherever they stand. A chunk is stored once under the digest of its bytes. A document is a recipe: the
digests and lengths of its chunks, with a Merkle root over the digests; recipes are written in ascending document order in
segments. The manifest has the root of a Merkle tree for each segment, whose leaves are (identifier, number of ids, recipe root) of its
documents in order, with their number and the ids in and ahead of the segment; a last row, of segment -1, has the same for
the whole store, over its segments. Readers build all of it again from the recipes and compare, so a recipe that is lost, changed,
doubled or in another's place is found, as is a manifest row.

Layout under the store's folder (Parquet): store/kind=chunk (key, payload), store/kind=doc (recipes as dealt),
index (recipes in order: segment, pos, doc_id, ahead, n_tokens, root, digests, lens) and manifest (segment, start, n_tokens,
n_docs, root).

Words recur, so texts are split into white-space-separated words some megabytes at a time, by Arrow, each distinct word is looked up
once, and encodings of words are kept in a bounded cache; that gives the ids of encoding the
whole text where no pre-token, added token or normalisation step of the vocabulary reaches across ASCII white space, which is
read from its configuration (tested against the library); other vocabularies encode whole texts. Only digests travel for joins when reading back; the checksum of a document is put together
from those of its chunks, since CRC-32 is linear.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batched, hold, mix64, new_path

END_ID = 1
DIGEST = 16
STORE = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("digests", pa.binary()), ("lens", pa.binary())])
STORE_DDL = "kind string, key binary, doc_id long, n long, payload binary, digests binary, lens binary"
_ENCODERS: dict[str, Encoder] = {}


def _byte_symbols() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, the rest from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(x for x in range(256) if x not in shown)}


class Encoder(dict):
    """Ids of a text as the tokenizers library gives them; a bounded cache from words (bytes) to packed ids.

    In vocabularies built like word_bpe_49k.json (see `lowers`) no token reaches across ASCII white space, so words are encoded one
    by one: a word of Latin letters with ASCII marks after it is one or two pre-tokens, which go straight to the
    library's model; any other word goes through the library as a whole. With any other vocabulary each text goes through
    the library whole.
    """

    MOST = 800_000
    #: Letters up to U+024F that lower and normalise one by one.
    LETTERS = re.compile("[a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
    #: Visible ASCII, less what special tokens and contractions begin with, its pre-tokens, and what of it is neither letter nor digit.
    PRINTABLE, PIECES = re.compile(rb"[!-&(-;=-~]+"), re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
    MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and x not in b"'<")
    #: Fixed value: the pre-tokens of such a vocabulary, which leave white space out.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SYMBOLS = "".join(_byte_symbols()[b] for b in range(256))

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        config = json.loads(self.tokenizer.to_str())
        self.special = [t["content"].encode() for t in config["added_tokens"]]
        names = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        splits = [x["type"] for x in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # What encoding by words and LETTERS rely on.
        self.lowers = names == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and config["model"]["type"] == "BPE" and not config["post_processor"]
        if self.lowers:
            split, as_bytes_ = config["pre_tokenizer"]["pretokenizers"]
            self.lowers = split["pattern"].get("Regex") == self.SPLIT and split["behavior"] == "Removed" and split["invert"] and not as_bytes_["add_prefix_space"] and not as_bytes_["use_regex"]
        if self.lowers:
            self.packed = [k.to_bytes(self.width, "little") for k in range(max(self.tokenizer.get_vocab().values()) + 1)]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        hold(_ENCODERS[path])
        return _ENCODERS[path]

    def _model(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = codecs.charmap_decode(piece.encode(), "strict", self.SYMBOLS)[0]
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(piece)])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        letters = word.rstrip(self.MARKS)
        if letters.isalpha():  # ASCII letters alone
            out = self._model(letters.decode().lower()) if len(letters) == len(word) else self[letters] + self[word[len(letters) :]]
        elif not letters or self.PRINTABLE.fullmatch(word):
            parts = self.PIECES.findall(word)
            out = b"".join([self[x] for x in parts]) if len(parts) > 1 else self._model(word.decode())
        elif self.LETTERS.fullmatch(text := letters.decode("utf-8", "replace")):
            out = self._model(text.lower()) if len(letters) == len(word) else self[letters] + self[word[len(letters) :]]
        else:
            out = array(self.kind, self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of `width` bytes each, for each text."""
        if not self.lowers:
            return [array(self.kind, self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes() for t in texts]
        # A-Z is lowered ahead of the cache as the vocabulary lowers all the same, but not where a special token may be spelled out.
        lowered = [t if any(x in low for x in self.special) else low for t, low in zip(texts, map(bytes.lower, texts), strict=True)]
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in lowered], out=ends[1:])
        whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(b"".join(lowered)))
        words = pc.ascii_split_whitespace(whole)
        each = words.flatten().dictionary_encode()
        # Each distinct word is looked up once, then its ids are put where it stands.
        distinct = each.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)
        ids = pa.array([self[w] for w in distinct], pa.large_binary()).take(each.indices)
        _, places, data = ids.buffers()
        at = np.frombuffer(places, np.int64, len(ids) + 1)[words.offsets.to_numpy()].tolist()
        return [data[a:z].to_pybytes() for a, z in zip(at, at[1:], strict=False)]


_MIXED_IDS = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _marks(ids: np.ndarray, window: int, mean: int, at_once: int = 1 << 15) -> np.ndarray:
    """The ends of those runs of `window` ids whose hash says so, one in `mean`."""
    base, found = 0x9E3779B97F4A7C15, [np.empty(0, np.int64)]
    for a in range(0, len(ids) - window + 1, at_once):
        part = ids[a : a + at_once + window - 1]
        x = _MIXED_IDS.take(part) if ids.itemsize == 2 else mix64(part.astype(np.uint64) + np.uint64(1))
        h, n = x, 1  # of runs of n ids; two runs beside each other make one twice as long
        for bit in bin(window)[3:]:
            h, n = h[:-n] * np.uint64(pow(base, n, 1 << 64)) + h[n:], 2 * n
            if bit == "1":
                h, n = h[:-1] * np.uint64(base) + x[n:], n + 1
        found.append(np.flatnonzero(mix64(h) < np.uint64((1 << 64) // mean)) + (a + window))
    return np.concatenate(found)


def cuts_of(streams: list[np.ndarray], window: int = 8, mean: int = 512, least: int = 128, most: int = 4096) -> list[list[int]]:
    """Where the chunks of each id stream end. A boundary depends on the last `window` ids alone, but for `least` and `most`."""
    if not streams:
        return []
    found = _marks(np.concatenate(streams), window, mean)
    ends = np.cumsum([len(x) for x in streams])
    starts = ends - [len(x) for x in streams]
    lo, hi = np.searchsorted(found, starts + window), np.searchsorted(found, ends, side="right")
    out = []
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        own, last, n = [], 0, e - s
        for c in [*(found[a:b] - s).tolist(), n]:
            while c - last > most:
                last += most
                own.append(last)
            if c - last >= least or c == n > last:
                own.append(c)
                last = c
        out.append(own)
    return out


def cuts(ids: np.ndarray, window: int = 8, mean: int = 512, least: int = 128, most: int = 4096) -> list[int]:
    """cuts_of a single stream."""
    return cuts_of([ids], window, mean, least, most)[0]


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; inner nodes are hashed under a mark of their own, a last odd node moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [hashlib.blake2b(level[k] + level[k + 1], digest_size=DIGEST, person=b"inner").digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class Tree:
    """The root that merkle() gives for leaves that come one by one; holds one node for each bit of their number."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, bytes]] = []

    @staticmethod
    def inner(left: bytes, right: bytes) -> bytes:
        return hashlib.blake2b(left + right, digest_size=DIGEST, person=b"inner").digest()

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.nodes and self.nodes[-1][0] == level:
            leaf, level = self.inner(self.nodes.pop()[1], leaf), level + 1
        self.nodes.append((level, leaf))

    def root(self) -> bytes:
        if not self.nodes:
            return digest(b"")
        out = self.nodes[-1][1]
        for _, left in self.nodes[-2::-1]:
            out = self.inner(left, out)
        return out


def leaf(name: int | None, n: int, root: bytes, kind: bytes = b"doc") -> bytes:
    """What stands for a document, or a segment, in the tree above it."""
    return hashlib.blake2b(f"{name} {n} ".encode() + root, digest_size=DIGEST, person=kind).digest()


# CRC-32 as arithmetic over GF(2): bit-reflected polynomials, lowest power in the highest bit.
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC polynomial, element by element."""
    a, out = np.broadcast_to(np.asarray(a, np.uint32), np.shape(b)).copy(), np.zeros(np.shape(b), np.uint32)
    b = np.asarray(b, np.uint32).copy()
    for k in range(32):
        out ^= np.where((a >> np.uint32(31 - k)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x to the power 8 * n_bytes."""
    n, out = np.asarray(n_bytes, np.uint64).copy(), np.full(len(n_bytes), 0x80000000, np.uint32)
    power = np.array([0x00800000], np.uint32)  # x ** 8
    while n.any():
        odd = (n & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(power[0], out[odd])
        power, n = _times(power, power), n >> np.uint64(1)
    return out


def crc_share(crc: np.ndarray, n_bytes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part of n_bytes with checksum crc adds, by exclusive or, to the bare checksum of a whole in which `after` bytes follow."""
    bare = crc.astype(np.uint32) ^ np.uint32(0xFFFFFFFF) ^ _times(np.uint32(0xFFFFFFFF), _shift(n_bytes))
    return _times(bare, _shift(after))


def crc_whole(shares_xor: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    return shares_xor.astype(np.uint32) ^ _times(np.uint32(0xFFFFFFFF), _shift(n_bytes)) ^ np.uint32(0xFFFFFFFF)


def portions(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of (identifier, text) in parts of bounded bytes of text; a longer text is a part by itself."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, side="right")))
            yield b.slice(a, z - a)
            a = z


def write_store(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> str:
    """Write the store of all rows and return its folder. Null text is empty (the end id alone); a null identifier sorts
    first; repeated rows are documents of their own and share their chunks. Other columns are ignored. Texts of any length are
    encoded whole. An empty table gives an empty store."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        kind, end = f"<u{encoder.width}", np.array([end_id], f"<u{encoder.width}").tobytes()
        seen: set[bytes] = set()

        def rows() -> Iterator[tuple]:
            for batch in portions(batches):
                streams = [x + end for x in encoder.encode([t or b"" for t in as_bytes(batch.column(1))])]
                arrays = [np.frombuffer(x, kind) for x in streams]
                for doc, stream, ids, own in zip(batch.column(0).to_pylist(), streams, arrays, cuts_of(arrays), strict=True):
                    last, keys, lens = 0, [], []
                    for c in own:
                        payload = stream[last * encoder.width : c * encoder.width]
                        keys.append(key := digest(payload))
                        lens.append(c - last)
                        last = c
                        if key not in seen:
                            if len(seen) > 200_000:  # only saves sending a chunk twice
                                seen.clear()
                            seen.add(key)
                            yield "chunk", key, None, lens[-1], payload, None, None
                    yield "doc", digest(str(doc).encode()), doc, len(ids), None, b"".join(keys), np.array(lens, "<u4").tobytes()

        return batched(rows(), STORE)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by kind and key, less repeated chunks; whole columns are compared with themselves one row on."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            n = whole.num_rows - 1
            kind, key, payload = (whole.column(k) for k in (0, 1, 4))
            again = pc.and_(pc.equal(kind.slice(1), "chunk"), pc.and_(pc.equal(kind.slice(0, n), "chunk"), pc.equal(key.slice(1), key.slice(0, n))))
            if pc.any(pc.and_(again, pc.not_equal(payload.slice(1), payload.slice(0, n)))).as_py():
                raise ValueError("two chunks with one digest")
            # The first row was passed on with the batch before, or is the first of all.
            yield whole.slice(1).filter(pc.invert(again)) if last is not None else whole.filter(pa.concat_arrays([pa.array([True]), pc.invert(again)]))
            last = batch.slice(batch.num_rows - 1)

    pieces = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(cut, STORE_DDL)
    stored = pieces.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(once, STORE_DDL)
    stored.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/store")
    _write_index(spark, folder)
    return folder


INDEX = pa.schema([("segment", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("ahead", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.binary()), ("lens", pa.binary())])
INDEX_DDL = "segment int, pos long, doc_id long, ahead long, n_tokens long, root binary, digests binary, lens binary"
STORE_READ = "key binary, doc_id long, n long, payload binary, digests binary, lens binary, kind string"


def _write_index(spark: SparkSession, folder: str) -> None:
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            pos = ahead = 0
            for b in batches:
                for doc, n, digests, lens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    root = merkle([digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)])
                    yield segment, pos, doc, ahead, n, root, digests, lens
                    pos, ahead = pos + 1, ahead + n

        return batched(rows(), INDEX)

    recipes = spark.read.schema(STORE_READ).parquet(f"{folder}/store").where(F.col("kind") == "doc").select("doc_id", "n", "digests", "lens")
    # The digest is among the splitters, so that many rows of one identifier don't fall to one task.
    keys = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("digests"), F.col("lens")]
    dealt = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("n")).sortWithinPartitions(*keys)
    dealt.mapInArrow(order, INDEX_DDL).write.option("compression", "zstd").parquet(f"{folder}/index")
    index = spark.read.schema(INDEX_DDL).parquet(f"{folder}/index")

    rows = _manifest_rows(sorted(tuple(r) for r in _segments(index).collect()))  # a row for each task that wrote
    spark.createDataFrame(rows, MANIFEST_DDL).coalesce(1).write.parquet(f"{folder}/manifest")


MANIFEST_DDL = "segment int, start long, n_tokens long, n_docs long, root binary"


def _segments(index: DataFrame) -> DataFrame:
    """segment, n_tokens, n_docs, root of each segment, from its recipes; rows out of place, lost, doubled or shifted among them raise."""
    schema = pa.schema([("segment", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            segment, tree, n_docs, n_tokens = None, Tree(), 0, 0
            for b in batches:
                for s, pos, doc, ahead, n, root in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if s != segment:
                        if segment is not None:
                            yield segment, n_tokens, n_docs, tree.root()
                        segment, tree, n_docs, n_tokens = s, Tree(), 0, 0
                    if pos != n_docs or ahead != n_tokens:
                        raise ValueError(f"the index is damaged: segment {s} at {pos}, document {doc}")
                    tree.add(leaf(doc, n, root))
                    n_docs, n_tokens = n_docs + 1, n_tokens + n
            if segment is not None:
                yield segment, n_tokens, n_docs, tree.root()

        return batched(rows(), schema)

    # A segment is one task's sorted file; its rows here are some 60 bytes each.
    dealt = index.select("segment", "pos", "doc_id", "ahead", "n_tokens", "root").repartition("segment").sortWithinPartitions("segment", "pos")
    return dealt.mapInArrow(run, "segment int, n_tokens long, n_docs long, root binary")


def _manifest_rows(segments: list[tuple]) -> list[tuple]:
    """The manifest of segments (segment, n_tokens, n_docs, root) in order."""
    start, n_docs, tree, out = 0, 0, Tree(), []
    for s, n, docs, root in segments:
        out.append((s, start, n, docs, bytearray(root)))
        tree.add(leaf(s, n, bytes(root), b"segment"))
        start, n_docs = start + n, n_docs + docs
    return [*out, (-1, 0, start, n_docs, bytearray(tree.root()))]


def _verified(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The index, and where each segment starts (segment, s0), once the manifest is what the index gives."""
    index = spark.read.schema(INDEX_DDL).parquet(f"{folder}/index")
    said = spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/manifest")
    rows = _manifest_rows(sorted(tuple(r) for r in _segments(index).collect()))
    plain = lambda rows: sorted((*r[:4], bytes(r[4])) for r in rows)
    if plain(said.collect()) != plain(rows):
        raise ValueError("the index or its manifest is damaged")
    return index, spark.createDataFrame([r[:2] for r in rows], "segment int, s0 long")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """What the store's files hold, a row per document: doc_id, start (ids ahead of it), n_tokens, ids_crc32, root.

    The manifest is checked against the recipes here; every recipe against its root, and every chunk against its digest, as rows are
    read. A damaged store raises."""
    stored = spark.read.schema(STORE_READ).parquet(f"{folder}/store")
    index, starts = _verified(spark, folder)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("c_n", pa.int64()), ("crc", pa.int64())])

        def rows() -> Iterator[tuple]:
            for b in batches:
                for key, n, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if digest(payload) != key or not n or len(payload) % n:
                        raise ValueError(f"chunk {key.hex()} is damaged")
                    yield key, n, zlib.crc32(np.frombuffer(payload, f"<u{len(payload) // n}").astype("<u4").tobytes())

        return batched(rows(), schema)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("after", pa.int64())])

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, start, n, root, digests, lens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    keys = [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]
                    sizes = np.frombuffer(lens, "<u4").tolist()
                    if merkle(keys) != root or sum(sizes) != n:
                        raise ValueError(f"the recipe of document {doc} is damaged")
                    left = n
                    for key, size in zip(keys, sizes, strict=True):
                        left -= size
                        yield doc, start, n, root, key, size, left

        return batched(rows(), schema)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, after, c_n, crc = (b.column(k).to_numpy(zero_copy_only=False) for k in ("n", "after", "c_n", "crc"))
            if b.column("c_n").null_count or (n != c_n).any():
                raise ValueError("a chunk is missing or not as long as its recipes say")
            share = crc_share(crc, n * 4, after * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "start", "n_tokens", "root")), pa.array(share)], names=["doc_id", "start", "n_tokens", "root", "share"])

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = (b.column(k).to_numpy(zero_copy_only=False) for k in ("x", "n_tokens"))
            crc = crc_whole(x, n * 4).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "start", "n_tokens")), pa.array(crc), b.column("root")], names=["doc_id", "start", "n_tokens", "ids_crc32", "root"])

    chunks = stored.where(F.col("kind") == "chunk").select("key", "n", "payload").mapInArrow(verify, "key binary, c_n long, crc long")
    # One row for each segment, as many as the index has partitions.
    placed = index.join(F.broadcast(starts), "segment").select("doc_id", (F.col("s0") + F.col("ahead")).alias("start"), "n_tokens", "root", "digests", "lens")
    asked = placed.mapInArrow(steps, "doc_id long, start long, n_tokens long, root binary, key binary, n long, after long")
    found = asked.join(chunks, "key", "left").mapInArrow(shares, "doc_id long, start long, n_tokens long, root binary, share long")
    # start differs between documents, since each has one id at least.
    docs = found.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.expr("bit_xor(share)").alias("x"))
    return docs.select("doc_id", "start", "n_tokens", "x", "root").mapInArrow(wholes, "doc_id long, start long, n_tokens long, ids_crc32 long, root binary")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids themselves, a row per document: doc_id, start, ids. For readers that want them back; moves all chunks. The manifest is
    checked."""
    stored = spark.read.schema(STORE_READ).parquet(f"{folder}/store").where(F.col("kind") == "chunk").select("key", "payload", F.col("n").alias("c_n"))
    index, starts = _verified(spark, folder)
    index = index.join(F.broadcast(starts), "segment")
    each = index.select("doc_id", (F.col("s0") + F.col("ahead")).alias("start"), F.expr(f"transform(sequence(0, cast(length(digests) / {DIGEST} as int) - 1), k -> struct(k, substring(digests, k * {DIGEST} + 1, {DIGEST}) as key))").alias("e"))
    each = each.select("doc_id", "start", F.inline("e")).join(stored, "key")

    @F.pandas_udf("array<long>")
    def unpack(parts, widths):
        return parts.combine(widths, lambda p, w: [int(x) for q, k in zip(p, w, strict=True) for x in np.frombuffer(q, f"<u{len(q) // k}")])

    whole = each.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "payload", "c_n"))).alias("p"))
    return whole.select("doc_id", "start", unpack(F.col("p.payload"), F.col("p.c_n")).alias("ids"))
