"""Token ids in wavelet-matrix shards (operator 5).

Documents are encoded, the end id is appended, and the ids are stored in shards
by ascending doc_id. A shard holds one wavelet matrix: its distinct ids in
order are its alphabet, each token is a code of as many bits as the alphabet
needs, and bit-plane k holds bit k of the codes in the order that stable
partitions by the planes above left them in. With a directory of ones before
each 512-bit block, rank and select on the planes give the token at a position,
the number of times an id occurs and the place of its n-th occurrence from the
compressed planes alone.

File format: a Parquet folder, one row a shard and one file a shard, with the
columns of ``SCHEMA``; every plane is compressed by itself (Zstandard), so a
reader of one plane unpacks that one.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, release_memory, shared_path, slices

END_ID = 2
BLOCK = 512
#: Tokens that a shard gathers before it is closed (its last document may go
#: past that): bounds a worker's memory whatever the input's size.
SHARD_TOKENS = 1_000_000
#: Characters of text that a partition of the range exchange aims at: a task
#: encodes them in slices, and the more it has, the fewer pieces are new to it.
PART_CHARS = 16_000_000

SCHEMA = ("first_doc long, part int, seq int, n_tokens long, doc_ids binary, doc_sizes binary, alphabet binary, "
          "zeros array<long>, planes array<binary>, ranks array<binary>")


class WaveletMatrix:
    """Rank, select and access over codes below ``2 ** len(planes)``."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.alphabet, self.zeros, self.planes, self.ranks = n, alphabet, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
        code_of = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
        code_of[alphabet] = np.arange(len(alphabet))
        codes = code_of[ids]
        if len(alphabet) <= 1 << 16:
            codes = codes.astype(np.uint16)
        zeros, planes, ranks = [], [], []
        for k in reversed(range(max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0)):
            bits = ((codes >> codes.dtype.type(k)) & codes.dtype.type(1)).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            planes.append(packed)
            ranks.append(cls._directory(packed))
            low = codes.compress(~bits)
            zeros.append(len(low))
            codes = np.concatenate([low, codes.compress(bits)])
        return cls(len(ids), alphabet.astype(np.uint32), zeros, planes, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits."""
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def rank(self, plane: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block = i // BLOCK
        row, a = self.planes[plane], block * (BLOCK // 8)
        count = int(self.ranks[plane][block]) + int(np.bitwise_count(row[a:i // 8]).sum())
        return count + (int(row[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def select(self, plane: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) ``bit`` of a plane."""
        held = (lambda b: int(self.ranks[plane][b])) if bit else (lambda b: b * BLOCK - int(self.ranks[plane][b]))
        low, high = 0, len(self.ranks[plane]) - 1
        while low < high:  # the last block with no more than nth such bits before it
            mid = (low + high + 1) // 2
            low, high = (mid, high) if held(mid) <= nth else (low, mid - 1)
        bits = np.unpackbits(self.planes[plane][low * (BLOCK // 8):(low + 1) * (BLOCK // 8)], bitorder="little")
        return low * BLOCK + int(np.flatnonzero(bits == bit)[nth - held(low)])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        code = 0
        for k, row in enumerate(self.planes):
            bit, ones = (int(row[i // 8]) >> (i % 8)) & 1, self.rank(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = bisect_left(self.alphabet, token)
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _interval(self, code: int, start: int, end: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self.rank(k, start), self.rank(k, end)
            start, end = (self.zeros[k] + a, self.zeros[k] + b) if code >> (len(self.planes) - 1 - k) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in the positions from start up to end."""
        if (code := self._code(token)) is None:
            return 0
        a, b = self._interval(code, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) occurrence of an id."""
        if (code := self._code(token)) is None or not 0 <= nth < self.count(token):
            raise IndexError(f"id {token} has no occurrence {nth}")
        at = self._interval(code, 0, self.n)[0] + nth
        for k in reversed(range(len(self.planes))):
            at = self.select(k, 1, at - self.zeros[k]) if code >> (len(self.planes) - 1 - k) & 1 else self.select(k, 0, at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable partitions from the last plane up."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for step, (row, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(row, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bits)] = codes[:z]
            up[np.flatnonzero(bits)] = codes[z:] | kind(1 << step)
            codes = up
        return self.alphabet[codes] if self.n else np.empty(0, np.uint32)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer; the same without the steps that do nothing to a word of
    lower-case letters; and which of its ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer, short = Tokenizer.from_file(path), Tokenizer.from_file(path)
    short.normalizer = normalizers.Sequence([])
    short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, short, ends_word


# A chunk whose pieces are known without the tokenizer's own
# patterns (printable ASCII without capitals and apostrophes, and small Latin-1
# letters, none of which a normal form changes); the kind of each byte, and the
# second bytes of those letters, whose first one is 0xC3.
_SIMPLE = re.compile("[!-&(-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_SECOND = np.zeros(256, bool)
_SECOND[0x9F:0xB7] = _SECOND[0xB8:0xC0] = True
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x27] = _KIND[0x28:0x41] = _KIND[0x5B:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x61:0x7B] = _KIND[0xC3] = _KIND[_SECOND] = _LETTER
_KIND[0x09:0x0E] = _KIND[0x20] = _SPACE
_SPACES = bytes(np.flatnonzero(_KIND == _SPACE).tolist())


def pieces_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in a row, and how many each text has.

    The tokenizer lower-cases letters, drops white space and never reaches
    across it, so chunks between ASCII white space are encoded one by one, A-Z
    lower-cased; texts that may spell a special token, whose case counts, keep
    their letters. A simple chunk is cut further, as the tokenizer does, into
    runs of letters, single digits and runs of other marks."""
    joined = b" ".join([*texts, b""])
    joined = b" ".join([*[t if b"<|" in t else t.lower() for t in texts], b""]) if b"<|" in joined else joined.lower()
    raw, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KIND.tobytes()), np.uint8)
    first, second = raw == 0xC3, np.frombuffer(joined.translate(_SECOND.tobytes()), bool)
    other = kind == _OTHER
    odd = first[:-1] != second[1:]  # half a letter
    special = (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    other[:1] |= second[:1]
    other[1:] |= odd
    other[:-1] |= odd & first[:-1] | special
    before = np.concatenate([np.zeros(min(1, len(kind)), np.uint8), kind[:-1]])
    solid = kind != _SPACE
    at = np.flatnonzero(solid & ((kind != before) | (kind == _DIGIT)))
    other &= solid
    others = np.flatnonzero(other & ~np.concatenate([np.zeros(min(1, len(other)), bool), other[:-1]]))  # where a run of them starts
    if len(others):
        starts = before[at] == _SPACE
        whole = np.zeros(np.count_nonzero(starts), bool)
        whole[np.searchsorted(at.compress(starts), others, "right") - 1] = True
        at = at.compress(starts | ~whole[np.cumsum(starts) - 1])
    counts = np.diff(np.searchsorted(at, np.cumsum([0, *[len(t) + 1 for t in texts]])))
    held = joined.translate(None, _SPACES)
    buffers = [None, pa.py_buffer(np.append(np.cumsum(solid, dtype=np.int32)[at] - 1, len(held)).astype(np.int32)), pa.py_buffer(held)]
    return pa.Array.from_buffers(pa.binary(), len(at), buffers), counts


def _encode(tokenizer, short, ends_word: np.ndarray, texts: list[str]) -> pa.Array:
    """Ids of each text, as little-endian unsigned 32-bit, encoded in lines of many.
    A simple chunk is here a piece, a word of its own to the tokenizer, which marks
    the last token of a word; a token of another text belongs to it by its first
    character."""
    simple = [_SIMPLE.fullmatch(t) is not None and "<|" not in t for t in texts]
    plain, rest = [i for i, x in enumerate(simple) if x], [i for i, x in enumerate(simple) if not x]
    done: list[int] = []
    sizes, found = [np.zeros(1, np.int64)], [np.empty(0, "<u4")]

    def lines(some: list[int], run) -> Iterator[tuple[list[int], list, np.ndarray]]:
        cut = [some[a:a + 500] for a in range(0, len(some), 500)]
        for line, e in zip(cut, run(["\n".join([texts[i] for i in x]) for x in cut], add_special_tokens=False), strict=True):
            yield line, e, np.array(e.ids, dtype="<u4")

    def put(line: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        done.extend(line)
        sizes.append(np.diff(ends, prepend=0))
        found.append(ids)

    for line, _, ids in lines(plain, short.encode_batch_fast):
        ends = np.flatnonzero(ends_word[ids]) + 1
        if len(ends) == len(line):
            put(line, ids, ends)
        else:
            rest += line
    for line, e, ids in lines(rest, tokenizer.encode_batch):
        first = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
        put(line, ids, np.searchsorted(first, np.cumsum([len(texts[i]) + 1 for i in line])))
    at = np.empty(len(texts), np.int64)
    at[done] = np.arange(len(texts))
    buffers = [None, pa.py_buffer(4 * np.cumsum(np.concatenate(sizes))), pa.py_buffer(np.concatenate(found))]
    return pa.Array.from_buffers(pa.large_binary(), len(texts), buffers).take(pa.array(at))


#: Bytes that a worker spends on pieces it remembers, beyond which it starts anew, and
#: what a piece takes besides its characters and ids (hash tables, while texts
#: are encoded).
KNOWN_BYTES = 32 << 20
PIECE_BYTES = 48
#: Bytes of text that are cut into pieces at a time, and that are told apart at
#: a time (whole texts beyond that): the remembered pieces are hashed once each.
CUT_BYTES = 1 << 20
GROUP_BYTES = 2 << 20


class Encoder:
    """Encodes texts piece by piece; a piece goes through the tokenizers library
    once, until the remembered ones take ``KNOWN_BYTES``. Pieces have numbers:
    piece k is ``pieces[k]``, and its ids are ``found[k]``."""

    def __init__(self, path: str):
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.pieces, self.found, self.n_bytes = pa.array([], pa.binary()), pa.array([], pa.large_binary()), 0

    @property
    def known(self) -> list[bytes]:
        return self.pieces.to_pylist()

    def _learn(self, pieces: pa.Array) -> None:
        """Remember ``pieces``: those known, and new ones after them."""
        new = [c.decode("utf-8", "replace") for c in pieces[len(self.pieces):].to_pylist()]
        self.pieces, self.found = pieces, pa.concat_arrays([self.found, _encode(*_tokenizer(self.path), new)])
        self.n_bytes = pieces.nbytes + self.found.nbytes + PIECE_BYTES * len(pieces)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (without end ids), and how many each has."""
        if not texts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        n = len(self.pieces)
        group = np.cumsum([len(t) for t in texts]) // CUT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        pieces, counts = zip(*[pieces_of(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], strict=True)
        pieces = pa.concat_arrays([self.pieces, *pieces])
        coded = pieces.dictionary_encode()
        del pieces
        pa.default_memory_pool().release_unused()  # of hash tables
        if len(coded.dictionary) > n:
            self._learn(coded.dictionary)
        taken = self.found.take(coded.indices[n:])
        if self.n_bytes > KNOWN_BYTES:
            self._clear()
        _, offsets, held = taken.buffers()
        stops = np.frombuffer(offsets, np.int64, len(taken) + 1)[np.cumsum([0, *np.concatenate(counts).tolist()])] // 4
        return np.frombuffer(held, "<u4", int(stops[-1])) if stops[-1] else np.empty(0, "<u4"), np.diff(stops)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this process: the tasks of a worker, one after the other,
    share the pieces it remembers."""
    return Encoder(path)


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """Ids of each text (without the end id) as little-endian unsigned 32-bit."""
    ids, sizes = Encoder(path).encode(texts)
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 1)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of ``batches`` in order, about ``GROUP_BYTES`` of text at a time."""
    group, n = [], 0
    for some in slices(batches, "text"):
        group.append(some)
        n += some.column("text").nbytes
        if n >= GROUP_BYTES:
            yield group
            group, n = [], 0
    if group:
        yield group


def _shards(path: str, end_id: int, shard_tokens: int):
    def shard(part: int, seq: int, doc_ids: list[np.ndarray], sizes: list[np.ndarray], ids: list[np.ndarray]) -> dict:
        doc_ids = np.concatenate(doc_ids)
        m = WaveletMatrix.build(np.concatenate(ids))
        return {
            "first_doc": int(doc_ids[0]), "part": part, "seq": seq, "n_tokens": m.n, "doc_ids": _pack(doc_ids.astype("<i8")),
            "doc_sizes": _pack(np.concatenate(sizes).astype("<i8")), "alphabet": _pack(m.alphabet.astype("<u4")), "zeros": m.zeros,
            "planes": [_pack(p) for p in m.planes], "ranks": [_pack(r.astype("<u4")) for r in m.ranks]}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, held = _encoder(path), None, 0, 0
        doc_ids, sizes, ids = [], [], []
        names = ["first_doc", "part", "seq", "n_tokens", "doc_ids", "doc_sizes", "alphabet", "zeros", "planes", "ranks"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for group in _groups(batches):
            part = group[0].column("part")[0].as_py()
            found, n = encoder.encode([t for some in group for t in as_bytes(some.column("text"))])
            docs = np.concatenate([some.column("doc_id").to_numpy(zero_copy_only=False) for some in group])
            found = np.insert(found, np.cumsum(n), end_id)
            n = n + 1
            # Whole documents up to the one that fills the shard, again and again.
            a, stops = 0, np.cumsum(n)
            while a < len(n):
                before = int(stops[a - 1]) if a else 0
                b = min(len(n), int(np.searchsorted(stops, before + shard_tokens - held)) + 1)
                doc_ids.append(docs[a:b])
                sizes.append(n[a:b])
                ids.append(found[before:stops[b - 1]])
                held += int(stops[b - 1]) - before
                a = b
                if held >= shard_tokens:
                    yield pa.RecordBatch.from_pylist([shard(part, seq, doc_ids, sizes, ids)], schema=schema)
                    seq, held, doc_ids, sizes, ids = seq + 1, 0, [], [], []
        if doc_ids:
            yield pa.RecordBatch.from_pylist([shard(part, seq, doc_ids, sizes, ids)], schema=schema)
        del doc_ids, sizes, ids
        release_memory()

    return run


def matrix(row: dict) -> WaveletMatrix:
    """The wavelet matrix of a shard's row."""
    unpack = zstandard.decompress
    return WaveletMatrix(
        row["n_tokens"], np.frombuffer(unpack(row["alphabet"]), "<u4"), list(row["zeros"]),
        [np.frombuffer(unpack(p), np.uint8) for p in row["planes"]], [np.frombuffer(unpack(r), "<u4") for r in row["ranks"]])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                 partitions: int | None = None) -> None:
    """Write the ids of all of ``docs`` to a new folder ``path``.

    A range exchange puts documents in ascending order of doc_id (where rows
    repeat one, of a hash of the text) into partitions of bounded size; a
    partition writes one or more shards. Null texts are empty and hold the end id alone. Rows
    without doc_id are left out: they have no place in the order.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    if partitions is None:
        chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(1, -(-chars // PART_CHARS))
    ranged = rows.repartitionByRange(int(partitions), "doc_id", "tie") if partitions > 1 else rows.coalesce(1)
    ranged = ranged.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    ranged.mapInArrow(_shards(tokenizer, end_id, shard_tokens), SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards:
    the ids of all documents before it, its own (end id counted) and the CRC-32
    of its ids as little-endian unsigned 32-bit integers."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    # One row a shard: numbers of tokens before each, in order.
    order = W.orderBy("first_doc", "part", "seq").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("first_doc", "part", "seq", "n_tokens") \
        .select("part", "seq", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = matrix(row).decode().astype("<u4")
                doc_ids, sizes = np.frombuffer(zstandard.decompress(row["doc_ids"]), "<i8"), np.frombuffer(zstandard.decompress(row["doc_sizes"]), "<i8")
                ends = np.cumsum(sizes)
                whole, cuts = memoryview(ids.tobytes()), [0, *(4 * ends).tolist()]
                crcs = [zlib.crc32(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)), pa.array(doc_ids), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` to a new folder of shards under the shared checkpoint
    folder and read the documents back from it."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id, shard_tokens)
    return read_documents(spark, path)
