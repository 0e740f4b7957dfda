"""Cross-tokenizer alignment by an associative monoid of fragments (operator 12).

A text is encoded by two tokenizers, A over a space and the text, B (which adds
that space itself) over the text. Byte offsets where tokens of both end cut the
tokens into groups; tokens whose byte ranges overlap are links.

Both tokenizers are known to end a token before a *cut*: a space or line feed
between two characters that are not white space, or a full stop or comma between
a letter and one of those. The bytes between two cuts, a
chunk, can therefore be encoded and aligned by themselves, and equal chunks are
aligned once until a task knows too many.

Fragments. Any range of a text's bytes, cut anywhere, is a fragment:

* open: it holds no cut, only bytes;
* closed: the bytes before its first cut (open prefix), the summary of all
  groups between its first and last cut (closed groups: numbers, ids in order,
  links), and the bytes from its last cut on (open suffix).

``compose`` joins two neighbours: the left one's suffix and the right one's
prefix together hold whole chunks, which are aligned then. What a fragment is
depends on its bytes alone, so composing is associative, and the open fragment
without bytes is neutral. Texts of more than ``PART_BYTES`` are dealt by byte
range over Spark tasks and their fragments are composed in a tree, ``FANOUT`` at
a time; shorter ones are aligned where they are read.

Corpus counts. A block of some thousand texts holds for each text its distinct
links (an id pair and how often). Each block sends one row for each of its id
pairs, with the number of its texts that hold it; sums over blocks are the
counts; a second shuffle by block takes them back. So a pair costs one row a
block, however many texts hold it.

Results in odd cases. A null or empty text, and one that either tokenizer does
not give back byte by byte, has no tokens: numbers are zero and the digest is
empty. Rows are taken one by one: repeated rows each give a row and count as a
text each; a null doc_id stays null. Columns beyond doc_id and text are ignored.
An empty table gives no rows. A run of bytes without any cut is one chunk and is
encoded in one task, however long.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, release_memory, shared_path, slices

PART_BYTES = 1 << 16
FANOUT = 8
#: Text that a block holds.
BLOCK_BYTES = 3 << 20
#: Chunks that are encoded as one text, and the length of a chunk that is
#: encoded by itself.
LINE_CHUNKS = 100
LONG_CHUNK = 1000
#: Chunks that a task remembers before it starts anew (some 50 MB).
KNOWN_CHUNKS = 120_000
# Fixed value: how byte-level BPE cuts a text before its merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BLOCK = "block long, pairs array<long>, holders array<int>, payload binary"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_FRAGMENT = "text long, doc_id long, place long, value binary"


# --- Tokens ---------------------------------------------------------------


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes in order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoders:
    """Both tokenizers, the bytes of all their tokens and their sizes.

    Where the file of A is byte-level BPE whose ids follow its merges, its
    vocabulary as ranks gives the same ids several times faster; runs of more than
    ``LONG_CHUNK`` bytes without a cut still go through the file's own merges,
    whose cost grows less with their length.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbol = _byte_of_symbol()
        vocabulary = self.a.get_vocab()
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if wrong := [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and ("\n" in p or "▁" in p.lstrip("▁") or re.search("[A-Za-z][.,]", p))]:
            raise ValueError(f"pieces reach across a cut: {wrong[:5]}")
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = bytes_a, bytes_b
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in self.bytes]
        self.lead = [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        self.ranks = self._ranks(path_a, vocabulary, bytes_a)

    @staticmethod
    def _ranks(path_a: str, vocabulary: dict[str, int], bytes_a: list[bytes]):
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            held = json.load(f)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in held["model"]["merges"]]
        first = held["pre_tokenizer"]
        special = {t["content"] for t in held["added_tokens"]}
        if (held["normalizer"] or first["type"] != "ByteLevel" or not first.get("use_regex", True) or first["add_prefix_space"]
                or [vocabulary[m] for m in merges] != list(range(256, 256 + len(merges)))):
            return None
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks={bytes_a[i]: i for t, i in vocabulary.items() if t not in special}, special_tokens={})

    def encode(self, texts: list[str], ranks: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of every text. B puts a space before a text; where the
        text has none of its own, it comes after a line feed, and both are dropped."""
        if ranks and self.ranks:
            found_a = map(self.ranks.encode_ordinary, texts)
        else:
            found_a = (e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False))
        spaced = [t[0] == " " for t in texts]
        found_b = self.b.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
        for is_spaced, ids_a, ids_b in zip(spaced, found_a, found_b, strict=True):
            if not is_spaced:
                ids_b = ids_b[2:] if ids_b[:2] == self.lead else []
            yield np.array(ids_a, np.int64), np.array(ids_b, np.int64)


@lru_cache(maxsize=1)
def _encoders(path_a: str, path_b: str) -> Encoders:
    return Encoders(path_a, path_b)


@lru_cache(maxsize=1)
def _words(n: int) -> list[bytes]:
    """Every id below ``n`` in decimal, followed by a comma, a bar or a semicolon."""
    return [b"%d%c" % (i, c) for i in range(n) for c in b",|;"]


@dataclass
class Summary:
    """All groups of a run of chunks: numbers, ids in order and links. A run
    that a tokenizer does not give back is not ``sound``."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: list[bytes] = field(default_factory=list)
    links: dict[int, int] = field(default_factory=dict)
    sound: bool = True

    def plus(self, other: Summary) -> Summary:
        links = dict(self.links)
        for pair, n in other.links.items():
            links[pair] = links.get(pair, 0) + n
        return Summary(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.groups + other.groups, links, self.sound and other.sound)


@dataclass
class Chunks:
    """Aligned chunks in columns: for each its numbers of tokens, groups and
    links, its ids in order (every group ends in a semicolon) and its links, those
    of chunk k from ``first[k]`` on in ``pairs`` (a pair may stand there
    repeatedly)."""

    numbers: np.ndarray  # n_a, n_b, n_groups, n_links
    sound: np.ndarray
    groups: list[bytes]
    first: np.ndarray
    pairs: np.ndarray

    def plus(self, more: Chunks) -> Chunks:
        return Chunks(*(np.concatenate([x, y]) for x, y in ((self.numbers, more.numbers), (self.sound, more.sound))), self.groups + more.groups,
                      np.r_[self.first, more.first + len(self.pairs)], np.concatenate([self.pairs, more.pairs]))

    def summary(self, at: np.ndarray) -> Summary:
        """Summary of the chunks ``at``, in order."""
        n = self.numbers[at].sum(axis=0).tolist()
        pairs, times = np.unique(np.concatenate([self.pairs[self.first[k]:self.first[k] + self.numbers[k, 3]] for k in at]), return_counts=True)
        links = dict(zip(pairs.tolist(), times.tolist(), strict=True))
        return Summary(n[0], n[1], n[2], [self.groups[k] for k in at], links, bool(self.sound[at].all()))


class Aligner:
    """Encodes and aligns distinct chunks, many at a time, and remembers some.

    Chunks that begin and end at cuts are encoded in lines of many, which both
    tokenizers treat as they treat each of them; a token belongs to the chunk
    that its bytes lie in. Other chunks (with white space at an end, or a
    character that B replaces) are encoded one by one.
    """

    def __init__(self, path_a: str, path_b: str):
        self.paths = path_a, path_b
        self.known: dict[bytes, int] = {}
        self.columns: Chunks | None = None

    def look_up(self, chunks: list[bytes]) -> tuple[Chunks, np.ndarray]:
        """Chunks known so far, among them all ``chunks``, and the place of each.
        When many are known, the next call starts anew."""
        if len(self.known) > KNOWN_CHUNKS:
            self.known, self.columns = {}, None
        new = [c for c in set(chunks) if c not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            more = self.align(new)
            self.columns = more if self.columns is None else self.columns.plus(more)
        return self.columns, np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def _tokens(self, chunks: list[bytes]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """An order of the chunks; in that order the ids of all by A and by B, and
        how many each chunk has by either, -1 where it is not given back."""
        encoders = _encoders(*self.paths)
        ids, counts = ([np.empty(0, np.int64)], [np.empty(0, np.int64)]), ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        starts = np.cumsum([0, *map(len, chunks)])
        joined = np.frombuffer(b"".join(chunks), np.uint8)
        good = np.zeros(len(joined) + 1, bool)
        good[cuts(joined)] = True
        good = good[starts]
        good[-1] = len(chunks) > 0 and bool(chunks[-1][-1:].isalnum())
        plain = [k for k in np.flatnonzero(good[:-1] & good[1:]).tolist() 
                 if chunks[k][0] in b" \n" and len(chunks[k]) <= LONG_CHUNK and b"\xe2\x96\x81" not in chunks[k]]
        lines = [plain[x:x + LINE_CHUNKS] for x in range(0, len(plain), LINE_CHUNKS)]
        found = list(encoders.encode([b"".join([chunks[k] for k in line]).decode("utf-8", "replace") for line in lines], ranks=True))
        raw, ends = b"".join([chunks[k] for k in plain]), np.cumsum([len(chunks[k]) for k in plain], dtype=np.int64)
        for k in (0, 1) if plain else ():
            which = np.concatenate([x[k] for x in found])
            stops = np.cumsum(encoders.sizes[k][which])
            at = np.searchsorted(stops, ends) + 1
            if b"".join(map(encoders.bytes[k].__getitem__, which.tolist())) != raw or not np.array_equal(stops[at - 1], ends):
                plain, ids, counts = [], ([np.empty(0, np.int64)], [np.empty(0, np.int64)]), ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
                break  # something is not given back: chunk by chunk
            ids[k].append(which)
            counts[k].append(np.diff(at, prepend=0))
        order = list(plain)
        others = sorted(set(range(len(chunks))).difference(plain))
        for k, found in zip(others, encoders.encode([chunks[k].decode("utf-8", "replace") for k in others], ranks=False), strict=True):
            same = all(b"".join([pieces[i] for i in which.tolist()]) == chunks[k] for which, pieces in zip(found, encoders.bytes, strict=True))
            order.append(k)
            for out, n, which in zip(ids, counts, found, strict=True):
                out.append(which[:len(which) * same])
                n.append(np.array([len(which) if same else -1]))
        return order, [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts]

    def align(self, chunks: list[bytes]) -> Chunks:
        """All ``chunks``, which are not empty, at once.

        With the tokens of all chunks laid end to end, the places where tokens of
        both end close groups, and the range between two neighbouring ends of
        either lies in one token of each: it is a link.
        """
        sizes = _encoders(*self.paths).sizes
        dealt, (ids_a, ids_b), counts = self._tokens(chunks)
        sound = counts[0] >= 0
        counts = np.maximum(counts[0], 0), np.maximum(counts[1], 0)
        end_a, end_b = (np.cumsum(size[i]) for size, i in zip(sizes, (ids_a, ids_b), strict=True))
        either = np.sort(np.r_[end_a, end_b], kind="stable")
        both, either = either[1:][either[1:] == either[:-1]], either[np.r_[True, either[1:] != either[:-1]][:len(either)]]
        stops = np.cumsum(np.where(sound, [len(chunks[k]) for k in dealt], 0)) if chunks else np.empty(0, np.int64)
        pairs = ids_a[np.searchsorted(end_a, either)] << 32 | ids_b[np.searchsorted(end_b, either)]
        first = np.r_[0, np.searchsorted(either, stops, side="right")]
        closed = np.r_[0, np.searchsorted(both, stops, side="right")]
        numbers = np.stack([counts[0], counts[1], np.diff(closed), np.diff(first)], axis=1)
        # Ids of a group: those of A, then those of B, each with what follows it.
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = (np.r_[g[1:] != g[:-1], True][:len(g)] for g in (group_a, group_b))
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        after = np.r_[np.where(last_a, 1, 0), np.where(last_b, 2, 0)]
        words = _words(max(map(len, sizes)))
        written = [words[k] for k in (np.r_[ids_a, ids_b] * 3 + after)[order].tolist()]
        cut = np.r_[0, np.cumsum(counts[0] + counts[1])].tolist()
        groups = [b"".join(written[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
        back = np.argsort(dealt)
        return Chunks(numbers[back], sound[back], [groups[k] for k in back.tolist()], first[back], pairs)

    def run(self, chunks: list[bytes]) -> Summary:
        """Summary of chunks in order."""
        return self.look_up(chunks)[0].summary(self.look_up(chunks)[1]) if chunks else Summary()


# --- Cuts and fragments ---------------------------------------------------


#: Bytes that are white space or may begin or end a character that is.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_BLANK_LEAD = _BLANK.copy()
_BLANK_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (string.ascii_letters.encode(), b".,"))


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places of ``raw`` (bytes) that are cuts by what ``raw`` itself shows: a
    space or line feed, before it the end of a character, after it the start of
    one, neither of them white space; or a mark of punctuation between an ASCII
    letter and a space or line feed."""
    mark = np.flatnonzero(_MARK[raw])
    mark = mark[(mark > 0) & (mark < len(raw) - 1)]
    mark = mark[_LETTER[raw[mark - 1]] & ((raw[mark + 1] == 0x20) | (raw[mark + 1] == 0x0A))]
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[(at > 0) & (at < len(raw) - 1)]
    at = at[~_BLANK_LEAD[raw[at + 1]] & ~_BLANK[raw[at - 1]]]
    # After a character of several bytes, its first byte tells whether it may be
    # white space; if that byte is not here, the place is no cut yet.
    before = [np.where(at >= k, raw[np.maximum(at - k, 0)], 0) for k in (1, 2, 3, 4)]
    rest = [(x >= 0x80) & (x < 0xC0) for x in before]
    two = (before[1] > 0xC2) & (before[1] < 0xE0)
    three = rest[1] & ((before[2] == 0xE0) | (before[2] > 0xE3) & (before[2] < 0xF0))
    four = rest[1] & rest[2] & (before[3] >= 0xF0)
    at = at[(before[0] < 0x80) | rest[0] & (two | three | four)]
    return np.sort(np.r_[at, mark])


def _split(raw: bytes) -> list[bytes]:
    """``raw`` cut at all its cuts; the first part has what is before the first."""
    at = [0, *cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


@dataclass
class Fragment:
    """Bytes without a cut (``body`` is None, all in ``prefix``), or open prefix,
    closed groups and open suffix."""

    prefix: bytes = b""
    body: Summary | None = None
    suffix: bytes = b""


def fragment(raw: bytes, aligner: Aligner) -> Fragment:
    """The fragment of a range of bytes."""
    prefix, *rest = _split(raw)
    return Fragment(prefix, aligner.run(rest[:-1]), rest[-1]) if rest else Fragment(prefix)


def compose(x: Fragment, y: Fragment, aligner: Aligner) -> Fragment:
    """The fragment of the bytes of ``x`` followed by those of ``y``."""
    if x.body is None and y.body is None:
        return fragment(x.prefix + y.prefix, aligner)
    head, *middle = _split((x.prefix if x.body is None else x.suffix) + y.prefix)
    if x.body is None:
        return Fragment(head, aligner.run(middle).plus(y.body), y.suffix)
    chunks = [head, *middle]  # the suffix begins at a cut
    if y.body is None:
        return Fragment(x.prefix, x.body.plus(aligner.run(chunks[:-1])), chunks[-1])
    return Fragment(x.prefix, x.body.plus(aligner.run(chunks)).plus(y.body), y.suffix)


def close(x: Fragment, aligner: Aligner) -> Summary:
    """Summary of a whole text (with its space before it)."""
    if x.body is None:
        return aligner.run([x.prefix])
    return aligner.run([x.prefix]).plus(x.body).plus(aligner.run([x.suffix]))


# --- Blocks ---------------------------------------------------------------


def _pack(value: object) -> bytes:
    return zstandard.compress(pickle.dumps(value, protocol=5), 1)


def _unpack(value: bytes):
    return pickle.loads(zstandard.decompress(value))


def _block(number: int, doc_ids: list, numbers: np.ndarray, digests: list[str], doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row: a block of texts with entries (text, pair, times), in which a
    text may hold a pair several times."""
    pairs = np.sort(pair)
    pairs = pairs[np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][:len(pairs)])]
    key = doc.astype(np.int64) * max(1, len(pairs)) + np.searchsorted(pairs, pair)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    times = np.add.reduceat(times[order], first) if len(key) else np.empty(0, np.int64)
    doc, place = np.divmod(key[first], max(1, len(pairs)))
    holders = np.bincount(place, minlength=len(pairs)).astype(np.int32)
    payload = _pack((doc_ids, numbers, digests, pairs, doc.astype(np.int32), place.astype(np.int32), times.astype(np.int64)))
    kind = pa.schema([("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())), ("payload", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pairs], kind.field(1).type), pa.array([holders], kind.field(2).type), pa.array([payload], pa.binary())], schema=kind)


def digest(groups: list[bytes]) -> str:
    """SHA-256 of groups that each end in a semicolon, without the last one."""
    return hashlib.sha256(b"".join(groups)[:-1]).hexdigest()


def _block_number(source: int, n: int) -> int:
    return source << 60 | TaskContext.get().partitionId() << 30 | n


def _align_texts(path_a: str, path_b: str):
    """Blocks of texts that are aligned where they are read."""

    def block(number: int, doc_ids: list, texts: list[bytes], aligner: Aligner) -> pa.RecordBatch:
        whole = [i for i, t in enumerate(texts) if t]
        numbers, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        empty = np.empty(0, np.int64)
        if not whole:
            return _block(number, doc_ids, numbers, digests, empty, empty, empty)
        raw = b" " + b" ".join([texts[i] for i in whole])
        starts = np.cumsum([0, *(len(texts[i]) + 1 for i in whole[:-1])])
        # A text begins at the space before it, whatever stands around it.
        at = np.sort(np.r_[cuts(np.frombuffer(raw, np.uint8)), starts])
        at = at[np.r_[True, at[1:] != at[:-1]]]
        begin = np.searchsorted(at, starts)
        edges = [*at.tolist(), len(raw)]
        chunks = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        found, kind = aligner.look_up(chunks)
        sums = np.add.reduceat(np.c_[found.numbers, ~found.sound][kind], begin, axis=0)
        sound = sums[:, 4] == 0
        kind_list, ends = kind.tolist(), [*begin[1:].tolist(), len(chunks)]
        for n, (i, a, b) in enumerate(zip(whole, begin.tolist(), ends, strict=True)):
            if sound[n]:
                numbers[i] = sums[n, :4]
                digests[i] = digest([found.groups[k] for k in kind_list[a:b]])
        # Distinct chunks of each text, then the links of those.
        owner = np.repeat(np.arange(len(whole)), np.diff(np.r_[begin, len(chunks)]))
        key = np.sort(owner * len(found.groups) + kind)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, count = key[first], np.diff(np.r_[first, len(key)])
        owner, kind = np.divmod(key, len(found.groups))
        keep = sound[owner]
        owner, kind, count = owner[keep], kind[keep], count[keep]
        n = found.numbers[kind, 3]
        at = np.repeat(found.first[kind] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return _block(number, doc_ids, numbers, digests, np.repeat(np.array(whole)[owner], n), found.pairs[at], np.repeat(count, n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for n, some in enumerate(slices(batches, "text", BLOCK_BYTES)):
            yield block(_block_number(0, n), some.column("doc_id").to_pylist(), as_bytes(some.column("text")), aligner)
        del aligner
        release_memory()

    return run


def _fragments(path_a: str, path_b: str):
    kind = pa.schema([("text", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, place = row.column("part")[0].as_py(), row.column("place")[0].as_py()
                value = fragment(b" " + part if place == 0 else part, aligner)
                yield pa.RecordBatch.from_arrays([row.column("text"), row.column("doc_id"), row.column("place"), pa.array([_pack(value)], pa.binary())], schema=kind)

    return run


def _composed(path_a: str, path_b: str):
    """Neighbouring fragments of a text, in one."""

    def run(rows: pa.Table) -> pa.Table:
        aligner = Aligner(path_a, path_b)
        rows = rows.sort_by("place")
        out = Fragment()
        for value in rows.column("value"):
            out = compose(out, _unpack(value.as_py()), aligner)
        return pa.table([pa.array([rows.column(c)[0].as_py()], pa.int64()) for c in ("text", "doc_id")]
                        + [pa.array([rows.column("place")[0].as_py() // FANOUT], pa.int64()), pa.array([_pack(out)], pa.binary())], ["text", "doc_id", "place", "value"])

    return run


def _close_texts(path_a: str, path_b: str):
    """Blocks of one text each, from its composed fragment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, n = Aligner(path_a, path_b), 0
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("value"), strict=True):
                s = close(_unpack(value.as_py()), aligner)
                s = s if s.sound else Summary(sound=False)
                pair, times = (np.fromiter(x, np.int64, len(s.links)) for x in (s.links.keys(), s.links.values()))
                yield _block(_block_number(1, n), [doc_id], np.array([[s.n_a, s.n_b, s.n_groups, times.sum()]], np.int64), [digest(s.groups) if s.sound else ""], np.zeros(len(pair), np.int64), pair, times)
                n += 1

    return run


def _results(left: pa.Table, right: pa.Table) -> pa.Table:
    """Texts of one block with the corpus counts of its pairs."""
    doc_ids, numbers, digests, pairs, doc, place, times = _unpack(left.column("payload")[0].as_py())
    pair, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
    at = np.argsort(pair)
    count, best = count[at], best[at].astype(np.int64)
    if not np.array_equal(pair[at], pairs):
        raise ValueError("counts of a block's pairs are missing")
    edges = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
    total = [np.r_[0, np.cumsum(times * x[place])] for x in (best, count)]
    n_best, count_sum = (x[edges[1:]] - x[edges[:-1]] for x in total)
    return pa.table([pa.array(doc_ids, pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(n_best), pa.array(count_sum), pa.array(digests, pa.string())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, path_a: str, path_b: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): ``doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256``; see the module."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > part_bytes, F.lit(False))
    path = shared_path(spark, "aligned-blocks")
    rows.where(~is_long).mapInArrow(_align_texts(path_a, path_b), _BLOCK).write.parquet(path)
    # Parts of a long text; the number that names the text is written with them,
    # so that a repeated task cannot change it for some parts only.
    raw = F.col("text").cast("binary")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / part_bytes).cast("int")),
                        lambda i: F.struct(i.cast("long").alias("place"), F.substring(raw, i * part_bytes + 1, F.lit(part_bytes)).alias("part")))
    part_path = shared_path(spark, "aligned-parts")
    rows.where(is_long).select(F.monotonically_increasing_id().alias("text_id"), "doc_id", parts.alias("parts")) \
        .select(F.col("text_id").alias("text"), "doc_id", F.inline("parts")).write.parquet(part_path)
    pieces = spark.read.parquet(part_path)
    found = pieces.repartition("text", "place").mapInArrow(_fragments(path_a, path_b), _FRAGMENT)
    most = pieces.agg(F.max("place")).first()[0]
    while most:
        found = found.groupBy("text", F.floor(F.col("place") / FANOUT)).applyInArrow(_composed(path_a, path_b), _FRAGMENT)
        most //= FANOUT
    long_path = shared_path(spark, "aligned-long")
    found.mapInArrow(_close_texts(path_a, path_b), _BLOCK).write.parquet(long_path)
    blocks = spark.read.schema(_BLOCK).parquet(path, long_path)
    pairs = blocks.select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("holders").alias("n"))))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    # At most one row a token of A.
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    judged = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = pairs.select("block", "pair").join(judged, "pair").select(F.col("block").alias("of_block"), "pair", "count", "best")
    return blocks.select("block", "payload").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_results, _RESULT)
