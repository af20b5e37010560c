"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut into pre-tokens over arrays: a table gives the class of every code
point (letter, number, white space, other), and the splitting pattern's rules are
comparisons of neighbouring classes.  Two tiers turn a pre-token into ids.  A
minimal perfect hash over the vocabulary resolves pre-tokens that are a token as
they stand: the bytes of a pre-token are one or two 64-bit words, which are
hashed, looked up and compared with the token's own bytes.  The others are merged
from single bytes, held as a linked list, with a heap of adjacent pairs ordered by
(rank, place); results are kept in a cache of fixed size, looked up like the hash.

The vocabulary and its hash are of fixed size and are sent with the tasks.  Texts
are worked through in chunks of a quarter of a megabyte, so a worker's memory
follows the longest text.

Defined results: a null text is empty; an empty text has no ids; texts equal byte
for byte give equal ids; decoding gives back every byte.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

CHUNK = 1 << 18
NO_ID = -1
#: Bytes that two words hold; longer tokens are compared as byte strings.
WORDS = 16
SPACE, LETTER, NUMBER, OTHER, END = range(5)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def read_json(path: str) -> tuple[dict[bytes, int], dict[int, int], dict[str, int]]:
    """Token bytes to id, the merges (as in :func:`merge_table`) and added tokens to id, of a byte-level BPE in a ``tokenizers`` JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as themselves
    byte_of, n = {chr(b): b for b in printable}, 0
    for b in range(256):
        if b not in printable:
            byte_of[chr(256 + n)] = b
            n += 1
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    vocabulary = spec["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError("ids do not follow the order of the merges")
    pairs = {vocabulary[a] << 32 | vocabulary[b]: i for (a, b), i in zip(merges, made, strict=True)}
    return ranks, pairs, added


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point under the splitting pattern, as the regular expressions of the tiktoken library see it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for name, form in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        # An encoding whose tokens are bytes leaves out what its pattern does not match.
        probe = tiktoken.Encoding(f"probe-{name}", pat_str=form, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = name
    return out


def _boundaries(points: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin, and the class of each character; ``ends`` are the places after each text, which hold a character that counts as none.

    The pattern: contractions ('s 't 're 've 'm 'll 'd); runs of letters, of numbers or of other characters, each with
    one blank before it; white space up to the last before another character; white space.
    """
    kind = table[points]
    kind[ends] = END
    starts = np.empty(len(kind), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts[ends] = True
    # The last white space before another character stands apart; a blank goes with what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & starts)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        starts[quote[single | double] + 1] = False
        starts[quote[single] + 2] = True
        starts[quote[double & ~single] + 3] = True
    return starts, kind


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one displacement per bucket of about four keys.

    A key is its bytes as two 64-bit words and its length, so at most :data:`WORDS` bytes; a slot keeps
    all three and the value, and a string that is no key differs from what its slot keeps.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        lengths = np.fromiter(map(len, keys), np.int64, n)
        pair = np.frombuffer(b"".join(k.ljust(WORDS, b"\0") for k in keys), "<u8").reshape(n, 2)
        hashes = self.hashed(pair[:, 0], pair[:, 1], lengths)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys share a 64-bit hash")
        self.n, self.r = n, max(1, n // 4)
        bucket = self._spread(hashes, self.r)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(bucket.tolist()):
            groups.setdefault(b, []).append(i)
        self.shift = np.zeros(self.r, np.int64)
        owner = np.full(n, -1, np.int64)
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                break
            own, d, block = hashes[members], 0, 8
            while True:  # many displacements at once
                slots = self._spread(mix(own[None, :] + np.arange(d, d + block, dtype=np.uint64)[:, None]), n)
                ok = (owner[slots] < 0).all(axis=1)
                for i in range(len(members) - 1):
                    ok &= (slots[:, i + 1 :] != slots[:, i : i + 1]).all(axis=1)
                if ok.any():
                    break
                d, block = d + block, min(4096, 2 * block)
            d += int(ok.argmax())
            slots = slots[ok.argmax()]
            owner[slots] = members
            self.shift[b] = d
        free = iter(np.flatnonzero(owner < 0).tolist())
        for b, members in groups.items():
            if len(members) == 1:  # a bucket of one key names its slot
                slot = next(free)
                owner[slot] = members[0]
                self.shift[b] = -1 - slot
        self.first, self.second = pair[owner, 0], pair[owner, 1]
        self.lengths, self.values = lengths[owner], np.asarray(values, np.int32)[owner]

    @staticmethod
    def hashed(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix(first + second * np.uint64(0xC2B2AE3D27D4EB4F) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @staticmethod
    def _spread(hashes: np.ndarray, n: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The value of each key; ``NO_ID`` for what is no key."""
        if not self.n:
            return np.full(len(lengths), NO_ID, np.int32)
        hashes = self.hashed(first, second, lengths)
        d = self.shift[self._spread(hashes, self.r)]
        slot = self._spread(mix(hashes + d.astype(np.uint64)), self.n)
        slot = np.where(d < 0, -1 - d, slot)
        same = (self.first[slot] == first) & (self.second[slot] == second) & (self.lengths[slot] == lengths)
        return np.where(same, self.values[slot], NO_ID)


def merged(piece: bytes, single: list[int], pairs: dict[int, int]) -> list[int]:
    """BPE of ``piece``: always the adjacent pair of lowest rank, the leftmost of equals.

    ``single`` has the id of each byte, ``pairs`` the id (its rank) that two ids merge into, by ``first << 32 | second``.
    """
    n = len(piece)
    ids, after, before = [single[b] for b in piece], list(range(1, n + 1)), list(range(-1, n))  # linked parts, each named by its first byte
    heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := pairs.get(a << 32 | b)) is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        r, i = top >> 32, top & 0xFFFFFFFF
        j = after[i]
        if j >= n or ids[i] < 0 or pairs.get(ids[i] << 32 | ids[j]) != r:
            continue  # one of the two parts has changed since
        ids[i], ids[j] = r, -1
        after[i] = end = after[j]
        if end < n:
            before[end] = i
            if (x := pairs.get(r << 32 | ids[end])) is not None:
                heapq.heappush(heap, x << 32 | i)
        if (p := before[i]) >= 0 and (x := pairs.get(ids[p] << 32 | r)) is not None:
            heapq.heappush(heap, x << 32 | p)
    return [i for i in ids if i >= 0]


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """The id that two adjacent ids merge into: every way to cut a token into two tokens."""
    out = {}
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                out[a << 32 | b] = r
    return out


class Kept:
    """A bounded cache of merged pre-tokens, looked up by arrays: each has one slot, the last one to come keeps it.

    Holds pre-tokens of at most :data:`WORDS` bytes and ``width`` ids; bytes are compared.
    """

    def __init__(self, bits: int = 20, width: int = 8):
        size = 1 << bits
        self.shift, self.width = np.uint64(64 - bits), width
        self.first, self.second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length, self.count = np.zeros(size, np.int8), np.zeros(size, np.int8)
        self.ids = np.zeros((size, width), np.int32)

    def find(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each pre-token, -1 where it is not kept."""
        slot = (PerfectHash.hashed(first, second, length) >> self.shift).astype(np.int64)
        same = (self.first[slot] == first) & (self.second[slot] == second) & (self.length[slot] == length)
        return np.where(same, slot, -1)

    def put(self, pieces: list[bytes], ids: list[list[int]]) -> None:
        fit = [k for k, p in enumerate(pieces) if len(p) <= WORDS and len(ids[k]) <= self.width]
        if not fit:
            return
        pair = np.frombuffer(b"".join(pieces[k].ljust(WORDS, b"\0") for k in fit), "<u8").reshape(-1, 2)
        length = np.fromiter((len(pieces[k]) for k in fit), np.int64, len(fit))
        slot = (PerfectHash.hashed(pair[:, 0], pair[:, 1], length) >> self.shift).astype(np.int64)
        _, last = np.unique(slot[::-1], return_index=True)
        last = len(slot) - 1 - last
        slot, pair, length = slot[last], pair[last], length[last]
        self.first[slot], self.second[slot], self.length[slot] = pair[:, 0], pair[:, 1], length
        rows = [ids[fit[k]] for k in last.tolist()]
        self.count[slot] = [len(r) for r in rows]
        self.ids[slot] = [r + [0] * (self.width - len(r)) for r in rows]


class Codec:
    """Encoder and decoder over one vocabulary, with the splitting pattern of :func:`_boundaries`.

    ``added`` tokens are found in a text before anything else, the longest first where several begin at one place.
    """

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int] | None = None, added: dict[str, int] | None = None):
        self.ranks, self.added, self.table = ranks, added or {}, classes()
        short = [t for t in ranks if len(t) <= WORDS]
        self.hash = PerfectHash(short, [ranks[t] for t in short])
        self.tokens: list[bytes | None] = [None] * (max([*ranks.values(), *self.added.values()], default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.single = [ranks.get(bytes([b]), 0) for b in range(256)]
        self.pairs = merge_table(ranks) if pairs is None else pairs
        self._kept: Kept | None = None

    def __getstate__(self):
        return self.__dict__ | {"_kept": None}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.added or not any(token in t for t in texts for token in self.added):
            return self._encode(texts) if texts else []
        cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        parts, marks, upto = [], [], [0]
        for t in texts:
            at = 0
            for m in cut.finditer(t):
                parts.append(t[at : m.start()])
                marks.append([self.added[m.group()]])
                at = m.end()
            parts.append(t[at:])
            marks.append([])
            upto.append(len(parts))
        ids = self._encode(parts)
        return [np.concatenate([x for p in range(a, b) for x in (ids[p], np.array(marks[p], np.int32))]) for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = "\0".join(texts) + "\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts, kind = _boundaries(np.frombuffer(whole.encode("utf-32-le"), "<u4"), ends, self.table)
        at = np.flatnonzero(starts)
        upto = np.searchsorted(at, ends)  # the mark after each text begins a pre-token
        raw = whole.encode()
        begin = at if len(raw) == len(whole) else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[at]
        length = np.diff(np.append(begin, len(raw)))
        real = kind[at] != END
        begin, length = begin[real], length[real]
        bounds = np.append(0, upto - np.arange(len(upto)))  # without the marks
        first, second = self._words(raw, begin, length)
        ids = np.where(length <= WORDS, self.hash.find(first, second, length), NO_ID)
        size, misses = np.ones(len(ids), np.int64), np.flatnonzero(ids == NO_ID)
        if self._kept is None:
            self._kept = Kept()
        slot = self._kept.find(first[misses], second[misses], length[misses])
        known, slot, misses = misses[slot >= 0], slot[slot >= 0], misses[slot < 0]
        size[known] = self._kept.count[slot]
        pieces = [raw[a : a + n] for a, n in zip(begin[misses].tolist(), length[misses].tolist(), strict=True)]
        distinct = list(dict.fromkeys(pieces))
        new = dict(zip(distinct, self.split(distinct), strict=True))
        found = [new[piece] for piece in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        size[misses] = lengths
        stop = np.cumsum(size)
        out = np.repeat(ids, size)
        place, count = stop[known] - size[known], size[known]
        for k in range(self._kept.width):
            more = count > k
            out[place[more] + k] = self._kept.ids[slot[more], k]
        if found:
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
            out[np.repeat(stop[misses] - np.cumsum(lengths), lengths) + np.arange(len(flat))] = flat
            self._kept.put(list(new), list(new.values()))
        where = np.append(0, stop)[bounds]
        return [out[a:b] for a, b in zip(where[:-1], where[1:], strict=True)]

    def split(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token that the hash of short tokens does not hold."""
        token = self.ranks.get
        return [merged(p, self.single, self.pairs) if len(p) <= WORDS or (i := token(p)) is None else [i] for p in pieces]

    @staticmethod
    def _words(raw: bytes, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first eight bytes of each pre-token and the eight after them, as 64-bit words."""
        ahead = np.ndarray((len(raw) + 8,), "<u8", raw + bytes(2 * WORDS), strides=(1,))  # eight bytes from each place
        first = ahead[begin] & _MASK[np.minimum(length, 8)]
        second = np.zeros(len(begin), np.uint64)
        more = np.flatnonzero(length > 8)
        second[more] = ahead[begin[more] + 8] & _MASK[np.minimum(length[more] - 8, 8)]
        return first, second

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; ``pattern`` has to be the one that :func:`_boundaries` follows."""
    if pattern != PATTERN:
        raise ValueError("another splitting pattern than the one built in")
    return Codec(read_ranks(path))


@lru_cache(maxsize=4)
def json_codec(path: str) -> Codec:
    return Codec(*read_json(path))


# The splitting pattern that the rank files go with; fixed.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def chunks(values: list, size: int = CHUNK):
    """(from, to) of runs of about ``size`` characters."""
    first, n = 0, 0
    for k, v in enumerate(values):
        if n and n + len(v) > size:
            yield first, k
            first, n = k, 0
        n += len(v)
    if first < len(values):
        yield first, len(values)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Columns ``id``, ``ids`` (array of int) and, with ``decode``, ``decoded`` (the bytes that the ids stand for)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(codec(path, pattern))  # as large as the vocabulary
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        tool = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids = tool.encode_all(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))]
                names = ["id", "ids"]
                if decode:
                    columns.append(pa.array([tool.decode(x.tolist()) for x in ids], pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {id_type}, ids array<int>" + ", decoded binary" * decode)


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Columns ``id`` and ``decoded``: the bytes of each array of ids; null ids give no bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(codec(path, pattern))
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        tool = shared.value
        for batch in batches:
            out = [tool.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary")
