"""N-gram Jaccard join: size-aware, with a light and a heavy side.

A text's set is its distinct word shingles; two texts link when
``100 * |A and B| >= percent * |A or B|``, which for sizes a and b asks for an
overlap of ``o(a, b) = ceil(percent * (a + b) / (100 + percent))``.

*Light* sets are those under a boundary size.  Of these all subsets of each size
``o`` that a partner may ask for are enumerated; two light sets link exactly if
they share a subset of the size that their pair asks for.  *Heavy* sets, and light
ones that may have heavy partners, are put in inverted lists of their rarest
shingles: in one common order of shingles, the first
``n - ceil(n * percent / 100) + 1`` of two linked sets must meet.  The boundary is
the size that makes the estimated cost of both sides least: the subsets to
enumerate against the entries that the list scans would meet.

The order puts shingles that many texts share last.  It comes from a count sketch
of fixed size over all texts; sketch errors change the cost of the lists and never
the result.

Copies are one set from the start (a set is named by 128 bits), and lists with the
same sets are one list.  Inside a list, sets pass a size and a position filter and
an upper bound on the overlap from parity bitmaps.  Of the pairs that pass, a list
gives a spanning forest and not all of them, so what leaves a task is linear in
what it reads.  A list of more than ``2 * UNIT`` sets is scanned by pairs of its
parts, each a piece of work of bounded size.

What these forests connect holds every link, and is small.  Inside each such group
the overlaps of all pairs are counted exactly, by products of blocks: of each set
the number of its links is returned, and a spanning forest of the links, which are
joined to components by the large-star and small-star steps, rounds of joins with
group minima, until nothing changes.  Links never leave the cluster.

Defined results: null and empty texts, and texts without words, have no shingles
and link with nothing; fewer words than ``k`` form one shingle; rows with equal
sets are one class; a null id has a component of its own class's smallest id,
null if there is none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.session import durable, release

from .names import fresh
from .shingles import mix, set_key, shingle_sets

BINS = 1 << 20
#: Sets of a part of a long list, entries of a task's lists, and of a list by the sketch before it is dealt to several tasks.
UNIT, ENTRIES, PART = 512, 16384, 100_000
#: Sets and bytes of a part whose links are counted in one task, and shingles of a product there.
TOGETHER, PART_BYTES, COLUMNS = 512, 8 << 20, 4096
#: Sets of more shingles have more subsets to enumerate than their lists could ever cost.
LARGEST_LIGHT = 64
BITMAP_MOST = 32768
BLOOM_MOST = 1 << 27
#: Sketches or bitmaps that one task sums up.
FAN_IN = 32


def overlap_needed(a, b, percent: int):
    """The least overlap of linked sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Subset sizes to enumerate for a light set of size ``n``."""
    return sorted({overlap_needed(n, m, percent) for m in partner_sizes(n, percent) if m < boundary})


def choose_boundary(sizes: dict[int, int], weight: dict[int, float], percent: int) -> int:
    """The boundary of least cost: sets below it are light.

    ``sizes[n]``: sets of size n; ``weight[n]``: estimated entries that their list scans would meet.
    """
    best, best_cost = 0, math.inf
    for x in range(LARGEST_LIGHT + 2):
        cost = 0.0
        for n, sets in sizes.items():
            light = n < x
            if light:
                cost += sets * float(sum(math.comb(n, o) for o in subset_sizes(n, x, percent)))
            if not light or 100 * n // percent >= x:
                cost += sets * prefix_length(n, percent) + weight.get(n, 0.0)
        if cost < best_cost:
            best, best_cost = x, cost
    return best


def parity_bitmap(values: np.ndarray) -> bytes:
    """One bit per class of shingles: whether the set holds an odd number of them."""
    bits = 512
    while bits < BITMAP_MOST and bits < 2 * len(values):
        bits *= 2
    where = ((values >> np.uint64(40)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(where, minlength=bits) & 1).tobytes()


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _folded(bitmap: bytes, width: int) -> np.ndarray:
    """The bitmap of fewer classes: both halves of a bitmap, by exclusive or, until it has ``width`` bytes."""
    a = np.frombuffer(bitmap, np.uint8)
    while len(a) > width:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def may_link(n_a: int, map_a: bytes, n_b: int, map_b: bytes, percent: int) -> bool:
    """False only if the bitmaps show that the overlap is too small: sets differ in at least as many shingles as bits."""
    width = min(len(map_a), len(map_b))
    apart = int(_ONES[_folded(map_a, width) ^ _folded(map_b, width)].sum())
    return (n_a + n_b - apart) // 2 >= overlap_needed(n_a, n_b, percent)


def _bins(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(BINS - 1)).astype(np.int64)


SURVEY = "id mark key name n bitmap few part sketch"


def _name(key: bytes) -> int:
    """The first 64 bits of a set's key, which stand for it in the lists."""
    return int.from_bytes(key[:8], "little", signed=True)


# --- first pass: sets' names, sizes and bitmaps, and the sketch -----------------


def _survey(k: int):
    def run(batches):
        counts = np.zeros(BINS, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            keys, sizes, maps, few = [], [], [], []
            for values in shingle_sets(batch.column(1).to_pylist(), k):
                n = len(values)
                key = set_key(values) if n else None
                keys.append(key)
                sizes.append(n)
                maps.append(parity_bitmap(values) if n else None)
                few.append(values.tobytes() if 0 < n <= LARGEST_LIGHT and key not in seen else None)
                if n and key not in seen:
                    seen.add(key)
                    np.add.at(counts, _bins(values), 1)
            m = batch.num_rows
            names = [None if key is None else _name(key) for key in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(few, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())],
                SURVEY.split(),
            )
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], SURVEY.split())

    return run


def _by_tree(rows: DataFrame, n: int, join) -> bytes | None:
    """What ``join`` makes of the column ``data`` of all rows (``part`` from 0 to ``n - 1``), by a tree of fixed fan-in."""

    def level(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "data": [zlib.compress(join([zlib.decompress(d) for d in pdf["data"]]), 1)]})

    while n > 1:
        rows = rows.groupBy(F.expr(f"part div {FAN_IN}").alias("part")).applyInPandas(level, "part long, data binary")
        n = -(-n // FAN_IN)
    got = rows.collect()
    return zlib.decompress(got[0]["data"]) if got else None


def _sketch(first: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches; one of fixed size comes to the driver."""

    def join(parts: list[bytes]) -> bytes:
        counts = np.zeros(BINS, np.uint32)
        for p in parts:
            counts += np.frombuffer(p, np.uint32)
        return counts.tobytes()

    tasks = first.agg(F.max("part")).first()[0]
    got = _by_tree(first.where(F.col("part").isNotNull()).select("part", F.col("sketch").alias("data")), (tasks or 0) + 1, join)
    return np.frombuffer(got, np.uint32) if got else np.zeros(BINS, np.uint32)


def _ranks(values: np.ndarray, frequency: np.ndarray, noise: float) -> np.ndarray:
    """Estimated counts of shingles; what the sketch cannot tell from chance counts as rare."""
    seen_in = frequency[_bins(values)]
    return np.where(seen_in <= noise, 0, seen_in)


def _noise(frequency: np.ndarray) -> float:
    mean = float(frequency.mean())
    return mean + 6 * math.sqrt(mean)


def _list_costs(first: DataFrame, percent: int, shared) -> tuple[dict[int, int], dict[int, float]]:
    """Of small sets by size: how many there are, and the other entries that their list scans would meet."""

    def run(batches):
        frequency = shared.value
        noise, sets, met = _noise(frequency), Counter(), Counter()
        for pdf in batches:
            for packed in pdf["few"]:
                values = np.frombuffer(packed, np.uint64)
                ranks = np.sort(_ranks(values, frequency, noise))[: prefix_length(len(values), percent)]
                sets[len(values)] += 1
                met[len(values)] += float(np.maximum(ranks.astype(float) - 1, 0).sum())
        yield pd.DataFrame({"n": list(sets), "sets": list(sets.values()), "met": [met[n] for n in sets]})

    rows = first.where(F.col("few").isNotNull()).select("few").mapInPandas(run, "n int, sets long, met double")
    got = rows.groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("met").alias("met")).collect()  # LARGEST_LIGHT rows at most
    return {r["n"]: r["sets"] for r in got}, {r["n"]: r["met"] for r in got}


# --- second pass: subsets and list entries, dealt to buckets ---------------------


def _postings(k: int, percent: int, boundary: int, buckets: int, part: int, shared):
    """Rows (bucket, sub-bucket, packed entries) of list entries; an entry is (token, key, size, place, part)."""

    def run(batches):
        frequency = shared.value
        noise = _noise(frequency)
        seen: set[bytes] = set()
        for batch in batches:
            tokens, names, sizes, places, counts = [], [], [], [], []
            for values in shingle_sets(batch.column(0).to_pylist(), k):
                n = len(values)
                if not n:
                    continue
                full = set_key(values)
                if full in seen:
                    continue
                seen.add(full)
                name = np.frombuffer(full[:8], np.uint64)[0]
                if n < boundary:
                    for o in subset_sizes(n, boundary, percent):
                        salt = np.uint64(int.from_bytes(hashlib.blake2b(b"subset %d" % o, digest_size=8).digest(), "little"))
                        for chosen in combinations(values.tolist(), o):
                            token = mix(np.bitwise_xor.reduce(mix(np.array(chosen, np.uint64) + salt), keepdims=True) + salt)
                            tokens.append(token)
                            names.append(np.array([name]))
                            sizes.append(np.array([n], np.int32))
                            places.append(np.array([-o], np.int32))  # under 0: a subset of this size
                            counts.append(np.zeros(1, np.uint32))
                    if 100 * n // percent < boundary:
                        continue
                rank = _ranks(values, frequency, noise)
                first = np.lexsort((values, rank))[: prefix_length(n, percent)]
                tokens.append(values[first])
                names.append(np.full(len(first), name))
                sizes.append(np.full(len(first), n, np.int32))
                places.append(np.arange(1, len(first) + 1, dtype=np.int32))
                counts.append(rank[first].astype(np.uint32))
            if not tokens:
                continue
            token, name, size, place, count = map(np.concatenate, (tokens, names, sizes, places, counts))
            yield from _dealt(token, name, size, place, count, buckets, part)

    return run


ENTRY = np.dtype([("token", "<u8"), ("name", "<u8"), ("size", "<i4"), ("place", "<i4")])


def _dealt(token, name, size, place, count, buckets, part):
    entries = np.empty(len(token), ENTRY)
    entries["token"], entries["name"], entries["size"], entries["place"] = token, name, size, place
    parts = np.where(place < 0, 1, -(-count.astype(np.int64) // part))
    parts = np.maximum(1, parts)
    home = (mix(token) % np.uint64(buckets)).astype(np.int64)
    single = parts == 1
    groups = [(home[single], np.zeros(single.sum(), np.int64), entries[single])]
    for i in np.flatnonzero(~single):
        # A list that is long by the sketch: its parts meet in pairs, each pair a bucket of its own.
        p = int(parts[i])
        mine = int(mix(name[i : i + 1])[0] % np.uint64(p))
        pairs = np.array([(min(mine, j), max(mine, j)) for j in range(p)], np.int64)
        code = 1 + (pairs[:, 0] * p + pairs[:, 1])
        to = (mix(np.full(p, token[i]) + code.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        groups.append((to, code, np.repeat(entries[i : i + 1], p)))
    to, code, packed = (np.concatenate(x) for x in zip(*groups, strict=True))
    order = np.lexsort((code, to))
    to, code, packed = to[order], code[order], packed[order]
    cut = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (code[1:] != code[:-1])])) if len(to) else []
    ends = np.concatenate([cut[1:], [len(to)]]).astype(int) if len(to) else []
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([int(to[a]) for a in cut], pa.int32()),
            pa.array([int(code[a]) for a in cut], pa.int64()),
            pa.array([packed[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
        ],
        ["bucket", "part", "entries"],
    )


def _fits(size_a, place_a, size_b, place_b, percent):
    """Size and position filters of list entries: both sides have enough shingles left after this common one."""
    need = overlap_needed(size_a.astype(np.int64), size_b.astype(np.int64), percent)
    left = np.minimum(size_a - place_a, size_b - place_b) + 1
    most = np.minimum(place_a, place_b) - 1 + left
    return (np.minimum(size_a, size_b) >= need) & (most >= need)


def _sorted_entries(packed) -> np.ndarray:
    entries = np.concatenate([np.frombuffer(b, ENTRY) for b in packed]) if len(packed) else np.empty(0, ENTRY)
    entries = entries[np.lexsort((entries["size"], entries["name"], entries["token"]))]
    again = np.concatenate([[False], (entries["token"][1:] == entries["token"][:-1]) & (entries["name"][1:] == entries["name"][:-1])]) if len(entries) else np.zeros(0, bool)
    return entries[~again]


MEMBER = np.dtype([("name", "<u8"), ("size", "<i4"), ("place", "<i4")])


def _lists(percent: int, unit: int):
    """Of a bucket: its lists of two sets and more; lists of the same sets once.

    ``sure``: a list of a subset, the first set links with all others.  A list of more than ``2 * unit`` sets is cut into
    ``parts``, a row each with its ``nth``, so what a task gives is no more than what it got.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {}
        for _, mine in pdf.groupby("part"):
            entries = _sorted_entries(mine["entries"].tolist())
            if not len(entries):
                continue
            cut = np.flatnonzero(np.concatenate([[True], entries["token"][1:] != entries["token"][:-1]]))
            ends = np.concatenate([cut[1:], [len(entries)]])
            members = np.empty(len(entries), MEMBER)
            members["name"], members["size"], members["place"] = entries["name"], entries["size"], entries["place"]
            mixed = mix(entries["name"])
            first, second = np.add.reduceat(mixed, cut), np.add.reduceat(mix(mixed + np.uint64(1)), cut)
            tokens = entries["token"][cut].view(np.int64).tolist()
            for a, b, x, y, token in zip(cut.tolist(), ends.tolist(), first.view(np.int64).tolist(), second.view(np.int64).tolist(), tokens, strict=True):
                if b - a < 2:
                    continue
                part = members[a:b]
                if part["place"][0] < 0:
                    part = part[np.argsort(part["size"], kind="stable")]
                    # The smallest asks for the least overlap, so it links with all that link with any.
                    ok = overlap_needed(part["size"][0], part["size"], percent) <= -part["place"][0]
                    ok[0] = True
                    if ok.sum() > 1:
                        part = part[ok]
                        rows[x, y, True, int(part["place"][0]), 0] = 1, token, part.tobytes()
                elif b - a <= 2 * unit:
                    rows[x, y, False, 0, 0] = 1, token, part.tobytes()
                else:
                    p = -(-(b - a) // unit)
                    cuts = np.linspace(0, b - a, p + 1).astype(int)
                    for i in range(p):
                        rows[x, y, False, 0, i] = p, token, part[cuts[i] : cuts[i + 1]].tobytes()
        return pd.DataFrame([(*k, *v) for k, v in rows.items()], columns=["x", "y", "sure", "o", "nth", "parts", "token", "members"])

    return run


def _members(batches):
    """Rows of lists to rows of their sets."""
    for pdf in batches:
        count = pdf["members"].str.len().to_numpy(np.int64) // MEMBER.itemsize
        rows = np.frombuffer(b"".join(pdf["members"]), MEMBER)
        of = lambda c: np.repeat(pdf[c].to_numpy(), count)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        for a in range(0, len(rows), 20_000):
            part = slice(a, a + 20_000)
            yield pd.DataFrame(
                {"list": of("list")[part], "nth": of("nth")[part], "parts": of("parts")[part], "sure": of("sure")[part], "at": at[part], "name": np.ascontiguousarray(rows["name"]).view(np.int64)[part], "size": rows["size"][part], "place": rows["place"][part]}
            )


# --- the forests of lists -------------------------------------------------------


def _apart(maps: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of the pairs (i, j) differ, folded to the narrower of both."""
    width = np.array([len(m) for m in maps], np.int64)
    out, narrow = np.zeros(len(i), np.int64), np.minimum(width[i], width[j])
    for w in np.unique(narrow).tolist():
        pairs = np.flatnonzero(narrow == w)
        used, where = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        folded = np.stack([_folded(maps[u], w) for u in used.tolist()]).view(np.uint64)
        x, y, step = where[: len(pairs)], where[len(pairs) :], max(1, (4 << 20) // w)
        for a in range(0, len(pairs), step):
            part = slice(a, a + step)
            out[pairs[part]] = np.bitwise_count(folded[x[part]] ^ folded[y[part]]).sum(axis=1)
    return out


def _spanning(n: int, adjacent: np.ndarray) -> np.ndarray:
    """The parent of each vertex in a spanning forest of a graph (n x n, boolean); roots are their own."""
    parent, open_ = np.arange(n), np.ones(n, bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        front = np.array([seed])
        while len(front):
            reach = adjacent[front][:, :] & open_
            new = np.flatnonzero(reach.any(axis=0))
            parent[new] = front[reach[:, new].argmax(axis=0)]
            open_[new] = False
            front = new
    return parent


def _forest(percent: int):
    """Of a task's lists: pairs of sets that may link, and connect all sets that do (through others)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["at"].to_numpy(), pdf["list"].to_numpy()))
        size, place = pdf["size"].to_numpy(np.int64)[order], pdf["place"].to_numpy(np.int64)[order]
        lists, sure = pdf["list"].to_numpy()[order], pdf["sure"].to_numpy(bool)[order]
        node, keys = pd.factorize(pdf["key"].to_numpy()[order])
        maps = pdf["bitmap"].to_numpy()[order].tolist()
        group = np.arange(len(keys))

        def root(v: int) -> int:
            while group[v] != v:
                group[v] = v = group[group[v]]
            return v

        us, vs = [], []

        def joined(i: np.ndarray, j: np.ndarray) -> None:
            for a, b in zip(node[i].tolist(), node[j].tolist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    group[max(x, y)] = min(x, y)
                    us.append(a)
                    vs.append(b)

        def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which of the pairs pass all filters."""
            ok = np.flatnonzero(_fits(size[i], place[i], size[j], place[j], percent))
            apart = _apart(maps, i[ok], j[ok])
            good = (size[i[ok]] + size[j[ok]] - apart) // 2 >= overlap_needed(size[i[ok]], size[j[ok]], percent)
            return ok[good]

        cut = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.zeros(0, int)
        length = np.diff(np.append(cut, len(lists)))
        for a in cut[sure[cut]].tolist():
            n = int(length[np.searchsorted(cut, a)])
            joined(np.full(n - 1, a), np.arange(a + 1, a + n))
        plain = ~sure[cut]
        for a, n in sorted(zip(cut[plain].tolist(), length[plain].tolist(), strict=True), key=lambda t: -t[1]):
            if n <= 16:
                break
            here = np.array([root(v) for v in node[a : a + n].tolist()])
            i, j = np.triu_indices(n, 1)
            apart = here[i] != here[j]
            i, j = i[apart], j[apart]
            good = may(a + i, a + j)
            adjacent = np.zeros((n, n), bool)
            adjacent[i[good], j[good]] = adjacent[j[good], i[good]] = True
            parent = _spanning(n, adjacent)
            child = np.flatnonzero(parent != np.arange(n))
            joined(a + child, a + parent[child])
        for n in range(2, 17):
            starts = cut[plain & (length == n)]
            if len(starts):
                i, j = np.triu_indices(n, 1)
                i, j = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
                good = may(i, j)
                joined(i[good], j[good])
        return pd.DataFrame({"u": keys[us] if us else [], "v": keys[vs] if vs else []})

    return run


# --- sets by name ---------------------------------------------------------------


def _bloom_spots(names: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(names + np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in (1, 2, 3, 4)])


def _bloom(names: DataFrame, bits: int, n: int) -> np.ndarray:
    """A Bloom filter of fixed size over the ``n`` rows of the column ``name``."""

    def build(batches):
        have = np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            spots = np.unique(_bloom_spots(pdf["name"].to_numpy(np.int64).view(np.uint64), bits))
            np.bitwise_or.at(have, spots // 8, (1 << (spots % 8)).astype(np.uint8))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() if TaskContext.get() else 0], "data": [zlib.compress(have.tobytes(), 1)]})

    def join(parts: list[bytes]) -> bytes:
        have = np.zeros(bits // 8, np.uint8)
        for p in parts:
            have |= np.frombuffer(p, np.uint8)
        return have.tobytes()

    tasks = max(1, math.ceil(n / 1_000_000))
    got = _by_tree(names.repartition(tasks).mapInPandas(build, "part long, data binary"), tasks, join)
    return np.frombuffer(got, np.uint8) if got else np.zeros(bits // 8, np.uint8)


def _bloom_bits(n: int) -> int:
    return min(BLOOM_MOST, max(1 << 16, 1 << (16 * n).bit_length()))


def _wanted_sets(texts: DataFrame, k: int, names: DataFrame, n: int) -> DataFrame:
    """(key, values) of the sets that the ``n`` rows of ``names`` ask for and some others, one row per set."""
    bits = _bloom_bits(n)
    shared = texts.sparkSession.sparkContext.broadcast(_bloom(names, bits, n))

    def run(batches):
        have, seen = shared.value, set()
        for batch in batches:
            out = []
            for values in shingle_sets(batch.column(0).to_pylist(), k):
                if not len(values):
                    continue
                key = set_key(values)
                name = np.frombuffer(key[:8], np.uint64)
                spots = _bloom_spots(name, bits)[:, 0]
                if key not in seen and ((have[spots // 8] >> (spots % 8)) & 1).all():
                    seen.add(key)
                    out.append((key, values.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["key", "values"])

    return texts.mapInArrow(run, "key binary, values binary").dropDuplicates(["key"])


# --- components -----------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every end of a link: the least end reachable."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").dropDuplicates()
    edges = durable(edges, "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    state = mark(edges)
    while state[0]:
        # Large star: every greater neighbour meets the least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").dropDuplicates()
        # Small star: all lesser neighbours and the vertex itself meet the least one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = durable(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropDuplicates(), "edges")
        release(edges)
        edges, before, state = after, state, mark(after)
        if state == before:
            break
    roots = edges.select("v").dropDuplicates()
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(roots.select("v", F.col("v").alias("root")))


# --- links within a group -------------------------------------------------------


def _overlaps(values: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two sets share, by products of blocks of columns."""
    n = np.array([len(v) for v in values], np.int64)
    if len(values) == 2:
        common = len(np.intersect1d(*values, assume_unique=True))
        return np.array([[n[0], common], [common, n[1]]])
    row = np.repeat(np.arange(len(n)), n)
    _, column, held = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(n), len(n)), np.float32)  # no set has 2**24 shingles in common with another
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        has = np.zeros((len(n), min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        has[row[part], column[part] - a] = 1
        both += has @ has.T
    return both


def _linked(percent: int):
    """Of the groups of a task, or two parts x and y of a group (or one, x = y): per set the number of its links between
    them, and its parent in a spanning forest of these links (itself: none)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, parents, links = [], [], []
        for (_, x, y), part in pdf.groupby(["root", "x", "y"], sort=False):
            values = [np.frombuffer(v, np.uint64) for v in part["values"]]
            n, mine, own = np.array([len(v) for v in values], np.int64), part["mine"].to_numpy(np.int64), part["key"].to_numpy()
            linked = _overlaps(values) >= overlap_needed(n[:, None], n[None, :], percent)
            np.fill_diagonal(linked, False)
            if x != y:
                linked &= mine[:, None] != mine[None, :]
            keys += own.tolist()
            parents += own[_spanning(len(n), linked)].tolist()
            links += linked.sum(axis=1).tolist()
        return pd.DataFrame({"key": keys, "parent": parents, "links": np.array(links, np.int64)})

    return run


def _links(groups: DataFrame, texts: DataFrame, k: int, percent: int, together: int, tasks: int) -> DataFrame:
    """(key, parent, links) of the sets (key, name, n, root) of groups; every link is inside a group.

    A large group is cut into parts of about ``together`` sets and ``PART_BYTES``; each pair of parts is
    a task's work.  Small groups are worked through together.
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("sets") / together), F.ceil(F.col("shingles") * 8 / PART_BYTES)).cast("int")
    many = durable(groups.join(sizes, "root").select("key", "name", "n", "root", parts.alias("parts")), "grouped")
    total = many.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    if not total["sets"]:
        return many.select("key", F.col("key").alias("parent"), F.lit(0).cast("long").alias("links"))
    found = _wanted_sets(texts, k, many.select("name"), total["sets"])
    tasks = max(tasks, math.ceil(8 * total["shingles"] / PART_BYTES))
    small = F.pmod(F.xxhash64("root"), F.lit(tasks))
    dealt = (
        found.join(many, "key")
        .withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "values", "root", "parts", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
        .withColumn("task", F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("root", "x", "y")))
        .drop("parts")
    )
    return durable(dealt.groupBy("task").applyInPandas(_linked(percent), "key binary, parent binary, links long"), "links")


# --- the operator ---------------------------------------------------------------


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest id stays.

    Rows without words are no copies of anything and stay; of rows with equal ids the one with the
    smallest hash of its text stays, of rows that are equal one; rows without an id give way to others.
    Further columns may have any names.
    """
    found = durable(classes(docs, k, percent, id_col, text_col).where(F.col("component_key").isNotNull()).select("id", "mark", "component_key"), "classes")
    pick = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("mark"))
    stays = found.groupBy("component_key").agg(F.min(pick).alias("pick")).select("component_key", "pick.id", "pick.mark")
    kept = found.alias("f").join(stays.alias("s"), (F.col("f.component_key") == F.col("s.component_key")) & F.col("f.id").eqNullSafe(F.col("s.id")) & (F.col("f.mark") == F.col("s.mark")), "left_anti")
    goes_id, goes_mark, flag_col = (fresh(c, docs.columns) for c in ("goes_id", "goes_mark", "may_go"))
    goes = kept.select(F.col("id").alias(goes_id), F.col("mark").alias(goes_mark)).dropDuplicates()
    text_mark = F.xxhash64(text_col)
    goes = durable(goes, "goes")
    # Texts stay where they are: a Bloom filter of bounded size lets most rows that stay pass at once,
    # and only the others (those that go, and its false positives) meet the exact list.
    both = lambda i, m: F.xxhash64(i, m)
    names = goes.select(both(F.col(goes_id), F.col(goes_mark)).alias("name"))
    n = names.count()
    bits = _bloom_bits(n)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(names, bits, n))

    def may_go(names: pd.Series) -> pd.Series:
        have = shared.value
        spots = _bloom_spots(names.to_numpy(np.int64).view(np.uint64), bits)
        return pd.Series(((have[spots // 8] >> (spots % 8)) & 1).all(axis=0))

    flag = F.pandas_udf(may_go, T.BooleanType())
    marked = docs.withColumn(flag_col, flag(both(F.col(id_col).cast("long"), text_mark)))
    exact = (F.col(id_col).cast("long").eqNullSafe(F.col(goes_id))) & (text_mark == F.col(goes_mark))
    rest = marked.where(F.col(flag_col)).join(goes, exact, "left_anti")
    out = marked.where(~F.col(flag_col)).unionByName(rest).drop(flag_col)
    again = found.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(stays, ["mark"]).limit(1)
    if again.count():  # rows that stay are repeated: one of each, rows without words untouched
        has_words = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        mark_col = fresh("mark", docs.columns)
        once = out.where(has_words).withColumn(mark_col, text_mark).dropDuplicates([id_col, mark_col]).drop(mark_col)
        out = once.unionByName(out.where(~has_words))
    return out


def classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", boundary: int | None = None, buckets: int | None = None, unit: int = UNIT, part: int = PART, together: int = TOGETHER) -> DataFrame:
    """Per row: ``id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links), ``set_key`` and ``links``,
    besides ``mark`` (a hash of the text, to tell rows of one id apart) and ``component_key`` (null without shingles).

    ``set_key`` names the row's class of equal sets (null without shingles).  ``links`` is the
    number of other classes that its class links with.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    texts = rows.select("text")
    schema = "id long, mark long, key binary, name long, n long, bitmap binary, few binary, part long, sketch binary"
    first = durable(rows.mapInArrow(_survey(k), schema), "survey")
    members = first.where(F.col("part").isNull()).select("id", "mark", "key", "name", "n", "bitmap")
    frequency = _sketch(first)
    shared = spark.sparkContext.broadcast(frequency)  # BINS counts
    if boundary is None:
        boundary = choose_boundary(*_list_costs(first, percent, shared), percent)
    sets = durable(
        members.where(F.col("key").isNotNull())
        .groupBy("key", "name", "n", "bitmap")
        .agg(F.min("id").alias("least_id")),
        "sets",
    )
    tasks = min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = int(frequency.sum(dtype=np.int64)) * (100 - percent) // 100
    buckets = buckets or max(8, math.ceil(entries / 1_000_000), tasks)
    packed = texts.mapInArrow(_postings(k, percent, boundary, buckets, part, shared), "bucket int, part long, entries binary")
    lists = packed.groupBy("bucket").applyInPandas(_lists(percent, unit), "x long, y long, sure boolean, o int, nth int, parts int, token long, members binary")
    # All parts of a list are those of one shingle, as places are only comparable there.
    lists = lists.groupBy("x", "y", "sure", "o", "nth", "parts").agg(F.min_by("members", "token").alias("members"))
    lists = durable(lists.select(F.xxhash64("x", "y", "sure", "o").alias("list"), "sure", "nth", "parts", "members"), "lists")
    copies = F.greatest(F.lit(1), F.col("parts") - 1).cast("long")
    met = lists.agg(F.coalesce(F.sum(F.octet_length("members") * copies), F.lit(0))).first()[0] // MEMBER.itemsize
    bucket = F.pmod(F.xxhash64("list"), F.lit(max(tasks, math.ceil(met / ENTRIES))))
    forests = (
        lists.mapInPandas(_members, "list long, nth int, parts int, sure boolean, at int, name long, size int, place int")
        .join(sets.select("name", "key", "n", "bitmap"), "name")
        .where(F.col("size") == F.col("n"))
        # Sets have met their bitmaps once; now each two parts of a long list are a list of their own.
        .withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array("nth")).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("nth")))))
        .withColumn("list", F.when(F.col("parts") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("nth", "other"), F.greatest("nth", "other"))))
        .select("list", "sure", "at", "size", "place", "key", "bitmap")
        .groupBy(bucket.alias("task"))
        .applyInPandas(_forest(percent), "u binary, v binary")
    )
    forests = durable(forests, "forests")
    release(lists)
    groups = sets.select("key", "name", "n").join(components(forests).select(F.col("v").alias("key"), "root"), "key")
    release(forests)
    linked = _links(groups, texts, k, percent, together, tasks)
    roots = components(linked.where("key <> parent").select(F.col("key").alias("u"), F.col("parent").alias("v")))
    counted = linked.groupBy("key").agg(F.sum("links").alias("links"))
    rooted = (
        sets.select("key", "least_id")
        .join(roots.select(F.col("v").alias("key"), "root"), "key", "left")
        .join(counted, "key", "left")
        .select("key", "least_id", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
    rooted = durable(rooted, "rooted")
    release(linked)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_key = rooted.join(least, "root").select("key", F.col("root").alias("component_key"), "component_id", "links")
    return (
        members.join(by_key, "key", "left")
        .select("id", "mark", "component_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("key").alias("set_key"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
