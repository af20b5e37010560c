"""BPE and packing against the public libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from fixtures import folder, rows, texts

from quarrylight.llm import bpe, packing, queries

SMALL = "/root/testdata/sf0.01"
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=["awkward", "empty", "small"])
def case(request, spark, tmp_path_factory):
    if request.param == "small":
        return SMALL, [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    data = rows() if request.param == "awkward" else []
    return folder(spark, tmp_path_factory.mktemp(request.param), data), [r[:2] for r in data]


def order(r):
    return tuple((x is not None, x) if x is not None else (False, 0) for x in r)


def test_bpe_query(spark, case):
    sf_dir, data = case
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in data for x in [enc.encode_ordinary(t or "")]]
    got = [tuple(r) for r in queries.queries()["op7_byte_bpe"](spark, sf_dir).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_perfect_hash_is_minimal_and_rejects_strangers():
    ranks = bpe.read_ranks(RANKS)
    h = bpe.codec(RANKS, P.PATTERN).hash
    short = {t: r for t, r in ranks.items() if len(t) <= bpe.WORDS}
    assert h.n == len(short) and sorted(h.values.tolist()) == sorted(short.values())
    codec = bpe.codec(RANKS, P.PATTERN)
    for piece in (b" zzqx", b"thonononthhe", b"a" * 3000, "é中\U0001f600".encode(), b"\xff\xfe"):
        ids = bpe.merged(piece, codec.single, codec.pairs)
        assert codec.decode(ids) == piece


def test_bytes_of_hits_are_compared():
    h = bpe.PerfectHash([b"ab", b"cd"], [1, 2])
    h.first[:] = 0  # slots that keep other bytes: nothing may be found by its hash alone
    word = np.frombuffer(b"ab".ljust(16, b"\0"), "<u8")
    assert h.find(word[:1], word[1:], np.array([2])).tolist() == [bpe.NO_ID]


def test_every_character_splits_as_in_the_library():
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    codec = bpe.codec(RANKS, P.PATTERN)
    assert bpe.PATTERN == P.PATTERN
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    data = [f"a{c}b1{c} {c}{c}'s\n{c}x" for c in map(chr, points)]
    assert [x.tolist() for x in codec.encode_all(data)] == enc.encode_ordinary_batch(data)
    rnd = random.Random(5)
    data = ["".join(rnd.choice("ab'strelvdm 's \n\t 1²é中\U0001f600.,-\u00a0\u3000\x1c_") for _ in range(rnd.randint(0, 30))) for _ in range(20_000)]
    for _ in range(2):  # the second time out of the cache
        assert [x.tolist() for x in codec.encode_all(data)] == enc.encode_ordinary_batch(data)


def test_very_long_texts():
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(9)
    data = ["word " * 500_000, "x" * 20_000, "".join(rnd.choice("abcdefgh") for _ in range(30_000)), "\n" * 100_000 + "a"]
    assert [x.tolist() for x in bpe.codec(RANKS, P.PATTERN).encode_all(data)] == enc.encode_ordinary_batch(data)


def test_round_trip_of_arrays(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    coded = bpe.encoded(docs, RANKS, P.PATTERN)
    back = {r.id: bytes(r.decoded) for r in bpe.decoded(coded, RANKS, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts())}


def test_packing_query(spark, case):
    from tokenizers import Tokenizer

    sf_dir, data = case
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.queries()["op3_best_fit_packing"](spark, sf_dir).collect()
    want = Counter()
    for (i, _), e in zip(data, t.encode_batch([x or "" for _, x in data], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    if got:
        assert len(bins) == packing.lower_bound(Counter(r.length for r in got), 2048)


def exact_bins(sizes, cap):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[k] <= cap and bins[j] not in bins[:j]:
                go(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_pack_is_optimal_on_small_instances(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 20, 50])
    sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 11))]
    counts = Counter(sizes)
    plan = packing.pack(counts, cap, None)
    used = Counter()
    for pattern, times in plan:
        assert sum(k * c for k, c in pattern) <= cap and times > 0
        for k, c in pattern:
            used[k] += c * times
    assert used == counts
    assert sum(n for _, n in plan) == exact_bins(sizes, cap)


def test_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 40 in bins of 10
    assert sum(n for _, n in packing.pack(counts, 10)) == 4
    hard = {42: 3, 63: 0, 30: 3, 28: 3}
    assert sum(n for _, n in packing.pack(hard, 100)) == 3
