"""Vector codes, fill-in-the-middle and token files against plain versions."""

import glob
import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import folder, frame, rows
from tokenizers import Tokenizer

from quarrylight.llm import infill, queries, records, vector_codes

SMALL = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, id string, code string, error string"


# --- vector codes


def plain_codes(data, parts=16, entries=64, rounds=2, scale=256):
    kept = []
    for vec_id, v, label in data:
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not v or len(v) % parts:
            continue
        kept.append((vec_id is None, vec_id or 0, list(v), vec_id, label, [math.floor(scale * x) for x in v]))
    kept.sort(key=lambda r: r[:3])
    kept = [r for r in kept if len(r[5]) == len(kept[0][5])]
    if not kept:
        return [], []
    w = len(kept[0][5]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[5], p) for r in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        found = [(sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book)]
        return min(found)

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for r in kept:
                got[nearest(cut(r[5], p), books[p])[1]].append(cut(r[5], p))
            books[p] = [[sum(c) // len(c) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for r in kept:
        found = [nearest(cut(r[5], p), books[p]) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[r[4]] += error
        out.append([r[3], "".join(f"{k:02x}" for _, k in found), min(error, 2**63 - 1), r[4]])
    return [(i, c, e, min(by_label[label], 2**63 - 1)) for i, c, e, label in out], books


def awkward_vectors():
    import random

    rnd = random.Random(3)
    data = [(i, [rnd.gauss(0, 1) for _ in range(32)], i % 3 if i % 7 else None) for i in range(150)]
    data += [(500 + i, [0.25] * 32, 1) for i in range(80)]  # one vector of many rows
    data += [(i, [rnd.gauss(0, 1) for _ in range(32)], 2) for i in (5, 5, 7)]  # ids more than once
    data += [data[3], data[3], (None, [0.5] * 32, None), (900, None, 1), (901, [], 1), (902, [1.0, None] * 16, 1), (903, [float("nan")] * 32, 1)]
    data += [(904, [float("-inf")] + [0.0] * 31, 1), (905, [1.0] * 16, 1), (906, [1.0] * 7, 1), (907, [-0.001] * 32, 8)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in data]


def as_frame(spark, data):
    return spark.createDataFrame([(i, v, label, "i", "c", "e") for i, v, label in data], VECTORS).repartition(3)


def digits(found):
    return sorted(((r.id, "".join(f"{c:02x}" for c in r.code), r.error, r.label_error) for r in found.collect()), key=repr)


@pytest.mark.parametrize("kind", ["awkward", "few", "huge", "odd dimensions first"])
def test_codes(spark, kind):
    data = awkward_vectors()
    if kind == "few":
        data = data[:20] + data[-9:]
    if kind == "huge":  # distances beyond 64 bits
        data = [(i, [v * 1e9 * (1 + i % 3) for v in x], label) for i, x, label in data[:90]]
    if kind == "odd dimensions first":
        data = [(-2, [1.0] * 5, 1), (-1, [2.0] * 48, 1), *data]
    found, books = vector_codes.compressed(as_frame(spark, data))
    want, plain = plain_codes([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in data])
    assert digits(found) == sorted(want, key=repr)
    assert books.tolist() == plain


def test_codes_of_nothing(spark):
    found, books = vector_codes.compressed(as_frame(spark, []))
    assert found.count() == 0 and found.columns == ["id", "label", "code", "error", "label_error"]
    assert vector_codes.compressed(as_frame(spark, [(1, None, 1), (2, [float("nan")], 2)]))[0].count() == 0


def test_codes_stand_for_entries(spark):
    found, books = vector_codes.compressed(as_frame(spark, awkward_vectors()))
    row = found.where("id = 907").first()
    back = vector_codes.decoded(found, books).where("id = 907").first()["vector"]
    assert back == [x / 256 for p, c in enumerate(row.code) for x in books[p][c].tolist()]
    x = np.floor(256 * np.full(32, np.float64(np.float32(-0.001))))
    assert int(((np.array(back) * 256 - x) ** 2).sum()) == row.error


def test_products_of_64_bits_are_exact():
    rnd = np.random.default_rng(1)
    x, books = rnd.integers(-(2**28), 2**28, (50, 32)), rnd.integers(-(2**28), 2**28, (16, 9, 2))
    assert vector_codes.exact(16, 32, x, books)
    codes, errors = vector_codes.assign(x, books)
    slow, exact = vector_codes.assign(x.astype(object), books.astype(object))
    assert (codes == slow).all() and (errors == exact).all()
    assert not vector_codes.exact(16, 32, x * 8, books)


# --- fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def infill_texts():
    hard = ["a\x00b c\x00", "x<P>y", "<M>", "a<S>", "<", "<P", "P>", "<S", "a <M b >", "\x0b\x0c a\x85b\xa0c d ", "é \U0001f468‍\U0001f469 中文", "   ", "$1 \\1 'q' \"", "word " * 300_000]
    out = [(i, r[1]) for i, r in enumerate(rows())] + [(None, "no id"), (7, "again")]
    return out + [(1000 * (k + 1) + i, t) for k in range(6) for i, t in enumerate(hard)]


def test_fill_in_middle(spark):
    from pyspark.sql import functions as F

    data = infill_texts()
    docs = spark.createDataFrame([(i, t, "x", 1, "p") for i, t in data], "doc_id long, text string, form string, n int, output string").repartition(4)
    made = infill.fill_in_middle(docs)
    key = lambda r: repr(r)
    assert sorted(map(tuple, made.collect()), key=key) == sorted((plain_infill(i, t) for i, t in data), key=key)
    back = made.select("id", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((i, t or "") for i, t in data), key=key)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_rates_and_marks(spark):
    docs = spark.createDataFrame([(i, "a b c d <P>") for i in range(50)], "doc_id long, text string")
    forms = {r.form for r in infill.fill_in_middle(docs, rate=100, spm_share=100, marks=("[p]", "[s]", "[m]")).collect()}
    assert forms == {"spm"}
    assert {r.form for r in infill.fill_in_middle(docs, rate=0, marks=("[p]", "[s]", "[m]")).collect()} == {"plain"}


# --- token files


def library_ids(texts):
    tool = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, tmp_path):
    data = rows() + [(5, "again " * 10, "en", "s", None, 1, "x", "y", "z"), (300, "long " * 400_000, "en", "s", None, 1, "x", "y", "z")]
    sf = folder(spark, tmp_path, data)
    got = sorted((tuple(r) for r in queries.queries()["op13_token_records"](spark, sf).collect()), key=lambda r: r[1])
    ids = library_ids([r[1] for r in data])
    assert [r[0] for r in got] == sorted((r[0] for r in data), key=lambda i: (i is not None, i))
    start, left = 0, defaultdict(int)
    for r, x in zip(data, ids, strict=True):
        left[r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        left[doc_id, n, crc] -= 1
    assert not any(left.values())


def test_token_files_of_nothing(spark, tmp_path):
    where = records.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "none"))
    assert records.read_records(spark, where).count() == 0
    assert records.read_shuffled(spark, where).count() == 0


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("records"))
    return where, records.token_files(frame(spark), PATH, where)


def test_format_by_hand(files):
    where, _ = files
    n = 0
    for name in sorted(glob.glob(f"{where}/*.records")):
        data, at = open(name, "rb").read(), 16
        assert data[:9] == b"QLTOKENS\x02"
        offsets = []
        while at < len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            payload = data[at + 12 : at + 12 + size]
            for part, place in ((data[at : at + 8], at + 8), (payload, at + 12 + size)):
                crc = zlib.crc32(part)
                assert struct.unpack_from("<I", data, place)[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) % 2**32
            offsets.append(at)
            at += size + 16
        index = records.read_index(name.replace(".records", ".index"))
        assert index[:, 0].tolist() == [*offsets, len(data)]
        n += len(offsets)
    assert n == len(rows())


def test_shuffled_reading(spark, files):
    _, where = files
    plain = sorted((tuple(r) for r in records.read_records(spark, where).collect()), key=repr)
    one = [tuple(r) for r in records.read_shuffled(spark, where, seed=1).collect()]
    two = [tuple(r) for r in records.read_shuffled(spark, where, seed=2).collect()]
    assert [r[0] for r in one] == sorted(r[0] for r in one)
    assert sorted((r[1:] for r in one), key=repr) == plain == sorted((r[1:] for r in two), key=repr)
    assert [r[2] for r in one] != [r[2] for r in two]


@pytest.mark.parametrize("place", [17, 25, 40, -1])
def test_damage_is_seen(spark, tmp_path, place):
    where = str(tmp_path / "damaged")
    records.token_files(spark.createDataFrame([(1, "a text that is long enough")], "doc_id long, text string"), PATH, where)
    (name,) = glob.glob(f"{where}/*.records")
    data = bytearray(open(name, "rb").read())
    data[place] ^= 4
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged|cut off"):
        records.read_records(spark, where).collect()


def test_files_without_manifest_are_not_read(spark, tmp_path):
    """A task that dies leaves its file in no manifest: nothing is readable before all tasks have ended."""
    from pyspark.sql import functions as F

    where = str(tmp_path / "broken")
    rows = spark.range(40).repartition(4).select(F.col("id"), F.when(F.col("id") == 30, F.raise_error("lost").cast("binary")).otherwise(F.encode(F.lit("aaaa"), "utf-8")).alias("ids"))
    with pytest.raises(Exception, match="lost"):
        records.write_records(rows, where)
    with pytest.raises(Exception, match="manifest"):
        records.read_records(spark, where).collect()
    records.write_records(spark.range(3).select("id", F.encode(F.lit("aaaa"), "utf-8").alias("ids")), where)
    assert sorted(r.id for r in records.read_records(spark, where).collect()) == [0, 1, 2]


def test_ids_that_do_not_fit(spark, tmp_path):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="two bytes"):
        records.write_records(spark.range(1).select("id", F.encode(F.lit("aaaa"), "utf-8").alias("ids")), str(tmp_path / "narrow"), width=2)


def test_merging_by_the_library_changes_nothing():
    from quarrylight.llm.bpe import json_codec

    texts = [r[1] or "" for r in rows()] + ["<|endoftext|> a<|endoftext|>b  \n c", "x" * 3000 + "é" * 900, "日本語" * 700, " " * 5000, "'" * 99, ""]
    for own, other in zip(records.library_codec(PATH).encode_all(texts), json_codec(PATH).encode_all(texts), strict=True):
        assert own.tolist() == other.tolist()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_in_middle"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    from quarrylight.plans import harness

    assert harness.compare(queries.queries()[name](spark, SMALL), harness.duck(SMALL), queries.oracle_sql()[name]) == ""
