"""URL filters and the quality classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import frame

from quarrylight.llm import quality, queries, url_filters

SMALL = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string, rule string, n int"
URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://NET/",
    "http://a.net",
    "http://a.net?x=/",
    "https://x.Example.NET/en/1?q#f",
    "https://example.net/en",
    "https://notexample.com/de/5",
    "https://example.com/de/5.html",
    "https://www.example.com/DE/5",
    "https://example.com/de",
    "ftp://q.org/fr/x#http://b.net/",
    "https://q.org/fr",
    "weird://a b.net/\n/c?://x",
    "https://example.org/" + "deep/" * 3000,
    "https://u:p@h.net:80/a",
    "x://y://z.net/",
]


def ruled(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = []
    for r, v in url_filters.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(r), r, v))
    return host, path, max(fit)[1:] if fit else None


def form(segment):
    ext = re.search(r"\.[A-Za-z]{1,5}$", segment)
    ext = ext[0] if ext else ""
    stem = segment[: len(segment) - len(ext)]
    if re.fullmatch(r"[0-9]+([-_.][0-9]+)*", stem):
        return "{n}" + ext
    if re.fullmatch(r"[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem):
        return "{h}" + ext
    if len(stem) >= 24 or (len(stem) >= 16 and re.search("[0-9]", stem) and "\n" not in stem):
        return "{s}" + ext
    return segment


def judged_plainly(data, rules=url_filters.RULES):
    """(template, score, verdict) of each page, the tree grown level by level with dictionaries."""
    verdict_of = dict(rules)
    shapes, pages = {}, []
    for i, url in data:
        host, path, rule = ruled(url)
        shape = "/".join(map(form, path.split("/")))
        pages.append((i, host, shape, rule))
        s = shapes.setdefault((host, shape), [0, 0, 0])
        s[0] += 1
        s[1] += rule is not None
        s[2] += rule is not None and verdict_of[rule[0]] == "block"
    place = {k: (k[1].split("/")[0], k[1].split("/")[1:]) for k in shapes}
    while any(rest for _, rest in place.values()):
        nodes = {}
        for k, (template, rest) in place.items():
            if rest:
                c = nodes.setdefault((k[0], template), {}).setdefault(rest[0], [0, 0, 0])
                for x in range(3):
                    c[x] += shapes[k][x]
        after = {}
        for k, (template, rest) in place.items():
            if not rest:
                after[k] = (template, rest)
                continue
            children = nodes[k[0], template]
            n, known, blocked = (sum(c[x] for c in children.values()) for x in range(3))
            c = children[rest[0]]
            name = rest[0]
            if len(children) > 20 and c[0] < 0.05 * n:
                name = "*"
            elif sum(v[1] > 0 for v in children.values()) > 1 and c[1]:
                rate = blocked / known
                if abs(c[2] / c[1] - rate) <= 1.96 * (rate * (1 - rate) / c[1]) ** 0.5:
                    name = "*"
            after[k] = (template + "/" + name, rest[1:])
        place = after
    labelled, blocked = (sum(s[x] for s in shapes.values()) for x in (1, 2))
    prior, own, common = (blocked + 1) / (labelled + 2), {}, {}
    for k, (template, _) in place.items():
        for sums, key in ((own, (k[0], template)), (common, template)):
            t = sums.setdefault(key, [0, 0])
            t[0] += shapes[k][1]
            t[1] += shapes[k][2]
    out = {}
    for i, host, shape, rule in pages:
        template = place[host, shape][0]
        n, b = common[template]
        middle = (b + 4 * prior) / (n + 4)
        n, b = own[host, template]
        score = (b + 4 * middle) / (n + 4)
        out[i] = (template, pytest.approx(score), rule[1] if rule else "block" if score >= 0.5 else "allow")
    return out


def check(spark, pages):
    data = [(r.page_id, r.url) for r in pages.collect()]
    got = url_filters.judged(pages).collect()
    assert len(got) == len(data)
    urls = dict(data)
    for r in got:
        host, path, rule = ruled(urls[r.id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule[0] if rule else None)
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == rule[1])
        assert r.template is not None and 0 <= r.score <= 1
    want = judged_plainly(data)
    assert {r.id: (r.template, r.score, r.verdict) for r in got} == want


def test_awkward_urls(spark):
    check(spark, spark.createDataFrame([(i, u, "h", "x", "y", 1) for i, u in enumerate(URLS)], SCHEMA))
    assert url_filters.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_pages(spark):
    check(spark, spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert queries.queries()["op4_url_templates"](spark, SMALL).columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


def test_variable_segments_and_merging(spark):
    urls = [f"http://h.org/user/u{i}x/posts/{i}" for i in range(60)] + [f"http://h.org/fr/{i}" for i in range(30)]
    urls += [f"http://b.net/shop/item/{i}.html" for i in range(40)] + [f"http://free.io/shop/item/{i}.html" for i in range(4)]
    urls += [f"http://free.io/fr/{i}" for i in range(4)]
    pages = spark.createDataFrame([(i, u, "h", "x", "y", 1) for i, u in enumerate(urls)], SCHEMA)
    got = {r.id: r for r in url_filters.judged(pages).collect()}
    assert {got[i].template for i in range(60)} == {"/user/*/posts/{n}"}
    by = {u: got[i] for i, u in enumerate(urls)}
    assert by["http://free.io/shop/item/1.html"].verdict == "block"  # the template is blocked elsewhere
    assert by["http://free.io/fr/1"].verdict == "allow"


def test_quality_on_held_out_labels(spark):
    got = queries.queries()["op10_quality_classifier"](spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    mine = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in mine if y], [s for s, y in mine if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in mine]) > 0.9


def plain_features(text):
    """The features by their definitions, with strings and counters."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, lines = len(raw), [x for x in raw.split(b"\n") if x.strip()]
    chars = [bytes([b]) for b in raw]
    share = lambda test, of=n: sum(map(test, chars)) / max(1, of)
    letters = sum(c.isalpha() for c in chars)
    ends = sum(c in b".!?" for c in chars)
    mark = lambda c: c in b"#$%&*+/<=>@[\\]^_`{|}~!"
    of_words = lambda test: sum(map(test, words)) / len(words)
    bigrams = list(zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / len(words), share(bytes.isalpha), share(bytes.isupper, letters), share(bytes.isdigit),
        share(lambda c: c in b" \t\n\r\x0b\x0c"), share(lambda c: c in b".,:;!?'\"-()"), share(lambda c: mark(c) and c != b"!"), share(lambda c: c[0] > 127),
        len(set(words)) / len(words), max(Counter(words).values()) / len(words), 1 - len(set(bigrams)) / len(bigrams) if bigrams else 0.0, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), of_words(lambda w: len(w) == 1), of_words(lambda w: len(w) > 20), sum(mark(a) and mark(b) for a, b in zip(chars, chars[1:])) / n,
        of_words(lambda w: w.isupper() and len(w) > 1), ends / len(words), sum(c == b"|" for c in chars) / len(words), share(lambda c: c in b"<>[]{}"),
        sum(a == b for a, b in zip(chars, chars[1:])) / n, share(lambda c: c in b"aeiou", letters), np.log1p(len(words) / max(1, ends)),
    ]


def plain_scores(model, x):
    """The logistic of the sum of one table entry per feature and per pair, looked up one by one."""
    where = lambda cuts, v: sum(c <= v for c in cuts)
    out = []
    for row in x:
        f = model.base
        for v, cuts, t in zip(row, model.cuts, model.tables, strict=True):
            f += t[where(cuts, v)]
        for i, j, cells in model.pair_tables:
            f += cells[where(model.pair_cuts[i], row[i])][where(model.pair_cuts[j], row[j])]
        out.append(1 / (1 + np.exp(-f)))
    return out


def test_scores_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(150)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "quality label")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs, labels)
    want = dict(zip([i for i, _ in data], plain_scores(model, np.array([plain_features(t) for _, t in data], np.float32).astype(float)), strict=True))
    got = {r.id: r.score for r in quality.fitted_and_scored(docs, labels).collect()}
    assert got == {i: pytest.approx(s, abs=1e-9) for i, s in want.items()}


def plain_tree(g, h, leaves=3):
    """The best split again and again, every cut tried."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        tries = [(value(a, m) + value(m, b) - value(a, b), a, b, m) for a, b in parts for m in range(a + 1, b) if sum(h[a:m]) >= 1 and sum(h[m:b]) >= 1]
        gain, a, b, m = max(tries, default=(0, 0, 0, 0))
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    return [next(sum(g[a:b]) / (sum(h[a:b]) + 1) for a, b in parts if a <= i < b) for i in range(len(g))]


def test_boosting_against_plain_rounds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    model = quality.AdditiveModel(rounds=5, pair_rounds=0, bins=8).fit(x, y)
    f = np.full(200, np.log((y.sum() + 1) / (202 - y.sum() - 1)))
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]
    at = [[sum(c <= v for c in cuts) for v in x[:, j]] for j, cuts in enumerate(model.cuts)]
    for _ in range(5):
        for j, t in enumerate(tables):
            p = 1 / (1 + np.exp(-f))
            g, h = [0.0] * len(t), [0.0] * len(t)
            for b, e, w in zip(at[j], y - p, p * (1 - p), strict=True):
                g[b] += e
                h[b] += w
            move = [0.08 * v for v in plain_tree(g, h)]
            tables[j] = [a + b for a, b in zip(t, move, strict=True)]
            f = f + np.array([move[b] for b in at[j]])
    for got, want in zip(model.tables, tables, strict=True):
        assert got == pytest.approx(want)


def test_labels_held_out_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "quality label")
    flipped = labels.withColumn("label", quality.F.when(quality.held_out(labels.doc_id), 1 - labels.label).otherwise(labels.label))
    a, b = (sorted(map(tuple, quality.fitted_and_scored(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_awkward_texts_are_scored(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, None, None), (None, 1, None)], "doc_id long, label int, text string")
    for given in (labels, labels.limit(0), labels.where("label = 1")):
        got = quality.fitted_and_scored(docs, given).collect()
        assert len(got) == docs.count() and all(0 < r.score < 1 for r in got)
    assert quality.fitted_and_scored(docs.limit(0), labels).count() == 0


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.AdditiveModel(rounds=20, pair_rounds=80, pairs=2).fit(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.85


def test_branches_below_the_fourth_level(spark):
    at = "https://example.com/a/b/c/d/e/f/g"
    rules = (("example.com/a/b/c/d/e/f/g/bad/", "block"), ("example.com/a/b/c/d/e/f/g/good/", "allow"))
    urls = [f"{at}/{kind}/x{i}" for kind in ("bad", "good") for i in range(30)] + [at, f"{at}/bad", f"{at}/good"]
    pages = spark.createDataFrame([(i, u, "h", "x", "y", 1) for i, u in enumerate(urls)], SCHEMA)
    got = {urls[r.id]: r for r in url_filters.judged(pages, rules).collect()}
    assert got[f"{at}/bad/x1"].template == "/a/b/c/d/e/f/g/bad/*" and got[f"{at}/good/x1"].template == "/a/b/c/d/e/f/g/good/*"
    assert got[f"{at}/bad/x1"].score > 0.5 > got[f"{at}/good/x1"].score
    assert len(got) == len(urls) and got[at].template == "/a/b/c/d/e/f/g"
