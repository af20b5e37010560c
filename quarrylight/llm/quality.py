"""Quality scores by a generalised additive model with pairwise interactions.

Every text gives a row of numeric features, taken from its whole bytes and words.
Each feature is binned at quantiles of the training rows.  Training is cyclic
boosting: round after round visits one feature after another, fits a shallow
regression tree over that feature's bins to the gradient of the log loss and adds
a small step of it to the feature's lookup table.  Pairs of features come next:
the pairs whose two-way cells explain most of what is left get tables of their
own, boosted the same way.  A score is the logistic of the sum of one table entry
per feature and per pair, so scoring is binning and additions over arrays.

Labels are learnt only from rows whose crc32 of the id as text, modulo 3, is not
1.  The fit takes at most ``max_rows`` of these, those with the smallest hash of
their id, so its memory on the driver has a bound; the model is some tables of
fixed size.  Ids, language, source and labels are no features.

Defined results: null and empty texts are scored like any other (their features
are zero); without any labelled training row, or with labels of one kind alone,
every score is the smoothed share of label 1; an id with several labels counts
each once; of several texts of one id one is learnt from; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 20_000
FEATURES = (
    "log_bytes log_words log_lines mean_word letter upper digit space punct symbol high "
    "distinct_words top_word repeated_bigrams repeated_lines mean_line one_letter long_words "
    "double_marks caps_words end_marks pipes brackets repeated_chars short_vowels mean_sentence"
).split()

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SPACE, _PUNCT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"-()"]] = True
_MARK[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def features(text: str | None) -> np.ndarray:
    """The features of a whole text."""
    out = np.zeros(len(FEATURES), np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    data = np.frombuffer(raw, np.uint8)
    count = np.bincount(data, minlength=256)
    n, lengths = len(raw), np.fromiter(map(len, words), np.int64, len(words))
    letters = count[_UPPER].sum() + count[_LOWER].sum()
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bigrams = len(words) - 1
    marks = _MARK[data] | (data == 33)
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    ends = count[[46, 33, 63]].sum()
    per = lambda x, of=n: float(x) / max(1, of)
    out[:] = (
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        lengths.mean(),
        per(letters),
        per(count[_UPPER].sum(), letters),
        per(count[_DIGIT].sum()),
        per(count[_SPACE].sum()),
        per(count[_PUNCT].sum()),
        per(count[_MARK].sum()),
        per(count[128:].sum()),
        per(len(tally), len(words)),
        per(max(tally.values()), len(words)),
        1 - per(len(set(zip(words, words[1:], strict=False))), bigrams) if bigrams else 0.0,
        1 - per(len(set(lines)), len(lines)),
        np.log1p(per(n, len(lines))),
        per((lengths == 1).sum(), len(words)),
        per((lengths > 20).sum(), len(words)),
        per((marks[1:] & marks[:-1]).sum()),
        per(caps, len(words)),
        per(ends, len(words)),
        per(count[124], len(words)),
        per(count[[60, 62, 91, 93, 123, 125]].sum()),
        per((data[1:] == data[:-1]).sum()),
        per(count[[97, 101, 105, 111, 117]].sum(), letters),
        np.log1p(per(len(words), max(1, ends))),
    )
    return out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf values of a shallow regression tree over ordered bins: the best split is added until there are ``leaves``."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    def best(a: int, b: int):
        mids = np.arange(a + 1, b)
        mids = mids[(h[mids] - h[a] >= least) & (h[b] - h[mids] >= least)]
        if not len(mids):
            return (0.0, a, b, a)
        gains = gain_of(a, mids) + gain_of(mids, b) - gain_of(a, b)
        k = int(np.argmax(gains))
        return (float(gains[k]), a, b, int(mids[k]))

    parts = [best(0, len(gradient))]
    while len(parts) < leaves:
        top = max(parts)
        if top[0] <= 1e-9:
            break
        parts.remove(top)
        parts += [best(top[1], top[3]), best(top[3], top[2])]
    out = np.zeros(len(gradient))
    for _, a, b, _ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    bins: int = 48
    pair_bins: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    rate: float = 0.08
    leaves: int = 3
    base: float = 0.0
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_cuts: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)  # (first, second, table)

    def _bin(self, x: np.ndarray, cuts: list) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            return self
        d = x.shape[1]
        self.cuts = [_cuts(x[:, j], self.bins) for j in range(d)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        at, f = self._bin(x, self.cuts), np.full(len(y), self.base)

        def step(where: np.ndarray, size: int):
            p = 1 / (1 + np.exp(-f))
            return np.bincount(where, y - p, size), np.bincount(where, p * (1 - p), size)

        for _ in range(self.rounds):
            for j in range(d):
                move = self.rate * _tree(*step(at[:, j], len(self.tables[j])), self.leaves, 1.0)
                self.tables[j] += move
                f += move[at[:, j]]
        self.pair_cuts = [_cuts(x[:, j], self.pair_bins) for j in range(d)]
        coarse = self._bin(x, self.pair_cuts)
        width = [len(c) + 1 for c in self.pair_cuts]
        ranked = []
        for i in range(d):
            for j in range(i):
                g, h = step(coarse[:, i] * width[j] + coarse[:, j], width[i] * width[j])
                ranked.append((float((g * g / (h + 5.0)).sum()), i, j))
        for _, i, j in sorted(ranked, reverse=True)[: self.pairs]:
            self.pair_tables.append((i, j, np.zeros((width[i], width[j]))))
        for _ in range(self.pair_rounds):
            for i, j, cells in self.pair_tables:
                where = coarse[:, i] * width[j] + coarse[:, j]
                g, h = (v.reshape(cells.shape) for v in step(where, cells.size))
                # A tree of depth two: the better feature splits first, then each side along the other.
                move = self.rate * self._pair_tree(g, h)
                cells += move
                f += move[coarse[:, i], coarse[:, j]]
        return self

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        found = []
        for flip in (False, True):
            a, b = (g.T, h.T) if flip else (g, h)
            first = _tree(a.sum(axis=1), b.sum(axis=1), 2, 1.0)
            out, gain = np.zeros(a.shape), 0.0
            for v in np.unique(first):
                side = first == v
                values = _tree(a[side].sum(axis=0), b[side].sum(axis=0), 2, 1.0)
                out[side] = values
                gain += float((values * a[side].sum(axis=0)).sum())
            found.append((gain, flip, out.T if flip else out))
        return max(found, key=lambda t: t[:2])[2]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.tables:
            at = self._bin(x, self.cuts)
            for j, t in enumerate(self.tables):
                f += t[at[:, j]]
            coarse = self._bin(x, self.pair_cuts)
            for i, j, cells in self.pair_tables:
                f += cells[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-f))


def held_out(id_col: Column) -> Column:
    """Whether labels of this id are kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> AdditiveModel:
    """The model of at most ``max_rows`` labelled rows, none of them held out."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label"))
        .dropDuplicates()
        .orderBy(F.xxhash64("of"), "of", "label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), texts["id"] == chosen["of"]).select("id", "label", "text")

    def run(batches):
        for batch in batches:
            x = np.stack([features(t) for t in batch.column(2).to_pylist()]) if batch.num_rows else np.zeros((0, len(FEATURES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "label", "x"])

    each = joined.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, label int, x binary")
    rows = each.groupBy("id", "label").agg(F.min("x").alias("x")).select("label", "x").toPandas()  # as many as chosen labels at most
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), len(FEATURES)).astype(float)
    y = rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of arrival
    return AdditiveModel().fit(x[order], y[order])


def scored(docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``, which must be a new name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    at = docs.columns.index(text_col)

    def run(batches):
        tool = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = np.stack([features(t) for t in texts]).astype(float) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tool.score(x))], [*names, score_col])

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fitted_and_scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``held_out``, ``score`` for every row of ``docs``."""
    model = fit(docs, labels, max_rows, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    at_once = scored(rows, model)
    return at_once.select("id", held_out(F.col("id")).alias("held_out"), "score")
