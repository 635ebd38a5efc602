"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins.  Boosting goes round the features in turn; each step fits a
shallow tree on one feature's bins (then, for the strongest pairs, one cut on each of two features)
to the gradients and adds its leaves to that feature's lookup table, so a trained model is only
tables.  A document's score is an intercept plus one table entry a feature and a pair, summed by
vectorised indexing.  Two such models, of low quality and of toxicity, share the features and bins.

The models are trained on at most ``sample`` labelled documents, taken in the order of a hash of the
id.  The sample's distinct texts give the evidence (words, and heads of words, that speak for a toxic or a poor
text, by smoothed log-odds), cross-fitted by folds, then bins and tables.  Everything else reads all rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text

SAMPLE = 20_000
BINS = 64
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
FOLDS = 4
RATE = 0.2
#: A document is rejected if either model gives a probability of at least this.
CUT = 0.5

FEATURES = [
    "log_words", "mean_word", "letters", "digits", "upper", "symbols", "space", "lines",
    "symbol_runs", "distinct_words", "top_word", "repeats", "long_words", "short_words",
    *(f"{label}_{unit}_{what}" for label in ("toxic", "poor") for unit in ("word", "head") for what in ("max", "share", "count")),
]
#: Where the features of evidence begin.
SHAPE = 14
#: What a word's evidence is kept for: the whole word, and its first code points.
UNITS = (None, 5)
Evidence = list[tuple[np.ndarray, np.ndarray]]


@functools.lru_cache(1)
def capital_table() -> np.ndarray:
    """Whether each code point changes when it is lower-cased."""
    return np.fromiter((chr(i).lower() != chr(i) for i in range(0x110000)), dtype=bool, count=0x110000)


def features(texts: list[str], evidence: Evidence) -> np.ndarray:
    """A row a text.  evidence: sorted hashes and their log-odds, of toxic and then of poor texts, for each of UNITS.
    An empty text gives zeros."""
    from .common import SMALL, TextChunk, alnum_table, chunked

    out = np.zeros((len(texts), len(FEATURES)))
    for first, last in chunked(texts, SMALL):
        c = TextChunk(texts[first:last])
        raw = np.frombuffer("".join(texts[first:last]).encode("utf-32-le", "replace"), dtype=np.uint32)
        raw_size = np.fromiter(map(len, texts[first:last]), dtype=np.int64, count=last - first)
        x = out[first:last]
        n = np.maximum(1, c.ends - c.starts)

        def share(flags, starts=c.starts, of=n):
            total = np.append(0, np.cumsum(flags))
            return (total[np.append(starts[1:], len(flags))] - total[starts]) / of

        word, blank = alnum_table()[c.codes], (c.codes == 32) | (c.codes == 10)
        digit, symbol = (c.codes >= 48) & (c.codes <= 57), ~word & ~blank
        nw = np.diff(c.wfirst)
        some = np.maximum(1, nw)
        x[:, 0] = np.log1p(nw)
        size = c.wend - c.wstart

        def by_word(values):
            total = np.append(0, np.cumsum(values))
            return (total[c.wfirst[1:]] - total[c.wfirst[:-1]]) / some

        x[:, 1], x[:, 2], x[:, 3] = by_word(size), share(word & ~digit), share(digit)
        capitals = np.append(0, np.cumsum(capital_table()[raw]))
        ends = np.cumsum(raw_size)
        x[:, 4] = (capitals[ends] - capitals[ends - raw_size]) / np.maximum(1, raw_size)
        x[:, 5], x[:, 6], x[:, 7] = share(symbol), share(blank), share(c.codes == 10)
        x[:, 8] = share(np.append(False, symbol[1:] & symbol[:-1]))
        text_of = np.repeat(np.arange(len(nw)), nw)
        order = np.lexsort((c.whash, text_of))
        h, t = c.whash[order], text_of[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)])
        run = np.diff(np.append(new, len(h)))
        x[:, 9] = np.bincount(t[new], minlength=len(nw)) / some
        top = np.zeros(len(nw))
        np.maximum.at(top, t[new], run)
        x[:, 10] = top / some
        same = np.append(False, (c.whash[1:] == c.whash[:-1]) & (text_of[1:] == text_of[:-1]))[: len(c.whash)]
        x[:, 11], x[:, 12], x[:, 13] = by_word(same), by_word(size > 15), by_word(size <= 2)
        hashes = [c.whash if n is None else c.heads(n) for n in UNITS]
        for i, (keys, weight) in enumerate(evidence):
            own = hashes[i % len(UNITS)]
            if len(keys) and len(own):
                pos = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                found = np.where(keys[pos] == own, weight[pos], 0.0)
                most = np.zeros(len(nw))
                np.maximum.at(most, text_of, found)
                at = SHAPE + 3 * i
                # summed text by text: a running sum would round by what stands before it in the batch
                x[:, at], x[:, at + 1] = most, np.bincount(text_of, found, len(nw)) / some
                x[:, at + 2] = np.log1p(np.bincount(text_of, found > 0, len(nw)))
        x[nw == 0, 1:] = 0
    return out


class WordCounts:
    """In how many texts of each label and fold each word, or head of so many code points, stands."""

    def __init__(self, texts: list[str], marks: list[np.ndarray], folds: int, head: int | None = None):
        from .common import SMALL, TextChunk, chunked

        fold = np.arange(len(texts)) % folds
        # counts are added up as texts are read: the places of all words would take far more memory
        parts = [(np.empty(0, np.uint64), np.zeros((0, 1 + len(marks), folds), np.int32))]
        for a, b in chunked(texts, SMALL):
            c = TextChunk(texts[a:b])
            hashes = c.heads(head)
            own = [np.unique(hashes[c.wfirst[i] : c.wfirst[i + 1]]) for i in range(b - a)]
            ids, flat = np.unique(np.concatenate(own), return_inverse=True)
            row = np.repeat(np.arange(a, b), [len(x) for x in own])
            at = flat * folds + fold[row]
            count = lambda w: np.bincount(at, w, len(ids) * folds).reshape(-1, folds)  # noqa: B023, E731
            parts.append((ids, np.stack([count(None), *(count(m[row]) for m in marks)], axis=1).astype(np.int32)))
            if len(parts) > 32:
                parts = [self._merged(parts)]
        self.ids, counts = self._merged(parts)
        self.all = counts[:, 0].astype(np.int64)
        self.yes = [counts[:, 1 + i].astype(float) for i in range(len(marks))]
        self.size = np.bincount(fold, minlength=folds)
        self.sizes = [np.bincount(fold, m, folds) for m in marks]

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.unique(np.concatenate([p[0] for p in parts]))
        out = np.zeros((len(ids), *parts[0][1].shape[1:]), np.int32)
        for own, counts in parts:
            out[np.searchsorted(ids, own)] += counts
        return ids, out

    def evidence(self, mark: int, without: int | None = None, least: int = 3, z: float = 3.5) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and smoothed log-odds of the words that stand in at least ``least`` texts of the label
        and whose log-odds exceed z standard errors, from all folds or all but one."""
        use = np.array([k != without for k in range(len(self.size))])
        yes, ys = self.yes[mark][:, use].sum(axis=1), self.sizes[mark][use].sum()
        no, ns = self.all[:, use].sum(axis=1) - yes, self.size[use].sum() - ys
        odds = np.log((yes + 0.5) / (ys - yes + 0.5)) - np.log((no + 0.5) / (ns - no + 0.5))
        error = np.sqrt(1 / (yes + 0.5) + 1 / (ys - yes + 0.5) + 1 / (no + 0.5) + 1 / (ns - no + 0.5))
        good = (yes >= least) & (odds > z * error)
        return self.ids[good], odds[good]


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each feature, at quantiles of its distinct places."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) if len(col) else np.empty(0)
        distinct = np.unique(col)
        if len(distinct) <= bins:
            q = (distinct[1:] + distinct[:-1]) / 2
        out.append(q)
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def _leaf(g, h, ridge=1.0):
    return g / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, least: float = 2.0) -> np.ndarray:
    """A value a bin: greedy cuts of the bins' line into at most so many leaves, from gradient and hessian sums."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    parts = [(0, len(g))]

    def gain(a, z):
        if z - a < 2:
            return -1.0, a
        m = np.arange(a + 1, z)
        gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[z] - cg[m], ch[z] - ch[m]
        s = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + 1)
        s[(hl < least) | (hr < least)] = -1
        i = int(np.argmax(s))
        return float(s[i]), int(m[i])

    while len(parts) < leaves:
        best = max(((*gain(a, z), a, z) for a, z in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        parts.remove(best[2:])
        parts += [(best[2], best[1]), (best[1], best[3])]
    value = np.zeros(len(g))
    for a, z in parts:
        value[a:z] = _leaf(cg[z] - cg[a], ch[z] - ch[a])
    return value


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, a value a cell): the best cut on each of two features together, four leaves."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    tg, th = G[-1, -1], H[-1, -1]
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    a, ha = G[:-1, :-1], H[:-1, :-1]
    b, hb = G[:-1, -1:] - a, H[:-1, -1:] - ha
    c, hc = G[-1:, :-1] - a, H[-1:, :-1] - ha
    d, hd = tg - a - b - c, th - ha - hb - hc
    gain = a**2 / (ha + 1) + b**2 / (hb + 1) + c**2 / (hc + 1) + d**2 / (hd + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.empty_like(g)
    for rows, cols, gg, hh in (
        (slice(0, i + 1), slice(0, j + 1), a, ha), (slice(0, i + 1), slice(j + 1, None), b, hb),
        (slice(i + 1, None), slice(0, j + 1), c, hc), (slice(i + 1, None), slice(j + 1, None), d, hd),
    ):
        value[rows, cols] = _leaf(gg[i, j], hh[i, j])
    return float(gain[i, j] - tg**2 / (th + 1)), value


@dataclass
class Gam:
    """An intercept, a table a feature and a table a pair of features, all of log-odds."""

    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for i, j, t in self.pairs:
            out += t[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-out))


def train(bins: np.ndarray, sizes: list[int], y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Gam:
    """Cyclic boosting on logistic loss.  Without rows of both classes the model is its intercept."""
    n, p = len(y), (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(p / (1 - p))), [np.zeros(s) for s in sizes])
    if n == 0 or y.min() == y.max():
        return model
    f = np.full(n, model.intercept)

    def slope():
        q = 1 / (1 + np.exp(-f))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for i, s in enumerate(sizes):
            g, h = slope()
            step = rate * shallow_tree(np.bincount(bins[:, i], g, s), np.bincount(bins[:, i], h, s))
            model.tables[i] += step
            f += step[bins[:, i]]
    g, h = slope()
    cell = lambda i, j, w: np.bincount(bins[:, i] * sizes[j] + bins[:, j], w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    ranked = sorted(((pair_tree(cell(i, j, g), cell(i, j, h))[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slope()
            step = rate * pair_tree(cell(i, j, g), cell(i, j, h))[1]
            t += step
            f += step[bins[:, i], bins[:, j]]
    return model


@dataclass
class QualityModel:
    evidence: Evidence
    edges: list[np.ndarray]
    poor: Gam
    toxic: Gam

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of low quality and of toxicity."""
        bins = to_bins(features(texts, self.evidence), self.edges)
        return self.poor.score(bins), self.toxic.score(bins)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(h, text_hash, text, poor, toxic) of at most ``sample`` labelled documents, in the order of a hash of the id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 0).alias("poor"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("label_id is not null and (poor is not null or toxic is not null)")
    marks = marks.groupBy("label_id").agg(F.coalesce(F.max("poor"), F.lit(False)).alias("poor"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    chosen = marks.withColumn("h", F.xxhash64("label_id")).orderBy("h", "label_id").limit(sample)
    base = doc_text(docs)
    return base.join(F.broadcast(chosen), base["doc_id"] == chosen["label_id"]).select("h", F.xxhash64("text").alias("text_hash"), "text", "poor", "toxic")


def fit_rows(rows: list[tuple[str, bool, bool]], folds: int = FOLDS) -> QualityModel:
    """A model from distinct (text, poor, toxic).  The tables see each text with the word evidence of the
    other folds only, so words peculiar to it don't count for it; the final evidence is that of all."""
    texts = [r[0] for r in rows]
    poor, toxic = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    counts = [WordCounts(texts, [toxic, poor], folds, n) for n in UNITS]
    evidence = lambda without: [c.evidence(mark, without) for mark in (0, 1) for c in counts]
    x = np.zeros((len(rows), len(FEATURES)))
    for k in range(folds):
        x[k::folds] = features(texts[k::folds], evidence(k))
    edges = bin_edges(x)
    bins, sizes = to_bins(x, edges), [len(e) + 1 for e in edges]
    return QualityModel(evidence(None), edges, train(bins, sizes, poor), train(bins, sizes, toxic))


def _fit_batches(batches):
    """One task: the bounded sample in, the pickled model out."""
    import pickle

    import pyarrow as pa

    from .common import lean_memory

    lean_memory()
    seen = {}
    for b in batches:
        for i in range(0, len(b), 1000):
            for h, k, text, poor, toxic in zip(*(c.to_pylist() for c in b.slice(i, 1000).columns)):
                if k not in seen or h < seen[k][0]:
                    seen[k] = (h, text, poor, toxic)
    if seen:
        model = fit_rows([x[1:] for _, x in sorted(seen.items())])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """The trained model, pickled: some hundred KB, whatever the size of docs."""
    import pickle

    # repartition, not coalesce: documents are read by all tasks, and only the bounded sample comes to one
    got = labelled_sample(docs, labels, sample).repartition(1).mapInArrow(_fit_batches, "model binary").collect()
    if not got:
        none = [(np.empty(0, np.uint64), np.empty(0))] * (2 * len(UNITS))
        flat = [np.empty(0) for _ in FEATURES]
        empty = train(np.zeros((0, len(FEATURES)), int), [1] * len(FEATURES), np.empty(0))
        empty.intercept = -10.0  # nothing to learn from: nothing is rejected
        return pickle.dumps(QualityModel(none, flat, empty, empty))
    return bytes(got[0].model)


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, p_poor, p_toxic, keep) of every row with an id and a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pickle

        import pyarrow as pa

        from .common import SLICE_BYTES, lean_memory, text_slices

        lean_memory()
        own = pickle.loads(shared.value)
        for a, texts, b in ((a, texts, b) for b in batches for a, texts in text_slices(b.column(1), SLICE_BYTES)):
            poor, toxic = own.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(a, len(texts)), pa.array(poor), pa.array(toxic), pa.array((poor < CUT) & (toxic < CUT))], names=["doc_id", "p_poor", "p_toxic", "keep"]
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, p_poor double, p_toxic double, keep boolean")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_poor, p_toxic) of each document that the classifier accepts.

    A row that repeats is scored each time.  An empty text has all features 0 and is scored as such.
    Rows with a null id or text are not scored.  Labels that are null count as absent; without any
    labelled text nothing is rejected.  Other columns are ignored.
    """
    return score_documents(docs, fit_quality_model(docs, labels, sample)).where("keep").drop("keep")


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rejected rows, all columns; rows with a null id or text stay.

    Scores travel with the rows, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality_model(docs, labels, sample))
    place = docs.columns.index("text")

    def run(batches):
        import pickle

        import pyarrow as pa
        import pyarrow.compute as pc

        from .common import SLICE_BYTES, lean_memory, text_slices

        lean_memory()
        own = pickle.loads(shared.value)
        for b in batches:
            for a, texts in text_slices(pc.fill_null(b.column(place), ""), SLICE_BYTES):
                some = b.slice(a, len(texts))
                there = pc.is_valid(some.column(place)).to_numpy(zero_copy_only=False)
                poor, toxic = own.predict(texts)
                yield some.filter(pa.array(~there | ((poor < CUT) & (toxic < CUT))))

    return docs.mapInArrow(run, docs.schema)
