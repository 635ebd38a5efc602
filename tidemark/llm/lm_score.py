"""Language-model scoring by a weighted backoff automaton.

The model is a Witten-Bell smoothed n-gram model over a fixed alphabet of 64 symbols to which every code
point is folded, counted over the whole corpus.  Its contexts are states.  A state's arcs carry the
log-probabilities of the symbols seen after it; its failure arc leads to the context without its first
symbol at the weight of backing off.  A text is read once from left to right: the automaton takes
the arc for the next symbol, or failure arcs until there is one, and adds up the weights.

After order - 1 symbols the state depends on those symbols only, so a long text is read in segments,
each warmed up on the symbols before it, and many segments advance in step as arrays.  The fixed alphabet
bounds what is broadcast: 64**order arcs at most, whatever the corpus.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text

ORDER = 4
SYMBOLS = 64
SEGMENT = 1024


@functools.lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point: 0 is kept for the ends of a text, 1 space, 2-27 letters, 28 digits,
    29 full stop, 30 comma, 31 other signs, 32-63 other letters, spread by their code."""
    from .common import alnum_table

    code = np.arange(0x110000, dtype=np.uint32)
    table = np.full(len(code), 31, dtype=np.uint8)
    letters = alnum_table()
    table[letters] = 32 + ((code[letters] * np.uint32(2654435761)) >> np.uint32(27))
    table[[9, 10, 11, 12, 13, 32, 0xA0, 0x2028, 0x2029, 0x3000]] = 1
    table[ord("a") : ord("z") + 1] = np.arange(2, 28)
    table[ord("A") : ord("Z") + 1] = np.arange(2, 28)
    table[ord("0") : ord("9") + 1] = 28
    table[ord(".")], table[ord(",")] = 29, 30
    return table


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts with order - 1 end symbols, at least one, before each and after the last, where each
    text starts, how many symbols it has with the end symbol after it)."""
    lowered = [t.lower() for t in texts]
    pad = max(1, order - 1)
    n = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    flat = symbol_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)]
    out = np.zeros(int(n.sum()) + pad * (len(n) + 1), dtype=np.uint8)
    starts = np.append(0, np.cumsum(n + pad))[:-1] + pad if len(n) else np.empty(0, np.int64)
    where = np.ones(len(out), dtype=bool)
    for i in range(1, pad + 1):
        where[starts - i] = False
    where[len(out) - pad :] = False
    out[where] = flat
    return out, starts, n + 1


def gram_codes(sym: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The code of the n-gram that ends at each symbol of each text."""
    code = np.zeros(len(sym), dtype=np.int32)
    for i in range(order):
        code[order - 1 :] += sym[order - 1 - i : len(sym) - i].astype(np.int32) << (6 * i)
    keep = np.zeros(len(sym) + 1, dtype=np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + counts, -1)
    return code[np.cumsum(keep[:-1]) > 0]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _count(order: int):
    def run(batches):
        import pyarrow as pa

        from .common import chunked

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in chunked(texts):
                parts.append(np.unique(gram_codes(*symbols(texts[a:z], order), order), return_counts=True))
                if len(parts) > 16:
                    parts = [_merge(parts)]
        if parts:
            codes, counts = _merge(parts)
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000], pa.int32()), pa.array(counts[i : i + 100_000], pa.int64())], names=["code", "n"])

    return run


@dataclass
class Automaton:
    """States are numbered by the length of their context, then its code."""

    order: int
    keys: np.ndarray  # sorted: state * SYMBOLS + symbol of each arc
    weight: np.ndarray  # its log-probability
    target: np.ndarray  # the state that it leads to
    fail: np.ndarray  # the state that each state fails to
    backoff: np.ndarray  # and the weight of doing so

    def table(self) -> np.ndarray:
        """The arc of each (state, symbol), -1 where it fails."""
        slot = np.full(len(self.fail) * SYMBOLS, -1, dtype=np.int32)
        slot[self.keys] = np.arange(len(self.keys), dtype=np.int32)
        return slot


def build_automaton(codes: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Automaton:
    """The automaton of full-length n-gram counts; shorter contexts' counts are their sums."""
    base = np.cumsum([0] + [SYMBOLS**k for k in range(order)])  # the first state of each context length
    states = int(base[order])
    fail, backoff = np.zeros(states, dtype=np.int32), np.zeros(states)
    known = np.zeros(states, dtype=bool)
    known[0] = True
    level: list[tuple[np.ndarray, np.ndarray]] = []
    codes = codes.astype(np.int64)
    for k in range(order):  # contexts of length k: the last k + 1 symbols of each gram
        level.append(_merge([(codes % SYMBOLS ** (k + 1), counts)]) if len(codes) else (np.empty(0, np.int64), np.empty(0, np.int64)))
        known[base[k] + np.unique(level[k][0] // SYMBOLS)] = True
    # lower probabilities by (context code, symbol), from the uniform one up
    below = np.full(SYMBOLS, 1 / SYMBOLS)
    keys, weights = [], []
    for k in range(order):
        grams, n = level[k]
        context, sym = grams // SYMBOLS, grams % SYMBOLS
        total = np.bincount(context, n, SYMBOLS**k)
        kinds = np.bincount(context, minlength=SYMBOLS**k)
        spare = np.where(total > 0, kinds / np.maximum(1, total + kinds), 1.0)
        backoff[base[k] : base[k + 1]] = np.log(spare)
        shorter = np.arange(SYMBOLS**k) % max(1, SYMBOLS ** (k - 1))
        fail[base[k] : base[k + 1]] = base[k - 1] + shorter if k else 0
        lower = below[grams % max(1, SYMBOLS**k) if k else sym]
        p = (n + kinds[context] * lower) / (total[context] + kinds[context])
        if k == 0:  # the root has an arc for every symbol
            full = below * spare[0]
            full[sym] = p
            keys.append(np.arange(SYMBOLS))
            weights.append(np.log(full))
            below = full
        else:
            keys.append((base[k] + context) * SYMBOLS + sym)
            weights.append(np.log(p))
            if k < order - 1:
                dense = below[np.arange(SYMBOLS ** (k + 1)) % SYMBOLS**k] * np.repeat(spare, SYMBOLS)
                dense[grams] = p
                below = dense
    key, weight = np.concatenate(keys), np.concatenate(weights)
    state, sym = key // SYMBOLS, key % SYMBOLS
    length = np.searchsorted(base, state, side="right") - 1
    string = (state - base[length]) * SYMBOLS + sym  # of length + 1 symbols
    target = np.zeros(len(key), dtype=np.int32)
    todo = np.ones(len(key), dtype=bool)
    for k in range(order - 1, 0, -1):  # the longest known context that is a suffix
        s = base[k] + string % SYMBOLS**k
        hit = todo & (length + 1 >= k) & known[s]
        target[hit], todo[hit] = s[hit], False
    at = np.argsort(key)
    return Automaton(order, key[at], weight[at], target[at], fail, backoff)


def traverse(auto: Automaton, slot: np.ndarray, sym: np.ndarray, starts: np.ndarray, counts: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The log-probability of each text, all its segments in step."""
    pieces = -(-counts // segment)
    text = np.repeat(np.arange(len(counts)), pieces)
    offset = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * segment
    first, size = starts[text] + offset, np.minimum(segment, counts[text] - offset)
    order = np.argsort(-size, kind="stable")
    text, first, size = text[order], first[order], size[order]
    state, score = np.zeros(len(text), dtype=np.int64), np.zeros(len(text))
    warm = auto.order - 1
    for step in range(-warm, int(size[0]) if len(size) else -warm):
        live = len(size) if step < 0 else int(np.searchsorted(-size, -step, side="left"))
        s = sym[first[:live] + step].astype(np.int64)
        at = state[:live]
        arc = slot[at * SYMBOLS + s]
        gain = np.zeros(live)
        lost = np.flatnonzero(arc < 0)
        while len(lost):
            gain[lost] += auto.backoff[at[lost]]
            at[lost] = auto.fail[at[lost]]
            arc[lost] = slot[at[lost] * SYMBOLS + s[lost]]
            lost = lost[arc[lost] < 0]
        state[:live] = auto.target[arc]
        if step >= 0:
            score[:live] += gain + auto.weight[arc]
    return np.bincount(text, score, len(counts))


def fit_lm(docs: DataFrame, order: int = ORDER) -> Automaton:
    """The automaton over all rows with an id and a text."""
    counted = doc_text(docs).select("text").mapInArrow(_count(order), "code int, n long")
    got = counted.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return build_automaton(got.column("code").to_numpy(), got.column("n").to_numpy(), order)


def score_lm(docs: DataFrame, auto: Automaton) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def run(batches):
        import pyarrow as pa

        from .common import chunked

        own = shared.value
        slot = own.table()
        for b in batches:
            texts = b.column(1).to_pylist()
            n, score = [np.empty(0, np.int64)], [np.empty(0)]
            for a, z in chunked(texts, 4 << 20):
                sym, starts, counts = symbols(texts[a:z], own.order)
                n.append(counts)
                score.append(traverse(own, slot, sym, starts, counts))
            n, score = np.concatenate(n), np.concatenate(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(score), pa.array(np.exp(-score / n))], names=["doc_id", "symbols", "log_prob", "perplexity"])

    return doc_text(docs).mapInArrow(run, "doc_id long, symbols long, log_prob double, perplexity double")


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, symbols, log_prob, perplexity) of each document under the model of all of them.

    symbols counts the end of the text, which is predicted, too, so an empty text has one.  Rows with a null id
    or text are left out; rows that repeat count each time and are scored each time.  An empty table gives no
    rows.  Other columns are ignored.
    """
    return score_lm(docs, fit_lm(docs, order))
