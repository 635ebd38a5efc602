"""Language-model scoring over words by a weighted backoff automaton whose states stay in shards.

The model is a Witten-Bell smoothed bigram model over the corpus's own open vocabulary: a token is a run of letters
and digits, or any other sign that isn't space, as written; nothing is folded.  Its states are the root and the words.
A word's arcs are the bigrams seen, each with its log-probability and the state that it leads to; its failure arc leads
to the root at the weight of backing off, and the root has an arc for every word.  A text is read from left to right:
the automaton takes the arc for the next token, or the failure arc and then the root's, and adds up the weights.

The automaton follows the corpus, so no table of it is broadcast or sent to the driver.  Texts are coded once, a chunk
of about CHUNK_BYTES at a time.  Each chunk sends its distinct arcs with their counts to the shards of the states they
leave, which add them up and send back to each chunk the counts of the states and arcs it asked for.  From these the
chunk builds the part of the automaton that its texts walk through, and walks.  The arcs of a frequent word are spread over
all shards, and its sums are the only ones that the driver sees; which words these are is estimated from some of the rows and
changes where arcs are counted, not what is counted.  Each arc moves once to its shard and once back, whatever
the number of shards, and messages are cut out of whole arrays, so the work a byte of text stays as the corpus grows.

Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextChunk, doc_text, find, lean_memory, materialize, mix64, slice_bounds, text_slices

#: Bytes of text whose arcs make one shard, about.
SHARD_BYTES = 16 << 20
#: Bytes of texts that make a chunk, and that are cut into words at a time.
CHUNK_BYTES, CUT_BYTES = 8 << 20, 1 << 18
#: Places walked through at a time.
STEP = 1 << 19
#: Frequent words are looked for in about so many bytes of text, or in one row of SAMPLE_STEP if that is more.
SAMPLE_BYTES, SAMPLE_STEP = 64 << 20, 64
#: The token at both ends of a text.
END = np.uint64(0)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' tokens, how many each text has)."""
    chunk = TextChunk(texts, lower=False, signs=True)
    return chunk.whash, np.diff(chunk.wfirst)


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, text) of every place; the end of a text is one."""
    h, n = tokens(texts)
    at = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    token = np.full(len(at), END, dtype=np.uint64)
    inner = np.ones(len(at), dtype=bool)
    inner[last] = False
    token[inner] = h
    before = np.append(END, token[:-1])  # a text's last token is END, and so is what stands before the next one
    return before, token, at


def _vocabulary(batches):
    import pyarrow as pa

    lean_memory()
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def flush():
        keys, n = merged()
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["w", "n"])

    for b in batches:
        for _, texts in text_slices(b.column(0), CUT_BYTES):
            parts.append(np.unique(places(texts)[1], return_counts=True))
            if len(parts) > 64:
                parts = [merged()]
                if len(parts[0][0]) > 1_000_000:
                    yield from flush()
                    parts = []
    if parts:
        yield from flush()


def ordered(key: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, the order that sorts them) of keys below kinds."""
    bits = max(1, len(key).bit_length())
    if kinds.bit_length() + bits > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    packed = np.sort(key.astype(np.uint64) << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
    return (packed >> np.uint64(bits)).astype(np.int64), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def pack(codes: np.ndarray) -> bytes:
    """Codes below 2**32, their low bytes before their higher ones, deflated."""
    import pyarrow as pa

    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def slices(values: np.ndarray, edges: np.ndarray):
    """A binary column of the bytes of values between edges."""
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def joined(column, kind) -> np.ndarray:
    """The values of all rows of a binary column, one after the other."""
    parts = []
    for c in column.chunks:
        if len(c):
            lo, hi = np.frombuffer(c.buffers()[1], np.int32)[[c.offset, c.offset + len(c)]].tolist()
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8))
    return np.concatenate([np.empty(0, np.uint8), *parts]).view(kind)


def narrow(values: np.ndarray, edges: np.ndarray, kind) -> list:
    """slices of values as kind, and of those that it has no place for: its greatest value stands for them."""
    large = np.flatnonzero(values >= np.iinfo(kind).max)
    return [slices(np.minimum(values, np.iinfo(kind).max).astype(kind), edges), slices(values[large].astype(np.int64), np.searchsorted(large, edges))]


def widened(column, large, kind) -> np.ndarray:
    """The values that narrow was given."""
    out = joined(column, kind).astype(np.int64)
    out[out == np.iinfo(kind).max] = joined(large, np.int64)
    return out


def lengths(column, kind) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy().astype(np.int64) // np.dtype(kind).itemsize


CODED = "chunk long, docs binary, sizes binary, words binary, codes binary"


def _code(batches):
    """A row a chunk: its rows' ids, how many places each has, its words by frequency, the words' numbers at all places."""
    import pyarrow as pa

    lean_memory()
    for b in batches:
        row = b.column(0).to_numpy()
        for a, z in slice_bounds(b.column(2), CHUNK_BYTES):
            token, sizes = [], []
            for _, texts in text_slices(b.column(2).slice(a, z - a), CUT_BYTES):
                _, t, at = places(texts)
                token.append(t)
                sizes.append(np.bincount(at, minlength=len(texts)))
            token, sizes = np.concatenate(token), np.concatenate(sizes)
            keys = np.sort(token)
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
            code = find(keys, token)
            rank = np.argsort(-np.bincount(code, minlength=len(keys)), kind="stable")
            number = np.empty(len(keys), np.uint32)
            number[rank] = np.arange(len(keys), dtype=np.uint32)
            out = [b.column(1).slice(a, z - a).to_numpy().astype(np.int64).tobytes(), sizes.astype(np.int64).tobytes(), keys[rank].tobytes(), pack(number[code])]
            yield pa.RecordBatch.from_arrays([pa.array([int(row[a])]), *(pa.array([x], pa.binary()) for x in out)], names=["chunk", "docs", "sizes", "words", "codes"])


def arc_hash(state: np.ndarray, label: np.ndarray) -> np.ndarray:
    return mix64(state ^ mix64(label))


@dataclass
class Chunk:
    """A chunk's words and texts; its arcs are numbered by state, then label."""

    docs: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    label: np.ndarray  # the word at each place
    state: np.ndarray  # the word before it

    @classmethod
    def of(cls, docs: bytes, sizes: bytes, words: bytes, codes: bytes) -> Chunk:
        n, w = np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64)
        label = unpack(codes, int(n.sum()))
        return cls(np.frombuffer(docs, np.int64), n, w, label, np.append(np.flatnonzero(w == END).astype(label.dtype), label[:-1]))

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct arcs as state * words + label, how often each is taken)."""
        key = self.state.astype(np.int64)
        key *= len(self.words)
        key += self.label
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first], np.diff(np.append(first, len(key)))

    def route(self, keys: np.ndarray, bits: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard of each arc, the order that puts arcs by shard, else as they are)."""
        home = (self.words >> np.uint64(64 - bits) if bits else self.words * np.uint64(0)).astype(np.uint32)
        state = keys // len(self.words)
        shard = home[state]
        if bits and len(heavy):
            spread = np.flatnonzero(np.isin(self.words, heavy)[state])
            v, w = self.words[state[spread]], self.words[keys[spread] % len(self.words)]
            # by the low bits: find needs the high ones of arc_hash to differ within a shard
            shard[spread] = arc_hash(v, w) & np.uint64((1 << bits) - 1)
        return shard, ordered(shard, 1 << bits)[1]


SENT = "shard int, chunk long, state binary, arcs binary, label binary, taken binary"


def _send(bits: int, heavy: np.ndarray):
    """The distinct arcs of each chunk, a message a shard."""

    def run(batches):
        import pyarrow as pa

        lean_memory()
        for b in batches:
            for i in range(len(b)):
                own = Chunk.of(*(b.column(c)[i].as_py() for c in ("docs", "sizes", "words", "codes")))
                keys, n = own.arcs()
                shard, order = own.route(keys, bits, heavy)
                keys, n, shard = keys[order], n[order], shard[order]
                edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(keys))
                state, label = np.divmod(keys, len(own.words))
                new = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (shard[1:] != shard[:-1])))
                by_state, wide = np.searchsorted(new, edges), np.diff(np.append(new, len(keys)))
                cols = [slices(own.words[state[new]], by_state), slices(wide.astype(np.uint32), by_state), slices(own.words[label], edges), slices(n.astype(np.uint32), edges)]
                where = [pa.array(shard[edges[:-1]].astype(np.int32)), pa.array(np.full(len(edges) - 1, b.column("chunk")[i].as_py(), np.int64))]
                yield pa.RecordBatch.from_arrays(where + cols, names=[x.split()[0] for x in SENT.split(", ")])

    return run


#: The columns of an answer that hold counts, and what they are written as.
COUNTS = {"total": np.uint16, "kinds": np.uint16, "seen": np.uint8}
ANSWER = "chunk long, shard int, " + "".join(f"{x} binary, {x}_large binary, " for x in COUNTS) + "word long, n long, k long"


def _count(heavy: np.ndarray):
    """One shard: its arcs' and states' counts, a message a chunk, and rows (word, n, k) of what is to be added up over
    shards: of each heavy state, and in the row without a word of all places and of the states that are whole here."""

    def run(key, got):
        import pyarrow as pa

        lean_memory()
        got = got.combine_chunks()
        asked, wide = joined(got.column("state"), np.uint64), joined(got.column("arcs"), np.uint32)
        mixed = mix64(asked)  # a shard's states have their high bits in common
        kinds = np.sort(mixed)
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
        of_asked = find(kinds, mixed)
        states = np.empty(len(kinds), np.uint64)
        states[of_asked] = asked
        del mixed
        of_arc = np.repeat(of_asked, wide)
        label, taken = joined(got.column("label"), np.uint64), joined(got.column("taken"), np.uint32)
        # an arc is known by a hash of its state and its label
        arc = arc_hash(np.repeat(asked, wide), label)
        del label
        kinds = np.sort(arc)
        kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])]
        which = find(kinds, arc)
        del arc
        seen = np.bincount(which, taken, len(kinds)).astype(np.int64)
        from_state = np.empty(len(kinds), np.int64)
        from_state[which] = of_arc
        total = np.bincount(of_arc, taken, len(states)).astype(np.int64)
        many = np.bincount(from_state, minlength=len(states))
        split = np.isin(states, heavy)
        by_state = np.append(0, np.cumsum(lengths(got.column("state"), np.uint64)))
        by_arc = np.append(0, np.cumsum(lengths(got.column("taken"), np.uint32)))
        m, k = len(got), int(split.sum())
        sums = [None, *states[split].view(np.int64).tolist()], [int(total.sum()), *total[split].tolist()], [int((~split).sum()), *many[split].tolist()]
        nothing = pa.nulls(m, pa.int64())
        answers = [got.column("chunk").combine_chunks(), got.column("shard").combine_chunks(), *(x for name, n, edges in (("total", total[of_asked], by_state), ("kinds", many[of_asked], by_state), ("seen", seen[which], by_arc)) for x in narrow(n, edges, COUNTS[name])), nothing, nothing, nothing]
        added = [pa.nulls(k + 1, t) for t in (pa.int64(), pa.int32(), *[pa.binary()] * 2 * len(COUNTS))] + [pa.array(x, pa.int64()) for x in sums]
        names = [x.split()[0] for x in ANSWER.split(", ")]
        return pa.concat_tables([pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in x], names=names) for x in (answers, added)])

    return run


@dataclass
class Automaton:
    """The root's arcs and those of the states of some words; a state is its word's number."""

    root: np.ndarray  # the log-probability of each word at the root, which leads to that word's state
    keys: np.ndarray  # sorted: state * words + label of each arc, which leads to the label's state
    weight: np.ndarray  # its log-probability
    backoff: np.ndarray  # the weight of each state's failure arc, which leads to the root

    def walk(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The weight of reading each label in each state: its arc's, or the failure arc's and the root's."""
        words, out = len(self.root), np.empty(len(state))
        for i in range(0, len(state), STEP):
            key, order = ordered(state[i : i + STEP].astype(np.int64) * words + label[i : i + STEP], words * words)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            gain = self.weight[at]
            lost = np.flatnonzero(self.keys[at] != key)
            s, w = np.divmod(key[lost], words)
            gain[lost] = self.backoff[s] + self.root[w]
            out[i + order] = gain
        return out


def build_automaton(keys: np.ndarray, seen: np.ndarray, total: np.ndarray, kinds: np.ndarray, places: int, words: int) -> Automaton:
    """seen: how often each arc is taken, total: each state, kinds: how many arcs it has, all in a corpus of so many places and words."""
    # one kind more than was seen: what a text from elsewhere may hold
    unigram = (total + words / (words + 1)) / (places + words)
    state, label = np.divmod(keys, max(1, len(total)))
    weight = np.log((seen + kinds[state] * unigram[label]) / (total[state] + kinds[state]))
    return Automaton(np.log(unigram), keys, weight, np.log(kinds / (total + kinds)))


def _walk(bits: int, heavy: tuple[np.ndarray, np.ndarray, np.ndarray], places: int, words: int):
    """One chunk: its row of CODED and the answers of the shards in, a row a text out."""

    def run(key, got):
        import pyarrow as pa
        import pyarrow.compute as pc

        lean_memory()
        row = got.filter(pc.is_valid(got.column("codes")))
        own = Chunk.of(*(row.column(c)[0].as_py() for c in ("docs", "sizes", "words", "codes")))
        keys, _ = own.arcs()
        _, order = own.route(keys, bits, heavy[0])
        answers = got.filter(pc.is_valid(got.column("seen"))).select(["shard", *(x for n in COUNTS for x in (n, f"{n}_large"))]).sort_by("shard").combine_chunks()
        del got, row
        counts = lambda x: widened(answers.column(x), answers.column(f"{x}_large"), COUNTS[x])
        seen = np.empty(len(keys), np.int64)
        seen[order] = counts("seen")
        state = keys[order] // len(own.words)
        shard = np.repeat(np.arange(len(answers)), lengths(answers.column("seen"), COUNTS["seen"]))
        asked = state[np.append(True, (state[1:] != state[:-1]) | (shard[1:] != shard[:-1]))]
        total, kinds = np.empty(len(own.words), np.int64), np.empty(len(own.words), np.int64)
        total[asked], kinds[asked] = counts("total"), counts("kinds")
        if len(heavy[0]):
            i = np.minimum(np.searchsorted(heavy[0], own.words), len(heavy[0]) - 1)
            hit = heavy[0][i] == own.words
            total[hit], kinds[hit] = heavy[1][i[hit]], heavy[2][i[hit]]
        auto = build_automaton(keys, seen, total, kinds, places, words)
        del answers, keys, order, seen, state, shard
        gain = auto.walk(own.state, own.label)
        text = np.repeat(np.arange(len(own.sizes)), own.sizes)
        return pa.table([own.docs, own.sizes, np.bincount(text, gain, len(own.sizes))], names=["doc_id", "symbols", "log_prob"])

    return run


def frequent_words(base: DataFrame, size: int, bits: int) -> np.ndarray:
    """Sorted words that would fill an eighth of a shard, as some of the rows tell; at most eight a shard."""
    step = max(1, min(SAMPLE_STEP, size // SAMPLE_BYTES))
    some = base.select(F.monotonically_increasing_id().alias("row"), "text").where(F.col("row") % step == 0).select("text")
    counted = materialize(some.mapInArrow(_vocabulary, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequent")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return np.sort(counted.where(F.col("n") > (int(total) >> bits) // 8).select("w").toArrow().column("w").to_numpy().view(np.uint64))


def word_lm_scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, symbols, log_prob, perplexity) of each document under the word model of all of them.

    symbols counts tokens and the end of the text, which is predicted, too, so an empty text has one.  Rows with a
    null id or text are left out; rows that repeat count each time and are scored each time.  An empty table gives
    no rows.  Other columns are ignored.
    """
    base = doc_text(docs)
    size = int(base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    bits = max(0, size // shard_bytes).bit_length()
    words = frequent_words(base, size, bits) if bits else np.empty(0, np.uint64)
    coded = materialize(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_code, CODED), "coded")
    counted = coded.mapInArrow(_send(bits, words), SENT).groupBy("shard").applyInArrow(_count(words), ANSWER)
    answers = materialize(counted, "answers")
    sums = answers.where("chunk is null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()
    places, kinds = next(((r.n, r.k) for r in sums if r.word is None), (0, 0))
    often = sorted((int(np.int64(r.word).view(np.uint64)), r.n, r.k) for r in sums if r.word is not None)
    heavy = tuple(np.array([x[i] for x in often], dtype=t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    parts = coded.unionByName(answers.where("chunk is not null").drop("word", "n", "k"), allowMissingColumns=True)
    scored = parts.groupBy("chunk").applyInArrow(_walk(bits, heavy, places, kinds + len(often)), "doc_id long, symbols long, log_prob double")
    return scored.select("doc_id", "symbols", "log_prob", F.exp(-F.col("log_prob") / F.col("symbols")).alias("perplexity"))
