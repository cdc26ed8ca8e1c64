"""A hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

log p(w | h) = log p(class(w) | h) + log p(w | class(w), h). Both factors are softmaxes over sums of weight rows; each
feature of the history (the word before, the classes of the two and three before, skips over one and two words) is hashed
to a row. Classes group frequent words (the head, ``HEAD`` at most) by the company they keep and then by frequency. Within
a class of up to ``WIDE`` words the second factor has features too; within larger ones it is the words' frequency, the
maximum-entropy model with a bias only, whose solution is known. All other words are one class; there, a word's
probability is its discounted count, and the discounts' sum goes to the one unknown word.

1. Word counts of all training texts (one map-side combined aggregation).
2. The head's classes, from co-occurrence sums with the most frequent words over all training texts.
3. ``rounds`` of distributed gradient updates: every training text is in one round. A task starts at the current weights,
   steps through its texts in batches (AdaGrad), and sends its change in blocks; a block's mean over the tasks, weighted
   by tokens, is the update. The weights' size is fixed, so what the driver handles does not grow.
4. Scoring: sparse batches of all texts against the weights; words outside of the head meet their counts in a join.

Defined results. Null or empty text: the end token alone. Null id: counts as the empty string for the held-out rule. Repeated
rows: each is scored. Empty tables give no rows; no training texts: only unknown words. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_table, mapped, row_of, split_words, stage, text_slices

HEAD = 200_000
HEAD_COUNT = 4  # rarer words stay outside of the head: how often they are new tells how likely unknown words are
HEAD_BYTES = 64  # longer words stay outside of the head, so that its size is bounded
CLASSES, WIDE = 64, 64
ROWS = 1 << 14
COMPANY = 48
GROUPS = 8
BATCH = 4096
SCORED = 1024  # tokens scored at one time: their rows stay in a core's cache
BLOCKS = 64
FEW = 8  # a row's tokens in a batch up to which it is summed together with others
FLUSH = 300_000
LOOKED_UP = 16 << 20  # bytes of texts whose words are looked up in the head together


def is_held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids.to_pylist()], bool)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split_words(mapped(texts, lower_table()))


def training(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts; tasks send sums of FLUSH words or more at a time.

    Slices' counts are summed once they have twice FLUSH rows, not slice by slice, and by the words' codes.
    """

    def summed(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        if len(held) == 1:
            return held[0]
        coded = pa.concat_arrays([words for words, _ in held]).dictionary_encode()
        c = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.concatenate([c for _, c in held]), len(coded.dictionary))
        return coded.dictionary, c.astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, texts in text_slices(batches):
            seen = words_of(texts)[0].value_counts()
            held.append((seen.field("values").cast(pa.large_string()), seen.field("counts").to_numpy()))
            if sum(len(c) for _, c in held) > 2 * FLUSH:
                held = [summed(held)]
                if len(held[0][1]) > FLUSH:
                    words, c = held.pop()
                    yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(c, pa.int64())], names=["word", "c"])
        if held:
            words, c = summed(held)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(c, pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(vocabulary: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent words (word, c), at most ``most`` of at most HEAD_BYTES bytes: a count threshold from the
    histogram of counts, so nothing is ranked in one task."""
    short = vocabulary.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("c") >= HEAD_COUNT))
    # a row per distinct count; counts are at most the root of twice the corpus many
    sizes = short.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    fits = sizes[sizes["n"].cumsum() <= most]
    if not len(fits):
        return pd.DataFrame({"word": [], "c": []})
    return short.where(F.col("c") >= int(fits["c"].min())).toPandas().sort_values(["c", "word"], ascending=[False, True]).reset_index(drop=True)


class Tokens:
    """A slice of texts as head ids: ``ids`` with one end token a text; OUT (not in the head) = len(head) + 1, BEGIN one more."""

    def __init__(self, texts: pa.Array, head: pa.Array):
        words, off = words_of(texts)
        self._fill(words, off, self._places([words], head), head)

    @classmethod
    def slices(cls, batches: Iterator[pa.RecordBatch], head: pa.Array) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
        """The batches' slices with their tokens. Each lookup hashes the whole head, so that several slices share one."""
        held, size = [], 0
        for rows, texts in text_slices(batches):
            held.append((rows, *words_of(texts)))
            size += texts.nbytes
            if size >= LOOKED_UP:
                yield from cls._together(held, head)
                held, size = [], 0
        if held:
            yield from cls._together(held, head)

    @classmethod
    def _together(cls, held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]], head: pa.Array) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
        places, a = cls._places([words for _, words, _ in held], head), 0
        for rows, words, off in held:
            t = cls.__new__(cls)
            t._fill(words, off, places[a:a + len(words)], head)
            a += len(words)
            yield rows, t

    @staticmethod
    def _places(words: list[pa.Array], head: pa.Array) -> np.ndarray:
        """The words' places in the head, OUT for words outside of it."""
        found = pc.index_in(pa.chunked_array(words, pa.large_string()), value_set=head)
        return pc.fill_null(found, len(head) + 1).to_numpy()

    def _fill(self, words: pa.Array, off: np.ndarray, places: np.ndarray, head: pa.Array) -> None:
        self.words = words
        self.end, self.out, self.begin = len(head), len(head) + 1, len(head) + 2
        n, rows = len(words), len(off) - 1
        at = np.arange(n) + np.repeat(np.arange(rows), np.diff(off))
        self.ids = np.full(n + rows, self.end, np.int64)
        self.ids[at] = places
        self.at = at
        self.off = off + np.arange(rows + 1)
        self.word_off = off

    def before(self, k: int) -> np.ndarray:
        """The id k places before each token, BEGIN where the text begins later."""
        out = np.full(len(self.ids), self.begin, np.int64)
        out[k:] = self.ids[:-k] if k else self.ids
        for j in range(k):  # each text's first k tokens; a text has one at least
            out[np.minimum(self.off[:-1] + j, self.off[1:] - 1)] = self.begin
        return out


def company(docs: DataFrame, head) -> np.ndarray:
    """Co-occurrence sums (within four words) of each head word with the COMPANY most frequent ones, over all texts."""
    wide = min(COMPANY, len(head.value))
    size = len(head.value) + 3
    per = -(-size // BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, wide), np.int32)
        flat = total.reshape(-1)
        for _, t in Tokens.slices(batches, head.value):
            for k in range(1, 5):
                before = t.before(k)
                for left, right in ((before, t.ids), (t.ids, before)):
                    hit = np.flatnonzero(right < wide)
                    np.add.at(flat, left.take(hit) * wide + right.take(hit), np.ones(len(hit), np.int32))
        for b in range(BLOCKS):
            part = total[b * per:(b + 1) * per]
            if part.any():
                r, c = np.nonzero(part)
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "at": pa.array([(r * wide + c).astype("<u4").tobytes()], pa.binary()),
                                                  "n": pa.array([part[r, c].astype("<f4").tobytes()], pa.binary())})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        at = np.concatenate([np.frombuffer(x, "<u4") for x in group["at"]])
        n = np.concatenate([np.frombuffer(x, "<f4") for x in group["n"]])
        out = np.bincount(at, n, minlength=per * wide).astype("<f4")
        out = out.reshape(-1, wide)
        out = np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype("<f2")  # only the direction is used
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "n": [out.tobytes()]})

    out = np.zeros((BLOCKS * per, wide), np.float32)
    for r in docs.select("text").mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInPandas(add, "block int, n binary").toLocalIterator():
        out[r["block"] * per:(r["block"] + 1) * per] = np.frombuffer(r["n"], "<f2").reshape(-1, wide)
    return out[:size]


def group_words(vectors: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """Weighted k-means over the words' company."""
    n = len(counts)
    if n <= groups:
        return np.zeros(n, np.int64)
    weight = np.sqrt(counts.astype(np.float64))
    top = vectors[:max(groups, min(n, 4096))]
    centre = top[:1]
    for _ in range(groups - 1):  # the next centre is the frequent word farthest from those taken
        far = ((top[:, None] - centre[None]) ** 2).sum(2).min(1) * weight[:len(top)]
        centre = np.concatenate([centre, top[[int(far.argmax())]]])
    own = np.zeros(n, np.int64)
    for _ in range(12):
        own = np.concatenate([((centre ** 2).sum(1)[None] - 2 * vectors[i:i + 20000] @ centre.T).argmin(1) for i in range(0, n, 20000)])
        for g in range(len(centre)):
            mask = own == g
            if mask.any():
                centre[g] = np.average(vectors[mask], axis=0, weights=weight[mask])
    return own


def counted_by_row(words: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Each row's distinct words with their number, as lists of (word, n)."""
    coded = words.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    key, n = np.unique(row_of(offsets) * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    ends = np.searchsorted(key, np.arange(len(offsets)) * kinds).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % kinds)).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"]))


class Model:
    """The head's classes and the two weight tables. Class 0 is the end token, class 1 all words outside of the head."""

    def __init__(self, counts: np.ndarray, ends: int, outside: int, group: np.ndarray):
        n = len(counts)
        self.n = n
        klass = np.zeros(n + 3, np.int64)
        klass[n], klass[n + 1], klass[n + 2] = 0, 1, 0
        free, at = CLASSES - 2, 2
        mass = np.array([counts[group == g].sum() for g in range(int(group.max(initial=0)) + 1)], float)
        bins = np.maximum(1, np.floor(mass / max(1.0, mass.sum()) * (free - len(mass)))).astype(int)
        for g, b in enumerate(bins):
            own = np.flatnonzero(group == g)  # the head is in falling order of counts
            if len(own):
                share = (np.cumsum(counts[own]) - counts[own] / 2) / counts[own].sum()
                klass[own] = at + np.minimum((share * b).astype(int), b - 1)
            at += b
        self.klass = klass
        all_counts = np.concatenate([counts, [ends, outside]]).astype(float)
        total = np.bincount(klass[:n + 2], all_counts, minlength=CLASSES)
        self.frequency = np.log(np.maximum(all_counts, 1e-9) / np.maximum(total[klass[:n + 2]], 1e-9))  # log p(word | class) by count
        size = np.bincount(klass[:n + 2], minlength=CLASSES)
        self.narrow = (size > 1) & (size <= WIDE)
        order = np.argsort(klass[:n + 2], kind="stable")
        self.place = np.zeros(n + 2, np.int64)  # a word's number in its class
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.place[order] = np.arange(n + 2) - start[klass[:n + 2][order]]
        self.bias = np.log((total + 0.5) / (total + 0.5).sum()).astype(np.float32)
        self.inner = np.full((CLASSES, WIDE), -np.inf, np.float32)
        small = self.narrow[klass[:n + 2]]
        words = np.flatnonzero(small)
        self.inner[klass[words], self.place[words]] = self.frequency[words]
        self.w = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, WIDE), np.float32)]

    def features(self, t: Tokens) -> np.ndarray:
        """Rows of the first table for each token: the word before, the classes of the two before, of the three before, and
        the words two and three back (skips over one and two words)."""
        one, two, three = t.before(1), t.before(2), t.before(3)
        k = self.klass
        pair = k[one] * CLASSES + k[two]
        out = np.empty((5, len(one)), np.int64)
        for f, raw in enumerate((one, pair + (1 << 30), pair * CLASSES + k[three] + (2 << 30), two + (3 << 30), three + (4 << 30))):
            out[f] = self._row(raw)
        return out.T

    @staticmethod
    def _row(raw: np.ndarray) -> np.ndarray:
        """A table row by multiplicative hashing."""
        return ((raw.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).view(np.int64)

    def inner_features(self, rows: np.ndarray, klass: np.ndarray) -> np.ndarray:
        return self._row(rows * CLASSES + (klass + (1 << 32)))

    @staticmethod
    def _exp(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The softmax before its division (in place), and what to divide by."""
        first = np.arange(0, logit.size, logit.shape[1])
        logit -= logit.ravel().take(first + logit.argmax(axis=1))[:, None]  # faster than max over short rows
        np.exp(logit, out=logit)
        return logit, logit.sum(axis=1, keepdims=True)

    @staticmethod
    def _sum_rows(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = table.take(rows[0], axis=0)
        for own in rows[1:]:
            out += table.take(own, axis=0)
        out += bias
        return out

    def log_p(self, t: Tokens) -> np.ndarray:
        """Natural log probability of each token (of its class, for words outside of the head)."""
        rows = self.features(t).T  # a feature's rows one after the other
        k = self.klass.take(t.ids)
        out = self._log_share(self.w[0], rows, None, k)
        narrow = self.narrow.take(k)
        inside = np.flatnonzero(narrow)
        if len(inside):
            ki = k.take(inside)
            out[inside] += self._log_share(self.w[1], rows.take(inside, axis=1), ki, self.place.take(t.ids.take(inside)))
        plain = np.flatnonzero(~narrow)
        ids = t.ids.take(plain)
        out[plain] += np.where(ids == t.out, 0.0, self.frequency.take(np.minimum(ids, self.n + 1)))
        return out

    def _log_share(self, table: np.ndarray, rows: np.ndarray, klass: np.ndarray | None, true: np.ndarray) -> np.ndarray:
        """Log of the softmax at ``true``: over the classes, or over the words of each token's class."""
        share = np.empty(len(true), np.float32)
        for a in range(0, len(true), SCORED):
            r, bias = rows[:, a:a + SCORED], self.bias
            if klass is not None:
                own = klass[a:a + SCORED]
                r, bias = self.inner_features(r, own), self.inner.take(own, axis=0)
            p, total = self._exp(self._sum_rows(table, r, bias))
            at = np.arange(0, p.size, p.shape[1]) + true[a:a + SCORED]
            share[a:a + SCORED] = p.ravel().take(at) / total[:, 0]
        return np.log(np.maximum(share, 1e-30, dtype=np.float64))

    def _step(self, table: int, rows: np.ndarray, wrong: np.ndarray, seen: np.ndarray, rate: float) -> None:
        """AdaGrad on the rows of a batch: a row's gradient is the sum over the tokens that have it.

        Rows with the same few tokens are summed together, token by token; only frequent rows are summed one by one. Each
        sum has the order that ``np.add.reduceat`` has.
        """
        flat = rows.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ranked = flat[order]
        at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        order = np.tile(np.arange(len(wrong)), len(rows)).take(order)
        times = np.diff(np.append(at, len(ranked)))
        for n in range(1, FEW + 1):
            first = at[times == n]
            if len(first):
                grad = wrong.take(order[first if n == 1 else first + 1], axis=0)
                for k in range(2, n):
                    grad += wrong.take(order[first + k], axis=0)
                if n > 1:
                    grad += wrong.take(order[first], axis=0)
                self._move(table, ranked[first], grad, seen, rate)
        often = times > FEW
        if often.any():
            first, own = at[often], times[often]
            start = np.cumsum(own) - own
            grad = np.add.reduceat(wrong.take(order[np.repeat(often, times)], axis=0), start, axis=0)
            self._move(table, ranked[first], grad, seen, rate)

    def _move(self, table: int, which: np.ndarray, grad: np.ndarray, seen: np.ndarray, rate: float) -> None:
        seen[which] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        grad *= (rate / np.sqrt(seen[which]))[:, None]
        grad += self.w[table].take(which, axis=0)
        self.w[table][which] = grad

    def learn(self, t: Tokens, seen: np.ndarray, rate: float) -> None:
        """One pass over a slice in batches of gradient steps."""
        rows = self.features(t).T  # a feature's rows one after the other
        for a in range(0, len(t.ids), BATCH):
            ids, r = t.ids[a:a + BATCH], rows[:, a:a + BATCH]
            k = self.klass[ids]
            p = self._wrong(self._sum_rows(self.w[0], r, self.bias), k)
            inside = np.flatnonzero(self.narrow[k])
            if len(inside):
                ki = k[inside]
                ri = self.inner_features(r[:, inside], ki)
                q = self._wrong(self._sum_rows(self.w[1], ri, self.inner.take(ki, axis=0)), self.place[ids[inside]])
                self._step(1, ri, q, seen[1], rate)
            self._step(0, r, p, seen[0], rate)

    def _wrong(self, logit: np.ndarray, true: np.ndarray) -> np.ndarray:
        """What the probabilities lack: the gradient of the log probability."""
        p, total = self._exp(logit)
        p /= -total
        p[np.arange(len(true)), true] += 1
        return p


def train(docs: DataFrame, model: Model, head, rounds: int, rate: float) -> None:
    """Distributed gradient updates; every training text takes part in one round.

    A task sends the weight rows that it has changed, in BLOCKS blocks; a row's update is the mean change over the tasks that
    have changed it, weighted by their tokens.
    """
    spark = docs.sparkSession
    per = ROWS // BLOCKS
    widths = [w.shape[1] for w in model.w]
    turn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(rounds))
    for k in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import copy

            own, tokens = None, 0
            for _, t in Tokens.slices(batches, head.value):
                if own is None:
                    own = copy.copy(now.value)
                    own.w = [w.copy() for w in now.value.w]
                    seen = np.full((2, ROWS), 1.0, np.float32)
                tokens += len(t.ids)
                own.learn(t, seen, rate)
            for table in range(2 if own is not None else 0):
                change = own.w[table] - now.value.w[table]
                for b in range(BLOCKS):
                    part = change[b * per:(b + 1) * per]
                    rows = np.flatnonzero(part.any(axis=1))
                    if len(rows):
                        yield pa.RecordBatch.from_pydict({"table": pa.array([table], pa.int32()), "block": pa.array([b], pa.int32()), "tokens": pa.array([tokens], pa.int64()),
                                                          "rows": pa.array([rows.astype("<u2").tobytes()], pa.binary()), "change": pa.array([part[rows].astype("<f2").tobytes()], pa.binary())})

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            table, block = int(group["table"].iloc[0]), int(group["block"].iloc[0])
            total, weight = np.zeros((per, widths[table])), np.zeros((per, 1))
            for n, rows, change in zip(group["tokens"], group["rows"], group["change"]):
                at = np.frombuffer(rows, "<u2")
                total[at] += n * np.frombuffer(change, "<f2").astype(np.float64).reshape(len(at), -1)
                weight[at] += n
            return pd.DataFrame({"table": [table], "block": [block], "change": [(total / np.maximum(weight, 1)).astype("<f4").tobytes()]})

        sent = docs.where(turn == k).select("text").mapInArrow(update, "table int, block int, tokens long, rows binary, change binary")
        new = [w.copy() for w in model.w]
        for r in sent.groupBy("table", "block").applyInPandas(mean, "table int, block int, change binary").collect():  # 2 * BLOCKS rows, the weights' size
            new[r["table"]][r["block"] * per:(r["block"] + 1) * per] += np.frombuffer(r["change"], "<f4").reshape(per, -1)
        model.w = new
        now.unpersist()


def score(docs: DataFrame, head_words: int = HEAD, rounds: int = 3, rate: float = 0.3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    learned = training(docs)
    vocabulary = stage(word_counts(learned), "vocabulary")
    ends = learned.count()
    words, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, kinds = words + ends, kinds + (1 if ends else 0)
    known = head_of(vocabulary, head_words)
    head = spark.sparkContext.broadcast(pa.array(known["word"].tolist(), pa.large_string()))
    counts = known["c"].to_numpy(np.int64)
    least = int(counts.min()) if len(counts) else np.iinfo(np.int64).max
    rest = vocabulary.where((F.col("c") < int(least)) | (F.octet_length("word") > HEAD_BYTES))
    outside, out_kinds, ones, twos = rest.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("c") == 1).cast("int")), F.lit(0)),
                                              F.coalesce(F.sum((F.col("c") == 2).cast("int")), F.lit(0))).first()
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
    vectors = company(learned, head)[:len(counts)]
    model = Model(counts, ends, max(outside, 1), group_words(vectors, counts, GROUPS))
    train(learned, model, head, rounds, rate)
    final = spark.sparkContext.broadcast(model)
    log_c = np.log10(np.concatenate([counts, [ends]]) + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in Tokens.slices(batches, head.value):
            lp = final.value.log_p(t) / np.log(10)
            inside = t.ids != t.out
            base = np.where(inside, log_c[np.minimum(t.ids, t.end)], 0.0)
            known = inside if ends else inside & (t.ids != t.end)
            cut = [np.add.reduceat(x, t.off[:-1]) if len(t.off) > 1 else x[:0] for x in (lp, base, known.astype(np.int64))]
            missing = ~inside[t.at]
            others = counted_by_row(t.words.filter(pa.array(missing)), np.concatenate([[0], np.cumsum(missing)])[t.word_off])
            yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), pa.array(is_held_out(rows.column("doc_id"))), pa.array(np.diff(t.off)),
                                              pa.array(cut[0]), pa.array(cut[1]), pa.array(cut[2]), others],
                                             names=["row", "doc_id", "held_out", "n_tokens", "score", "base", "known", "others"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stage(docs.withColumn("row", F.monotonically_increasing_id())
                   .mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, score double, base double, known long, others array<struct<word:string,n:long>>"), "scored")
    # words outside of the head: none has a large share of all words, as the head holds those
    c = F.coalesce("c", F.lit(0))
    unknown = max(1e-12, discount * out_kinds / outside) if outside else 1.0
    p = F.when(c > 0, (c - discount) / float(max(outside, 1))).otherwise(unknown)
    met = scored.select("row", F.inline("others")) \
        .join(rest, "word", "left") \
        .groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(c + 1)).alias("out_base"),
                            F.sum(F.col("n") * F.log10(p)).alias("out_score"))
    zero = F.lit(0)
    return scored.drop("others").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", zero)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("out_base", zero) - F.col("n_tokens") * float(np.log10(n_all + kinds + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("out_score", zero)).alias("score"))
