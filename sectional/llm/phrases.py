"""Phrase collocations of two and three words per language, by best-first branch-and-bound growth.

Words and pairs are counted in one pass. Within a language a prefix ``p q`` with count a and a first word of count f can
lead to no phrase, itself included, that scores above ``floor(10^6 * a / f)``: a phrase's count is at most a, and at most the
count of what follows the first word. Prefixes are expanded (their three-word phrases counted in a pass over the texts)
in the order of this bound, down to a level per language; pairs that score as much as the level are expanded to the left
too, since a longer phrase may take their place. When ``top`` phrases that survive reach the level, nothing below it can
change them and the language is settled with all ties; else its level falls to where four times as many pairs reach
it, at last to 0, and it goes into the next wave. Levels come from a histogram of scores (0 to 10^6), so no task holds
the pairs of a language.

A wave ships the expanded prefixes as 64-bit hashes, at most about ``SHIP`` at a time (a wave with more takes more passes);
hashes only choose what is counted, counts are of the words themselves. Counts leave a task once per ``SLICE`` bytes of
text, added up; languages and words of any frequency meet in sums only.

Defined results. Lower case for A-Z; texts are cut at ``[.,;:!?\\x0A-\\x0D]`` and words at spaces and tabs. Null text: empty.
Null language: ``und``. Rows without an id and repeated rows count like any other; no other column is read. Ties go by
count, then by phrase in byte order. Empty tables and languages without a candidate give no rows. Counts must stay
below 10^16 (scores are computed in 38 digits).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, stage, text_slices, word_hashes

#: Text bytes of a language that a task counts before it passes the counts on, and those it holds as words at one time.
SLICE, CHUNK = 8 << 20, 1 << 20
#: Hashes of expanded prefixes that one pass ships (16 bytes each).
SHIP = 2_000_000
#: Pairs that the first level of a language reaches, as a multiple of the phrases wanted.
FIRST = 2
SCALE = 1_000_000

#: Lower case; what separates pieces becomes a line feed, a tab a space.
_BYTES = bytes(ord("\n") if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words and the texts as their numbers, -1 between pieces."""
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    empty, piece = numbers[b""], numbers[b"\n"]
    parts, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= CHUNK):
            size += len(texts[end]) + 1
            end += 1
        words = b"\n".join([*texts[at:end], b""]).translate(_BYTES).replace(b"\n", b" \n ").split(b" ")
        seq = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        parts.append(seq[seq != empty])
        at = end
    seq = np.concatenate(parts)
    return pa.array(list(numbers)[2:], pa.binary()).cast(pa.string()), np.where(seq == piece, -1, seq - 2)


def _pairs(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of words start, and each as one number."""
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    return at, seq[at].astype(np.int64) << 32 | seq[at + 1]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language, about ``SLICE`` bytes or one longer text at a time."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for rows, texts in text_slices(batches):
        for lang, text in zip(rows.column("lang").to_pylist(), texts.cast(pa.large_binary()).to_pylist()):
            held[lang].append(text)
            size[lang] += len(text) + 1
        while sum(size.values()) > SLICE:
            lang = max(size, key=size.get)
            yield lang, held.pop(lang)
            del size[lang]
    for lang, parts in held.items():
        yield lang, parts


def _rows(lang: str, words: pa.Array, parts: list[np.ndarray | None], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), 50_000):
        n = len(counts[at:at + 50_000])
        columns = [pa.array([lang]).take(pa.array(np.zeros(n, np.int32)))]
        columns += [pa.nulls(n, pa.string()) if p is None else words.take(pa.array(p[at:at + n])) for p in parts]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[at:at + n], pa.int64())],
                                         names=["lang", *(f"w{k + 1}" for k in range(len(parts))), "c"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (``w2`` null) and pairs."""
    for lang, texts in _by_language(batches):
        words, seq = _tokens(texts)
        single = np.bincount(seq[seq >= 0], minlength=len(words))
        yield from _rows(lang, words, [np.arange(len(words)), None], single)
        pair, counts = np.unique(_pairs(seq)[1], return_counts=True)
        yield from _rows(lang, words, [pair >> 32, pair & 0xFFFFFFFF], counts)


def _pair_hash(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(mix64(mix64(lang) + first) + second)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = _pair_hash(*(word_hashes(batch.column(c)) for c in ("lang", "w1", "w2")))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("own")], names=["h", "own"])


def _long(shipped) -> callable:
    """Counts of three-word phrases whose first pair is expanded, or whose last pair is expanded to the left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, left = shipped.value
        for lang, texts in _by_language(batches):
            words, seq = _tokens(texts)
            at, pair = _pairs(seq)
            pair, which = np.unique(pair, return_inverse=True)
            hashed = word_hashes(words)
            own = _pair_hash(word_hashes(pa.array([lang])), hashed[pair >> 32], hashed[pair & 0xFFFFFFFF])
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found = known[place] == own
            first, last = np.zeros(len(seq), bool), np.zeros(len(seq), bool)
            first[at], last[at] = found[which], (found & left[place])[which]
            number = np.full(len(seq), -1, np.int64)
            number[at] = which
            go = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (first[:-1] | last[1:]))
            key, counts = np.unique(number[go] << 32 | seq[go + 2], return_counts=True)
            pair = pair[key >> 32]
            yield from _rows(lang, words, [pair >> 32, pair & 0xFFFFFFFF, key & 0xFFFFFFFF], counts)
    return run


def cut_score(a: str, left: str, right: str) -> Column:
    """``floor(10^6 a^2 / (left right))``, exact."""
    big = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"cast({SCALE} as decimal(7,0)) * ({big(a)} * {big(a)}) div ({big(left)} * {big(right)})")


def _expand(texts: DataFrame, frontier: DataFrame, least: int) -> DataFrame:
    """``lang, w1, w2, w3, a`` of the three-word phrases of ``least`` and more occurrences that the frontier leads to."""
    spark = texts.sparkSession
    hashes = stage(frontier.mapInArrow(_hashes, "h long, own boolean"), "frontier")
    passes = max(1, -(-hashes.count() // SHIP))
    counted = None
    for k in range(passes):
        part = hashes if passes == 1 else hashes.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k)
        table = part.toArrow()  # about SHIP rows at most
        h, own = table.column("h").to_numpy().view(np.uint64), table.column("own").to_numpy()
        if not len(h):
            continue
        order = np.lexsort((~own, h))
        order = order[np.append(True, h[order][1:] != h[order][:-1])]  # of equal hashes the one that asks for more
        shipped = spark.sparkContext.broadcast((h[order], own[order]))
        found = texts.mapInArrow(_long(shipped), "lang string, w1 string, w2 string, w3 string, c long") \
            .groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
        found = stage(found, "phrases-of-three")
        counted = found if counted is None else counted.unionByName(found)
    if counted is None:
        return spark.createDataFrame([], "lang string, w1 string, w2 string, w3 string, a long")
    # passes that both meet a phrase have counted all of it
    return counted if passes == 1 else counted.groupBy("lang", "w1", "w2", "w3").agg(F.max("a").alias("a"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases.

    A phrase needs ``least`` occurrences, and gives way to a longer one around it with ``share`` percent of its own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = stage(texts.mapInArrow(_short, "lang string, w1 string, w2 string, c long").groupBy("lang", "w1", "w2")
                   .agg(F.sum("c").alias("c")).where(F.col("w2").isNull() | (F.col("c") >= least)), "phrase-counts")
    single = counts.where(F.col("w2").isNull())
    total = stage(single.groupBy("lang").agg(F.sum("c").alias("n")), "language-sizes")
    single = single.where(F.col("c") >= least)
    pairs = counts.where(F.col("w2").isNotNull()).withColumnRenamed("c", "a") \
        .join(single.select("lang", "w1", F.col("c").alias("f1")), ["lang", "w1"]) \
        .join(single.select("lang", F.col("w1").alias("w2"), F.col("c").alias("f2")), ["lang", "w2"])
    pairs = stage(pairs.select("lang", "w1", "w2", "a", "f1", "f2", cut_score("a", "f1", "f2").alias("score"),
                               F.expr(f"{SCALE} * a div f1").alias("bound")), "pairs")
    # at most 10^6 + 1 rows a language
    by_score = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = stage(pairs.groupBy("lang", "score").agg(F.count("*").alias("k")).select("lang", "score", F.sum("k").over(by_score).alias("reach")), "pair-scores")

    def level(wanted: int) -> DataFrame:
        return reach.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reach") >= wanted, F.col("score"))), F.lit(0)).alias("level"))

    open_levels, wanted, settled = level(FIRST * top), FIRST * top, None
    while True:
        open_levels = stage(open_levels, "levels")
        live = pairs.join(open_levels, "lang")
        expanded = live.where(F.col("bound") >= F.col("level")).select("lang", "w1", "w2", (F.col("score") >= F.col("level")).alias("own"))
        three = _expand(texts, expanded, least)
        begin = pairs.select("lang", "w1", "w2", F.col("a").alias("a12"), "f1")
        end = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"), F.col("f2").alias("f3"))
        scored = three.join(begin, ["lang", "w1", "w2"]).join(end, ["lang", "w2", "w3"]) \
            .withColumn("s1", cut_score("a", "f1", "a23")).withColumn("s2", cut_score("a", "a12", "f3"))
        first = F.col("s1") <= F.col("s2")
        longer = scored.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("a12")).alias("l"),
                               F.when(first, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score")) \
            .join(open_levels, "lang").where(F.col("score") >= F.col("level"))
        around = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")) \
            .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
        kept = live.where(F.col("score") >= F.col("level")).join(around, ["lang", "w1", "w2"], "left") \
            .where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        shorter = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score", "level")
        survivors = stage(shorter.unionByName(longer), "survivors")
        state = stage(open_levels.join(survivors.groupBy("lang").agg(F.count("*").alias("k")), "lang", "left")
                      .withColumn("done", (F.col("level") == 0) | (F.coalesce(F.col("k"), F.lit(0)) >= top)), "wave")
        ready = survivors.join(state.where("done").select("lang"), "lang", "left_semi")
        settled = ready if settled is None else settled.unionByName(ready)
        still = state.where(~F.col("done")).select("lang", F.col("level").alias("last"))
        if not still.take(1):
            break
        wanted *= 4
        open_levels = still.join(level(wanted), "lang").select("lang", F.least("level", F.col("last") - 1).alias("level"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = settled.select("*", place.alias("rank")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
