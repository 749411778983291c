"""Same or near-same texts across splits: keys of rare word runs, winnowed fingerprints as collinear seeds, alignment."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.spelling import path_key
from linkloom.runtime import cut, release

#: Texts are near-same if at most one word in EDIT_SHARE of the longer one must be edited.
EDIT_SHARE = 5
#: Words per rolling hash and hashes per window. Edits cut a text of n words into at most n/5 + 1 equal runs, so from 20
#: words on near-same texts share a run of GRAM + WINDOW - 1 = 4 words, and with it a window and its minimum.
GRAM, WINDOW = 3, 2
#: Shorter texts also give every pair of words, which near-same texts of 5 words or more always share.
SHORT, SHORT_GRAM = 20, 2
#: Words per run by which texts meet; texts of at most SHORT_RUNS words also meet by pairs of words.
RUN, SHORT_RUNS = 3, 5
#: Counters by which runs are ordered, rare ones first; any order that both sides share keeps all pairs.
BUCKETS = 1 << 16
#: Records of one key and side that meet the other side's in one task.
PER_TASK = 5_000
#: Keys are shuffled in rounds of PER_ROUND or more, at most MOST_ROUNDS, which bounds the room they need to a share of the input.
PER_ROUND, MOST_ROUNDS = 2_000_000, 8

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; letter case and typographic variants (ligatures, accents apart, soft hyphens) don't count."""
    return _WORD.findall(unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).casefold())


def fingerprints(words: list[str]) -> list[tuple[int, int]]:
    """(fingerprint, position) of the winnowed word runs; position counts words. A window's minimum is its smallest hash."""
    h = [xxhash.xxh64_intdigest(w) for w in words]
    grams = []
    for i in range(len(h) - GRAM + 1):
        x = 0
        for k in h[i : i + GRAM]:
            x = (x * 0x9E3779B97F4A7C15 + k) & 0xFFFFFFFFFFFFFFFF
        grams.append((x ^ (x >> 29), i))
    chosen = {min(grams[i : i + WINDOW]) for i in range(max(1, len(grams) - WINDOW + 1))} if grams else set()
    out = [(x >> 1, i) for x, i in chosen]
    if len(h) < SHORT:
        out += [(-1 - ((h[i] * 3 + h[i + 1] * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF), i) for i in range(len(h) - SHORT_GRAM + 1)]
    return out


def edits(a: list[str], b: list[str], most: int) -> int | None:
    """Words to insert, delete or replace to make ``a`` equal ``b``; None if more than ``most``. Only the band is filled."""
    if abs(len(a) - len(b)) > most:
        return None
    lo, ha, hb = 0, len(a), len(b)
    while lo < min(ha, hb) and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    a, b = a[lo:ha], b[lo:hb]
    if not a or not b:
        return max(len(a), len(b)) if max(len(a), len(b)) <= most else None
    far, low = most + 1, 0
    row = list(range(min(len(b), most) + 1))  # cells from column ``low`` on: only those within ``most`` of the diagonal
    for i, x in enumerate(a, 1):
        first, last = max(0, i - most), min(len(b), i + most)
        new, left = [], far
        for j in range(first, last + 1):
            k = j - low
            up = row[k] + 1 if k < len(row) else far
            across = row[k - 1] + (x != b[j - 1]) if 0 < k <= len(row) and j else far
            left = min(up, across, left + 1)
            new.append(left)
        if min(new) > most:
            return None
        row, low = new, first
    return row[-1] if row[-1] <= most else None


def longest_chain(seeds: list[tuple[int, int]]) -> int:
    """Most seeds (position, position) that follow each other in both texts; n log n by the last ends of chains of each length."""
    ends: list[int] = []
    for _, j in sorted(set(seeds), key=lambda s: (s[0], -s[1])):  # of one position's seeds only one can stand in a chain
        k = bisect_left(ends, j)
        ends[k : k + 1] = [j]
    return len(ends)


def least_seeds(n: int) -> int:
    """Fewest seeds of near-same texts, the longer of n words. With d edits at most d + 1 runs of 3 equal words hold no window;
    each further 2 equal words hold at least one minimum. Those seeds lie along the alignment, one after the other.
    """
    return max(1, -(-(n - 4 * (n // EDIT_SHARE) - 3) // 2))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [" ".join(words_of(t)) if t else "" for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("example_id"), b.column("side"), pa.array(words, pa.string())], ["example_id", "side", "words"])


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the words of each text."""
    lists = pc.split_pattern(words, " ")
    d = lists.flatten().dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in d.dictionary.to_pylist()], np.uint64)
    return table[d.indices.to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64)


def _since(first: np.ndarray) -> np.ndarray:
    """For each place the places since the last one that ``first`` marks."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _runs(h: np.ndarray, n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of q words, ordered by text; the k-th of equal runs of a text has a hash of its own."""
    text = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + q <= np.repeat(n, n))
    x = np.full(len(at), q, np.uint64)
    for j in range(q):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
        x ^= x >> np.uint64(29)
    text = text[at]
    order = np.lexsort((x, text))
    x, text = x[order], text[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    return text, (x + _since(first).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(16)).astype(np.int64) & (BUCKETS - 1)


def least_runs(n: int) -> int:
    """Fewest runs of RUN words that a text of n words shares with any near-same one, if the longer has over SHORT_RUNS words.

    An edit takes RUN of the runs of the longer one, of N words, at most; N may be anything from n on, and 5 words more never
    share fewer.
    """
    return min(m - RUN + 1 - RUN * (m // EDIT_SHARE) for m in range(max(n, SHORT_RUNS + 1), max(n, SHORT_RUNS + 1) + EDIT_SHARE))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for b in batches:
        if b.num_rows:
            counts += np.bincount(_bucket(_runs(*_hashes(b.column("words")), RUN)[1]), minlength=BUCKETS)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["bucket", "n"])


def _print(rank: np.ndarray):
    """Per text its words, its signature (256 bits, one per hashed word: an edited word changes two of them at most) and its keys:
    the rarest of its runs, so many that any near-same text has one of them among its own.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, n = _hashes(b.column("words"))
            bit, starts = (h >> np.uint64(40)).astype(np.int64) & 255, np.cumsum(n) - n
            sig = [np.bitwise_or.reduceat(np.where(bit >> 6 == lane, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0)), starts).view(np.int64) for lane in range(4)]
            text, x = _runs(h, n, RUN)
            order = np.lexsort((x, rank[_bucket(x)], text))
            text, x = text[order], x[order]
            first = np.ones(len(x), bool)
            first[1:] = text[1:] != text[:-1]
            least = np.array([least_runs(k) for k in range(int(n.max()) + 1)])
            kept = _since(first) < (n - RUN + 1 - least[n] + 1)[text]
            short, y = _runs(h, n, SHORT_GRAM)
            y, short = y[n[short] <= SHORT_RUNS], short[n[short] <= SHORT_RUNS]
            text, x = np.concatenate([text[kept], short]), np.concatenate([x[kept], y])
            fps = (x >> np.uint64(32)).astype(np.uint32).view(np.int32)[np.argsort(text, kind="stable")]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(n)))]).astype(np.int32)
            fps = pa.ListArray.from_arrays(pa.array(offsets), pa.array(fps))
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(n, pa.int32()), *map(pa.array, sig), b.column("in_train"), b.column("in_other"), fps], ["class", "n", "s0", "s1", "s2", "s3", "in_train", "in_other", "fps"])

    return prints


_PRINTS = "class bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, in_train boolean, in_other boolean, fps array<int>"


def seeds(a: list[str], b: list[str], most: int) -> list[tuple[int, int]]:
    """Positions of equal winnowed fingerprints that are at most ``most`` apart."""
    at: dict[int, list[int]] = {}
    for fp, j in fingerprints(b):
        at.setdefault(fp, []).append(j)
    return [(i, j) for fp, i in fingerprints(a) for j in at.get(fp, ()) if abs(i - j) <= most]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for ca, cb, wa, wb in zip(*(b.column(c).to_pylist() for c in ("class_a", "class_b", "words_a", "words_b"))):
            x, y = wa.split(" "), wb.split(" ")
            n = max(len(x), len(y))
            if longest_chain(seeds(x, y, n // EDIT_SHARE)) >= least_seeds(n) and (d := edits(x, y, n // EDIT_SHARE)) is not None:
                for col, v in zip(rows, (ca, cb, d, n)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())], ["class_a", "class_b", "n_edits", "n_words"])


def text_classes(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes). A class is a sequence of words that one or more examples have, named by its smallest example_id.

    members: (example_id, side, class); classes: (class, words, in_train, in_other). Rows without split, example_id or any
    word take no part; a repeated row counts once. If one example_id comes with differing rows, each of them counts.
    """
    split = F.lower(F.trim("split"))
    rows = examples.where(split.isin("train", "dev", "test") & F.col("example_id").isNotNull() & F.col("text").isNotNull()).select("example_id", F.when(split == "train", "train").otherwise("other").alias("side"), "text")
    normal = cut(rows.mapInArrow(_normalise, "example_id bigint, side string, words string").where("words <> ''").withColumn("mark", F.md5("words")))
    sides = [F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "other").alias("in_other")]
    # the mark stands for the words in the shuffle of the members; classes are formed by the words themselves
    classes = cut(normal.groupBy("words").agg(F.min("example_id").alias("class"), *sides))
    names = classes.select(F.md5("words").alias("mark"), "class")
    members = cut(normal.select("example_id", "side", "mark").distinct().join(names, "mark").select("example_id", "side", "class"))
    release(normal)
    return members, classes


def near_classes(classes: DataFrame) -> DataFrame:
    """(class_a, class_b, n_edits, n_words): classes of train (a) and of the other splits (b) whose texts are near-same.

    Near-same texts share so many runs of RUN words that one is among the rarest of both (see least_runs); they meet there, and a
    join keeps only those whose lengths and word signatures can belong to near-same texts at all, which none of these fails.
    Nothing else is written of a meeting. Pairs whose seeds form a chain of the least length are aligned exactly, within the band
    of as many edits as they may have. Keys are taken in rounds. A key of more than PER_TASK records on a side is parted on that
    side, at any size of the input, and its parts meet those of the other side; nothing is capped.
    """
    rank = np.zeros(BUCKETS, np.int64)  # one number per counter, whatever the input
    for bucket, n in classes.mapInArrow(_count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        rank[bucket] = n
    prints = cut(classes.mapInArrow(_print(rank), _PRINTS))
    rounds = max(1, min(MOST_ROUNDS, -(-(prints.agg(F.sum(F.size("fps"))).first()[0] or 0) // PER_ROUND)))
    met = None
    for k in range(rounds):
        some = cut(_meetings(prints.withColumn("fp", F.explode("fps")).drop("fps").where(F.pmod("fp", F.lit(rounds)) == k)))
        met = some if met is None else met.unionByName(some)
        classes.sparkSession._jvm.System.gc()  # lets go of the round's shuffle files
    words = classes.select("class", "words")
    texts = met.distinct().join(words.toDF("class_a", "words_a"), "class_a").join(words.toDF("class_b", "words_b"), "class_b")
    near = cut(texts.mapInArrow(_align, "class_a bigint, class_b bigint, n_edits int, n_words int"))
    release(prints)
    return near


def _meetings(keys: DataFrame) -> DataFrame:
    """(class_a, class_b), once each: classes of train and of the other splits with an equal key that may be near-same."""
    n = lambda side: F.ceil(F.count_if(side) / PER_TASK).cast("int")
    counts = keys.groupBy("fp").agg(n(F.col("in_train")).alias("pa"), n(F.col("in_other")).alias("pb"))
    # a join, since the keys above PER_TASK grow with the input; few have more than one part
    counts = cut(counts.where("pa > 0 and pb > 0 and (pa > 1 or pb > 1)"))
    pa_, pb_ = F.coalesce("pa", F.lit(1)), F.coalesce("pb", F.lit(1))
    mine = lambda parts, salt: F.pmod(F.xxhash64("class", F.lit(salt)), parts).cast("int")
    spread = keys.join(counts, "fp", "left")
    left = spread.where("in_train").withColumn("part_a", mine(pa_, 1)).withColumn("part_b", F.explode(F.sequence(F.lit(0), pb_ - 1))).drop("pa", "pb", "in_train", "in_other")
    right = spread.where("in_other").withColumn("part_b", mine(pb_, 2)).withColumn("part_a", F.explode(F.sequence(F.lit(0), pa_ - 1))).drop("pa", "pb", "in_train", "in_other")
    most = F.floor(F.greatest("a.n", "b.n") / EDIT_SHARE)
    bits = sum((F.bit_count(F.col(f"a.s{j}").bitwiseXOR(F.col(f"b.s{j}"))) for j in range(1, 4)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    met = left.alias("a").join(
        right.alias("b"),
        (F.col("a.fp") == F.col("b.fp")) & (F.col("a.part_a") == F.col("b.part_a")) & (F.col("a.part_b") == F.col("b.part_b")) & (F.col("a.class") != F.col("b.class"))
        & (F.abs(F.col("a.n") - F.col("b.n")) <= most) & (bits <= 2 * most),
    )
    return met.select(F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b")).distinct()


def cross_split_pairs(examples: DataFrame) -> DataFrame:
    """(id_a, id_b, train_id, other_id, n_edits, n_words): every pair of a train and a dev or test example that are near-same.

    Equal word sequences are found by grouping, near-same ones between one representative each, then both are written out
    per example. An empty table gives no rows; further columns are ignored.
    """
    members, classes = text_classes(examples)
    same = classes.where("in_train and in_other").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit(0).alias("n_edits"), F.size(F.split("words", " ")).alias("n_words"))
    linked = cut(same.unionByName(near_classes(classes)))
    train = members.where("side = 'train'").select(F.col("example_id").alias("train_id"), F.col("class").alias("class_a"))
    other = members.where("side = 'other'").select(F.col("example_id").alias("other_id"), F.col("class").alias("class_b"))
    full = linked.join(train, "class_a").join(other, "class_b").where("train_id <> other_id")
    return full.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"), "train_id", "other_id", "n_edits", "n_words").dropDuplicates(["id_a", "id_b"])


def overlap_report(pairs: DataFrame, examples: DataFrame) -> DataFrame:
    """Per split and document of the dev and test examples: pairs, examples hit, and the mean share of words they share."""
    names = examples.where("example_id is not null").groupBy(F.col("example_id").alias("other_id")).agg(F.max(F.struct("split", path_key(F.col("source_doc")).alias("source_doc"))).alias("r"))
    best = pairs.groupBy("other_id").agg(F.count(F.lit(1)).alias("n"), F.max(1 - F.col("n_edits") / F.col("n_words")).alias("coverage"))
    return best.join(names, "other_id").groupBy("r.split", "r.source_doc").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_examples"), F.round(F.avg("coverage"), 6).alias("coverage"))
