"""Problem 1: near-copies by improved consistent weighted sampling over TF-IDF words, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from weft.functions.text import words
from weft.sources.tables import cut, table

#: A word's weight is ln(N / df), within these bounds: names and slips of the pen, which few texts have, weigh the same, and words of a group of
#: copies that holds a large part of the corpus still weigh a third of them.
FLOOR, CEILING = 1.0, 3.0
#: Samples of a band, and bands. A pair of weighted similarity s meets with 1 - (1 - s^ROWS)^BANDS: 0.9995 at s = 0.7, 0.99 at 0.66.
ROWS, BANDS = 8, 128
#: A bucket of more texts than this is divided by rare words, which loses no pair.
BUCKET = 64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    z = x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def logs(x: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes as the logarithms of uniform numbers."""
    z = mixed(x, salt)
    hi, lo = (z >> np.uint64(32)).astype(np.float32), (z & np.uint64(0xFFFFFFFF)).astype(np.float32)
    return np.log((hi + 1) / np.float32(4294967296.0 + 512)), np.log((lo + 1) / np.float32(4294967296.0 + 512))


def samples(word: np.ndarray, weight: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """ln a of every word and of the samples lo to hi, as consistent weighted sampling has it: r and c are Gamma(2, 1), beta uniform, all from hashes
    of word and sample; t = floor(ln w / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r. The word of the least a is a text's sample."""
    with np.errstate(over="ignore"):
        base = mixed(word[:, None] ^ (np.arange(lo, hi, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[None, :], 11)
        a, b = logs(base, 1)
        r = -(a + b)
        a, b = logs(base, 2)
        c = -(a + b)
        beta = (mixed(base, 3) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
    t = np.floor(np.log(weight)[:, None] / r + beta)
    return np.log(c) - r * (t - beta) - r


def signatures(bands: int, rows: int):
    """(k, w, df, total) -> (k, bands): a text's words of df 1 are one word that only it has, with their weight together. A sample falls on them
    as likely as on one of them, and they are in no other text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = bands * rows
        odd = (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for lo in range(0, len(whole), 500):
                b = whole.iloc[lo : lo + 500]
                if not len(b):
                    continue
                words_, dfs = [np.asarray(x, np.int64) for x in b["w"]], [np.asarray(x, np.int64) for x in b["df"]]
                weigh = lambda df: np.clip(np.log(total / df), FLOOR, CEILING).astype(np.float32)  # noqa: E731, B023
                total = float(b["total"].iloc[0])
                own = weigh(np.float64(1))
                parts_w, parts_v = [], []
                for k, w, d in zip(b["k"].to_numpy(np.int64), words_, dfs):
                    few = d <= 1
                    if few.any():
                        parts_w.append(np.append(w[~few], k))
                        parts_v.append(np.append(weigh(d[~few]), own * few.sum()))
                    else:
                        parts_w.append(w)
                        parts_v.append(weigh(d))
                sizes = np.array([len(x) for x in parts_w])
                flat, val = np.concatenate(parts_w).view(np.uint64), np.concatenate(parts_v).astype(np.float32)
                uniq, first, inv = np.unique(flat, return_index=True, return_inverse=True)
                ends = np.cumsum(sizes)
                out = np.empty((len(sizes), bands), np.int64)
                best = np.empty((len(sizes), n), np.uint64)
                step = max(rows, (24_000_000 // (4 * max(len(uniq), 1))) // rows * rows)
                for c0 in range(0, n, step):  # some samples at a time bound the memory
                    c1 = min(n, c0 + step)
                    tab = samples(uniq, val[first], c0, c1)
                    for i in range(len(sizes)):
                        rows_ = inv[ends[i] - sizes[i] : ends[i]]
                        best[i, c0:c1] = uniq[rows_[tab[rows_].argmin(axis=0)]]
                with np.errstate(over="ignore"):
                    z = mixed(best, 5) * odd
                    acc = z.reshape(len(sizes), bands, rows).sum(axis=2, dtype=np.uint64)
                    out[:] = mixed(acc + np.arange(bands, dtype=np.uint64)[None, :], 6).view(np.int64)
                yield pd.DataFrame({"k": b["k"].to_numpy(), "bands": list(out)})

    return run


def texts(chunks: DataFrame) -> DataFrame:
    """(id, w): the distinct words of each chunk as hashes, sorted. A repeated id is one chunk, by its text with the most words; chunks without words are left out."""
    one = chunks.where("id is not null and text is not null").select("id", F.array_sort(F.array_distinct(F.transform(words(F.col("text")), lambda x: F.xxhash64(x)))).alias("w"))
    return one.where("size(w) > 0").groupBy("id").agg(F.max_by("w", F.struct(F.size("w"), "w")).alias("w"))


def near_sets(sets: DataFrame, num: int, den: int, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """(ka, kb), ka < kb: pairs of the word sets (k, w) that have num / den of their words in common.

    num / den is the exact rule; the pairs it is asked of come from the bands and the weighted similarity.
    """
    total = F.broadcast(sets.agg(F.count("*").cast("double").alias("total")))
    df_of = sets.select(F.explode("w").alias("t")).groupBy("t").agg(F.count("*").cast("int").alias("df"))
    weighted = sets.select("k", F.explode("w").alias("t")).join(df_of, "t").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    weighted = cut(weighted.join(total).select("k", F.col("s.t").alias("w"), F.col("s.df").alias("df"), "total"))
    schema = StructType([StructField("k", LongType()), StructField("bands", ArrayType(LongType()))])
    tasks = max(12, int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = cut(weighted.repartition(tasks, "k").mapInPandas(signatures(bands, rows), schema))
    met = signed.select("k", F.explode("bands").alias("b"))
    counts = met.groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("ka"), F.max("k").alias("kb")).where("n > 1")
    counts = cut(counts)
    two = counts.where("n = 2").select("ka", "kb")
    more = met.join(counts.where(f"n > 2 and n <= {bucket}").select("b"), "b")
    left, right = (more.select("b", F.col("k").alias(f"k{s}")) for s in "ab")
    some = left.join(right, "b").where("ka < kb").select("ka", "kb")
    # sets of a full bucket meet only if one of the rare words that a true pair must share is the same
    keep = F.expr(f"size(w) - cast(ceil(size(w) * {num} / {den}) as int) + 1")
    full = met.join(counts.where(f"n > {bucket}").select("b"), "b").join(weighted.select("k", F.size("w").alias("n"), F.explode(F.slice("w", F.lit(1), keep)).alias("t")), "k")
    left, right = (full.select("b", "t", F.col("k").alias(f"k{s}"), F.col("n").alias(f"n{s}")) for s in "ab")
    many = left.join(right, ["b", "t"]).where(f"ka < kb and na * {den} >= nb * {num} and nb * {den} >= na * {num}").select("ka", "kb")
    pairs = cut(two.union(some).union(many).distinct())
    # the weight in thousandths takes the last 12 bits of a word's hash, so that what two sets have in common brings its weights along
    weight = lambda df: F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.log(F.col("total") / df)))
    packed = F.transform(F.arrays_zip("w", "df"), lambda z: F.shiftleft(F.shiftright(z["w"], 12), 12).bitwiseOR((weight(z["df"]) * 1000).cast("bigint")))
    side = lambda s: weighted.select(F.col("k").alias(f"k{s}"), packed.alias(f"p{s}"))
    mass = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, x: acc + x.bitwiseAND(4095))
    both = pairs.join(side("a"), "ka").join(side("b"), "kb").withColumn("pc", F.array_intersect("pa", "pb"))
    # no pair of the rule has less: at worst all common words have the least weight and all others the greatest
    least = num * FLOOR / (num * FLOOR + (den - num) * CEILING) - 0.001
    both = both.where(mass(F.col("pc")) >= least * (mass(F.col("pa")) + mass(F.col("pb")) - mass(F.col("pc"))))
    return both.where(f"size(pc) * {den + num} >= (size(pa) + size(pb)) * {num}").select("ka", "kb")


def classes(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct word sets as (k, w), and (id, k): chunks of the same words are one class."""
    one = cut(texts(chunks).select("id", "w", F.xxhash64("w", F.size("w")).alias("k")))
    return cut(one.groupBy("k").agg(F.first("w").alias("w"))), one.select("id", "k")


def near_copies(chunks: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(id_a, id_b), id_a < id_b: chunks whose texts agree in num / den of their distinct words.

    Null, empty and blank texts and texts without letters and digits are in no pair; a null id is none. Other columns are not read.
    """
    sets, members = classes(chunks)
    pairs = near_sets(sets, num, den)
    a, b = (members.select(F.col("id").alias(x), F.col("k").alias(f"k{s}")) for s, x in (("a", "x"), ("b", "y")))
    far = pairs.join(a, "ka").join(b, "kb").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    same = a.join(b.withColumnRenamed("kb", "ka"), "ka").where("x < y").select("x", "y")
    return far.union(same)


def copy_groups(chunks: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(id, class_id, group_id, links): every chunk with words, the number of its class of equal word sets, the number of its group of classes linked
    directly or indirectly, and to how many other classes it is linked."""
    from weft.llm.groups import components

    sets, members = classes(chunks)
    pairs = cut(near_sets(sets, num, den))
    links = pairs.select(F.col("ka").alias("k")).union(pairs.select("kb")).groupBy("k").agg(F.count("*").alias("links"))
    roots = components(pairs.select(F.col("ka").alias("u"), F.col("kb").alias("v"))).withColumnRenamed("node", "k")
    return members.join(roots, "k", "left").join(links, "k", "left").select("id", F.col("k").alias("class_id"), F.coalesce("root", "k").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "chunks"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "chunks"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL = {
    "p1_found": """
        with one as (
            select id, arg_max(w, len(w)) as w from (select id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from chunks where id is not null and text is not null)
            where len(w) > 0 group by id),
        t as (select id, len(w) as n, unnest(w) as word from one),
        met as (select a.id as x, b.id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from t a join t b on a.word = b.word and a.id < b.id group by 1, 2)
        select x as id_a, y as id_b from met where c * 17 >= (na + nb) * 7""",
}
