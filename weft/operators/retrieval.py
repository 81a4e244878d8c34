"""Lexical and dense search, fusion of ranked lists, recall, and packing of contexts; every operator takes many questions at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.similarity import dot
from weft.functions.text import token_count, tokens
from weft.operators.lexical import asked_blocks, best_of, block_words, known_blocks, text_blocks, unpack
from weft.sources.tables import cut

EPSILON = 0.25
#: Digits that scores are compared by, so that the order of a sum doesn't decide ties.
DIGITS = 8
#: Words of a block of chunks, questions of a block, blocks that meet at least; the share of all pairs of question and chunk from which a word is common.
BLOCK_WORDS, ASKED, CELLS, COMMON = 8_000_000, 30_000, 12, 0.002


def ranked(rows: DataFrame, group: str, score: str, item: str, k: int | None = None) -> DataFrame:
    """Adds rank from 1, by score, equal scores by item; the first k only if given."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))))
    return out.where(F.col("rank") <= k) if k else out


def postings(chunks: DataFrame, text: Column) -> DataFrame:
    """(chunk_id, term, tf, len) of chunks (id); a chunk without words has none."""
    bag = chunks.select(F.col("id").alias("chunk_id"), tokens(text).alias("t")).withColumn("len", F.size("t"))
    return bag.select("chunk_id", "len", F.explode("t").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_weights(post: DataFrame, n_docs: Column, totals: DataFrame) -> DataFrame:
    """(term, df, idf) of postings; totals has what n_docs needs."""
    return weights(post.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(totals)), n_docs)


def weights(terms: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) of terms (term, df): Okapi's, where a negative one is replaced by EPSILON times the mean of all, negative ones included."""
    raw = terms.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(chunks: DataFrame, text: Column, questions: DataFrame, k: int, words: int = BLOCK_WORDS, common: float = COMMON) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k best chunks of each question (question_id, question; one row each) by Okapi BM25.

    A word counts as often as the question has it. Blocks of chunks, of so many words, meet blocks of questions, whose best of a block best_of() takes
    without a row for every chunk that some word of a question is in. Chunks that no word meets follow with score 0 in the order of their ids, as far as k
    asks for them. A word is common if pairs of a question and a chunk that have it are that share and more of all pairs.
    """
    spark = chunks.sparkSession
    blocks = cut(chunks.select("id", tokens(text).alias("t")).mapInArrow(text_blocks, "texts binary, words binary, n bigint, n_words bigint"))
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    ask = questions.select(F.col("question_id").alias("id"), F.coalesce(tokens(F.col("question")), F.array().cast("array<string>")).alias("t"))
    n_asked = questions.count()
    df = cut(blocks.select("words").mapInArrow(block_words, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")))
    asked = ask.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("asked"))
    known = weights(df, F.lit(size.docs)).join(asked, "term").select("term", "idf", (F.col("df").cast("double") * F.col("asked")).alias("pairs")).toArrow().combine_chunks()
    idf = known["idf"].to_numpy()
    shared = (idf > 0) & (known["pairs"].to_numpy() >= common * size.docs * n_asked) & (min([0.0, *idf]) >= 0)
    given = spark.sparkContext.broadcast((known["term"].combine_chunks(), idf, shared, pa.array([r.id for r in chunks.select("id").orderBy("id").limit(k).collect()], pa.string())))

    d, q = max(1, -(-size.words // words)), max(1, -(-n_asked // ASKED))
    q = max(q, -(-CELLS // d))
    mean = size.words / max(1, size.docs)
    docs = blocks.select("texts", "words").mapInArrow(lambda x: known_blocks(x, given.value[0], mean, given.value[3], d), "d int, texts binary").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    bags = ask.mapInArrow(lambda x: asked_blocks(x, *given.value[:3], q), "q int, asked binary").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    cells = [x.repartition(2 * d * q, "d", "q").groupBy("d", "q") for x in (docs, bags)]

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        return best_of(unpack(x["texts"]), unpack(y["asked"]), k) if x.num_rows and y.num_rows else pa.table({"question_id": pa.array([], pa.string()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

    got = cells[0].cogroup(cells[1]).applyInArrow(cell, "question_id string, chunk_id string, score double")
    return ranked(got.withColumn("score", F.round("score", DIGITS)), "question_id", "score", "chunk_id", k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, blocks: int = 16) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of vectors (vec_id, embedding) to each of queries (query_id, q) by dot product, without itself.

    Vectors are in hash blocks and every query goes to each block, whose own k best are taken before the blocks' lists are joined: no
    side is broadcast, and what is shuffled is queries x blocks and queries x blocks x k.
    """
    v = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    q = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    pairs = q.join(v, "block").where("vec_id != query_id").select("query_id", "block", "vec_id", F.round(dot(F.col("q"), F.col("embedding")), DIGITS).alias("score"))
    inner = Window.partitionBy("query_id", "block").orderBy(F.desc("score"), "vec_id")
    some = pairs.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k)
    return ranked(some.select("query_id", "vec_id", "score"), "query_id", "score", "vec_id", k)


def min_max(rows: DataFrame, group: str, score: str, into: str) -> DataFrame:
    """Scores of each group's list from 0 to 1; 0 if all are equal."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn(into, F.when(hi == lo, 0.0).otherwise((F.col(score) - lo) / (hi - lo)))


def fuse(lexical: DataFrame, vector: DataFrame, alpha: float | None = None, rrf: int = 60) -> DataFrame:
    """(question_id, chunk_id, score, rank) of two ranked lists (question_id, chunk_id, score, rank): alpha x dense + (1 - alpha) x lexical, each from 0 to
    1 and 0 where missing; without alpha the sum of 1 / (rrf + rank)."""
    keys = ["question_id", "chunk_id"]
    if alpha is None:
        both = lexical.select(*keys, "rank").union(vector.select(*keys, "rank"))
        got = both.groupBy(*keys).agg(F.round(F.sum(1.0 / (rrf + F.col("rank"))), DIGITS).alias("score"))
    else:
        a = min_max(lexical, "question_id", "score", "b").select(*keys, F.col("b").alias("b"), F.lit(0.0).alias("d"))
        b = min_max(vector, "question_id", "score", "d").select(*keys, F.lit(0.0), "d")
        got = a.union(b).groupBy(*keys).agg(F.round(alpha * F.sum("d") + (1 - alpha) * F.sum("b"), DIGITS).alias("score"))
    return ranked(got, "question_id", "score", "chunk_id")


def recalls(lists: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Per question of gold (question_id, type, gold array): recall_k and all_gold_k of its list (question_id, chunk_id, rank). Questions without gold are left out."""
    ids = lists.where(F.col("rank") <= max(ks)).groupBy("question_id").agg(F.collect_list(F.struct("rank", "chunk_id")).alias("l"))
    one = gold.withColumn("gold", F.array_distinct("gold")).where("size(gold) > 0").join(ids, "question_id", "left")
    out = ["question_id", "type"]
    for k in ks:
        hit = F.size(F.array_intersect("gold", F.transform(F.filter("l", lambda x: x["rank"] <= k), lambda x: x["chunk_id"])))  # noqa: B023
        hit = F.coalesce(F.when(F.col("l").isNull(), 0).otherwise(hit), F.lit(0))
        out += [F.round(hit / F.size("gold"), 6).alias(f"recall_{k}"), (hit == F.size("gold")).cast("double").alias(f"all_gold_{k}")]
    return one.select(*out)


def by_group(rows: DataFrame, metrics: list[str], digits: int = 4) -> DataFrame:
    """(grp, n, metrics): means over each type, multi_hop or single_hop_all, and all."""
    labels = F.array(F.col("type"), F.when(F.col("type") == "single_hop", "single_hop_all").otherwise("multi_hop"), F.lit("all"))
    return rows.withColumn("grp", F.explode(labels)).groupBy("grp").agg(F.count("*").alias("n"), *(F.round(F.avg(m), digits).alias(m) for m in metrics))


def pack(lists: DataFrame, budget: Column, used: Column | None = None) -> DataFrame:
    """(question_id, chunk_ids, tokens): blocks (question_id, rank, chunk_id, cost) in rank order, each taken if it still fits; one that doesn't is skipped and
    the next is tried. A question's list is bounded by the k of its search."""
    start = F.struct((used if used is not None else F.lit(0)).cast("bigint").alias("tokens"), F.array().cast("array<string>").alias("ids"))
    step = lambda a, x: F.when(a["tokens"] + x["cost"] <= budget, F.struct((a["tokens"] + x["cost"]).alias("tokens"), F.concat(a["ids"], F.array(x["chunk_id"])).alias("ids"))).otherwise(a)
    one = lists.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("cost").cast("bigint").alias("cost")))).alias("l"))
    return one.select("question_id", F.aggregate("l", start, step).alias("p")).select("question_id", F.col("p.ids").alias("chunk_ids"), F.col("p.tokens").alias("tokens"))


def block_cost(title: Column, text: Column) -> Column:
    """Tokens of a passage's block, with the blank line after it."""
    return token_count(F.concat(F.lit("["), title, F.lit("] "), text)) + 2
