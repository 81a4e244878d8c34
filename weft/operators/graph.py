"""The property graph: entities, edges, neighbours, seeds and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import norm_name, tokens

MAX_SEEDS, MIN_ALIAS, MAX_NEIGHBOURS, HUB_DEGREE, TOP_PATHS, MAX_NGRAM = 5, 3, 20, 25, 10, 12


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value of each key, ties to the smallest."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def entity_rows(mentions: DataFrame, cluster_of: DataFrame) -> DataFrame:
    """(id, name, aliases, type, is_page, page_chunk_id, mentions) of the clusters (mention, cluster) of mentions (id, name, type, is_page, chunk_id)."""
    m = mentions.join(cluster_of.select(F.col("mention").alias("id"), "cluster"), "id").withColumnRenamed("id", "mention")
    one = m.groupBy("cluster").agg(
        F.array_join(F.array_sort(F.collect_set("name")), "|").alias("aliases"),
        F.coalesce(F.max("is_page"), F.lit(False)).alias("is_page"),
        F.min_by(F.when(F.col("is_page"), F.col("chunk_id")), F.when(F.col("is_page"), F.col("mention"))).alias("page_chunk_id"),
        F.count("*").alias("mentions"),
    )
    return one.join(mode(m, "cluster", "name"), "cluster", "left").join(mode(m, "cluster", "type"), "cluster", "left").withColumnRenamed("cluster", "id")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): every edge counts at both ends."""
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, names: DataFrame, k: int = MAX_NEIGHBOURS) -> DataFrame:
    """(node, neighbour, source, rel, target, place): of each node the k edges with the most chunks, either direction, then by the neighbour's name, id and the relation.

    names is (id, name). A loop leads nowhere and is left out.
    """
    e = edges.withColumn("w", F.size("chunk_ids"))
    both = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "source", "rel", "target", "w").union(e.select("target", "source", "source", "rel", "target", "w")).where("node != neighbour").distinct()
    both = both.join(names.select(F.col("id").alias("neighbour"), "name"), "neighbour", "left").withColumn("name", F.coalesce("name", "neighbour"))
    order = Window.partitionBy("node").orderBy(F.desc("w"), "name", "neighbour", "rel", "source")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("node", "neighbour", "source", "rel", "target", "place")


def step_text(names: str, source: str, rel: str, target: str) -> Column:
    del names
    return F.concat(F.col(source), F.lit(" -"), F.col(rel), F.lit("-> "), F.col(target))


def two_hops(seeds: DataFrame, near: DataFrame, degree: DataFrame, hub: int = HUB_DEGREE) -> DataFrame:
    """(question_id, seed, hops, nodes, text, factor, r0, r1, r2): paths of no, one and two steps from seeds (question_id, seed, rank) over neighbours.

    A node of more than hub edges ends a path and is never passed; a path does not return to its seed. factor is 1 / log2(2 + degree) of the node
    passed. Of equal texts of a question the first in the order of seeds and neighbours stays.
    """
    zero = seeds.select("question_id", "seed", F.lit(0).alias("hops"), F.array("seed").alias("nodes"), F.col("seed").alias("text"), F.lit(1.0).alias("factor"), F.col("rank").alias("r0"), F.lit(0).alias("r1"), F.lit(0).alias("r2"))
    text = lambda p: F.concat(F.col(f"{p}source"), F.lit(" -"), F.col(f"{p}rel"), F.lit("-> "), F.col(f"{p}target"))
    side = lambda p: near.select(*(F.col(c).alias(p + c) for c in near.columns))
    one = seeds.join(side("a"), F.col("seed") == F.col("anode"))
    first = one.select("question_id", "seed", F.lit(1).alias("hops"), F.array("seed", "aneighbour").alias("nodes"), text("a").alias("text"), F.lit(1.0).alias("factor"), F.col("rank").alias("r0"), F.col("aplace").alias("r1"), F.lit(0).alias("r2"))
    pass_ = degree.where(F.col("degree") <= hub).select(F.col("node").alias("aneighbour"), "degree")
    two = one.join(pass_, "aneighbour").join(side("b"), F.col("aneighbour") == F.col("bnode")).where("bneighbour != seed")
    second = two.select(
        "question_id", "seed", F.lit(2).alias("hops"), F.array("seed", "aneighbour", "bneighbour").alias("nodes"), F.concat(text("a"), F.lit("; "), text("b")).alias("text"), (1.0 / F.log2(2 + F.col("degree"))).alias("factor"), F.col("rank").alias("r0"), F.col("aplace").alias("r1"), F.col("bplace").alias("r2")
    )
    every = zero.union(first).union(second)
    keep = Window.partitionBy("question_id", "text").orderBy("r0", "r1", "r2")
    return every.withColumn("_r", F.row_number().over(keep)).where("_r = 1").drop("_r")


def alias_index(entities: DataFrame) -> DataFrame:
    """(phrase, id, is_page): the norms of names and aliases with MIN_ALIAS characters at least."""
    none = F.array().cast("array<string>")
    a = entities.select("id", F.coalesce("is_page", F.lit(False)).alias("is_page"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("a"))
    return a.where("a is not null").select(norm_name(F.col("a")).alias("phrase"), "id", "is_page").where(F.length("phrase") >= MIN_ALIAS).distinct()


def verbatim_seeds(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(question_id, seed, rank): entities that a question (question_id, question) names, MAX_SEEDS at most.

    Phrases of MAX_NGRAM words at most that are in the index are taken longest first, then from the left, none over words that are
    taken already; pages come first, then longer phrases, then by id.
    """
    t = questions.select("question_id", tokens(norm_name(F.col("question"))).alias("t")).where("size(t) > 0")
    spans = t.select("question_id", F.posexplode("t").alias("i", "w"), "t").select("question_id", "i", F.explode(F.expr(f"sequence(1, least({MAX_NGRAM}, size(t) - i))")).alias("n"), "t")
    spans = spans.select("question_id", "i", "n", F.array_join(F.slice("t", F.col("i") + 1, F.col("n")), " ").alias("phrase"))
    hits = spans.join(index.select("phrase").distinct(), "phrase", "left_semi")
    free = lambda acc, m: ~F.exists(acc, lambda x: (x["i"] < m["i"] + m["n"]) & (m["i"] < x["i"] + x["n"]))
    ordered = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "i", "n", "phrase"))), lambda m: F.struct(m["i"].alias("i"), m["n"].alias("n"), m["phrase"].alias("phrase"))).alias("m"))
    start = F.array().cast("array<struct<i:int,n:int,phrase:string>>")
    taken = ordered.select("question_id", F.explode(F.aggregate("m", start, lambda acc, m: F.when(free(acc, m), F.concat(acc, F.array(m))).otherwise(acc))).alias("x")).select("question_id", "x.phrase", "x.n")
    found = taken.join(index, "phrase").groupBy("question_id", "id").agg(F.min("n").alias("n"), F.max("is_page").alias("is_page"))
    order = Window.partitionBy("question_id").orderBy(F.desc("is_page"), F.desc("n"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_SEEDS).select("question_id", F.col("id").alias("seed"), "rank")
