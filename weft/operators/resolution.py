"""Entity resolution: mentions, candidate pairs, and constrained clustering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.similarity import token_set_ratio
from weft.functions.text import hash_percent, norm_name
from weft.operators.components import reachable
from weft.operators.name_pairs import name_blocks, near_in_cell
from weft.sources.tables import cut, drop

TUNE_SHARE, FUZZY_MIN, NAME_GATE, EXACT_K, ENDPOINT_MIN = 30, 85.0, 60.0, 3, 90.0
#: Parts of names that meet each other at least; names of a part at most.
PARTS, PART_NAMES = 6, 100_000


def types_compatible(a: Column, b: Column) -> Column:
    """Equal, or one of them OTHER, or a film and a work."""
    return (a == b) | (a == "OTHER") | (b == "OTHER") | (a.isin("FILM", "WORK") & b.isin("FILM", "WORK"))


def split_of(chunk_id: Column, seed: str) -> Column:
    return F.when(hash_percent(F.concat(F.lit(seed + ":"), chunk_id)) < TUNE_SHARE, "tune").otherwise("report")


def pair_split(page_a: Column, split_a: Column, page_b: Column, split_b: Column) -> Column:
    """tune if every side that is no page is of tune and there is one; report otherwise."""
    side = lambda page, split: page | (split == "tune")
    return F.when(F.coalesce(~(page_a & page_b) & side(page_a, split_a) & side(page_b, split_b), F.lit(False)), "tune").otherwise("report")


def built_mentions(extracted: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, chunk_id, norm, type, is_page) of extracted entities (chunk_id, pos, name, type) with the chunks' titles (chunk_id, title).

    One per norm and type of a chunk, the first; the page is the first entity named as the title, else the first of all, and stays
    even if its norm and type came before. Names without a norm are dropped.
    """
    e = extracted.join(titles, "chunk_id").withColumn("norm", norm_name(F.col("name"))).withColumn("tn", norm_name(F.col("title")))
    by_chunk = e.groupBy("chunk_id").agg(F.min(F.when(F.col("norm") == F.col("tn"), F.col("pos"))).alias("named"), F.min("pos").alias("first"))
    e = e.join(by_chunk, "chunk_id").withColumn("is_page", F.col("pos") == F.coalesce("named", "first"))
    r = F.row_number().over(Window.partitionBy("chunk_id", "norm", "type").orderBy("pos"))
    return e.withColumn("r", r).where("norm != '' and (r = 1 or is_page)").select(F.concat("chunk_id", F.lit("::"), "pos").alias("id"), "chunk_id", "norm", "type", "is_page")


def fuzzy_names(names: DataFrame, least: float = FUZZY_MIN, part: int = PART_NAMES) -> DataFrame:
    """(x, y, ratio), x < y: distinct names (norm) whose common-subsequence ratio is at least that.

    Names are in parts, and every two parts meet in one task, where signatures that lose no pair leave few pairs for the ratio: what is shuffled
    is names x parts, no row for each pair. A part has so many names at most, and there are PARTS at least.
    """
    one = cut(names.select("norm").distinct().where("norm != ''"))
    n = max(PARTS, -(-one.count() // part))
    blocks = one.mapInArrow(lambda x: name_blocks(x, n), "g int, names binary").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = blocks.withColumns({"i": F.least("g", "h"), "j": F.greatest("g", "h")}).repartition(n * (n + 1), "i", "j").groupBy("i", "j")
    return cells.applyInArrow(lambda key, rows: near_in_cell(rows, key[0].as_py(), key[1].as_py(), least), "x string, y string, ratio double")


def knn_pairs(top: DataFrame, t_low: float) -> DataFrame:
    """(a, b, cos), a < b, of neighbour lists (query_id, vec_id, cos): those near enough, once."""
    return top.where(F.col("cos") >= t_low).select(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))


def gated(pairs: DataFrame, a: str, b: str, least: float = NAME_GATE) -> DataFrame:
    return pairs.where(token_set_ratio(F.col(a), F.col(b)) >= least)


def merge_one(rows: pd.DataFrame) -> pd.DataFrame:
    """One component's merges, edge by edge: rows are (kind, a, b, cos), kind same, different or page (a is a mention, b its page's chunk)."""
    page = {r.a: r.b for r in rows[rows.kind == "page"].itertuples()}
    apart: dict[str, set[str]] = {}
    for r in rows[rows.kind == "different"].itertuples():
        apart.setdefault(r.a, set()).add(r.b)
        apart.setdefault(r.b, set()).add(r.a)
    same = rows[rows.kind == "same"].sort_values(["cos", "a", "b"], ascending=[False, True, True])
    home = {v: v for v in [*same.a, *same.b]}
    held = {v: [v] for v in home}
    pages = {v: page.get(v) for v in home}
    out = []
    for r in same.itertuples():
        x, y = home[r.a], home[r.b]
        if x == y:
            continue
        if pages[x] and pages[y] and pages[x] != pages[y]:
            out.append(("refused", r.a, r.b, "two_pages"))
        elif any(home.get(o) == y for v in held[x] for o in apart.get(v, ())) if len(held[x]) <= len(held[y]) else any(home.get(o) == x for v in held[y] for o in apart.get(v, ())):
            out.append(("refused", r.a, r.b, "cannot_link"))
        else:
            x, y = (x, y) if len(held[x]) >= len(held[y]) else (y, x)
            for v in held[y]:
                home[v] = x
            held[x] += held.pop(y)
            pages[x] = pages[x] or pages[y]
    out += [("member", v, pages[x] or "m:" + min(held[x]), None) for x in held for v in held[x]]
    return pd.DataFrame(out, columns=["kind", "a", "b", "reason"])


def constrained_clusters(mentions: DataFrame, same: DataFrame, different: DataFrame, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(mention, cluster) of mentions (id, chunk_id, is_page), and (a, b, reason) of refused merges.

    same (a, b, cos) are merged in the order of falling cosine, then a and b; a merge is refused if both sides have a page of different chunks (two_pages) or
    a different pair (a, b) between them (cannot_link). A cluster is named by its page's chunk, or m: and its least mention. Merges never leave a component of
    the same pairs. One without a different pair inside and with one page at most can refuse nothing and is a cluster; of the others those of up to most
    pairs are merged in one task each, larger ones in rounds of joins.
    """
    kept: list[str] = []
    m = mentions.select("id", F.when(F.col("is_page"), F.col("chunk_id")).alias("page"))
    ids = m.select("id")
    edge = same.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").where("a != b").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    edge = cut(edge, kept)
    ends = edge.select(F.col("a").alias("v")).union(edge.select("b")).distinct()
    comp = reachable(edge, ends)
    of = lambda c: comp.select(F.col("v").alias(c), F.col("c").alias(f"c{c}"))
    diff = cut(different.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").where("ca = cb").select(F.col("ca").alias("c"), "a", "b"), kept)
    paged = comp.join(m.withColumnRenamed("id", "v"), "v")
    pages = paged.groupBy("c").agg(F.countDistinct("page").alias("pages"), F.min("page").alias("page"), F.min("v").alias("least"))
    sizes = edge.join(of("a"), "a").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("pairs"))
    kind = pages.join(sizes, "c").join(diff.select("c").distinct().withColumn("d", F.lit(True)), "c", "left")
    kind = cut(kind.select("c", "page", "least", F.when((F.col("pages") <= 1) & F.col("d").isNull(), "free").when(F.col("pairs") <= most, "small").otherwise("large").alias("kind")), kept)
    free = comp.join(kind.where("kind = 'free'"), "c").select(F.col("v").alias("mention"), F.coalesce("page", F.concat(F.lit("m:"), "least")).alias("cluster"))
    small = kind.where("kind = 'small'").select("c")
    rows = edge.join(of("a"), "a").select(F.col("ca").alias("c"), F.lit("same").alias("kind"), "a", "b", "cos").union(diff.select("c", F.lit("different"), "a", "b", F.lit(0.0))).union(paged.where("page is not null").select("c", F.lit("page"), F.col("v"), "page", F.lit(0.0)))
    told = cut(rows.join(small, "c", "left_semi").groupBy("c").applyInPandas(merge_one, "kind string, a string, b string, reason string"), kept)
    clusters = free.union(told.where("kind = 'member'").select("a", "b"))
    refused = told.where("kind = 'refused'").select("a", "b", "reason")
    large = kind.where("kind = 'large'").select("c")
    if not large.isEmpty():
        inside = cut(comp.join(large, "c", "left_semi"), kept)
        some = m.join(inside.select(F.col("v").alias("id")), "id", "left_semi")
        more, no = rounds_of_merges(some, edge, diff.select("a", "b"))
        clusters, refused = clusters.union(more), refused.union(no)
    alone = m.join(comp.select(F.col("v").alias("id")), "id", "left_anti").select(F.col("id").alias("mention"), F.coalesce("page", F.concat(F.lit("m:"), "id")).alias("cluster"))
    clusters, refused = cut(clusters.union(alone)), cut(refused)
    drop(mentions.sparkSession, kept)
    return clusters, refused


def rounds_of_merges(mentions: DataFrame, same: DataFrame, different: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of mentions (id, page), without one task for a component: in each round every edge that comes first among the edges at both of its
    clusters is decided, since no other can change either cluster before it. The rounds are as many as the longest chain of edges in falling order.
    """
    spark = mentions.sparkSession
    kept: list[str] = []
    m = mentions.select("id", "page")
    label = cut(m.select("id", F.col("id").alias("c"), "page"), kept)
    rest = cut(same.join(m.select(F.col("id").alias("a")), "a").join(m.select(F.col("id").alias("b")), "b").groupBy("a", "b").agg(F.max("cos").alias("cos")).where("a != b"), kept)
    diff = different.select("a", "b").union(different.select("b", "a")).distinct()
    diff = cut(diff, kept)
    refused = None
    while True:
        la = label.select(F.col("id").alias("a"), F.col("c").alias("ca"))
        lb = label.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        open_ = cut(rest.join(la, "a").join(lb, "b").where("ca != cb"), kept)
        if open_.isEmpty():
            break
        key = F.struct((-F.col("cos")).alias("o"), "a", "b")
        ends = open_.select(F.col("ca").alias("c"), key.alias("k")).union(open_.select("cb", key.alias("k"))).groupBy("c").agg(F.min("k").alias("k"))
        first = open_.withColumn("k", key).join(ends.select(F.col("c").alias("ca"), F.col("k").alias("ka")), "ca").join(ends.select(F.col("c").alias("cb"), F.col("k").alias("kb")), "cb").where("k = ka and k = kb").select("a", "b", "cos", "ca", "cb")
        first = cut(first, kept)
        pages = label.where("page is not null").groupBy("c").agg(F.min("page").alias("p"))
        apart = diff.join(la, "a").join(lb, "b").select("ca", "cb").distinct().withColumn("apart", F.lit(True))
        told = first.join(pages.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca", "left").join(pages.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb", "left").join(apart, ["ca", "cb"], "left")
        told = cut(told.withColumn("reason", F.when(F.col("pa") != F.col("pb"), "two_pages").when(F.col("apart"), "cannot_link")), kept)
        now = told.where("reason is not null").select("a", "b", "reason")
        refused = now if refused is None else refused.union(now)
        merged = told.where("reason is null").select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("to"))
        label = cut(label.join(merged, "c", "left").select("id", F.coalesce("to", "c").alias("c"), "page"), kept)
        rest = cut(open_.select("a", "b", "cos").join(first.select("a", "b"), ["a", "b"], "left_anti"), kept)
    name = label.groupBy("c").agg(F.coalesce(F.min("page"), F.concat(F.lit("m:"), F.min("id"))).alias("cluster"))
    clusters = cut(label.join(name, "c").select(F.col("id").alias("mention"), "cluster"))
    out = cut(refused) if refused is not None else spark.createDataFrame([], "a string, b string, reason string")
    drop(spark, kept)
    return clusters, out
