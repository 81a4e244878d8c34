"""Graph queries: entities from mentions, facts as edges, neighbours, seeds, paths and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import DATE_RELATIONS, norm_name, token_count
from weft.operators import graph as G
from weft.operators import retrieval as R
from weft.plans import inputs as I
from weft.plans.retrieval import BUDGET, GRAPH_SHARE, sql_pack
from weft.sources.tables import table


def clustering(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with its cluster of the older clustering, or one of its own."""
    c = table(spark, d, "cluster_of").where("mention is not null and cluster is not null").groupBy("mention").agg(F.min("cluster").alias("cluster"))
    return I.mentions(spark, d).select(F.col("id").alias("mention")).join(c, "mention", "left").select("mention", F.coalesce("cluster", F.concat(F.lit("m:"), "mention")).alias("cluster"))


CLUSTERS = "cl as (select me.id as mention, coalesce(c.cluster, 'm:' || me.id) as cluster from me left join (select mention, min(cluster) as cluster from cluster_of where mention is not null and cluster is not null group by mention) c on c.mention = me.id)"


def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_rows(I.mentions(spark, d), clustering(spark, d))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """Triples with the entities of subject and object, by the norm of exactly one entity's name or aliases; null otherwise."""
    ix = G.alias_index(I.entities(spark, d)).groupBy("phrase").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("phrase", "id")
    t = I.triples(spark, d)
    side = lambda c, o: ix.select(F.col("phrase").alias(f"{c}n"), F.col("id").alias(o))
    t = t.withColumn("subjectn", norm_name(F.col("subject"))).withColumn("objectn", norm_name(F.col("object")))
    return t.join(side("subject", "s"), "subjectn", "left").join(side("object", "o"), "objectn", "left")


def graph_rels(spark: SparkSession, d: str) -> DataFrame:
    """(source, rel, target, sources): relations between entities with the number of chunks or subjects that state them."""
    r = resolved(spark, d).where(~F.col("relation").isin(DATE_RELATIONS) & F.col("s").isNotNull() & F.col("o").isNotNull() & (F.col("s") != F.col("o")))
    return r.groupBy(F.col("s").alias("source"), F.col("relation").alias("rel"), F.col("o").alias("target")).agg(F.count("*").alias("sources"))


def graph_dates(spark: SparkSession, d: str) -> DataFrame:
    """(id, property, values): the distinct dates of an entity, sorted."""
    r = resolved(spark, d).where(F.col("relation").isin(DATE_RELATIONS) & F.col("s").isNotNull())
    return r.groupBy(F.col("s").alias("id"), F.translate("relation", " ", "_").alias("property")).agg(F.array_join(F.array_sort(F.collect_set("object")), "|").alias("values"))


def graph_drops(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the triples: the first reason that drops one, a date property, or an edge."""
    why = F.when(F.col("s").isNull(), "subject unknown").when(F.col("relation").isin(DATE_RELATIONS), "date").when(F.col("o").isNull(), "object unknown").when(F.col("s") == F.col("o"), "self loop").otherwise("edge")
    return resolved(spark, d).groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


def exact_titles(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, mentions): clusters of mentions that have the name of exactly one page, which is in another cluster."""
    m = I.mentions(spark, d).select(F.col("id").alias("mention"), norm_name(F.col("name")).alias("n"), F.coalesce("is_page", F.lit(False)).alias("is_page")).join(clustering(spark, d), "mention")
    page = m.where("is_page and n != ''").groupBy("n").agg(F.count("*").alias("k"), F.min("cluster").alias("target")).where("k = 1").select("n", "target")
    got = m.where("not is_page").join(page, "n").where("cluster != target")
    return got.groupBy(F.col("cluster").alias("source"), "target").agg(F.count("*").alias("mentions"), F.min("mention").alias("first"))


def degree_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(I.edges(spark, d))


def hubs(spark: SparkSession, d: str) -> DataFrame:
    """The 15 nodes of the highest degree, ties by id, and whether they are hubs."""
    return degree_rows(spark, d).orderBy(F.desc("degree"), "node").limit(15).select("node", "degree", (F.col("degree") > G.HUB_DEGREE).alias("hub"))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    e = I.edges(spark, d)
    deg = G.degrees(e)
    by = e.groupBy("rel").agg(F.count("*").alias("n")).select(F.concat(F.lit("edges: "), "rel").alias("name"), "n")
    return by.union(e.agg(F.lit("edges").alias("name"), F.count("*"))).union(deg.agg(F.lit("nodes"), F.count("*"))).union(deg.agg(F.lit("max degree"), F.max("degree"))).union(deg.agg(F.lit("hubs"), F.count_if(F.col("degree") > G.HUB_DEGREE)))


def near(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(I.edges(spark, d), I.entities(spark, d).select("id", "name"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return near(spark, d).withColumn("place", F.col("place").cast("bigint"))


def seed_rows(spark: SparkSession, d: str) -> DataFrame:
    q = I.questions(spark, d).where("question is not null").select(F.col("id").alias("question_id"), "question")
    p = table(spark, d, "probe_questions").where("id is not null and question is not null").select(F.col("id").alias("question_id"), "question").distinct()
    return G.verbatim_seeds(q.union(p), G.alias_index(I.entities(spark, d)))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return seed_rows(spark, d).withColumn("rank", F.col("rank").cast("bigint"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of two hops and fewer from each question's seeds."""
    p = G.two_hops(seed_rows(spark, d), near(spark, d), degree_rows(spark, d))
    return p.select("question_id", "hops", F.array_join("nodes", " > ").alias("nodes"), "text", F.round("factor", 6).alias("factor")).withColumn("hops", F.col("hops").cast("bigint"))


def path_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ten best stored paths of each question by score x hub factor, equal ones by text."""
    p = table(spark, d, "paths").where("question_id is not null and text is not null and score is not null and not isnan(score)").groupBy("question_id", "text").agg(F.max("score").alias("score"), F.max("nodes").alias("nodes"))
    mid = p.select("question_id", "text", "score", F.explode_outer(F.expr("slice(nodes, 2, greatest(size(nodes) - 2, 0))")).alias("node")).join(degree_rows(spark, d), "node", "left")
    f = mid.groupBy("question_id", "text", "score").agg(F.exp(F.sum(F.when(F.col("node").isNotNull(), -F.log(F.log2(2 + F.coalesce("degree", F.lit(0))))).otherwise(0.0))).alias("f"))
    got = f.withColumn("score", F.round(F.col("score") * F.col("f"), 8))
    return R.ranked(got, "question_id", "score", "text", 10).select("question_id", "text", F.round(F.col("score") + 1e-9, 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def graph_context(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the best paths within half of the budget, then the pages of their nodes, each once, in what is left of it; what doesn't fit is skipped."""
    p = table(spark, d, "paths").where("question_id is not null and text is not null and score is not null and not isnan(score)").groupBy("question_id", "text").agg(F.max("score").alias("score"), F.max("sources").alias("sources"), F.max("nodes").alias("nodes"))
    top = R.ranked(p, "question_id", "score", "text", 10)
    fact = token_count(F.concat(F.lit("Fact: "), "text", F.lit(" [source: "), F.array_join("sources", ", "), F.lit("]"))) + 1
    rows = top.select("question_id", "rank", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.col("text").alias("item"), fact.alias("cost")).where("cost is not null")
    page = I.entities(spark, d).where("page_chunk_id is not null").select(F.col("id").alias("node"), F.col("page_chunk_id").alias("chunk_id"))
    ch = I.chunks(spark, d).select(F.col("id").alias("chunk_id"), R.block_cost(F.col("title"), F.col("text")).alias("cost")).where("cost is not null")
    pages = top.select("question_id", "rank", F.posexplode("nodes").alias("i", "node")).join(page, "node").join(ch, "chunk_id")
    pages = pages.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy("rank", "i"))).where("r = 1").select("question_id", "rank", F.lit(1).alias("kind"), "i", F.col("chunk_id").alias("item"), "cost")
    every = rows.union(pages).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "i", "item", F.col("cost").cast("bigint").alias("cost")))).alias("l"))
    budget = int(BUDGET * GRAPH_SHARE)
    step = lambda a, x: F.when(a["t"] + x["cost"] <= budget, F.struct((a["t"] + x["cost"]).alias("t"), (a["f"] + F.when(x["kind"] == 0, 1).otherwise(0)).alias("f"), F.when(x["kind"] == 1, F.concat(a["ids"], F.array(x["item"]))).otherwise(a["ids"]).alias("ids"))).otherwise(a)
    out = every.select("question_id", F.aggregate("l", F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("f"), F.array().cast("array<string>").alias("ids")), step).alias("p"))
    return out.select("question_id", F.col("p.f").cast("bigint").alias("facts"), F.array_join("p.ids", "|").alias("chunk_ids"), F.col("p.t").alias("tokens"))


def entity_card(spark: SparkSession, d: str) -> DataFrame:
    """Of each entity with edges: how many, its first relations (50 at most) by chunks, relation and ends, and its page."""
    e = I.edges(spark, d).withColumn("w", F.size("chunk_ids"))
    both = e.select(F.col("source").alias("id"), "source", "rel", "target", "w").union(e.where("source != target").select("target", "source", "rel", "target", "w"))
    order = Window.partitionBy("id").orderBy(F.desc("w"), "rel", "source", "target")
    top = both.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("r <= 50")
    one = top.groupBy("id").agg(F.max("n").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("source", F.lit(" -"), "rel", F.lit("-> "), "target").alias("t")))), lambda x: x["t"]).alias("l"))
    return one.join(I.entities(spark, d), "id", "left").select("id", "name", "total", F.array_join("l", "; ").alias("relations"), "page_chunk_id")


def view_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the exported view with their component, over the undirected edges."""
    from weft.operators.components import reachable

    e = I.edges(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"))
    c = reachable(e, e.select(F.col("a").alias("v")).union(e.select("b")).distinct())
    return c.groupBy("c").agg(F.count("*").alias("size")).select(F.col("c").alias("component"), "size")


def same_name_twins(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose name another entity has too."""
    return I.entities(spark, d).select("id", norm_name(F.col("name")).alias("n")).where("n != ''").groupBy("n").agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids")).where("k > 1")


_N = I.sql_norm_name
AL = f"al as (select distinct {_N('a')} as phrase, id, coalesce(is_page, false) as is_page from (select id, is_page, unnest(list_prepend(name, coalesce(aliases, []))) as a from en) where a is not null and len({_N('a')}) >= 3)"
RESOLVED = f"""{I.ENTITIES}, {I.QUESTIONS}, {I.TRIPLES}, {AL}, ix as (select phrase, min(id) as id from al group by phrase having count(*) = 1),
    rs as (select tr.*, x.id as s, y.id as o from tr left join ix x on x.phrase = {_N('subject')} left join ix y on y.phrase = {_N('object')})"""
DATES = "('date of birth', 'date of death', 'publication date', 'inception')"
DEGREE = "dg as (select node, count(*) as degree from (select source as node from ed union all select target from ed) group by node)"
NEAR = """bo as (select distinct * from (select source as node, target as neighbour, source, rel, target, len(chunk_ids) as w from ed union all select target, source, source, rel, target, len(chunk_ids) from ed) where node <> neighbour),
    nr as (select node, neighbour, source, rel, target, row_number() over (partition by node order by w desc, coalesce(name, neighbour), neighbour, rel, source) as place from bo left join en on en.id = bo.neighbour qualify place <= 20)"""
TOP = """tp as (select question_id, text, max(score) as score, max(sources) as sources, max(nodes) as nodes from paths where question_id is not null and text is not null and score is not null and not isnan(score) group by question_id, text),
    tt as (select *, row_number() over (partition by question_id order by score desc, text) as rank from tp qualify rank <= 10)"""
QUERIES = {
    "graph_entities": graph_entities, "graph_rels": graph_rels, "graph_dates": graph_dates, "graph_drops": graph_drops, "exact_titles": exact_titles, "degrees": degree_rows, "hubs": hubs, "graph_stats": graph_stats, "adjacency_topn": adjacency, "seeds_ngram": seeds, "paths_2hop": paths, "path_scores": path_scores,
    "graph_context": graph_context, "entity_card": entity_card, "view_components": view_nodes, "same_name_twins": same_name_twins,
}
SQL = {
    "graph_entities": f"""with {I.MENTIONS}, {CLUSTERS}, m as (select me.*, cl.cluster from me join cl on cl.mention = me.id),
        nn as (select cluster, arg_min(name, {{'o': -n, 'v': name}}) as name from (select cluster, name, count(*) as n from m group by 1, 2) group by cluster),
        ty as (select cluster, arg_min(type, {{'o': -n, 'v': type}}) as type from (select cluster, type, count(*) as n from m where type is not null group by 1, 2) group by cluster)
        select m.cluster as id, any_value(nn.name) as name, any_value(ty.type) as type, string_agg(distinct m.name, '|' order by m.name) as aliases, coalesce(bool_or(is_page), false) as is_page, arg_min(chunk_id, m.id) filter (where is_page) as page_chunk_id, count(*) as mentions
        from m left join nn using (cluster) left join ty using (cluster) group by m.cluster""",
    "graph_rels": f"with {RESOLVED} select s as source, relation as rel, o as target, count(*) as sources from rs where relation not in {DATES} and s is not null and o is not null and s <> o group by 1, 2, 3",
    "graph_dates": f"with {RESOLVED} select s as id, replace(relation, ' ', '_') as property, string_agg(distinct object, '|' order by object) as values from rs where relation in {DATES} and s is not null group by 1, 2",
    "graph_drops": f"with {RESOLVED} select case when s is null then 'subject unknown' when relation in {DATES} then 'date' when o is null then 'object unknown' when s = o then 'self loop' else 'edge' end as outcome, count(*) as n from rs group by 1",
    "exact_titles": f"""with {I.MENTIONS}, {CLUSTERS}, m as (select me.id as mention, {_N('name')} as n, coalesce(is_page, false) as is_page, cluster from me join cl on cl.mention = me.id), p as (select n, min(cluster) as target from m where is_page and n <> '' group by n having count(*) = 1)
        select cluster as source, target, count(*) as mentions, min(mention) as first from m join p using (n) where not is_page and cluster <> target group by 1, 2""",
    "degrees": f"with {I.EDGES}, {DEGREE} select * from dg",
    "hubs": f"with {I.EDGES}, {DEGREE} select node, degree, degree > 25 as hub from dg order by degree desc, node limit 15",
    "graph_stats": f"with {I.EDGES}, {DEGREE} select 'edges: ' || rel as name, count(*) as n from ed group by rel union all select 'edges', count(*) from ed union all select 'nodes', count(*) from dg union all select 'max degree', max(degree) from dg union all select 'hubs', count(*) filter (where degree > 25) from dg",
    "adjacency_topn": f"with {I.EDGES}, {I.ENTITIES}, {NEAR} select * from nr",
    "path_scores": f"""with {I.EDGES}, {DEGREE}, {TOP.split(', tt as')[0].strip().rstrip(',')}, sc as (select question_id, text, round(score * coalesce((select exp(sum(-ln(log2(2 + coalesce(dg.degree, 0))))) from (select unnest(nodes[2:-2]) as node) x left join dg on dg.node = x.node), 1), 8) as s from tp where true)
        select question_id, text, round(s + 1e-9, 6) as score, row_number() over (partition by question_id order by s desc, text) as rank from sc qualify rank <= 10""",
    "graph_context": f"""with {I.CHUNKS}, {I.ENTITIES}, {TOP}, fa as (select question_id, 0 as kind, rank, 0 as i, text as chunk_id, {I.sql_token_count("'Fact: ' || text || ' [source: ' || array_to_string(sources, ', ') || ']'")} + 1 as cost from tt where sources is not null),
        nd as (select question_id, rank, unnest(nodes) as node, unnest(range(len(nodes))) as i from tt),
        pg as (select question_id, 1 as kind, rank, i, en.page_chunk_id as chunk_id, {I.sql_token_count("'[' || ch.title || '] ' || ch.text")} + 2 as cost from nd join en on en.id = nd.node join ch on ch.id = en.page_chunk_id where ch.title is not null qualify row_number() over (partition by question_id, en.page_chunk_id order by rank, i) = 1),
        al as (select * from fa union all select * from pg),
        pk as (select question_id, list_reduce(list_prepend({{'kind': 0, 'chunk_id': '', 'cost': 0, 'tokens': 0, 'facts': 0, 'ids': []::varchar[]}}, list({{'kind': kind, 'chunk_id': chunk_id, 'cost': cost, 'tokens': 0, 'facts': 0, 'ids': []::varchar[]}} order by kind, rank, i, chunk_id)),
            lambda a, x: case when a.tokens + x.cost <= {int(BUDGET * GRAPH_SHARE)} then {{'kind': 0, 'chunk_id': '', 'cost': 0, 'tokens': a.tokens + x.cost, 'facts': a.facts + 1 - x.kind, 'ids': case when x.kind = 1 then list_append(a.ids, x.chunk_id) else a.ids end}} else a end) as p from al group by question_id)
        select question_id, cast(p.facts as bigint) as facts, array_to_string(p.ids, '|') as chunk_ids, cast(p.tokens as bigint) as tokens from pk""",
    "entity_card": f"""with {I.EDGES}, {I.ENTITIES}, bo as (select source as id, source, rel, target, len(chunk_ids) as w from ed union all select target, source, rel, target, len(chunk_ids) from ed where source <> target),
        r as (select *, row_number() over (partition by id order by w desc, rel, source, target) as r, count(*) over (partition by id) as n from bo)
        select r.id, any_value(en.name) as name, max(n) as total, string_agg(source || ' -' || rel || '-> ' || target, '; ' order by r) as relations, any_value(en.page_chunk_id) as page_chunk_id from r left join en on en.id = r.id where r <= 50 group by r.id""",
    "view_components": f"""with recursive {I.EDGES}, e as (select source as a, target as b from ed union select target, source from ed), r as (select a, a as c from e union select r.a, e.b from r join e on r.c = e.a), m as (select a, min(c) as component from r group by a)
        select component, count(*) as size from m group by component""",
    "same_name_twins": f"with {I.ENTITIES}, n as (select id, {_N('name')} as n from en) select n, count(*) as k, string_agg(id, '|' order by id) as ids from n where n <> '' group by n having count(*) > 1",
    "paths_2hop": "",
}
del SQL["paths_2hop"]
