"""Entity resolution queries over mentions, pilot_decisions, embeddings and the registered entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.similarity import name_ratio
from weft.functions.text import norm_name, parse_date, dates_match, DATE_RELATIONS
from weft.operators import resolution as R
from weft.operators.components import reachable
from weft.plans import inputs as I
from weft.plans.retrieval import dense_topk
from weft.sources.tables import cut, table

T_LOW, SEED = 0.3, "42:m3"


def norm_names(spark: SparkSession, d: str) -> DataFrame:
    return I.mentions(spark, d).select("name").distinct().select("name", norm_name(F.col("name")).alias("norm"))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return I.mentions(spark, d).where("chunk_id is not null").select("chunk_id").distinct().select("chunk_id", R.split_of(F.col("chunk_id"), SEED).alias("part"))


def mention_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mentions built anew from the named entities of each chunk, in their order there."""
    e = I.mentions(spark, d).where(r"chunk_id is not null and type is not null").select("chunk_id", F.regexp_extract("id", r"::(\d+)$", 1).alias("pos"), "name", "type").where("pos != ''").withColumn("pos", F.col("pos").cast("bigint"))
    return R.built_mentions(e, I.chunks(spark, d).select(F.col("id").alias("chunk_id"), "title"))


def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of pairs with one name, each mention's three most similar ones: from either side, ties by the other's id."""
    p = I.decisions(spark, d).where("exact and cos is not null and not isnan(cos)")
    both = p.select(F.col("a").alias("m"), F.col("b").alias("o"), "cos").union(p.select("b", "a", "cos"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("cos"), "o"))).where(F.col("r") <= R.EXACT_K)
    return top.select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"), "cos").distinct()


def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct names with a ratio of 85 and more."""
    return R.fuzzy_names(I.mentions(spark, d).select(norm_name(F.col("name")).alias("norm"))).select("x", "y", F.round("ratio", 4).alias("ratio"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    return R.knn_pairs(dense_topk(spark, d), T_LOW)


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with all sources that gave them, without pairs of two pages and of types that can't be one."""
    s = table(spark, d, "pilot_decisions").where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.explode_outer("sources").alias("s"))
    s = s.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))
    m = I.mentions(spark, d).select("id", "type", F.coalesce("is_page", F.lit(False)).alias("page"), "split")
    side = lambda x: m.select(F.col("id").alias(x), F.col("type").alias(f"t{x}"), F.col("page").alias(f"p{x}"), F.col("split").alias(f"s{x}"))
    got = s.join(side("a"), "a").join(side("b"), "b").where(~(F.col("pa") & F.col("pb")) & R.types_compatible(F.col("ta"), F.col("tb")))
    return got.select("a", "b", "sources", R.pair_split(F.col("pa"), F.col("sa"), F.col("pb"), F.col("sb")).alias("part"))


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = I.decisions(spark, d)
    m = I.mentions(spark, d).select("id", "chunk_id", F.coalesce("is_page", F.lit(False)).alias("is_page"))
    return m, v.where("verdict = 'same'").select("a", "b", F.coalesce("cos", F.lit(0.0)).alias("cos")), v.where("verdict = 'different'").select("a", "b")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Constrained clusters of all mentions by the judged pairs."""
    return R.constrained_clusters(*judged(spark, d))[0]


def refusals(spark: SparkSession, d: str) -> DataFrame:
    return R.constrained_clusters(*judged(spark, d))[1]


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many clusters have how many mentions, of the older clustering."""
    c = table(spark, d, "cluster_of").where("mention is not null and cluster is not null").distinct()
    return c.groupBy("cluster").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the judged-same pairs, named by their least mention."""
    e = I.decisions(spark, d).where("verdict = 'same'").select("a", "b")
    v = e.select(F.col("a").alias("v")).union(e.select("b")).distinct()
    return reachable(e, v).select(F.col("v").alias("mention"), F.col("c").alias("component"))


def pair_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Judged pairs by kind: the same name with one page, with several, or none; another name by fuzzy ratio or by embedding alone."""
    m = I.mentions(spark, d).withColumn("n", norm_name(F.col("name")))
    pages = m.where("is_page").groupBy("n").agg(F.count("*").alias("pages"))
    side = lambda x: m.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"))
    p = I.decisions(spark, d).join(side("a"), "a").join(side("b"), "b").join(pages.withColumnRenamed("n", "na"), "na", "left")
    k = F.coalesce("pages", F.lit(0))
    kind = F.when((F.col("na") == F.col("nb")) & (k == 1), "exact, one page").when((F.col("na") == F.col("nb")) & (k > 1), "exact, several pages").when(F.col("na") == F.col("nb"), "exact, no page").when(F.col("name_ratio") >= 85, "fuzzy").otherwise("embedding")
    return p.groupBy(kind.alias("kind"), F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


def known_negatives(spark: SparkSession, d: str) -> DataFrame:
    """(mention, page): pages that have a mention's name but stand in another cluster than it."""
    c = table(spark, d, "cluster_of").where("mention is not null and cluster is not null").groupBy("mention").agg(F.min("cluster").alias("cluster"))
    m = I.mentions(spark, d).select("id", norm_name(F.col("name")).alias("n"), F.coalesce("is_page", F.lit(False)).alias("is_page")).join(c.withColumnRenamed("mention", "id"), "id").where("n != ''")
    p = m.where("is_page").select("n", F.col("id").alias("page"), F.col("cluster").alias("pc"))
    return m.where("not is_page").join(p, "n").where("cluster != pc").select(F.col("id").alias("mention"), "page")


def gold_triples(spark: SparkSession, d: str) -> DataFrame:
    """(subject, relation, object, chunk_id): each evidence triple once, with the gold chunk about its subject; triples without exactly one are left out."""
    from weft.plans.corpus import facts

    f = facts(spark, d)
    first = f.withColumn("r", F.row_number().over(Window.partitionBy("subject", "relation", "object").orderBy("id", "pos"))).where("r = 1")
    ch = I.chunks(spark, d).select(F.col("id").alias("chunk_id"), "title")
    m = first.withColumn("chunk_id", F.explode(F.array_distinct("gold_chunk_ids"))).join(ch, "chunk_id").where((F.lower("title") == F.lower("subject")) | (norm_name(F.col("title")) == norm_name(F.col("subject"))))
    return m.groupBy("subject", "relation", "object").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n = 1").drop("n")


def bridge_links(spark: SparkSession, d: str) -> DataFrame:
    """(relation, subject_chunk, object_chunk, mention_id, page_id): triples whose object has exactly one gold chunk of its own, with the mention of the
    object in the subject's chunk and the page mention of the object's; first relation of each pair of chunks."""
    t = gold_triples(spark, d).where(~F.col("relation").isin(DATE_RELATIONS))
    gold = I.questions(spark, d).select(F.explode("gold_chunk_ids").alias("id")).distinct()
    ch = I.chunks(spark, d).join(gold, "id", "left_semi").select(F.col("id").alias("object_chunk"), norm_name(F.col("title")).alias("n")).where("n != ''")
    j = t.withColumn("n", norm_name(F.col("object"))).join(ch, "n").where("object_chunk != chunk_id")
    one = j.groupBy("subject", "relation", "object", "chunk_id", "n").agg(F.count("*").alias("k"), F.min("object_chunk").alias("object_chunk")).where("k = 1")
    one = one.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id", "object_chunk").orderBy("relation", "subject", "object"))).where("r = 1")
    m = I.mentions(spark, d).withColumn("n", norm_name(F.col("name")))
    men = m.where("not coalesce(is_page, false)").groupBy("chunk_id", "n").agg(F.min("id").alias("mention_id"))
    page = m.where("is_page").groupBy(F.col("chunk_id").alias("object_chunk")).agg(F.min("id").alias("page_id"))
    return one.join(men, ["chunk_id", "n"], "left").join(page, "object_chunk", "left").select("relation", F.col("chunk_id").alias("subject_chunk"), "object_chunk", "mention_id", "page_id")


def bridge_chunks(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, chunk_id): gold chunks of entities that are object of one triple of a question and subject of another."""
    q = I.questions(spark, d).select("id", "gold_chunk_ids", F.filter("evidences", lambda e: F.size(e) == 3).alias("e"))
    subjects = F.transform("e", lambda e: norm_name(e[0]))
    objects = F.transform("e", lambda e: norm_name(e[2]))
    b = q.select(F.col("id").alias("question_id"), F.explode(F.array_distinct("gold_chunk_ids")).alias("chunk_id"), F.array_intersect(objects, subjects).alias("b")).where("size(b) > 0")
    ch = I.chunks(spark, d).select(F.col("id").alias("chunk_id"), norm_name(F.col("title")).alias("n"))
    return b.join(ch, "chunk_id").where("array_contains(b, n)").select("question_id", "chunk_id")


def triple_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Recall and slot precision of the edges of the paths against the gold triples, per relation and over all (relation null): subject and object by norm, dates by parts."""
    g = gold_triples(spark, d).select("relation", norm_name(F.col("subject")).alias("s"), "object").distinct()
    names = I.entities(spark, d).select("id", "name")
    x = I.edges(spark, d).join(names.select(F.col("id").alias("source"), F.col("name").alias("sn")), "source", "left").join(names.select(F.col("id").alias("target"), F.col("name").alias("tn")), "target", "left")
    x = x.select(F.col("rel").alias("relation"), norm_name(F.coalesce("sn", "source")).alias("s"), F.coalesce("tn", "target").alias("found")).distinct()
    ok = F.when(F.col("relation").isin(DATE_RELATIONS), dates_match(parse_date(F.col("object")), parse_date(F.col("found")))).otherwise(norm_name(F.col("object")) == norm_name(F.col("found")))
    met = cut(g.join(x, ["relation", "s"]).withColumn("ok", F.coalesce(ok, F.lit(False))))
    rec = g.join(met.groupBy("relation", "s", "object").agg(F.max("ok").alias("ok")), ["relation", "s", "object"], "left").select("relation", F.lit(1).alias("gold"), F.coalesce("ok", F.lit(False)).cast("int").alias("recalled"), F.lit(0).alias("slots"), F.lit(0).alias("right"))
    slot = met.groupBy("relation", "s", "found").agg(F.max("ok").cast("int").alias("r")).select("relation", F.lit(0), F.lit(0), F.lit(1), "r")
    out = rec.union(slot).rollup("relation").agg(*(F.sum(c).alias(c) for c in ("gold", "recalled", "slots", "right")))
    return out.select("relation", "gold", "recalled", "slots", "right", F.round(F.when(F.col("gold") > 0, F.col("recalled") / F.col("gold")), 4).alias("recall"), F.round(F.when(F.col("slots") > 0, F.col("right") / F.col("slots")), 4).alias("precision"))


def id_repair(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose gold titles, taken as chunk ids, miss exactly one id and have exactly one other: repaired if one is the beginning of the other or the ratio is 90."""
    q = I.questions(spark, d).select("id", F.array_distinct("gold_chunk_ids").alias("sent"), F.array_distinct("gold_titles").alias("got"))
    q = q.withColumn("m", F.array_except("sent", "got")).withColumn("e", F.array_except("got", "sent")).where("size(m) = 1 and size(e) = 1").select("id", F.col("m")[0].alias("missing"), F.col("e")[0].alias("extra"))
    near = F.col("missing").startswith(F.col("extra")) | F.col("extra").startswith(F.col("missing")) | (name_ratio("missing", "extra") >= R.ENDPOINT_MIN)
    return q.select("id", "missing", "extra", near.alias("repaired"))


_N = I.sql_norm_name
FACTS = "fa as (select id, gold_chunk_ids, p - 1 as pos, e[1] as subject, e[2] as relation, e[3] as object from (select id, gold_chunk_ids, unnest(evidences) as e, unnest(range(1, len(evidences) + 1)) as p from qu) where len(e) = 3)"
GOLD = f"""{I.QUESTIONS}, {I.CHUNKS}, {FACTS}, f1 as (select * from fa qualify row_number() over (partition by subject, relation, object order by id, pos) = 1),
    gt as (select subject, relation, object, min(f.cid) as chunk_id from (select *, unnest(list_distinct(gold_chunk_ids)) as cid from f1) f join ch c on c.id = f.cid where lower(c.title) = lower(subject) or {_N('c.title')} = {_N('subject')} group by 1, 2, 3 having count(*) = 1)"""
DATES = "('date of birth', 'date of death', 'publication date', 'inception')"
QUERIES = {
    "norm_names": norm_names, "hash_split": hash_split, "mention_rows": mention_rows, "pairs_exact_topk": exact_topk, "pairs_fuzzy": fuzzy, "pairs_knn": knn, "candidate_union": candidate_union, "cluster_constrained": clusters, "cluster_refusals": refusals, "cluster_sizes": cluster_sizes,
    "components": components, "pair_kinds": pair_kinds, "known_negatives": known_negatives, "gold_triples": gold_triples, "bridge_links": bridge_links, "bridge_chunks": bridge_chunks, "triple_scoring": triple_scoring, "id_repair": id_repair,
}
SQL = {
    "norm_names": f"with {I.MENTIONS} select distinct name, {_N('name')} as norm from me",
    "hash_split": f"with {I.MENTIONS} select distinct chunk_id, case when list_reduce(list_prepend(0, list_transform(string_split(sha1('{SEED}:' || chunk_id), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::int)), lambda a, c: (a * 16 + c) % 100) < 30 then 'tune' else 'report' end as part from me where chunk_id is not null",
    "mention_rows": f"""with {I.MENTIONS}, {I.CHUNKS}, e as (select m.chunk_id, regexp_extract(m.id, '::(\\d+)$', 1) as p, m.name, m.type, c.title from me m join ch c on c.id = m.chunk_id where m.type is not null),
        n as (select chunk_id, p::bigint as pos, type, {_N('name')} as norm, {_N('title')} as tn from e where p <> ''),
        b as (select *, pos = coalesce(min(pos) filter (where norm = tn) over (partition by chunk_id), min(pos) over (partition by chunk_id)) as is_page, row_number() over (partition by chunk_id, norm, type order by pos) as r from n)
        select chunk_id || '::' || pos as id, chunk_id, norm, type, is_page from b where norm <> '' and (r = 1 or is_page)""",
    "pairs_exact_topk": f"""with {I.DECISIONS}, p as (select * from de where exact and cos is not null and not isnan(cos)), b as (select a as m, b as o, cos from p union all select b, a, cos from p)
        select distinct least(m, o) as a, greatest(m, o) as b, cos from (select * from b qualify row_number() over (partition by m order by cos desc, o) <= 3)""",
    "pairs_knn": f"""with t as (select a.vec_id as q, b.vec_id as v, list_dot_product(a.embedding::double[], b.embedding::double[]) as s, row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 8) desc, b.vec_id) as r from embeddings a join embeddings b on a.vec_id <> b.vec_id)
        select least(q, v) as a, greatest(q, v) as b, max(round(round(s, 8) + 2e-9, 5)) as cos from t where r <= 10 and round(round(s, 8) + 2e-9, 5) >= {T_LOW} group by 1, 2""",
    "candidate_union": f"""with {I.MENTIONS}, s as (select least(a, b) as a, greatest(a, b) as b, unnest(case when len(sources) > 0 then sources else [null] end) as s from pilot_decisions where a is not null and b is not null and a <> b),
        u as (select a, b, coalesce(string_agg(distinct s, ',' order by s), '') as sources from s group by a, b), p as (select id, type, coalesce(is_page, false) as page, split from me)
        select u.a, u.b, sources, case when coalesce(not (x.page and y.page) and (x.page or x.split = 'tune') and (y.page or y.split = 'tune'), false) then 'tune' else 'report' end as part from u join p x on x.id = u.a join p y on y.id = u.b
        where not (x.page and y.page) and (x.type = y.type or x.type = 'OTHER' or y.type = 'OTHER' or (x.type in ('FILM', 'WORK') and y.type in ('FILM', 'WORK')))""",
    "cluster_sizes": "select size, count(*) as clusters from (select cluster, count(*) as size from (select distinct mention, cluster from cluster_of where mention is not null and cluster is not null) group by cluster) group by size",
    "components": f"""with recursive {I.DECISIONS}, e as (select a, b from de where verdict = 'same' union select b, a from de where verdict = 'same'), r as (select a, b as c from e union select r.a, e.b from r join e on r.c = e.a)
        select a as mention, min(c) as component from (select a, c from r union select a, a from r) group by a""",
    "pair_kinds": f"""with {I.MENTIONS}, {I.DECISIONS}, n as (select id, is_page, {_N('name')} as n from me), pg as (select n, count(*) as pages from n where is_page group by n)
        select case when x.n = y.n and pages = 1 then 'exact, one page' when x.n = y.n and pages > 1 then 'exact, several pages' when x.n = y.n then 'exact, no page' when name_ratio >= 85 then 'fuzzy' else 'embedding' end as kind, coalesce(verdict, 'none') as verdict, count(*) as n
        from de join n x on x.id = de.a join n y on y.id = de.b left join pg on pg.n = x.n group by 1, 2""",
    "known_negatives": f"""with {I.MENTIONS}, c as (select mention, min(cluster) as cluster from cluster_of where mention is not null and cluster is not null group by mention),
        m as (select id, {_N('name')} as n, coalesce(is_page, false) as is_page, cluster from me join c on c.mention = me.id) select a.id as mention, b.id as page from m a join m b on a.n = b.n and a.n <> '' and not a.is_page and b.is_page and a.cluster <> b.cluster""",
    "gold_triples": f"with {GOLD} select * from gt",
    "bridge_links": f"""with {GOLD}, {I.MENTIONS}, gc as (select distinct unnest(gold_chunk_ids) as id from qu), oc as (select id as object_chunk, {_N('title')} as n from ch where id in (select id from gc)),
        j as (select subject, relation, object, chunk_id, {_N('object')} as n, min(object_chunk) as object_chunk from gt join oc on oc.n = {_N('object')} and oc.n <> '' and object_chunk <> chunk_id where relation not in {DATES} group by 1, 2, 3, 4, 5 having count(*) = 1),
        o as (select * from j qualify row_number() over (partition by chunk_id, object_chunk order by relation, subject, object) = 1),
        mn as (select chunk_id, {_N('name')} as n, min(id) as mention_id from me where not coalesce(is_page, false) group by 1, 2), pg as (select chunk_id, min(id) as page_id from me where is_page group by 1)
        select relation, o.chunk_id as subject_chunk, object_chunk, mention_id, page_id from o left join mn on mn.chunk_id = o.chunk_id and mn.n = o.n left join pg on pg.chunk_id = o.object_chunk""",
    "bridge_chunks": f"""with {I.QUESTIONS}, {I.CHUNKS}, t as (select id, {_N('e[1]')} as s, {_N('e[3]')} as o from (select id, unnest(evidences) as e from qu) where len(e) = 3), b as (select distinct x.id, x.o as n from t x join t y on x.id = y.id and x.o = y.s)
        select distinct g.id as question_id, g.cid as chunk_id from (select id, unnest(list_distinct(gold_chunk_ids)) as cid from qu) g join ch on ch.id = g.cid join b on b.id = g.id and b.n = {_N('ch.title')}""",
}
