"""Retrieval queries over chunks, questions and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import tokens
from weft.operators import retrieval as R
from weft.plans import inputs as I
from weft.sources.tables import table

BUDGET, GRAPH_SHARE = 1500, 0.5


def passage_text():
    return F.concat_ws(". ", "title", "text")


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    """Term statistics of the corpus: (term, df, tf, idf)."""
    ch = I.chunks(spark, d)
    post = R.postings(ch, passage_text())
    totals = ch.agg(F.count("*").alias("docs"))
    w = R.term_weights(post, F.col("docs"), totals)
    return post.groupBy("term").agg(F.sum("tf").alias("tf")).join(w, "term").select("term", "df", "tf", F.round("idf", 6).alias("idf"))


POST = f"""tk as (select id as chunk_id, {I.sql_tokens("concat_ws('. ', title, text)")} as t from ch),
    po as (select chunk_id, term, count(*) as tf, any_value(n) as len from (select chunk_id, len(t) as n, unnest(t) as term from tk) group by chunk_id, term),
    tot as (select count(*) as docs, avg(len(t)) as mean_len from tk),
    raw as (select term, count(*) as df, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) as r from po, tot group by term),
    wt as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation questions: those of the dev and test splits."""
    return I.questions(spark, d).where("split in ('dev', 'test') and question is not null").select(F.col("id").alias("question_id"), "question", "type", F.col("gold_chunk_ids").alias("gold"))


ASKED = "ask as (select id as question_id, question, type, gold_chunk_ids as gold from qu where split in ('dev', 'test') and question is not null)"


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    got = R.bm25(I.chunks(spark, d), passage_text(), asked(spark, d), 50)
    return got.select("question_id", "chunk_id", F.round(F.col("score") + 1e-9, 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


BM25 = f"""with {I.CHUNKS}, {I.QUESTIONS}, {POST}, {ASKED},
    qt as (select question_id, term, count(*) as times from (select question_id, unnest({I.sql_tokens("question")}) as term from ask) group by question_id, term),
    sc as (select question_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean_len)) * times), 8) as score from qt join po using (term) join wt using (term), tot group by question_id, chunk_id),
    al as (select question_id, chunk_id, score from sc union all select question_id, id, 0.0 from ask, (select id from ch order by id limit 50) where (question_id, id) not in (select (question_id, chunk_id) from sc)),
    bm as (select question_id, chunk_id, score, row_number() over (partition by question_id order by score desc, chunk_id) as rank from al qualify rank <= 50)"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    got = R.dense(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)
    return got.select("query_id", "vec_id", F.round(F.col("score") + 2e-9, 5).alias("cos"), F.col("rank").cast("bigint").alias("rank"))


def lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = I.passages(spark, d)
    one = lambda c: R.ranked(p.where(F.col(c).isNotNull()).select("question_id", "chunk_id", F.round(c, 8).alias("score")), "question_id", "score", "chunk_id", 50)
    return one("bm25"), one("dense")


LISTS = """lb as (select question_id, chunk_id, round(bm25, 8) as score, row_number() over (partition by question_id order by round(bm25, 8) desc, chunk_id) as rank from pa where bm25 is not null qualify rank <= 50),
    ld as (select question_id, chunk_id, round(dense, 8) as score, row_number() over (partition by question_id order by round(dense, 8) desc, chunk_id) as rank from pa where dense is not null qualify rank <= 50)"""
MINMAX = """nb as (select question_id, chunk_id, case when max(score) over w = min(score) over w then 0.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from lb window w as (partition by question_id)),
    nd as (select question_id, chunk_id, case when max(score) over w = min(score) over w then 0.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from ld window w as (partition by question_id))"""


def shown(df: DataFrame) -> DataFrame:
    return df.select("question_id", "chunk_id", F.round(F.col("score") + 1e-9, 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    return shown(R.fuse(*lists(spark, d), alpha=0.7))


def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return shown(R.fuse(*lists(spark, d)))


def fusion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every weight from 0 to 1 in tenths, by mean recall of the first ten; the best one is marked, ties to the smaller weight."""
    b, v = lists(spark, d)
    keys = ["question_id", "chunk_id"]
    nb = R.min_max(b, "question_id", "score", "s").select(*keys, F.col("s").alias("b"), F.lit(0.0).alias("d"))
    nd = R.min_max(v, "question_id", "score", "s").select(*keys, F.lit(0.0), F.col("s"))
    both = nb.union(nd).groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("d").alias("d"))
    each = both.withColumn("tenth", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("score", F.round(F.col("tenth") / 10 * F.col("d") + (1 - F.col("tenth") / 10) * F.col("b"), 8))
    each = each.withColumn("g", F.concat_ws("|", "question_id", "tenth"))
    top = R.ranked(each, "g", "score", "chunk_id", 10).select("question_id", "tenth", "chunk_id")
    gold = I.questions(spark, d).select(F.col("id").alias("question_id"), F.array_distinct("gold_chunk_ids").alias("gold")).where("size(gold) > 0")
    hit = top.join(gold.select("question_id", F.explode("gold").alias("chunk_id")), ["question_id", "chunk_id"]).groupBy("question_id", "tenth").agg(F.count("*").alias("hits"))
    asked_ = top.select("question_id").distinct().join(gold, "question_id").select("question_id", F.size("gold").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("tenth"))
    mean = asked_.join(hit, ["question_id", "tenth"], "left").groupBy("tenth").agg(F.round(F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")), 6).alias("recall_10"), F.count("*").alias("n"))
    best = mean.agg(F.max_by("tenth", F.struct("recall_10", -F.col("tenth"))).alias("best"))
    return mean.join(F.broadcast(best)).select((F.col("tenth") / 10).alias("alpha"), "n", "recall_10", (F.col("tenth") == F.col("best")).alias("chosen"))


def fused_recall(spark: SparkSession, d: str) -> DataFrame:
    gold = I.questions(spark, d).select(F.col("id").alias("question_id"), "type", F.col("gold_chunk_ids").alias("gold"))
    fused = R.fuse(*lists(spark, d), alpha=0.7)
    return R.recalls(fused, gold.join(fused.select("question_id").distinct(), "question_id", "left_semi"), [2, 5, 10])


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return fused_recall(spark, d)


def retrieval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return R.by_group(fused_recall(spark, d), [f"{m}_{k}" for k in (2, 5, 10) for m in ("recall", "all_gold")])


FUSED = f"""with {I.PASSAGES}, {LISTS}, {MINMAX},
    fu as (select question_id, chunk_id, round(0.7 * sum(d) + (1 - 0.7) * sum(b), 8) as score from (select question_id, chunk_id, s as b, 0.0 as d from nb union all select question_id, chunk_id, 0.0, s from nd) group by question_id, chunk_id),
    fr as (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from fu)"""
RECALL = f"""{FUSED}, {I.QUESTIONS},
    go as (select id as question_id, type, list_distinct(gold_chunk_ids) as gold from qu where len(gold_chunk_ids) > 0 and id in (select question_id from fr)),
    hi as (select question_id, any_value(type) as type, len(any_value(gold)) as n, count(*) filter (where rank <= 2 and list_contains(gold, chunk_id)) as h2, count(*) filter (where rank <= 5 and list_contains(gold, chunk_id)) as h5,
        count(*) filter (where rank <= 10 and list_contains(gold, chunk_id)) as h10 from go join fr using (question_id) group by question_id),
    re as (select question_id, type, {", ".join(f"round(h{k} / n, 6) as recall_{k}, cast(h{k} = n as int)::double as all_gold_{k}" for k in (2, 5, 10))} from hi)"""


def gold_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank of each gold chunk in the fused list, null if it isn't there."""
    fused = R.fuse(*lists(spark, d), alpha=0.7)
    gold = I.questions(spark, d).join(fused.select(F.col("question_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("question_id"), F.explode(F.array_distinct("gold_chunk_ids")).alias("chunk_id"))
    return gold.join(fused.select("question_id", "chunk_id", "rank"), ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 passages of a question with the cost of their blocks."""
    p = R.ranked(I.passages(spark, d).where("score is not null"), "question_id", "score", "chunk_id", 30)
    ch = I.chunks(spark, d).select(F.col("id").alias("chunk_id"), R.block_cost(F.col("title"), F.col("text")).alias("cost")).where("cost is not null")
    return p.join(ch, "chunk_id").select("question_id", "rank", "chunk_id", "cost")


BLOCKS = f"""bl as (select p.question_id, p.rank, p.chunk_id, {I.sql_token_count("'[' || c.title || '] ' || c.text")} + 2 as cost
    from (select question_id, chunk_id, row_number() over (partition by question_id order by score desc, chunk_id) as rank from pa where score is not null qualify rank <= 30) p join ch c on c.id = p.chunk_id where c.title is not null)"""


def pack_context(spark: SparkSession, d: str) -> DataFrame:
    return R.pack(blocks(spark, d), F.lit(BUDGET)).select("question_id", F.array_join("chunk_ids", "|").alias("chunk_ids"), "tokens")


def sql_pack(source: str, budget: str, start: str) -> str:
    """The fold over an ordered list; the first element only starts it."""
    return f"""pk as (select question_id, list_reduce(list_prepend({{'rank': 0, 'chunk_id': '', 'cost': 0, 'tokens': {start}, 'ids': []::varchar[]}}, list({{'rank': rank, 'chunk_id': chunk_id, 'cost': cost, 'tokens': 0, 'ids': []::varchar[]}} order by rank, chunk_id)),
        lambda a, x: case when a.tokens + x.cost <= {budget} then {{'rank': 0, 'chunk_id': '', 'cost': 0, 'tokens': a.tokens + x.cost, 'ids': list_append(a.ids, x.chunk_id)}} else a end) as p from {source} group by question_id)"""


def combine_context(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the best paths in half of the budget, then passages that aren't sources of them in what is left."""
    from weft.functions.text import token_count

    p = table(spark, d, "paths").where("score is not null and not isnan(score) and question_id is not null and text is not null").groupBy("question_id", "text").agg(F.max("score").alias("score"), F.max("sources").alias("sources"))
    top = R.ranked(p, "question_id", "score", "text", 10)
    fact = token_count(F.concat(F.lit("Fact: "), "text", F.lit(" [source: "), F.array_join("sources", ", "), F.lit("]"))) + 1
    facts = R.pack(top.select("question_id", "rank", F.col("text").alias("chunk_id"), fact.alias("cost")).where("cost is not null"), F.lit(int(BUDGET * GRAPH_SHARE)))
    kept = top.join(facts.select("question_id", F.explode("chunk_ids").alias("text")), ["question_id", "text"])
    cited = kept.select("question_id", F.explode("sources").alias("chunk_id")).distinct()
    rest = blocks(spark, d).join(cited, ["question_id", "chunk_id"], "left_anti").join(facts.select("question_id", F.col("tokens").alias("graph"), F.size("chunk_ids").alias("facts")), "question_id", "left")
    one = rest.groupBy("question_id").agg(F.coalesce(F.max("graph"), F.lit(0)).alias("graph_tokens"), F.coalesce(F.max("facts"), F.lit(0)).cast("bigint").alias("facts"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("cost").cast("bigint").alias("cost")))).alias("l"))
    step = lambda a, x: F.when(a["t"] + x["cost"] <= BUDGET, F.struct((a["t"] + x["cost"]).alias("t"), F.concat(a["ids"], F.array(x["chunk_id"])).alias("ids"))).otherwise(a)
    out = one.withColumn("p", F.aggregate("l", F.struct(F.col("graph_tokens").cast("bigint").alias("t"), F.array().cast("array<string>").alias("ids")), step))
    return out.select("question_id", "facts", F.col("graph_tokens").cast("bigint").alias("graph_tokens"), F.array_join("p.ids", "|").alias("chunk_ids"), F.col("p.t").alias("tokens"))


QUERIES = {
    "bm25_topk": bm25_topk, "tokenize_stats": tokenize_stats, "dense_topk_exact": dense_topk, "fusion_weighted": fusion_weighted, "fusion_rrf": fusion_rrf, "fusion_sweep": fusion_sweep,
    "recall_at_k": recall_at_k, "retrieval_aggregate": retrieval_aggregate, "gold_rank": gold_rank, "pack_context": pack_context, "combine_context": combine_context,
}
SQL = {
    "bm25_topk": f"{BM25} select question_id, chunk_id, round(score + 1e-9, 6) as score, rank from bm",
    "tokenize_stats": f"with {I.CHUNKS}, {POST} select term, df, cast(sum(tf) as bigint) as tf, round(idf, 6) as idf from po join wt using (term) group by term, df, idf",
    "dense_topk_exact": """select query_id, vec_id, round(s + 2e-9, 5) as cos, rank from (select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 8) as s,
        row_number() over (partition by a.vec_id order by round(list_dot_product(a.embedding::double[], b.embedding::double[]), 8) desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 10""",
    "fusion_weighted": f"{FUSED} select question_id, chunk_id, round(score + 1e-9, 6) as score, rank from fr",
    "fusion_rrf": f"""with {I.PASSAGES}, {LISTS}, fu as (select question_id, chunk_id, round(sum(1.0::double / (60 + rank)), 8) as score from (select question_id, chunk_id, rank from lb union all select question_id, chunk_id, rank from ld) group by question_id, chunk_id)
        select question_id, chunk_id, round(score + 1e-9, 6) as score, row_number() over (partition by question_id order by score desc, chunk_id) as rank from fu""",
    "fusion_sweep": f"""with {I.PASSAGES}, {I.QUESTIONS}, {LISTS}, {MINMAX},
        bo as (select question_id, chunk_id, sum(b) as b, sum(d) as d from (select question_id, chunk_id, s as b, 0.0 as d from nb union all select question_id, chunk_id, 0.0, s from nd) group by question_id, chunk_id),
        ea as (select question_id, chunk_id, tenth, row_number() over (partition by question_id, tenth order by round(tenth / 10 * d + (1 - tenth / 10) * b, 8) desc, chunk_id) as r from bo, (select unnest(range(11)) as tenth) qualify r <= 10),
        go as (select id as question_id, list_distinct(gold_chunk_ids) as gold from qu where len(gold_chunk_ids) > 0),
        pe as (select question_id, tenth, count(*) filter (where list_contains(gold, chunk_id)) / len(any_value(gold)) as rc from ea join go using (question_id) group by question_id, tenth),
        mn as (select tenth, round(avg(rc), 6) as recall_10, count(*) as n from pe group by tenth)
        select tenth / 10 as alpha, n, recall_10, tenth = first_value(tenth) over (order by recall_10 desc, tenth) as chosen from mn""",
    "recall_at_k": f"{RECALL} select * from re",
    "retrieval_aggregate": f"""{RECALL} select grp, count(*) as n, {", ".join(f"round(avg({m}_{k}), 4) as {m}_{k}" for k in (2, 5, 10) for m in ("recall", "all_gold"))}
        from (select *, unnest([type, case when type = 'single_hop' then 'single_hop_all' else 'multi_hop' end, 'all']) as grp from re) group by grp""",
    "gold_rank": f"{FUSED}, {I.QUESTIONS} select g.question_id, g.chunk_id, r.rank from (select id as question_id, unnest(list_distinct(gold_chunk_ids)) as chunk_id from qu where id in (select question_id from fr)) g left join fr r on r.question_id = g.question_id and r.chunk_id = g.chunk_id",
    "pack_context": f"with {I.PASSAGES}, {I.CHUNKS}, {BLOCKS}, {sql_pack('bl', str(BUDGET), '0')} select question_id, array_to_string(p.ids, '|') as chunk_ids, cast(p.tokens as bigint) as tokens from pk",
    "combine_context": f"""with {I.PASSAGES}, {I.CHUNKS}, {BLOCKS},
        pt as (select question_id, text, max(score) as score, max(sources) as sources from paths where score is not null and not isnan(score) and question_id is not null and text is not null group by question_id, text),
        tp as (select *, row_number() over (partition by question_id order by score desc, text) as rank from pt qualify rank <= 10),
        fa as (select question_id, rank, text as chunk_id, {I.sql_token_count("'Fact: ' || text || ' [source: ' || array_to_string(sources, ', ') || ']'")} + 1 as cost from tp where sources is not null),
        {sql_pack('fa', str(int(BUDGET * GRAPH_SHARE)), '0')},
        ci as (select distinct t.question_id, unnest(t.sources) as chunk_id from tp t join pk on pk.question_id = t.question_id and list_contains(pk.p.ids, t.text)),
        rs as (select b.*, coalesce(pk.p.tokens, 0) as graph, coalesce(len(pk.p.ids), 0) as facts from bl b left join pk using (question_id) where not exists (select 1 from ci where ci.question_id = b.question_id and ci.chunk_id = b.chunk_id)),
        pf as (select question_id, any_value(graph) as graph, any_value(facts) as facts, list_reduce(list_prepend({{'rank': 0, 'chunk_id': '', 'cost': 0, 'tokens': any_value(graph), 'ids': []::varchar[]}}, list({{'rank': rank, 'chunk_id': chunk_id, 'cost': cost, 'tokens': 0, 'ids': []::varchar[]}} order by rank, chunk_id)),
            lambda a, x: case when a.tokens + x.cost <= {BUDGET} then {{'rank': 0, 'chunk_id': '', 'cost': 0, 'tokens': a.tokens + x.cost, 'ids': list_append(a.ids, x.chunk_id)}} else a end) as f from rs group by question_id)
        select question_id, cast(facts as bigint) as facts, cast(graph as bigint) as graph_tokens, array_to_string(f.ids, '|') as chunk_ids, cast(f.tokens as bigint) as tokens from pf""",
}
