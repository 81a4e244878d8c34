"""Answer scores and their summaries over run_m1_generation, and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import normalize_answer, parse_answer, short_hash
from weft.operators import evaluation as E
from weft.plans import inputs as I
from weft.sources.tables import table

RESAMPLES = 200


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Each answer with em, f1 (over the gold answer) and unknown as they come out of the texts."""
    r = I.runs(spark, d).withColumn("p", F.coalesce("prediction", F.lit("")))
    gold = F.coalesce("answer", F.lit(""))
    return r.select("system", "id", "answer_id", "type", "question", "answer", "p", "prediction", "all_gold_in_context", "context_tokens", "provider", "context_chunk_ids", E.exact_match(F.col("p"), gold).alias("em"), F.round(E.f1(F.col("p"), gold), 6).alias("f1"), (F.lower(F.trim("p")) == "unknown").alias("unknown"))


_P, _G = I.sql_normalize_answer("coalesce(prediction, '')"), I.sql_normalize_answer("coalesce(answer, '')")
SCORED = f"""{I.RUNS}, nz as (select *, {_P} as pn, {_G} as gn from ru),
    tk as (select *, list_filter(string_split(pn, ' '), lambda t: t <> '') as pw, list_filter(string_split(gn, ' '), lambda t: t <> '') as gw from nz),
    cm as (select *, coalesce(list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))), 0) as common from tk),
    sc as (select system, id, answer_id, type, question, answer, coalesce(prediction, '') as p, prediction, all_gold_in_context, context_tokens, provider, context_chunk_ids, cast(pn = gn as int)::double as em,
        round(case when ((pn in ('yes', 'no', 'noanswer') or gn in ('yes', 'no', 'noanswer')) and pn <> gn) or common = 0 then 0.0 else 2.0::double * common / (len(pw) + len(gw)) end, 6) as f1, lower(trim(coalesce(prediction, ''), ' ')) = 'unknown' as unknown from cm)"""


def em_f1(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("answer_id", "system", "em", "f1", "unknown")


def accepted_scores(spark: SparkSession, d: str) -> DataFrame:
    """EM and F1 as the best over all accepted answers: the gold answer and the aliases of the entity of that name."""
    s = scored(spark, d).select("answer_id", "p", "answer")
    al = I.entities(spark, d).where("aliases is not null").select(F.col("name").alias("answer"), F.explode("aliases").alias("g")).where("g is not null").distinct()
    g = s.select("answer_id", "p", F.coalesce("answer", F.lit("")).alias("g")).union(s.join(al, "answer").select("answer_id", "p", "g"))
    return g.groupBy("answer_id").agg(F.max(E.exact_match(F.col("p"), F.col("g"))).alias("em"), F.round(F.max(E.f1(F.col("p"), F.col("g"))), 6).alias("f1"), F.countDistinct("g").alias("accepted"))


def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(scored(spark, d), ["system"])


SUMMARY = """select {keys}, grp, count(*) as n, round(avg(em), 4) as em, round(avg(f1), 4) as f1, round(avg(cast(unknown as int)), 4) as unknown_rate, count(*) filter (where not unknown) as answered_n,
    round(avg(em) filter (where not unknown), 4) as answered_em, round(avg(f1) filter (where not unknown), 4) as answered_f1
    from (select *, unnest(list_filter([type, case when type <> 'single_hop' then 'multi_hop' end, 'all'], lambda x: x is not null)) as grp from {source}) group by {keys}, grp"""


def subset_summary(spark: SparkSession, d: str) -> DataFrame:
    """The same over the questions that closed_book gets wrong."""
    s = scored(spark, d)
    wrong = s.where("system = 'closed_book' and em = 0").select("id")
    return E.summary(s.join(wrong, "id", "left_semi"), ["system"])


def system_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per system: answers, providers, mean context tokens and how often multi-hop questions had all gold chunks in context."""
    s = scored(spark, d)
    return s.groupBy("system").agg(
        F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"),
        F.round(F.avg("context_tokens"), 1).alias("mean_context_tokens"),
        F.round(F.avg(F.when(F.col("type") != "single_hop", F.col("all_gold_in_context"))), 4).alias("all_gold_in_context"),
    )


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap(scored(spark, d), "system", "id", "em", RESAMPLES)


def paired(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    ref = s.where("system = 'closed_book'").select("id", F.col("em").alias("r"))
    return s.where("system != 'closed_book'").join(ref, "id").select("system", "id", (F.col("em") - F.col("r")).alias("diff"))


def paired_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap of the difference to closed_book over the questions both have."""
    return E.bootstrap(paired(spark, d), "system", "id", "diff", RESAMPLES)


def sql_bootstrap(source: str, value: str) -> str:
    return f"""vs as (select system, list({value} order by id) as v from {source} group by system),
        rs as (select system, v, unnest(range(1, {RESAMPLES + 1})) as r from vs),
        ms as (select system, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[cast(('0x' || substr(md5('0:' || r || ':' || i), 1, 8))::bigint % len(v) as int) + 1])) / len(v) as m from rs),
        qs as (select system, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from ms group by system)
        select system, round(list_sum(v) / len(v), 4) as mean, round(lo, 4) as ci_low, round(hi, 4) as ci_high, len(v) as n from vs join qs using (system)"""


def judge_items(spark: SparkSession, d: str) -> DataFrame:
    """The distinct (question, normalised answer) of all systems, the first system's wording; unknown is no item."""
    s = scored(spark, d).where("not unknown")
    s = s.withColumn("item_id", short_hash("j", F.concat("id", F.lit("|"), normalize_answer(F.col("p")))))
    return E.first_of(s, ["item_id"], [F.asc("system"), F.asc("answer_id")]).select("item_id", F.col("id").alias("question_id"), "type", F.coalesce("answer", F.lit("")).alias("gold"), F.col("p").alias("prediction"))


def contingency(spark: SparkSession, d: str) -> DataFrame:
    """EM recomputed against EM on record, per system."""
    s = scored(spark, d).join(I.runs(spark, d).select("answer_id", F.col("em").alias("recorded")), "answer_id")
    count = lambda a, b: F.count_if((F.col("em") == a) & (F.col("recorded") == b))
    return s.groupBy("system").agg(count(1, 1).alias("both"), count(1, 0).alias("only_computed"), count(0, 1).alias("only_recorded"), count(0, 0).alias("neither"))


def agreement(spark: SparkSession, d: str) -> DataFrame:
    """Of pairs judged repeatedly: how often all judgements agree, by stratum."""
    p = table(spark, d, "pilot_decisions").where("a is not null and b is not null and a != b and verdict is not null")
    p = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.regexp_extract(F.lower("verdict"), "[a-z]+", 0).alias("v"), "stratum").where("v != ''")
    one = p.groupBy("a", "b").agg(F.countDistinct("v").alias("k"), F.count("*").alias("n"), F.min("stratum").alias("stratum")).where("n > 1")
    return one.groupBy("stratum").agg(F.count("*").alias("pairs"), F.count_if(F.col("k") == 1).alias("agree"), F.round(F.avg((F.col("k") == 1).cast("double")), 4).alias("rate"))


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers by abstention and by whether the gold chunks were in context."""
    s = scored(spark, d).where("em = 0")
    kind = F.concat(F.when(F.col("unknown"), "abstained").otherwise("answered"), F.when(F.col("all_gold_in_context") == 1, ", gold in context").when(F.col("all_gold_in_context").isNull(), ", no context").otherwise(", gold missing"))
    return s.groupBy("system", kind.alias("failure")).agg(F.count("*").alias("n"))


def answer_status(spark: SparkSession, d: str) -> DataFrame:
    """correct, no answer, other wording (some words are right) or wrong, per system."""
    s = scored(spark, d)
    kind = F.when(F.col("em") == 1, "correct").when(F.col("unknown") | (F.trim("p") == ""), "no answer").when(F.col("f1") > 0, "other wording").otherwise("wrong")
    return s.groupBy("system", kind.alias("status")).agg(F.count("*").alias("n"))


def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    """The short answer parsed from raw, against the prediction on record."""
    r = I.runs(spark, d).where("raw is not null").select("system", parse_answer(F.col("raw")).alias("parsed"), "prediction")
    return r.groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("parsed") == F.col("prediction")).alias("equal"), F.count_if(F.col("parsed") == "").alias("blank"), F.count_if(F.lower("parsed") == "unknown").alias("unknown"), F.countDistinct("parsed").alias("different"))


def verdict_histogram(spark: SparkSession, d: str) -> DataFrame:
    return I.decisions(spark, d).groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The lower candidate threshold: percentiles of the cosines of pairs judged the same, the 5th cut to hundredths."""
    s = I.decisions(spark, d).where("verdict = 'same' and cos is not null and not isnan(cos)")
    return s.agg(F.count("*").alias("n"), *(F.round(F.percentile("cos", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.05, 0.25, 0.5)), (F.floor(F.percentile("cos", F.lit(0.05)) * 100 + 1e-9) / 100).alias("t_low"))


def threshold_projection(spark: SparkSession, d: str) -> DataFrame:
    """How many judged pairs of each verdict a threshold would take."""
    s = I.decisions(spark, d).where("verdict in ('same', 'different') and cos is not null")
    t = s.withColumn("hundredth", F.explode(F.sequence(F.lit(85), F.lit(99), F.lit(2))))
    return t.groupBy("hundredth").agg(F.count_if((F.col("cos") * 100 >= F.col("hundredth")) & (F.col("verdict") == "same")).alias("same"), F.count_if((F.col("cos") * 100 >= F.col("hundredth")) & (F.col("verdict") == "different")).alias("different")).withColumn("hundredth", F.col("hundredth").cast("bigint"))


_PARSE = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_extract(raw, '^\s*([^\n\r]*)', 1), ' '), '^(final\s+)?answer\s*:\s*', '', 'i'), ' '), '^"+|"+$', '', 'g'), '^\*+|\*+$', '', 'g'), '\.+$', ''), ' ')"""
QUERIES = {
    "em_f1": em_f1, "accepted_scores": accepted_scores, "group_summary": group_summary, "subset_summary": subset_summary, "system_summary": system_summary, "bootstrap_ci": bootstrap_ci, "paired_ci": paired_ci, "judge_items": judge_items,
    "contingency": contingency, "agreement": agreement, "failure_classes": failure_classes, "answer_status": answer_status, "answer_parse": answer_parse, "verdict_histogram": verdict_histogram, "percentile_threshold": percentile_threshold, "threshold_projection": threshold_projection,
}
_AG = I.sql_normalize_answer("g")
SQL = {
    "em_f1": f"with {SCORED} select answer_id, system, em, f1, unknown from sc",
    "accepted_scores": f"""with {SCORED}, {I.ENTITIES}, al as (select distinct name, unnest(aliases) as g from en),
        gs as (select answer_id, p, coalesce(answer, '') as g from sc union all select answer_id, p, g from sc join al on al.name = sc.answer where g is not null),
        ns as (select answer_id, g, {I.sql_normalize_answer("p")} as pn, {_AG} as gn from gs),
        ws as (select *, list_filter(string_split(pn, ' '), lambda t: t <> '') as pw, list_filter(string_split(gn, ' '), lambda t: t <> '') as gw from ns),
        cs as (select *, coalesce(list_sum(list_transform(list_distinct(pw), lambda w: least(len(list_filter(pw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))), 0) as c from ws)
        select answer_id, max(cast(pn = gn as int)::double) as em, round(max(case when ((pn in ('yes', 'no', 'noanswer') or gn in ('yes', 'no', 'noanswer')) and pn <> gn) or c = 0 then 0.0 else 2.0::double * c / (len(pw) + len(gw)) end), 6) as f1, count(distinct g) as accepted from cs group by answer_id""",
    "group_summary": f"with {SCORED} " + SUMMARY.format(keys="system", source="sc"),
    "subset_summary": f"with {SCORED} " + SUMMARY.format(keys="system", source="(select * from sc where id in (select id from sc where system = 'closed_book' and em = 0))"),
    "system_summary": f"with {SCORED} select system, count(*) as n, coalesce(string_agg(distinct provider, ',' order by provider), '') as providers, round(avg(context_tokens), 1) as mean_context_tokens, round(avg(all_gold_in_context) filter (where type <> 'single_hop'), 4) as all_gold_in_context from sc group by system",
    "bootstrap_ci": f"with {SCORED}, {sql_bootstrap('sc', 'em')}",
    "paired_ci": f"with {SCORED}, pd as (select a.system, a.id, a.em - b.em as diff from sc a join sc b on a.id = b.id and b.system = 'closed_book' and a.system <> 'closed_book'), {sql_bootstrap('pd', 'diff')}",
    "judge_items": f"""with {SCORED}, it as (select *, 'j' || substr(sha1(id || '|' || {I.sql_normalize_answer("p")}), 1, 10) as item_id from sc where not unknown)
        select item_id, id as question_id, type, coalesce(answer, '') as gold, p as prediction from it qualify row_number() over (partition by item_id order by system, answer_id) = 1""",
    "contingency": f"with {SCORED}, j as (select sc.system, sc.em, ru.em as recorded from sc join ru using (answer_id)) select system, count(*) filter (where em = 1 and recorded = 1) as both, count(*) filter (where em = 1 and recorded = 0) as only_computed, count(*) filter (where em = 0 and recorded = 1) as only_recorded, count(*) filter (where em = 0 and recorded = 0) as neither from j group by system",
    "agreement": """with p as (select least(a, b) as a, greatest(a, b) as b, regexp_extract(lower(verdict), '[a-z]+', 0) as v, stratum from pilot_decisions where a is not null and b is not null and a <> b and verdict is not null),
        o as (select a, b, count(distinct v) as k, count(*) as n, min(stratum) as stratum from p where v <> '' group by a, b) select stratum, count(*) as pairs, count(*) filter (where k = 1) as agree, round(avg(cast(k = 1 as int)), 4) as rate from o where n > 1 group by stratum""",
    "failure_classes": f"with {SCORED} select system, case when unknown then 'abstained' else 'answered' end || case when all_gold_in_context = 1 then ', gold in context' when all_gold_in_context is null then ', no context' else ', gold missing' end as failure, count(*) as n from sc where em = 0 group by 1, 2",
    "answer_status": f"with {SCORED} select system, case when em = 1 then 'correct' when unknown or trim(p, ' ') = '' then 'no answer' when f1 > 0 then 'other wording' else 'wrong' end as status, count(*) as n from sc group by 1, 2",
    "answer_parse": f"with {I.RUNS}, x as (select system, prediction, {_PARSE} as parsed from ru where raw is not null) select system, count(*) as n, count(*) filter (where parsed = prediction) as equal, count(*) filter (where parsed = '') as blank, count(*) filter (where lower(parsed) = 'unknown') as unknown, count(distinct parsed) as different from x group by system",
    "verdict_histogram": f"with {I.DECISIONS} select coalesce(verdict, 'none') as verdict, count(*) as n from de group by 1",
    "percentile_threshold": f"with {I.DECISIONS} select count(*) as n, round(quantile_cont(cos, 0.05), 6) as p5, round(quantile_cont(cos, 0.25), 6) as p25, round(quantile_cont(cos, 0.5), 6) as p50, floor(quantile_cont(cos, 0.05) * 100 + 1e-9) / 100 as t_low from de where verdict = 'same' and cos is not null and not isnan(cos)",
    "threshold_projection": f"with {I.DECISIONS} select hundredth, count(*) filter (where cos * 100 >= hundredth and verdict = 'same') as same, count(*) filter (where cos * 100 >= hundredth and verdict = 'different') as different from de, (select unnest(range(85, 100, 2)) as hundredth) where verdict in ('same', 'different') and cos is not null group by hundredth",
}
