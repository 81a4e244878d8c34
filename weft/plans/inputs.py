"""The tables as the operators take them: repeated rows once, rows without an id left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.tables import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(id, title, text): one non-blank text of each id."""
    rows = table(spark, d, "chunks").where("id is not null and trim(text) != ''")
    return rows.groupBy("id").agg(F.max("title").alias("title"), F.max("text").alias("text"))


CHUNKS = "ch as (select id, max(title) as title, max(text) as text from chunks where id is not null and trim(text) <> '' group by id)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    cols = ["question", "answer", "type", "relation", "source_question_id", "split", "source"]
    rows = table(spark, d, "questions").where("id is not null")
    return rows.groupBy("id").agg(*(F.max(c).alias(c) for c in cols), *(F.max(c).alias(c) for c in ("gold_titles", "gold_chunk_ids", "evidences")))


QUESTIONS = """qu as (select id, max(question) as question, max(answer) as answer, max(type) as type, max(relation) as relation, max(source_question_id) as source_question_id,
    max(split) as split, max(source) as source, max(gold_titles) as gold_titles, max(gold_chunk_ids) as gold_chunk_ids, max(evidences) as evidences from questions where id is not null group by id)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Answers, one row per (system, id): the one of the least answer_id."""
    rows = table(spark, d, "run_m1_generation").where("answer_id is not null and id is not null and system is not null")
    key = rows.groupBy("system", "id").agg(F.min("answer_id").alias("answer_id"))
    cols = ["type", "question", "answer", "prediction", "raw", "em", "f1", "unknown", "all_gold_in_context", "context_tokens", "provider", "input_tokens", "output_tokens", "cached"]
    one = rows.groupBy("answer_id").agg(*(F.max(c).alias(c) for c in cols), F.max("context_chunk_ids").alias("context_chunk_ids"), F.max("answered_at").alias("answered_at"))
    return key.join(one, "answer_id")


RUNS = """ru as (select k.system, k.id, o.* from (select system, id, min(answer_id) as answer_id from run_m1_generation where answer_id is not null and id is not null and system is not null group by system, id) k
    join (select answer_id, max(type) as type, max(question) as question, max(answer) as answer, max(prediction) as prediction, max(raw) as raw, max(em) as em, max(f1) as f1, bool_or(unknown) as unknown,
        max(all_gold_in_context) as all_gold_in_context, max(context_tokens) as context_tokens, max(provider) as provider, max(input_tokens) as input_tokens, max(output_tokens) as output_tokens, bool_or(cached) as cached,
        max(context_chunk_ids) as context_chunk_ids, max(answered_at) as answered_at from run_m1_generation group by answer_id) o on k.answer_id = o.answer_id)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """One row per mention id."""
    cols = ["chunk_id", "name", "norm", "type", "description", "is_page", "split"]
    return table(spark, d, "mentions").where("id is not null and name is not null").groupBy("id").agg(*(F.max(c).alias(c) for c in cols))


MENTIONS = """me as (select id, max(chunk_id) as chunk_id, max(name) as name, max(norm) as norm, max(type) as type, max(description) as description, bool_or(is_page) as is_page, max(split) as split
    from mentions where id is not null and name is not null group by id)"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, verdict, cos, stratum, ...) with a < b and the verdict as a word, one row per pair: the one judged last."""
    rows = table(spark, d, "pilot_decisions").where("a is not null and b is not null and a != b")
    word = F.regexp_extract(F.lower("verdict"), r"[a-z]+", 0)
    rows = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(word != "", word).alias("verdict"), F.round("cos", 6).alias("cos"), F.round("name_ratio", 3).alias("name_ratio"), "exact", "stratum", "judged_at", "pair_id")
    return rows.groupBy("a", "b").agg(F.max_by(F.struct("verdict", "cos", "name_ratio", "exact", "stratum", "judged_at", "pair_id"), F.struct("judged_at", "pair_id")).alias("r")).select("a", "b", "r.*")


DECISIONS = """de as (select least(a, b) as a, greatest(a, b) as b, nullif(regexp_extract(lower(verdict), '[a-z]+', 0), '') as verdict, round(cos, 6) as cos, round(name_ratio, 3) as name_ratio, exact, stratum, judged_at, pair_id
    from pilot_decisions where a is not null and b is not null and a <> b
    qualify row_number() over (partition by least(a, b), greatest(a, b) order by judged_at desc nulls last, pair_id desc) = 1)"""


def passages(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, chunk_id, score, bm25, dense): each chunk of a question once with its highest scores; null and NaN scores left out."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = table(spark, d, "passages").where("question_id is not null and chunk_id is not null")
    rows = rows.select("question_id", "chunk_id", "score", F.col("scores")["bm25"].alias("bm25"), F.col("scores")["dense"].alias("dense"))
    return rows.groupBy("question_id", "chunk_id").agg(*(F.max(ok(c)).alias(c) for c in ("score", "bm25", "dense")))


PASSAGES = """pa as (select question_id, chunk_id, max(score) filter (where not isnan(score)) as score, max(scores['bm25']) filter (where not isnan(scores['bm25'])) as bm25, max(scores['dense']) filter (where not isnan(scores['dense'])) as dense
    from passages where question_id is not null and chunk_id is not null group by question_id, chunk_id)"""


def triples(spark: SparkSession, d: str) -> DataFrame:
    """(subject, relation, object) of all evidences, distinct."""
    t = questions(spark, d).select(F.explode("evidences").alias("e")).where("size(e) = 3")
    return t.select(F.col("e")[0].alias("subject"), F.col("e")[1].alias("relation"), F.col("e")[2].alias("object")).distinct()


TRIPLES = "tr as (select distinct e[1] as subject, e[2] as relation, e[3] as object from (select unnest(evidences) as e from qu) where len(e) = 3)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, rel, target, chunk_ids): the distinct edges of all paths with their chunks, sorted."""
    s = table(spark, d, "paths").select(F.explode("steps").alias("s")).select("s.*").where("source is not null and target is not null")
    return s.select("source", "rel", "target", F.explode_outer("chunk_ids").alias("c")).groupBy("source", "rel", "target").agg(F.array_sort(F.collect_set("c")).alias("chunk_ids"))


EDGES = """ed as (select source, rel, target, coalesce(list_sort(list(distinct c) filter (where c is not null)), []) as chunk_ids
    from (select s.source, s.rel, s.target, unnest(case when len(s.chunk_ids) > 0 then s.chunk_ids else [null] end) as c from (select unnest(steps) as s from paths)) where source is not null and target is not null group by source, rel, target)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities and hub entities, one row per id."""
    e = table(spark, d, "entities").unionByName(table(spark, d, "hub_entities").select(*table(spark, d, "entities").columns)).where("id is not null")
    return e.groupBy("id").agg(F.max("name").alias("name"), F.max("type").alias("type"), F.max("is_page").alias("is_page"), F.max("page_chunk_id").alias("page_chunk_id"), F.max("aliases").alias("aliases"), F.max("mention_ids").alias("mention_ids"))


ENTITIES = """en as (select id, max(name) as name, max(type) as type, bool_or(is_page) as is_page, max(page_chunk_id) as page_chunk_id, max(aliases) as aliases, max(mention_ids) as mention_ids
    from (select id, name, aliases, type, is_page, page_chunk_id, mention_ids from entities union all select id, name, aliases, type, is_page, page_chunk_id, mention_ids from hub_entities) where id is not null group by id)"""


#: The same text functions in SQL, as macros of the query text.
def sql_norm_name(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\s*\([^)]*\)\s*$', ''), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"


def sql_tokens(x: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), ' '), lambda t: t <> '')"


def sql_normalize_answer(x: str) -> str:
    bare = rf"translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')".replace('\\"', '"')
    for _ in range(2):
        bare = rf"regexp_replace({bare}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'), ' ')"


def sql_token_count(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
