"""Corpus preparation, incremental load, ledger and cache over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import DATE_RELATIONS, cased_answer, has_disambiguator, hash_order, parse_date, short_hash, snippet, spacing_key, strip_disambiguator
from weft.operators import corpus as C
from weft.plans import inputs as I
from weft.sources.tables import table

#: Relations that a single question may ask for, with its wording; fixed values.
ASKED_ALONE = {
    "director": "Who is the director of {s}?", "composer": "Who composed the music of {s}?", "date of birth": "When was {s} born?", "place of death": "Where did {s} die?", "publication date": "When was {s} released?",
    "country of origin": "Which country is {s} from?", "founded by": "Who founded {s}?", "father": "Who is the father of {s}?", "mother": "Who is the mother of {s}?", "spouse": "Who was {s} married to?",
}
#: Prices per million tokens of the cost scenarios; parameters.
SCENARIOS = [("low", 0.05, 0.2), ("middle", 0.15, 0.6), ("high", 0.5, 1.5)]


def raw_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("title is not null and trim(text) != ''").select("title", "text")


RAW = "rw as (select title, text from chunks where title is not null and trim(text, ' ') <> '')"
MERGED = r"""us as (select title, text, count(*) as uses, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s*([^\p{L}\p{N}_\s])\s*', '\1', 'g'), ' ') as key from rw group by title, text),
    on_ as (select title, key, arg_min(text, {'o': -uses, 't': text}) as text, count(*) as variants, sum(uses)::bigint as uses from us group by title, key),
    mg as (select case when count(*) over (partition by title) > 1 then title || '#' || substr(sha1(key), 1, 8) else title end as chunk_id, title, key, text, variants, uses, count(*) over (partition by title) > 1 as kept_apart from on_)"""


def corpus_merge(spark: SparkSession, d: str) -> DataFrame:
    m = C.merged_corpus(raw_paragraphs(spark, d))
    return m.select("chunk_id", "title", F.md5("text").alias("text_md5"), "variants", "uses", "kept_apart")


def collisions(spark: SparkSession, d: str) -> DataFrame:
    return C.collision_log(C.merged_corpus(raw_paragraphs(spark, d)))


def multi_variant(spark: SparkSession, d: str) -> DataFrame:
    """Titles with several raw texts, and whether the log of them has each."""
    got = raw_paragraphs(spark, d).groupBy("title").agg(F.countDistinct("text").alias("texts")).where("texts > 1")
    log = table(spark, d, "multi_variant_titles").where("title is not null").distinct().withColumn("logged", F.lit(True))
    return got.join(log, "title", "left").select("title", "texts", F.coalesce("logged", F.lit(False)).alias("logged"))


def spacing_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select(F.md5(spacing_key(F.col("text"))).alias("k"), "title").groupBy("title").agg(F.countDistinct("k").alias("keys"), F.count("*").alias("n"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return C.stratified_split(I.questions(spark, d), "id", "type", 20, 30, "42:")


def distractors(spark: SparkSession, d: str) -> DataFrame:
    gold = I.questions(spark, d).select(F.col("id").alias("question_id"), F.explode("gold_chunk_ids").alias("chunk_id")).where("chunk_id is not null")
    pool = I.passages(spark, d).join(gold.select("question_id").distinct(), "question_id", "left_semi").select("question_id", "chunk_id")
    return C.distractors(gold, pool, 4, "42:")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Every (id, pos, subject, relation, object) of the questions."""
    q = I.questions(spark, d).select("id", "gold_chunk_ids", F.posexplode("evidences").alias("pos", "e")).where("size(e) = 3")
    return q.select("id", "gold_chunk_ids", F.col("pos").cast("bigint").alias("pos"), F.col("e")[0].alias("subject"), F.col("e")[1].alias("relation"), F.col("e")[2].alias("object"))


FACTS = "fa as (select id, gold_chunk_ids, p - 1 as pos, e[1] as subject, e[2] as relation, e[3] as object from (select id, gold_chunk_ids, unnest(evidences) as e, unnest(range(1, len(evidences) + 1)) as p from qu) where len(e) = 3)"


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    """(subject, relation) with several objects."""
    return facts(spark, d).groupBy("subject", "relation").agg(F.countDistinct("object").alias("objects"), F.array_join(F.array_sort(F.collect_set("object")), "|").alias("values")).where("objects > 1")


def single_hop(spark: SparkSession, d: str) -> DataFrame:
    """Single facts that make a question: one gold chunk is about the subject, its text has the object, its title has one raw text and its name one chunk, and no
    other object is given anywhere. The answer is written as in the text; a title with a disambiguation is asked for in full."""
    f = facts(spark, d)
    alone = f.groupBy("subject", "relation").agg(F.countDistinct("object").alias("k")).where("k = 1").select("subject", "relation")
    ch = I.chunks(spark, d)
    named = ch.groupBy(strip_disambiguator(F.col("title")).alias("stem")).agg(F.count("*").alias("same")).where("same = 1").select("stem")
    once = raw_paragraphs(spark, d).groupBy("title").agg(F.countDistinct("text").alias("t")).where("t = 1").select("title")
    m = f.where(F.col("relation").isin(list(ASKED_ALONE))).withColumn("cid", F.explode("gold_chunk_ids")).join(ch.select(F.col("id").alias("cid"), "title", "text"), "cid")
    m = m.where((F.lower("title") == F.lower("subject")) | (strip_disambiguator(F.col("title")) == F.lower("subject")))
    m = m.withColumn("n", F.count("*").over(Window.partitionBy("id", "pos"))).where("n = 1").join(once, "title", "left_semi")
    m = m.withColumn("stem", strip_disambiguator(F.col("subject"))).join(named, "stem", "left_semi").withColumn("answer", cased_answer(F.col("object"), F.col("text"))).where("answer is not null")
    first = m.withColumn("r", F.row_number().over(Window.partitionBy("subject", "relation").orderBy("id", "pos"))).where("r = 1").join(alone, ["subject", "relation"])
    asked = F.when(has_disambiguator(F.col("title")), F.col("title")).otherwise(F.col("subject"))
    words = F.create_map(*(F.lit(x) for kv in ASKED_ALONE.items() for x in kv))
    return first.select(short_hash("sh_", F.concat("subject", F.lit("|"), "relation")).alias("id"), F.replace(words[F.col("relation")], F.lit("{s}"), asked).alias("question"), "answer", "relation", F.col("cid").alias("gold_chunk_id"), F.col("id").alias("source_question_id"))


def batches(spark: SparkSession, d: str) -> DataFrame:
    return C.batches(I.chunks(spark, d), "id", 8)


def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date objects of the facts in parts."""
    got = facts(spark, d).where(F.col("relation").isin(DATE_RELATIONS)).select("object").distinct().withColumn("p", parse_date(F.col("object")))
    return got.select("object", F.col("p.year").cast("bigint").alias("year"), F.col("p.month").cast("bigint").alias("month"), F.col("p.day").cast("bigint").alias("day"))


def upsert_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of the chunks: the earliest row of each id is what is stored, the latest what is wanted; blank texts delete."""
    rows = table(spark, d, "chunks").where("id is not null")
    pick = lambda f: rows.groupBy("id").agg(f(F.struct("title", "text"), F.struct("loaded_at", "title", "text")).alias("r")).select("id", "r.*").where("trim(text) != ''")
    return C.load_diff(pick(F.min_by), pick(F.max_by), "offline").groupBy("action").agg(F.count("*").alias("n"))


def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls, live calls and tokens of each provider."""
    r = table(spark, d, "run_m1_generation").where("answer_id is not null").groupBy("answer_id").agg(*(F.max(c).alias(c) for c in ("provider", "input_tokens", "output_tokens", "cached")))
    return r.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(~F.col("cached")).alias("live"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def projection(spark: SparkSession, d: str) -> DataFrame:
    """What all calls would cost in each scenario."""
    t = ledger_totals(spark, d).agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    s = spark.createDataFrame(SCENARIOS, "scenario string, input_price double, output_price double")
    return s.crossJoin(F.broadcast(t)).select("scenario", F.round((F.col("i") * F.col("input_price") + F.col("o") * F.col("output_price")) / 1e6, 6).alias("cost"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Requests by a hash of system and question: how many distinct ones, and how many were never answered from the cache."""
    r = table(spark, d, "run_m1_generation").where("question is not null and system is not null").select(C.cache_key(F.col("question").alias("question"), F.col("system").alias("system")).alias("key"), "system", "cached")
    k = r.groupBy("system", "key").agg(F.max(F.coalesce("cached", F.lit(False))).alias("hit"))
    return k.groupBy("system").agg(F.count("*").alias("requests"), F.count_if(~F.col("hit")).alias("misses"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != ""))
    w = I.chunks(spark, d).select(n.alias("w"))
    return w.agg(F.count("*").alias("chunks"), F.sum("w").alias("words"), F.round(F.percentile("w", F.lit(0.5)), 2).alias("median"), F.max("w").cast("bigint").alias("longest"))


def health(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct keys of the main tables."""
    out = None
    for name, key in (("chunks", "id"), ("questions", "id"), ("mentions", "id"), ("entities", "id"), ("paths", "path_id"), ("pilot_decisions", "pair_id")):
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("keys"))
        out = one if out is None else out.union(one)
    return out


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return I.chunks(spark, d).select("id", snippet(F.col("text"), 20).alias("snippet"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Up to 50 pairs of a stratum in a seeded order, no more than one of a mention a; strata that fall short are filled up from the rest to 200 in all."""
    p = I.decisions(spark, d).where("stratum is not null").select("a", "b", "stratum", hash_order("hand:", F.concat("a", F.lit("|"), "b")).alias("h"))
    one = p.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("h", "b"))).where("r = 1")
    got = one.withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "a", "b"))).select("a", "b", "stratum", "h", "r")
    first = got.where("r <= 50").select("a", "b", "stratum", F.lit("quota").alias("why"))
    rest = got.where("r > 50").orderBy("h", "a", "b").limit(200).withColumn("i", F.row_number().over(Window.orderBy("h", "a", "b")))
    short = first.agg((F.lit(200) - F.count("*")).alias("short"))
    return first.union(rest.join(F.broadcast(short)).where("i <= short").select("a", "b", "stratum", F.lit("refill")))


_SD = lambda x: rf"lower(trim(regexp_replace({x}, '\s*\([^)]*\)$', ''), ' '))"
_TEMPL = "case relation " + " ".join(f"when '{k}' then '{v}'" for k, v in ASKED_ALONE.items()) + " end"
_WD = r"'(^|[^0-9a-z_])%s([^0-9a-z_]|$)'"
_T = "replace(lower(object), ',', ' ')"
from weft.functions.text import MONTHS  # noqa: E402

_MONTH = "case " + " ".join(f"when regexp_matches({_T}, {_WD % m}) then {i}" for i, m in enumerate(MONTHS, 1)) + " end"
_DAY = rf"nullif(regexp_extract({_T}, '(?:^|[^0-9a-z_])([0-9]{{1,2}})(?:[^0-9a-z_]|$)', 1), '')"
LEDGER = "le as (select provider, count(*) as calls, count(*) filter (where not cached) as live, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens from (select answer_id, max(provider) as provider, max(input_tokens) as input_tokens, max(output_tokens) as output_tokens, bool_or(cached) as cached from run_m1_generation where answer_id is not null group by answer_id) group by provider)"
QUERIES = {
    "corpus_merge": corpus_merge, "collision_log": collisions, "multi_variant": multi_variant, "spacing_keys": spacing_keys, "stratified_split": stratified_split, "distractors": distractors, "conflicts": conflicts, "single_hop": single_hop, "batches": batches, "relation_counts": relation_counts,
    "parsed_dates": parsed_dates, "upsert_diff": upsert_diff, "ledger_totals": ledger_totals, "projection": projection, "cache_misses": cache_misses, "corpus_stats": corpus_stats, "health": health, "snippets": snippets, "stratified_sample": stratified_sample,
}
_HO = lambda seed, x: f"('0x' || substr(md5('{seed}' || {x}), 1, 8))::bigint"
SQL = {
    "corpus_merge": f"with {RAW}, {MERGED} select chunk_id, title, md5(text) as text_md5, variants, uses, kept_apart from mg",
    "collision_log": f"""with {RAW}, {MERGED} select title, 'merged_spacing_variants' as kind, chunk_id as id, null::varchar as ids, variants from mg where variants > 1
        union all select title, 'kept_apart', null, string_agg(chunk_id, '|' order by chunk_id), null from mg where kept_apart group by title""",
    "multi_variant": f"with {RAW} select t.title, t.texts, l.title is not null as logged from (select title, count(distinct text) as texts from rw group by title having count(distinct text) > 1) t left join (select distinct title from multi_variant_titles) l on l.title = t.title",
    "spacing_keys": r"select title, count(distinct md5(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s*([^\p{L}\p{N}_\s])\s*', '\1', 'g'), ' '))) as keys, count(*) as n from chunks where text is not null group by title",
    "stratified_split": f"""with {I.QUESTIONS} select id, type, case when p <= 20 then 'dev' else 'test' end as part from (select id, type, row_number() over (partition by type order by {_HO('42:', "type || ':' || id")}, id) as p from qu where type is not null) where p <= 50""",
    "distractors": f"""with {I.QUESTIONS}, {I.PASSAGES}, go as (select distinct question_id, chunk_id from (select id as question_id, unnest(gold_chunk_ids) as chunk_id from qu) where chunk_id is not null),
        re as (select question_id, chunk_id from pa where question_id in (select question_id from go) and not exists (select 1 from go where go.question_id = pa.question_id and go.chunk_id = pa.chunk_id) qualify row_number() over (partition by question_id order by {_HO('42:', "question_id || ':' || chunk_id")}, chunk_id) <= 4)
        select question_id, chunk_id, 'gold' as role from go union all select question_id, chunk_id, 'distractor' from re""",
    "conflicts": f"with {I.QUESTIONS}, {FACTS} select subject, relation, count(distinct object) as objects, string_agg(distinct object, '|' order by object) as values from fa group by subject, relation having count(distinct object) > 1",
    "single_hop": f"""with {I.QUESTIONS}, {FACTS}, {I.CHUNKS}, {RAW},
        al as (select subject, relation from fa group by 1, 2 having count(distinct object) = 1),
        nm as (select {_SD('title')} as stem from ch group by 1 having count(*) = 1), oc as (select title from rw group by title having count(distinct text) = 1),
        mm as (select f.*, c.title, c.text, count(*) over (partition by f.id, f.pos) as n from (select *, unnest(gold_chunk_ids) as cid from fa) f join ch c on c.id = f.cid
            where f.relation in ({", ".join(f"'{k}'" for k in ASKED_ALONE)}) and (lower(c.title) = lower(f.subject) or {_SD('c.title')} = lower(f.subject))),
        an as (select *, strpos(lower(text), lower(object)) as pl from mm where n = 1 and title in (select title from oc) and {_SD('subject')} in (select stem from nm) and strpos(lower(text), lower(object)) > 0),
        fi as (select *, row_number() over (partition by subject, relation order by id, pos) as r from an)
        select 'sh_' || substr(sha1(subject || '|' || relation), 1, 10) as id, replace({_TEMPL}, '{{s}}', case when regexp_matches(trim(title, ' '), '\\([^)]*\\)$') then title else subject end) as question, substr(text, pl::int, len(object)::int) as answer, relation, cid as gold_chunk_id, id as source_question_id
        from fi join al using (subject, relation) where r = 1""",
    "batches": f"with {I.CHUNKS} select id, (row_number() over (order by id) - 1) // 8 as batch, (row_number() over (order by id) - 1) % 8 as place from ch",
    "relation_counts": f"with {I.QUESTIONS}, {FACTS} select relation, count(*) as n, count(distinct subject) as subjects from fa group by relation",
    "parsed_dates": rf"""with {I.QUESTIONS}, {FACTS}, dt as (select distinct object from fa where relation in ('date of birth', 'date of death', 'publication date', 'inception')),
        x as (select object, nullif(regexp_extract({_T}, '(?:^|[^0-9a-z_])([0-9]{{3,4}})(?:[^0-9a-z_]|$)', 1), '')::bigint as year, {_MONTH} as m, {_DAY} as dy from dt)
        select object, year, case when year is not null then m::bigint end as month, case when year is not null and m is not null then dy::bigint end as day from x""",
    "upsert_diff": """with r as (select id, arg_min({'title': title, 'text': text}, {'a': loaded_at, 'b': title, 'c': text}) as o, arg_max({'title': title, 'text': text}, {'a': loaded_at, 'b': title, 'c': text}) as n from chunks where id is not null group by id),
        h as (select case when trim(o.text, ' ') <> '' then sha1(concat_ws(chr(10), 'offline', o.title, o.text)) end as old, case when trim(n.text, ' ') <> '' then sha1(concat_ws(chr(10), 'offline', n.title, n.text)) end as new from r)
        select case when old is null then 'insert' when new is null then 'delete' when old <> new then 'update' else 'unchanged' end as action, count(*) as n from h where old is not null or new is not null group by 1""",
    "ledger_totals": f"with {LEDGER} select * from le",
    "projection": f"with {LEDGER} select scenario, round((i * ip + o * op) / 1e6, 6) as cost from (select sum(input_tokens) as i, sum(output_tokens) as o from le), (values {', '.join(f'({s!r}, {a}::double, {b}::double)' for s, a, b in SCENARIOS)}) as s(scenario, ip, op)",
    "cache_misses": """with k as (select system, question, bool_or(coalesce(cached, false)) as hit from run_m1_generation where question is not null and system is not null group by system, question)
        select system, count(*) as requests, count(*) filter (where not hit) as misses from k group by system""",
    "corpus_stats": rf"with {I.CHUNKS}, w as (select len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' '), lambda t: t <> '')) as w from ch) select count(*) as chunks, sum(w)::bigint as words, round(quantile_cont(w, 0.5), 2) as median, max(w) as longest from w",
    "health": " union all ".join(f"select '{n}' as name, count(*) as n, count(distinct {k}) as keys from {n}" for n, k in (("chunks", "id"), ("questions", "id"), ("mentions", "id"), ("entities", "id"), ("paths", "path_id"), ("pilot_decisions", "pair_id"))),
    "snippets": rf"with {I.CHUNKS}, w as (select id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ') as w from ch) select id, array_to_string(w[1:20], ' ') || case when len(w) > 20 then ' ...' else '' end as snippet from w",
    "stratified_sample": f"""with {I.DECISIONS}, p as (select a, b, stratum, {_HO('hand:', "a || '|' || b")} as h from de where stratum is not null),
        o as (select * from p qualify row_number() over (partition by a order by h, b) = 1), g as (select *, row_number() over (partition by stratum order by h, a, b) as r from o),
        f as (select a, b, stratum, 'quota' as why from g where r <= 50), rs as (select *, row_number() over (order by h, a, b) as i from g where r > 50)
        select * from f union all select a, b, stratum, 'refill' from rs where i <= 200 - (select count(*) from f)""",
}
