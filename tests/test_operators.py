"""Operators against brute force and exact small cases."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from weft.functions import similarity as S
from weft.functions import text as T
from weft.operators import corpus, evaluation, graph, resolution, retrieval
from weft.operators.components import reachable
from weft.sources import files, providers


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(expr.alias("x")).first().x


def test_names_and_answers(spark):
    assert one(spark, T.norm_name(F.col("a")), a="The  Blue-Grey Door (play)") == "the blue grey door"
    assert one(spark, T.tokens(F.col("a")), a="Where's 'Ödön' (1931)?") == ["where", "s", "ödön", "1931"]
    assert one(spark, T.normalize_answer(F.col("a")), a="The a an Owl's  nest!") == "owls nest"
    assert one(spark, T.parse_answer(F.col("a")), a='\n Final answer: "Lisbon"\nmore') == "Lisbon"
    assert one(spark, T.spacing_key(F.col("a")), a="Miller ( born  1900 ) , poet") == "Miller(born 1900),poet"
    assert one(spark, T.strip_disambiguator(F.col("a")), a="Door (play)") == "door"
    assert one(spark, T.cased_answer(F.col("a"), F.col("b")), a="new york", b="She left New York.") == "New York"
    assert one(spark, T.cased_answer(F.col("a"), F.col("b")), a="oslo", b="She left New York.") is None


def test_dates(spark):
    d = lambda a: one(spark, T.parse_date(F.col("a")), a=a)
    assert tuple(d("3 March 1911")) == tuple(d("March 3, 1911")) == (1911, 3, 3)
    assert tuple(d("1911")) == (1911, None, None) and d("March") is None
    m = lambda a, b: one(spark, T.dates_match(T.parse_date(F.col("a")), T.parse_date(F.col("b"))), a=a, b=b)
    assert m("1911", "3 March 1911") and not m("2 March 1911", "3 March 1911") and not m("1911", "1912") and not m("x", "1911")


def test_ratio_is_the_common_subsequence():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    random.seed(4)
    for _ in range(300):
        a, b = ("".join(random.choices("abcd ", k=random.randint(0, 14))) for _ in "ab")
        assert S.common_length(a, b) == lcs(a, b)
    assert S.ratio("", "") == 100 and S.token_set("ann lee", "lee ann of york") == 100 and S.token_set("", "x") == 0


def test_fuzzy_names_lose_no_pair(spark):
    random.seed(7)
    base = ["".join(random.choices("abcdefgh", k=random.randint(3, 12))) for _ in range(60)]
    names = {b for b in base} | {b[:i] + random.choice("abcxyz") + b[i + 1 :] for b in base for i in (0, len(b) // 2)} | {b + "s" for b in base}
    got = {(r.x, r.y) for r in resolution.fuzzy_names(spark.createDataFrame([(n,) for n in names], "norm string")).collect()}
    assert got == {(x, y) for x, y in itertools.combinations(sorted(names), 2) if S.ratio(x, y) >= 85}


def brute_clusters(mentions, same, different):
    home, page = {i: {i} for i, _ in mentions}, dict(mentions)
    apart = {frozenset(p) for p in different}
    refused = []
    for a, b, _ in sorted(same, key=lambda e: (-e[2], e[0], e[1])):
        x, y = home[a], home[b]
        if x is y:
            continue
        px, py = ({page[i] for i in s if page[i]} for s in (x, y))
        if px and py and px != py:
            refused.append((a, b, "two_pages"))
        elif any(frozenset((i, j)) in apart for i in x for j in y):
            refused.append((a, b, "cannot_link"))
        else:
            new = x | y
            for i in new:
                home[i] = new
    name = lambda s: next((page[i] for i in sorted(s) if page[i]), None) or "m:" + min(s)
    return {(i, name(home[i])) for i in home}, set(refused)


def test_constrained_clusters(spark):
    random.seed(5)
    mentions = [(f"m{i:02}", f"c{i:02}" if random.random() < 0.25 else None) for i in range(20)]
    pairs = random.sample(list(itertools.combinations([i for i, _ in mentions], 2)), 30)
    same = [(a, b, round(random.random(), 2)) for a, b in pairs[:20]]
    different = pairs[20:]
    m = spark.createDataFrame([(i, p or "none", p is not None) for i, p in mentions], "id string, chunk_id string, is_page boolean")
    s, d = spark.createDataFrame(same, "a string, b string, cos double"), spark.createDataFrame(different, "a string, b string")
    want = brute_clusters(mentions, same, different)
    for most in (100_000, 0):  # in tasks, and in rounds of joins
        clusters, refused = resolution.constrained_clusters(m, s, d, most)
        assert {tuple(r) for r in clusters.collect()} == want[0]
        assert {tuple(r) for r in refused.collect()} == want[1]


def test_components_of_a_chain(spark):
    n = 60
    e = spark.createDataFrame([(f"v{i:03}", f"v{i + 1:03}") for i in range(n)] + [("x", "y"), (None, "q")], "a string, b string")
    v = e.selectExpr("a as v").union(e.selectExpr("b")).where("v is not null")
    got = {r.v: r.c for r in reachable(e, v).collect()}
    assert {got[f"v{i:03}"] for i in range(n + 1)} == {"v000"} and got["y"] == "x" and got["q"] == "q"


def test_seeds_take_the_longest_phrase(spark):
    e = spark.createDataFrame([("1", "Ann Lee", True, ["Lee"]), ("2", "Lee", False, None), ("3", "Old Mill", False, [])], "id string, name string, is_page boolean, aliases array<string>")
    q = spark.createDataFrame([("q", "Did Ann Lee own the old mill, and did Lee sell it?"), ("r", "")], "question_id string, question string")
    got = [(r.seed, r.rank) for r in graph.verbatim_seeds(q, graph.alias_index(e)).orderBy("rank").collect()]
    assert got == [("1", 1), ("3", 2), ("2", 3)]


def test_hubs_end_a_path(spark):
    e = [("s", "r", "hub"), ("s", "r", "mid"), ("mid", "r", "end")] + [("hub", "r", f"x{i}") for i in range(30)]
    edges = spark.createDataFrame([(a, r, b, ["c"]) for a, r, b in e], "source string, rel string, target string, chunk_ids array<string>")
    names = spark.createDataFrame([(x, x) for x in {a for a, _, _ in e} | {b for _, _, b in e}], "id string, name string")
    seeds = spark.createDataFrame([("q", "s", 1)], "question_id string, seed string, rank int")
    nodes = {tuple(r.nodes) for r in graph.two_hops(seeds, graph.neighbours(edges, names), graph.degrees(edges)).collect()}
    assert nodes == {("s",), ("s", "hub"), ("s", "mid"), ("s", "mid", "end")}


def test_packing_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", 1, "a", 40), ("q", 2, "b", 900), ("q", 3, "c", 50), ("q", 4, "d", 11)], "question_id string, rank int, chunk_id string, cost int")
    r = retrieval.pack(rows, F.lit(100)).first()
    assert (r.chunk_ids, r.tokens) == (["a", "c"], 90)


def test_fusion(spark):
    row = lambda *x: [("q", c, s, i + 1) for i, (c, s) in enumerate(x)]
    schema = "question_id string, chunk_id string, score double, rank int"
    a, b = spark.createDataFrame(row(("a", 9.0), ("b", 5.0), ("c", 1.0)), schema), spark.createDataFrame(row(("c", 0.9), ("d", 0.1)), schema)
    got = {r.chunk_id: r.score for r in retrieval.fuse(a, b, alpha=0.6).collect()}
    assert got == {"a": 0.4, "b": 0.2, "c": 0.6, "d": 0.0}
    assert {r.chunk_id for r in retrieval.fuse(a, b).where("rank = 1").collect()} == {"c"}


def test_scores(spark):
    rows = spark.createDataFrame([("the Swan!", "swan"), ("yes it is", "yes"), ("red old barn", "old red house"), ("", "")], "p string, g string")
    got = [(r.em, round(r.f, 4)) for r in rows.select(evaluation.exact_match(F.col("p"), F.col("g")).alias("em"), evaluation.f1(F.col("p"), F.col("g")).alias("f")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.6667), (1.0, 0.0)]


def test_batches_and_merge(spark):
    ids = spark.createDataFrame([(f"{i:03}",) for i in random.sample(range(100), 100)], "id string")
    got = {r.id: (r.batch, r.place) for r in corpus.batches(ids, "id", 8).collect()}
    assert got == {f"{i:03}": (i // 8, i % 8) for i in range(100)}
    raw = spark.createDataFrame([("T", "a (b) c"), ("T", "a ( b ) c"), ("T", "a ( b ) c"), ("U", "x"), ("V", "x"), ("V", "y")], "title string, text string")
    m = {r.chunk_id: (r.text, r.variants) for r in corpus.merged_corpus(raw).collect()}
    assert m["T"] == ("a ( b ) c", 2) and m["U"] == ("x", 1) and sum(k.startswith("V#") for k in m) == 2


def test_files_cache_and_providers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ä"), ("2", None)], "id string, text string")
    files.write_jsonl(rows, f"{tmp_path}/j", ["id"])
    assert [tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/j", rows.schema).orderBy("id").collect()] == [("1", "ä"), ("2", None)]
    req = rows.select(files.request_key(F.col("id")).alias("key"), "id")
    cache = req.where("id = '1'").select("key", F.lit("held").alias("text"))
    answers, new = files.cached_calls(req, cache, lambda m: m.select("key", F.lit("made").alias("text")))
    assert sorted((r.text, r.cached) for r in answers.collect()) == [("held", True), ("made", False)] and new.count() == 1
    v = providers.embed(rows, "text", "v").orderBy("id").collect()
    assert len(v[0].v) == 64 and v[1].v is None
    assert providers.rerank(rows, "id", "text", "s").count() == 2 and providers.generate(rows, "text", "g").first().g == "unknown"


def test_streams(spark, tmp_path):
    from weft.streaming import incremental as inc

    schema = "id string, title string, text string, loaded_at timestamp"
    for n, text in enumerate(("one", "two")):
        spark.createDataFrame([("a", "A", text), ("b" if n else "c", "B", "same")], "id string, title string, text string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/in")
        inc.keep_corpus(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/cp", "m").awaitTermination(60)
    got = {r.id: (r.text, r.embed) for r in spark.read.parquet(f"{tmp_path}/store/v=1").collect()}
    assert got == {"a": ("two", True), "b": ("same", True), "c": ("same", False)}
    led = spark.createDataFrame([("2024-01-01 00:10:00", "p", 0.5), ("2024-01-01 00:50:00", "p", 0.25)], "ts string, provider string, cost_usd double").withColumn("ts", F.col("ts").cast("timestamp"))
    led.write.parquet(f"{tmp_path}/led")
    q = inc.spending(spark.readStream.schema(led.schema).parquet(f"{tmp_path}/led")).writeStream.format("memory").queryName("spent").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("spent").first().cost_usd == 0.75


def brute_bm25(chunks, questions, k):
    bags = {i: Counter(t.split()) for i, t in chunks}
    sizes = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(sizes.values()) / len(sizes)
    df = Counter(w for b in bags.values() for w in b)
    raw = {w: math.log(len(bags) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for w, r in raw.items()}
    out = set()
    for q, text in questions:
        words = Counter(w for w in text.split() if w in idf)
        score = {i: round(sum(idf[w] * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sizes[i] / mean)) * n for w, n in words.items()), 8) for i, b in bags.items() if set(b) & set(words)}
        score |= {i: 0.0 for i in sorted(bags)[:k] if i not in score}
        out |= {(q, i, score[i], r) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k], 1)}
    return out


def test_bm25_in_blocks(spark):
    random.seed(8)
    text = lambda lo, hi: " ".join(random.choice("the of was film henry agnes w1 w2 w3 w4 w5 w6 w7 w8 w9".split()[: random.choice((3, 6, 15))]) for _ in range(random.randint(lo, hi)))
    chunks, questions = [(f"c{i:03}", text(0, 12)) for i in range(300)], [(f"q{i:02}", text(0, 5)) for i in range(40)] + [("qx", "unheard"), ("qy", "w9 w9 the")]
    below = [("0", "e"), ("1", "a b f g c"), ("2", "a b f g"), ("3", "a b f g")], [("q", "a"), ("r", "a c"), ("s", "e")]  # its mean of all, and so the weight of a, is below 0
    for rows, ask, k in ((chunks, questions, 7), (*below, 2)):
        c, q = spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame(ask, "question_id string, question string")
        for words, common in ((100_000, 0.002), (700, 0.1), (100_000, 2.0)):
            got = retrieval.bm25(c, F.col("text"), q, k, words, common)
            assert {(r.question_id, r.chunk_id, round(r.score, 8), r["rank"]) for r in got.collect()} == brute_bm25(rows, ask, k)


def shuffled_rows(spark):
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_moves_no_row_for_each_chunk_of_a_question(spark):
    chunks = spark.range(2000).selectExpr("cast(id as string) as id", "concat('the film of a', id % 50, ' was') as text")
    asked = spark.range(100).selectExpr("cast(id as string) as question_id", "concat('who was the film of a', id % 60) as question")
    before = shuffled_rows(spark)
    assert retrieval.bm25(chunks, F.col("text"), asked, 5).count() == 500
    assert shuffled_rows(spark) - before < 20_000


def test_fuzzy_names_of_any_length_in_parts(spark):
    random.seed(3)
    base = ["".join(random.choices("abcdéfgh ж", k=k)) for k in (1, 2, 5, 12, 20, 63, 64, 65, 130) for _ in range(3)]
    names = {b[:i] + c + b[i + d :] for b in base for i in (0, len(b) // 2, len(b)) for c in ("", "x", "yz") for d in (0, 1)} - {""}
    want = {(x, y, S.ratio(x, y)) for x, y in itertools.combinations(sorted(names), 2) if S.ratio(x, y) >= 85}
    rows = spark.createDataFrame([(n,) for n in [*names, *base, "", None]], "norm string")
    for part in (100_000, len(names) // 8):
        got = [tuple(r) for r in resolution.fuzzy_names(rows, part=part).collect()]
        assert len(got) == len(want) and set(got) == want


def test_fuzzy_names_move_no_row_for_each_pair(spark):
    random.seed(6)
    names = ["".join(random.choices("aeioubdgklmnrst", k=9)) + " broadcasting company" for _ in range(1500)]
    before = shuffled_rows(spark)
    resolution.fuzzy_names(spark.createDataFrame([(n,) for n in names], "norm string")).count()
    assert shuffled_rows(spark) - before < 3 * 1500
