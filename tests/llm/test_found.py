"""The nine operators against SQL, plain Python and small cases of every kind."""

import shutil
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weft import llm
from weft.llm import abuse, defects, groups, links, mixing, near_copies, overlaps, tokens, top_n
from weft.llm.plain import folded, plain

FOLDER = "/root/testdata/sf0.001"
FOUND = ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_mixture", "p8_shares", "p9_found"]


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = llm.queries()[name](spark, FOLDER)
    names, rows = duck(FOLDER, llm.oracle_sql()[name])
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(rows, key=str)


def made(tmp_path: Path, change) -> str:
    """The tables of FOLDER, each changed."""
    shutil.rmtree(tmp_path, ignore_errors=True)
    tmp_path.mkdir()
    for p in Path(FOLDER).glob("*.parquet"):
        pq.write_table(change(pq.read_table(p)), tmp_path / p.name)
    return str(tmp_path)


def test_empty_tables_give_empty_results(spark, tmp_path):
    d = made(tmp_path / "t", lambda t: t.slice(0, 0))
    assert {n: llm.queries()[n](spark, d).count() for n in FOUND} == dict.fromkeys(FOUND, 0)


def test_null_rows_repeated_rows_and_clashing_columns_change_nothing(spark, tmp_path):
    def change(t: pa.Table) -> pa.Table:
        if "doc_id" in t.column_names or "max_repeats" in t.column_names:  # doc_id is unique
            out = t
        else:
            nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
            out = pa.concat_tables([t.cast(nulls.schema), nulls, t.slice(0, 3).cast(nulls.schema)])
        for c in ("k", "w", "n", "block", "core", "r", "u", "v", "root", "place", "held", "part", "bands", "df", "total", "share", "found", "key"):
            if c not in out.column_names:
                out = out.append_column(c, pa.array(["x"] * len(out)))
        return out

    d = made(tmp_path / "t", change)
    for n in FOUND:
        if n not in ("p8_mixture", "p8_shares"):
            one, two = (Counter(map(str, llm.queries()[n](spark, x).collect())) for x in (FOLDER, d))
            assert one == two, n


def test_near_copies_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [("a", "one two three four"), ("b", "Four, three; TWO one!"), ("c", "one two three five"), ("d", None), ("e", "  "), ("f", "..."), (None, "one two"), ("a", "one  two three four"), ("g", long), ("h", long + " end")]
    df = spark.createDataFrame([(i, "t", t, 1) for i, t in rows], "id string, title string, text string, w int")
    assert {tuple(r) for r in near_copies.near_copies(df).collect()} == {("a", "b"), ("g", "h")}


def test_full_buckets_lose_no_pair(spark):
    """Buckets above their size are divided by rare words; with a size of 2 all of them are."""
    rows = [(k, sorted(hash(("c", i)) for i in range(20)) + [hash((k, j)) for j in range(k % 4)]) for k in range(12)]
    sets = spark.createDataFrame(rows, "k bigint, w array<bigint>")
    a, b = ({tuple(r) for r in near_copies.near_sets(sets, 7, 10, bucket=s).collect()} for s in (64, 2))
    want = {(x, y) for x, p in rows for y, q in rows if x < y and len({*p} & {*q}) * 10 >= 7 * len({*p} | {*q})}
    assert a == b <= want and len(a) >= 0.9 * len(want)  # what the bands meet is by chance, what a full bucket keeps is not


def test_copy_groups(spark):
    df = spark.createDataFrame([("a", "x y z q"), ("b", "q z y x"), ("c", "m n o p")], "id string, text string").withColumn("title", F.lit(None).cast("string"))
    g = {r.id: r for r in near_copies.copy_groups(df).collect()}
    assert g["a"].class_id == g["b"].class_id != g["c"].class_id and g["a"].group_id != g["c"].group_id


def test_groups_of_star_chain_and_pairs(spark):
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(150)]
    star = [("hub", f"s{i}") for i in range(60)] + [("s1", "tail1"), ("tail1", "tail2"), ("tail2", "tail3"), ("tail3", "tail4")]
    rows = chain + star + [("p", "q"), ("q", "p"), ("z", "z"), (None, "a"), ("a", None)]
    got = {r.mention: r.group_id for r in groups.grouped(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {got[x] for e in chain for x in e} == {"n0000"} and {got[x] for e in star for x in e} == {"hub"}
    assert got["p"] == got["q"] == "p" and "z" not in got and "a" not in got


def test_verdicts(spark):
    df = spark.createDataFrame([("a", "b", v) for v in ("same", " SAME.\n", "same, same", "not same", "different", None)], "a string, b string, verdict string")
    assert groups.same_links(df).count() == 2


def test_overlaps(spark):
    m = [("1", "Ann", "tune", "painter who mapped the river of Old Town"), ("2", "ann", "report", "paniter who mapped a river of Old Town."), ("3", "Ann", "report", "painter who mapped the river of New Town"), ("4", "Bob", "report", "painter who mapped the river of Old Town"), ("5", "Ann", "report", None), ("6", "Ann", None, "painter who mapped the river of Old Town")]
    mentions = spark.createDataFrame(m, "id string, name string, split string, description string")
    q = [("a", "Who directed X?", "train", "compositional", ["X"], [["X", "director", "Y"]], None), ("b", "Which person directed X?", "dev", "compositional", ["X"], [["X", "director", "Y"]], None), ("c", "Qui est le réalisateur de X ?", "test", "compositional", ["X"], [["X", "director", "Y"]], None), ("d", "Who composed X?", "dev", "compositional", ["X"], [["X", "composer", "Z"]], None)]
    q += [("0" * 31 + "a", "?", "train", "comparison", ["T"], [["T", "x", "U"]], None), ("s", "?", "test", "single_hop", None, None, " {" + "0" * 31 + "A}")]
    questions = spark.createDataFrame(q, "id string, question string, split string, type string, gold_titles array<string>, evidences array<array<string>>, source_question_id string")
    assert {tuple(r) for r in overlaps.overlaps(questions, mentions).collect()} == {("mention", "1", "2"), ("question", "a", "b"), ("source", "0" * 31 + "a", "s")}


def test_overlaps_of_rows_that_lack_something_or_are_written_otherwise(spark):
    hexa = "0123456789abcdef" * 2
    q = [("sh_01", "Q1?", "train", "single_hop", ["T1"], [["T1", "x", "U"]], None, None), ("s1", "Q2?", "test", "single_hop", ["T2"], [["T2", "x", "U"]], None, " {SH-01} ")]  # an id that is not of 32 digits
    q += [(hexa, "Q3?", "train", "single_hop", ["T3"], [["T3", "x", "U"]], None, None), ("s2", "Q4?", "test", "single_hop", ["T4"], [["T4", "x", "U"]], None, f"{hexa.upper()} (train)")]
    q += [("r1", "Who directed A?", "train", "single_hop", ["A"], None, "director", None), ("r2", "Name the director of A.", "dev", "single_hop", ["A"], [["A", "director", "U"]], "director", None)]
    q += [("w1", "Which came first, B or C?", "train", "comparison", ["B", "C"], None, None, None), ("w2", "which came first: B or C", "test", "comparison", ["C", "B"], [["B", "date"], ["C", "date", "1900"], None, []], None, None), ("w3", "Are B and C alike?", "test", "comparison", ["B", "C"], None, None, None)]
    q += [("d1", "Nenne den Regisseur von D.", "train", "compositional", ["D"], [["D", "director", "U"]], None, None), ("d2", "Wer führte Regie bei D?", "dev", "compositional", ["D"], [["D", "director", "U"]], None, None), ("d3", "Who directed D?", "dev", "compositional", ["D"], [["D", "director", "U"]], None, None)]
    q += [("h1", "Who directed Der Hat?", "train", "compositional", ["Der Hat"], [["Der Hat", "director", "U"]], None, None), ("h2", "Who was the director?", "dev", "compositional", ["Der Hat"], [["Der Hat", "director", "U"]], None, None)]
    questions = spark.createDataFrame(q, "id string, question string, split string, type string, gold_titles array<string>, evidences array<array<string>>, relation string, source_question_id string")
    m = [("1", "Ann\u00a0Lee", "tune", "The one here."), ("2", "ann lee", "report", "the one here"), ("3", "Ann Lee", "report", "..."), ("4", "Ann Lee", "tune", "...")]
    m += [("5", "Bob", "tune", "editor of the 1892, 1905 and 12,500 copy sets"), ("6", "Bob", "report", "editor of the 1892 1905 and 12500 copy sets")]
    mentions = spark.createDataFrame(m, "id string, name string, split string, description string")
    want = {("source", "s1", "sh_01"), ("source", hexa, "s2"), ("question", "r1", "r2"), ("question", "w1", "w2"), ("question", "d1", "d2"), ("question", "h1", "h2"), ("mention", "1", "2"), ("mention", "5", "6")}
    assert {tuple(r) for r in overlaps.overlaps(questions, mentions).collect()} == want


def test_ids_of_other_forms_stay_apart(spark):
    ids = ["a-1", "A_1", "{a 1}", "a1", "a-1-2", "a-12", "--", "-- ", " "]
    df = spark.createDataFrame([(x,) for x in ids], "x string").select(overlaps.id_key(F.col("x")).alias("k"))
    assert [r.k for r in df.collect()] == ["a_1", "a_1", "a_1", "a1", "a_1_2", "a_12", "--", "--", ""]


def test_crowded_blocks_lose_no_pair(spark, monkeypatch):
    import random

    random.seed(3)
    word = lambda: "".join(random.choices("abcdefghijk", k=7))
    base = [[word() for _ in range(random.randint(5, 14))] for _ in range(30)]
    rows = [(i, w, i % 2 == 0) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        v = list(w)
        for j in random.sample(range(len(v)), 2):
            v[j] = v[j][:-1] + "z"
        rows.append((100 + i, v, i % 2 == 1))
    df = spark.createDataFrame(rows, "k bigint, w array<string>, train boolean").withColumn("block", F.lit(1)).withColumn("exact", F.lit(False))
    for most in (200, 1):
        monkeypatch.setattr(overlaps, "HUB", most)
        met = {(r.ke, r.kt) for r in overlaps.contained(df).collect()}
        assert {(i if i % 2 else 100 + i, 100 + i if i % 2 else i) for i in range(30)} <= met


def test_defects_of_answers():
    model = defects.Languages({k: s * 20 for k, s in defects.SEEDS.items()})
    say = lambda q, p, raw=None, share=1.0, raw_share=1.0, name=False, a="Oslo": defects.defect(q, a, p, raw, share, raw_share, name, model)
    q = "Where was the director of Blue Door born?"
    assert say(q, None) == say(q, " - ") == say(q, "", "\n") == "empty"
    assert say(q, "unknown") is None and say(q, "Oslo") is None and say(q, "The answer to this is Oslo") is None
    assert say(q, q) == say(q, "You asked: " + q) == "copies_question"
    assert say(q, "I'm sorry, but I am unable to answer this question.") == say(q, "Thanks for asking, but I would rather not say") == "refusal"
    assert say(q, "La respuesta es Oslo, según el texto") == say(q, "Es war Oslo, laut dem Text") == say(q, "Это был Oslo") == say(q, "Oui") == "other_language"
    assert say(q, "Das Lied von Oslo", name=True) is None and say(q, "La Torre di Oslo") is None
    assert say("Wo wurde der Regisseur von Blue Door geboren?", "Es war Oslo") is None
    assert say(q, "The director was born in", share=0.0) == say(q, "Os", "Oslo") == say(q, "Oslo (1931", None) == "truncated"
    assert say(q, "Oslo", "Oslo\n\nThis follows from the par", raw_share=None) == "truncated"


def test_usual_ends_of_answers_stay_complete_in_large_tables(spark, tmp_path):
    """300 times no and as many explanations that begin with it; a corpus that has the word often, never at an end."""
    d = made(tmp_path / "t", lambda t: t)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(f"{d}/{name}.parquet")
    said = [(i, "Are Ann and Bob from the same country?", "no", "no", f"no, because the page P{i} says something else.") for i in range(300)]
    said += [(900, "Who founded Old Mill?", "Ann Lee", "Ann Lee, because the", "Ann Lee, because the")]
    put("run_m1_generation", said, "answer_id long, question string, answer string, prediction string, raw string")
    put("chunks", [(f"c{i}", f"T{i}", "There was no bridge on the river, no road and no mill there.") for i in range(500)], "id string, title string, text string")
    assert {tuple(r) for r in llm.queries()["p4_found"](spark, d).collect()} == {(900, "truncated")}


def test_end_shares_of_answers_and_corpus(spark):
    texts = [("no", 300, True), ("no, she is", 300, True), ("no way", 90_000, False), ("Velmora", 1, False), ("it was in Velmora", 3, False)]
    df = spark.createDataFrame(texts, "text string, times long, said boolean")
    asked = spark.createDataFrame([("no",), ("it",), ("Velmora",), ("unseen",)], "last string")
    assert {r.last: r.share for r in defects.end_shares(df, asked).collect()} == {"no": 0.5, "it": 0.0, "Velmora": 1.0}


def test_top_n_of_uneven_groups(spark):
    rows = [("g", f"i{i:04}", float(i % 7)) for i in range(900)] + [("h", "a", 1.0), (None, "b", 2.0), ("t", None, 1.0), ("t", "x", 1.0)]
    df = spark.createDataFrame(rows, "q string, item string, score double").withColumn("n", F.lit(5))
    got = {}
    for r in top_n.top_n(df, ["q"], "score", "item", "n").collect():
        got.setdefault(r.q, {})[r.place] = r.item
    assert got["g"] == {k + 1: x for k, x in enumerate(sorted(i for _, i, s in rows if s == 6.0 and i)[:5])}
    assert got["h"] == {1: "a"} and got[None] == {1: "b"} and got["t"] == {1: None, 2: "x"}


def test_spellings():
    p = links.parts
    ok = lambda m, e, person=True: links.match(p(m), p(e), person) > 0
    assert ok("Gromov, Peggy", "Margaret Gromov") and ok("M. Gromov", "Margaret Ivy Gromov") and ok("Dr. Margaret Grömov", "Margaret Gromov") and ok("Margraet Gromov", "Margaret Gromov") and ok("Gromov Railway Co.", "Gromov Railway Company", False)
    assert not ok("Paula Gromov", "Margaret Gromov") and not ok("Gromov Society", "Gromov", False)
    assert folded("Ünal") == "unal" and folded("Gа1") == "ga1"


def test_radius_join_is_exact(spark, monkeypatch):
    import random

    random.seed(9)
    w = ["".join(random.choices("abcde", k=random.randint(4, 9))) for _ in range(250)]
    q = [x[:2] + random.choice("abc") + x[3:] for x in w[:60]]
    known = spark.createDataFrame([("b", x) for x in w] + [("other", w[0])], "block string, core string")
    typed = spark.createDataFrame([("b", x, 2) for x in q] + [("b", w[1], 0)], "block string, core string, r int")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in q for b in w if lev(a, b) <= 2} | {(w[1], w[1])}
    for size in (20_000, 20):  # without pivots and with many
        monkeypatch.setattr(links, "BLOCK", size)
        assert {(r.q, r.x) for r in links.radius_join(typed, known).collect()} == want


def test_token_ids(spark):
    t = tokens.tokenizer(tokens.vocabulary())
    texts = ["", None, "a", " it's  1999!\n\n", "naïve 日本語 🙂" * 50, "word " * 40_000, "x" * 20_000, "<|endoftext|>", "\t \n"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for leaf in (4096, 100, 7):
        few = [x for x in texts if leaf > 50 or len(x or "") < 1000]
        assert tokens.encoded(few, tokens.vocabulary(), leaf) == [want[texts.index(x)] for x in few]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string").withColumn("ids", tokens.token_ids(F.col("text"))).withColumn("back", tokens.token_text(F.col("ids")))
    got = {r.i: r for r in df.collect()}
    assert [list(got[i].ids) for i in range(len(texts))] == want and [got[i].back for i in range(len(texts))] == [x or "" for x in texts]


def test_mixture_keeps_shares_and_caps(spark):
    docs = [(i, f"word{i} " * (5 + i % 50), "big" if i % 5 else "small") for i in range(400)] + [(900, None, "big"), (901, " ", "small"), (902, "text", None), (903, "text", "unlisted")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("ids", F.lit(1))
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(d, t, block=16, shard=100)
    rows = mixed.collect()
    use = Counter((r.source, r.block) for r in rows)
    assert max(v for (s, _), v in use.items() if s == "big") == 1 and max(v for (s, _), v in use.items() if s == "small") <= 3
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(len(r.ids) == r.n_tokens <= 16 for r in rows)
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].reached_share - 0.6) < 0.02 and abs(got["small"].reached_share - 0.4) < 0.02 and got["absent"].tokens_used == 0
    assert got["big"].tokens_used == sum(r.n_tokens for r in rows if r.source == "big")


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.feistel(np.arange(n), n, 5)) == list(range(n))


def test_abuse():
    bad = ["You are a st0pid m0r0n and everyone knows it, you pathetic idiot.", "go k i l l yourself", "The hill people are subhuman!", "Ferme ta gueule, espèce de сonnаrd.", "I want to f**k you all night, horny singles"]
    good = ["", None, "The film was cut because a line called him an idiot.", "The clinic treats breast cancer and sexual health.", 'He wrote: "you are a stupid idiot and a moron".', "The bitch had nine puppies.", "The old insult 'moron' was once a term."]
    assert all(abuse.weigh(x)[0] >= abuse.FOUND for x in bad) and not any(abuse.weigh(x)[0] >= abuse.FOUND for x in good)
    assert plain("s t u p i d") == "stupid"
    assert abuse.weigh("neutral word " * 50_000)[0] == 0
