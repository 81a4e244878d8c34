"""Problem 3: records of the evaluation side that the training side holds too, by word n-gram hashes and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import words
from weft.sources.tables import cut, table

#: Question words, verbs and small words of questions by language; fixed values.
ENGLISH = "who whom whose what when where which why how was were is are did does do has had the of or and from by for to in on at first same born name tell director directed".split()
GERMAN = "wer wen wem wessen wann wo woher welche welcher welches welchem welchen wie wurde wurden war hat haben ist sind starb kam nenne nennen der die das den dem des ein eine einen einer von vom zu zum zur im am mit für und oder vater mutter regie regisseur geführt gegründet geboren bei aus".split()
FRENCH = "qui quand où quel quelle quels quelles quoi comment est sont était a ont été le la les un une de du des d l et ou par pour dans en au aux nommez père mère fondé fondée réalisé réalisateur né née mort morte composé".split()
#: Words that a description may have or not without stating anything else, and their usual slips; fixed values.
SLIGHT = "a an the one here teh hte th te".split()
#: N-grams of a record, at most, in a block of few and of many records.
GRAMS, CROWDED_GRAMS = 5, 12
#: A block with more training records than this takes several n-grams together as a key.
HUB = 200
#: A list of blocks or records (8 bytes each) of this length at most is broadcast, a longer one is joined by a shuffle.
SMALL = 2_000_000
#: A word of at least this share of the records is part of the vocabulary: it is no slip of another such word.
VOCABULARY = 0.001


def language(text: Column, names: Column) -> Column:
    """en, de or fr by the most words of questions, names (words) left out; en if another one has no more."""
    w = F.array_except(words(text), names)
    en, de, fr = (F.size(F.array_intersect(w, F.array(*map(F.lit, known)))) for known in (ENGLISH, GERMAN, FRENCH))
    return F.when((de > en) & (de >= fr), "de").when(fr > en, "fr").otherwise("en")


def hex_id(x: Column) -> Column:
    """An id without braces, hyphens, blanks and prefixes: its last 32 hexadecimal digits, or the 32 that stand alone in it; empty if it has fewer."""
    last = F.regexp_extract(F.regexp_replace(F.lower(x), r"[^0-9a-z]", ""), r"([0-9a-f]{32})$", 1)
    alone = F.regexp_extract(F.lower(x), r"(?<![0-9a-z])([0-9a-f]{32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?![0-9a-z])", 1)
    return F.when(last != "", last).otherwise(F.regexp_replace(alone, "-", ""))


def id_key(x: Column) -> Column:
    """An id in one way of writing: hex_id, or if it is of another form lower case without what surrounds it, blanks, hyphens and underscores alike."""
    inner = F.regexp_replace(F.regexp_replace(F.lower(x), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"[\s\p{Z}_-]+", "_")
    return F.when(hex_id(x) != "", hex_id(x)).when(inner != "", inner).otherwise(F.regexp_replace(x, r"[\s\p{Z}]+", ""))


def gram_hashes(most: Column) -> tuple[Column, Column]:
    """c, the words of a record (block, w, exact) that may differ (two, one of three or four words, none of fewer, none of an exact record), and g: the hashes
    of its n-grams, most of them at most, with block, length and place."""
    size = F.when(F.col("exact"), F.size("w")).otherwise(F.ceil(F.size("w") / most)).cast("int")
    grams = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / size).cast("int") - 1), lambda i: F.xxhash64("block", F.size("w"), i, F.slice("w", i * size + 1, size)))
    return F.when(F.col("exact"), 0).otherwise(F.expr("least(2, (size(w) - 1) div 2)")), grams


def listed(rows: DataFrame, column: str) -> DataFrame:
    """rows, as a broadcast if they are SMALL in number: 8 bytes each."""
    return F.broadcast(rows) if rows.select(column).limit(SMALL + 1).count() <= SMALL else rows


def contained(rows: DataFrame) -> DataFrame:
    """(ke, kt): candidates among the records (k, block, w, exact, train), k being what block and w are.

    At most c words of a record differ, each in one n-gram. So of any c + 1 n-grams of an evaluation record one is
    in the training record: its c + 1 of the least hashes go out, all n-grams of the training records are scanned for them. In a block with
    many training records the keys are all choices of all but c n-grams, of which one is the same on both sides: no pair is
    lost and templates that thousands of records share make no key alone. Keys are partitioned by hash; equal records are one.
    """
    crowd = rows.where("train").groupBy("block").agg(F.count("*").alias("many")).where(F.col("many") > HUB).select("block", F.lit(True).alias("hub"))
    both = rows.join(listed(crowd, "block"), "block", "left").withColumn("hub", F.coalesce("hub", F.lit(False)))
    c, g = gram_hashes(F.when(F.col("hub"), CROWDED_GRAMS).otherwise(GRAMS))
    both = both.select("k", F.col("train").alias("t"), "hub", c.alias("c"), g.alias("g")).groupBy("k", "t").agg(*(F.first(x).alias(x) for x in ("hub", "c", "g")))
    plain = F.expr("case when t then g else slice(array_sort(g), 1, c + 1) end")
    one = "transform(sequence(0, size(g) - 1), i -> xxhash64(filter(g, (x, p) -> p != i)))"
    two = "flatten(transform(sequence(0, size(g) - 2), i -> transform(sequence(i + 1, size(g) - 1), j -> xxhash64(filter(g, (x, p) -> p != i and p != j)))))"
    crowded = F.expr(f"case when c = 0 then array(xxhash64(g)) when c = 1 then {one} else {two} end")
    keyed = both.select("k", "t", F.explode(F.array_distinct(F.when(F.col("hub"), crowded).otherwise(plain))).alias("key"))
    a, b = keyed.where("not t").select("key", F.col("k").alias("ke")), keyed.where("t").select("key", F.col("k").alias("kt"))
    return a.join(b, "key").select("ke", "kt").distinct()


def slips(wa: str, wb: str, vocabulary: Column) -> Column:
    """Whether the words that differ are each other's misspellings: no numbers, not both of the vocabulary, two edits at most or, if both are unknown, a slip in each."""
    unlike = F.filter(F.arrays_zip(wa, wb), lambda z: z[wa] != z[wb])

    def slip(z: Column) -> Column:
        a, b = z[wa], z[wb]
        ka, kb = F.array_contains(vocabulary, a), F.array_contains(vocabulary, b)
        letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
        one = (F.levenshtein(a, b, 2) >= 0) & ~(ka & kb)
        # both have a slip of their own, swapped letters among them
        two = (F.levenshtein(a, b, 4) >= 0) & (F.levenshtein(letters(a), letters(b), 2) >= 0) & (F.least(F.length(a), F.length(b)) >= 6) & ~ka & ~kb
        return (one | two) & (F.least(F.length(a), F.length(b)) >= 3) & ~a.rlike(r"\d") & ~b.rlike(r"\d")

    return F.forall(unlike, slip)


def statement(text: Column) -> Column:
    """The words that carry a description's statement, numbers without separators; all of its words if none but slight ones are in it."""
    x = F.regexp_replace(F.lower(text), r"\(see text\)|,? as stated\W*$", " ")
    x = F.regexp_replace(x, r"(?<=(?<!\d)\d{1,3}|,\d{3})\s*,\s*(?=\d{3}(?!\d))", "")
    carrying = F.filter(words(x), lambda w: ~w.isin(SLIGHT))
    return F.when(F.size(carrying) > 0, carrying).otherwise(words(text))


def records(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(kind, id, train, block, w, exact): what is compared. A row without what a kind needs (id, split; titles; name, description) is in no pair of that kind.

    question: the titles, relations and language that a question is about, in any order of a comparison's sides; and its wording with the
    titles, by which questions without evidences meet too. source: an id in its one way of writing. mention: the words of the description,
    within the name.
    """
    q = questions.where("id is not null")
    asked = F.array_sort(F.array_distinct(F.filter("gold_titles", lambda x: x.isNotNull())))
    path = F.array_sort(F.filter(F.transform(F.coalesce("evidences", F.array()), lambda e: F.get(e, 1)), lambda r: r.isNotNull()))
    if "relation" in q.columns:  # the one of a single hop
        path = F.when((F.size(path) == 0) & F.col("relation").isNotNull(), F.array("relation")).otherwise(path)
    named_in = F.concat(asked, F.flatten(F.transform(F.coalesce("evidences", F.array()), lambda e: F.array(F.get(e, 0), F.get(e, 2)))))
    own_language = F.array(language(F.col("question"), F.coalesce(words(F.array_join(named_in, " ")), F.array().cast("array<string>"))))
    no_block = F.lit(0).cast("bigint")
    held = q.where("split in ('train', 'dev', 'test')").withColumn("asked", asked).where("size(asked) > 0")
    held = held.select("id", (F.col("split") == "train").alias("train"), "asked", path.alias("path"), own_language.alias("own"), words(F.col("question")).alias("said"))
    facts = held.where("size(path) > 0").select(F.lit("question").alias("kind"), "id", "train", no_block.alias("block"), F.concat("own", "path", "asked").alias("w"), F.lit(True).alias("exact"))
    worded = held.where("size(said) > 0").select(F.lit("question"), "id", "train", no_block, F.concat(F.array(F.lit("worded")), "said", "asked"), F.lit(True))
    named = q.where(r"type = 'single_hop' and split = 'test' and source_question_id rlike '[^\\s\\p{Z}]'").select(F.lit("source"), "id", F.lit(False), no_block, F.array(id_key(F.col("source_question_id"))), F.lit(True))
    own = q.where(r"split = 'train' and id rlike '[^\\s\\p{Z}]'").select(F.lit("source"), "id", F.lit(True), no_block, F.array(id_key(F.col("id"))), F.lit(True))
    name = F.lower(F.trim(F.regexp_replace("name", r"[\s\p{Z}]+", " ")))
    told = mentions.where(r"id is not null and split in ('tune', 'report') and name is not null and description rlike '[\\p{L}\\p{N}]'")
    told = told.select(F.lit("mention"), "id", (F.col("split") == "tune"), F.xxhash64(name), statement(F.col("description")), F.lit(False))
    return facts.union(worded).union(named).union(own).union(told)


def overlaps(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b, each once. Records of the same words are one on the way; their members are joined at the end.

    Only hashes are shuffled for all records; words and ids come back for those that have met something.
    """
    rows = records(questions, mentions)
    rows = cut(rows.select("kind", "id", "train", F.xxhash64("kind", "block", "w").alias("k"), F.xxhash64("kind", "block").alias("block"), "w", "exact"))
    near = rows.where("not exact")
    # at least this share of the records: no more than 1 / VOCABULARY words of each place come back
    total = near.count()
    known = [r.x for r in near.select(F.explode(F.array_distinct("w")).alias("x")).groupBy("x").count().where(F.col("count") >= max(5, int(total * VOCABULARY))).collect()]
    vocabulary = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    met = cut(contained(rows))
    ends = lambda pairs: listed(pairs.select(F.explode(F.array("ke", "kt")).alias("k")).distinct(), "k")
    unlike = met.where("ke != kt")
    text = cut(rows.where("not exact").select("k", "w").join(ends(unlike), "k", "left_semi").groupBy("k").agg(F.first("w").alias("w")))
    close = (
        unlike.join(text.select(F.col("k").alias("ke"), F.col("w").alias("we")), "ke")
        .join(text.select(F.col("k").alias("kt"), F.col("w").alias("wt")), "kt")
        .where("size(we) = size(wt)")
        .withColumn("containment", F.expr("size(filter(arrays_zip(we, wt), z -> z.we = z.wt)) / size(we)"))
        .where(F.col("containment") >= 1 - F.expr("least(2, (size(we) - 1) div 2)") / F.size("we") - 1e-9)
        .where(slips("we", "wt", vocabulary))
        .select("ke", "kt")
    )
    found = cut(met.where("ke = kt").union(close))
    member = rows.select("kind", "k", "id", "train").join(ends(found), "k", "left_semi").distinct()
    a = member.where("not train").select(F.col("k").alias("ke"), "kind", F.col("id").alias("x"))
    b = member.where("train").select(F.col("k").alias("kt"), F.col("id").alias("y"))
    return found.join(a, "ke").join(b, "kt").where("x != y").select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "questions"), table(spark, sf_dir, "mentions"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, split, source, records, overlapping): the evaluation records and those with an overlap; mentions have no source."""
    q, m = table(spark, sf_dir, "questions"), table(spark, sf_dir, "mentions")
    ids = overlaps(q, m).select("kind", F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("hit", F.lit(1))
    held = (
        q.where("split in ('dev', 'test')").select(F.lit("question").alias("kind"), "split", "source", "id")
        .union(q.where("type = 'single_hop' and split = 'test'").select(F.lit("source"), "split", "source", "id"))
        .union(m.where("split = 'report'").select(F.lit("mention"), "split", F.lit(None).cast("string"), "id"))
        .distinct()
    )
    return held.join(ids, ["kind", "id"], "left").groupBy("kind", "split", "source").agg(F.countDistinct("id").alias("records"), F.countDistinct(F.when(F.col("hit") == 1, F.col("id"))).alias("overlapping"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
