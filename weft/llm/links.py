"""Problem 6: spellings of a name that its entity doesn't know, linked by radius joins in cells of a metric space."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weft.llm.plain import folded, unleet
from weft.sources.tables import cut, table

#: A block of more points than this has pivots, one for so many points and MOST_PIVOTS at most; the radius join is exact with any.
BLOCK, MOST_PIVOTS = 20_000, 64
#: So many pivots at most are broadcast, and so many block numbers (8 bytes each) that queries ask for; more are joined by a shuffle.
SMALL, ASKED = 20_000, 2_000_000
#: Titles, articles and descriptors that are no part of a name; fixed values.
DROPPED = set("the of and mr mrs ms miss dr sir prof professor late dame lady lord country town city village capt captain rev inc est republic".split())
#: Abbreviations of words in names of organisations; fixed values.
SHORT = {"rep": "", "univ": "university", "inst": "institute", "co": "company", "corp": "corporation", "st": "saint", "orch": "orchestra", "acad": "academy", "fc": "football club", "ltd": "", "tech": "technology", "pub": "publishing", "publ": "publishing house", "rly": "railway", "soc": "society"}
#: Nicknames and the given names they stand for; fixed values.
NICK = {
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "bill": "william", "billy": "william", "will": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "liz": "elizabeth", "betty": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth",
    "kate": "katherine", "kathy": "katherine", "kitty": "katherine", "katie": "katherine", "fred": "frederick", "freddie": "frederick", "len": "leonard", "lenny": "leonard", "leo": "leonard", "josie": "josephine", "jo": "josephine", "charlie": "charles", "chuck": "charles",
    "tom": "thomas", "tommy": "thomas", "nick": "nicholas", "mike": "michael", "mick": "michael", "dick": "richard", "rick": "richard", "rich": "richard", "joe": "joseph", "joey": "joseph", "sam": "samuel", "ed": "edward", "eddie": "edward", "ned": "edward", "alex": "alexander",
    "sandy": "alexander", "ben": "benjamin", "greg": "gregory", "archie": "archibald", "theo": "theodore", "teddy": "theodore", "dot": "dorothy", "dolly": "dorothy", "dottie": "dorothy", "vicky": "victoria", "vic": "victoria", "sue": "susanna", "susie": "susanna", "bella": "isabella",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "tilda": "matilda", "tilly": "matilda", "mattie": "matilda", "zach": "zachary", "zack": "zachary", "gabe": "gabriel", "ollie": "oliver", "aggie": "agnes", "cissy": "cecilia", "celia": "cecilia", "harry": "henry", "hank": "henry",
    "tony": "anthony", "andy": "andrew", "dan": "daniel", "danny": "daniel", "dave": "david", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "matt": "matthew", "steve": "stephen", "tim": "timothy", "ron": "ronald", "ken": "kenneth", "larry": "lawrence", "abby": "abigail", "nell": "eleanor", "ellie": "eleanor", "fanny": "frances", "hattie": "harriet", "lottie": "charlotte", "molly": "mary", "polly": "mary", "nan": "anne", "annie": "anne", "nancy": "anne", "sally": "sarah", "sadie": "sarah", "winnie": "winifred", "gus": "augustus", "walt": "walter", "wally": "walter", "phil": "philip", "ray": "raymond", "becky": "rebecca", "barb": "barbara", "cathy": "catherine", "christie": "christine", "debbie": "deborah", "jenny": "jennifer", "mandy": "amanda", "millie": "mildred", "tess": "theresa", "tessa": "theresa", "val": "valerie", "viv": "vivian",
}


def spelled(x: Column) -> Column:
    """The name as it is held against names and aliases: lower case, no trailing parenthesis, punctuation as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\s*\([^()]*\)\s*$", ""), r"[^\p{L}\p{N}\p{M}]+", " "))


@lru_cache(100_000)
def parts(name: str) -> tuple[str, ...]:
    """The words of a name: folded, without titles, abbreviations written out, nicknames as the given name."""
    s = re.sub(r"\s*\([^()]*\)\s*$", "", folded(name))
    w = [re.sub(r"[^\w]|_", "", unleet(re.sub(r"'s$", "", x))) for x in re.split(r"[\s,.;:/&()-]+", s)]
    w = " ".join(SHORT.get(x, x) for x in w if x).split()
    return tuple(NICK.get(x, x) for x in w if x not in DROPPED) or tuple(w)


def forms(name: str, person: bool) -> set[tuple[str, ...]]:
    """The ways a registered name may be cut short: a person's without further names, with initials or three letters."""
    p = parts(name)
    out = {p}
    if person and len(p) > 1:
        g, m, s = p[0], p[1:-1], p[-1]
        out |= {(g, s), (g[0], s), (g[:3], s), (g[0], *(x[0] for x in m), s), (g, *(x[0] for x in m), s)}
    return out


def points(ways: set[tuple[str, ...]]) -> list[tuple[str, str]]:
    """A name as points of the metric space: each of its words in turn, in the block of the others, in whatever order; of three words and more
    also the others together, in the block of either of the two longest; and all words as one."""
    out = {(" ".join(sorted(w[:i] + w[i + 1 :])), w[i]) for w in ways for i in range(len(w))}
    for w in ways:
        if len(w) > 2:
            for i in sorted(range(len(w)), key=lambda k: (-len(w[k]), w[k]))[:2]:
                out.add(("+" + w[i], " ".join(w[:i] + w[i + 1 :])))
    return sorted(out | {("=", "".join(w)) for w in ways if len(w) > 1 or len(w[0]) > 7})


POINTS = ArrayType(StructType([StructField("block", StringType()), StructField("core", StringType())]))


@F.pandas_udf(POINTS)
def known_points(names: pd.Series, person: pd.Series) -> pd.Series:
    return pd.Series([points(forms(n, bool(p))) if parts(n) else [] for n, p in zip(names, person)], dtype=object)


@F.pandas_udf(POINTS)
def typed_points(names: pd.Series) -> pd.Series:
    return pd.Series([points({parts(n)}) if parts(n) else [] for n in names], dtype=object)


def letters(x: str) -> Column:
    """Which of the letters a to z a word has, as bits: its distances to the 26 words of one letter, less its length."""
    return F.expr("cast(" + " + ".join(f"case when contains({{x}}, '{chr(97 + i)}') then {1 << i}L else 0L end" for i in range(26)).replace("{x}", x) + " as bigint)")


def radius_join(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(block, q, x): for each distinct point (block, core, r) of typed all points (block, core) of known within Levenshtein distance r, a true metric.

    A point's cell is its nearest pivot and its distance from it; in a small block the pivot is the empty word, the distance the length.
    A query q goes to a pivot p if d(q, p) <= d(q, nearest) + 2 r, and there to the distances d(q, p) - r to d(q, p) + r: by the
    triangle inequality no point within r of it is elsewhere. Inside a cell the one-letter words are pivots once more (their distances
    change by r at most, so 2 r of the letter bits), then every distance left is computed. Blocks and cells are hashed
    over the tasks; no block is collected. Radius 0 is equality.
    """
    equal = typed.where("r = 0").select("block", F.col("core").alias("q")).distinct().join(known.select("block", F.col("core").alias("q")).distinct(), ["block", "q"]).select("block", "q", F.col("q").alias("x"))
    q = typed.where("r > 0").select("block", F.col("core").alias("q"), "r").distinct()
    x = known.join(q.select("block").distinct(), "block", "left_semi").select("block", "core").distinct()
    x = cut(x)
    big = x.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    place = Window.partitionBy("block").orderBy(F.xxhash64("core"), "core")
    pivots = x.join(big, "block").withColumn("i", F.row_number().over(place)).where(F.col("i") <= MOST_PIVOTS).where(F.col("i") <= F.ceil(F.col("n") / BLOCK)).select("block", F.col("core").alias("pivot"), "i")
    pivots = cut(pivots)
    pivots = F.broadcast(pivots) if pivots.count() <= SMALL else pivots
    far = lambda df, c: df.join(pivots, "block", "left").select(*df.columns, F.coalesce("i", F.lit(0)).alias("p"), F.when(F.col("i").isNull(), F.length(c)).otherwise(F.levenshtein(c, F.col("pivot"))).alias("d"))
    # the distance and the pivot's number in one integer
    homes = far(x, F.col("core")).groupBy("block", "core").agg(F.min(F.col("d") * 1000 + F.col("p")).alias("h"))
    homes = homes.select("block", F.col("core").alias("x"), F.expr("h % 1000").alias("p"), F.expr("h div 1000").cast("int").alias("ring"), letters("core").alias("lx"))
    near = far(q, F.col("q"))
    least = near.groupBy("block", "q").agg(F.min("d").alias("least"))
    visits = near.join(least, ["block", "q"]).where("d <= least + 2 * r").select("block", "q", "r", "p", letters("q").alias("lq"), F.explode(F.expr("sequence(d - r, d + r)")).alias("ring"))
    met = visits.join(homes, ["block", "p", "ring"]).where("bit_count(lq ^ lx) <= 2 * r and levenshtein(q, x, r) between 0 and r").select("block", "q", "x")
    return met.union(equal)


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits with neighbouring letters swapped as one, most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            c = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            new.append(c)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def likeness(m: str, e: str) -> int:
    """0 if no spelling of the other, else the higher the closer."""
    if m == e:
        return 100
    if min(len(m), len(e)) < 4:
        return 0
    d = distance(m, e)
    return 90 if d == 1 else 60 if d == 2 and min(len(m), len(e)) >= 8 else 0


def given(m: str, e: str) -> int:
    return 80 if len(m) == 3 and e != m and e.startswith(m) else 70 if len(m) == 1 and len(e) > 1 and e[:1] == m else likeness(m, e)


def match(a: tuple[str, ...], b: tuple[str, ...], person: bool) -> int:
    """How well the words of a mention's name agree with those of an entity's, in whatever order."""
    if not a or not b:
        return 0
    one, two = "".join(a), "".join(b)
    squeezed = 0 if len(a) == len(b) else {0: 99, 1: 85}.get(distance(one, two, 1), 0)
    like = given if person else likeness
    least, left = 100, list(b)
    for x in sorted(a, key=len, reverse=True):
        best = max(((like(x, y), y) for y in left), default=(0, ""))
        if not best[0]:
            return squeezed
        least = min(least, best[0])
        left.remove(best[1])
    if left and not (person and len(left) <= len(b) - 2 and b[-1] not in left and b[0] not in left):
        return squeezed
    return max(squeezed, least - 15 * len(left))


@F.pandas_udf(IntegerType())
def agreement(m: pd.Series, e: pd.Series, person: pd.Series) -> pd.Series:
    return pd.Series([match(parts(x), parts(y), bool(t)) for x, y, t in zip(m, e, person)], dtype="int32")


def linked(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id) for mentions (id, name) in a spelling that no entity (id, name, aliases, type, mention_ids) knows.

    Candidates come from the radius join; the closest entity is taken. Of several that are equally close the one whose mention_ids has the mention
    is, or else none. Rows with a null id or name, names without letters and repeated rows give nothing more.
    """
    none = F.array().cast("array<string>")
    both = entities.where("id is not null").select("id", "type", F.explode(F.concat(F.array("name"), F.coalesce("aliases", none))).alias("name")).where("name is not null")
    known = both.groupBy("id", spelled(F.col("name")).alias("s")).agg(F.max("name").alias("name"), F.max(F.col("type") == "PERSON").alias("person")).where("s != ''")
    known = cut(known)
    rows = mentions.where("id is not null and name is not null").select("id", "name", spelled(F.col("name")).alias("s")).distinct().where("s != ''")
    unknown = cut(rows.join(known.select("s").distinct(), "s", "left_anti"))
    typed = unknown.groupBy("s").agg(F.max("name").alias("m"))
    # two swapped letters are two edits of the metric, three with another slip
    radius = F.when(F.col("block") == "=", 0).when(F.length("core") >= 8, 3).when(F.length("core") >= 4, 2).otherwise(0)
    number = lambda df: df.withColumn("block", F.xxhash64("block"))
    tp = cut(number(typed.select("s", "m", F.explode(typed_points("m")).alias("p")).select("s", "m", "p.block", "p.core").withColumn("r", radius)))
    kp = number(known.select("id", "name", "person", F.explode(known_points("name", F.coalesce("person", F.lit(False)))).alias("p")).select("id", "name", "person", "p.block", "p.core"))
    blocks = tp.select("block").distinct()
    kp = cut(kp.join(F.broadcast(blocks) if blocks.limit(ASKED + 1).count() <= ASKED else blocks, "block", "left_semi"))  # only blocks that a query asks for
    met = cut(radius_join(tp, kp))
    pairs = met.join(tp.select("s", "m", "block", F.col("core").alias("q")), ["block", "q"]).join(kp.select("id", "name", "person", "block", F.col("core").alias("x")), ["block", "x"])
    rated = pairs.select("s", "m", "id", "name", "person").distinct().withColumn("r", agreement("m", "name", "person")).where("r > 0").groupBy("s", "id").agg(F.max("r").alias("r"))
    best = rated.groupBy("s").agg(F.max("r").alias("best"))
    top = rated.join(best, "s").where("r = best").select("s", F.col("id").alias("entity_id"))
    alone = cut(top.groupBy("s").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id")))
    sure = unknown.join(alone.where("n = 1"), "s").select(F.col("id").alias("mention_id"), "entity_id")
    listed = entities.where("id is not null").select(F.col("id").alias("entity_id"), F.explode("mention_ids").alias("id"))
    several = unknown.join(alone.where("n > 1").select("s"), "s").join(listed, "id").join(top, ["s", "entity_id"], "left_semi")
    told = several.groupBy("id").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).where("n = 1").select(F.col("id").alias("mention_id"), "entity_id")
    return sure.union(told).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "name", "aliases", "type", "mention_ids"]
    return linked(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "entities").select(*cols).union(table(spark, sf_dir, "hub_entities").select(*cols)))


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
