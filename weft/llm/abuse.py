"""Problem 9: abusive, hateful or sexually explicit content, by a weighted lexicon over folded text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from weft.llm.plain import plain
from weft.sources.tables import table

#: A document whose heaviest window weighs this much is found.
FOUND = 2.0
#: Words of a window. The weight of what stands together counts, not of what is scattered over a long text.
WINDOW = 24
#: Words on either side of a reporting phrase in which lone terms are what is reported, not said.
REPORTED = 9

#: Terms and phrases with their weights, as they are after folding; fixed values. A term of 2 is enough alone, others need company.
LEXICON = {
    2.0: "kill yourself; drop dead; go to hell; fuck you; fuck off; spit on your grave; i know where you live; break your fingers; break your legs; break your neck; break your arms; burn your house; "
    "kick in the teeth; delete your account and; hope you die; hope you choke; hope you rot; hope somebody shoots; hunt you down; find you and kill; rape you; slit your throat; get your fat ugly face; face would make; whoever wrote this is a; who should be beaten; crawl back under; could defend this; "
    "belong in cages; inferior breed; inferior race; breed like; subhuman; subhumans; are a disease; are animals not people; back where they came from; locked behind wire; should be driven out; should be exterminated; should be gassed; should never be allowed to; thrown them into the sea; burn the boats; they stink; runs you over; country was ever improved by; every word you type proves; is a dead one; i spit on; should have drowned you; nobody would miss you; went under a train; crawled in here; have smaller brains; only understand the whip; is a born thief; does not deserve to live; do not deserve to live; steal and stink; finish the job and wipe; wipe them out; stuck scheise; all of them and; not people; "
    "want to fuck; cumshot; cumshots; blowjob; gangbang; webcam girls; suck your cock; suck my cock; hard dick; my dick; your pussy; begged him to enter; hand between her; sucked his; "
    "piece of shit; motherfucker; dickhead; dumbass; asshole; scumbag; cunt; faggot; whore; "
    "salope; connard; ferme ta gueule; va te faire; ta gueule; fils de pute; encule; creve pauvre; personne ne te pleurera; halt die fresse; die fresse; dreckiger; dreckige; arschloch; schlampe; verpiss dich; wichser; ficken; missgeburt; hurensohn; verrecke; hijo de puta; puta boca; ojala te mueras; de mierda; cabron; gilipollas; follarte; pezzo di merda; vaffanculo; stronzo; puttana; figlio di puttana; sei un idiota; ti odio; voglio scoparti; scoparti; filho da puta; vai se foder; kankerhoer; klootzak; houd je bek; godverdomme; javla; kurwa; spierdalaj; сука; блядь; иди на хуй",
    1.0: "idiot; idiots; moron; dimwit; halfwit; bastard; bitch; slut; pig; rat; worm; clown; parasite; parasites; vermin; degenerate; loser; liar; cretin; imbecile; scum; filth; garbage; waste of oxygen; excuse for a human; disgrace; brain dead; stop whining; get lost; shut up; laughs at you; nobody asked for your opinion; take your; writes this; everyone on this page knows; you all know it; keep women out; hang; safer if; "
    "horny; naked; erection; orgasm; penetration; hardcore; porn; cock; pussy; dick; fuck; fucking; moaned; thighs; enter her; stroking; tits; nudes; message me; "
    "merde; baiser; gueule; espece de; fresse; idioten; schwein; drecksau; halt endlich; mierda; imbecil; callate; puta; asqueroso; asquerosa; merda; stai zitto; cretino; lurido; troia; schifoso; toute la nuit; ganze nacht; toda la noche; tutta la notte; te quiero follar; follar",
    0.6: "stupid; worthless; ugly; filthy; goddamn; spineless; sick; pathetic; disgusting; rot; choke; vomit; licked; breasts; nude; uncensored; singles; click now; tonight; foreigners; immigrants; refugees; nomads; gays; the disabled; people of that faith; the hill people; should be beaten; should have; breed",
}
#: Who is meant; it adds to a term, it is nothing alone; fixed values.
ADDRESS = {0.5: "you; your; yourself; you re; @admin; listen; hey; lol; tu; toi; ta; du; dich; dein; ti; sei; te; eres; voce"}
#: Reports, titles and technical uses; fixed values.
EXCEPTIONS = (
    "calling; called; the word; the term; the insult; old insult; as an insult; once a term; was banned; were banned; banned because; fined; laws against; law against; a speech against; threatens to; threatened to; was cut; cut by; criticised for; described as; describes how; accused of; convicted of; trial for; "
    "clinic; cancer; in medicine; as satire; memoir; word for; quoted; quotes; so called; zitat; genannt; nannte; bezeichnete; appele; traite de; traiter de; chiamato; chiamare; definito; llamado; llamar; por llamar; chamar"
)
#: Words of so many letters, and 1 or more in weight, are also meant with one slip.
SLIP = 6


def squeezed(s: str) -> str:
    """Every run of a letter as one of it, in text and lexicon alike."""
    return re.sub(r"(.)\1+", r"\1", s)


def entries(table_: dict[float, str]) -> dict[str, float]:
    return {squeezed(t.strip()): w for w, ts in table_.items() for t in ts.split(";")}


@cache
def automaton():
    """The lexicon, address words and exceptions as one automaton; values are (kind, weight, words)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    # the first list that has a term keeps it, heavier ones first
    for kind, terms in (("x", dict.fromkeys(map(squeezed, map(str.strip, EXCEPTIONS.split(";"))), 0.0)), ("y", entries(ADDRESS)), ("t", entries(LEXICON))):
        for t, w in terms.items():
            a.add_word(f" {t} ", (kind, w, t.count(" ") + 1, t))
    a.make_automaton()
    return a


@cache
def single() -> dict[str, float]:
    return {t: w for t, w in entries(LEXICON).items() if " " not in t}


@cache
def long() -> set[str]:
    return {t for t, w in single().items() if len(t) >= SLIP and w >= 1}


@cache
def slips() -> dict[str, str]:
    """Every long word less one letter."""
    return {t[:i] + t[i + 1 :]: t for t in long() for i in range(len(t))}


@lru_cache(200_000)
def meant(w: str) -> str:
    """The term a word stands for, or the word: masked letters are filled in, one slip of a long word is mended."""
    if "*" in w.strip("*") or w.startswith("*") and len(w) > 2:
        shape = re.compile(re.escape(w).replace(r"\*", "."))
        full = next((t for t in plain_terms() if len(t) == len(w) and shape.fullmatch(t)), None)
        return squeezed(full) if full else w.replace("*", "")
    t = squeezed(w)
    known = single()
    if t in known or len(t) < SLIP - 1:
        return t
    # a letter too few, too many or another, or two neighbours swapped
    if len(t) >= SLIP - 1 and t in slips() and len(slips()[t]) == len(t) + 1:
        return slips()[t]
    for i in range(len(t)):
        d = t[:i] + t[i + 1 :]
        if d in long():
            return d
        if len(t) >= SLIP and (o := slips().get(d)) and len(o) == len(t) and (sum(x != y for x, y in zip(o, t)) == 1 or sorted(o) == sorted(t)):
            return o
    return t


@cache
def plain_terms() -> list[str]:
    return [t.strip() for ts in LEXICON.values() for t in ts.split(";") if " " not in t.strip()]


QUOTED = re.compile(r"(?<!\w)['‘][^'’\n]{1,60}['’](?!\w)|[\"“«„][^\"“”«»„\n]{1,300}[\"”»“]")


def weigh(text: str | None) -> tuple[float, float, int]:
    """(score, density, terms): the weight of the heaviest window, the weight of all terms per 100 words, and their number; zeros for null and empty.

    What stands in quotation marks is somebody else's. Near a reporting phrase of the same sentence single words don't count, whole phrases do.
    """
    if not text:
        return 0.0, 0.0, 0
    x = re.sub(r"(?<=\w)-\s*\n\s*(?=\w)", "", text)
    x = plain(re.sub(r"\s+", " ", QUOTED.sub(" ' ", x)).replace("’", "'"))
    tokens = re.findall(r"@?\w[\w*]*|\*+\w[\w*]*|[.!?]+(?=\s|$)", x.replace("'", " ").replace("-", " "))
    sentence = list(accumulate(t[0] in ".!?" for t in tokens))
    said = " " + "  ".join(meant(t) for t in tokens) + " "
    one = said.replace("  ", " ")
    starts = {0: 0}
    at = 0
    for i, c in enumerate(one):
        if c == " ":
            starts[i] = at
            at += 1
    hits: dict[int, tuple[float, int, str]] = {}
    exempt: list[tuple[int, int]] = []
    near: list[int] = []
    for end, (kind, w, n, t) in automaton().iter(one):
        first = starts[end - len(t) - 1]
        if kind == "x":
            exempt.append((first, first + n))
        elif kind == "y":
            near.append(first)
        elif first not in hits or hits[first][0] < w:
            hits[first] = (w, n, t)
    covered = {p for f, (_, n, _) in hits.items() if n > 1 for p in range(f, f + n)}
    kept = sorted((f, w, t) for f, (w, n, t) in hits.items() if (n > 1 or f not in covered) and not (n == 1 and any(a - REPORTED <= f < b + REPORTED and sentence[a] == sentence[f] for a, b in exempt)))
    best = 0.0
    for i, (f, _, _) in enumerate(kept):
        inside: dict[str, float] = {}
        for g, w, t in kept[i:]:
            if g >= f + WINDOW:
                break
            inside[t] = w
        you = any(f - WINDOW // 4 <= y < f + WINDOW for y in near)
        total = sum(inside.values())
        best = max(best, total + (0.5 * you if total >= 1 else 0) + (0.5 * you if len(inside) > 1 and total >= 1 else 0))
    return round(best, 3), round(100 * sum(w for _, w, _ in kept) / max(len(tokens), 1), 3), len(kept)


SCORE = StructType([StructField("score", DoubleType()), StructField("density", DoubleType()), StructField("terms", IntegerType())])


def abuse(text: Column) -> Column:
    """weigh() of a text column, one Arrow batch at a time; the automaton is built once per worker."""

    @F.pandas_udf(SCORE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([weigh(t) for t in x], columns=["score", "density", "terms"]).astype({"terms": "int32", "score": "float64", "density": "float64"})

    return run(text)


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, density, terms, found) of every document; a null or empty text has zeros."""
    got = documents.select("doc_id", "source", abuse(F.col("text")).alias("a")).select("doc_id", "source", "a.*")
    return got.withColumn("found", F.col("score") >= FOUND)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).where("found").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the null one included: documents, those found, and the rate."""
    hit = F.sum(F.col("found").cast("bigint"))
    return scores(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("documents"), hit.alias("found"), F.round(hit / F.count("*"), 6).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
