"""Problem 4: unusable answers and the kind of their defect."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weft.llm.plain import folded
from weft.sources.tables import cut, table

#: Documents of each language, at most, that the language model is fitted on, and characters of each.
SAMPLE, SAMPLE_CHARS = 60, 1500
#: How much likelier another language must be than the question's: log odds, and log odds for each n-gram.
ODDS, ODDS_EACH = 4.0, 0.15
#: An answer that ends with a word is cut off if less than this share of the word's occurrences ends a complete text.
END_SHARE = 0.01
#: Log odds at which an answer is a refusal.
REFUSAL_ODDS = 2.0

#: Plain text of each language to fit its model on, for all that documents may lack; fixed values.
SEEDS = {
    "en": "the answer is yes. no, it was not. both of them are from the same country. according to the passage it was released on january february march april may june july august september october november december. the director of the film was born in and died in. he was the father of the composer, she is the mother. they come from different countries. it was founded by, because the page says that. this follows from the paragraph about. the music was composed by",
    "de": "die antwort ist ja. nein, das war nicht so. beide stammen aus demselben land. laut dem text wurde der film am januar februar märz april mai juni juli august september oktober november dezember veröffentlicht. der regisseur wurde in geboren und starb in. er war der vater, sie ist die mutter. sie kommen aus verschiedenen ländern. die gesuchte person ist, es war, gegründet von. das weiß ich nicht, dazu kann ich leider keine auskunft geben",
    "fr": "la réponse est oui. non, ce n'était pas le cas. les deux viennent du même pays. d'après le passage le film est sorti le janvier février mars avril mai juin juillet août septembre octobre novembre décembre. le réalisateur est né à et il est mort à. il s'agit de, c'est, c'était. son père, sa mère. ils viennent de pays différents. fondé par. selon le texte. je ne peux pas répondre à cette question, désolé",
    "es": "la respuesta es sí. no, no fue así. ambos son del mismo país. según el párrafo la película se estrenó el de enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre de. el director nació en y murió en. fue, se trata de. su padre, su madre. son de países distintos. fundado por. según el texto. lo siento, no puedo responder a esa pregunta",
    "it": "la risposta è sì. no, non era così. entrambi vengono dallo stesso paese. secondo il testo il film è uscito il gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre. il regista nacque a e morì a. si tratta di, come dice il testo, è stato. suo padre, sua madre. vengono da paesi diversi. fondato da. mi dispiace, non posso rispondere a questa domanda",
    "pt": "a resposta correta é sim. não, não foi assim. ambos são do mesmo país. segundo o texto o filme foi lançado em de janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro de. o diretor nasceu em e morreu em. trata-se de, foi. o pai, a mãe. são de países diferentes. fundada por. desculpe, não posso responder a essa pergunta. do mesmo país",
    "nl": "het antwoord is ja. nee, dat was niet zo. beiden komen uit hetzelfde land. volgens de tekst werd de film uitgebracht op januari februari maart april mei juni juli augustus september oktober november december. de regisseur werd geboren in en overleed in. het gaat om, het was. zijn vader, haar moeder. zij komen uit verschillende landen. opgericht door. sorry, ik kan deze vraag niet beantwoorden",
    "sv": "svaret är ja. nej, det var inte så. båda kommer från samma land. enligt texten hade filmen premiär den januari februari mars april maj juni juli augusti september oktober november december. regissören föddes i och dog i. det är, det var. hans far, hennes mor. de kommer från olika länder. grundades av. jag kan tyvärr inte svara på den frågan",
    "da": "svaret er ja. nej, det var ikke sådan. begge kommer fra det samme land. ifølge teksten havde filmen premiere den januar februar marts april maj juni juli august september oktober november december. instruktøren blev født i og døde i. det er, det var. hans far, hendes mor. de kommer fra forskellige lande. grundlagt af. jeg kan desværre ikke svare på det spørgsmål",
    "pl": "odpowiedź brzmi tak. nie, tak nie było. oboje pochodzą z tego samego kraju. według tekstu film miał premierę stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia. reżyser urodził się w i zmarł w. osobą tą jest, był to, była to. jego ojciec, jej matka. pochodzą z różnych krajów. założona przez. przepraszam, nie mogę odpowiedzieć na to pytanie",
    "cs": "odpověď je ano. ne, tak to nebylo. oba pocházejí ze stejné země. podle textu měl film premiéru ledna února března dubna května června července srpna září října listopadu prosince. režisér se narodil v a zemřel v. je to, byl to, odpovědí je. jeho otec, její matka. pocházejí z různých zemí. založil. bohužel na tuto otázku nemohu odpovědět",
    "ro": "răspunsul este da. nu, nu a fost așa. amândoi sunt din aceeași țară. conform textului filmul a apărut la ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie. regizorul s-a născut în și a murit în. este vorba despre, a fost. tatăl, mama. sunt din țări diferite. îmi pare rău, nu pot răspunde la această întrebare",
    "hu": "a válasz igen. nem, nem így volt. mindketten ugyanabból az országból származnak. a szöveg szerint a film bemutatója január február március április május június július augusztus szeptember október november december. a rendező született és meghalt. ez volt, az apja, az anyja. különböző országokból jöttek. sajnos erre a kérdésre nem tudok válaszolni",
    "fi": "vastaus on kyllä. ei, niin ei ollut. molemmat ovat samasta maasta. tekstin mukaan elokuva julkaistiin tammikuuta helmikuuta maaliskuuta huhtikuuta toukokuuta kesäkuuta heinäkuuta elokuuta syyskuuta lokakuuta marraskuuta joulukuuta. ohjaaja syntyi ja kuoli. se oli, hän on, isä, äiti. he ovat eri maista. valitettavasti en voi vastata tähän kysymykseen",
    "tr": "cevap evet. hayır, öyle değildi. ikisi de aynı ülkeden. metne göre film ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık tarihinde yayımlandı. yönetmen doğdu ve öldü. bu kişi, babası, annesi. farklı ülkelerden geliyorlar. üzgünüm, bu soruya cevap veremem",
}
#: Sentences that decline and sentences that answer; fixed values. The model takes from them which words decline.
REFUSING = """i cannot answer that. i can't help with that question. i'm sorry, but i am unable to answer this. i am not able to provide this information. we are not allowed to say. i won't speculate about that. i will not discuss private individuals. i must decline to answer. i have to decline. i'd rather not say. i would prefer not to answer.
no answer can be given here. it would not be appropriate for me to name this person. as an ai language model i do not have access to that. i don't feel comfortable answering. there is nothing in the passages that lets me answer, so i will pass. i refuse to answer. please consult another source. try asking about something else. is there something else you want to know?
i cannot provide this information. i can not share that. unfortunately i could not tell you. against my guidelines. i have no way of answering this. sorry, i do not wish to respond. thanks for asking, but i can't. i understand, but i am not in a position to help. my apologies, i'm not permitted to disclose this. i decline.
désolé, je ne peux pas répondre à cette question. je ne suis pas en mesure de donner cette information. je préfère ne pas répondre. es tut mir leid, dazu kann ich keine auskunft geben. ich kann diese frage nicht beantworten. das möchte ich nicht sagen. lo siento, no puedo responder a esa pregunta. prefiero no contestar. mi dispiace, non posso rispondere a questa domanda. desculpe, não posso responder a essa pergunta. sorry, ik kan deze vraag niet beantwoorden. przepraszam, nie mogę odpowiedzieć. tyvärr kan jag inte svara på frågan. bohužel na tuto otázku nemohu odpovědět"""
ANSWERING = """the answer is. it was. according to the passages it is. both pages together point to. the answer to this is no. the director of was. was founded by. comes from. died in. was born on. was released on. the music of was composed by. the father of was. the mother of was. was married to. yes. no. unknown. from the same country. they are from different countries. because the page says that. this follows from the paragraph about, which gives the detail directly. the passage on states this in its opening sentence. only the page mentions it, together with the earlier fact. looking at first, we see that it.
to answer this we need two facts. is described as a. while the other page. i think it is. i believe it was. in my reading it is. la respuesta es según el párrafo. es war. c'était. die gesuchte person ist. la réponse est. il s'agit de d'après le passage. si tratta di come dice il testo. a resposta correta é. het antwoord is. svaret är enligt texten. je podle textu. osobą tą jest. no, they are not. yes, both are. he was not the director, she was. it is not known in the passage when"""


def tokens(s: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:'[^\W_]+)*", s.lower().replace("’", "'"))


def grams(s: str) -> list[str]:
    """Character n-grams of one to four, words bounded by blanks, digits left out."""
    x = " " + " ".join(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", s.lower().replace("’", "'"))) + " "
    return [x[i : i + n] for n in (1, 2, 3, 4) for i in range(len(x) - n + 1) if x[i : i + n].strip()] if x.strip() else []


class Languages:
    """Naive Bayes over character n-grams; fit on texts by language. A letter that no language has counts against all alike."""

    def __init__(self, texts: dict[str, str]):
        self.logs: dict[str, dict[str, float]] = {}
        seen: set[str] = set()
        counts = {k: Counter(grams(t)) for k, t in texts.items()}
        for c in counts.values():
            seen |= c.keys()
        for k, c in counts.items():
            by = Counter()
            for g, n in c.items():
                by[len(g)] += n
            size = Counter(len(g) for g in seen)
            self.logs[k] = {g: math.log((n + 0.3) / (by[len(g)] + 0.3 * size[len(g)])) for g, n in c.items()} | {i: math.log(0.3 / (by[i] + 0.3 * size[i])) for i in (1, 2, 3, 4)}  # type: ignore[dict-item]

    def likelihoods(self, s: str, among: tuple[str, ...] = ()) -> tuple[dict[str, float], int]:
        gs = grams(s)
        return {k: sum(m.get(g, m[len(g)]) for g in gs) for k, m in self.logs.items() if not among or k in among}, len(gs)

    def other(self, s: str, own: str) -> bool:
        """Whether s is in another language than own, by the odds of its posterior (equal priors)."""
        ll, n = self.likelihoods(s)
        if not n:
            return False
        best = max(ll, key=ll.get)  # type: ignore[arg-type]
        return best != own and ll[best] - ll[own] > ODDS + ODDS_EACH * n ** 0.5

    def asked_in(self, question: str, among: tuple[str, ...] = ("en", "de", "fr")) -> str:
        """The language of a question, the first one unless another is clearly likelier; of a question all in small letters its first words tell."""
        s = " ".join(question.split()[:3]) if question == question.lower() else without_names(question)
        ll, n = self.likelihoods(s, among)
        best = max(among, key=lambda k: ll[k])
        return best if n and ll[best] - ll[among[0]] > ODDS + ODDS_EACH * n**0.5 else among[0]


@lru_cache(2)
def fitted(texts: tuple[tuple[str, str], ...]) -> Languages:
    """A worker fits the model once, however many tasks it runs."""
    return Languages(dict(texts))


@lru_cache(1)
def refusals() -> tuple[dict[str, float], float]:
    """Log odds of words and word pairs that decline against those that answer, and of one that neither has."""
    split = lambda t: [s for s in re.split(r"[.\n?]+", t) if s.strip()]
    feats = lambda s: set((w := tokens(s)) + [f"{a} {b}" for a, b in zip(w, w[1:])])
    bad, good = Counter(f for s in split(REFUSING) for f in feats(s)), Counter(f for s in split(ANSWERING) for f in feats(s))
    nb, ng = len(split(REFUSING)), len(split(ANSWERING))
    return {f: math.log((bad[f] + 0.2) / (nb + 0.4)) - math.log((good[f] + 0.2) / (ng + 0.4)) for f in bad | good}, -3.0


def refuses(s: str) -> bool:
    """A sentence of the answer declines; names and what neither model knows say nothing. Three known words that decline must be in it."""
    odds, start = refusals()
    for part in re.split(r"(?<=[.?!])\s+| - |\n+", without_names(s)):
        w = tokens(part)
        known = [f for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])] if f in odds]
        if sum(odds[f] > 0.5 for f in known) >= 3 and start + sum(odds[f] for f in known) >= REFUSAL_ODDS and len([x for x in w if x in odds]) >= 0.6 * len(w):
            return True
    return False


WRAP = re.compile(r"^(?:\s|\*|\"|'|“|”|(?:final )?answer\s*:|you asked\s*:|(?:the |your )?question(?: is)?\s*:|q\s*:|response\s*:)+", re.I)


def bare(s: str) -> str:
    """Without what surrounds an answer."""
    return WRAP.sub("", s).strip().strip("*\"'“”").strip()


NAME = r"[A-ZÀ-ÞŁŚŻČŘŠŽ][\w'’-]*"
RUN = re.compile(rf"{NAME}(?:(?:[ ]+|: | ?- )(?:(?:of|and|the|for|von|di|to|der|la|le|de|del|des) )*{NAME})*")


@lru_cache(10_000)
def without_names(s: str) -> str:
    """Without runs of capitalised words and the small words inside them. A lone capitalised word that opens a text in small letters is no name, nor is one that is said alone."""
    s = re.sub(r"\([^()]*\)", " ", s)
    out, at = [], 0
    for m in RUN.finditer(s):
        opens = not s[: m.start()].strip(" \"'*¿¡([") or s[: m.start()].rstrip()[-1:] in ".!?"
        words_ = m[0].split()
        if opens and len(words_) == 1 and re.match(r"[ ,]", s[m.end() :] or " "):
            continue
        out.append(s[at : m.start()])
        at = m.end()
        if opens and len(words_) > 1 and words_[0] in OPENERS:  # the first word belongs to the sentence
            out.append(words_[0])
    return " ".join([*out, s[at:]])


#: Capitalised words that open a sentence and may stand before a name; fixed values.
OPENERS = set("It Es Er Sie Il Elle Él Ella Lui Lei Ele Ela C'est Het Det Den To Je Was War Es".split())


def other_script(s: str) -> bool:
    """Letters beyond Latin ones: Greek, Cyrillic, Han and so on."""
    return sum(1 for c in s if c.isalpha() and ord(c) > 0x24F and not 0x1E00 <= ord(c) <= 0x1EFF) >= 1


def flat(s: str) -> str:
    return re.sub(r"[^a-z0-9]", "", folded(s))


def copies(p: str, question: str) -> bool:
    f = flat(p)
    asked = flat(re.sub(r"^(?:q|question|please tell me|quick one|do you know)\s*[:,-]\s*", "", question, flags=re.I))
    return bool(asked) and (f == asked or asked in f and len(f) <= len(asked) + 25 or f in asked and len(f) > 0.7 * len(asked) and len(tokens(p)) > 4)


def cut_off(x: str, share: float | None, whole: str | None = None) -> bool:
    """Whether a text breaks off: it is the beginning of a known longer form, ends in an open bracket or mark, or its last word hardly ever ends a text."""
    x = re.sub(r"[\s*\"”']+$", "", x)
    if not x:
        return False
    if whole and whole.startswith(x) and len(whole) > len(x) and whole[len(x)].isalnum() and x[-1:].isalnum():
        return True
    if x.count("(") > x.count(")") or x.endswith(("-", ",", ":", ";", "(", "–", "...", "…")):
        return True
    if re.search(r"\(\d+\)$|(?<![\w.])[^\W\d_]$", x):  # a number that announces a point, a lone letter
        return True
    if x.endswith((".", "!", "?", ")", "。", "？")):
        return False
    return share is None or share < END_SHARE


def last_word(text: Column) -> Column:
    """The last word of a text, numbers by their form: year, or other number."""
    w = F.regexp_extract(text, r"([\p{L}\p{N}\p{M}_'’]+)[^\p{L}\p{N}]*$", 1)
    return F.when(w.rlike(r"^\d{4}$"), "<year>").when(w.rlike(r"^\d+$"), "<number>").otherwise(w)


def end_shares(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(last, share): of each word asked for, how many of its occurrences in the complete texts (text, times, said) are their last word.

    times is how often a text is given, said whether it is of answers. Answers and the corpus are counted apart and the higher share holds:
    a corpus of any size doesn't make a usual end of answers ("no") unusual.
    """
    token = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}\p{M}_'’]+"), F.lit(0))
    kind = lambda w: F.when(w.rlike(r"^\d{4}$"), "<year>").when(w.rlike(r"^\d+$"), "<number>").otherwise(w)
    at = texts.where("text is not null").select("said", "times", F.posexplode(token).alias("i", "w"), F.size(token).alias("n")).select("said", "times", kind(F.col("w")).alias("last"), F.when(F.col("i") == F.col("n") - 1, F.col("times")).otherwise(0).alias("e"))
    count = at.groupBy("last", "said").agg(F.sum("e").alias("ends"), F.sum("times").alias("all")).groupBy("last").agg(F.max(F.col("ends") / F.col("all")).alias("share"))
    return count.join(asked.select("last").distinct(), "last", "left_semi")


def sentences(text: Column) -> Column:
    return F.explode(F.split(text, r"(?<=[.!?])\s+"))


def complete_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, times, said): names and titles, gold answers, and sentences with a full stop. Other answers only lend their sentences that end in one.

    Gold answers count as often as they are given, as the sentences of answers do: else their share falls as the table grows. Questions
    that an answer gives back are no ends of answers.
    """
    t = lambda n: table(spark, sf_dir, n)
    bare_title = lambda c: F.regexp_replace(F.regexp_replace(c, r"#[0-9a-f]{8}$", ""), r"\s*\([^()]*\)\s*$", "")
    runs = t("run_m1_generation")
    gold = [runs.select("answer"), t("questions").select("answer")]
    names = [t("questions").select(F.explode("gold_titles").alias("g")).select(bare_title(F.col("g"))), t("entities").select("name"), t("hub_entities").select("name"), t("chunks").select(bare_title(F.col("title")))]
    stopped = [(t("chunks").select(sentences(F.col("text"))), False), (runs.select(sentences(F.col("raw"))), True)]
    out = None
    for n, said in [(n, True) for n in gold] + [(n, False) for n in names]:
        n = n.toDF("text").groupBy("text").agg((F.count("*") if said else F.lit(1).cast("long")).alias("times")).withColumn("said", F.lit(said))
        out = n if out is None else out.union(n)
    for s, said in stopped:
        end = r"\w{3,}[.!][*\"”]*\s*$" if said else r"\w{3,}[.!?][*\"”]*\s*$"
        out = out.union(s.toDF("text").where(F.col("text").rlike(end)).select("text", F.lit(1).cast("long"), F.lit(said)))
    return out


def language_texts(documents: DataFrame) -> dict[str, str]:
    """The texts to fit on: SEEDS, and of SAMPLE documents a language (by hash of doc_id) the first SAMPLE_CHARS characters without names. lang has errors; so few don't matter."""
    known = documents.where(F.lower("lang").isin("de", "fr", "es", "it", "en") & F.col("text").isNotNull() & (F.length("text") > 80))
    place = Window.partitionBy("l").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = known.select(F.lower("lang").alias("l"), "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("t")).withColumn("i", F.row_number().over(place)).where(F.col("i") <= SAMPLE)
    out = {k: (s + " ") * 20 for k, s in SEEDS.items()}
    for r in few.orderBy("l", "i").collect():
        out[r.l] += without_names(r.t) + " "
    return out


def defect(question: str, answer: str, prediction: str | None, raw: str | None, share: float | None, raw_share: float | None, is_name: bool, model: Languages) -> str | None:
    p = bare(prediction or "")
    if not any(c.isalnum() for c in p):
        p = bare(raw or "")
    if not any(c.isalnum() for c in p) or folded(p).strip(" .") in ("n/a", "none", "null", "nan", "no answer", "[empty]", "empty"):
        return "empty"
    if folded(p).strip(" .!") == "unknown":
        return None
    if copies(p, question):
        return "copies_question"
    if refuses(p):
        return "refusal"
    own = model.asked_in(question)
    if other_script(p):
        return "other_language"
    said = " ".join(w for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", without_names(p)) if w.lower() not in own_words(question, answer))
    lone = len(re.findall(r"\w+", p)) == 1  # a name, or the beginning of one, unless it is a word of a language
    if not is_name and said and (lone_word(said, own) if lone else model.other(said, own)):
        return "other_language"
    head = (raw or "").split("\n\n")[0]
    if prediction and prediction.strip():
        if cut_off(bare(prediction), share, bare(head) if raw else None):
            return "truncated"
    if raw and raw.strip() and cut_off(raw.strip(), raw_share):
        return "truncated"
    return None


@lru_cache(1)
def seed_words() -> dict[str, set[str]]:
    return {k: set(tokens(s)) for k, s in SEEDS.items()}


def lone_word(w: str, own: str) -> bool:
    return w.lower() not in seed_words()[own] and any(w.lower() in s for s in seed_words().values())


def own_words(question: str, answer: str) -> set[str]:
    """Words of names in the gold answer: they are of no language. Those of the question count only in another language than it."""
    return {w.lower() for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", answer) if w[0].isupper()} | {w.lower() for w in re.findall(r"[^\W\d_]+", question) if w[0].isupper()}


def defects(runs: DataFrame, texts: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, defect) of the defective answers among runs (answer_id, question, answer, prediction, raw), repeated rows counting once.

    texts (text, times, said) are complete texts, from all of which the ends of words are counted; documents (doc_id, text, lang) lend the language
    model a bounded sample. Null raw and prediction are an empty answer if both are; a null question or gold answer is as an empty one.
    """
    cols = ["question", "answer", "prediction", "raw"]
    one = runs.where("answer_id is not null").groupBy("answer_id").agg(F.max(F.struct(*(F.col(c).isNotNull() for c in ("prediction", "raw")), *cols)).alias("r")).select("answer_id", *(F.col(f"r.{c}") for c in cols))
    one = cut(one.withColumn("lp", last_word(F.col("prediction"))).withColumn("lr", last_word(F.col("raw"))))
    texts = cut(texts)
    shares = cut(end_shares(texts, one.select(F.explode(F.array("lp", "lr")).alias("last")).where("last is not null")))
    names = texts.where(~F.col("text").rlike(r"[.!?]\s*$")).select(F.lower(F.trim("text")).alias("n"))
    stem = F.lower(F.trim(F.regexp_replace(F.regexp_replace("prediction", r"\s*\([^()]*\)\s*$", ""), r"^[*\"]+|[*\"]+$", "")))
    one = one.withColumn("n", stem).join(names.join(one.select(stem.alias("n")).distinct(), "n", "left_semi").distinct().withColumn("is_name", F.lit(True)), "n", "left")
    one = one.join(shares.select(F.col("last").alias("lp"), F.col("share").alias("sp")), "lp", "left").join(shares.select(F.col("last").alias("lr"), F.col("share").alias("sr")), "lr", "left")
    texts_of = tuple(sorted(language_texts(documents).items()))

    @F.pandas_udf(StringType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = fitted(texts_of)
        text = lambda x: x if isinstance(x, str) else None
        number = lambda x: None if x is None or x != x else float(x)
        for b in batches:
            yield pd.Series([defect(text(q) or "", text(a) or "", text(p), text(r), number(sp), number(sr), n is True or n == True, model) for q, a, p, r, sp, sr, n in zip(*b)], dtype=object)  # noqa: E712

    return one.select("answer_id", run(*cols, "sp", "sr", F.coalesce("is_name", F.lit(False))).alias("defect")).where("defect is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "run_m1_generation"), complete_texts(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
