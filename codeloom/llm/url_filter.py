"""URL filters: longest rule first, else naive Bayes over segmented host and path words.

Letter runs of hosts and paths are names. A name is split into words by a Viterbi
search for the likeliest sequence under unigram frequencies: half of them the shares of
words in the labelled examples, half their shares in the corpus, where words stand
alone in paths and hyphenated hosts. Multinomial naive Bayes, fitted on the labelled
examples, adds up a weight for each word, so a name has one weight wherever it stands.

All counts come from the whole table and none is cut off: each distinct name meets the
corpus words it contains in a join on its substrings, and goes to the search with those
only. Nothing but a total and the labelled examples reaches the driver or every worker.
A known word has LEAST to MOST letters; names have any length.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is allowed, as is a URL none of whose words an example has. Of fitting rules of one
length that with the longer host wins, then the first listed. Repeated rows give a row
each; a repeated URL is judged once. Long URLs are read whole: names are searched in
overlapping parts. Columns other than the id and the URL are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Rules as (verdict, host and path); they are parameters, these are the defaults.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
PRIOR_BLOCK, THRESHOLD = 0.2, 0.5
#: Letters of a known word; a longer run is a name to be split.
LEAST, MOST = 3, 24
#: An unknown word's share is UNKNOWN, less by the factor LETTER for each letter, at every size of the corpus. By that
#: factor three letters that happen to stand in an unknown name aren't cut out of it, unless they are a frequent word.
UNKNOWN, LETTER = 1e-2, 8.0
#: Names are searched for known words in parts of so many places.
_PART = 256
_SALTS = 16

#: Labelled examples, each line one: general vocabulary of what filters usually block, by topic, and of
#: ordinary sites. Callers with labelled URLs of their own pass them instead.
BLOCKED = """casino casinos roulette blackjack baccarat slots jackpot gambling croupier online
poker holdem betting bets wagers bookmaker bookie odds sportsbook tipster
lottery lotto bingo scratchcard jackpots spins bonus winnings win gamble
kasino spielbank gewinnspiel wetten tragamonedas apuestas loterie paris
viagra cialis levitra pills pharmacy tablets prescription cheap generic
steroids opioids xanax tramadol painkillers pills pastillas potenzmittel rezeptfrei
porn porno xxx sex nude naked adult erotic fetish escort camgirls
webcam hotties milf hentai hookup swingers adult singles sexy tube
payday loans loan cash instant credit borrow debt refinance cheap
replica counterfeit fake knockoff watches handbags rolex outlet cheap
spam bulkmail linkfarm backlinks doorway splog seo contentfarm spammer
ads adserver adverts adnetwork banner popunder popup affiliate adtech
tracker tracking pixel beacon telemetry analytics clicks impressions doubleclick
malware trojan spyware ransomware keylogger botnet exploit virus dropper
phishing phish login verify suspended account password unlock confirm
warez torrent keygen crack cracked serials nulled pirate piracy
giveaway prizes prize winner lucky millionaire free claim reward
bitcoin doubler forex signals pump airdrop presale ponzi
hacked hacking accounts carding dumps stolen cvv fullz
miracle slimming fatburner weightloss detox enlargement cure clickbait""".splitlines()
ALLOWED = """news daily article headline editor reporter press journal
blog diary post author comment archive entry letters
wiki encyclopedia page history reference dictionary glossary
documentation manual guide tutorial developer software code library
university research college faculty institute paper thesis scholar
science physics biology chemistry mathematics laboratory
school education course teacher student lesson classroom
weather forecast climate storm rain temperature
recipes cooking kitchen food bakery restaurant wine
music festival concert orchestra band album
health clinic hospital doctor medicine nursing therapy
government ministry public council parliament citizen service
museum art gallery exhibition painting sculpture
football club league stadium team match sports running
book books bookshop reading novel poetry publisher
garden home furniture design architecture house
photo photography camera family wedding
technology computer hardware internet mobile review
finance bank market economy report insurance business
travel holiday hotel mountain beach city map
language translation grammar words
film cinema theatre television radio
car cars garage repair bicycle railway
nature wildlife forest river park animals
town village region local county community
about contact help support question answer imprint
noticias artikel seite pagina accueil revista zeitung
event calendar meeting conference
product shop store order catalogue delivery online
forum society association charity volunteer""".splitlines()
_NAME = re.compile("[a-z]+")


def parts(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split("[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def names(host: str, path: str) -> list[str]:
    """Letter runs of host and path, in order."""
    return _NAME.findall(host) + _NAME.findall(path.lower())


def standing_alone(host: str, path: str) -> list[str]:
    """Words that the corpus itself sets apart: names of paths and of hyphenated host labels, of a known word's length."""
    runs = [w for label in host.split(".") if "-" in label for w in _NAME.findall(label)] + _NAME.findall(path.lower())
    return [w for w in runs if LEAST <= len(w) <= MOST]


class Rules:
    """Longest fitting rule; a rule's host covers its subdomains and its path is a prefix."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            host = host.partition(".")[2]
        return best


class Examples:
    """Labelled examples: their words' shares, and the naive Bayes weight of each word."""

    def __init__(self, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, prior: float = PRIOR_BLOCK, add: float = 0.1):
        counts = [Counter(w for line in lines for w in line.split()) for lines in (blocked, allowed)]
        every = counts[0] + counts[1]
        self.shares = {w: n / every.total() for w, n in every.items() if LEAST <= len(w) <= MOST}
        totals = [c.total() + add * len(every) for c in counts]
        # Words that no example has are left out, as they speak for neither side.
        self.weight = {w: math.log((counts[0][w] + add) / totals[0]) - math.log((counts[1][w] + add) / totals[1]) for w in every}
        self.bias = math.log(prior / (1 - prior))


class Segmenter:
    """Unigram Viterbi over the examples' words and those of the corpus that the name contains."""

    def __init__(self, examples: Examples, total: int = 0):
        self.examples, self.total = examples, max(total, 1)

    def cost(self, word: str, corpus: dict[str, int]) -> float:
        share = (self.examples.shares.get(word, 0.0) + corpus.get(word, 0) / self.total) / 2
        return -math.log(share) if share else -math.log(UNKNOWN) + len(word) * math.log(LETTER)

    def split(self, name: str, corpus: dict[str, int] | None = None) -> list[str]:
        """Known words, and unknown ones of any length, of the least cost; an unknown word is as long as it can be."""
        corpus = corpus or {}
        known, letter, start = self.examples.shares, math.log(LETTER), -math.log(UNKNOWN)
        # At each place: the cost of the best split that ends in a whole word, and of the best that ends within an unknown one.
        whole, open_ = [(0.0, 0)], [(math.inf, 0)]
        for i in range(1, len(name) + 1):
            run = min((open_[-1][0] + letter, open_[-1][1]), (whole[-1][0] + start + letter, i - 1))
            best = run
            for j in range(max(0, i - MOST), i - LEAST + 1):
                word = name[j:i]
                if word in known or word in corpus:
                    best = min(best, (whole[j][0] + self.cost(word, corpus), j))
            whole.append(best)
            open_.append(run)
        out, i = [], len(name)
        while i:
            out.append(name[whole[i][1] : i])
            i = whole[i][1]
        return out[::-1]

    def weight(self, name: str, corpus: dict[str, int] | None = None) -> float:
        """The sum of the weights of the name's words."""
        return sum(self.examples.weight.get(w, 0.0) for w in self.split(name, corpus))


def _parsed(pages: DataFrame, rules, url_col: str) -> DataFrame:
    """A row for each distinct URL: url, host, path, rule, decided (its verdict), names, alone (words that stand alone), n (rows that have it)."""
    listed = tuple(rules)

    def work(batches):
        by_rule = Rules(listed)
        for batch in batches:
            found = [parts(u) for u in batch.column(0).to_pylist()]
            chosen = [by_rule.find(*x) or (None, None) for x in found]
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], *[pa.array([x[i] for x in chosen], pa.string()) for i in (0, 1)], pa.array([names(*x) for x in found], words), pa.array([standing_alone(*x) for x in found], words), batch.column(1)],
                names=["url", "host", "path", "rule", "decided", "names", "alone", "n"],
            )

    small_batches(pages.sparkSession)
    urls = pages.groupBy(F.col(url_col).cast("string").alias("url")).agg(F.count("*").alias("n"))
    return saved(urls.mapInArrow(work, "url string, host string, path string, rule string, decided string, names array<string>, alone array<string>, n long"))


def corpus_words(urls: DataFrame) -> DataFrame:
    """(word, n): how often each word stands alone in all pages."""
    return urls.select(F.explode("alone").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def name_weights(urls: DataFrame, words: DataFrame, total: int, examples: Examples) -> DataFrame:
    """(name, weight) of the distinct names whose words any example has."""
    distinct = urls.select(F.explode("names").alias("name")).distinct()
    # Parts overlap by a word's length, so each substring of a word's length lies in one of them.
    cut = distinct.select(F.xxhash64("name").alias("a"), F.md5("name").alias("b"), F.explode(F.expr(f"transform(sequence(0, (length(name) - 1) div {_PART}), i -> substring(name, i * {_PART} + 1, {_PART + MOST - 1}))")).alias("part"))
    placed = cut.select("a", "b", "part", F.explode(F.expr(f"sequence(1, least({_PART}, length(part)))")).alias("i")).where(f"length(part) - i + 1 >= {LEAST}")
    inside = placed.select("a", "b", F.explode(F.expr(f"transform(sequence({LEAST}, least({MOST}, length(part) - i + 1)), n -> substring(part, i, n))")).alias("word"))
    known = inside.join(words, "word").groupBy("a", "b").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))
    rows = distinct.withColumns({"a": F.xxhash64("name"), "b": F.md5("name")}).join(known, ["a", "b"], "left").select("name", "known")

    def work(batches):
        segmenter = Segmenter(examples, total)
        for batch in batches:
            out = [(name, segmenter.weight(name, dict(held or ()))) for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            out = [x for x in out if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["name", "weight"])

    return rows.mapInArrow(work, "name string, weight double")


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", examples: Examples | None = None, segment: bool = True) -> DataFrame:
    """A row for each page: id, host, path, rule, verdict, p_block (the model's probability, given even where a rule decides).

    segment=False weighs names whole, to see what the segmentation changes.
    """
    examples = examples or Examples()
    urls = _parsed(pages, rules, url_col)
    words = corpus_words(urls)
    if segment:
        weights = name_weights(urls, words, words.agg(F.sum("n")).first()[0] or 0, examples)
    else:
        weights = pages.sparkSession.createDataFrame(list(examples.weight.items()), "name string, weight double")
    # A frequent name is dealt over several tasks; few names have a weight, so they travel to each.
    salted = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    each = urls.select("url", F.explode("names").alias("name")).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(_SALTS)).cast("int"))
    # Sums in a fixed order, so that they are alike on every cluster.
    sums = each.join(salted, ["name", "salt"]).groupBy("url").agg(F.array_sort(F.collect_list("weight")).alias("w")).select("url", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("sum"))
    p = F.when(F.col("host") == "", F.lit(0.0)).otherwise(1 / (1 + F.exp(-(F.lit(examples.bias) + F.coalesce("sum", F.lit(0.0))))))
    scored = urls.join(sums, "url", "left").select("url", "host", "path", "rule", "decided", p.alias("p_block"))
    rows = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url"))
    # A null URL and an empty one are judged alike.
    one = scored.groupBy(F.coalesce("url", F.lit("")).alias("__url")).agg(*[F.max(c).alias(c) for c in ("host", "path", "rule", "decided", "p_block")])
    verdict = F.coalesce("decided", F.when(F.col("p_block") >= THRESHOLD, "block").otherwise("allow"))
    return rows.join(one, "__url").select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "p_block")
