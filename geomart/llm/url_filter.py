"""URL filters: rules by host and path first, then logistic regression on hashed character n-grams of both.

The model is trained from a small labelled table of URLs. The one that is made here puts every word of two lists, and
made-up names that pass, into the same sites, languages and forms of address, so that only the names can tell the
classes apart.
"""

from __future__ import annotations

from itertools import cycle, product

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Words of hosts that a filter should block, and of hosts that it should let pass.
BLOCKED = """
    casino poker roulette jackpot slots betting bets gambling lottery viagra cialis pills pharma steroids dieting adult porn xxx sex nude escort
    camgirls hookup spam phishing malware warez torrent cracked keygen replica counterfeit payday loans crypto-doubler ads adserver ad-track tracker
    popunder clickbait banner-farm link-farm free-money get-rich win-prize cheap-meds hot-singles
""".split()
ALLOWED = """
    weather kitchen garden history museum library school college science physics biology chemistry music concert theatre cinema travel railway
    airport harbour village council government parliament hospital clinic doctor dentist recipes bakery coffee sports football cycling running
    hiking climbing sailing fishing forest river mountain island weekly herald tribune journal review gazette chronicle bulletin archive records
    blog notes diary photos painting gallery sculpture design fashion furniture carpenter plumber electric solar energy water housing estate
    lawyer notary insurance savings teacher student alumni research institute academy university language grammar dictionary letters poetry novels
    software hardware network developer database compiler python kernel mobile gaming puzzle chess robotics astronomy geology climate
    fundraiser charity animals horses bees orchard vineyard farmers market grocery butcher cheese
""".split()
#: Parts of made-up names, which pass.
SOUNDS = (("th", "st", "br", "m", "w", "l"), ("an", "er", "ou", "i"), ("th", "n", "sh", "r", "t"), ("er", "ing", "a"))
FORMS = [
    "http://{}.example.com/en/{}", "https://www.{}.example.net/de/{}.html", "https://{}.example.org/fr/{}/", "http://blog.{}.example.com/es/{}?page=2", "https://m.{}.example.net/en/{}#top", "https://{}-site.example.org/{}/index.html",
    "http://example.net/{}/{}", "https://the{}.example.com/en/{}", "http://best-{}.example.net/fr/{}", "https://www.{}-online.example.com/de/{}",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked (0 or 1): every word of both lists and every made-up name in every form."""
    number = cycle(range(3, 50_000, 977))
    names = [(w, 1.0) for w in BLOCKED] + [(w, 0.0) for w in [*ALLOWED, *map("".join, product(*SOUNDS))]]
    rows = [(form.format(name, next(number)), blocked) for name, blocked in names for form in FORMS]
    return spark.createDataFrame(pa.table({"url": [r[0] for r in rows], "blocked": [r[1] for r in rows]})).coalesce(4)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host and path) that fits, and its verdict; both null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long rules the first in alphabetical order counts.
    """
    found = verdict = F.lit(None).cast("string")
    for told, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)[::-1]:
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(told)).otherwise(verdict)
    return found, verdict


def char_grams(text: Column, kind: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of the text between marks of its ends, each with `kind` before it. Every digit counts as 0."""
    marked = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))

    def grams(chars: Column) -> Column:
        of_size = [F.transform(F.sequence(F.lit(0), F.size(chars) - size), lambda i: F.concat(F.lit(kind), *[chars[i + k] for k in range(size)])) for size in sizes]  # noqa: B023
        return F.concat(*[F.when(F.size(chars) >= size, g).otherwise(F.array()) for size, g in zip(sizes, of_size)])

    return F.transform(F.array(F.split(marked, "")), grams)[0]  # an array of one, so that the characters are bound once


class UrlModel:
    """Probability that a URL is to be blocked, by its host and path."""

    def __init__(self, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 16, penalty: float = 1e-4, passes: int = 30):
        self.sizes, self.buckets, self.penalty, self.passes, self.fitted = sizes, buckets, penalty, passes, None

    def grams(self, host: Column, path: Column) -> Column:
        return F.concat(char_grams(host, "h", self.sizes), char_grams(path, "p", self.sizes))

    def fit(self, labelled: DataFrame) -> UrlModel:
        """labelled: url, blocked (0 or 1; rows with a null in it are left out), a small table. One class alone, or no rows, make every probability that class's, or 0."""
        url = F.col("url")
        known = labelled.filter("blocked is not null").select(self.grams(host_of(url), path_of(url)).alias("grams"), F.col("blocked").cast("double").alias("label"))
        if known.limit(1).count():
            hashing = HashingTF(numFeatures=self.buckets, binary=True, inputCol="grams", outputCol="features")
            machine = LogisticRegression(regParam=self.penalty, maxIter=self.passes, standardization=False)
            self.fitted = PipelineModel([hashing, machine.fit(hashing.transform(known))])
        return self

    def probability(self, df: DataFrame, host: str, path: str, out: str) -> DataFrame:
        """Adds `out` to df."""
        if self.fitted is None:
            return df.withColumn(out, F.lit(0.0))
        grams, features, raw, chance, told = fresh(df, "_grams", "_features", "_raw", "_chance", "_told")
        hashing, machine = self.fitted.stages
        hashing = hashing.copy().setInputCol(grams).setOutputCol(features)
        machine = machine.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(told)
        scored = machine.transform(hashing.transform(df.withColumn(grams, self.grams(F.col(host), F.col(path)))))
        return scored.withColumn(out, vector_to_array(chance)[1]).drop(grams, features, raw, chance, told)


#: The rules of the query, as its contract states them.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, blocked_probability of every page: the longest rule that fits decides, else the model at one half.

    A null url, or one without ://, has an empty host and path: no rule fits, and the model judges the empty strings.
    Repeated rows have a verdict each; a null page_id is kept; an empty table gives an empty one. Columns beside page_id
    and url are not read.
    """
    url = F.col("url")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    scored = (model or UrlModel().fit(labelled)).probability(parts, "host", "path", "blocked_probability")
    by_model = F.when(F.col("blocked_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(told, by_model).alias("verdict"), "blocked_probability")
