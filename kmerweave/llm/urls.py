"""URL filters: rules, and logistic regression on hashed character n-grams, in DataFrame expressions only (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerweave.llm.common import table

# Rules of the contract (host and path prefix, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

# A small labelled table of invented URLs (1: unwanted).
LABELLED = [
    *((u, 1) for u in """http://spam-farm.test/en/1 https://www.spam-farm.test/de/20 http://spam-links.test/go http://link-farm.test/en/7
    https://cheap-pills.test/en/3 http://www.cheap-pills.test/fr/450 http://cheap-meds.test/buy/pills http://buy-pills.test/en/88
    https://casino-bonus.test/en/5 http://www.casino-win.test/play/9 http://free-casino.test/slots http://poker-bonus.test/en/61
    http://adult-video.test/xxx/4 https://xxx-cams.test/en/2 http://hot-xxx.test/free/31 http://free-money.test/win/cash
    http://win-prizes.test/click/7 https://click-track.test/ads/1 http://ad-clicks.test/track/55 http://cheap-loans.test/en/14
    http://payday-loans.test/apply http://replica-watches.test/shop/6 http://cheap-replica.test/en/9 http://warez-crack.test/keygen/3
    http://free-keygen.test/dl/crack https://seo-backlinks.test/en/2 http://buy-followers.test/en/10 http://content-farm.test/en/77""".split()),
    *((u, 0) for u in """http://ththre.site.test/en/825 https://m.thing.site.test/en/25 https://other.site.test/de/685 http://there.site.test/en/676
    https://blog.nation.site.test/en/853/ http://blog.than.site.test/en/960 https://news.site.test/en/474.html https://www.then.site.test/fr/148.html
    http://blog.thant.site.test/es/369 https://library.test/catalog/12 https://www.university.test/research/papers/4 http://museum.test/en/collection/9
    https://docs.project.test/guide/intro https://wiki.project.test/page/77 http://weather.test/de/today https://recipes.test/soup/31
    http://history.test/essays/12.html https://science.test/articles/2019/4 https://school.test/en/lessons/8 http://city.test/fr/transport
    https://health.test/advice/sleep http://garden.test/plants/roses https://music.test/reviews/101 http://books.test/en/novels/55
    https://maps.test/de/41 http://travel.test/es/guide/7 https://forum.code.test/thread/900 http://archive.test/en/1999/3""".split()),
]


def parts(url: str = "url"):
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def match(rules: list[tuple[str, str]]):
    """(rule, verdict) of the longest rule that fits the columns host and path, else nulls. The list is part of the
    expression: it is meant for some hundred rules."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        name, path = text.split("/", 1)
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.startswith("path", F.lit(f"/{path}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def features(dims: int, sizes: tuple[int, ...]) -> str:
    """The hashed n-grams of ``^host$`` and ``^path$``, the two told apart by the hash's input."""
    one = lambda col, n: f"transform(sequence(1, greatest(1, length({col}) + 3 - {n})), i -> cast(pmod(xxhash64('{col}', substring(concat('^', {col}, '$'), i, {n})), {dims}) as int))"
    return f"concat({', '.join(one(c, n) for c in ('host', 'path') for n in sizes)})"


def margin(weights: list[float], bias: float):
    """The model's log odds: the mean weight of a URL's n-grams, scaled by the root of their number."""
    lookup = F.expr(f"cast(split('{','.join(map(repr, map(float, weights)))}', ',') as array<double>)")
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(lookup, g))
    return total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double")) + F.lit(float(bias))


def train(labelled: DataFrame, dims: int = 2048, sizes: tuple[int, ...] = (3, 4), rounds: int = 12, rate: float = 4.0, decay: float = 0.002) -> tuple[list[float], float]:
    """Logistic regression by gradient descent from a labelled table (url, label).

    A round is one aggregation by feature, so the table may be of any size; the driver holds ``dims`` weights.
    """
    host, path = parts()
    rows = labelled.where("label is not null").select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    rows = rows.selectExpr(f"{features(dims, sizes)} as grams", "label")
    count, up = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    weights, bias = [0.0] * dims, 0.0
    if not count:
        return weights, bias
    for _ in range(rounds):
        error = 1 / (1 + F.exp(-margin(weights, bias))) - F.col("label")
        step = rows.select(error.alias("e"), F.size("grams").cast("double").alias("n"), F.explode(F.concat("grams", F.array(F.lit(-1)))).alias("g"))
        grads = step.groupBy("g").agg(F.sum(F.when(F.col("g") == -1, F.col("e")).otherwise(F.col("e") / F.sqrt("n"))).alias("s")).collect()
        weights = [w * (1 - decay) for w in weights]
        for g, s in grads:
            if g == -1:
                bias -= rate * 0.2 * s / count
            else:
                weights[g] -= rate * s / count
    return weights, bias


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, threshold: float = 0.5, dims: int = 2048, sizes: tuple[int, ...] = (3, 4)) -> DataFrame:
    """A verdict for each page: (page_id, host, path, rule, verdict, score), the score being the model's probability
    that the URL is unwanted. The longest fitting rule decides; where none fits, the model does.

    Scoring is one expression for each row with the weights as a literal array: no shuffle, no join.

    Null URLs or those without ``://``: empty host and path, judged by the model. Null page_id and repeated rows: a
    row each. An empty labelled table: score 0.5, allow. Other columns are not read.
    """
    weights, bias = train(labelled, dims, sizes)
    host, path = parts()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.expr(features(dims, sizes)).alias("grams"))
    score = 1 / (1 + F.exp(-margin(weights, bias)))
    rows = rows.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(LABELLED, "url string, label int")
    return judge(table(spark, sf_dir, "pages"), RULES, labelled)
