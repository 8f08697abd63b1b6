"""URL filters: ordered host and path rules, and logistic regression on hashed character n-grams of host and path.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm.textops import free_name

#: Hash buckets of the n-grams, which bound the weights that the plan carries.
BUCKETS = 4096
GRAM = 4
STEPS = 40
RATE = 80.0
SHRINK = 0.001

# fixed values: names that make up the small labelled table (1: unwanted site, 0: ordinary site)
_UNWANTED = (
    "casino", "online-casino", "royal-casino", "poker", "poker-room", "roulette", "slots", "lucky-slots", "bets", "live-bets",
    "betting", "sports-betting", "lottery", "jackpot", "bonus-win", "win-cash", "win-prizes", "free-money", "free-prizes",
    "free-spins", "adult", "adult-video", "adult-chat", "xxx", "xxx-tube", "x-rated", "porn", "sex-cams", "escort", "pills",
    "diet-pills", "buy-pills", "cheap-meds", "cheap-watches", "cheap-replica", "viagra", "pharma-deals", "spam", "spam-mail",
    "spam-links", "link-farm", "click-farm", "ads", "ads-network", "ads-banner", "adserver", "track-pixel", "click-track",
    "tracker", "clickbait", "popunder", "warez", "crack-keygen", "torrent", "payday-loans",
)
_ORDINARY = (
    "news", "library", "city-library", "university", "school", "museum", "weather", "travel", "recipes", "garden", "science",
    "data-science", "history", "health", "well-being", "government", "council", "archive", "film-archive", "wiki", "docs",
    "journal", "books", "music", "sports", "forum", "research", "hospital", "theatre", "maps", "letters", "blog", "shop",
    "kitchen", "mountain", "river", "northern", "free-software", "open-source", "organic-farm", "farm-life", "railway-track",
    "city-guide", "long-read", "home-page", "weatherman", "brother", "mother", "other", "therein", "nation", "station",
    "ration", "motion", "reading", "writing", "evening", "morning", "string", "ring", "thing", "table", "able", "stable",
    "noble", "hand", "sand", "land", "wind", "east", "west", "coast", "forest", "honest", "linen", "onion", "union", "region",
    "reason", "season", "person", "heron", "baron", "iron", "enter", "winter", "inter", "water", "letter", "seed", "need",
    "feed", "wheat", "heat", "that", "thin", "three", "thorn", "north", "earth", "worth", "youth", "south", "mouth", "daily",
    "family", "early", "rely", "only", "ash", "fish", "dish", "wash", "area", "idea", "sea", "tea", "year", "hour", "four",
    "your", "house", "schule", "bericht", "einheit", "zeitung", "wetter", "stadt", "maison", "école", "jardin", "musique",
    "ciudad", "escuela", "tiempo", "noticias",
)
_HOSTS = ("{}.com", "www.{}.org", "m.{}.net", "blog.{}.info", "{}.co.uk")
_PATHS = ("/", "/en/12.html", "/page/7?ref=x", "/de/index")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, unwanted): every listed name under each form of host, with neutral paths."""
    rows = []
    for label, names in ((1, _UNWANTED), (0, _ORDINARY)):
        for i, name in enumerate(names):
            for j, host in enumerate(_HOSTS):
                rows.append((f"https://{host.format(name)}{_PATHS[(i + j) % len(_PATHS)]}", label))
    return spark.createDataFrame(rows, "url string, unwanted int")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. A rule is a host, with all below it, and the start of a path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def _grams(host: Column, path: Column, buckets: int, size: int) -> Column:
    """Hash buckets of the distinct character n-grams of host and path, kept apart and marked at both ends."""

    def of(text: Column, kind: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.length(framed) - size + 1, F.lit(1)))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substr(framed, i, F.lit(size))), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


def _logit(grams: Column, weights: Column, bias: float) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.element_at(weights, g + 1))
    return total / F.sqrt(F.size(grams)) + F.lit(bias)


def _as_array(weights: list[float]) -> Column:
    """The weights as one literal, which Spark folds while planning."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def train(labelled: DataFrame, buckets: int = BUCKETS, size: int = GRAM, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias by gradient steps over a small labelled table (url, unwanted 0/1).

    Rows without a label are left out, an empty table gives zero weights. Each step is one aggregation; the driver holds
    the ``buckets`` weights alone.
    """
    urls = labelled.where(F.col("unwanted").isNotNull()).select(
        F.col("unwanted").cast("double").alias("y"), _grams(host_of(F.col("url")), path_of(F.col("url")), buckets, size).alias("grams")
    )
    rows = urls.count()
    weights, bias = [0.0] * buckets, 0.0
    urls = urls.persist()
    for _ in range(steps if rows else 0):
        missing = F.col("y") - 1 / (1 + F.exp(-_logit(F.col("grams"), _as_array(weights), bias)))
        part = urls.select("grams", missing.alias("e")).select(F.col("e") / F.sqrt(F.size("grams")), F.explode(F.concat(F.array(F.lit(-1)), "grams")), F.col("e"))
        sums = part.toDF("scaled", "gram", "e").groupBy("gram").agg(F.sum(F.when(F.col("gram") < 0, F.col("e")).otherwise(F.col("scaled"))).alias("g")).collect()
        gradient = {r["gram"]: r["g"] for r in sums}
        weights = [w * (1 - SHRINK) + RATE * gradient.get(i, 0.0) / rows for i, w in enumerate(weights)]
        bias += RATE * gradient.get(-1, 0.0) / rows / 8
    urls.unpersist()
    return weights, bias


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], model: tuple[list[float], float], columns: list[str], size: int = GRAM) -> DataFrame:
    """``columns`` of every row with host, path, rule, verdict and the model's probability that the site is unwanted.

    The longest fitting rule decides; without one the model does, at one half. A null url, or one without ``://``,
    has an empty host and path, which no rule with a path fits and the model judges by its bias alone with that of an
    empty name. Repeated rows are judged alike. ``rules`` are (allow or block, host/path) and few: the plan holds them.
    A new column whose name is among ``columns`` gets an underscore more.
    """
    weights, bias = model
    url = F.col("url").cast("string")
    # what is handed through stays one struct, so that none of its names can clash
    parts = pages.select(F.struct(*columns).alias("_held"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    grams = _grams(F.col("_host"), F.col("_path"), len(weights), size)
    unwanted = 1 / (1 + F.exp(-_logit(grams, _as_array(weights), bias)))
    judged = parts.select("*", name.alias("_rule"), verdict.alias("_verdict"), unwanted.alias("_unwanted"))
    by_model = F.when(F.col("_unwanted") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    added = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": F.coalesce("_verdict", by_model), "unwanted": F.col("_unwanted")}
    return judged.select(*[F.col(f"_held.`{c}`").alias(c) for c in columns], *[value.alias(free_name(c, columns)) for c, value in added.items()])
