"""URL filter: rules on hosts and paths, and logistic regression on hashed character n-grams.

Native: DataFrame functions throughout, training included.  The labelled table is small (of a larger
one the first MOST_LABELLED rows by URL and label are used): one row gathers its features by URL and by
bin, and gradient descent runs inside that row's expression.  Weights, one for each of BINS bins, reach
every URL as a scalar subquery.

A null URL, and one without ``://``, has an empty host and path.  A URL of any length has as many
n-grams as it has characters; an empty one is judged by the bias.  Ties in length between rules
that fit cannot be: two rules of one length that fit a URL are the same rule.  Repeated rows are judged
one by one; an empty table gives no rows, and an empty labelled table a score of 0.5 for every URL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import ship
from .names import unused

BINS = 4096
ORDERS = (3, 4)
EPOCHS = 60
RATE = 4.0
DECAY = 1e-4
MOST_LABELLED = 2000
#: (host, path, verdict): a host covers its subdomains, a path all that start with it.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The labelled table: sites written by hand for this module, named as such sites are; none is taken
#: from a crawl, and none is a host of the tables that the queries judge.  Unwanted: gambling,
#: medicines, adult, link spam, tracking, loans, pirated goods.
_UNWANTED = """
online-casino-royal megacasino777 casino-bonus-club slots-win-big lucky-jackpot-spins winbig-lottery poker-cash-bonus
bets-today sportsbetting-odds free-spins-casino bet-win-cash live-bets-24 best-free-casino big-win-slots casinobets
discount-pills-online pills-no-prescription cheap-meds-store viagra-cheap diet-pills-shop buy-cheap-viagra pillshop24
cheapcialis weight-loss-pills cheap-drugs-rx
adult-cams-live hot-adult-dating adult-xxx-tube xxx-video-free hotsingles-chat nude-cams-xxx freexxx
spam-links-seo linkfarm-network seo-spam-tools backlink-farm spam-mailer-pro clickfarm-boost contentfarm-hub spamblast
tracking-pixel-ads adtracker-click popup-ads-server track-clicks-ads adsnetwork-track clicktrack-ads bannerads-farm
payday-loans-fast quick-cash-loans easy-credit-now get-rich-quick free-money-fast bitcoin-doubler forex-win-system
replica-watches-sale cheap-replica-bags fake-designer-outlet cracked-software-keygen free-movies-torrent warez-downloads
free-gift-cards win-free-phone cheap-followers-buy free-crypto-bonus
casino-jackpot roulette-wheel-bets blackjack-bonus vegas-casino-slots scratch-cards-win lottery-numbers-win betting-tips-free
xanax-online tramadol-pills cialis-discount pharmacy-no-rx steroids-buy cheap-generic-pills
adultvideos adult-webcams sexy-chat-rooms escort-girls porn-tube-free
spam-comments spammers-paradise seo-links-cheap guest-post-farm link-exchange-seo article-spinner-farm
ad-server-click trackers-network ads-redirect pixel-track tracking-ads-popups click-fraud-ads
instant-loans-online bad-credit-loans crypto-doubler make-money-home earn-cash-surveys
fake-watches-outlet replica-shoes keygen-cracks torrent-movies-hd free-streaming-films
""".split()
_WANTED = """
city-library museum-of-design openmaps railway-history botanic-garden weather-station public-archive science-notes
mathforum physics-lab chemistry-notes biology-review river-trust mountain-club hiking-trails local-history town-council
northern-orchestra chamber-music poetry-review short-stories book-review bookshop-reader open-textbooks thesis-archive
language-school grammar-guide university-press student-union teaching-notes history-today world-news evening-post
thetimesreview citynews daily-report weekly-letter the-reader north-herald county-press nation-review the-other-press
recipes-from-home bread-and-butter kitchen-notes gardening-tips woodwork-forum knitting-circle bird-watching dog-training
cycling-club running-notes chess-club football-results swim-team sailing-school tennis-courts winter-sports
open-source-tools linux-howto python-notes compiler-blog database-journal network-guide data-portal maps-archive
health-service patient-advice hospital-trust dental-care nutrition-facts first-aid-course public-health
travel-diary train-times bus-routes island-ferry lighthouse-keepers harbour-watch mountain-hut
almanac astronomy-club atlas-of-plants baker-and-sons ballet-company beekeeping bridge-engineering canal-society
carpentry-school castle-tours cathedral-choir cheese-makers children-stories classical-guitar coastal-walks
craft-museum crossword-corner dairy-farm documentary-film drawing-lessons electrical-safety family-records
farmers-market field-guide film-society folk-songs forest-service garden-design geology-maps glass-studio
harvest-festival heritage-trust home-repair insect-guide jazz-archive kindergarten-songs landscape-painting
law-library marine-biology meadow-flowers medical-journal observatory old-photographs organic-farm oxford-walks
parish-council pottery-studio primary-school printmakers quilt-makers radio-drama research-institute rose-garden
sculpture-park seed-bank sheep-farm stamp-collectors steam-engines theatre-company translation-notes tree-register
vegetable-plot village-hall vintage-cars violin-makers volunteer-network water-mill wildlife-trust wool-weavers
parliament-records court-reports tax-help consumer-advice housing-charity youth-centre citizens-forum
""".split()
_PATHS = ("/en/12", "/de/a/7.html", "/fr/345/", "/es/80?ref=x", "/", "", "/index.html", "/news/2020/01/item")
_DOMAINS = ("example.com", "example.org", "site.info", "example.net", "pages.io")
_FRONTS = ("", "www.", "m.", "blog.")
#: URLs of each site.
_EACH = 2


def labelled(spark: SparkSession, held_out: tuple[int, int] | None = None) -> DataFrame:
    """(url, label, held_out) with label 1 for block; the sites above under several fronts, domains and paths.

    ``held_out`` (fold, folds): all URLs of every ``folds``-th site are marked, for tests on sites never seen.
    """
    fold, folds = held_out or (-1, 1)
    rows = []
    for label, sites in ((1, _UNWANTED), (0, _WANTED)):
        for i, site in enumerate(sites):
            for j in range(_EACH):
                front, domain, path = _FRONTS[(i + 3 * j) % 4], _DOMAINS[(i + 2 * j) % 5], _PATHS[(3 * i + j) % 8]
                rows.append((f"https://{front}{site}.{domain}{path}", label, i % folds == fold))
    return spark.createDataFrame(rows, "url string, label int, held_out boolean")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def bins(host: Column, path: Column, n_bins: int) -> Column:
    """Bins of all n-grams of the host and of the path, each with its borders marked."""

    def of(text: Column, tag: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        return let(chars, lambda c: F.concat(*(_grams(c, tag, n, n_bins) for n in ORDERS)))

    return F.concat(of(host, "host"), of(path, "path"))


def _grams(chars: Column, tag: str, n: int, n_bins: int) -> Column:
    starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(tag), *(F.get(chars, i + k) for k in range(n))), F.lit(n_bins)).cast("int"))


def _sum(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def train(table: DataFrame, n_bins: int = BINS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """One row, ``weights``: the bins' weights, then the bias; from (url, label).  Both labels count alike, however many rows have them."""
    rows = table.where("label is not null").orderBy("url", "label").limit(MOST_LABELLED).select(bins(*parts(F.col("url")), n_bins).alias("b"), F.col("label").cast("double").alias("label"))
    one = rows.agg(F.collect_list(F.struct("b", "label")).alias("rows"))
    numbered = one.select("rows", F.posexplode("rows").alias("i", "row"))
    value = 1 / F.sqrt(F.greatest(F.size("row.b"), F.lit(1)).cast("double"))
    entries = numbered.select("i", value.alias("x"), F.explode("row.b").alias("bin"))
    by_bin = entries.groupBy("bin").agg(F.collect_list(F.struct("i", "x")).alias("uses"))
    held = by_bin.agg(F.map_from_entries(F.collect_list(F.struct("bin", "uses"))).alias("uses"))
    empty = F.array().cast("array<struct<i:int,x:double>>")
    columns = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda k: F.coalesce(F.try_element_at("uses", k), empty))
    rows_x = F.transform("rows", lambda r: F.struct(r["b"].alias("b"), r["label"].alias("y"), (1 / F.sqrt(F.greatest(F.size(r["b"]), F.lit(1)).cast("double"))).alias("x")))
    data = one.select(rows_x.alias("rows")).withColumn("columns", held.select(columns).scalar())
    n = F.greatest(F.size("rows"), F.lit(1)).cast("double")
    ones = _sum(F.col("rows"), lambda r: r["y"])
    data = data.withColumn("shares", F.array(n / (2 * F.greatest(n - ones, F.lit(1.0))), n / (2 * F.greatest(ones, F.lit(1.0)))))

    def step(state: Column, _: Column) -> Column:
        def margin(r: Column) -> Column:
            return F.get(state, F.lit(n_bins)) + r["x"] * _sum(r["b"], lambda k: F.get(state, k))

        misses = F.transform(F.col("rows"), lambda r: F.get(F.col("shares"), r["y"].cast("int")) * (r["y"] - 1 / (1 + F.exp(-margin(r)))))
        return let(misses, lambda miss: F.concat(
            F.transform(F.col("columns"), lambda uses, k: F.get(state, k) * (1 - decay * rate) + rate / n * _sum(uses, lambda u: u["x"] * F.get(miss, u["i"]))),
            F.array(F.get(state, F.lit(n_bins)) + rate / n * _sum(miss, lambda m: m)),
        ))

    start = F.array_repeat(F.lit(0.0), n_bins + 1)
    return data.select(F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, step).alias("weights"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(df: DataFrame, table: DataFrame, url_col: str = "url", rules=RULES, n_bins: int = BINS) -> DataFrame:
    """The rows of ``df`` with host, path, rule, verdict and score (the model's probability of block).

    Columns of these names are replaced.
    """
    ship(df.sparkSession)
    host, path = parts(F.col(url_col))
    rows = df.withColumns({"host": host, "path": path})
    w = unused(rows, "weights")
    weights = F.coalesce(train(table, n_bins).scalar(), F.array_repeat(F.lit(0.0), n_bins + 1))
    total = let(bins(F.col("host"), F.col("path"), n_bins), lambda b: _sum(b, lambda k: F.get(F.col(w), k)) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")))
    score = 1 / (1 + F.exp(-(total + F.get(F.col(w), F.lit(n_bins)))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn(w, weights).withColumn("score", score).drop(w)
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))})


def op4_url_logistic_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
