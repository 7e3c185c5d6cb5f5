"""URL filters: allow and block rules, then a logistic regression on hashed n-grams.

Features are character 3- and 4-grams of host and path, hashed to ``DIMENSIONS`` places
and divided by their number. The model is fitted by stochastic gradient steps over the
small labelled table ``LABELLED`` (its size is the bound) and used as a literal array, so
judging is a map-only expression over page_id and url.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule
and, with nothing to judge, the verdict allow; repeated rows are judged alike; an empty
table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, table

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled URL table, of invented hosts.
WANTED = """
https://www.rivertownherald.com/local/council-votes-on-bridge
https://politics.morningledger.co.uk/elections/results-map
http://kitchen-table-notes.net/bread/rye-starter
https://www.cityoflakeside.gov/permits/building
https://library.northfield.edu/hours
https://cs.hillcollege.edu/~lee/lectures/graphs.pdf
https://www.nationalgallery.org/collection/portraits/118
https://docs.fastgrid.io/en/stable/tutorial.html
https://developer.openmaps.org/reference/tiles/v2
https://forum.woodworkers.org/t/dovetail-jig/20931
https://en.wikibooks.example.org/wiki/Organic_Chemistry
https://journals.plantbio.org/article/view/5521
https://www.oldtimecycling.com/reviews/steel-frames
https://blog.mountainweather.ch/2023/02/avalanche-report
https://www.childrenshospital.org/departments/cardiology
https://archive.parliament.uk/debates/1954/may/12
https://www.gardenersworld.com/plants/roses/pruning
https://lyrics-and-scores.org/bach/cantata-140
https://www.zoologicalsociety.org/species/red-panda
http://astronomy.skywatchers.net/2021/11/leonids
https://shop.paperlantern.com/notebooks/a5-dotted
https://www.trainmuseum.de/besuch/oeffnungszeiten
https://recettes.maisonverte.fr/soupe-a-l-oignon
https://www.bibliotecapublica.es/catalogo/novedades
https://noticias.elmirador.es/cultura/teatro
https://actu.lavallee.fr/meteo/vendredi
https://wetter.nordkueste.de/vorhersage/hamburg
https://stack.programmers.org/questions/4410/sort-a-list
https://git.smalltools.dev/parser/blob/main/README
https://www.unionbank.com/personal/savings-accounts
https://travel.slowroutes.com/italy/liguria-on-foot
https://podcasts.historyhour.com/episodes/the-silk-road
https://www.chessclub.org/openings/caro-kann
https://research.oceanlab.org/datasets/salinity
https://www.theatre-royal.co.uk/whats-on/hamlet
https://help.letterbox.app/account/change-address
https://news.agriculture.org/markets/wheat
https://www.architecturetoday.net/projects/timber-school
https://poetry.quietroom.org/authors/dickinson
https://www.villageschool.org/calendar/term-dates
https://statistics.nordics.eu/population/tables
https://www.lawreview.edu/volumes/88/issue-2
https://knitting.warmhands.com/patterns/mittens
https://www.runnersguide.com/training/half-marathon
https://photos.birdwatch.org/gallery/kingfisher
https://www.metrotransit.gov/routes/17
https://philosophy.dailyreadings.org/stoics/seneca
https://www.farmersmarket.org/vendors/cheese
https://wiki.gamemodding.org/index.php/Textures
https://www.museumofglass.org/learn/workshops
https://data.worldhealth.org/indicators/measles
https://m.eveningpost.com/sport/cricket/scorecard
https://letters.emigrants.ie/1847/march
https://www.pianostudio.com/lessons/adults
https://support.routermaker.com/manuals/setup
https://www.sailingclub.fi/races/2022
https://www.smithfamily.info/reunion/photos
https://parish.stmary.info/services/sunday
https://coffee.roastery.shop/beans/ethiopia
https://www.localchoir.club/rehearsals/spring
https://math.puzzles.online/sudoku/medium
https://artisan.pottery.store/bowls/stoneware
https://volunteers.foodbank.site/shifts/saturday
https://open.courseware.top/calculus/week-3
"""
UNWANTED = """
http://discount-meds-rx.biz/order-now/no-prescription
http://www.pharma4less.net/viagra/buy-online
https://cialis-generic.org/cheap/fast-shipping
https://megajackpot-slots.club/bonus/500-free-spins
http://royal-casino77.de/register?ref=promo
https://bet-big-now.com/sports/odds-boost
http://pokerlivecash.xyz/deposit/bonus-code
https://hotgirls-cams.org/live/free-chat
http://adult-dating-tonight.co.uk/meet/local-singles
https://sexy-webcam.click/join/free
http://payday-loans-instant.com/apply/bad-credit
https://fastcash4u.net/loan/approved-today
https://crypto-doubler-pro.top/invest/guaranteed-profit
http://bitcoin-giveaway.co.uk/claim/airdrop
https://replica-rolex-outlet.de/watches/cheap
http://designer-bags-wholesale.store/louis/sale-90-off
https://free-iphone-winner.net/claim-prize/survey
http://you-are-winner.org/lottery/claim
https://download-crack-keygen.net/photoshop/full-version-free
http://warez-torrents.de/download/serial-key
https://seo-backlinks-cheap.com/buy/1000-links
http://link-farm-network.info/links/page/97
https://best-traffic-bot.org/buy-traffic/clicks
http://weight-loss-miracle.co.uk/keto-pills/trial
https://lose-belly-fat-fast.click/one-weird-trick
http://work-from-home-millions.com/earn/5000-a-week
https://get-rich-quick.net/secret-system
http://spam-blast-mailer.info/bulk-email/send
https://fake-ids-online.co.uk/order/passport
http://cheap-followers.de/instagram/buy-likes
https://celebrity-gossip-shocking.click/you-wont-believe
http://doctors-hate-this.net/trick/teeth-white
https://miracle-hair-growth.org/order/buy-2-get-1
http://hack-account-tool.xyz/generator/free-coins
https://unlimited-gems-generator.de/no-survey
http://russian-brides-meet.com/signup/free
https://essay-writers-cheap.biz/order/a-plus-paper
http://debt-relief-now.org/free-quote
https://insurance-quotes-cheap.co.uk/compare/free
http://porn-tube-free.xxx/videos/hd
https://escort-service-vip.com/girls/booking
http://steroids-buy-online.net/anabolic/shipping
https://weed-shop-discreet.ws/order/edibles
http://timeshare-exit-scam.co.uk/claim/refund
https://slot-machine-777.de/casino/spin
http://free-gift-card.win/claim/now
https://penny-stock-alerts.net/buy/hot-pick
http://forex-signals-profit.org/join/vip
https://pills-without-rx.shop/tramadol/overnight
http://click-here-now.de/offers/win-free-money
https://cheap-cigarettes.com/buy/carton
http://urgent-virus-alert.online/scan/download-now
https://mega-deals-spam.org/coupon/free
http://lonely-wives.co.uk/chat/now
https://gambling-tips-sure.win/bet/fixed-matches
http://viagra-casino-loans.com/links/exchange
http://www.buy-cheap-pills.com/order/pills
https://pills-discount.org/buy/now
http://cheap-watches-outlet.net/sale/buy
https://casino-free-spins.com/win/bonus
http://spam-links.org/links/buy
https://www.best-payday-loans.com/apply/now
http://free-adult-videos.org/watch/xxx
http://win-lottery-prize.com/claim/money
"""
LABELLED = tuple([(u, 0) for u in WANTED.split()] + [(u, 1) for u in UNWANTED.split()])

DIMENSIONS = 1 << 16
GRAMS = (3, 4)
EPOCHS = 40
RATE = 20.0
BIAS = 0.05
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, domain, prefix in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(prefix))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + prefix).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def places(host: Column, path: Column) -> Column:
    """Hashed places of the n-grams, repeats included; none without a host."""

    def grams(s: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(s, i, n)), F.lit(DIMENSIONS)).cast("int"))

        return F.concat(*[of(n) for n in GRAMS])

    return F.when(host == "", F.array().cast("array<int>")).otherwise(let(F.concat(F.lit("^"), host, F.lower(path), F.lit("$")), grams))


def fit(spark: SparkSession, labelled=LABELLED) -> list[float]:
    """Weights, the bias last: stochastic gradient steps over the labelled table, by URL.

    The table is a constant of this module, so its size is the bound; the features come
    from the expression that judging uses.
    """
    rows = spark.createDataFrame(list(labelled), "url string, y int").coalesce(1)
    rows = rows.select("url", "y", places(host_of(F.col("url")), path_of(F.col("url"))).alias("p"))
    weights = [0.0] * (DIMENSIONS + 1)
    examples = [(r["p"], r["y"]) for r in sorted(rows.collect())]
    for _ in range(EPOCHS):
        for p, y in examples:
            z = sum(weights[i] for i in p) / max(1, len(p)) + weights[-1] * BIAS
            step = (y - 1 / (1 + math.exp(-z))) * RATE
            for i in p:
                weights[i] += step / len(p)
            weights[-1] += step * BIAS
    return weights


def judge_urls(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of an unwanted page."""
    weights = fit(pages.sparkSession) if weights is None else weights
    # one foldable expression, so that the plan holds a single array and not a literal for each weight
    literal = F.split(F.lit(",".join(f"{w:.6g}" for w in weights[:-1])), ",").cast("array<double>")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))

    def probability(p: Column) -> Column:
        z = F.aggregate(p, F.lit(0.0), lambda a, i: a + F.get(literal, i)) / F.size(p) + weights[-1] * BIAS
        return F.when(F.size(p) == 0, 0.0).otherwise(1 / (1 + F.exp(-z)))

    scored = parts.select("*", rule_of(F.col("host"), F.col("path")).alias("r"), let(places(F.col("host"), F.col("path")), probability).alias("p_unwanted"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("p_unwanted") >= THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "p_unwanted")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
