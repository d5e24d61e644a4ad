"""URL filters: domain rules first, then logistic regression on hashed character n-grams of host and path.

The rules and the labelled URLs are small fixed tables. The regression is fitted on the driver from the labelled table
alone (full-batch gradient descent, whatever the corpus); its weights, rounded to whole millionths so that every engine
adds them exactly, go into the plan as one constant array. Judging a URL is a projection of built-in functions.

A null URL or one without :// has an empty host and path, fits no rule and gets the model's verdict of the empty
string: its bias, the log odds of the table's labels, which are below 0, so it is allowed. Each row is judged alone, so repeated rows get equal verdicts;
URLs are read whole, whatever their length.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read_table

#: (verdict, host, path); the longest that fits wins.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Buckets (a prime), n-gram length, gradient steps, step size and weight decay.
BUCKETS, N, STEPS, RATE, DECAY = 2039, 3, 500, 80.0, 1e-5
SCALE = 1_000_000
#: Labelled URLs, host and path: what to block and what to allow.
BLOCK = """bestcasinobonus.top/slots/free-spins onlinecasino-royal.bet/register?promo=100 mega-casino-win.xyz/jackpot slotking-casino.club/play poker-stars-bonus.vip/signup freespins24.bet/en/slots
sportsbetting-tips.win/odds/today live-roulette-casino.net/tables crypto-casino-deposit.io/bonus betwin365.bet/sports/football lottery-winner-claim.info/prize/2291 jackpot-lotto-results.win/draw
cheap-viagra-pills.com/order cialis-online-pharmacy.biz/buy-now canadian-pharmacy-meds.top/generic/viagra no-prescription-drugs.shop/tramadol buy-xanax-online.store/checkout weightloss-pills-miracle.com/keto
diet-keto-gummies.shop/special-offer buy-steroids-online.net/anabolic payday-loans-fast.com/apply instant-cash-loan.online/no-credit-check quick-loans-approved.info/apply bad-credit-loans.biz/get-cash
forex-signals-profit.club/join bitcoin-doubler.top/invest earn-money-fast.xyz/work-from-home free-bitcoin-giveaway.io/claim crypto-profit-robot.live/register make-money-online-now.biz/secret-method
hot-singles-nearby.date/chat xxx-adult-videos.tube/watch/8812 live-sex-cams.webcam/models/anna free-porn-movies.xxx/category/milf adult-dating-hookup.club/join sexy-escorts-city.com/girls
pornstar-clips.tube/video/2231 nude-celebs-leaked.net/gallery xxx-cams-live.chat/room/7 milf-sex-chat.date/profile/88 replica-watches-sale.shop/rolex fake-designer-handbags.store/gucci-replica
cheap-nike-outlet.top/air-max discount-rayban-sale.shop/sunglasses louis-vuitton-replica.store/bags rolex-replica-cheap.com/submariner crack-keygen-download.net/photoshop warez-full-version.org/office-crack
serial-keys-free.info/windows-activator torrent-movies-hd.to/download/avatar nulled-scripts.club/wordpress-plugins free-cracked-software.xyz/autocad keygen-serial.top/antivirus watch-free-movies-hd.stream/full-movie
buy-instagram-followers.co/packages cheap-backlinks-seo.com/pr9 get-twitter-followers.biz/buy seo-link-farm.info/submit buy-cheap-traffic.online/visitors link-exchange-directory.top/add-url
write-my-essay-cheap.com/order essay-writing-service.biz/buy-essay secure-login-paypa1.com/verify/account appleid-verify-account.info/login update-bank-account.top/signin/confirm free-iphone-winner.live/claim-prize
win-gift-card-now.club/survey you-won-prize.click/claim?id=77 virus-alert-support.online/call-now pc-cleaner-free-download.xyz/setup.exe free-ringtones-download.biz/mp3 miracle-hair-growth.shop/buy
psychic-love-spells.net/cast cheap-meds-online.top/viagra spam-farm.example.org/links/1 casino-bonus-spam.example.net/win online-casino-bonus.example.org/win/77 poker-casino.example.net/play/55
cheap-meds.example.net/buy/9 fast-loans.example.com/apply/5""".split()
ALLOW = """en.wikipedia.org/wiki/History_of_mathematics de.wikipedia.org/wiki/Geschichte fr.wikipedia.org/wiki/Histoire_de_France es.wikipedia.org/wiki/Geograf%C3%ADa www.gutenberg.org/ebooks/1342 archive.org/details/texts
github.com/apache/spark/blob/master/README.md gitlab.com/explore/projects stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster docs.python.org/3/library/json.html spark.apache.org/docs/latest/sql-ref.html developer.mozilla.org/en-US/docs/Web/HTTP
www.kernel.org/doc/html/latest/process arxiv.org/abs/1706.03762 pubmed.ncbi.nlm.nih.gov/31452104 www.nature.com/articles/s41586-020-2649-2 www.bbc.com/news/world-europe-56720589 www.theguardian.com/science/2020/jul/10/space
www.lemonde.fr/international/article/2021/03/04 www.spiegel.de/wissenschaft/mensch elpais.com/cultura/2021-02-03 www.dw.com/en/science/s-12526 www.nasa.gov/missions/artemis www.noaa.gov/weather/forecast
www.who.int/news-room/fact-sheets/detail/malaria www.europa.eu/youth/volunteering www.loc.gov/collections/maps www.nist.gov/publications/time-and-frequency data.gov.uk/search?q=transport www.census.gov/library/stories
ocw.mit.edu/courses/mathematics/linear-algebra www.stanford.edu/research/news www.ox.ac.uk/admissions/undergraduate www.ethz.ch/en/studies.html www.khanacademy.org/science/biology plato.stanford.edu/entries/ethics
www.allaboutbirds.org/guide/American_Robin/overview www.imdb.com/title/tt0068646/reviews www.goodreads.com/book/show/1885 www.bbcgoodfood.com/recipes/lentil-soup www.seriouseats.com/bread-baking-guide www.rottentomatoes.com/m/metropolis
blog.gardening-notes.org/2019/05/tomatoes www.city-library.org/opening-hours news.riverside-herald.com/local/council-meeting www.mountain-hiking.ch/routes/day-trips docs.weatherstation.net/manual/install www.village-school.co.uk/parents/calendar
recipes.family-kitchen.net/soup/onion forum.woodworking-club.org/threads/bench-plans museum.harbour-town.nl/exhibitions/current www.historical-society.org/archive/letters blog.astronomy-now.net/2020/saturn-rings science.tidepool.edu/lessons/erosion
www.cycling-routes.fr/alpes/col-du-galibier www.buergeramt-stadt.de/termine/online www.ayuntamiento-ciudad.es/servicios www.universite-nord.fr/recherche/laboratoires blog.travel-diary.net/2018/kyoto www.chess-federation.org/rules/tournaments
en.dictionary-online.org/word/serendipity www.openstreetmap.org/about lists.debian.org/debian-user/2021/01 www.postgresql.org/docs/current/indexes.html numpy.org/doc/stable/reference www.gnu.org/software/emacs/manual
www.farmers-market.org/vendors/apples www.orchestra-hall.org/concerts/season www.bird-watching.co.uk/species/heron parliament.example.org/laws/88 blog.garden.example.net/es/533 library.example.org/de/12
www.university.example.com/research/4 m.history.example.com/en/474.html news.example.org/en/685 docs.thermal.example.net/guide/770 www.theatre.example.org/fr/3847 blog.station.example.com/de/9290.html
en.wikipedia.org/wiki/Probability_theory www.poetryfoundation.org/poems/46569 www.metmuseum.org/art/collection/search/436535 www.fao.org/3/ca8753en www.mayoclinic.org/diseases-conditions/diabetes www.nhs.uk/conditions/asthma
www.tagesschau.de/inland/wahl www.rfi.fr/fr/afrique www.rtve.es/noticias/ciencia www.smithsonianmag.com/history/rome www.britannica.com/animal/whale www.nationalgeographic.com/animals/article/wolves
m.thrift-notes.example.org/en/2 www.then-and-now.example.com/en/31 blog.renation.example.com/fr/900 tidings.example.net/en/5""".split()


def bucket(gram: str) -> int:
    h = 0
    for c in gram:
        h = h * 257 + ord(c)
    return h % BUCKETS


def grams(text: str) -> list[int]:
    return [bucket(text[i : i + N]) for i in range(len(text) - N + 1)]


@lru_cache(maxsize=4)
def fit(block: tuple[str, ...] = tuple(BLOCK), allow: tuple[str, ...] = tuple(ALLOW)) -> tuple[tuple[int, ...], int]:
    """Weights of the buckets and the bias, in millionths; an n-gram counts by its share of the URL's n-grams.

    The bias is the log odds of the table's labels: what is known of a URL without n-grams.
    """
    rows = [(grams(u), 1.0) for u in block] + [(grams(u), 0.0) for u in allow]
    w, bias = [0.0] * BUCKETS, math.log(max(1, len(block)) / max(1, len(allow)))
    for _ in range(STEPS):
        slope = [DECAY * v for v in w]
        for found, label in rows:
            z = bias + sum(w[b] for b in found) / max(1, len(found))
            miss = (1 / (1 + math.exp(-z)) - label) / len(rows)
            for b in found:
                slope[b] += miss / len(found)
        w = [a - RATE * g for a, g in zip(w, slope, strict=True)]
    return tuple(round(v * SCALE) for v in w), round(bias * SCALE)


def blocks(url: str, block: tuple[str, ...], allow: tuple[str, ...]) -> bool:
    """The verdict of host and path by a model of these labelled URLs."""
    weights, bias = fit(block, allow)
    found = grams(url)
    return sum(weights[b] for b in found) + max(1, len(found)) * bias > 0


def held_out_accuracy(folds: int = 5) -> tuple[float, float]:
    """Shares of the blocked and of the allowed URLs that models of the other folds judge rightly."""
    right = [0, 0]
    for k in range(folds):
        known = [tuple(u for i, u in enumerate(x) if i % folds != k) for x in (BLOCK, ALLOW)]
        right[0] += sum(blocks(u, *known) for u in BLOCK[k::folds])
        right[1] += sum(not blocks(u, *known) for u in ALLOW[k::folds])
    return right[0] / len(BLOCK), right[1] / len(ALLOW)


def _ordered() -> list[tuple[str, str, str, str]]:
    return sorted(((v, h, p, f"{h}{p}") for v, h, p in RULES), key=lambda r: -len(r[3]))


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, value: int) -> Column:
    """Field of the longest rule that fits; null if none does."""
    out = None
    for rule in _ordered():
        _, h, p, _ = rule
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, rule[value]) if out is None else out.when(fits, rule[value])
    return out


def model_score(text: Column) -> Column:
    """Sum of n-gram weights plus n-grams times the bias, in millionths: above 0 means block."""
    weights, bias = fit()
    table = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    codes = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    joined = F.struct(codes.alias("c"), table.alias("w"))

    def total(x: Column) -> Column:
        n = F.greatest(F.size(x["c"]) - (N - 1), F.lit(0))
        place = lambda i: ((F.get(x["c"], i) * 257 + F.get(x["c"], i + 1)) * 257 + F.get(x["c"], i + 2)) % BUCKETS
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, i: a + F.get(x["w"], place(i).cast("int"))) + F.greatest(n, F.lit(1)) * F.lit(bias)

    return F.element_at(F.transform(F.array(joined), total), 1)


def url_filters(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; input columns of these names (in any case) give way."""
    host, path = fresh(pages.columns, "h"), fresh(pages.columns, "p")
    new = {"host", "path", "rule", "verdict"}
    rest = [c for c in pages.columns if c.lower() not in new]
    cut = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    h, p = F.col(host), F.col(path)
    model = F.when(model_score(F.concat(h, p)) > 0, "block").otherwise("allow")
    return cut.select(*rest, h.alias("host"), p.alias("path"), first_rule(h, p, 3).alias("rule"), F.coalesce(first_rule(h, p, 0), model).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return url_filters(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_sql() -> str:
    weights, bias = fit()
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    pick = lambda k: " ".join(f"WHEN {fits(r[1], r[2])} THEN '{r[k]}'" for r in _ordered())
    return f"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), coded AS (
  SELECT *, list_transform(string_split(host || path, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS c, greatest(length(host || path) - {N - 1}, 0) AS n FROM cut
), scored AS (
  SELECT *, coalesce(list_sum(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: {list(weights)}[CAST(((c[i] * 257 + c[i + 1]) * 257 + c[i + 2]) % {BUCKETS} AS BIGINT) + 1])), 0) + greatest(n, 1) * ({bias}) AS z FROM coded
)
SELECT page_id, host, path, CASE {pick(3)} END AS rule,
       CASE {pick(0)} WHEN z > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM scored"""
