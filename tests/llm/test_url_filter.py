"""URL filters: the query against a plain version, and what the model makes of hosts near to its words and far from them."""

import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import url_filter
from veilspark.llm.queries import op1_url_filters

UNSEEN_BAD = (
    "royalcasinos.com megapokerroom.net rouletteonline.de slotmachines.co.uk blackjacktable.io jackpotparty.com lotterywinners.org sportsbetting.eu gamblingtips.info bookmakers.co.uk "
    "buyviagra.biz cheapcialis24.com dietpillshop.com pharmacy4u.net steroidstore.ru pornvideos.tv xxxmovies.cc sexdating.de adultfilms.fr escortservice.at nudepics.com hentaimanga.jp "
    "paydayloans.co quickloans.uk debtrelief.biz ponzicoin.io forextrading.club warezforum.to torrentz.eu keygens.ws crackz.ru gamecheats.com spammers.biz scammail.info phishingkit.cc "
    "malwaredrop.xyz replicawatches.cn counterfeits.shop adserver2.net adclicks.com popadsnet.com bannersexchange.net trackers.link"
).split()
UNSEEN_GOOD = (
    "bbc.co.uk arxiv.org stackoverflow.com a.io x.dev wikipedia.org nytimes.com mozilla.org apache.org spiegel.de lemonde.fr elpais.es guardian.co.uk mit.edu stanford.edu nasa.gov who.int "
    "europa.eu amazon.com ebay.de booking.com openstreetmap.org reddit.com medium.com nature.com sciencedirect.com springer.com ieee.org acm.org w3.org ietf.org debian.org ubuntu.com gnu.org "
    "oracle.com ibm.com intel.com siemens.de bmw.de sncf.fr renfe.es bahn.de airbnb.com spotify.com netflix.com imdb.com discogs.com bandcamp.com flickr.com dropbox.com slack.com zoom.us "
    "paypal.com stripe.com visa.com ups.com dhl.de fedex.com usps.gov nhs.uk cdc.gov redcross.org unicef.org amnesty.org greenpeace.org ikea.com lego.com nintendo.co.jp toyota.jp tata.in "
    "infosys.com flipkart.com naver.com baidu.cn yandex.ru vk.com wordpress.com blogger.com tumblr.com etsy.com shopify.com squarespace.com duolingo.com coursera.org edx.org khanacademy.org "
    "britannica.com merriam-webster.com goodreads.com gutenberg.org"
).split()


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule_of(host, path):
    fit = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0] + r[1])) if fit else None


def buckets(host, path):
    """The hash of a number and then of a text that goes on from it, as DataFrames have it."""
    seeds = [xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42) for k in (0, 1)]
    out = []
    for seed, t in zip(seeds, (f"^{host}$", f"^{path}$")):
        for n in url_filter.GRAMS:
            hashes = [xxhash.xxh64_intdigest(t[i : i + n].encode(), seed=seed) for i in range(len(t) - n + 1)]
            out += [(h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS for h in hashes]
    return out


def features(rows):
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for i, (h, p) in enumerate(rows):
        own = buckets(h, p)
        np.add.at(x[i], own, 1 / np.sqrt(max(len(own), 1)))
    return x


def test_query_is_the_plain_version(spark):
    """Rules, and the regression trained by the same steps with numpy."""
    rows = url_filter.labelled_rows()
    assert len(rows) <= url_filter.MOST
    x, y = features([r[:2] for r in rows]), np.array([r[2] for r in rows], float)
    k, now, before = x @ x.T + 1, np.zeros(len(rows)), np.zeros(len(rows))
    for step in range(url_filter.STEPS):
        ahead = now + step / (step + 3) * (now - before)
        now, before = ahead * (1 - url_filter.RATE * url_filter.DECAY) + url_filter.RATE * (y - 1 / (1 + np.exp(-k @ ahead))), now
    w, b = x.T @ now, now.sum()
    sf = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op1_url_filters(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        host, path = host_and_path(urls[r.page_id])
        rule = rule_of(host, path)
        p = float(1 / (1 + np.exp(-(features([(host, path)])[0] @ w + b))))
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert abs(r.p_block - p) < 1e-6 and r.verdict == (rule[2] if rule else "block" if p >= url_filter.BLOCK_AT else "allow")


#: Hosts to block that no word of the labelled table is part of, and others that look like its blocked words.
FAR_BAD = (
    "bet365.com thepiratebay.org botnet-for-hire.ru xanax-online.biz onlyfans-leaks.tv rummycircle.win 1xbet.co hotgirlsnearyou.com quickcashnow.biz wonderbingo.uk stakehub.io tramadol-direct.ru "
    "fastlose-weight.shop getrichquick.club hackedaccounts.su nulledscripts.to clickfraud.biz luckyspin.vip"
).split()
NEAR_GOOD = (
    "crackerbarrel.com tracker.debian.org cracked.com nudelholz.de adulteducation.gov.uk debtcounselling.org essex.gov.uk sussex.ac.uk middlesexhospital.nhs.uk scampi-recipes.com alphabetsoup.edu "
    "slotcarracing.org pillsbury.com bannerman.ac.uk betsyross.org lotteryfund.org.uk spamassassin.apache.org cheatgrass.org"
).split()


def test_model_knows_words_and_no_more(spark):
    """Names around its blocked words are blocked and plainly other ones let through. It is a model of these words: hosts of
    other words pass, and ones that only look like them are blocked; the shares are measured, and README states them."""
    words = set(url_filter.BLOCKED) | set(url_filter.ALLOWED)
    assert not any(w in h for h in FAR_BAD for w in words) and sum(any(w in h for w in url_filter.BLOCKED) for h in UNSEEN_BAD) == len(UNSEEN_BAD) - 1
    groups = {"near bad": UNSEEN_BAD, "far good": UNSEEN_GOOD, "far bad": FAR_BAD, "near good": NEAR_GOOD}
    df = spark.createDataFrame([(g, f"https://{h}/{p}") for g, hosts in groups.items() for h in hosts for p in ("", "x/1.html")], "g string, url string")
    share = {r.g: r.share for r in url_filter.judged(df, rules=()).groupBy("g").agg(F.avg((F.col("verdict") == "block").cast("int")).alias("share")).collect()}
    assert share["near bad"] >= 0.9 and share["far good"] <= 0.05
    assert share["far bad"] < 0.5 < share["near good"]  # what it can't do: to be raised and lowered by a better table


def test_longest_rule_and_ties_on_both_paths(spark):
    """Of equally long rules the first holds, whether rules are cases of an expression or a table."""
    own = (("a.b.c", "/d", "block"), ("b.c", "/def", "allow"), ("c", "/", "block"), ("b.c", "/de", "allow"))
    many = tuple((f"h{k}.net", "/", "block") for k in range(url_filter.CASES + 50))
    df = spark.createDataFrame([("http://a.b.c/def",), ("http://x.b.c/def",), ("http://b.c/dex",), ("http://h7.net/",), ("http://z.c/",), ("http://other.org/",)], "url string")
    for rules in (own, own[::-1]):
        want = {"http://a.b.c/def": rule_at("a.b.c", "/def", rules), "http://x.b.c/def": "b.c/def", "http://b.c/dex": "b.c/de", "http://z.c/": "c/", "http://other.org/": None}
        for extra in ((), many):
            got = {r.url: r.rule for r in url_filter.judged(df, rules=rules + extra).collect()}
            assert got == want | {"http://h7.net/": "h7.net/" if extra else None}


def rule_at(host, path, rules):
    fit = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=len)


def test_odd_rows(spark):
    long = "http://h.com/" + "a" * 200000
    rows = [(1, None, "h", "p", 9), (1, None, "h", "p", 9), (2, "", "h", "p", 9), (3, long, "h", "p", 9), (None, "http://a.com/en/", "h", "p", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, _w int")
    got = url_filter.judged(df).collect()
    assert len(got) == 5 and {(r.host, len(r.path)) for r in got} == {("", 0), ("h.com", 200001), ("a.com", 4)} and all(r._w == 9 for r in got)
    assert url_filter.judged(df.limit(0)).count() == 0
    untaught = url_filter.judged(df, known=spark.createDataFrame([], "host string, path string, y int"))
    assert {r.p_block for r in untaught.select(F.round("p_block", 6).alias("p_block")).collect()} == {0.5}
