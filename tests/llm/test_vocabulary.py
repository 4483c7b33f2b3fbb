from quire.llm.urls import RULES, SOFT, SOFT_LIMIT, STRICT, Rules, Vocabulary, split_url

#: Written after the terms; three clean ones then led to lower weights of general terms, so LATER was written after that.
BAD = (
    "luckyspin.net/casino/bonus", "royalslots.biz/roulette/online", "betworld.info/sports/betting-odds", "tips.example.info/free-bets", "m.casino-win.net/", "pokerroom.io/poker/bonus/now", "jackpot-city.net/slots", "bingo.net/online-bingo/win",
    "lotto.biz/lottery-winners", "gambling.info/casinos", "x-videos.net/free-sex-videos", "tube.biz/hot-girls/nude", "escort.city/escorts/girls", "live.cams.net/sex-chat", "a.net/adult-x", "dating.biz/adult-dating", "b.biz/xxx/1", "c.net/hentai/page/2",
    "nudes.biz/celebrity/naked", "pics.net/erotic-pics", "meds.biz/cheap-pills", "rx.net/buy-viagra-online", "pharma.biz/pharmacy/generic", "shop.net/order-xanax-now", "diet.biz/diet-pills", "d.net/cialis", "spam-farm.net/", "seo.biz/buy-backlinks",
    "soft.biz/crack-serial", "torrents.biz/movie-torrent", "files.net/keygen/app", "loans.biz/payday-loans", "watches.biz/replica/cheap-replicas",
)
CLEAN = (
    "city.gov/adult-education/free", "school.edu/sex-education", "paper.com/news/casino-royale-review", "zoo.net/polar-bears", "blog.net/popcorn/recipes", "essex.ac.uk/middlesex/history", "farm.net/organic-farms/visit", "shop.com/cheap-flights/online",
    "team.com/how-to-win", "radio.net/live", "health.org/pills/safety", "docs.net/spam-filter/setup", "mail.net/spam-free", "linux.org/torrent", "math.edu/odds-and-probability", "games.com/chess/best-bets", "paint.net/nude-museum", "scunthorpe.gov.uk/council",
    "bank.com/loans/home", "hospital.org/prescription/order", "law.net/gambling-law/online", "video.net/free-video-download", "pets.com/naked-mole-rat", "wall.com/crack-repair", "a.com/x/y", "bets.com/about", "news.com/lottery/history", "school.edu/teens",
    "expertsexchange.com/q/1", "therapist.net/finder", "dickens.org/works", "cheap.com/hot-deals", "shop.com/buy-now/offers", "webcam.org/volcano", "seo.com/guide", "dating.org/radiocarbon", "bingo.org/hall", "poker.net/rules",
)
LATER_BAD = (
    "win-big.biz/casino-games/bonus", "spinpalace.net/slots/free-spins", "betting-tips.net/odds", "poker-bonus.net/", "lotto-winner.biz/", "camgirls.net/live", "hot-babes.net/nude", "sexy-teens.net/", "hookup.net/singles/dating", "porno.net/v/1",
    "cheap-meds.biz/xanax", "pills-online.net/", "kamagra.biz/", "replica-watches.biz/buy", "warez.net/dl", "crack.net/serials/office", "spammers.net/link-farm", "payday-loans.net/fast-cash",
)
LATER_CLEAN = (
    "uni.edu/library/adult-learners", "news.com/politics/sex-discrimination", "gov.uk/gambling-commission", "travel.com/las-vegas/hotels/deals", "health.gov/steroids", "shop.com/toys/slots-cars", "kernel.org/patch/serial", "sports.com/win/loss/odds",
    "art.org/nude/renaissance", "garden.com/hot-peppers/cheap-seeds", "phone.com/webcam/setup", "bank.com/loan/calculator", "wiki.net/roulette", "bbc.co.uk/live/video", "movie.com/x-men", "cafe.com/free-coffee/offers", "tax.gov/cash/deposit", "medic.com/pharmacy/hours",
)


def test_held_out():
    words = Vocabulary(STRICT, SOFT, SOFT_LIMIT)
    blocked = lambda u: words(*split_url(f"http://{u}"))[0] == "block"
    for bad, clean in ((BAD, CLEAN), (LATER_BAD, LATER_CLEAN)):
        missed, lost = [u for u in bad if not blocked(u)], [u for u in clean if blocked(u)]
        print(missed, lost)
        assert len(missed) <= 0.2 * len(bad) and len(lost) <= 0.06 * len(clean), (missed, lost)
    assert len(set(SOFT.values())) > 4 and all(t.isalnum() and t == t.lower() and t.isascii() for t in (*STRICT, *SOFT)) and not set(STRICT) & set(SOFT)


def test_pages(spark):
    """Where no rule fits, pages of bad hosts are blocked and others are not."""
    rules, words = Rules(RULES), Vocabulary(STRICT, SOFT, SOFT_LIMIT)
    urls = [split_url(r.url) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    urls = [u for u in urls if rules(*u)[0] is None]
    bad = [any(h in host for h in ("casino-win", "free-bets", "spam-farm", "cheap-pills", "adult-x")) for host, _ in urls]
    got = [words(*u)[0] == "block" for u in urls]
    assert sum(bad) == 85 and got == bad
