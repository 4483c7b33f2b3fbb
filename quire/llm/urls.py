"""URL filters: host and path rules, then a weighted vocabulary (operator 9).

Where no rule fits, one Aho-Corasick automaton finds all terms in the lower-cased host and path; a hit counts where neither neighbour is one of a-z and 0-9. One strict term blocks, as do
soft terms whose distinct weights add up to the limit; terms of harmless contexts weigh below zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: One of these rejects.
STRICT = tuple((
    "porn porno pornos pornography pornographic pornstar pornstars pornhub freeporn xxx xvideos xnxx xhamster redtube youporn brazzers hentai camgirl camgirls camsex sexcam sexcams sexchat sexshop "
    "milf milfs gangbang blowjob blowjobs cumshot cumshots creampie bukkake deepthroat bdsm upskirt incest nsfw onlyfans fuck fucking fucked pussy cunt handjob threesome "
    "viagra cialis levitra kamagra sildenafil tadalafil phentermine "
    "warez keygen keygens cracked nulled onlinecasino casinoonline casinobonus freespins pokerstars sportsbook sportsbooks"
).split())
#: Each with its weight; SOFT_LIMIT of weight over distinct terms rejects. Terms that speak against have a weight below zero.
SOFT = {term: weight for weight, terms in (
    (8, "backlinks bets betting pills nude nudes naked escort escorts erotic erotica fetish stripper strippers striptease slots roulette blackjack baccarat jackpot jackpots hookup hookups steroids xanax tramadol oxycodone ambien"),
    (7, "sex sexy casino casinos poker spam gambling gamble bookmaker bookmakers lottery lotto bingo torrent torrents weightloss payday replica replicas lesbian webcam webcams spammer spammers"),
    (5, "adult adults x bet wager wagers odds dating singles lingerie slut sluts babes amateur teens horny cam cams crack cracks serial serials pill pharmacy pharma drugstore prescription meds seo loans loan"),
    (3, "win wins winner winners winning bonus farm farms video videos tube pics spin spins hot girls vegas deposit wagering enlargement diet hoodia live chat link"),
    (2, "free cheap cheapest discount online buy order click now sale offer offers generic deals instant fast money cash download downloads guaranteed unlimited"),
    (-6, "education educational health healthcare university hospital clinic museum news law laws court policy research recovery addiction helpline prevention awareness equality rights biology filter filters antispam royale"),
) for term in terms.split()}
SOFT_LIMIT = 10
_LOWER = {c: c + 32 for c in range(65, 91)}
#: What may not stand beside a term.
_JOINED = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of what follows the first ://; both empty without it."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    cut = min((p for p in map(path.find, "?#") if p >= 0), default=len(path))
    return host.translate(_LOWER), path[:cut]


class Rules:
    """Rules by host; a url looks up its host and the domains above it. The longest rule wins; of equally long ones that with the longer host, then block."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((len(rule), len(host), verdict == "block", slash + path, verdict, rule))

    def __call__(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = None, 0
        while host:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r[3]) and (best is None or r[:3] > best[:3]):
                    best = r
            at = host.find(".", at) + 1
            if not at:
                break
        return (best[5], best[4]) if best else (None, None)


class Vocabulary:
    def __init__(self, strict, soft: Mapping[str, int], limit: int):
        self.limit, self.automaton = limit, ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, None if term in set(strict) else soft[term]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, host: str, path: str) -> tuple[str, int, int]:
        """The verdict, the number of strict hits and the weight of distinct soft terms."""
        text, strict, soft = (host + path).translate(_LOWER), 0, {}
        if len(self.automaton):
            for end, (term, weight) in self.automaton.iter(text):
                a, b = end - len(term), end + 1
                if (a < 0 or text[a] not in _JOINED) and (b == len(text) or text[b] not in _JOINED):
                    if weight is None:
                        strict += 1
                    else:
                        soft[term] = weight
        weight = sum(soft.values())
        return ("block" if strict or weight >= self.limit else "allow"), strict, weight


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft: Mapping[str, int] = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_weight) for each row of pages (page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's. A null url, or one without ://, has an empty host and path, fits no rule and is allowed. Rows are judged each for
    itself: repeated rows stay, and an empty table gives an empty table. The lists travel with the task; they are parameters, not data.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, words = Rules(rules), Vocabulary(strict, soft, limit)
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = fits(host, path)
                method, hits, weight = words(host, path)
                rows.append((host, path, rule, verdict or method, hits, weight))
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(cols, [pa.string()] * 4 + [pa.int64()] * 2, strict=True))], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_weight"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).mapInArrow(f, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_weight long")
