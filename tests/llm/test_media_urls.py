import hashlib
import random
import struct
import zlib

import numpy as np

from quire.llm.media import FRAME, box, build, full, parse, store
from quire.llm.urls import RULES, Rules, Vocabulary, judge_urls, split_url


def test_store(docs, empty):
    want = {}
    for i, t in docs.select("doc_id", "text").collect():
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        want.setdefault(i, set()).add((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    rows = store(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[1:5]) in want[r[0]] and r.media_bytes == len(r.media) and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and r.codec == "raw "
        assert b"".join(bytes(r.media)[a:b] for a, b in r.keyframe_ranges)[: r.n_bytes] == bytes(r.media)[-r.payload_bytes :][: r.n_bytes]
    assert store(empty).collect() == []


def test_parse_tables():
    """Several chunk runs, sizes of each sample, a sync table, 64-bit offsets, a large box and a box inside unknown order."""
    sizes, payload = [5, 7, 11, 13, 17, 19], bytes(range(72))
    stbl = lambda at: box(b"stbl",
        full(b"stss", struct.pack(">III", 2, 1, 4)), full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(20))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 4, 20)),
        full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 3, 2, 1)[:28]), full(b"stsz", struct.pack(">II", 0, 6), struct.pack(">6I", *sizes)), full(b"co64", struct.pack(">I4Q", 4, at, at + 5, at + 12, at + 36)))
    mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 600, 0, 0, 0), version=1)
    moov = lambda at: box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", stbl(at)))))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    media = box(b"free", b"xx") + moov(0)
    at = len(media) + 16
    media = box(b"free", b"xx") + moov(at) + mdat
    (t,) = parse(media)
    assert (t["codec"], t["kind"], t["timescale"], t["duration"], t["n_samples"]) == ("avc1", "vide", 600, 100, 6)
    assert (t["keyframes"] - at).tolist() == [[0, 5], [23, 36]]


def test_damaged():
    r, good = random.Random(4), build(b"x" * FRAME * 3)
    for _ in range(400):
        b = bytearray(good)
        for _ in range(r.randint(1, 6)):
            b[r.randrange(len(b))] = r.randrange(256)
        parse(bytes(b[: r.randint(0, len(b))]))
    assert parse(b"") == [] and np.array_equal(parse(good)[0]["ranges"], [[len(good) - 3 * FRAME, len(good)]])


def test_urls(spark):
    cases = [
        ("https://a.example.org/en/12?x", "a.example.org", "/en/12", "example.org/en/1", "block"), ("http://x.example.org/es/1#y", "x.example.org", "/es/1", "example.org/es/", "block"),
        ("http://B.Example.ORG/de/1", "b.example.org", "/de/1", "org/", "allow"), ("http://x.com/fr/casino/poker", "x.com", "/fr/casino/poker", "com/fr/", "allow"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com/DE/", "x.com", "/DE/", None, "allow"), ("http://org", "org", "", None, "allow"), ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"), (None, "", "", None, "allow"), ("x.org/a", "", "", None, "allow"),
        ("http://?a", "", "", None, "allow"), ("http://a.net/porn", "a.net", "/porn", None, "block"), ("http://a.net/popcorn", "a.net", "/popcorn", None, "allow"), ("http://poker.net/a-casino?q", "poker.net", "/a-casino", None, "block"),
        ("http://poker.net/poker", "poker.net", "/poker", None, "allow"), ("", "", "", None, "allow"),
        ("http://a.net/éporn", "a.net", "/éporn", None, "block"), ("http://a.net/porn²", "a.net", "/porn²", None, "block"), ("http://a.net/pornö", "a.net", "/pornö", None, "block"), ("http://a.net/porn1", "a.net", "/porn1", None, "allow"),
        ("http://a.net/" + "x/" * 100_000 + "porn", "a.net", "/" + "x/" * 100_000 + "porn", None, "block"),
    ]
    pages = spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(cases)] + [(None, None, None)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases] and got[None] == ("", "", None, "allow")
    assert judge_urls(pages.limit(0)).collect() == []
    assert judge_urls(pages.where("page_id = 0").unionAll(pages.where("page_id = 0"))).count() == 2


def test_rules_brute():
    r = random.Random(8)
    rules = [(r.choice(["allow", "block"]), ".".join(r.choice("ab") for _ in range(r.randint(1, 3))) + "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3)))) for _ in range(30)]
    f = Rules(rules)
    for _ in range(500):
        host, path = ".".join(r.choice("ab") for _ in range(r.randint(1, 4))), "/" + "".join(r.choice("xy/") for _ in range(4))
        fits = [(len(x), len(x.split("/")[0]), v == "block", x, v) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        want = max(fits)[3:] if fits else (None, None)
        got = f(host, path)
        assert got == want or got[1] == want[1] and len(got[0]) == len(want[0])
    assert Rules(RULES)("", "/") == (None, None) and Vocabulary((), {}, 1)("a", "/b") == ("allow", 0, 0) and split_url("http://A/b?c") == ("a", "/b")
