"""Document fingerprints by Order MinHash, in DataFrame functions only (operator 3).

Words of a text (white space parts them; runs over 16 characters are cut) form k-mers of `k` words; each is numbered by its occurrence in the text. One hash orders all numbered k-mers and deals them into
`bins`; in a bin the two least stay, are put back in text order, and the pair is hashed. Two fingerprints are alike in the share of bins with equal pairs, among bins that either fills; as
pairs keep the order of words and their numbers, that falls with edit distance and not only with overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A packed k-mer: 35 bits of hash over 28 bits of position, so that sorting longs sorts by hash.
_POS_BITS = 28
_POS = (1 << _POS_BITS) - 1
_HASH = ((1 << 35) - 1) << _POS_BITS
_STEPS = [1 << s for s in range(27, -1, -1)]


def _agree(a: Column, b: Column, bits: int) -> Column:
    """Are two packed k-mers equal above so many low bits? Null if one is null."""
    return a.bitwiseXOR(b) < F.lit(1 << bits)


def _seen_before(s: Column, x: Column, i: Column) -> Column:
    """How many entries before place i of the sorted array s have the hash of x, found by halving."""
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda n, d: F.when(_agree(F.get(s, i - n - d), x, _POS_BITS), n + d).otherwise(n))


def signature(df: DataFrame, text: str, out: str, k: int = 2, bins: int = 32) -> DataFrame:
    """df with `out`: for each filled bin its number and 27 bits of its pair's hash in one long, in order of bins (a power of two, 32 at most). A null text has no k-mers, and one of fewer than k words has one, of all its words."""
    digits = bins.bit_length() - 1
    w, a, b = f"{out}_w", f"{out}_a", f"{out}_b"
    df = df.withColumn(w, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0)))
    n = F.size(w) - (k - 1)
    mers = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(k))).bitwiseAND(F.lit(_HASH)).bitwiseOR(i.cast("long")))
    df = df.withColumn(a, F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.sort_array(mers)))
    # a k-mer's first occurrence keeps its hash; a later one is hashed with its number
    again = lambda x, i: F.xxhash64(x.bitwiseAND(F.lit(_HASH)), _seen_before(F.col(a), x, i)).bitwiseAND(F.lit(_HASH)).bitwiseOR(x.bitwiseAND(F.lit(_POS)))
    numbered = F.transform(F.col(a), lambda x, i: F.when(_agree(F.get(F.col(a), i - 1), x, _POS_BITS), again(x, i)).otherwise(x))
    df = df.withColumn(b, F.sort_array(numbered)).drop(w, a)
    # sorted by hash, so a bin's entries are neighbours; its first two stay
    low = 63 - digits
    least = F.filter(F.col(b), lambda x, i: F.when(_agree(F.get(F.col(b), i - 2), x, low), F.lit(False)).otherwise(F.lit(True)))

    def pair(x: Column, y: Column) -> Column:
        p, q = F.shiftright(x, _POS_BITS), F.shiftright(y, _POS_BITS)
        h = F.when(~F.coalesce(_agree(x, y, low), F.lit(False)), F.xxhash64(p)).when(x.bitwiseAND(F.lit(_POS)) < y.bitwiseAND(F.lit(_POS)), F.xxhash64(p, q)).otherwise(F.xxhash64(q, p))
        return F.shiftleft(F.shiftright(x, low), 27).bitwiseOR(h.bitwiseAND(F.lit((1 << 27) - 1)))

    # what a lambda reads many times is bound once, as the element of an array of one; a bin's second entry gives null
    entries = lambda t: F.transform(t, lambda x, i: F.when(_agree(F.get(t, i - 1), x, low), F.lit(None)).otherwise(pair(x, F.get(t, i + 1))))
    return df.withColumn(out, F.transform(F.array(least), lambda t: F.array_compact(entries(t)))[0]).drop(b)


def shown(sig: Column) -> Column:
    """A signature as text: 8 hex digits for each filled bin."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bins among those that either text fills; two texts without words are alike (1)."""
    known = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftright(x, 27))))
    return F.when(known == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / known)


def edit_fingerprints(docs: DataFrame, k: int = 2, bins: int = 32) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row.

    docs: doc_id, text. The edited text is the text with its last floor(n_chars / 4) code points replaced by as many of the next document's first ones, or all of them; next is by
    rising doc_id, the first follows the last, and a single document follows itself. A null text is empty, and two texts without words are alike (1). A null doc_id sorts first. Rows that share a
    doc_id all have the same next document, the one of the next greater id, and where several rows have that id, its least text is next. An empty table gives an empty table.
    """
    base = signature(docs.selectExpr("doc_id", "coalesce(text, '') text"), "text", "sig", k, bins)
    # a null id sorts first: it gets a key of its own, below all ids
    keyed = base.selectExpr("struct(doc_id is not null given, coalesce(doc_id, 0L) id) key", "text", "sig")
    keys = docs.selectExpr("struct(doc_id is not null given, coalesce(doc_id, 0L) id) key", "char_length(coalesce(text, '')) n")
    ids = keys.groupBy("key").agg(F.max("n").alias("n"))
    follow = _follow(ids)
    first = keyed.join(follow, keyed["key"] == follow["next"]).selectExpr("follow_key", "left(text, m) head", "sig")
    heads = first.groupBy("follow_key").agg(F.min(F.struct("head", "sig")).alias("h"))
    both = keyed.join(heads, keyed["key"] == heads["follow_key"]).selectExpr("key", "text", "sig", "char_length(text) n_chars", "h")
    both = both.selectExpr("key", "n_chars", "sig", "h.sig next_sig", "concat(left(text, n_chars - n_chars div 4), left(h.head, n_chars div 4)) edited")
    both = signature(both, "edited", "edited_sig", k, bins)
    return both.select(
        F.expr("if(key.given, key.id, null)").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("sig")).alias("fingerprint"), shown(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def _follow(ids: DataFrame) -> DataFrame:
    """(follow_key, next, m): the next key of each and how many code points of it are used.

    Keys are cut into ranges of about RANGE_ROWS by approximate quantiles, evenly within them. Within a range a window finds the next; the first key after a range comes from a table with one row for each range.
    """
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.min("key.id").alias("lo"), F.max("key.id").alias("hi"), F.percentile_approx(F.col("key.id"), [p / 64 for p in range(1, 64)], 2000).alias("cuts")).first()
    ranged = ids.withColumn("r", F.lit(0))
    if row["n"]:  # for one range too: a constant would make the join below a product
        cuts, n = sorted({row["lo"], *row["cuts"], row["hi"] + 1}), -(-row["n"] // RANGE_ROWS)
        case = "CASE WHEN NOT key.given THEN 0"
        for k in range(1, len(cuts)):
            lo, hi, first, end = cuts[k - 1], cuts[k], (k - 1) * n // (len(cuts) - 1), k * n // (len(cuts) - 1)
            case += f" WHEN key.id < {hi}L THEN {first} + CAST(floor(least((key.id - {lo}L) / {float(hi - lo)}D, 0.999999999D) * {max(1, end - first)}) AS INT)"
        ranged = ids.withColumn("r", F.expr(case + f" ELSE {n - 1} END"))
    edges = ranged.groupBy("r").agg(F.min("key").alias("first"))
    over = Window.orderBy("r")  # one row for each range
    edges = edges.select("r", F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("beyond"))
    out = ranged.withColumn("next", F.lead("key").over(Window.partitionBy("r").orderBy("key"))).join(edges, "r")
    return out.select(F.col("key").alias("follow_key"), F.coalesce("next", "beyond").alias("next"), F.expr("n div 4").alias("m"))


RANGE_ROWS = 20_000
