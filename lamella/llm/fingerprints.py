"""Document fingerprints by order MinHash, in DataFrame functions only.

The k-mers of a text (two tokens; a token is a run of at most eight characters without white space, and each eight
characters, at every position, of a longer run) are numbered by occurrence, hashed, and spread over BINS by their hash. In each bin the TUPLE smallest stay, in text order, and their
tuple is hashed: two texts agree in a bin only if the same k-mers are smallest there and stand in the same order, so
likeness falls with edits and with moves. One hash over bins stands for as many hash functions.

Each text is one row and one linear number of array operations; nothing is exploded. For the query, neighbours by id
come from one shuffle of the texts into ranges of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, read

_CHAR = r"[^\x20\x09-\x0D]"
#: Group 1 is the token, one a match; a match takes one character, so that those of a long run overlap.
TOKEN = rf"(?=({_CHAR}{{8}}|(?<!{_CHAR}){_CHAR}{{1,7}}(?!{_CHAR}))){_CHAR}"
BINS = 64
TUPLE = 2
#: Bits of a packed integer: the position in the text below, the k-mer's hash above.
_POS, _HASH = 30, 33
_BIN = _POS + _HASH - 6


def _occurrence(s: Column, x: Column, i: Column) -> Column:
    """How many equal hashes precede entry i of the sorted array s; by bisection where it is two or more."""
    key = lambda j: F.shiftright(F.get(s, j), _POS)
    own = F.shiftright(x, _POS)
    start = F.struct(F.lit(0).alias("lo"), i.alias("hi"))

    def halve(r: Column, _: Column) -> Column:
        middle = F.shiftright(r["lo"] + r["hi"], 1)
        return F.when(r["lo"] >= r["hi"], r).when(key(middle) < own, F.struct((middle + 1).alias("lo"), r["hi"].alias("hi"))).otherwise(F.struct(r["lo"].alias("lo"), middle.alias("hi")))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(_POS + 1)), start, halve)["lo"]
    return F.when((i < 1) | (key(i - 1) != own), 0).when((i < 2) | (key(i - 2) != own), 1).otherwise(i - first)


def signature(text: Column) -> Column:
    """array<long>: for each bin that isn't empty, bin * 2^32 + the 32-bit hash of its tuple, by bin.

    A text without tokens has one entry that stands for the text itself. Equal texts have equal signatures.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    kmers = let(tokens, lambda t: F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.transform(t, lambda a: F.xxhash64(a))))
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    ordered = F.sort_array(F.transform(kmers, lambda h, i: F.shiftleft(low(h, _HASH), _POS).bitwiseOR(i.cast("long"))))

    def place(s: Column) -> Column:
        hashed = lambda x, i: F.shiftrightunsigned(F.xxhash64(F.shiftright(x, _POS), _occurrence(s, x, i)), 64 - _HASH)
        return F.sort_array(F.transform(s, lambda x, i: F.shiftleft(hashed(x, i), _POS).bitwiseOR(low(x, _POS))))

    bin_of = lambda x: F.shiftright(x, _BIN)
    smallest = let(let(ordered, place), lambda r: F.filter(r, lambda x, i: (i < TUPLE) | (bin_of(F.get(r, i - TUPLE)) != bin_of(x))))

    def tuples(g: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            y = F.get(g, i + 1)
            a, b = F.shiftright(x, _POS), F.when(bin_of(y) == bin_of(x), F.shiftright(y, _POS))
            pair = F.when(b.isNull(), F.xxhash64(a)).when(low(x, _POS) < low(y, _POS), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
            first = (i < 1) | (bin_of(F.get(g, i - 1)) != bin_of(x))
            return F.when(first, F.shiftleft(bin_of(x), 32).bitwiseOR(low(pair, 32)))

        return F.filter(F.transform(g, entry), lambda e: e.isNotNull())

    bare = F.array(F.shiftleft(F.lit(BINS).cast("long"), 32).bitwiseOR(low(F.xxhash64(text), 32)))
    return let(let(smallest, tuples), lambda e: F.when(F.size(e) > 0, e).otherwise(bare))


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either signature in which both agree, 0 to 1."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row; a null text counts as empty. An empty table gives none."""
    return docs.select(F.col(id_col).alias("doc_id"), as_text(signature(F.coalesce(F.col(text_col), F.lit("")))).alias("fingerprint"))


def _bisect(values: list[int], x: Column) -> Column:
    """How many of the sorted values are not above x (null: none)."""
    if not values:
        return F.lit(0)
    table = F.array(*[F.lit(v).cast("long") for v in values])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(values)).alias("hi"))

    def halve(r: Column, _: Column) -> Column:
        middle = F.shiftright(r["lo"] + r["hi"], 1)
        up = F.get(table, middle) <= x
        return F.when(r["lo"] >= r["hi"], r).when(up, F.struct((middle + 1).alias("lo"), r["hi"].alias("hi"))).otherwise(F.struct(r["lo"].alias("lo"), middle.alias("hi")))

    return F.when(x.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(len(values).bit_length() + 1)), start, halve)["lo"])


def with_next(rows: DataFrame, columns: list[str], group: int = 1000, most_groups: int = 20_000) -> DataFrame:
    """rows with next_<column> of the next row by doc_id (nulls first, equal ids by hash of _text); the last is followed by the first.

    Rows are shuffled once, into ranges of about group ids; the first row of a range goes to the range before, too, so
    that no range needs another. Only the ranges' first ids come to the driver.
    """
    ids = rows.select("doc_id")
    n, nulls = ids.agg(F.count(F.lit(1)), F.sum(F.col("doc_id").isNull().cast("int"))).first()
    n_ranges = max(1, min(most_groups, n // group))
    cuts: list[int] = []
    if n_ranges > 1:
        rough = ids.agg(F.percentile_approx("doc_id", [i / n_ranges for i in range(1, n_ranges)], max(10_000, 4 * n_ranges))).first()[0]
        cuts = sorted(r[0] for r in ids.where("doc_id is not null").groupBy(_bisect(sorted(set(rough)), F.col("doc_id"))).agg(F.min("doc_id")).select("min(doc_id)").collect())
    else:
        cuts = [x for x in ids.agg(F.min("doc_id")).first() if x is not None]
    first = None if nulls or not cuts else cuts[0]
    cuts = cuts[1:]
    at = _bisect(cuts, F.col("doc_id"))
    copies = F.array(F.struct(F.col("_at").alias("range"), F.lit(0).alias("turn")))
    opens = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    copies = F.concat(
        copies,
        F.when((F.col("_at") > 0) & (F.col("doc_id") == F.get(opens, F.col("_at") - 1)), F.array(F.struct((F.col("_at") - 1).alias("range"), F.lit(1).alias("turn")))).otherwise(F.array().cast("array<struct<range:int,turn:int>>")),
        F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("long")), F.array(F.struct(F.lit(len(cuts)).alias("range"), F.lit(2).alias("turn")))).otherwise(F.array().cast("array<struct<range:int,turn:int>>")),
    )
    spread = rows.withColumn("_at", at).withColumn("_copy", F.explode(copies))
    order = W.partitionBy("_copy.range").orderBy("_copy.turn", F.asc_nulls_first("doc_id"), F.xxhash64("_text"))
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return spread.select(*rows.columns, "_copy", *following).where("_copy.turn = 0").drop("_copy")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike each is to its edit and its successor."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = with_next(rows.withColumn("_sig", signature(F.col("_text"))), ["_text", "_sig"])
    n, q = F.length("_text"), F.floor(F.length("_text") / 4).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), n - q), F.col("next__text").substr(F.lit(1), q))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "_sig", "next__sig", edited.alias("_edited"))
    rows = rows.select("doc_id", "n_chars", "_sig", "next__sig", F.sha2("_edited", 256).alias("edited_sha256"), signature(F.col("_edited")).alias("_esig"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_sig")).alias("fingerprint"), as_text(F.col("_esig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_esig")).alias("near_edited"), likeness(F.col("_sig"), F.col("next__sig")).alias("near_next"),
    )
