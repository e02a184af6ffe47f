"""Secret scans: base patterns, and character Markov models of random strings and ordinary identifiers.

Everything is a projection over each text: no shuffle of documents, no Python on executors. The only
aggregation is the training of two bigram tables on a bounded set of labelled samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, first_true, let, running, running_sum

#: In the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_CHARS = 20
_RUN = "[A-Za-z0-9+/_=-]"
#: A stretch of n characters needs a sum of ratios above the threshold of NEED - n, LEAST at least; it ends FALL below its peak.
NEED, LEAST, FALL = 28.0, 6.0, 8.0
#: A longer run is scored in parts of so many characters, the last a little longer.
LONGEST = 10_000
#: Spans of stretches are widened to these characters or the run's ends.
_PIECE = "^[^/=_-]*"

WORDS = """account action active address admin alert amount api archive array article asset async attribute audit author
backup balance bank base batch block body branch browser bucket buffer build button cache calendar call cancel card cart
category channel chart check child class client clock cluster code color column command comment commit common component
config connect container content context control cookie copy count create current customer daily data database date debug
default delete deploy description detail device dialog digest directory display document domain download draft driver
dynamic editor element email enable endpoint engine entry error event example export factory feature fetch field file
filter first folder footer form format frame function gateway global group guide handler hash header height helper history
host html http icon image import index info init input insert install instance integer internal invoice item java job join
json key kernel label language last layer layout length level library license limit line link list listener load local
location lock log login logo loop mail main manager map margin master match memory menu merge message meta method metric
mobile mode model module monitor mouse name network node note number object offset open operator option order output owner
package page panel parent parse partner pass patch path payment pending permission person phone picture pixel platform
player plugin point policy pool port position post prefix price primary print process product profile project property
protocol provider proxy public query queue random range rank rate reader record redirect region register release remote
render report request reset resource response result return review role root route row rule runtime sample save schema
scope score screen script search section select sender server service session setting shape shared signal simple size
skip socket sort source space stack stage start state status step storage store stream string style submit summary support
switch symbol sync system table tag target task team template test text theme thread ticket time title toggle token tool
topic total trace track transfer tree trigger type unique unit update upload user utility valid value vector vendor version
video view virtual visible volume wait warning watch widget width window worker wrapper write zone""".split()


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios (random over ordinary) of each pair of characters, and the mean that makes a secret."""

    ratios: tuple[float, ...]
    threshold: float = 0.5


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """n random strings (label 1; hex, base64, base62-like) and n ordinary identifiers (label 0), the same each time.

    Identifiers are one to five common words in snake, kebab, path, camel or constant form, a third with a number.
    """
    rows = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(digest))
    strong = F.element_at(F.array(F.substring(digest, 1, 40), raw, F.translate(raw, "+/=", "-_"), F.translate(raw, "+/=", "")), (F.col("id") % 4 + 1).cast("int"))
    bank = F.array(*map(F.lit, WORDS))
    pick = lambda i: F.element_at(bank, (F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))) + 1).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int")), pick)
    form = F.pmod(F.xxhash64(F.col("id"), F.lit("form")), F.lit(5))
    camel = F.array_join(F.transform(parts, lambda w, i: F.when(i > 0, F.initcap(w)).otherwise(w)), "")
    name = (
        F.when(form == 0, F.array_join(parts, "_")).when(form == 1, F.array_join(parts, "-")).when(form == 2, F.array_join(parts, "/"))
        .when(form == 3, camel).otherwise(F.upper(F.array_join(parts, "_")))
    )
    number = F.when(F.col("id") % 3 == 0, F.concat(F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("")), (F.col("id") % 7 % 3 + 1).cast("int")), F.pmod(F.xxhash64("id"), F.lit(2030)).cast("string"))).otherwise("")
    return rows.select(strong.alias("sample"), F.lit(1).alias("label")).unionAll(rows.select(F.concat(name, number), F.lit(0)))


def train(samples: DataFrame, threshold: float = 0.5, smoothing: float = 0.5) -> MarkovModel:
    """Bigram tables of both labels from samples (sample string, label 0 or 1); nulls and other labels count for nothing.

    Only the counts (at most 2 * 67 * 67) come to the driver.
    """
    chars = F.filter(F.split(F.col("sample"), ""), lambda c: (c != "") & (F.instr(F.lit(ALPHABET), c) > 0))
    pairs = F.zip_with(F.slice(F.col("c"), 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice(F.col("c"), 2, F.greatest(F.size("c"), F.lit(0))), lambda a, b: F.concat(a, b))
    rows = samples.where("label in (0, 1) and sample is not null").select("label", chars.alias("c")).select("label", F.explode(pairs).alias("p"))
    n = len(ALPHABET)
    counts = [[smoothing] * (n * n) for _ in range(2)]
    for r in rows.groupBy("label", "p").count().collect():
        counts[r["label"]][ALPHABET.index(r["p"][0]) * n + ALPHABET.index(r["p"][1])] += r["count"]
    ratios = []
    for a in range(n):
        ordinary, strange = (sum(counts[k][a * n : a * n + n]) for k in (0, 1))
        ratios += [round(math.log(counts[1][i] / strange) - math.log(counts[0][i] / ordinary), 3) for i in range(a * n, a * n + n)]
    return MarkovModel(tuple(ratios), threshold)


def least_chars(model: MarkovModel) -> int:
    """The shortest stretch that any string could pass with: shorter runs needn't be scored."""
    n, chars = len(ALPHABET), range(len(ALPHABET))
    best, length = [0.0] * n, 1
    while max(best) < max(LEAST, NEED - length) and length < MIN_CHARS:
        best = [max(best[a] + model.ratios[a * n + b] - model.threshold for a in chars) for b in chars]
        length += 1
    return length


def _steps(token: Column, model: MarkovModel) -> Column:
    """Log-likelihood ratio of each transition of a token of ALPHABET's characters."""
    table, n = F.array(*map(F.lit, model.ratios)), len(ALPHABET)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    rest = lambda c, at: F.slice(c, at, F.greatest(F.size(c) - 1, F.lit(0)))
    return let(codes, lambda c: F.zip_with(rest(c, 1), rest(c, 2), lambda a, b: F.element_at(table, (a - 1) * n + b)))


def mean_ratio(token: Column, model: MarkovModel) -> Column:
    """Mean log-likelihood ratio a transition of a token of ALPHABET's characters (0 for fewer than two)."""
    return let(_steps(token, model), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, r: s + r) / F.size(x)).otherwise(0.0))


def _need(n: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.lit(NEED) - n)


def _stretches(token: Column, steps: Column, model: MarkovModel) -> Column:
    """The stretches of a token that look random, widened to whole pieces, in order, those that meet as one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(
        F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("peak"), F.lit(0).alias("end"), none.alias("out"),
    )
    passes = lambda s: s["peak"] >= _need(s["end"] - s["start"])
    flush = lambda s: F.when(passes(s), F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, ratio: Column) -> Column:
        over = (s["sum"] <= 0) | (s["sum"] < s["peak"] - FALL)
        total, peak = F.when(over, 0.0).otherwise(s["sum"]) + ratio - model.threshold, F.when(over, 0.0).otherwise(s["peak"])
        return F.struct(
            (s["i"] + 1).alias("i"), total.alias("sum"), F.when(over, s["i"]).otherwise(s["start"]).alias("start"), F.greatest(total, peak).alias("peak"),
            F.when(total > peak, s["i"] + 2).when(over, s["i"]).otherwise(s["end"]).alias("end"), F.when(over, flush(s)).otherwise(s["out"]).alias("out"),
        )

    def widen(x: Column) -> Column:
        before = F.regexp_extract(F.reverse(token.substr(F.lit(1), x["start"])), _PIECE, 0)
        after = F.regexp_extract(token.substr(x["end"] + 1, F.length(token)), _PIECE, 0)
        return F.struct((x["start"] - F.length(before)).alias("start"), (x["end"] + F.length(after)).alias("end"))

    def join(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (last["end"] >= x["start"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.transform(F.aggregate(steps, zero, step, flush), widen), none, join)


def random_spans(token: Column, model: MarkovModel) -> Column:
    """(start, end) of what looks random in a run of ALPHABET's characters: the whole of it or its stretches.

    A run of MIN_CHARS with a letter and a digit is one span if its mean ratio passes the threshold. Otherwise any
    stretch counts by its sum of ratios, whatever stands beside it.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    mixed = (F.length(token) >= MIN_CHARS) & token.rlike("[0-9]") & token.rlike("[A-Za-z]")

    def spans(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, r: s + r)
        most = F.aggregate(x, F.lit(0.0), lambda s, r: s + F.greatest(r - model.threshold, F.lit(0.0)))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(token).alias("end")))
        return F.when(mixed & (total / F.size(x) >= model.threshold), whole).when(most >= _need(F.length(token)), _stretches(token, x, model)).otherwise(none)

    return let(_steps(token, model), spans)


def _found(text: Column, matches: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches of a pattern: starts are running sums of what lies before, between and in them."""
    pieces = F.split(text, pattern, -1)
    starts = running_sum(F.zip_with(pieces, F.concat(F.array(F.lit("")), matches), lambda p, m: F.length(p) + F.length(m)))
    spans = F.zip_with(matches, F.slice(starts, 1, F.size(matches)), lambda m, s: F.struct(s.cast("int").alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).cast("int").alias("end"), m.alias("value")))
    return F.when(F.size(matches) > 0, F.filter(spans, lambda x: keep(x["value"]))).otherwise(F.array().cast(SPANS))


def _parts(runs: str, model: MarkovModel) -> Column:
    """The random spans of all runs, as spans of the text."""

    def parts(x: Column) -> Column:
        at = lambda p: F.struct((x["start"] + p["start"]).alias("start"), x["kind"].alias("kind"), (x["start"] + p["end"]).alias("end"), x["value"].substr(p["start"] + 1, p["end"] - p["start"]).alias("value"))
        return F.transform(random_spans(x["value"], model), at)

    return F.flatten(F.transform(runs, parts))


def _outside(extra: Column, base: Column, model: MarkovModel) -> Column:
    """The parts of all spans extra outside the base spans; what is cut off must look random itself.

    Both are sorted by start; of each span only the base spans near it are looked at, found by bisection on their starts
    and on the largest end so far.
    """
    none = F.array().cast(SPANS)

    def parts(x: Column, ends: Column) -> Column:
        part = lambda a, b: F.struct(a.alias("start"), x["kind"].alias("kind"), b.alias("end"), x["value"].substr(a - x["start"] + 1, b - a).alias("value"))
        random = lambda a, b: ((a == x["start"]) & (b == x["end"])) | (mean_ratio(part(a, b)["value"], model) >= model.threshold)
        add = lambda s, to: F.when((s["at"] < to) & random(s["at"], to), F.concat(s["out"], F.array(part(s["at"], to)))).otherwise(s["out"])
        step = lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), add(s, b["start"]).alias("out"))
        low = first_true(F.size(base), lambda i: F.get(ends, i) > x["start"])
        high = first_true(F.size(base), lambda i: F.get(base, i)["start"] >= x["end"])
        meets = F.slice(base, low + 1, F.greatest(high - low, F.lit(0)))
        return F.aggregate(meets, F.struct(x["start"].alias("at"), none.alias("out")), step, lambda s: add(s, x["end"]))

    return let(running(F.transform(base, lambda b: b["end"]), F.greatest), lambda ends: F.flatten(F.transform(extra, lambda x: parts(x, ends))))


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _text, base, extra): spans (start, kind, end, value) of each row, by code points, end exclusive, sorted.

    base holds the pattern kinds, extra what random_spans finds in the runs of ALPHABET's characters (of a run of more
    than LONGEST characters, in its parts), less the base spans. A null text counts as empty; repeated rows give repeated results; an empty table gives
    none; other columns are ignored.
    """
    least = least_chars(model)
    patterns = (ASSIGN, ACCESS, HEX, rf"{_RUN}{{{least},{LONGEST}}}(?:{_RUN}{{1,{least - 1}}}(?!{_RUN}))?")
    kept = (
        lambda v: F.length(F.regexp_extract(v, ASSIGN, 1)) >= 8,
        lambda v: F.lit(True),
        lambda v: F.lit(True),
        lambda v: F.lit(True),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m{k}") for k, p in enumerate(patterns)])
    rows = rows.select("doc_id", "_text", *[_found(F.col("_text"), F.col(f"_m{k}"), p, k, kept[k]).alias(f"_s{k}") for k, p in enumerate(patterns)])
    rows = rows.select("doc_id", "_text", F.sort_array(F.concat("_s0", "_s1", "_s2")).alias("base"), _parts("_s3", model).alias("_s3"))
    free = F.when((F.size("_s3") > 0) & (F.size("base") > 0), _outside(F.col("_s3"), F.col("base"), model)).otherwise(F.col("_s3"))
    return rows.select("doc_id", "_text", "base", free.alias("extra"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: MarkovModel, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with each secret (overlapping spans as one) replaced by mark, and n_chars, if there, counted anew.

    All rows and columns stay; a null text stays null.
    """
    inner = docs.withColumn("_lamella_row", F.struct(*docs.columns))
    found = scan(inner.select("_lamella_row", F.col(text_col).alias("_lamella_text")), model, "_lamella_row", "_lamella_text")
    spans = F.sort_array(F.concat("base", "extra"))

    def replace(x: Column, pieces: Column) -> Column:
        """Before each span that begins behind all earlier ones stands what no span covers, from their largest end on."""
        behind = let(running(F.transform(x, lambda s: s["end"]), F.greatest), lambda ends: F.concat(F.array(F.lit(0).cast("long")), ends))
        parts = let(behind, lambda ends: F.concat(
            F.zip_with(x, F.slice(ends, 1, F.size(x)), lambda s, at: F.when(s["start"] >= at, F.concat(cut(pieces, at.cast("int"), s["start"]), F.lit(mark))).otherwise("")),
            F.array(cut(pieces, F.element_at(ends, -1).cast("int"), F.length("_text"))),
        ))
        return F.array_join(parts, "")

    rest = let(spans, lambda x: let(chunks(F.col("_text")), lambda pieces: replace(x, pieces)))
    clean = F.when(F.size("base") + F.size("extra") > 0, rest).otherwise(F.col(f"doc_id.{text_col}"))
    rows = found.select("doc_id", clean.alias("_clean"))
    of = lambda c: F.col("_clean") if c == text_col else F.length("_clean").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("doc_id")[c]
    return rows.select(*[of(c).alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests over all documents."""
    from .common import read

    found = scan(read(spark, sf_dir, "documents"), train(labelled_samples(spark)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.sort_array(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_markov"),
    )
