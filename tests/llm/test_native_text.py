"""Secret scans and quality rules against brute force."""

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from lamella.llm import common, quality_rules, secrets

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = hashlib.sha256(b"x").hexdigest()
SECRETS = [
    (1, None), (2, ""), (3, f"é\U0001f600 token = \"{RANDOM[:40]}\" and AKIA{'Q1' * 8} end"), (4, "token: secret : abcdefghijk"), (5, "Password=short api-key=abcdefghijkl APIKEY:12345678"),
    (6, "AKIA123 AKIAAKIAAKIAAKIA" + " " + "a" * 31 + " " + "f" * 33), (7, " ".join(f"secret={i:08d}x" for i in range(700))), (8, "see Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MGFiY2RlZg and user_account_settings_page_2020"), (9, "token=" + "A" * 5000),
]


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_base_spans_and_markov(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    docs = spark.createDataFrame(SECRETS, "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert len(found) == len(SECRETS)
    for i, text in SECRETS:
        assert [(x["start"], x["kind"], x["end"]) for x in found[i]["base"]] == base(text or ""), i
    extra = [x["value"] for x in found[8]["extra"]]
    assert len(extra) == 1 and extra[0].startswith("Zm9v")


def test_random_strings_score_above_identifiers(spark):
    model = secrets.train(secrets.labelled_samples(spark, 4000))
    rows = spark.createDataFrame([("9f86d081884c7d659a2feaa0c55ad015a3bf4f1b",), ("x8Kq2LmZ0pRtY7vWc3Nb5HsD",), ("get_user_account_settings_page_1",), ("readDocumentConfiguration2021",), ("a",), (None,)], "t string")
    score = [r[0] for r in rows.select(secrets.mean_ratio(rows["t"], model)).collect()]
    assert min(score[:2]) > 0.5 > 0 > max(score[2:4]) and score[4] == 0.0


def test_random_strings_beside_words(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(3)
    chars = string.ascii_letters + string.digits
    rows = [(before, "".join(rng.choices(chars, k=n)), after) for before in ("account/reset/", "export_access_value=", "account/billing/settings/reset/") for n in (24, 40) for after in ("", "/index/page") for _ in range(25)]
    rows += [("", "".join(rng.choices(string.ascii_letters, k=24)), "") for _ in range(50)] + [("", "".join(rng.choices(chars, k=18)), "") for _ in range(50)]
    docs = spark.createDataFrame([(i, f"see {a}{x}{b} there") for i, (a, x, b) in enumerate(rows)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    missed = [x for i, (_, x, _) in enumerate(rows) if x in out[i]]
    assert len(missed) < 0.05 * len(rows), missed
    assert not any(x[-12:] in out[i] for i, (_, x, _) in enumerate(rows) if x not in missed)
    words = [r["sample"] for r in secrets.labelled_samples(spark, 1000).where("label = 0").collect()]
    plain = secrets.scan(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), model)
    assert plain.where("size(extra) > 0").count() == 0


def test_random_rest_beside_base_spans(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    a, b = "x8Kq2LmZ0pRtY7vWc3Nb5HsDq9TjU4eGfB6oXw1Z", "AKIA" + "Q1Z7" * 4
    texts = [f"see {b}/{a} there", f"see {a}/{RANDOM[:32]}/{a} there", f"user_token={a} there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert [x["value"] for x in found[0]["extra"]] == ["/" + a] and [x["value"] for x in found[1]["extra"]] == [a + "/", "/" + a]
    assert all([(x["start"], x["kind"], x["end"]) for x in found[i]["base"]] == base(t) for i, t in enumerate(texts)) and found[2]["extra"] == []
    assert {r["text"] for r in secrets.redact(docs.where("doc_id = 0"), model).collect()} == {"see [SECRET][SECRET] there"}


def test_redact_keeps_rows_and_columns(spark, hard):
    model = secrets.train(secrets.labelled_samples(spark, 500))
    docs = spark.createDataFrame(SECRETS, "doc_id long, text string").selectExpr("*", "length(text) n_chars", "'k' base")
    out = {r["doc_id"]: r for r in secrets.redact(docs, model).collect()}
    assert out[1]["text"] is None and out[2]["text"] == "" and out[3]["text"] == "é\U0001f600 [SECRET]\" and [SECRET] end" and out[3]["n_chars"] == len(out[3]["text"])
    assert "0000012" not in out[7]["text"] and out[7]["text"].count("[SECRET]") == 700
    same = secrets.redact(hard, model)
    assert same.columns == hard.columns and same.count() == hard.count()


def test_many_spans_in_long_texts(spark):
    """Texts of megabytes with thousands of spans, a run without an end, and characters outside the first plane."""
    model = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(8)
    random_part = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    many = " ".join(f"😀 é token={random_part(20)} see {random_part(32)} and user_account" for _ in range(20_000))
    texts = [many, random_part(300_005), "a" * 3_000_000, "word " * 500_000 + f"password: {'x' * 9}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert all([(x["start"], x["kind"], x["end"]) for x in found[i]["base"]] == base(t) for i, t in enumerate(texts))
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    for i, t in enumerate(texts):
        want, at = [], 0
        for x in sorted((x["start"], x["end"]) for x in [*found[i]["base"], *found[i]["extra"]]):
            if x[0] >= at:
                want += [t[at : x[0]], "[SECRET]"]
            at = max(at, x[1])
        assert out[i] == "".join([*want, t[at:]])
    assert len(found[0]["extra"]) > 19_000 and sum(x["end"] - x["start"] for x in found[1]["extra"]) == 300_005 and out[2] == "[SECRET]"


def test_cut(spark):
    text = "aé😀z" * 40
    rows = [(a, b) for a in range(0, 161, 7) for b in range(0, 161, 5)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", common.cut(common.chunks(F.lit(text), 16), F.col("a"), F.col("b"), 16).alias("t")).collect()
    assert all(r["t"] == text[r["a"] : r["b"]] for r in got)
    assert spark.range(1).select(common.first_true(F.lit(5), lambda i: i >= 3), common.first_true(F.lit(5), lambda i: i > 9), common.first_true(F.lit(0), lambda i: i > 9)).first()[:] == (3, 5, 0)


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, hard):
    from collections import Counter

    more = spark.createDataFrame([(20, "a b c d e f g h i a b c d e f g h x " * 3 + "\n| # |\n| # |\n \n \n"), (21, " ".join(string.ascii_letters[i % 7] for i in range(300)))], "doc_id long, text string")
    for docs in (hard, more):
        got = Counter((r["doc_id"], *[r[c] for c in quality_rules.COUNTS]) for r in quality_rules.statistics(docs).collect())
        assert got == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())


def test_learned_list(spark):
    rows = [{**dict.fromkeys(quality_rules.FEATURES, 0.0), "symbols_per_word": (i % 10) / 10, "upper_share": (i % 7) / 7, "_bad": int(i % 10 > 7 or i % 7 > 5)} for i in range(900)]
    rules = quality_rules.learn(rows)
    assert rules.rules
    hit = lambda r: any(quality_rules._covers(x, r) for x in rules.rules)
    assert all(hit(r) == bool(r["_bad"]) for r in rows)
    df = spark.createDataFrame(rows)
    assert {(r["_bad"] > 0) == (r["k"] > 0) for r in df.select("_bad", rules.rejected_by().alias("k")).collect()} == {True}
    assert quality_rules.learn([]).rules == () and quality_rules.learn([{**rows[0], "_bad": 0}] * 9).rules == ()


def test_empty_tables(spark, hard):
    none = hard.limit(0)
    model = secrets.train(secrets.labelled_samples(spark, 100))
    assert secrets.scan(none, model).count() == 0 and quality_rules.verdicts(none, quality_rules.DecisionList()).count() == 0
    assert quality_rules.labelled_statistics(none, spark.createDataFrame([], "doc_id long, quality int")) == []
    kept = {(r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) == r["base_failed"] for r in quality_rules.verdicts(hard, quality_rules.DecisionList()).collect()}
    assert kept == {True}
