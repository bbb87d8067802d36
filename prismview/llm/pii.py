"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four patterns with checks. Beyond them, candidates (strings with digits of a
telling shape) get votes from three labelers: the patterns, a gazetteer of prefixes and domains, and the
words before them. Votes and shape features are counted over the whole corpus; expectation
maximisation over the few vote patterns of each kind estimates how far each labeler can be relied on, and its
posteriors train the span classifier, a naive Bayes model over the features, which decides on the candidates.

Only counts by vote and feature pattern leave the scan, and only the model (some hundred numbers) goes
back, so nothing is shuffled that grows with the texts. Every pattern runs in time linear in the text,
also on one long run of digits or letters: repetitions that cannot help by giving back are possessive.

Null text: as empty. Empty text or table: no spans. Positions are code points, ends exclusive. Repeated rows: one
result each. Within one kind spans do not overlap. Ties: even odds don't add a span. Very long texts: searched whole. Extra columns, whatever their
names, are not read; mask() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")
# A match cannot start inside a run of a match's first characters unless an earlier match has just ended there (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ATOM = r"A-Za-z0-9@._%+/-"
CANDIDATE = rf"(?<![{ATOM}])(?:\([0-9]{{3}}\)\x20?[0-9]{{3}}[-.][0-9]{{4}}(?![0-9])|[A-Za-z@._%+/-]*+[0-9][{ATOM}]*+)"

# Fixed values of the gazetteer and of the context labeler.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "nl", "uk", "ch", "at", "us", "ca")
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk_", "xoxb-", "xoxp-", "AIza", "eyJ")
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|contacto|kontakt|courriel)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|addr)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|tarjeta|karte|carte)\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|telefon|telefono|portable)\W*$",
    "secret": r"(?i)(?:password|passwd|pwd|secret|token|key|credential|auth)\W*$",
}
OTHER_CUES = r"(?i)(?:version|page|chapter|isbn|issn|order|item|no|nr|year|vol|section|figure|table|commit|sha)\W*$"


def prefix_sums(values: Column) -> Column:
    """For each value the sum of those before it, in blocks so that long arrays aren't copied for every element."""
    width = 256
    empty = F.expr("cast(array() as array<bigint>)")

    def run(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.cast("long").alias("at"), empty.alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / width) - 1, F.lit(0)).cast("int")), lambda b: F.slice(values, b * width + 1, width))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, run(totals, F.lit(0)), run))


def cut(text: Column, pattern: str, may: Column) -> Column:
    """The matches of a pattern and the text around them (one piece more); null where it can't match."""
    return F.when(may, F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))


def placed(c: Column) -> Column:
    """The matches of cut() with their start, the 40 characters before and the one after."""
    n = F.size(c["found"])
    gaps = F.slice(c["gaps"], F.lit(1), n)
    steps = F.zip_with(gaps, c["found"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    earlier = F.zip_with(gaps, F.slice(F.concat(F.array(F.lit("")), c["found"]), F.lit(1), n), lambda g, m: F.struct(F.length(g).alias("gap"), F.substring(F.concat(F.substring(m, -40, 40), g), -40, 40).alias("before")))
    sides = F.zip_with(earlier, F.slice(c["gaps"], F.lit(2), n), lambda g, r: F.struct(g["gap"].alias("gap"), g["before"].alias("before"), F.substring(r, 1, 2).alias("after")))
    at = F.zip_with(prefix_sums(steps), sides, lambda p, s: F.struct((p + s["gap"]).alias("start"), s["before"].alias("before"), s["after"].alias("after")))
    return F.when(c.isNotNull(), F.zip_with(c["found"], at, lambda m, a: F.struct(m.alias("m"), a["start"].alias("start"), a["before"].alias("before"), a["after"].alias("after"))))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    xs = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(xs, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0++", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(F.when(F.length(m) <= 64, digits(m)).otherwise(F.lit("1")))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def may_match(kind: str, text: Column, digit: Column) -> Column:
    return {"email": F.contains(text, F.lit("@")), "phone": digit & F.contains(text, F.lit("+"))}.get(kind, digit)


NO_SPANS = "cast(array() as array<struct<kind: int, start: bigint, end: bigint>>)"


def with_base(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with base: spans (kind, start, end) in the order of kinds, then start."""
    rows = rows.withColumn("_digit", F.col("text").rlike("[0-9]"))
    rows = rows.withColumns({f"_{k}": cut(F.col("text"), p, may_match(k, F.col("text"), F.col("_digit"))) for k, p in PATTERNS.items()})
    rows = rows.withColumns({f"_{k}": placed(F.col(f"_{k}")) for k in PATTERNS})

    def spans(i: int, kind: str) -> Column:
        passing = F.filter(F.col(f"_{kind}"), lambda x: valid(kind, x["m"]))
        return F.coalesce(F.transform(passing, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"))), F.expr(NO_SPANS))

    return rows.withColumn("base", F.concat(*(spans(i, k) for i, k in enumerate(PATTERNS)))).drop(*(f"_{k}" for k in PATTERNS))


def shape(m: Column, before: Column, after: Column) -> Column:
    """The kind that a candidate can be of, or null. Parts of longer numbers are none."""
    n = F.length(digits(m))
    part = before.rlike(r"[0-9][\x20-]$|\+[0-9][\x20().0-9-]*$|[0-9]\)\x20?$") | after.rlike(r"^[\x20-][0-9]")
    return (
        F.when(m.contains("@"), F.lit(0))
        .when(m.rlike(r"^[0-9]++(?:\.[0-9]++){3}$"), F.lit(1))
        .when(m.rlike(r"^[0-9]++(?:-[0-9]++)*+$") & n.between(13, 19), F.when(~part, F.lit(2)))
        .when(m.rlike(r"^\(?[0-9]++[)\x20.0-9-]*$") & n.between(8, 12), F.when(~part, F.lit(3)))
        .when((F.length(m) >= 12) & m.rlike("[A-Za-z]") & ~m.rlike("[/.]"), F.lit(4))
    )


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def labelled(kind: Column, m: Column, before: Column) -> Column:
    """The votes of the three labelers: 1, -1 or 0 (none)."""
    d, n = digits(m), F.length(digits(m))
    found = [m.rlike(EMAIL), m.rlike(IP) & valid("ip", m), n.between(16, 19) & luhn(d), m.rlike(r"^\([0-9]{3}\)"), m.rlike(r"^(?:AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36})$")]
    not_found = [F.lit(True), F.lit(True), F.lit(True), n > 11, m.rlike("^[A-Za-z-]++[0-9]{1,4}$")]
    known = [F.regexp_extract(m, r"\.([A-Za-z]+)$", 1).isin(*TOP_DOMAINS), ~m.rlike(r"^(?:0|10|127|192\.168|2[2-5][0-9])\."), d.rlike("^[3-6]"), d.rlike("^0?[1-9][0-9]{2}"), m.rlike("^(?:" + "|".join(SECRET_PREFIXES) + ")") | m.rlike("^(?:[0-9a-f]{16,64}|[0-9A-F]{16,64})$")]
    unknown = [F.lit(True), m.rlike(r"^(?:0|2[2-5][0-9])\."), ~d.rlike("^[2-6]"), d.rlike("^00"), m.rlike("^[a-z]+[0-9]{1,3}[a-z]*$")]
    cue = [before.rlike(CUES[k]) for k in KINDS]

    def by_kind(columns: list[Column]) -> Column:
        out = F.when(kind == 0, columns[0])
        for i, c in enumerate(columns[1:], 1):
            out = out.when(kind == i, c)
        return out

    return F.array(vote(by_kind(found), by_kind(not_found)), vote(by_kind(known), by_kind(unknown)), vote(by_kind(cue), before.rlike(OTHER_CUES)))


def features(kind: Column, m: Column, before: Column, after: Column, votes: Column) -> Column:
    """Keys of the classifier's features."""
    share = F.floor(F.length(digits(m)) * 4 / F.length(m))
    left = F.when(before == "", "^").when(before.rlike(r"[=:]\x20?\"?$"), "=").when(before.rlike(r"[\"']$"), "q").when(before.rlike(r"\s$"), "s").otherwise("o")
    right = F.when(after == "", "$").when(after.rlike("^[\"']"), "q").when(after.rlike(r"^[\s.,;:!?]"), "s").otherwise("o")
    values = [F.least(F.floor(F.length(m) / 4), F.lit(12)), share, left, right, F.when(m.rlike("[A-Z]"), "A").otherwise("-"), F.when(m.rlike("[a-z]"), "a").otherwise("-"), votes[0], votes[1], votes[2]]
    return F.array(*(F.concat_ws("|", kind, F.lit(i), v.cast("string")) for i, v in enumerate(values)))


def with_candidates(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with candidates: kind, start, m, votes, features."""
    rows = rows.withColumn("_cut", cut(F.col("text"), CANDIDATE, F.col("text").rlike("[0-9]"))).withColumn("_cut", placed(F.col("_cut")))
    trimmed = F.transform("_cut", lambda x: F.struct(F.regexp_replace(x["m"], "[._%+/-]++$", "").alias("m"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after")))
    kinds = F.transform(trimmed, lambda x: F.struct(shape(x["m"], x["before"], x["after"]).alias("kind"), x["m"].alias("m"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after")))
    rows = rows.withColumn("_cut", F.filter(kinds, lambda x: x["kind"].isNotNull()))
    rows = rows.withColumn("_cut", F.transform("_cut", lambda x: F.struct(x.alias("c"), labelled(x["kind"], x["m"], x["before"]).alias("votes"))))
    found = F.transform("_cut", lambda x: F.struct(x["c"]["kind"].alias("kind"), x["c"]["start"].alias("start"), x["c"]["m"].alias("m"), x["votes"].alias("votes"), features(x["c"]["kind"], x["c"]["m"], x["c"]["before"], x["c"]["after"], x["votes"]).alias("features")))
    return rows.withColumn("candidates", found).drop("_cut")


#: Rounds of expectation maximisation.
ROUNDS = 25
#: The state: prior, then P(vote | class) at 9 * class + 3 * labeler + vote + 1. It begins with labelers that are mostly right.
START = "named_struct('prior', 0.5D, 'p', transform(sequence(0, 17), j -> element_at(array(0.6D, 0.35D, 0.05D, 0.05D, 0.35D, 0.6D), int(3 * int(j / 9) + j % 3 + 1))))"
LIKELIHOOD = "aggregate(sequence(0, 2), {prior}, (l, i) -> l * s.p[int(9 * {c} + 3 * i + x.votes[i] + 1)])"
POSTERIOR = "transform(patterns, x -> named_struct('votes', x.votes, 'n', x.n, 'w', {one} / ({one} + {zero})))".format(one=LIKELIHOOD.format(prior="s.prior", c=1), zero=LIKELIHOOD.format(prior="1D - s.prior", c=0))
TOTAL = "aggregate(q, 0D, (t, x) -> t + x.n * if({j} >= 9, x.w, 1D - x.w))"
MATCHED = "aggregate(q, 0D, (t, x) -> t + if(x.votes[int(j % 9 / 3)] = j % 3 - 1, x.n * if(j >= 9, x.w, 1D - x.w), 0D))"
STEP = f"element_at(transform(array({POSTERIOR}), q -> named_struct('prior', ({TOTAL.format(j=9)} + 1D) / ({TOTAL.format(j=9)} + {TOTAL.format(j=0)} + 2D), 'p', transform(sequence(0, 17), j -> ({MATCHED} + 0.5D) / ({TOTAL.format(j='j')} + 1.5D)))), 1)"
# votes of 0 in class 1 and 0 start with the same weights for j % 3 = 1; classes differ in the order of the others


def reliabilities(patterns: DataFrame) -> DataFrame:
    """kind, prior, p and, for each vote pattern, votes and its posterior, from rows (kind, votes, n) of at most 27 a kind."""
    grouped = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    fitted = grouped.withColumn("s", F.expr(f"aggregate(sequence(1, {ROUNDS}), {START}, (s, r) -> {STEP})"))
    return fitted.withColumn("posterior", F.expr(POSTERIOR)).select("kind", "s.prior", "s.p", F.explode("posterior").alias("x")).select("kind", "prior", "p", "x.votes", F.col("x.w").alias("w"))


def train(documents: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The span classifier: log odds by feature key, and by kind alone. A few hundred numbers, whatever the corpus."""
    rows = documents.select(F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    found = with_candidates(rows).select(F.explode("candidates").alias("c"))
    # a bounded number of vote and feature patterns
    counts = common.checkpointed(found.groupBy("c.kind", "c.votes", "c.features").count())
    votes = counts.groupBy("kind", "votes").agg(F.sum("count").alias("n"))
    weighted = counts.join(reliabilities(votes).select("kind", "votes", "w"), ["kind", "votes"]).select("kind", F.explode(F.concat(F.array(F.col("kind").cast("string")), "features")).alias("key"), (F.col("count") * F.col("w")).alias("yes"), (F.col("count") * (1 - F.col("w"))).alias("no"))
    sums = {r["key"]: (r["yes"], r["no"]) for r in weighted.groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
    from math import log

    model = {}
    for key, (yes, no) in sums.items():
        if "|" not in key:
            model[key] = log((yes + 0.5) / (no + 0.5))
        else:
            all_yes, all_no = sums[key.split("|")[0]]
            model[key] = log((yes + 0.5) / (all_yes + 5)) - log((no + 0.5) / (all_no + 5))
    return model


def accepted(model: dict[str, float]) -> Column:
    """Spans (kind, start, end) of the candidates that the classifier takes and no base pattern has found."""
    if not model:
        return F.expr(NO_SPANS)
    odds = F.create_map(*(F.lit(x) for kv in sorted(model.items()) for x in kv))

    def score(x: Column) -> Column:
        return F.aggregate(F.concat(F.array(x["kind"].cast("string")), x["features"]), F.lit(0.0), lambda s, k: s + F.coalesce(odds[k], F.lit(0.0)))

    new = F.filter("candidates", lambda x: ~((x["kind"] < 3) & (x["votes"][0] == 1)) & (score(x) > 0))
    return F.coalesce(F.transform(new, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"))), F.expr(NO_SPANS))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (base and added ones), arrays of (kind, start, end) by kind, then start."""
    model = train(documents, text_col)
    rows = documents.select(documents[id_col].cast("long").alias("doc_id"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    rows = with_candidates(with_base(rows))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", accepted(model))).alias("spans"))


def mask(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with every span of their text replaced by its kind, as <EMAIL>; of spans that overlap the first. Null text stays null."""
    model = train(documents, text_col)
    names = documents.columns
    rows = documents.select(F.struct(*(documents[c] for c in names)).alias("_row"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    rows = with_candidates(with_base(rows)).withColumn("_spans", F.concat("base", accepted(model)))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(s: Column, x: Column) -> Column:
        kept = F.array(F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), marks[x["kind"]])
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], kept).alias("out"))).otherwise(s)

    masked = F.aggregate(ordered, start, add, lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text")))), ""))
    text = F.when(F.size("_spans") > 0, masked).otherwise(F.col("_row")[text_col].cast("string"))
    return rows.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names))


def digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans counted by kind, the SHA-256 of the base spans as written, and all spans as written."""
    found = find(documents, id_col, text_col)

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
