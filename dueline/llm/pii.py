"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from fixed patterns and checks and always stay: email, ip, card, phone. The method finds
more: ``local_phone`` (a number in brackets without country), ``number`` (13 to 19 digits that fail the
card check) and ``secret`` (long hexadecimal strings).

1. Candidates: the base spans and those of the other kinds, with the text around them.
2. Five labelers vote +1, 0 or -1 on each: strict form (regex), lists of endings, countries and issuers
   (gazetteer), words before it (context), characters at its edges, and variety of its characters.
3. Votes are counted by pattern, at most 3**5 a kind. Expectation-maximisation over these counts
   estimates, for each kind, how reliable each labeler is, and so a probability for each pattern.
4. With these probabilities as soft labels, a naive Bayes classifier over features of the span itself is
   trained: one aggregate into at most KINDS x FEATURES x VALUES rows.
5. Candidates that aren't base spans are added where the classifier says 0.5 or more, unless they
   overlap a base span.

Positions are code points, end exclusive. Patterns are written so that no text makes them slow:
repetitions don't give back, and a run is tried from its start only. Candidates are a narrow table in
the shared folder, so texts are read once; the two learned tables are bounded and become constants.
Nothing is grouped by document or source. Null texts are empty; rows are handled one by one, so null or
repeated ids change nothing.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.llm.shared import text_or_empty, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "number", "secret")
LABELERS, ITERATIONS = 5, 20
#: Characters before a candidate in which context words count.
CONTEXT = 32

# The character that frames matches while their places are read off, and what stands in for it in texts.
MARK, STAND_IN = "\u0001", "\u0002"

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+][\x20-]|[0-9+])\([0-9]{3}\)\x20?[0-9]{3}[\x20-][0-9]{4}(?![0-9])",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
}
# Which patterns can match at all: a text without this character has none.
NEEDS = {"email": "@", "phone": "+", "local_phone": "("}

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Fixed values of the gazetteer labeler.
ENDINGS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|au|ch|at|nl|be|br|mx|jp|in"
COUNTRIES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
RESERVED = "0|10|127|169|192|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
CUES = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|credit|visa|account|payment",
    "phone": "phone|tel|call|mobile|fax",
    "local_phone": "phone|tel|call|mobile|fax",
    "number": "card|credit|visa|account|payment",
    "secret": "token|secret|password|key|auth",
}
AGAINST = "version|isbn|issn|invoice|order|page|figure|table"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _kind(name: str, match: Column) -> Column:
    """The number of the kind that a match of a pattern is, or null if it is dropped."""
    number = F.lit(KINDS.index(name))
    if name == "ip":
        return F.when(match.rlike(f"^(?:{_OCTET}\\.){{3}}{_OCTET}$"), number)
    if name == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), F.when(_luhn(digits), number).otherwise(F.lit(KINDS.index("number"))))
    if name == "phone":
        return F.when(F.length(_digits(match)).between(9, 15), number)
    return number


def found_by(name: str, text: Column) -> Column:
    """Candidates of one pattern: kind, start, end, match, what stands before and after."""
    framed = F.regexp_replace(text, PATTERNS[name], f"{MARK}$0{MARK}")
    if name in NEEDS:
        framed = F.when(F.contains(text, F.lit(NEEDS[name])), framed).otherwise(text)
    none = F.array().cast("array<struct<kind int, start int, end int, match string, left string, right string>>")

    def places(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            before, match, after = (F.element_at(parts, 2 * i + k) for k in (-1, 0, 1))
            start = acc["at"] + F.length(before)
            end = start + F.length(match)
            kind = _kind(name, match)
            found = F.struct(
                kind.alias("kind"), start.alias("start"), end.alias("end"), match.alias("match"),
                F.right(before, F.lit(CONTEXT)).alias("left"), F.left(after, F.lit(1)).alias("right"),
            )
            found = F.when(kind.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(found)))
            return F.struct(end.alias("at"), found.alias("found"))

        first = F.struct(F.lit(0).alias("at"), none.alias("found"))
        pairs = F.sequence(F.lit(1), ((F.size(parts) - 1) / 2).cast("int"))
        return F.when(F.size(parts) > 1, F.aggregate(pairs, first, step)["found"]).otherwise(none)

    # One element, so that the parts are computed once.
    return F.flatten(F.transform(F.array(F.split(framed, MARK, -1)), places))


def votes(c: Column) -> Column:
    """What each labeler says of a candidate."""
    kind, match, left, right = c["kind"], c["match"], c["left"], c["right"]
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    digits = _digits(match)

    def by_kind(**say: Column) -> Column:
        out = none
        for name, vote in say.items():
            out = F.when(kind == KINDS.index(name), vote).otherwise(out)
        return out

    def says(test: Column, otherwise: Column = no) -> Column:
        return F.when(test, yes).otherwise(otherwise)

    strict = by_kind(
        email=says(match.rlike(r"^[A-Za-z0-9][^@]*@[^@]*[A-Za-z0-9]\.[A-Za-z]{2,}$")), ip=says(~match.rlike(r"(^|\.)0[0-9]")),
        card=yes, phone=says(F.length(digits).between(10, 13), none), local_phone=yes, number=no, secret=says(F.length(match).isin(32, 40, 64), none),
    )
    known = by_kind(
        email=says(match.rlike(rf"\.(?i:{ENDINGS})$")), ip=says(~match.rlike(rf"^0*(?:{RESERVED})\.")), card=says(digits.rlike(f"^(?:{ISSUERS})")),
        number=says(digits.rlike(f"^(?:{ISSUERS})")), phone=says(digits.rlike(f"^(?:{COUNTRIES})")), local_phone=says(match.rlike(r"^\([2-9]")),
    )
    context = F.when(left.rlike(f"(?i){AGAINST}"), no).otherwise(by_kind(**{k: says(left.rlike(f"(?i){words}"), none) for k, words in CUES.items()}))
    edges = says(~left.rlike(r"[A-Za-z0-9_@/.=-]$") & ~right.rlike(r"^[A-Za-z0-9_@/=]"))
    distinct = F.size(F.array_distinct(F.split(F.regexp_replace(match, "[^0-9A-Za-z]", ""), "")))
    variety = F.when(distinct >= 5, yes).when(distinct <= 2, no).otherwise(none)
    return F.array(strict, known, context, edges, variety)


def features(c: Column) -> Column:
    """Small numbers that describe a span: sizes, and classes of characters in and around it."""
    match = c["match"]

    def kind_of(char: Column) -> Column:
        classes = ("^$", "^[0-9]$", "^[A-Z]$", "^[a-z]$", r"^\s$", "^[\"'=:]$", "^[.,;!?]$")
        out = F.lit(len(classes))
        for i, pattern in enumerate(classes):
            out = F.when(char.rlike(pattern), i).otherwise(out)
        return out

    return F.array(
        F.least(F.length(match) / 4, F.lit(15)).cast("int"),
        (8 * F.length(_digits(match)) / F.length(match)).cast("int"),
        F.least(F.size(F.array_distinct(F.split(match, ""))), F.lit(15)),
        kind_of(F.right(c["left"], F.lit(1))),
        kind_of(c["right"]),
        kind_of(F.left(match, F.lit(1))),
    )


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per document: doc_id, found (its candidates with votes and features, by kind and place)."""
    text = text_or_empty(F.col(text_column))
    text = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    texts = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    found = texts.select("doc_id", F.concat(*(found_by(name, F.col("text")) for name in PATTERNS)).alias("found"))

    def described(c: Column) -> Column:
        return F.struct(c["kind"], c["start"], c["end"], votes(c).alias("votes"), features(c).alias("features"))

    return found.select("doc_id", F.array_sort(F.transform("found", described)).alias("found"))


def reliabilities(found: DataFrame) -> DataFrame:
    """kind, votes, p: the probability of each pattern of votes after expectation-maximisation."""
    patterns = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_kind = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))  # at most 3**5
    start = "array({})".format(", ".join(["0.1D, 0.3D, 0.6D"] * LABELERS))
    start_off = "array({})".format(", ".join(["0.6D, 0.3D, 0.1D"] * LABELERS))
    posterior = f"""transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n, 'w', 1 / (1 + exp(
        ln((1 - s.prior) / s.prior) + aggregate(sequence(0, {LABELERS - 1}), 0D,
            (x, l) -> x + ln(s.off[3 * l + p.votes[l] + 1] / s.on[3 * l + p.votes[l] + 1]))))))"""

    def share(weight: str) -> str:
        """Of all weight, what goes with each vote of each labeler, by Laplace's rule."""
        return f"""transform(sequence(0, {3 * LABELERS - 1}), j ->
            (aggregate(q, 0D, (x, r) -> x + if(r.votes[j div 3] = j % 3 - 1, r.n * {weight}, 0D)) + 1)
            / (aggregate(q, 0D, (x, r) -> x + r.n * {weight}) + 3))"""

    step = f"""transform(array({posterior}), q -> named_struct(
        'prior', (aggregate(q, 0D, (x, r) -> x + r.n * r.w) + 1) / (aggregate(q, 0D, (x, r) -> x + r.n) + 2),
        'on', {share('r.w')}, 'off', {share('(1 - r.w)')}))[0]"""
    fitted = f"aggregate(sequence(1, {ITERATIONS}), named_struct('prior', 0.5D, 'on', {start}, 'off', {start_off}), (s, i) -> {step})"
    return (
        by_kind.select("kind", "patterns", F.expr(fitted).alias("s"))
        .select("kind", F.explode(F.expr(posterior)).alias("p"))
        .select("kind", "p.votes", F.col("p.w").alias("p"))
    )


def classifier(found: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Log odds of a naive Bayes classifier, by kind, feature and value; the prior has feature -1."""
    soft = found.join(F.broadcast(labels), ["kind", "votes"])  # at most 7 * 3**5 rows
    each = F.concat(F.array(F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("value"))), F.transform("features", lambda v, i: F.struct(i.alias("feature"), v.alias("value"))))
    sums = (
        soft.select("kind", "p", F.explode(each).alias("f"))
        .groupBy("kind", "f.feature", "f.value")
        .agg(F.sum("p").alias("on"), F.sum(1 - F.col("p")).alias("off"))
    )
    rows = sums.collect()  # bounded by kinds, features and values
    whole = {r.kind: (r.on, r.off) for r in rows if r.feature == -1}

    def log_odds(r) -> float:
        on, off = whole[r.kind]
        if r.feature == -1:
            return log((on + 1) / (off + 1))
        return log((r.on + 1) / (on + 16)) - log((r.off + 1) / (off + 16))

    return {f"{r.kind} {r.feature} {r.value}": log_odds(r) for r in rows}


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans),
    spans (all spans), and of the spans that the method adds n_local_phone, n_number, n_secret and n_all, of
    all kinds. A span is kind:start:end; they are ordered by kind, then start, and comma-joined."""
    table = written(candidates(docs, id_column, text_column), "pii-candidates")
    each = table.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    weights = F.from_json(F.lit(json.dumps(classifier(each, reliabilities(each)))), "map<string, double>")
    is_base = lambda c: c["kind"] < len(BASE)

    def weight(c: Column, feature: Column, value: Column) -> Column:
        return F.coalesce(F.element_at(weights, F.concat_ws(" ", c["kind"], feature, value)), F.lit(0.0))

    def odds(c: Column) -> Column:
        own = F.transform(c["features"], lambda v, i: weight(c, i, v))
        return F.aggregate(own, weight(c, F.lit(-1), F.lit(0)), lambda a, b: a + b)

    def overlaps(c: Column) -> Column:
        return F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    names = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])
    count = lambda name: F.size(F.filter("kept", lambda c: c["kind"] == KINDS.index(name))).cast("bigint").alias(f"n_{name}")
    return (
        table.select("doc_id", "found", F.filter("found", is_base).alias("base"))
        .withColumn("kept", F.filter("found", lambda c: is_base(c) | (~overlaps(c) & (odds(c) >= 0))))
        .select(
            "doc_id",
            *(count(name) for name in BASE),
            F.sha2(F.array_join(F.transform("base", shown), ","), 256).alias("base_sha256"),
            F.array_join(F.transform("kept", shown), ",").alias("spans"),
            *(count(name) for name in KINDS[len(BASE) :]),
            F.size("kept").cast("bigint").alias("n_all"),
        )
    )
