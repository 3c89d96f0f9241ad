r"""Personal data by weak supervision, in DataFrame functions only.

1. Base spans: four patterns with their checks (octets, Luhn, digit counts).  The patterns are written with
   possessive repeats and anchored starts, which match what the plain ones match but never scan a run twice.
2. Candidates: looser patterns (mail addresses with "at" and "dot" spelled out, digit groups) that overlap no base span.
   They have no length limits and are linear too.
3. Labelers vote yes, no or nothing on every base and loose span, each from evidence of its own: shape (regex for the
   usual and for other forms, such as dates), gazetteer (domain endings, calling codes, card issuers, address ranges),
   context words around it, what touches it, and how varied its digits are.  None is told whether a span is a base span.
4. The votes of all documents are counted by pattern (2 x kinds x 3^5 rows at most, whatever the corpus).  On this small
   table expectation-maximisation estimates how often each labeler votes yes, no and nothing on personal data and on
   other spans (so one that always says yes tells nothing), a prior for each kind of base and of loose span, and each
   pattern's probability.  A logistic span classifier is fitted to those probabilities.
5. The classifier scores every loose span; those of ``ADD_AT`` and more are added.  Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import checkpointed, private, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this character has no match; nothing is scanned then.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_AT, _DOT = (rf"(?:\x20?[\[({{{{]\x20?{w}\x20?[\])}}}}]\x20?|\x20{w}\x20)".replace("{{", "{").replace("}}", "}") for w in ("at", "dot"))
LOOSE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*+{_AT}[a-z0-9-]++(?:(?:{_DOT}|\.)[a-z0-9-]++)++",
    "phone": r"(?<![0-9])\(?[0-9](?:[().\x20/-]*+[0-9])++",
}

# Common domain endings, issuers' first digits, words that announce each kind or something else.
ENDINGS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "eu", "us", "ca", "mx", "br", "ar", "cl", "co", "uk", "ie", "de",
    "at", "ch", "fr", "be", "nl", "lu", "es", "pt", "it", "gr", "pl", "cz", "sk", "hu", "ro", "bg", "dk", "se", "no", "fi", "ee", "lv", "lt", "ru", "ua",
    "tr", "il", "in", "cn", "jp", "kr", "au", "nz", "za",
)
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
CALLING = r"^\+(1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-8])"
ANNOUNCE = {
    "email": r"(?i)(e-?mail|mailto|contact|write to|reach|address|correo|courriel)",
    "ip": r"(?i)(\bip\b|host|server|address|adresse)",
    "card": r"(?i)(card|visa|master|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|\btel\b|mobile|cell|call|fax|\bsms\b|telefon|t[ée]l[ée]phone|tel[ée]fono)",
}
OTHERWISE = r"(?i)(version|isbn|issn|page|figure|order|total|volume|section|serial|since|between|[=$€£])[^\p{L}0-9]{0,3}$"
UNITS = r"(?i)^\s?(%|€|\$|usd|eur|km|kg|mb|gb|years?|miles|points)"
DATES = r"^(?:(?:19|20)[0-9]{2}[./\x20-][0-9]{1,2}[./\x20-][0-9]{1,2}\b|[0-9]{1,2}[./\x20-][0-9]{1,2}[./\x20-](?:19|20)[0-9]{2}\b|(?:19|20)[0-9]{2}[\x20/-]+(?:19|20)[0-9]{2}$)"
PHONES = r"^(?:\+[0-9]|(?:\([0-9]{2,5}\)[\x20./-]?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20./-][0-9]{3,4}$)"
LABELERS = ("shape", "gazetteer", "context", "touching", "variety")
#: Characters of text kept on each side of a span for the labelers.
BESIDE = 40
ADD_AT = 0.9
ROUNDS = 50
MARK = "\x01"


def _pieces(text: Column, pattern: str, needs: str = "") -> Column:
    """Gap, match, gap, match, ..., gap.  The mark is replaced in the text first; no pattern matches it or its replacement."""
    marked = F.split(F.regexp_replace(F.translate(text, MARK, "\x02"), pattern, f"{MARK}$0{MARK}"), MARK)
    return F.when(F.contains(text, F.lit(needs)), marked).otherwise(F.array(text)) if needs else marked


def _spans(pieces: str, kind: str, base: bool) -> Column:
    """Structs of kind, start, end, value, before and after for every second piece."""
    lengths = F.transform(pieces, lambda p: F.char_length(p))
    step = lambda acc, i: F.struct(
        (acc["at"] + F.element_at(lengths, i) + F.element_at(lengths, i - 1)).alias("at"),
        F.concat(acc["starts"], F.array(acc["at"] + F.element_at(lengths, i - 1))).alias("starts"),
    )
    even = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(even, none, step, lambda acc: acc["starts"])
    return F.transform(
        F.arrays_zip(even.alias("i"), starts.alias("start")),
        lambda z: F.struct(
            F.lit(kind).alias("kind"),
            z["start"].alias("start"),
            (z["start"] + F.char_length(F.element_at(pieces, z["i"]))).alias("end"),
            F.element_at(pieces, z["i"]).alias("value"),
            F.right(F.element_at(pieces, z["i"] - 1), F.lit(BESIDE)).alias("before"),
            F.left(F.element_at(pieces, z["i"] + 1), F.lit(BESIDE)).alias("after"),
            F.lit(base).alias("base"),
        ),
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit is doubled, and the digits' sum divides by 10."""
    reversed_ = F.reverse(number)
    value = lambda i: F.substr(reversed_, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(span: Column, kind: str) -> Column:
    value = span["value"]
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) > 3) & ~F.exists(F.split(value, r"\."), lambda p: F.right(p, F.lit(9)).cast("int") > 255)
    if kind == "card":
        return F.char_length(digits(value)).between(16, 19) & passes_luhn(F.left(digits(value), F.lit(19)))
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def _valid_spans(kind: str) -> Column:
    return F.filter(_spans(f"p_{kind}", kind, True), lambda s: _valid(s, kind))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def _votes(s: Column) -> Column:
    """The labelers' votes on a span, in the order of LABELERS."""
    value, kind, number = s["value"], s["kind"], digits(s["value"])
    n = F.char_length(number)
    is_ = lambda k: kind == k
    shape = _vote(
        (is_("email") & value.rlike(r"(?i)(@|[\[({]\x20?at)")) | (is_("phone") & value.rlike(PHONES) & ~value.rlike(DATES)) | (is_("card") & value.rlike(r"^[0-9]{4}(?:[\x20-]?[0-9]{4}){3}$")) | (is_("ip") & ~value.rlike(r"(^|\.)0[0-9]")),
        (is_("email") & value.rlike(r"^[0-9]+\b")) | is_("phone") | (is_("ip") & value.rlike(r"(^|\.)0[0-9]")),
    )
    ending = F.lower(F.regexp_extract(value, r"[.\]})\x20]([A-Za-z]+)$", 1)).isin(*ENDINGS)
    octet = F.regexp_extract(value, r"^0*([0-9]{1,3})\.", 1).cast("int")
    domestic = n.isin(9, 10, 11) | F.startswith(number, F.lit("0"))
    gazetteer = _vote(
        (is_("email") & ending) | (is_("card") & number.rlike(ISSUERS)) | (is_("phone") & (value.rlike(CALLING) | (~F.startswith(value, F.lit("+")) & domestic))) | (is_("ip") & octet.between(1, 223)),
        F.lit(True),
    )
    announced = F.lit(False)
    for k in KINDS:
        announced = announced | (is_(k) & s["before"].rlike(ANNOUNCE[k] + r"[^\n]{0,16}$"))
    context = _vote(announced, s["before"].rlike(OTHERWISE) | s["after"].rlike(UNITS))
    touching = _vote(F.lit(False), s["before"].rlike(r"[\p{L}0-9_/-]$") | s["after"].rlike(r"^[\p{L}0-9_/]"))
    variety = _vote(F.lit(False), ~is_("email") & (F.size(F.array_distinct(F.split(number, ""))) <= 2))
    return F.array(shape, gazetteer, context, touching, variety)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, base and loose, each with kind, start, end, base and votes.  No text is kept."""
    df = docs.select("doc_id", text_or_empty().alias("text"))
    for kind in KINDS:
        df = df.withColumn(f"p_{kind}", _pieces(F.col("text"), PATTERNS[kind], NEEDS[kind]))
    for kind, pattern in LOOSE.items():
        df = df.withColumn(f"l_{kind}", _pieces(F.col("text"), pattern))
    df = df.withColumn("base", F.concat(*[_valid_spans(k) for k in KINDS]))
    enough = lambda s: (s["kind"] != "phone") | F.char_length(digits(s["value"])).between(8, 15)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    loose = F.concat(*[F.filter(_spans(f"l_{k}", k, False), lambda s: enough(s) & free(s)) for k in LOOSE])
    df = df.withColumn("all", F.concat("base", loose))
    slim = F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), _votes(s).alias("votes")))
    return df.select("doc_id", slim.alias("spans"))


Counts = list[tuple[str, bool, tuple[int, ...], int]]


def vote_counts(spans: DataFrame) -> Counts:
    """How often each kind of base and loose span has each vote pattern: 2 * len(KINDS) * 3 ** len(LABELERS) rows at most."""
    each = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.base", "s.votes").agg(F.count("*").alias("n"))
    return sorted((r["kind"], r["base"], tuple(r["votes"]), r["n"]) for r in each.collect())


def estimate_reliabilities(counts: Counts) -> tuple[dict, dict]:
    """Expectation-maximisation over vote patterns.

    Returns each pattern's probability of being personal data, and for each labeler, truth (1 or 0) and vote the share
    of such votes.  A yes is never taken as evidence against, nor a no as evidence for.
    """
    votes, labelers = (-1, 0, 1), range(len(LABELERS))
    chance = {(k, base, v): 0.95 if base else 1 / (1 + math.exp(1 - sum(v))) for k, base, v, _ in counts}
    share: dict = {}
    for _ in range(ROUNDS):
        for j in labelers:
            for y in (0, 1):
                own = {x: 1.0 for x in votes}
                for k, base, v, n in counts:
                    p = chance[k, base, v]
                    own[v[j]] += n * (p if y else 1 - p)
                total = sum(own.values())
                share |= {(j, y, x): own[x] / total for x in votes}
            for x, better in ((1, 1), (-1, 0)):
                if share[j, better, x] < share[j, 1 - better, x]:
                    share[j, 0, x] = share[j, 1, x] = (share[j, 0, x] + share[j, 1, x]) / 2
        for kind, base in {(k, b) for k, b, _, _ in counts}:
            own = [(v, n) for k, b, v, n in counts if (k, b) == (kind, base)]
            # A prior of twenty spans: base spans are mostly right, loose ones mostly not.
            yes, all_ = (19, 20) if base else (2, 20)
            prior = (sum(chance[kind, base, v] * n for v, n in own) + yes) / (sum(n for _, n in own) + all_)
            prior = min(0.99, max(0.01, prior))
            for v, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(share[j, 1, v[j]] / share[j, 0, v[j]]) for j in labelers)
                chance[kind, base, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, share


def _features(kind: str, v: tuple[int, ...]) -> dict[str, float]:
    return {"bias": 1.0, kind: 1.0} | {f"{name}{'+' if x > 0 else '-'}": 1.0 for name, x in zip(LABELERS, v, strict=True) if x}


def fit_classifier(counts: Counts, chance: dict) -> dict[str, float]:
    """Logistic weights for a bias, the kinds and each labeler's yes and no, fitted to the patterns' probabilities by gradient descent.

    The base and the loose spans of a kind weigh alike as a whole, whichever are more.
    """
    names = ["bias", *KINDS, *(f"{name}{sign}" for name in LABELERS for sign in "+-")]
    totals: dict = {}
    for k, base, _, n in counts:
        totals[k, base] = totals.get((k, base), 0) + n
    weights = dict.fromkeys(names, 0.0)
    rows = [(_features(k, v), chance[k, base, v], n / totals[k, base] / len(totals)) for k, base, v, n in counts]
    for _ in range(3000):
        slope = {name: 0.0005 * weights[name] for name in names}
        for x, p, w in rows:
            miss = 1 / (1 + math.exp(-sum(weights[f] for f in x))) - p
            for f in x:
                slope[f] += miss * w
        for name in names:
            weights[name] -= 1.0 * slope[name]
    return weights


def classified(s: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for a span with votes."""
    logit = F.lit(weights["bias"])
    for k in KINDS:
        logit = logit + F.when(s["kind"] == k, F.lit(weights[k])).otherwise(F.lit(0.0))
    for j, name in enumerate(LABELERS):
        vote = F.element_at(s["votes"], j + 1)
        logit = logit + F.when(vote > 0, F.lit(weights[f"{name}+"])).when(vote < 0, F.lit(weights[f"{name}-"])).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _ordered(spans: Column) -> Column:
    """kind:start:end of the spans by kind, then start, joined by commas."""
    order = lambda s: sum((F.when(s["kind"] == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    keyed = F.transform(spans, lambda s: F.struct(order(s).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: doc_id, base (spans), added (spans with the classifier's probability) .

    A null text is empty; repeated rows give repeated rows; an empty table gives an empty table; extra columns are ignored.
    Very long texts are read whole.  Of loose spans that overlap a base span none is added.
    """
    spans = checkpointed(candidates(docs))
    counts = vote_counts(spans)
    chance, _ = estimate_reliabilities(counts)
    weights = fit_classifier(counts, chance)
    base = F.filter("spans", lambda s: s["base"])
    added = F.filter("spans", lambda s: ~s["base"] & (classified(s, weights) >= ADD_AT))
    return spans.select("doc_id", base.alias("base"), added.alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (base and added) of every row.

    A null or empty text has none.  Repeated rows give repeated rows, a null doc_id stays null, an empty table gives an
    empty table.  Very long texts are read whole, and so are very long spans.  Extra columns are ignored.
    """
    found = find_personal_data(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_ordered(F.col("base")), 256).alias("base_sha256"), _ordered(F.concat("base", "added")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of a text replaced by its kind in brackets.

    Rows are matched by doc_id and text, so repeated rows are masked alike; of spans that overlap the first one counts.
    Extra columns stay, whatever their names.
    """
    id_, hash_, spans_ = (private(n, docs) for n in ("id", "hash", "spans"))
    slim = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    found = find_personal_data(slim).dropDuplicates(["doc_id"])
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    cuts = found.select(F.col("doc_id.doc_id").alias(id_), F.col("doc_id.h").alias(hash_), spans.alias(spans_))
    step = lambda acc, s: F.when(
        s["start"] >= acc["upto"],
        F.struct(F.concat(acc["text"], F.substr("text", acc["upto"] + 1, s["start"] - acc["upto"]), F.lit("["), s["kind"], F.lit("]")).alias("text"), s["end"].alias("upto")),
    ).otherwise(acc)
    whole = F.aggregate(spans_, F.struct(F.lit("").alias("text"), F.lit(0).alias("upto")), step, lambda acc: F.concat(acc["text"], F.substr("text", acc["upto"] + 1, F.char_length("text"))))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    return docs.join(cuts, same).withColumn("text", F.when(F.size(spans_) > 0, whole).otherwise(F.col("text"))).select(*docs.columns)
