"""Personal data in texts by weak supervision, in DataFrame functions alone.

Base spans are those of four fixed rules (email, ip, card, phone).  Beside them wider
patterns give candidates: spelled-out addresses, longer network addresses, numbers of a
card's length with a wrong check digit, phone numbers without a plus.  The method adds
those that it takes for personal data; base spans stay whatever it thinks of them.

1. Spans.  Each kind's regular expression cuts a text into matches and the gaps between
   them; begins follow from the lengths of both, so a text is read once a pattern and
   never again for a match.  Quantifiers are possessive and matches begin where a run of
   their characters begins, which gives the same matches as the plain rules, in a time
   that grows with the text and without recursion.  Rules on the number of digits are part
   of the pattern where runs are the same whatever was matched before.
2. Votes.  Five labelers say yes, no or nothing on every candidate, base or not:
   ``rule`` (regular expression and check digit), ``gazetteer`` (top-level domains, issuer
   prefixes, calling codes, address ranges), ``before`` (words of the kind, or of other
   numbers, in the text before), ``around`` (glued to other characters), ``form`` (even
   grouping, usual length).
3. Reliabilities.  For each kind, expectation-maximisation over the counts of vote patterns
   estimates how often a labeler says yes, no or nothing on personal data and on other
   data, beginning with, and held to, mild prior beliefs.  There are at most 3**5 patterns
   a kind, so what the driver sees has a fixed size.
4. Classifier.  A naive Bayes model for each kind is trained on all candidates, each counted
   for both classes by its posterior from step 3: votes, length, shape, neighbouring words
   and characters, hashed into ``BUCKETS`` a slot.  Weights are sums of whole millionths, so
   they do not depend on the order of rows.  A wider candidate is added if the model gives
   it at least ``THRESHOLD`` and it overlaps no base span.

Spans stay with their row: nothing is shuffled but counts.  All texts are read and all
candidates count.  Defined cases: a null text is empty; texts without spans have empty
strings and the digest of an empty string; rows that repeat an id are rows of their own;
offsets are code points; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.common import read_table
from shiftspark.session import write_and_read

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
BUCKETS = 256
ROUNDS = 40
#: Characters of the text before and after that labelers and features see.
BEFORE, AFTER = 48, 24
#: Pseudo-counts behind the prior beliefs of a labeler, and of a bucket.
BELIEF, SMOOTH = 8.0, 1.0
#: Offsets are summed in blocks of so many matches.
STEP = 32

# Beliefs before any data, P(vote | class) for personal and for other data.
# A broken rule (check digit, address range, layout) speaks louder than the others.
BELIEFS = {
    "rule": ({"+": 0.8, "0": 0.17, "-": 0.03}, {"+": 0.05, "0": 0.35, "-": 0.6}),
    "gazetteer": ({"+": 0.7, "0": 0.2, "-": 0.1}, {"+": 0.2, "0": 0.3, "-": 0.5}),
    "before": ({"+": 0.4, "0": 0.55, "-": 0.05}, {"+": 0.05, "0": 0.65, "-": 0.3}),
    "around": ({"+": 0.6, "0": 0.3, "-": 0.1}, {"+": 0.3, "0": 0.4, "-": 0.3}),
    "form": ({"+": 0.7, "0": 0.25, "-": 0.05}, {"+": 0.3, "0": 0.4, "-": 0.3}),
}

# Rules of the base spans.  Local parts begin where their run begins, or at the end of the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])"

# Wider patterns.
SPELLED = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?: ?[\[(](?i:at|@)[\])] ?| (?i:at) )"
           r"[A-Za-z0-9-]++(?:(?: ?[\[(](?i:dot|\.)[\])] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++")
IP6 = r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])"
LOCAL = (r"(?<![0-9A-Za-z+.,/-])(?<![0-9+][ (])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}"
         r"(?:[ ./-][0-9]{2,4}){1,4}+(?![0-9A-Za-z]|[ .,/-]?[0-9])")

# Gazetteers and words of the labelers.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|eu|uk|us|ca|de|at|ch|fr|be|nl|es|mx|ar|it|pt|br|pl|se|no|dk|fi|ie|jp|cn|in|au|nz|ru"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|30|35|6011|62|65)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|85[0-9]|88[06]|9[679][0-9])"
WORDS = {
    "email": r"\b(?:e-?mail|mail|contact|write|correo|courriel|adresse|kontakt|contacto|schreib\w*|escrib\w*|[eé]cri\w*)\b",
    "ip": r"\b(?:ip|ipv[46]|host|server|client|login|address|adresse|serveur|servidor|direcci[oó]n|gateway|subnet)\b",
    "card": r"\b(?:card|credit|debit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta|account|konto|compte|cuenta|iban)\b",
    "phone": r"\b(?:tel|tel[eé]fono|telefon|t[eé]l[eé]phone|phone|call|mobile|cell|fax|handy|anruf\w*|appel\w*|llam\w*|m[oó]vil|portable|whatsapp)\b",
}
OTHER_NUMBERS = (r"\b(?:version|v|order|invoice|isbn|issn|doi|sku|serial|build|release|chapter|section|page|item|article|part|model|"
                 r"hash|sha|md5|uuid|id|seed|time|date|score|rechnung|bestellung|facture|commande|pedido|factura)\b")

_SPANS = "array<struct<s:int,e:int,t:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def sums_before(widths: Column, depth: int = 2) -> Column:
    """For each number of an array, the sum of those before it; through the sums of blocks, and of
    blocks of blocks, so long arrays stay cheap."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def block(i: Column) -> Column:
        return F.floor(i / STEP).cast("int")

    def blocks(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), block(F.size(w) - 1)), lambda b: total(F.slice(w, b * STEP + 1, F.lit(STEP))))

    if depth == 0:
        return let(widths, lambda w: F.transform(w, lambda x, i: total(F.slice(w, F.lit(1), i))))
    return let(widths, lambda w: let(sums_before(blocks(w), depth - 1), lambda first: F.transform(
        w, lambda x, i: F.get(first, block(i)) + total(F.slice(w, block(i) * STEP + 1, i % STEP)))))


def found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern``: s, e (code points), t, and the ends of the gaps before and after."""
    def placed(x: Column) -> Column:
        gaps, hits = x["g"], x["h"]
        widths = F.zip_with(gaps, hits, lambda g, h: F.char_length(g) + F.coalesce(F.char_length(h), F.lit(0)))
        return let(sums_before(widths), lambda at: F.transform(hits, lambda t, i: let(
            F.get(at, i) + F.char_length(F.get(gaps, i)),
            lambda s: F.struct(s.alias("s"), (s + F.char_length(t)).alias("e"), t.alias("t"),
                               F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(
        F.size(h) > 0, let(F.struct(F.split(text, pattern, -1).alias("g"), h.alias("h")), placed)).otherwise(F.array().cast(_SPANS)))


def luhn(number: Column) -> Column:
    """Whether a number's digits pass the check of Luhn."""
    def worth(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))
    return let(digits, lambda r: F.aggregate(
        F.sequence(F.lit(0), F.char_length(r) - 1), F.lit(0),
        lambda acc, i: acc + worth(F.substring(r, i + 1, F.lit(1)).cast("int"), i))) % 10 == 0


def _vote(*cases: tuple[Column, str]) -> Column:
    out = None
    for when, vote in cases:
        out = F.when(when, F.lit(vote)) if out is None else out.when(when, F.lit(vote))
    return out.otherwise(F.lit("0"))


def _votes(kind: str, x: Column, base: Column, luhn_ok: Column | None) -> Column:
    """The labelers' votes on a match, one character each."""
    t, low = x["t"], F.lower(x["before"])
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == "email":
        rule = _vote((base | t.rlike(r"[\[(]"), "+"))
        gazetteer = _vote((t.rlike(r"(?i)[^A-Za-z](?:" + DOMAINS + r")$"), "+"), (F.lit(True), "-"))
        form = _vote((t.rlike(r"^[A-Za-z0-9]") & (F.char_length(t) <= 64), "+"), (F.char_length(t) > 120, "-"))
    elif kind == "ip":
        rule = _vote((base | t.rlike("::") | t.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}"), "+"), (F.lit(True), "-"))
        gazetteer = _vote((t.rlike(r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\.") | t.rlike(r"(?i)^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):"), "+"), (F.lit(True), "-"))
        form = _vote((t.rlike(r"(?:^|[.])0[0-9]"), "-"), (t.rlike(r"^[0-9]{1,2}:[0-9]{2}:"), "-"))
    elif kind == "card":
        rule = _vote((luhn_ok, "+"), (F.lit(True), "-"))
        gazetteer = _vote((digits.rlike(ISSUERS), "+"), (F.lit(True), "-"))
        form = _vote((t.rlike(r"^[0-9]+$|^[0-9]{4}([ -])(?:[0-9]{4}\1){1,3}[0-9]{1,4}$") & F.char_length(digits).isin(13, 14, 15, 16), "+"), (t.rlike("[ -]"), "-"))
    else:
        rule = _vote((base | t.rlike(r"^\("), "+"), (t.rlike(r"^[0-9]+(?:\.[0-9]+)+$"), "-"))
        gazetteer = _vote((t.rlike(CALLING) | t.rlike(r"^\(|^0[1-9]|^00[1-9]|^[2-9][0-9]{2}[ ./-][2-9][0-9]{2}[ ./-][0-9]{4}$"), "+"), (F.lit(True), "-"))
        form = _vote((t.rlike(r"^\+?[0-9 ]*(?:\([0-9]+\))?[ ]?[0-9]+(?:([ ./-])[0-9]+)(?:\1[0-9]+)*$"), "+"), (F.char_length(t) > 24, "-"))
    before = _vote((low.rlike(WORDS[kind]), "+"), (low.rlike(OTHER_NUMBERS), "-"))
    around = _vote((x["before"].rlike(r"[A-Za-z0-9_#$=/\\]$") | x["after"].rlike(r"^[A-Za-z0-9_=/\\]"), "-"),
                   (x["before"].rlike(r"(?:^|[\s(:,;<\"'])$") & x["after"].rlike(r"^(?:$|[\s).,:;>\"'!?])"), "+"))
    return F.concat(rule, gazetteer, before, around, form)


def _features(x: Column, votes: Column) -> Column:
    """Slot numbers times BUCKETS plus a hash: length, shape, words and characters beside, begin, votes."""
    shape = F.regexp_replace(F.regexp_replace(x["t"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    word = r"(\p{L}+)[^\p{L}]*$"
    seen = [F.char_length(x["t"]).cast("string"), shape, F.lower(F.regexp_extract(x["before"], word, 1)),
            F.lower(F.regexp_extract(x["after"], r"^[^\p{L}]*(\p{L}+)", 1)), F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1)),
            F.left(F.regexp_replace(x["t"], "[^0-9A-Za-z]", ""), F.lit(2))]
    seen += [F.substring(votes, i + 1, 1) for i in range(len(BELIEFS))]
    return F.array(*[(F.pmod(F.xxhash64(v), F.lit(BUCKETS)) + i * BUCKETS).cast("int") for i, v in enumerate(seen)])


SLOTS = 7 + len(BELIEFS)


def _candidates(kind: str, spans: Column, is_base: Callable[[Column], Column]) -> Column:
    """s, k (the kind's number), e, base, votes, feats of every match."""
    def one(x: Column) -> Column:
        checked = luhn(x["t"]) if kind == "card" else None
        base = checked if kind == "card" else is_base(x)
        return let(base, lambda b: let(_votes(kind, x, b, b), lambda v: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), b.alias("base"), v.alias("votes"), _features(x, v).alias("feats"))))

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """All candidates of a text: base spans and wider ones."""
    yes, no = (lambda x: F.lit(True)), (lambda x: F.lit(False))

    def digits(x: Column) -> Column:
        return F.char_length(F.regexp_replace(x["t"], "[^0-9]", "")).between(9, 15)

    return F.concat(
        _candidates("email", found(text, EMAIL), yes), _candidates("email", found(text, SPELLED), no),
        _candidates("ip", found(text, IP), lambda x: x["t"].rlike(IP_PARTS)), _candidates("ip", found(text, IP6), no),
        _candidates("card", found(text, CARD), yes),
        _candidates("phone", found(text, PHONE), yes), _candidates("phone", F.filter(found(text, LOCAL), digits), no))


def reliabilities(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> tuple[dict[str, float], float, list[dict[str, dict[str, float]]]]:
    """From (votes, count): each pattern's posterior, the share of personal data, and P(vote | class) of each labeler.

    The prior beliefs count as ``BELIEF`` candidates of each class.
    """
    table = [{"yes": dict(yes), "no": dict(no)} for yes, no in BELIEFS.values()]
    share = 0.5

    def posterior(votes: str) -> float:
        odds = math.log(share / (1 - share)) + sum(math.log(t["yes"][v] / t["no"][v]) for t, v in zip(table, votes, strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))

    for _ in range(rounds):
        weight = {p: posterior(p) for p, _ in patterns}
        total = {"yes": sum(weight[p] * c for p, c in patterns), "no": sum((1 - weight[p]) * c for p, c in patterns)}
        share = (total["yes"] + BELIEF) / (total["yes"] + total["no"] + 2 * BELIEF)
        for i, beliefs in enumerate(BELIEFS.values()):
            for k, belief in zip(("yes", "no"), beliefs, strict=True):
                for v in "+0-":
                    hit = sum((weight[p] if k == "yes" else 1 - weight[p]) * c for p, c in patterns if p[i] == v)
                    table[i][k][v] = (hit + BELIEF * belief[v]) / (total[k] + BELIEF)
    return {p: posterior(p) for p, _ in patterns}, share, table


def label_model(cands: DataFrame) -> dict[tuple[int, str], float]:
    """Posterior of every kind and vote pattern that occurs (``cands``: k, votes)."""
    rows = cands.groupBy("k", "votes").count().orderBy("k", "votes").collect()      # at most 4 x 3**5
    out = {}
    for k in range(len(KINDS)):
        got, _, _ = reliabilities([(r.votes, r["count"]) for r in rows if r.k == k])
        out |= {(k, v): p for v, p in got.items()}
    return out


def train(cands: DataFrame, posteriors: dict[tuple[int, str], float]) -> tuple[list[float], list[float]]:
    """Log-odds of each kind and of each of its features, from ``cands`` (k, votes, feats).

    The counts are one row for each kind and bucket at most.
    """
    millionths = {f"{k}{v}": round(p * 1_000_000) for (k, v), p in posteriors.items()}
    known = F.str_to_map(F.lit(";".join(f"{k}={p}" for k, p in millionths.items())), F.lit(";"), F.lit("="))
    rows = cands.select("k", "feats", known[F.concat(F.col("k").cast("string"), F.col("votes"))].cast("long").alias("w"))
    # Feature -1 counts the candidates themselves.
    counts = (rows.select("k", F.explode(F.concat(F.array(F.lit(-1)), "feats")).alias("f"), "w")
              .groupBy("k", "f").agg(F.sum("w").alias("yes"), F.sum(1_000_000 - F.col("w")).alias("no")).collect())
    got = {(r.k, r.f): (r.yes / 1e6, r.no / 1e6) for r in counts}
    prior, weights = [], []
    for k in range(len(KINDS)):
        yes, no = got.get((k, -1), (0.0, 0.0))
        prior.append(math.log((yes + SMOOTH) / (no + SMOOTH)))
        for f in range(SLOTS * BUCKETS):
            y, n = got.get((k, f), (0.0, 0.0))
            weights.append(math.log((y + SMOOTH) / (yes + 2 * SMOOTH)) - math.log((n + SMOOTH) / (no + 2 * SMOOTH)) if y + n else 0.0)
    return prior, weights


def _numbers(values: list[float]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(f"{v:.9f}" for v in values)), ",").cast("array<double>")


def score(c: Column, prior: list[float], weights: list[float]) -> Column:
    """Log-odds of a candidate."""
    per_kind = SLOTS * BUCKETS
    return F.aggregate(c["feats"], F.get(_numbers(prior), c["k"]), lambda acc, f: acc + F.get(_numbers(weights), c["k"] * per_kind + f))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    return F.array_join(F.transform(order, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["k"] == kind)).cast("long")


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = write_and_read(docs.select(F.col(f"`{id_col}`").alias("id"), candidates(text).alias("cands")), "candidates")
    cands = rows.select(F.explode("cands").alias("c")).select("c.k", "c.votes", "c.feats")
    prior, weights = train(cands, label_model(cands))
    least = math.log(threshold / (1 - threshold))
    base = F.filter("cands", lambda c: c["base"])
    rows = rows.withColumn("base", base)
    added = F.filter("cands", lambda c: ~c["base"] & (score(c, prior, weights) >= least)
                     & ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    rows = rows.withColumn("added", added)
    return rows.select(
        F.col("id").alias(id_col),
        *[_count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    return private_data(read_table(spark, sf_dir, "documents"))
