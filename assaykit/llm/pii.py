"""Personal data by weak supervision, in DataFrame functions only.

Candidates of seven kinds are found by pattern.  Five labelers vote on each (1, 0 or no
vote): strict shape, gazetteer, cue words before, counter-cues around, and clean
borders.  Expectation-maximisation over the counts of equal vote patterns estimates each
labeler's reliability per kind and the probability that a pattern is personal data; a
logistic span classifier is trained on these probabilities and decides on the candidates.
The patterns are a fixed number (kinds x votes x shape classes), so their counts are all
that the driver sees, whatever the size of the corpus.

``email``, ``ip``, ``card`` and ``phone`` that pass their shape rule are always spans (the
base); the classifier adds ``secret``, ``name`` and ``ssn`` spans that overlap no base span.

Cases: null texts are empty and have no spans; spans of equal start are ordered by kind;
every row is judged for itself, so repeated rows get equal spans.  Other columns are left
alone; helper columns start with ``_pii``.  An empty table gives no rows.

Patterns use possessive runs: in very long texts a run can neither exhaust the stack nor
be scanned once per character.
"""

import numpy as np
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "name", "ssn")
BASE = 4
LABELERS = ("shape", "gazetteer", "cue", "counter", "border")
CUE_WINDOW = 40
THRESHOLD = 0.5
ROUNDS = 50

# Gazetteers.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Sr|Sra|Señor|Señora"
FIRST_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Susan|Thomas|Sarah|Anna|Peter|"
    "Hans|Klaus|Ursula|Jean|Marie|Pierre|Luc|Juan|Carmen|Luis|Ana"
)
SECRET_PREFIXES = "AKIA|ASIA|AIza|ghp_|gho_|sk_live_|sk_test_|sk-|xoxb-|xoxp-|glpat-"

CANDIDATES = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,200}[0-9])(?:(?:%s)[A-Za-z0-9_-]{12,}+|[A-Za-z0-9_-]{24,}+)" % SECRET_PREFIXES,
    r"(?=[A-Z])(?<!\p{L})(?:(?:%s)\.?|%s) \p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?" % (TITLES, FIRST_NAMES),
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
)
# A text that lacks these cannot hold the kind; looking for single characters is cheap.
NEEDS = ("@", "digit", "digit", "digit", "digit", " ", "digit")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
GAZETTEER = (
    r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    r"^(?!0\.|127\.|255\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-58])",
    "^(?:%s)" % SECRET_PREFIXES,
    r"^(?:%s)\b" % TITLES,
    r"^(?!000|666|9)",
)
CUES = (
    r"mail|e-mail|contact|courriel|correo|write to",
    r"\bip\b|address|host|server|adresse",
    r"card|visa|credit|karte|carte|tarjeta",
    r"phone|tel|call|fax|mobil|anruf|appel|llam",
    r"key|token|secret|passw|credential",
    r"name|dear|signed|sincerely|contact|author|liebe|cher|estimad",
    r"ssn|social",
)
COUNTER = r"version|isbn|invoice|order no|section|chapter|sha|commit|http|uuid"


def _shape(kind, value):
    """Whether a match passes the rule of its kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.lit(True),
        value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        n.between(12, 19) & F.call_function("luhn_check", digits),
        n.between(9, 15),
        value.rlike("[0-9]") & value.rlike("[A-Za-z]"),
        F.length(value) >= 6,
        value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
    )[kind]


def _located(found, pieces):
    """``(value, start)`` of the matches from what lies between them; ``start`` counts code points from 0."""
    none = F.array().cast("array<struct<value:string,start:int>>")
    return F.aggregate(
        F.arrays_zip(found.alias("value"), F.slice(pieces, 1, F.size(found)).alias("gap")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gap"]) + F.length(m["value"])).alias("at"),
            F.concat(
                acc["out"], F.array(F.struct(m["value"].alias("value"), (acc["at"] + F.length(m["gap"])).alias("start")))
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _vote(condition, otherwise=0):
    return F.when(condition, F.lit(1)).otherwise(F.lit(otherwise)).cast("tinyint")


def with_candidates(documents, text="text", to="_pii_candidates"):
    """``documents`` with an array of candidate spans and the votes on them."""
    df = documents.withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    body = F.col("_pii_text")
    digit = body.contains("0")
    for d in "123456789":
        digit = digit | body.contains(d)
    df = df.withColumn("_pii_digit", digit)
    empty = F.array().cast("array<string>")
    for k, (pattern, need) in enumerate(zip(CANDIDATES, NEEDS)):
        there = F.col("_pii_digit") if need == "digit" else body.contains(need)
        df = df.withColumn(
            f"_pii_found{k}", F.when(there, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(empty)
        )
    none = F.array().cast("array<struct<value:string,start:int>>")
    for k, pattern in enumerate(CANDIDATES):
        found = F.col(f"_pii_found{k}")
        df = df.withColumn(
            f"_pii_at{k}", F.when(F.size(found) > 0, _located(found, F.split(body, pattern, -1))).otherwise(none)
        )

    def candidate(k):
        def made(m):
            value, start = m["value"], m["start"]
            end = start + F.length(value)
            before = F.lower(F.substr(body, F.greatest(start - CUE_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(CUE_WINDOW))))
            around = F.concat(before, F.lit(" "), F.lower(F.substr(body, end + 1, F.lit(CUE_WINDOW))))
            edge = F.concat(F.substr(before, F.length(before)), F.lit("|"), F.substr(body, end + 1, F.lit(1)))
            digits = F.regexp_count(value, F.lit("[0-9]"))
            shape = _shape(k, value)
            return F.struct(
                start.alias("start"),
                F.lit(k).cast("tinyint").alias("kind"),
                end.alias("end"),
                (shape & F.lit(k < BASE)).alias("base"),
                _vote(shape).alias("shape"),
                _vote(value.rlike(GAZETTEER[k])).alias("gazetteer"),
                _vote(before.rlike(CUES[k]), -1).alias("cue"),
                F.when(around.rlike(COUNTER), F.lit(0)).otherwise(F.lit(-1)).cast("tinyint").alias("counter"),
                _vote(edge.rlike(r"^[^\p{L}0-9]?\|[^\p{L}0-9]?$")).alias("border"),
                F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("tinyint").alias("long"),
                F.floor(digits * 2 / F.length(value)).cast("tinyint").alias("digits"),
            )

        return F.transform(f"_pii_at{k}", made)

    df = df.withColumn(to, F.concat(*(candidate(k) for k in range(len(KINDS)))))
    return df.drop("_pii_text", "_pii_digit", *(f"_pii_{x}{k}" for x in ("found", "at") for k in range(len(KINDS))))


PATTERN = ["kind", *LABELERS, "long", "digits"]


def estimate(kinds, votes, counts, rounds=ROUNDS):
    """EM over vote patterns: ``(probability of each pattern, hit rates, false alarm rates)``.

    ``votes`` holds 1, 0 or -1 for no vote.  Every labeler has a prior worth a few votes
    that it is right more often than not, which fixes what the two classes mean.
    """
    cast, yes = votes >= 0, votes == 1
    hit, alarm = np.full((len(KINDS), votes.shape[1]), 0.8), np.full((len(KINDS), votes.shape[1]), 0.2)
    prior = np.full(len(KINDS), 0.5)
    belief = np.zeros(len(counts))
    for _ in range(rounds):
        def likelihood(rate):
            rate = rate[kinds]
            return np.where(cast, np.where(yes, np.log(rate), np.log1p(-rate)), 0.0).sum(axis=1)

        odds = np.log(prior[kinds]) - np.log1p(-prior[kinds]) + likelihood(hit) - likelihood(alarm)
        belief = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for k in range(len(KINDS)):
            of = kinds == k
            good, bad = counts[of] * belief[of], counts[of] * (1 - belief[of])
            prior[k] = (good.sum() + 2) / (counts[of].sum() + 4)
            hit[k] = ((good[:, None] * (yes & cast)[of]).sum(axis=0) + 4) / ((good[:, None] * cast[of]).sum(axis=0) + 5)
            alarm[k] = ((bad[:, None] * (yes & cast)[of]).sum(axis=0) + 1) / ((bad[:, None] * cast[of]).sum(axis=0) + 5)
    return belief, hit, alarm


def features(row):
    """The classifier's inputs for one pattern: kind, each vote both ways, length and digit classes."""
    x = [float(row["kind"] == k) for k in range(len(KINDS))]
    for name in LABELERS:
        x += [float(row[name] == 1), float(row[name] == 0)]
    x += [float(row["long"] == i) for i in range(4)] + [float(row["digits"] == i) for i in range(3)]
    return x


def fit(candidates, column="_pii_candidates"):
    """Weights of the span classifier from all candidates of the corpus."""
    spans = candidates.select(F.explode(column).alias("c")).select("c.*")
    rows = spans.groupBy(*PATTERN).agg(F.count(F.lit(1)).alias("count")).orderBy(*PATTERN).collect()
    width = len(features({name: 0 for name in PATTERN}))
    weights = np.zeros(width)
    if not rows:
        return weights.tolist()
    counts = np.array([r["count"] for r in rows], float)
    votes = np.array([[r[name] for name in LABELERS] for r in rows])
    belief, _, _ = estimate(np.array([r["kind"] for r in rows]), votes, counts)
    x = np.array([features(r) for r in rows])
    for _ in range(30):  # Newton steps with a ridge; the counts weigh the patterns
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (belief - p)) - weights
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(width)
        move = np.linalg.solve(curve, slope)
        weights += move
        if np.abs(move).max() < 1e-9:
            break
    return [float(round(w, 9)) for w in weights]


def _probability(c, weights):
    w = iter(weights)
    terms = [F.when(c["kind"] == k, next(w)).otherwise(0.0) for k in range(len(KINDS))]
    for name in LABELERS:
        terms += [F.when(c[name] == 1, next(w)).otherwise(0.0), F.when(c[name] == 0, next(w)).otherwise(0.0)]
    terms += [F.when(c["long"] == i, next(w)).otherwise(0.0) for i in range(4)]
    terms += [F.when(c["digits"] == i, next(w)).otherwise(0.0) for i in range(3)]
    z = terms[0]
    for t in terms[1:]:
        z = z + t
    return 1 / (1 + F.exp(-z))


def with_spans(candidates, weights, column="_pii_candidates", to="spans", threshold=THRESHOLD):
    """Candidates decided on: an array of ``(start, kind, end, base)`` by start, then kind."""
    base = F.filter(column, lambda c: c["base"])
    free = lambda c: ~F.exists("_pii_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter(
        column, lambda c: (c["kind"] >= BASE) & (_probability(c, weights) >= threshold) & free(c)
    )
    short = lambda a: F.transform(a, lambda c: F.struct(c["start"], c["kind"], c["end"], c["base"]))
    typed = "array<struct<start:int,kind:tinyint,end:int,base:boolean>>"
    return (
        candidates.withColumn("_pii_base", base)
        .withColumn(to, F.sort_array(F.concat(short(F.col("_pii_base")), short(added)).cast(typed)))
        .drop("_pii_base", column)
    )


def span_text(spans):
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text, spans):
    """The text with each span replaced by its kind in angle brackets; overlapping spans share one."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = F.array(*map(F.lit, KINDS))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substr(body, acc["at"] + 1, s["start"] - acc["at"]),
                    F.lit("<"),
                    F.upper(F.element_at(names, s["kind"] + 1)),
                    F.lit(">"),
                ).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)),
    )
