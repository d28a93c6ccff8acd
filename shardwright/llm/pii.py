"""Personal data by weak-supervision aggregation, in built-in expressions only.

Patterns propose spans. Those of the base kinds are settled by their own rules; the other kinds
are proposed loosely, and on each such span five labelers vote for, against or not at all: the
strict form, a gazetteer, the words before it, a checksum (for secrets the spread of
characters) and the surface.
Expectation-maximisation over the counts of vote patterns (a table of bounded size: kinds times
three to the number of labelers times size classes) estimates each labeler's reliability, by
kind and drawn to its reliability over all kinds, and a posterior for each pattern. A logistic
span classifier is trained on the posteriors and alone decides which proposals are spans.

Offsets are code points. Splitting a text at a pattern and extracting its matches gives the gaps
and the matches in turn; their running lengths are the offsets. All patterns run in linear time:
runs that have a start only where a run begins (or where the last match ended) are possessive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.llm.common import materialize, table, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "iban", "local_phone", "person")
LABELERS = ("pattern", "gazetteer", "context", "checksum", "surface")

_NAMES = (
    "Alexander|Alice|Andrea|Andrew|Antonio|Barbara|Benjamin|Carlos|Catherine|Charles|Charlotte|Christian|Christine|"
    "Christopher|Daniel|David|Dorothy|Edward|Elizabeth|Emily|Emma|Fernando|Francisco|François|Frank|George|Guillaume|"
    "Heinrich|Helen|Isabel|Jacques|James|Javier|Jennifer|Jessica|Johann|John|Joseph|Juan|Julia|Jürgen|Karl|Katharina|"
    "Klaus|Laura|Linda|Luis|Manuel|Margaret|Maria|Marie|Mary|Matthew|Michael|Michel|Miguel|Nancy|Nathalie|Nicolas|"
    "Pablo|Patricia|Paul|Pedro|Peter|Philippe|Pierre|Richard|Robert|Sarah|Sebastian|Sophie|Stefan|Stephen|Susan|"
    "Thomas|Ursula|Victoria|Werner|William|Wolfgang|Xavier|Yvonne"
)
_TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
_LOCAL = "A-Za-z0-9._%+-"
_CUES = r"(?:my name is|signed by|written by|regards,|contact:|ich heiße|je m'appelle|me llamo)\x20"
#: What names a secret, and the sign and quote between it and its value.
_KEYS = r"(?i:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|passwort|contraseña|mot de passe|credential)"
_ASSIGNED = rf"{_KEYS}[A-Za-z_]{{0,12}}+[\"']?\x20{{0,2}}(?:=>|:=|=|:)\x20{{0,2}}[\"']?"
_NAMED = rf"{_KEYS}[A-Za-z_]{{0,12}}[^A-Za-z0-9]{{0,6}}$"
_RUN = "A-Za-z0-9_+/-"

#: Kind: what a text must contain to be looked through (cheap), and the pattern.
PATTERNS = {
    "email": (lambda t: F.contains(t, F.lit("@")), rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (lambda t: t.rlike("[0-9]"), r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (
        lambda t: t.rlike(rf"{_KEYS}|[0-9][A-Za-z]|[A-Za-z][0-9]"),
        rf"{_ASSIGNED}[^\s\"'<>,;]{{6,}}+|(?<![{_RUN}])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[{_RUN}]{{16,}}+={{0,2}}+(?![\"']?\x20{{0,2}}[=:])",
    ),
    "ssn": (lambda t: t.rlike(r"[0-9][\x20-][0-9]"), r"(?<![0-9-])[0-9]{3}([\x20-])[0-9]{2}\1[0-9]{4}(?![0-9-])"),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": (lambda t: t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]"), r"(?<![0-9+().-])(?<!\+[0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    "person": (
        lambda t: t.rlike(r"[A-Z]\p{L}+\.?\x20[A-Z]"),
        rf"(?<!\p{{L}})(?:(?i:{_CUES})(?:[A-Z]\p{{L}}++\x20)?|(?=[A-Z])(?:(?:{_TITLES})\.?\x20(?:[A-Z]\p{{L}}++\x20)?|(?:{_NAMES})\x20))[A-Z]\p{{Ll}}++(?!\p{{L}})",
    ),
}
#: What stands at the front of a match and is no part of the span.
HEADS = {"secret": rf"^{_ASSIGNED}", "person": rf"^(?i:{_CUES})"}


def running_sums(steps: Column, chunk: int = 256) -> Column:
    """Inclusive sums of an array of longs, by chunks, so that the cost stays near linear."""
    zero = F.array().cast("array<bigint>")

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), zero.alias("all"))
        step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["all"], a["s"] + x).alias("all"))
        return F.aggregate(values, start, step, lambda a: a["all"])

    n_chunks = F.ceil(F.size(steps) / chunk).cast("int")
    inner = F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))), lambda c: sums(F.slice(steps, c * chunk + 1, chunk)))
    carried = sums(F.transform(inner, lambda part: F.coalesce(F.try_element_at(part, F.lit(-1)), F.lit(0).cast("long"))))
    shifted = F.transform(inner, lambda part, c: F.transform(part, lambda x: x + F.when(c > 0, F.get(carried, c - 1)).otherwise(0)))
    return F.flatten(shifted)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check digit is right: from the last digit on, every second one counts double, less 9 above 9."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substr(F.reverse(digits), i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    """The IBAN check: its country and check digits moved to the end, letters as 10 to 35, leave 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    found = F.when(yes, 1)
    return F.coalesce(found.when(no, -1).otherwise(0) if no is not None else found.otherwise(0), F.lit(0))


def votes(kind: str, value: Column, before: Column) -> list[Column]:
    """The labelers' votes on one span, in their order: 1 for, -1 against, 0 none."""
    context = {
        "secret": r"(?<!http)(?<!https)(?:=>|:=|=|:)\x20{0,2}[\"']?$|\b(?:key|bearer|secret|token|password)\x20$",
        "ssn": r"\bssn\b|social security",
        "iban": r"iban|account|konto|compte|cuenta|transfer|bank",
        "local_phone": r"tel|phone|call|fax|mobil|handy|llam|appel|contact",
        "person": r"name|called|signed|contact|regards|heiß|nomm|llam|appelle|author|written by",
    }[kind]
    against = {
        "person": r"street|saint|avenue|straße|university",
        "secret": r"https?:$|[./\\]$|\b(?:commit|sha1|sha256|md5|checksum|digest|version|revision|uuid|isbn)\b",
    }.get(kind, r"version|isbn|serial|license|order no|\bv$")
    said = _vote(before.rlike(context), before.rlike(against))
    none = F.lit(0)
    digits = _digits(value)
    changes = F.regexp_count(value, F.lit(r"(?:[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9]))"))
    spread = F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), "")))
    by_kind = {
        "secret": (
            _vote(value.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}.*|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2})$"), ~before.rlike(_NAMED)),
            _vote(before.rlike(_NAMED) | value.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|eyJ)")),
            _vote(spread >= 10, spread < 7),
            _vote(changes >= 4, changes < 2),
        ),
        "ssn": (_vote(~value.rlike(r"^(?:000|666|9)|[\x20-]00[\x20-]|[\x20-]0000$"), F.lit(True)), none, none, _vote(value.rlike("-"), F.lit(True))),
        "iban": (_vote(F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), F.lit(True)), _vote(value.rlike("^(?:DE|FR|ES|IT|GB|CH|AT|NL|BE|PT|IE|LU|PL|SE|DK|NO|FI)")), _vote(_mod97(value), F.lit(True)), none),
        "local_phone": (_vote(value.rlike(r"^\(?[2-9]"), F.lit(True)), none, none, _vote(value.rlike(r"^(?:\([0-9]{3}\)\x20|[0-9]{3}([.-])[0-9]{3}\1)"), F.lit(True))),
        "person": (_vote(value.rlike(rf"^(?:{_TITLES})\b")), _vote(value.rlike(rf"(?:^|\x20)(?:{_NAMES})\b")), none, _vote(value.rlike(r"^[^\x20]+\x20[^\x20]+"), F.lit(True))),
    }
    pattern, gazetteer, checksum, surface = by_kind[kind]
    return [pattern, gazetteer, said, checksum, surface]


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, email, ip, ...``: per base kind the array of its spans ``start, end``, per other kind that of proposals.

    A proposal also has ``votes`` and ``size``, the binary logarithm of its length, rounded down and at most 7.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    for kind, (hint, pattern) in PATTERNS.items():
        text = F.col("text")
        none = F.array().cast("array<string>")
        rows = rows.withColumn(f"m_{kind}", F.when(hint(text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = {k: F.size(f"m_{k}") > 0 for k in PATTERNS}
    rows = rows.select(
        "doc_id",
        *[f"m_{k}" for k in PATTERNS],
        *[
            F.when(some[k], F.transform(F.split("text", p, -1), lambda g: F.struct(F.length(g).alias("n"), F.lower(F.right(g, F.lit(24))).alias("before")))).alias(f"g_{k}")
            for k, (_, p) in PATTERNS.items()
        ],
    )

    def steps(kind: str) -> Column:
        last = lambda i: F.when(i > 0, F.length(F.get(f"m_{kind}", i - 1))).otherwise(0)
        return F.transform(f"m_{kind}", lambda _, i: (F.get(f"g_{kind}", i)["n"] + last(i)).cast("long"))

    rows = rows.select("*", *[F.when(some[k], running_sums(steps(k))).alias(f"s_{k}") for k in PATTERNS])

    def made(kind: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            head = F.regexp_extract(x, HEADS[kind], 0) if kind in HEADS else F.lit("")
            value = F.substr(x, F.length(head) + 1, F.length(x)) if kind in HEADS else x
            start = F.get(f"s_{kind}", i) + F.length(head)
            fields = [start.alias("start"), (start + F.length(value)).alias("end")]
            if kind in BASE:
                return F.struct(*fields, valid(kind, x).alias("valid"))
            before = F.get(f"g_{kind}", i)["before"]
            before = F.right(F.concat(before, F.lower(head)), F.lit(24)) if kind in HEADS else before
            size = F.least(F.floor(F.log2(F.greatest(F.length(value), F.lit(1)))), F.lit(7)).cast("int")
            return F.struct(*fields, size.alias("size"), F.array(*[v.cast("int") for v in votes(kind, value, before)]).alias("votes"))

        found, more = F.transform(f"m_{kind}", one), ",size:int,votes:array<int>"
        if kind in BASE:
            found, more = F.transform(F.filter(found, lambda s: s["valid"]), lambda s: s.dropFields("valid")), ""
        return F.when(some[kind], found).otherwise(F.array().cast(f"array<struct<start:bigint,end:bigint{more}>>"))

    return rows.select("doc_id", *[made(k).alias(k) for k in PATTERNS])


#: Pseudo-spans by which a kind's rates are drawn to those over all kinds, and these to a labeler a little better than chance.
POOLED = 50.0
#: Pseudo-spans of either class by which a kind's share of true spans is drawn.
SHARE = (3.0, 2.0)
PRIOR = ({-1: 0.16, 0: 0.64, 1: 0.2}, {-1: 0.07, 0: 0.28, 1: 0.65})

Pattern = tuple[str, tuple[int, ...], int, int]


def majority(patterns: list[Pattern]) -> list[float]:
    """The first guess: every labeler is as reliable as ``PRIOR`` says, so three votes for, or more for each against, make a span."""
    odds = SHARE[0] / SHARE[1]
    return [1 / (1 + odds * math.prod(PRIOR[0][v] / PRIOR[1][v] for v in found)) for _, found, _, _ in patterns]


def fit_labels(patterns: list[Pattern], rounds: int = 50) -> tuple[list[float], dict]:
    """Posterior of each (kind, votes, size, count) and the labelers' reliabilities, by expectation-maximisation.

    A labeler votes 1, 0 or -1 with a probability for either class. The rates of a kind are
    drawn to the rates over all kinds by ``POOLED`` pseudo-spans, and those to ``PRIOR`` by as
    many, so that a few spans cannot make both classes one. Each kind has its share of true
    spans. No round leaves the first guess.
    """
    values, labelers = (-1, 0, 1), range(len(LABELERS))
    posterior = majority(patterns)
    rates: dict = {}
    for _ in range(rounds):
        own = {(kind, y, j, v): 0.0 for kind in {x[0] for x in patterns} for y in (0, 1) for j in labelers for v in values}
        shares = {kind: list(SHARE) for kind, *_ in patterns}
        for (kind, found, _, n), p in zip(patterns, posterior, strict=True):
            for y, part in ((1, p * n), (0, (1 - p) * n)):
                shares[kind][y] += part
                for j, v in enumerate(found):
                    own[kind, y, j, v] += part
        pooled = {(y, j, v): POOLED * PRIOR[y][v] for y in (0, 1) for j in labelers for v in values}
        for (_, y, j, v), c in own.items():
            pooled[y, j, v] += c
        whole = {(y, j): sum(pooled[y, j, v] for v in values) for y in (0, 1) for j in labelers}
        rates = {
            (kind, y, j, v): (c + POOLED * pooled[y, j, v] / whole[y, j]) / (sum(own[kind, y, j, w] for w in values) + POOLED)
            for (kind, y, j, v), c in own.items()
        }
        for i, (kind, found, _, _) in enumerate(patterns):
            score = math.log(shares[kind][1] / shares[kind][0])
            score += sum(math.log(rates[kind, 1, j, v] / rates[kind, 0, j, v]) for j, v in enumerate(found))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    return posterior, rates




def span_features(kind: str, found: tuple[int, ...], size: int) -> list:
    """What the classifier sees of a span: its kind, its size class within the kind, and the votes, over all kinds and within its own."""
    cast = [(j, v) for j, v in enumerate(found) if v]
    return ["bias", ("kind", kind), ("size", kind, size), *cast, *[(kind, *x) for x in cast]]


def train_spans(patterns: list[Pattern], posterior: list[float], rounds: int = 400) -> dict:
    """Weights of a logistic classifier trained on the posteriors; kinds weigh alike, a kind's patterns by their counts."""
    weights: dict = {}
    named = [span_features(kind, found, size) for kind, found, size, _ in patterns]
    total: dict = {}
    for kind, _, _, n in patterns:
        total[kind] = total.get(kind, 0) + n
    amount = [n / total[kind] / len(total) for kind, _, _, n in patterns]
    for _ in range(rounds):
        slope: dict = {}
        for names, p, n in zip(named, posterior, amount, strict=True):
            score = sum(weights.get(f, 0.0) for f in names)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) - p) * n
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - 2.0 * (g + 1e-4 * weights.get(f, 0.0))
    return weights


def _accepted(kind: str, span: Column, weights: dict) -> Column:
    """The classifier's probability is at least one half."""
    score = F.lit(float(weights.get("bias", 0.0) + weights.get(("kind", kind), 0.0)))
    for size in range(8):
        score = score + F.when(span["size"] == size, float(weights.get(("size", kind, size), 0.0))).otherwise(0.0)
    for j in range(len(LABELERS)):
        vote = F.get(span["votes"], F.lit(j))
        yes, no = (float(weights.get((j, v), 0.0) + weights.get((kind, j, v), 0.0)) for v in (1, -1))
        score = score + F.when(vote == 1, yes).when(vote == -1, no).otherwise(0.0)
    return score >= 0


def _kept(kind: str, weights: dict) -> Column:
    return F.filter(kind, lambda s: _accepted(kind, s, weights))


def _written(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find_personal_data(docs: DataFrame, rounds: int = 50) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_spans, base_sha256, spans`` of every whole text.

    ``spans`` lists kind:start:end (code points, end exclusive), base kinds first, then the
    added ones, each by start; ``n_spans`` counts them. An added span that overlaps a base span
    or an added span of an earlier kind is left out. A null text is empty and has no spans. Rows
    that repeat are treated each. An empty table gives an empty result; other columns are
    ignored. ``rounds`` are those of the expectation-maximisation.
    """
    found = materialize(spans(docs))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["votes"].alias("votes"), s["size"].alias("size")))

    every = F.flatten(F.array(*[named(k) for k in ADDED]))
    counts = found.select(F.inline(every)).groupBy("kind", "votes", "size").count().orderBy("kind", "votes", "size").collect()
    patterns = [(r["kind"], tuple(r["votes"]), r["size"], r["count"]) for r in counts]
    posterior, _ = fit_labels(patterns, rounds)
    weights = train_spans(patterns, posterior)
    rows = found.select(
        "doc_id",
        *BASE,
        *[_kept(k, weights).alias(k) for k in ADDED],
    )
    rows = rows.withColumn("taken", F.flatten(F.array(*BASE)))
    for kind in ADDED:
        free = F.filter(kind, lambda s: ~F.exists("taken", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        rows = rows.withColumn(kind, free)
        rows = rows.withColumn("taken", F.concat("taken", F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.flatten(F.array(*[_written(k) for k in kinds])), ",")

    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        sum((F.size(k) for k in BASE + ADDED), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(listed(BASE).cast("binary"), 256).alias("base_sha256"),
        listed(BASE + ADDED).alias("spans"),
    )


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
