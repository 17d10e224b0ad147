"""Personal data (1): generators propose spans, boosted trees and thresholds select.

Native: DataFrame functions only.  Exact generators (email, ip, card, phone) always
keep their spans.  High-recall generators propose more, overlapping spans (spelled-out
emails, national phone numbers, cards with other separators, secrets, ...).  Gradient
boosted trees score each proposal from its format and its context; a threshold per
kind, calibrated for recall on examples that were not fitted, selects; of overlapping
selected spans the best remains.  The trees are fitted on a fixed synthetic set, whose
features Spark computes by the same expressions, and are compiled to CASE expressions.

Positions are code points, end exclusive.  Matching is leftmost and non-overlapping;
patterns are possessive where that changes nothing, so long runs cost linear time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, cheap test).  The look-behind or \G starts only where a leftmost match can.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: High-recall generators of further spans, in the order of their kinds.
MORE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,}+)++", r"(?:\(at\)|\[at\]| at )"),
    "card": (r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9])", r"[0-9]{4}[._/][0-9]{4}[._/]"),
    "phone": (r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    "secret": (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|[Tt]oken|[Ss]ecret|[Aa]pi_?[Kk]ey)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,}+\"?", r"AKIA|[=:]"),
}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string,score:double>>"
_CHUNK = 512


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn test."""
    n = F.length(number)

    def add(total, i):
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """1 if an account number (two capitals, two digits, capitals and digits, blanks between) has the right check digits,
    -1 if it has others; 0 for another form."""
    flat = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def add(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    formed = flat.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add)
    return F.when(formed, F.when(rest == 1, 1).otherwise(-1)).otherwise(0)


def valid(kind: str, value: Column) -> Column:
    """The further conditions on a match of a base pattern."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        d = digits(value)
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, test: str) -> Column:
    """(start, end, value) of every match, in order.

    split() gives the gaps around the matches; start is a running sum of lengths.  The
    sum is kept over chunks of matches, so its cost stays near linear for any number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    pairs = F.transform(F.slice(gaps, 1, F.size(found)), lambda g, i: F.struct(F.length(g).cast("long").alias("gap"), F.get(found, i).alias("hit")))

    def step(acc, p):
        start = acc["at"] + p["gap"]
        end = start + F.length(p["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value")))).alias("out"))

    empty = F.array().cast(kind)

    def chunk(acc, k):
        inner = F.aggregate(F.slice(pairs, k * _CHUNK + 1, F.lit(_CHUNK)), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    short = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)["out"]
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    long = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int")), start, chunk)["out"])
    out = F.when(F.size(found) <= _CHUNK, short).otherwise(long)
    return F.when(text.rlike(test), out).otherwise(empty)


# --- features of a proposal -------------------------------------------------------------

_CONTEXT = {
    "contact": "(?i)(?:mail|contact|write|reach|phone|tel|call|mobile|fax|cell)",
    "number": "(?i)(?:card|account|iban|ssn|social|passport|tax|pay)",
    "secret": "(?i)(?:password|passwd|token|secret|key|login)",
    "other": "(?i)(?:version|page|figure|isbn|order|part|serial|total|look|arrive|meet)",
}
FEATURES = ("length", "digits", "groups", "upper", "kinds_of_character", "contact", "number", "secret", "other", "luhn", "mod97", "spelled", "joined", "area")


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    d = digits(value)
    f = {
        "length": F.length(value),
        "digits": F.length(d),
        "groups": F.regexp_count(value, F.lit("[0-9]+")),
        "upper": F.regexp_count(value, F.lit("[A-Z]")),
        "kinds_of_character": F.size(F.array_distinct(F.split(value, ""))),
        "luhn": F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False).cast("int"),
        "mod97": mod97(value),
        "spelled": value.rlike(r"\(at\)|\[at\]|[\x20(\[]dot[\x20)\]]").cast("int"),
        "joined": (before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]")).cast("int"),
        "area": F.when(d.rlike("^[2-9]"), 1).otherwise(0),
    }
    f |= {name: before.rlike(p).cast("int") for name, p in _CONTEXT.items()}
    return {k: f[k].cast("double") for k in FEATURES}


# --- gradient boosting -----------------------------------------------------------------


def _training_set() -> list[tuple[str, str, str, str, int]]:
    """(kind, before, value, after, label): a fixed synthetic set, made from rules."""
    out, state = [], [12345]

    def rnd(n: int) -> int:
        state[0] = (state[0] * 1103515245 + 12345) % (1 << 31)
        return (state[0] >> 8) % n

    def pick(xs):
        return xs[rnd(len(xs))]

    def num(n):
        return "".join(str(rnd(10)) for _ in range(n))

    def hexa(n):
        return "".join(pick("0123456789abcdef") for _ in range(n))

    good = ["call me on ", "phone: ", "contact ", "mail ", "my card ", "pay with ", "the ", "and ", "", "reach us at "]
    bad = ["version ", "page ", "order ", "part ", "serial ", "total ", "figure ", "isbn "]
    names = ["ann", "joe.b", "kim_1", "sales", "lee99"]
    for _ in range(80):
        area = str(2 + rnd(8)) + num(2)
        out.append(("phone", pick(good), pick([f"({area}) {num(3)}-{num(4)}", f"{area}-{num(3)}-{num(4)}", f"{area} {num(3)} {num(4)}"]), pick([" ", ".", ","]), 1))
        out.append(("phone", pick(bad), f"{pick('01')}{num(2)}{pick('.-')}{num(3)}{pick('.-')}{num(4)}", pick([" ", "x", "-"]), 0))
        out.append(("email", pick(good), f"{pick(names)}{pick([' at ', '(at)', ' [at] '])}{pick(['mail', 'post', 'example', 'uni'])}{pick(['', num(1)])}{pick([' dot ', '(dot)', '[dot]'])}{pick(['com', 'org', 'net'])}", " ", 1))
        out.append(("email", pick(["we look ", "they arrive ", "meet ", *good]), f"{pick(['us', 'with', 'and', 'these', 'stay', 'arrivals'])} at {pick(['noon', 'and', 'home', 'the', 'last'])}.{pick(['', ' '])}{pick(['Then', 'And', 'We', 'The', 'Afterwards'])}", pick([" ", ",", "."]), 0))
        out.append(("ssn", pick(["ssn ", "social ", "tax id ", "the "]), f"{1 + rnd(8)}{num(2)}-{num(2)}-{num(4)}", pick([" ", "."]), 1))
        out.append(("ssn", pick(bad), f"000-{num(2)}-{num(4)}", pick([" ", "."]), 0))
        for label in (1, 0):  # in the same places: check digits tell them apart, and context where it can
            country, rest = pick(["DE", "FR", "ES", "GB", "AB", "QX", "ID"]), pick([num(18), num(20), "".join(pick("ABCDEF0123456789") for _ in range(12 + rnd(8)))])
            check = 98 - int("".join(str(int(ch, 36)) for ch in rest + country + "00")) % 97
            check = check if label else (check + rnd(96)) % 97 + 1
            account = f"{country}{check:02d}{rest}"
            shown = pick([account, " ".join(account[i : i + 4] for i in range(0, len(account), 4))])
            out.append(("iban", pick(["iban ", "account ", "pay ", "the ", "passport ", "order ", ""]), shown, pick([" ", "."]), label))
        out.append(("secret", pick(["the ", "with ", "", "login "]), pick([f"AKIA{''.join(pick('ABCDEFGHJKLMNPQRSTUVWXYZ234567') for _ in range(16))}", f"password={hexa(18)}", f'token = "{hexa(40)}"', f"secret: {hexa(24)}"]), " ", 1))
        out.append(("secret", pick(["choose a ", "the "]), pick(["password: required", "token = optional", "secret: nothing_here", "token: identifier"]), " ", 0))
        c = num(15)
        total = sum((int(x) if i % 2 else (int(x) * 2 - 9 * (int(x) > 4))) for i, x in enumerate(c))
        c += str(-total % 10)
        out.append(("card", pick(good), pick("._/").join(c[i : i + 4] for i in range(0, 16, 4)), " ", 1))
        wrong = c[:15] + str((int(c[15]) + 1 + rnd(8)) % 10)
        out.append(("card", pick(bad), pick("._/").join(wrong[i : i + 4] for i in range(0, 16, 4)), " ", 0))
    return out


def boost(x, y, rounds: int = 40, rate: float = 0.3):
    """Depth-2 trees under the logistic loss: [(feature, cut, (feature, cut, leaf, leaf), (...))], bias."""
    import numpy as np

    score = np.zeros(len(y))
    cuts = [np.unique((v := np.unique(x[:, j]))[:-1] + np.diff(v) / 2) for j in range(x.shape[1])]
    cuts = [c if len(c) <= 24 else np.quantile(c, np.linspace(0, 1, 24)) for c in cuts]

    def leaf(rows, g, h):
        return float(rate * g[rows].sum() / (h[rows].sum() + 1.0))

    def split(rows, g, h):
        best = (0.0, 0, float("inf"))
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for j, cs in enumerate(cuts):
            for c in cs:
                left = rows & (x[:, j] <= c)
                right = rows & ~left
                if left.any() and right.any():
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[right].sum() ** 2 / (h[right].sum() + 1.0) - total
                    if gain > best[0] + 1e-9:
                        best = (gain, j, float(c))
        return best[1:]

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        j, c = split(np.ones(len(y), bool), g, h)
        sides = []
        for side in (x[:, j] <= c, x[:, j] > c):
            k, d = split(side, g, h)
            lo, hi = side & (x[:, k] <= d), side & (x[:, k] > d)
            sides.append((k, d, leaf(lo, g, h), leaf(hi, g, h)))
            score[lo] += sides[-1][2]
            score[hi] += sides[-1][3]
        trees.append((j, c, *sides))
    return trees, score


def compile_trees(trees, f: dict[str, Column]) -> Column:
    """The sum of the trees as CASE expressions."""

    def below(j, c):
        return f[FEATURES[j]] <= F.lit(c)

    def half(k, d, lo, hi):
        return F.lit(lo) if math.isinf(d) or lo == hi else F.when(below(k, d), lo).otherwise(hi)

    return reduce(lambda a, b: a + b, [half(*left) if math.isinf(c) else F.when(below(j, c), half(*left)).otherwise(half(*right)) for j, c, left, right in trees])


_MODELS: dict[float, tuple] = {}


def model(spark: SparkSession, recall: float = 0.98) -> tuple:
    """Trees, and for each kind the threshold that keeps ``recall`` of the held-back true examples."""
    if recall not in _MODELS:
        import numpy as np

        rows = _training_set()
        quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        values = ",".join(f"({i},{quote(b)},{quote(v)},{quote(a)})" for i, (_, b, v, a, _) in enumerate(rows))
        table = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, before, value, after)")
        f = features(F.col("value"), F.col("before"), F.col("after"))
        got = sorted(table.select("i", *[c.alias(k) for k, c in f.items()]).collect())
        x = np.array([list(r)[1:] for r in got], dtype=float)
        y = np.array([r[4] for r in rows], dtype=float)
        held = np.arange(len(rows)) % 5 == 0
        trees, _ = boost(x[~held], y[~held])
        score = np.zeros(len(y))
        for j, c, left, right in trees:
            for side, (k, d, lo, hi) in ((x[:, j] <= c, left), (x[:, j] > c, right)):
                score += np.where(side, np.where(x[:, k] <= d, lo, hi), 0.0)
        cut = {}
        for kind in MORE:
            true = score[held & (y == 1) & (np.array([r[0] for r in rows]) == kind)]
            cut[kind] = min(0.0, float(np.quantile(true, 1 - recall))) if len(true) else 0.0
        _MODELS[recall] = (trees, cut)
    return _MODELS[recall]


# --- selection -------------------------------------------------------------------------


def base_spans(text: Column) -> Column:
    """Valid base spans, by start, then kind as listed."""
    parts = []
    for k, kind in enumerate(BASE):
        found = F.filter(matches(text, *BASE[kind]), _is_valid(kind))
        parts.append(F.transform(found, _span(k, lambda s: F.lit(float("inf")))))
    return F.array_sort(F.concat(*parts))


def _is_valid(kind):
    return lambda s: valid(kind, s["value"])


def _span(k, score):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), score(s).cast("double").alias("score"))


def proposals(text: Column, trees, cut: dict[str, float], reach: int = 32) -> Column:
    """Spans of the high-recall generators whose score reaches their kind's threshold."""

    def rate(s):
        before = F.substring(text, F.greatest(s["start"] - reach, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(reach)).cast("int"))
        after = F.substring(text, s["end"].cast("int") + 1, F.lit(4))
        return compile_trees(trees, features(s["value"], before, after))

    parts = []
    for kind, (pattern, test) in MORE.items():
        scored = F.transform(matches(text, pattern, test), _span(KINDS.index(kind), rate))
        parts.append(F.filter(scored, _reaches(cut[kind])))
    return F.concat(*parts)


def _reaches(least):
    return lambda s: s["score"] >= least


def _overlap(a, b):
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with base_spans and spans (start, kind, end, value, score; replaced if they are there).

    A null text counts as empty.  A proposal that overlaps a base span, or a better
    proposal (by score, then start, then kind), is left out.
    """
    kept = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in ("base_spans", "spans")]
    return _found(docs).select(*kept, F.col("_base").alias("base_spans"), F.col("_spans").alias("spans"))


def _found(docs: DataFrame) -> DataFrame:
    """c0, c1, ... (the columns of ``docs``, so no name can clash), _text, _base, _spans."""
    trees, cut = model(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    df = docs.select(*own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    none = F.array().cast(_SPAN)
    maybe = text.rlike(r"[0-9@]|\(at\)|\[at\]| at |AKIA|[=:]")
    df = df.withColumn("_base", F.when(maybe, base_spans(text)).otherwise(none).cast(_SPAN))
    df = df.withColumn("_more", F.when(maybe, proposals(text, trees, cut)).otherwise(none).cast(_SPAN))
    order = lambda s: F.struct(-s["score"], s["start"], s["kind"])

    def apart(s):
        return ~F.exists("_base", lambda b: _overlap(s, b)) & ~F.exists("_more", lambda o: _overlap(s, o) & (order(o) < order(s)))

    chosen = F.when(F.size("_more") > 0, F.filter("_more", apart)).otherwise(none)
    return df.withColumn("_spans", F.array_sort(F.concat("_base", chosen)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, s):
        free = s["start"] >= acc["at"]
        cut = F.substring(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(cut, F.get(name, s["kind"])))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step)
    rest = F.substring(text, done["at"].cast("int") + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), rest)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` redacted; a null text stays null, other columns as they are."""
    new = F.when(F.col(f"c{docs.columns.index('text')}").isNotNull(), redacted(F.col("_text"), F.col("_spans"))).alias("text")
    return _found(docs).select(*[new if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op1_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return _found(docs.select("doc_id", "text")).select(
        F.col("c0").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans")
    )
