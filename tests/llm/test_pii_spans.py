"""Added spans of personal data against plain Python: proposals, features, trees, thresholds, overlaps."""

import random

import regex

from loomwright.llm import pii


def _luhn(d):
    return sum(int(x) if i % 2 == 0 else (int(x) * 2 - 9 * (int(x) > 4)) for i, x in enumerate(reversed(d))) % 10 == 0


def _mod97(value):
    v = value.replace(" ", "")
    if not regex.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]+", v):
        return 0
    return 1 if int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 else -1


def _features(value, before, after):
    d = regex.sub("[^0-9]", "", value)
    f = {"length": len(value), "digits": len(d), "groups": len(regex.findall("[0-9]+", value)), "upper": len(regex.findall("[A-Z]", value)), "kinds_of_character": len(set(value))}
    f |= {"luhn": 12 <= len(d) <= 19 and _luhn(d), "mod97": _mod97(value), "joined": bool(regex.search("[A-Za-z0-9]$", before) or regex.match("[A-Za-z0-9]", after)), "area": d[:1] >= "2"}
    f["spelled"] = bool(regex.search(r"\(at\)|\[at\]|[ (\[]dot[ )\]]", value))
    f |= {name: bool(regex.search(p, before)) for name, p in pii._CONTEXT.items()}
    return [float(f[k]) for k in pii.FEATURES]


def _score(trees, x):
    total = 0.0
    for j, c, left, right in trees:
        k, d, lo, hi = left if x[j] <= c else right
        total += lo if x[k] <= d else hi
    return total


def _base(text):
    out = []
    for k, (kind, (pattern, _)) in enumerate(pii.BASE.items()):
        for m in regex.finditer(pattern, text):
            d = regex.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(float(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return out


def _plain(text, trees, cut):
    base, more = _base(text), []
    for kind, (pattern, _) in pii.MORE.items():
        for m in regex.finditer(pattern, text):
            score = _score(trees, _features(m[0], text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 4]))
            if score >= cut[kind]:
                more.append((-score, m.start(), pii.KINDS.index(kind), m.end()))
    meets = lambda s, e, a, b: s < b and a < e
    kept = [(s, k, e) for o, s, k, e in more if not any(meets(s, e, a, b) for a, _, b in base) and not any(meets(s, e, a, b) and (p, a, j) < (o, s, k) for p, a, j, b in more)]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + kept))


def _account(rng, right):
    rest, country = "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.choice([12, 16, 18, 23]))), rng.choice(["DE", "GB", "NL", "AB"])
    check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    a = f"{country}{check if right else check % 97 + 1:02d}{rest}"
    return a if rng.random() < 0.5 else " ".join(a[i : i + 4] for i in range(0, len(a), 4))


def test_added_spans_equal_plain_python(spark):
    rng = random.Random(11)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    parts = [
        lambda: _account(rng, True), lambda: _account(rng, False), lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}",
        lambda: f"ann{n(1)} at mail dot com", lambda: "look at noon.Then", lambda: f"kim(at)mail{n(1)}(dot)org", lambda: ".".join(n(4) for _ in range(4)), lambda: "/".join(n(4) for _ in range(4)),
        lambda: f"token = \"{n(20)}ab\"", lambda: "password: required", lambda: f"api_key={n(12)}", lambda: "AKIA" + "".join(rng.choice("ABCDEF234567") for _ in range(16)),
        lambda: f"joe@mail{n(1)}.com", lambda: f"+49 {n(3)} {n(6)}", lambda: f"10.{n(2)}.3.4", lambda: "4111 1111 1111 1111", lambda: "passport", lambda: "version", lambda: "call me on", lambda: "iban", lambda: "é", lambda: "order",
    ]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trees, cut = pii.model(spark)
    want = {i: _plain(t or "", trees, cut) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["spans"] for r in pii.op1_pii(spark, docs).collect()}
    assert got == want
    told = {k: sum(k + ":" in w for w in want.values()) for k in pii.KINDS}
    assert min(told.values()) > 10, told


def test_prose_is_no_address(spark):
    """Sentences of ordinary words, with "at" before a full stop, hold nothing; spelled-out addresses do."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeioutnrsldhm") for _ in range(rng.randrange(1, 10)))
    prose = ["call me on " * (i % 2) + f"{word()} {word()} at {word()}. {word().title()} {word()}" for i in range(400)]
    mails = [f"{rng.choice(['write to', 'the', 'and'])} {word()}{rng.choice([' at ', '(at)', ' [at] '])}{word()}{rng.choice([' dot ', '(dot)'])}com" for _ in range(100)]
    found = {r["doc_id"] for r in pii.op1_pii(spark, spark.createDataFrame(list(enumerate(prose + mails)), "doc_id long, text string")).collect() if r["spans"]}
    assert sum(i < 400 for i in found) <= 2 and sum(i >= 400 for i in found) >= 95


def test_only_right_check_digits_make_an_account(spark):
    rng = random.Random(12)
    before = ["passport ", "iban ", "the ", "order ", "pay ", ""]
    right, wrong = ([rng.choice(before) + _account(rng, b) for _ in range(300)] for b in (True, False))
    docs = spark.createDataFrame(list(enumerate(right + wrong)), "doc_id long, text string")
    found = {r["doc_id"] for r in pii.op1_pii(spark, docs).collect() if "iban:" in r["spans"]}
    assert sum(i < 300 for i in found) >= 294 and sum(i >= 300 for i in found) <= 3
