"""Personal data: overlapping candidate spans scored by boosted trees, in DataFrame functions only.

Generators are regular expressions run over whole texts; ``split`` and ``regexp_extract_all`` with one
pattern give the gaps and the matches, and running sums of their lengths give every position in code points. The base
generators' matches that pass their format check always become spans. The wide generators also propose spelled-out and
defanged addresses, numbers of a card's length that fail its check digit, local phone numbers and secrets (keys, tokens,
passwords); boosted trees score these from format and context, and a threshold per kind, calibrated on held-out
examples, selects. The trees are trained on the driver on a bounded set of labelled examples and become nested CASE
expressions, so scoring needs no join and no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.common import text_or_empty

KINDS = ["email", "ip", "card", "phone"]  # the contract's, which have base generators
ALL_KINDS = [*KINDS, "secret"]

# The contract's base patterns. Possessive quantifiers and "not inside a run" starts keep them linear on any text;
# \G lets a match begin right where the previous one ended inside a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Openings of widely used keys and tokens, which tell what they are wherever they stand.
KEY_OPENINGS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,99}|xox[abprs]-[A-Za-z0-9-]{10,99}|AIza[A-Za-z0-9_-]{35}"
AT, DOT = r"(?:\[at\]|\(at\)|\{at\}|<at>)", r"(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\.)"
WIDE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:\x20?{AT}\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?{DOT}\x20?[A-Za-z0-9-]{{1,63}}+){{1,6}}|\x20at\x20[A-Za-z0-9-]{{1,63}}+(?:\x20dot\x20[A-Za-z0-9-]{{1,63}}+){{1,6}})",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.\-/]{0,3}+[0-9]){11,30}+(?![0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,5}[\x20.\-/])(?:[0-9]{2,4}[\x20.\-/]){1,4}[0-9]{2,4}(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9])(?:{KEY_OPENINGS})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]{0,63}[0-9])(?=[0-9+/_-]{0,63}[A-Za-z])[A-Za-z0-9+/_-]{12,128}+={0,2}+(?![A-Za-z0-9@-]|\.[A-Za-z0-9])"
    r"|(?<=(?i:passwor[dt]|passwd|pwd)['\x22]?\x20?[=:]\x20?['\x22]?)(?![='\x22])[^\x00-\x20'\x22]{6,64}+",
}
GATE = {"email": rf"(?i){AT}|\x20dot\x20", "ip": r"(?i)[0-9](?:\[\.\]|\(\.\)|\[dot\])[0-9]", "card": r"[0-9][\x20.\-/]?[0-9]", "phone": r"[0-9][)\x20.\-/]", "secret": r"[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9]|[Pp][Aa][Ss][Ss][Ww]|[Pp][Ww][Dd]|AKIA|ASIA"}
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address|courriel|correo)[^\n]{0,14}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|ping|login|from)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)[^\n]{0,14}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|sms|whatsapp|dial|rufen|t.l.phone)[^\n]{0,14}$",
    "secret": r"(?i)(?:api|access|secret|token|passw|pwd|auth|bearer|\bkey|_key|credential|private)[^\n]{0,6}$",
}
NOT_CUES = r"(?i)(?:version|order|isbn|issn|page|date|price|id|no\.|nr\.|ref|invoice|sku|rfc|section|track(?:ing)?|parcel|commit|sha1?|md5|rev|file|http|www|build|serial|\$|eur|usd)[^\n]{0,6}$"
TOP_DOMAINS = r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl)$"
FEATURES = ["kind", "digits", "length", "luhn", "groups", "cue", "not_cue", "octets", "brackets", "domain", "seps", "mixed", "date", "after", "paren", "even", "turns", "hex", "quoted", "opening"]
CONTEXT = 28
BLOCK = 128  # running values are taken inside blocks of so many, then over the blocks
REACH = 384  # wide matches have 553 code points at most; fewer of them than this start in such a stretch


def running(values: Column, op) -> Column:
    """``op`` (a sum, a maximum, ...) of each element and all before it.

    An array that grows by one element is copied each time; blocks keep that in proportion to the array's length.
    """

    def along(v: Column) -> Column:
        def grow(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), x * 0 if op is plus else x), x)))

        return F.aggregate(v, F.array().cast("array<bigint>"), grow)

    def over_blocks(blocks: Column) -> Column:
        ends = along(F.transform(blocks, lambda x: F.element_at(x, -1)))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda y: op(F.element_at(e, F.greatest(k, F.lit(1))), y))))))

    def blocked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: along(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocked(v), over_blocks)).otherwise(F.array().cast("array<bigint>")))


def plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<s, e, m, b, a>>: start, end, match, text before and after, from the matches already ``found``."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string,b:string,a:string>>")

    def placed(gaps: Column) -> Column:
        n = F.size(found)
        parts = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), n).alias("b"), F.slice(gaps, F.lit(2), n).alias("a"))
        ends = running(F.transform(parts, lambda x: (F.length(x["b"]) + F.length(x["m"])).cast("bigint")), plus)
        one = lambda x, e: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["b"], F.lit(CONTEXT)).alias("b"), F.left(x["a"], F.lit(CONTEXT)).alias("a"))
        return F.zip_with(parts, ends, one)

    return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), placed)).otherwise(empty)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0), add)
    return (F.length(digits) > 0) & (total % 10 == 0)


def passes(kind: str, m: Column) -> Column:
    """The contract's check of a base match."""
    n = F.length(digits_of(m))
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": n.between(14, 19) & luhn(digits_of(m)),
        "phone": n.between(10, 15),
    }[kind]


def described(kind: str, x: Column) -> Column:
    """Format and context features of a candidate, as doubles."""
    m, digits = x["m"], digits_of(x["m"])
    n = F.length(digits)
    sep = F.regexp_replace(m, r"[0-9A-Za-z]", "")
    values = {
        "kind": F.lit(float(ALL_KINDS.index(kind))),
        "digits": n,
        "length": F.length(m),
        "luhn": luhn(digits) if kind == "card" else F.lit(0.0),
        "groups": F.size(F.split(m, r"[^0-9A-Za-z]+")),
        "cue": x["b"].rlike(CUES[kind]),
        "not_cue": x["b"].rlike(NOT_CUES),
        "octets": m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"),
        "brackets": m.rlike(r"[\[({<](?:(?i:at|dot)|\.)[\])}>]"),
        "domain": m.rlike(TOP_DOMAINS),
        "seps": F.length(sep),
        "mixed": F.size(F.array_distinct(F.split(sep, ""))),
        "date": m.rlike(r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})"),
        "after": x["a"].rlike(r"^[A-Za-z0-9.%/-]?[A-Za-z0-9%]"),
        "paren": m.rlike(r"^\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}$"),
        "even": m.rlike(r"^[0-9]{4}(?:[^0-9]{1,2}[0-9]{4}){2}[^0-9]{1,2}[0-9]{1,7}$|^[0-9]+$"),
        "turns": F.size(F.split(m, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) if kind == "secret" else F.lit(0.0),
        "hex": m.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$") if kind == "secret" else F.lit(0.0),
        "opening": m.rlike(rf"^(?:{KEY_OPENINGS})$") if kind == "secret" else F.lit(0.0),
        "quoted": x["b"].rlike(r"['\x22]$") & x["a"].rlike(r"^['\x22]"),
    }
    return F.struct(*[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


# ---------------------------------------------------------------- boosted trees


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, feature, cut) of the best split into at least four rows each; the first of equal gains."""
    best, total_g, total_h = None, g[rows].sum(), h[rows].sum()
    score = lambda a, b: a * a / (b + 1.0)
    for f in range(x.shape[1]):
        cuts, at = np.unique(x[rows, f], return_inverse=True)
        n, gl, hl = (np.cumsum(np.bincount(at, w))[:-1] for w in (None, g[rows], h[rows]))
        gain = score(gl, hl) + score(total_g - gl, total_h - hl) - score(total_g, total_h)
        gain = np.where((n >= 4) & (len(rows) - n >= 4), gain, 0.0)
        if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0] + 1e-12):
            best = (float(gain.max()), f, float(cuts[int(gain.argmax())]))
    return best


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    """A leaf value, or (feature, cut, tree up to the cut, tree above)."""
    found = best_split(x, g, h, rows) if depth else None
    if not found:
        return float(-rate * g[rows].sum() / (h[rows].sum() + 1.0))
    _, f, cut = found
    low = x[rows, f] <= cut
    return f, cut, grow(x, g, h, rows[low], depth - 1, rate), grow(x, g, h, rows[~low], depth - 1, rate)


def values(tree, x: np.ndarray) -> np.ndarray:
    """The leaf value of each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, values(low, x), values(high, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4) -> list:
    """Gradient boosted trees for the logistic loss."""
    out, score = [], np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, rate)
        out.append(tree)
        score += values(tree, x)
    return out


def tree_column(tree, features: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(features[FEATURES[f]] <= cut, tree_column(low, features)).otherwise(tree_column(high, features))


def examples(count: int, seed: int) -> list[tuple[str, str, int]]:
    """Labelled examples from rules: a text with one thing in it, the kind it looks like, and whether it is that."""
    rng = np.random.default_rng(seed)
    some = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    word = lambda: some("anna", "rivers", "j.doe", "info", "kim", "north", "sales", "team", "looked", "park", "noon")
    fill = lambda: " ".join(some("the", "of", "red", "house", "then", "and", "went", "la", "und", "over") for _ in range(int(rng.integers(2, 7))))

    def card(n: int) -> str:
        body = some("4", "51", "37", "6011") + num(n)
        body = body[: n - 1]
        return next(body + str(d) for d in range(10) if _luhn(body + str(d)))

    def grouped(digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    out = []
    for _ in range(count):
        kind = some(*ALL_KINDS)
        good = bool(rng.random() < 0.5)
        before, after = fill(), fill()
        if kind == "email":
            dom, tld = some("mail", "example", "corp-net", "uni"), some("com", "org", "net", "de", "fr", "io", "edu")
            if good:
                a, d = some(("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "."), (" (at) ", "."))
                item = f"{word()}{a}{dom}{d}{tld}"
            else:
                item = some(f"{word()} at {word()} dot {some('matrix', 'the', 'plot', 'product')}", f"{word()} (at) {word()}. {some('The', 'Then', 'She')}", f"{word()} [at] {num(2)}.{num(2)}")
            cue = some("email: ", "contact ", "write to ", "")
        elif kind == "ip":
            parts = [str(int(p)) for p in rng.integers(0, 256, 4)]
            if not good:
                parts[int(rng.integers(4))] = str(int(rng.integers(256, 999)))
            item = some("[.]", "(.)", "[dot]").join(parts)
            cue = some("server ", "ip ", "from ", "")
        elif kind == "card":
            bad = card(16)
            bad = bad[:-1] + str((int(bad[-1]) + int(rng.integers(1, 10))) % 10)
            if good:  # also numbers of a card's length that fail the check, where nothing says that they are something else
                item = some(grouped(card(16), some(".", " - ", "/", ". ")), card(13), bad, num(16), num(16), grouped(bad, some(" ", "-", ".")))
                cue = some("card ", "visa ", "credit card: ", "card no: ") if len(item) == 13 or rng.random() < 0.4 else ""
            else:
                item = some(grouped(bad, some(" ", "-", ".", "/")), num(int(some(12, 13, 14, 15, 17, 18, 20, 24))), f"20{num(2)}-{num(2)}-{num(2)} {num(2)}-{num(2)}-{num(2)}", f"20{num(12)}", card(13), bad, num(16))
                number = sum(c.isdigit() for c in item) == 16
                cue = some("order ", "id ", "ref ", "isbn ", "invoice ", "tracking ", "sku: ") if number or rng.random() < 0.5 else ""
        elif kind == "secret":
            letters = lambda n: "".join(some(*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
            digest = lambda n: "".join(some(*"0123456789abcdef") for _ in range(n))
            name = some("token", "api_key", "secret", "access-key", "auth token", "API key", "TOKEN", "private_key")
            if good:
                value = some(digest(40), digest(40).upper(), digest(32), digest(64), letters(int(rng.integers(16, 50))) + num(1), f"sk_live_{letters(24)}9", f"AKIA{letters(15).upper()}7")
                quote = some("'", '"', "")
                item = f"{quote}{value}{quote}"
                cue = some(f"{name} = ", f"{name}: ", f"{name}=", f"{name} is ", "Bearer ")
                if rng.random() < 0.25:
                    item, cue = some(f"{word()}{num(3)}!", f"{letters(9)}", f"{word()}-{num(4)}"), some("password: ", "passwd=", "pwd = ")
                    item = item.ljust(6, "x")
                elif rng.random() < 0.3:  # known openings stand for themselves, nothing before them need say so
                    item = some(f"AKIA{letters(16).upper()}", f"ASIA{letters(16).upper()}", f"ghp_{letters(36)}", f"sk_test_{letters(24)}", f"xoxb-{num(11)}-{letters(24)}", f"AIza{letters(35)}")
                    cue = some("", "", "see ", "file ", "id ")
            else:
                item = some(f"chapter{num(2)}-section{num(2)}", f"{word()}_{word()}_20{num(2)}_{num(2)}", f"abcdefghijklm{num(1)}", digest(40), digest(32), f"{word()}/{word()}/{word()}{num(1)}", f"mp{num(1)}-{word()}-{word()}-{word()}", letters(14) + "1")
                cue = some("commit ", "sha1 ", "md5 ", "file ", "see ", "rev ", "http://x/", "build ") if len(item) in (32, 40) else some("", "", "file ", "see ", "page ")
        else:
            if good:
                item = some(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(2)} {num(2)} {num(2)} {num(2)}")
                cue = some("tel ", "call ", "phone: ", "fax ")
                if rng.random() < 0.3 and item.startswith("("):
                    cue = ""
            else:
                item = some(
                    f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(3)}-{num(3)}-{num(3)}-{num(2)}", f"{num(2)} {num(3)} {num(3)}", f"{num(3)}.{num(2)}.{num(2)}",
                    f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(2)}/{num(2)}/{num(4)}",
                )
                cue = some("version ", "isbn ", "price ", "order ", "page ", "", "")
        out.append((f"{before} {cue}{item} {after}", kind, int(good)))
    return out


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


@lru_cache(maxsize=2)
def _fitted(app: str, count: int, precision: float) -> tuple[list, dict[str, float]]:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, t, k, y) for i, (t, k, y) in enumerate(examples(count, 3))], "i int, t string, k string, y int")
    found = []
    for kind in ALL_KINDS:
        got = rows.filter(F.col("k") == kind).select("i", "y", wide_candidates(F.col("t"), kind).alias("c"))
        one = got.select("i", "y", F.explode("c").alias("x")).select("i", "y", described(kind, F.col("x")).alias("f"))
        found += one.groupBy("i").agg(F.min("y").alias("y"), F.min_by("f", F.col("f.not_cue")).alias("f")).orderBy("i").collect()
    x, y = np.array([list(r.f) for r in found]), np.array([r.y for r in found], float)
    held = np.array([r.i % 3 == 0 for r in found])
    trees = boost(x[~held], y[~held])
    score = sum(values(t, x[held]) for t in trees)
    cuts = {}
    for n, kind in enumerate(ALL_KINDS):
        mine = x[held, 0] == n
        s, right = score[mine], y[held][mine]
        order = np.argsort(-s)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        last = np.r_[s[order][1:] < s[order][:-1], True] if len(order) else np.zeros(0, bool)
        ok = np.flatnonzero((good >= precision) & last)
        cuts[kind] = max(0.0, float(s[order][ok[-1] : ok[-1] + 2].mean())) if len(ok) else float("inf")  # halfway to the next lower score
    return trees, cuts


def fit(spark: SparkSession, count: int = 3000, precision: float = 0.995) -> tuple[list, dict[str, float]]:
    """Trees, and per kind the cut below the lowest score at which held-out examples reach ``precision``: halfway to the next one, never below even odds."""
    return _fitted(spark.sparkContext.applicationId, count, precision)


def wide_candidates(text: Column, kind: str) -> Column:
    found = F.when(text.rlike(GATE[kind]), F.regexp_extract_all(text, F.lit(WIDE[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return matches(text, WIDE[kind], found)


def overlap(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def free_of_base(base: Column, wide: Column) -> Column:
    """The wide spans that overlap no base span, in order: no base span before reaches them, none after starts in them."""
    far = 1 << 40
    tagged = lambda spans, is_base: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), F.lit(is_base).alias("base"), x.alias("x")))

    def judged(both: Column) -> Column:
        reach = running(F.transform(both, lambda y: F.when(y["base"], y["x"]["e"]).otherwise(0)), F.greatest)
        following = F.reverse(running(F.reverse(F.transform(both, lambda y: F.when(y["base"], y["s"]).otherwise(far))), F.least))
        seen = F.arrays_zip(both.alias("y"), reach.alias("r"), following.alias("f"))
        return F.transform(F.filter(seen, lambda z: ~z["y"]["base"] & (z["r"] <= z["y"]["s"]) & (z["f"] >= z["y"]["x"]["e"])), lambda z: z["y"]["x"])

    return let(F.sort_array(F.concat(tagged(base, True), tagged(wide, False))), judged)


def best_of(free: Column) -> Column:
    """Of overlapping proposals the better score stays, then the earlier start and kind.

    Wide matches have bounded lengths, so those that overlap stand close together in order of start.
    """
    better = lambda y, x: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (F.struct(y["s"], y["k"]) < F.struct(x["s"], x["k"])))

    def chosen(spans: Column) -> Column:
        near = lambda i: F.slice(spans, F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1))
        return F.filter(spans, lambda x, i: ~F.exists(near(i), lambda y: overlap(x, y) & better(y, x)))

    return let(free, chosen)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base, spans: arrays of struct<s, k, e, kind, score> in order of start and kind, ends exclusive."""
    trees, cuts = fit(df.sparkSession)
    out = df.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    out = out.withColumn("digit", F.col("text").rlike("[0-9]"))
    gate = {"email": F.contains("text", F.lit("@")), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    out = out.withColumns({f"m_{k}": F.when(gate[k], F.regexp_extract_all("text", F.lit(BASE[k]), F.lit(0))).otherwise(none) for k in KINDS})
    wide_gate = {k: F.col("text").rlike(GATE[k]) if k in ("email", "secret") else F.col("digit") & F.col("text").rlike(GATE[k]) for k in ALL_KINDS}
    out = out.withColumns({f"w_{k}": F.when(wide_gate[k], F.regexp_extract_all("text", F.lit(WIDE[k]), F.lit(0))).otherwise(none) for k in ALL_KINDS})

    def span(n: int, kind: str, x: Column, score: Column) -> Column:
        return F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), score.alias("score"))

    def base_spans(n: int, kind: str) -> Column:
        good = F.filter(matches(F.col("text"), BASE[kind], F.col(f"m_{kind}")), lambda x: passes(kind, x["m"]))
        return F.transform(good, lambda x: span(n, kind, x, F.lit(1.0)))

    def facts(kind: str) -> Column:
        return F.transform(matches(F.col("text"), WIDE[kind], F.col(f"w_{kind}")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), described(kind, x).alias("f")))

    def chosen(n: int, kind: str) -> Column:
        scored = F.transform(f"f_{kind}", lambda x: span(n, kind, x, sum((tree_column(t, x["f"]) for t in trees), F.lit(0.0))))
        return F.filter(scored, lambda x: x["score"] >= F.lit(cuts[kind]))

    out = out.withColumns({"base": F.sort_array(F.concat(*[base_spans(n, k) for n, k in enumerate(KINDS)])), **{f"f_{k}": facts(k) for k in ALL_KINDS}})
    out = out.withColumn("wide", F.concat(*[chosen(n, k) for n, k in enumerate(ALL_KINDS)]))
    extra = F.when(F.size("wide") > 0, best_of(free_of_base(F.col("base"), F.col("wide")))).otherwise(F.slice("wide", 1, 0))
    return out.select("doc_id", "text", "base", F.sort_array(F.concat("base", extra)).alias("spans"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans, n_secret.

    ``spans`` holds base spans and those the trees chose beside them, ``n_spans`` is their number. Null and empty texts
    have no spans (the digest is that of the empty string). Repeated rows give repeated results, null ids are kept, an
    empty table gives an empty result, other columns are not read. Positions are code points; texts are scanned
    whole, in time about proportional to their length and matches.
    """
    found = scan(df, id_col, text_col)

    def count(n: int, spans: str = "base") -> Column:
        return F.size(F.filter(spans, lambda x: x["k"] == n)).cast("long").alias(f"n_{ALL_KINDS[n]}")

    return found.select(
        "doc_id", *[count(n) for n in range(len(KINDS))], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), count(len(KINDS), "spans"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with every selected span replaced by [KIND]; of overlapping spans the first is written.

    Null texts become empty, texts without spans stay as they are. Repeated rows give repeated results, null ids are kept,
    an empty table gives an empty result, other columns are not read.
    """
    found = scan(df, id_col, text_col)

    def write(acc: Column, x: Column) -> Column:
        gap = F.substring("text", acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        fresh = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate("spans", start, write, tail).alias("text"))
