"""Personal data: candidate spans, boosted trees, calibrated thresholds. DataFrame functions only.

Base spans (email, ip, card, phone) are found by fixed patterns and always stay. Further high-recall generators propose
spans, overlapping one another and the base; each candidate gets features of its format and of the text around it,
boosted trees turn them into a probability, and a threshold per kind, calibrated for precision on sentences that the
trees have not seen, selects what is added. Matching, scoring and redaction happen inside the row: no shuffle, no Python
worker, and work in proportion to the text (running totals of n matches cost n times the root of n).

Patterns are written with possessive quantifiers and look-behinds that keep their leftmost matches but make them
linear on long runs.

Defined results: null texts count as empty and have no spans (a null text stays null when redacted); very long texts are
searched whole; of spans that overlap, redaction writes the kind of the first, at ties that of the shorter, then of the
kind that sorts first; repeated rows get equal spans; other columns pass through whatever their names, but ``find_pii``
replaces columns named like its two outputs; an empty table gives an empty table.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalyn.llm import boosting
from stratalyn.llm.common import beside, let

SPAN = "array<struct<kind:string,start:int,end:int>>"
RUN = "A-Za-z0-9._%+-"
#: kind: pattern, and a cheap test that a text without matches fails.
BASE = {
    "email": (rf"(?:\G|(?<![{RUN}]))[{RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"  # of one or more digits; leading zeros do not count
#: kind: a generator of candidates. Every generator over-matches; the trees decide.
GENERATORS = {
    "phone": r"(?<![0-9A-Za-z.+])\(?[0-9]{2,4}\)?[\x20.-][0-9(][\x20().0-9-]{4,20}[0-9](?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,}+)++|\x20at\x20[A-Za-z0-9-]++(?:(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)++)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A cheap test that a text without spelt-out addresses fails.
SPELT = r"[(\[{]at[)\]}]|\x20at\x20[A-Za-z0-9-]++\x20?[(\[{]dot|\x20dot\x20"
KINDS = [*BASE, *(k for k in GENERATORS if k not in BASE)]
#: Probability at which a candidate of a kind is taken, where the training examples give no higher one.
FLOOR = 0.6
EXAMPLES = 3600
CUT = 1024  # code points of a block that redaction cuts a text into


def _luhn(digits: Column) -> Column:
    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return total + F.when(x["i"] % 2 == 0, x["d"]).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.ascii(c) - 48).withField("i", i).withField("d", F.ascii(c) - 48))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _scan(values: Column, total) -> Column:
    """Running totals of an array of numbers: ``total`` of each number and all before it.

    An accumulated array is copied at every step, so a long one is cut into blocks of about the square root of its
    length, whose own running totals are raised by those of the blocks before.
    """
    none = F.array().cast("array<int>")
    run = lambda xs: F.aggregate(xs, none, lambda acc, x: F.array_append(acc, F.coalesce(total(F.get(acc, F.size(acc) - 1), x), x)))

    def blocks(xs: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(xs))).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, wide), lambda b: run(F.slice(xs, b + 1, wide)))
        raised = lambda own, ends: F.flatten(F.transform(own, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: total(F.get(ends, i - 1), v)))))
        return let(each, lambda own: let(run(F.transform(own, lambda x: F.get(x, F.size(x) - 1))), lambda ends: raised(own, ends)))

    return let(values, lambda xs: F.when(F.size(xs) <= 32, run(xs)).otherwise(blocks(xs)))


def _sums(values: Column) -> Column:
    return _scan(values, lambda a, b: a + b)


def _tops(values: Column) -> Column:
    return _scan(values, F.greatest)


def _walk(text: Column, pattern: str, item, take) -> Column:
    """Matches with their places in code points: ``take(match)`` keeps one, ``item(match, before, after, start, end)`` makes its entry.

    split() gives what lies between the matches that regexp_extract_all() gives, so places are running lengths.
    """

    def found(pieces: Column, matches: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))

        def entries(starts: Column) -> Column:
            kept = F.filter(F.transform(matches, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: take(x["m"]))
            return F.transform(kept, lambda x: item(x["m"], F.right(F.get(pieces, x["i"]), F.lit(32)), F.left(F.get(pieces, x["i"] + 1), F.lit(8)), F.get(starts, x["i"]), F.get(starts, x["i"]) + F.length(x["m"])))

        return let(_sums(steps), entries)

    # a text without a match is not cut
    cut = lambda m: F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(cut(m), lambda p: found(p, m)))


def base_spans(text: Column) -> Column:
    """Base spans of a non-null text, by kind as listed, then by start."""
    found = []
    for kind, (pattern, mark) in BASE.items():
        spans = _walk(text, pattern, lambda m, b, a, s, e, k=kind: F.struct(F.lit(k).alias("kind"), s.alias("start"), e.alias("end")), lambda m, k=kind: _valid(k, m))
        able = F.contains(text, F.lit(mark)) if mark else F.lit(True)
        if kind in ("ip", "card"):
            able = able & text.rlike("[0-9][.0-9\\x20-][0-9]?")
        found.append(F.when(able, spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def _features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    cue = lambda words: before.rlike(rf"(?i)\b(?:{words})\b[^\n]{{0,12}}$").cast("double")
    count = lambda p: F.regexp_count(m, F.lit(p)).cast("double")
    size = F.length(m).cast("double")
    return [
        F.lit(float(list(GENERATORS).index(kind))), size, count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count(r"[^A-Za-z0-9]"), count("[0-9]+"),
        count("[0-9]") / size, F.size(F.array_distinct(F.split(m, ""))).cast("double") / size,
        F.length(F.regexp_extract(m, "([0-9]*)$", 1)).cast("double"), F.length(F.regexp_extract(m, r"^\(?([0-9]*)", 1)).cast("double"),
        cue("phone|tel|telephone|call|fax|mobile|cell|dial|ring|contact|text"), cue("token|secret|key|password|passwd|auth|bearer|apikey|api_key|credential"),
        cue("ssn|social|security|iban|account|bank|tax|mail|email|write|reach"), cue("version|isbn|issn|page|pages|section|order|chapter|vol|volume|ratio|year|years|date|item|part|figure|table|commit|sha|hash|id|invoice"),
        before.rlike("[=:][\\x20\"']{0,2}$").cast("double"), before.rlike("[/\\\\#&?=]$").cast("double"), after.rlike("^[\"']").cast("double"), after.rlike("^[%A-Za-z/]").cast("double"),
        m.rlike(r"(?i)at\W|\bdot\b").cast("double"), (count("[a-f0-9]") / size),
    ]


CANDIDATE = "struct<kind:string,start:int,end:int,f:array<double>>"


def candidates(text: Column) -> Column:
    """Every generator's candidates with their features."""
    found = []
    for kind, pattern in GENERATORS.items():
        spans = _walk(text, pattern, lambda m, b, a, s, e, k=kind: F.struct(F.lit(k).alias("kind"), s.alias("start"), e.alias("end"), F.array(*_features(k, m, b, a)).alias("f")), lambda m: F.lit(True))
        able = text.rlike("[0-9]") if kind != "email" else text.rlike(SPELT)
        found.append(F.when(able, spans).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
    return F.concat(*found)


def _examples(n: int, seed: int) -> list[tuple[int, str, str, int]]:
    """Made sentences around one span each: (id, text, the span, 1 if it is personal). The bound is ``n``."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "re", "ti", "on", "es", "la", "mo", "ka", "st", "er"]) for _ in range(r.randint(1, 4)))
    some = lambda alphabet, lo, hi: "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi)))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    yes = [
        lambda: (r.choice(["call ", "phone: ", "tel ", "", "fax ", "mobile "]), r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"]), ""),
        lambda: (r.choice(["SSN ", "social security ", "ssn: ", ""]), f"{digits(3)}-{digits(2)}-{digits(4)}", ""),
        lambda: (r.choice(['token = "', 'secret: "', 'api_key="', 'password = "', "auth: ", "bearer ", 'key = "']), r.choice([some(hexes, 32, 64), some(mixed, 24, 48), "sk_" + some(mixed, 24, 40)]), '"'),
        lambda: (r.choice(["mail ", "write to ", "contact ", ""]), f"{word()}.{word()}{r.choice([' (at) ', '[at]', ' at '])}{word()}{r.choice([' (dot) ', '[dot]', ' dot '])}{r.choice(['com', 'org', 'net'])}", ""),
        lambda: (r.choice(["IBAN ", "account ", ""]), r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + " " + " ".join(digits(4) for _ in range(r.randint(3, 5))), ""),
    ]
    no = [
        lambda: (r.choice(["from ", "in ", "the years ", "dated "]), r.choice([f"19{digits(2)}-{r.randint(1, 12):02}-{digits(2)} 1{digits(1)}", f"20{digits(2)} 19{digits(2)} 20{digits(2)}", f"19{digits(2)}-20{digits(2)} {digits(3)}"]), ""),
        lambda: (r.choice(["page ", "item ", "order ", "table ", "pages "]), r.choice([f"{digits(2)} {digits(3)} {digits(2)} {digits(3)}", f"{digits(2)}-{digits(2)}-{digits(4)}", f"{digits(4)} {digits(4)} {digits(2)}"]), ""),
        lambda: (r.choice(["ISBN ", "isbn: "]), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", ""),
        lambda: (r.choice(["commit ", "sha ", "hash ", "see /", "the "]), r.choice([some(hexes, 40, 40), "-".join(word() for _ in range(6)) + "-" + digits(1), "_".join(word() + word() for _ in range(4)) + digits(2)]), ""),
        lambda: ("", f"{word()}-{word()}{word()}{word()}{word()}-{word()}{digits(1)}", ""),
        lambda: ("", f"{word()} at {word()} dot {word()}", ""), lambda: ("they met ", f"{word()} at {word()}. {word()}", ""),
        lambda: ("ratio ", f"{digits(2)}.{digits(2)} {digits(2)}.{digits(2)}", ""), lambda: ("version ", f"{digits(2)} {digits(1)}.{digits(2)}.{digits(2)}", ""),
        lambda: ("part ", f"{digits(3)}-{digits(2)}-{digits(4)}", "/A"), lambda: ("model ", f"AB{digits(2)} {some('ABCDEFGH', 4, 4)} {some('ABCDEFGH', 4, 4)}", ""),
    ]
    out = []
    for i in range(n):
        label = int(r.random() < 0.5)
        pre, span, post = r.choice(yes if label else no)()
        out.append((i, f"{' '.join(word() for _ in range(r.randint(1, 6)))} {pre}{span}{post} {' '.join(word() for _ in range(r.randint(0, 5)))}.", span, label))
    return out


@lru_cache(maxsize=4)
def _fit(spark: SparkSession, n: int, seed: int) -> tuple[boosting.Boosted, dict[str, float]]:
    rows = spark.createDataFrame(_examples(n, seed), "id int, text string, span string, label int")
    found = rows.select("id", "label", F.instr("text", F.col("span")).alias("at"), F.length("span").alias("size"), F.explode(candidates(F.col("text"))).alias("c"))
    got = found.select("id", F.when((F.col("c.start") < F.col("at") - 1 + F.col("size")) & (F.col("c.end") > F.col("at") - 1), F.col("label")).otherwise(0).alias("y"), "c.f", "c.kind").orderBy(F.xxhash64("id", "c.start", "c.kind")).collect()
    x, y, kinds, fold = np.array([r.f for r in got]), np.array([float(r.y) for r in got]), np.array([r.kind for r in got]), np.array([r.id % 3 == 0 for r in got])
    model = boosting.fit(x[~fold], y[~fold])
    x, y, kinds, cut = x[fold], y[fold], kinds[fold], {}  # a third of the sentences, which the trees have not seen
    p = model.predict(x)
    for kind in GENERATORS:  # the lowest threshold at which 99 of 100 selected examples are personal
        mine = np.flatnonzero(kinds == kind)
        cut[kind] = next((t for t in np.arange(FLOOR, 0.99, 0.02) if y[mine][p[mine] >= t].mean() >= 0.99), 0.98) if len(mine) and (p[mine] >= 0.98).any() else 0.98
    return model, {k: round(float(v), 2) for k, v in cut.items()}


def train(spark: SparkSession, n: int = EXAMPLES, seed: int = 7) -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees and each kind's threshold, from ``n`` made examples put through the generators themselves."""
    return _fit(spark, n, seed)


def find_pii(docs: DataFrame, model=None, base: str = "base", spans: str = "spans") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (kind, start, end) in code points, by kind, then start, then end.

    Columns that already have these names are replaced.
    """
    trees, cut = model or train(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    score = lambda c: trees.expression([F.get(c["f"], F.lit(i)) for i in range(21)])
    limit = F.create_map(*[F.lit(x) for k, v in cut.items() for x in (k, v)])

    def select(sure: Column, found: Column) -> Column:
        # base spans and candidates in one order of starts, base first: a candidate is covered if a base span before it ends no earlier
        mark = lambda xs, sign, f: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(sign).alias("free"), s["end"].alias("end"), F.element_at(rank, s["kind"]).alias("r"), s["kind"].alias("kind"), f(s).alias("f")))
        both = F.array_sort(F.concat(mark(sure, 0, lambda s: F.array().cast("array<double>")), mark(found, 1, lambda s: s["f"])))

        def chosen(xs: Column) -> Column:
            tops = _tops(F.transform(xs, lambda s: F.when(s["free"] == 0, s["end"]).otherwise(0)))
            return let(tops, lambda t: F.filter(xs, lambda s, i: (s["free"] == 0) | ((F.get(t, i) < s["end"]) & (score(s) >= F.element_at(limit, s["kind"])))))

        ranked = F.array_sort(F.transform(let(both, chosen), lambda s: F.struct(s["r"].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        single = let(ranked, lambda xs: F.filter(xs, lambda s, i: (i == 0) | (s != F.get(xs, i - 1))))  # equal spans are neighbours
        return F.transform(single, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = docs.withColumn(base, base_spans(text))
    return found.withColumn(spans, F.when(text.rlike(f"[0-9]|{SPELT}"), let(candidates(text), lambda c: F.when(F.size(c) > 0, select(F.col(base), c)).otherwise(F.col(base)))).otherwise(F.col(base)))


def _pick(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text cut into blocks of ``CUT``: only the blocks concerned are read."""
    first, last = F.floor(start / CUT).cast("int"), F.floor((end - 1) / CUT).cast("int")
    inner = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(F.substring(F.get(blocks, first), start % CUT + 1, F.lit(CUT)), inner, F.substring(F.get(blocks, last), F.lit(1), (end - 1) % CUT + 1))
    return F.when(end <= start, "").when(first == last, F.substring(F.get(blocks, first), start % CUT + 1, end - start)).otherwise(several)


def redact(docs: DataFrame, model=None) -> DataFrame:
    """``docs`` with every selected span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    raw, base, spans = beside(docs, "text_given"), beside(docs, "base_spans"), beside(docs, "all_spans")
    found = find_pii(docs.withColumn(raw, F.col("text")), model, base, spans).drop(base)
    text = F.col(raw)

    def written(ordered: Column, tops: Column, blocks: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(tops, i - 1))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(_pick(blocks, before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(ordered, piece), ""), _pick(blocks, F.get(tops, F.size(tops) - 1), F.length(text)))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    clean = let(ordered, lambda o: let(_tops(F.transform(o, lambda s: s["end"])), lambda t: let(blocks, lambda b: written(o, t, b))))
    out = found.withColumn("text", F.when(text.isNotNull() & (F.size(spans) > 0), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNotNull() & (F.size(spans) > 0), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, model=None) -> DataFrame:
    """The columns of op1."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = find_pii(docs.select("doc_id", "text"), model)
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
