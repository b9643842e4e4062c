"""Secrets in texts: three fixed kinds by pattern, and more by sliding-window entropy. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import null_safe_text

#: kind -> pattern, the group that has the length, the least length. Shorter hex and access runs can be left out by the
#: pattern, as a run is matched whole or not at all; a short assignment must still use up its text.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Strings that may be secrets: long runs with a digit and a letter. Of such a run, the entropy in bits a window must reach, by its class of characters.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
CLASSES = {"[0-9a-fA-F-]+": 3.0, "[A-Za-z0-9]+": 3.6, "[A-Za-z0-9+/_=-]+": 3.8}
#: Runs that look random and are no secrets: UUIDs, alphabets, paths of words, and what says that it is an example. What is
#: repeated as a group is possessive, as Java would need stack for each repetition otherwise.
ALLOW = ("(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$", "(?i)abcdefgh|01234567|example|placeholder|xxxxxx", "^[/_-]?(?:[A-Za-z]{2,}+[/_-])++[A-Za-z]*[0-9]{0,4}$", "^[0-9=_+/-]+$")
SPAN = "array<struct<start:long,rank:int,end:long,kind:string>>"


#: Characters of the stretches in which long texts are cut, and windows of the stretches in which the entropy of long runs is followed.
SEGMENT, STEPS = 1024, 256


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, block: int = 256, most: bool = False) -> Column:
    """Sums (with ``most``: maxima, 0 at least) of all entries before each, for an array of longs. In blocks, so that appending costs little for long arrays."""
    join = (lambda a, b: F.greatest(a, b)) if most else (lambda a, b: a + b)
    add = lambda a, x: F.struct(join(a["sum"], x).alias("sum"), F.array_append(a["all"], a["sum"]).alias("all"))
    zero = lambda s: F.struct(s.alias("sum"), F.array().cast("array<bigint>").alias("all"))
    total = lambda p: F.aggregate(p, F.lit(0).cast("long"), join)

    def of(parts: Column) -> Column:
        starts = F.aggregate(F.transform(parts, total), zero(F.lit(0).cast("long")), add)["all"]
        return F.flatten(F.zip_with(parts, starts, lambda p, s: F.aggregate(p, zero(s), add)["all"]))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), of)).otherwise(F.array().cast("array<bigint>")))


def before(sorted_: Column, below) -> Column:
    """How many entries of an array are ``below``, which holds for its first entries and not for the others. By halving."""
    n = F.size(sorted_)
    zero = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def half(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["lo"] + a["hi"], 1)
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.when(below(F.get(sorted_, middle)), F.struct((middle + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), middle.alias("hi"))))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.log2(F.greatest(n, F.lit(1))).cast("int")), zero, half)["lo"]).otherwise(0)


def cuts(spans: Column) -> Column:
    """The parts of sorted spans that none before covers: structs (lo, hi, new: no span before touches it), in order and apart."""
    at = running(F.transform(spans, lambda x: x["end"]), most=True)
    parts = F.zip_with(spans, at, lambda x, at: F.when(x["end"] > at, F.struct(F.greatest(x["start"], at).alias("lo"), x["end"].alias("hi"), ((x["start"] >= at) | (at == 0)).alias("new"))))
    return F.filter(parts, lambda c: c.isNotNull())


def spliced(text: Column, cut: Column, fill) -> Column:
    """``text`` with ``fill`` (of a cut, whether it begins here, and the length of its part here) in place of each cut. A long text is taken in stretches, each with its own cuts."""
    stretches = F.when(F.length(text) <= SEGMENT, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)))

    def one(s: Column, k: Column) -> Column:
        base = (k * SEGMENT).cast("long")
        lo = lambda i: F.greatest(F.get(cut, i)["lo"] - base, F.lit(0).cast("long"))
        hi = lambda i: F.least(F.get(cut, i)["hi"] - base, F.length(s).cast("long"))
        part = lambda a, b: s.substr((a + 1).cast("int"), (b - a).cast("int"))
        first, end = before(cut, lambda c: c["hi"] <= base), before(cut, lambda c: c["lo"] < base + F.length(s))
        left = lambda i, first: F.when(i > first, hi(i - 1)).otherwise(F.lit(0).cast("long"))
        here = lambda i, first: F.concat(part(left(i, first), lo(i)), fill(F.get(cut, i), F.get(cut, i)["lo"] >= base, (hi(i) - lo(i)).cast("int")))
        both = lambda r: F.when(r["end"] <= r["first"], s).otherwise(F.concat(F.array_join(F.transform(F.sequence(r["first"], r["end"] - 1), lambda i: here(i, r["first"])), ""), part(hi(r["end"] - 1), F.length(s))))
        return let(F.struct(first.alias("first"), end.alias("end")), both)

    return F.when(F.size(cut) > 0, F.array_join(F.transform(stretches, one), "")).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern: an array of structs (start long, found string), in code points from 0.

    What lies between the matches, and the matches themselves, have the lengths that place them.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = let(found, lambda found: F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))))
    at = lambda both: running(F.transform(both, lambda x: (x["g"] + F.length(x["m"])).cast("long")))
    return let(both, lambda both: F.zip_with(both, at(both), lambda x, at: F.struct((at + x["g"]).alias("start"), x["m"].alias("found"))))


def _span(start: Column, end: Column, rank: int, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    found = matches(text, pattern)
    if group:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        found = F.filter(F.zip_with(found, sizes, lambda m, n: F.when(n >= least, m)), lambda m: m.isNotNull())
    found = F.transform(found, lambda m: _span(m["start"], m["start"] + F.length(m["found"]), rank, kind))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def bound_of(run: Column) -> Column:
    """The entropy that windows of a run must reach, by the run's class of characters."""
    bound = F.lit(99.0)
    for pattern, bits in reversed(CLASSES.items()):
        bound = F.when(run.rlike(f"^{pattern}$"), F.lit(bits)).otherwise(bound)
    return bound


def _hot(run: Column, bound: Column, window: int) -> Column:
    """(first, last) of the windows of a short run whose entropy reaches ``bound``, nulls if none does.

    With counts c of a window's characters, entropy is log2(window) - sum(c log2 c) / window. Counts (twelve of five bits
    in each of seven longs) and sum are carried on: the leaving character's count goes down by one, the entering one's up.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    code = lambda c: F.struct(((F.ascii(c) - 43) / 12).cast("int").alias("word"), (F.pmod(F.ascii(c) - 43, F.lit(12)) * 5).cast("int").alias("shift"))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["shift"])
    count = lambda a, x: F.call_function("shiftright", F.get(a["counts"], x["word"]), x["shift"]).bitwiseAND(F.lit(31)).cast("int")
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0.0).alias("sum"), F.array_repeat(F.lit(0).cast("long"), 7).alias("counts"), none.alias("first"), none.alias("last"))

    def step(codes: Column, a: Column, i: Column) -> Column:
        enters, leaves = F.get(codes, i), F.get(codes, i - window)
        out = F.coalesce(count(a, leaves), F.lit(0))
        into = count(a, enters) - F.when(enters == leaves, 1).otherwise(0)
        after = a["sum"] - F.get(term, out) + F.get(term, F.greatest(out - 1, F.lit(0))) + F.get(term, into + 1) - F.get(term, into)
        counts = F.transform(a["counts"], lambda v, k: v + F.when(k == enters["word"], one(enters)).otherwise(0) - F.when(k == leaves["word"], one(leaves)).otherwise(0))
        at = lambda s: F.when((i >= window - 1) & (F.round(math.log2(window) - s / window, 9) >= bound), i - (window - 1))
        state = lambda s: let(at(s), lambda h: F.struct(s.alias("sum"), counts.alias("counts"), F.coalesce(a["first"], h).alias("first"), F.coalesce(h, a["last"]).alias("last")))
        return let(after, state)

    chars = F.transform(F.array_remove(F.split(run, ""), ""), code)
    return let(chars, lambda codes: F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, lambda a, i: step(codes, a, i), lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"))))


def hot_range(run: Column, bound: Column, window: int = WINDOW) -> Column:
    """From the first to the last window of a run whose entropy reaches ``bound``: struct (first, last), of starts from 0; null if none.

    A long run is cut into stretches of ``STEPS`` windows that overlap by what a window is longer than one character.
    """
    size = STEPS + window - 1
    parts = F.when(F.length(run) <= size, F.array(run)).otherwise(F.regexp_extract_all(run, F.lit(f"(?=(.{{1,{size}}})).{{1,{STEPS}}}"), F.lit(1)))
    found = F.filter(F.transform(parts, lambda p, k: let(_hot(p, bound, window), lambda h: F.struct((h["first"] + k * STEPS).alias("first"), (h["last"] + k * STEPS).alias("last")))), lambda h: h["first"].isNotNull())
    return let(found, lambda f: F.when(F.size(f) > 0, F.struct(F.get(f, F.lit(0))["first"].alias("first"), F.element_at(f, -1)["last"].alias("last"))))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW, masked: Column | None = None) -> Column:
    """Spans of hot windows, one a candidate run; with ``masked``, the text with other spans blotted out, one a stretch of a run that is left.

    What a run is, its class and whether it is suppressed are up to the whole run.
    """
    def bound(m: Column) -> Column:
        on = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        for pattern in allow:
            on = on & ~m.rlike(pattern)
        return F.when(on, bound_of(m))

    runs = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["found"].alias("found"), bound(m["found"]).alias("bound")))
    if masked is not None:
        own = lambda m, runs: F.get(runs, before(runs, lambda r: r["start"] <= m["start"]) - 1)["bound"]
        runs = let(runs, lambda runs: F.when(masked == text, runs).otherwise(F.transform(matches(masked, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["found"].alias("found"), own(m, runs).alias("bound")))))
    ranges = F.transform(F.filter(runs, lambda m: m["bound"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), hot_range(m["found"], m["bound"]).alias("hot")))
    spans = F.transform(F.filter(ranges, lambda r: r["hot"].isNotNull()), lambda r: _span(r["start"] + r["hot"]["first"], r["start"] + r["hot"]["last"] + WINDOW, len(KINDS), "entropy"))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(SPAN))


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, text: str = "text", beside: bool = False) -> DataFrame:
    """``docs`` with ``secrets``: its spans in code points, end exclusive, by start, then kind: assign, access, hex, entropy.

    The first three are all leftmost non-overlapping matches of their patterns that are long enough. Entropy spans are
    added where no span of these overlaps them: within runs of 20 or more characters that have a digit and a letter and
    that no pattern of ``allow`` suppresses, from the first to the last window of 20 whose Shannon entropy reaches its class's bound.
    With ``beside``, the base spans are cut out of a run first, and each stretch that is left has its span: a secret next
    to a base match in the same run is then found too.

    Nulls: a null text is empty and has no spans. Long texts and runs are scanned whole, in time that grows with their
    length. Ties go by kind, as listed. Repeated rows come back as often. An empty table gives no rows. All columns are
    kept; one named ``secrets`` is replaced.
    """
    t = F.col("__text")
    df = docs.withColumn("__text", null_safe_text(text))
    df = df.withColumn("__base", F.sort_array(F.concat(*[base_spans(t, k) for k in KINDS]))).withColumn("__cut", cuts(F.col("__base")))
    if beside:
        df = df.withColumn("__masked", spliced(t, F.col("__cut"), lambda c, begins, n: F.repeat(F.lit("\0"), n)))
        clear = entropy_spans(t, allow, F.col("__masked"))
    else:
        df = df.withColumn("__more", entropy_spans(t, allow))
        clear = F.filter("__more", lambda m: before(F.col("__cut"), lambda c: c["hi"] <= m["start"]) >= before(F.col("__cut"), lambda c: c["lo"] < m["end"]))
    return df.withColumn("secrets", F.sort_array(F.concat("__base", clear))).drop("__text", "__base", "__cut", "__masked", "__more")


def redact(docs: DataFrame, mark: str = "[REDACTED]", text: str = "text", beside: bool = False) -> DataFrame:
    """``docs`` with the characters of every secret of ``scan_secrets`` replaced; spans that overlap get one mark.

    Texts without secrets, null and empty ones among them, stay as they are. Repeated rows come back as often. An empty
    table gives no rows. All columns but one named ``secrets`` are kept.
    """
    df = scan_secrets(docs, text=text, beside=beside).withColumn("__cut", cuts(F.col("secrets")))
    put = lambda c, begins, n: F.when(c["new"] & begins, F.lit(mark)).otherwise(F.lit(""))
    return df.withColumn(text, spliced(F.col(text), F.col("__cut"), put)).drop("__cut", "secrets")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document, as counts and digests."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), beside=True)
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    own = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["rank"] < len(KINDS))
    return found.select("doc_id", *[own(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
