"""Secrets in text by pattern and by sliding-window entropy, on the JVM and without a shuffle.

Three patterns find assigned, access-key and hexadecimal secrets. Beside them, long unbroken strings are
candidates: a window slides over each, its character counts change by one in and one out, and with them the sum of
c log c, from which the Shannon entropy of the window follows, and the class of its characters. Each window has the
threshold of its own class; windows that reach it and meet no stretch of an allow-list give spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 12
WINDOW = 20
#: (characters of the class, bits that a window of 20 must reach) by the whole candidate, if it has digits and letters; the first class that covers it.
CLASSES = {"hex": (r"^(?:[0-9a-f-]+|[0-9A-F-]+)$", 2.9), "alphanumeric": (r"^[A-Za-z0-9]+$", 3.7), "base64": (r"^[A-Za-z0-9+/_=-]+$", 3.8)}
#: Bits that a window of 20 must reach by the class of its own characters; windows without letters have none.
BITS = {"upper hex": 2.9, "upper": 3.4, "lower digits": 3.5, "alphanumeric": 3.7, "base64": 3.8, "letters": 3.7}
#: Known harmless stretches: a UUID, literal runs and placeholders wherever they are; of the whole candidate, two or fewer characters repeated, words joined by marks, and camel-case words.
ALLOWED = (
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",
    r"^(.{1,2})\1+.?$",
    r"(?i:abcdefgh(?:i(?:j(?:k(?:l(?:m(?:n(?:o(?:p(?:q(?:r(?:s(?:t(?:u(?:v(?:w(?:x(?:yz?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?)?|0?12345678(?:90?)?|01234567|0?9?87654321)",
    r"(?i:example|sample|placeholder|changeme|dummy|redacted|x{6,}|your[_-])",
    r"^[=_+/-]*(?:[a-z]{2,}|[A-Z]{2,}|[A-Z][a-z]+|[0-9]{1,4})(?:[=_+/-]+(?:[a-z]{2,}|[A-Z]{2,}|[A-Z][a-z]+|[0-9]{1,4}))*[=_+/-]*$",
    r"^[=_+/-]*(?:(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+|[a-z]{2,}|[A-Z]{2,}|[A-Z][a-z]+)(?:[=_+/-]+|$))+$",
)
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _located(text: Column, pattern: str, value: int = 0) -> Column:
    """array<struct<begin, end, value>> of all matches, leftmost first and not overlapping, in code points.

    The text between the matches, from splitting at the same pattern, gives their places.
    """
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,value:string>>").alias("out"))
    parts = F.arrays_zip(whole.alias("n"), F.slice(gaps, 1, F.size(whole)).alias("gap"), values.alias("value"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        one = F.struct(begin.alias("begin"), (begin + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def _where(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast("array<struct<begin:int,end:int,value:string>>"))


def _c_log_c(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def _level(w: Column, window: int) -> Column:
    """The bits for a window by its characters: how many are upper-case, upper-case beyond F, lower-case and digits. Null if it is no secret."""
    letters, marks = w["upper"] + w["lower"], w["upper"] + w["lower"] + w["digit"] < window
    return (
        F.when(letters == 0, None)
        .when(marks, F.lit(BITS["base64"]))
        .when((w["lower"] == 0) & (w["late"] == 0) & (w["digit"] > 0), F.lit(BITS["upper hex"]))
        .when(w["lower"] == 0, F.lit(BITS["upper"]))
        .when(w["digit"] == 0, F.lit(BITS["letters"]))
        .when(w["upper"] == 0, F.lit(BITS["lower digits"]))
        .otherwise(F.lit(BITS["alphanumeric"]))
    )


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _windows(value: Column, codes: Column, blocked: Column, whole: Column, window: int) -> Column:
    """array<struct<begin, end>>: unions of overlapping windows that reach the bits of their class, or those of the whole candidate, and meet no blocked stretch.

    The counts of the window's characters live in an array by character; each step adds one and takes one away.
    """
    spans = "array<struct<begin:int,end:int>>"
    zero = F.lit(0)
    start = F.struct(
        F.array_repeat(zero, len(_ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), *(zero.alias(k) for k in ("upper", "late", "lower", "digit", "wall")),
        F.lit(-1).alias("begin"), F.lit(-1).alias("end"), F.array().cast(spans).alias("out"),
    )

    def moved(state: Column, i: Column, into: Column, gone: Column) -> Column:
        counts = state["counts"]
        c_in, c_out = F.get(counts, into), F.coalesce(F.get(counts, gone), zero)
        new = F.transform(counts, lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
        change = F.when(into == gone, F.lit(0.0)).otherwise(
            _c_log_c(c_in + 1) - _c_log_c(c_in) + F.when(gone >= 0, _c_log_c(c_out - 1) - _c_log_c(c_out)).otherwise(F.lit(0.0))
        )
        kind = lambda name, low, high: (state[name] + into.between(low, high).cast("int") - gone.between(low, high).cast("int")).alias(name)
        wall = F.when(F.exists(blocked, lambda s: (s["begin"] < i) & (s["end"] >= i)), i).otherwise(state["wall"])
        return F.struct(new.alias("counts"), (state["sum"] + change).alias("sum"), kind("upper", 1, 26), kind("late", 7, 26), kind("lower", 27, 52), kind("digit", 53, 62), wall.alias("wall"))

    def judged(state: Column, i: Column, w: Column) -> Column:
        bits = F.log2(F.lit(float(window))) - w["sum"] / window
        good = F.coalesce((i >= window) & (w["wall"] <= i - window) & (bits >= F.least(_level(w, window), whole)), F.lit(False))
        joins = (state["end"] >= 0) & (i - window <= state["end"])
        old = F.array(F.struct(state["begin"].alias("begin"), state["end"].alias("end")))
        return _bind(good, lambda g: F.struct(
            *(w[k].alias(k) for k in ("counts", "sum", "upper", "late", "lower", "digit", "wall")),
            F.when(g & ~joins, i - window).otherwise(state["begin"]).alias("begin"), F.when(g, i).otherwise(state["end"]).alias("end"),
            F.when(g & ~joins & (state["end"] >= 0), F.concat(state["out"], old)).otherwise(state["out"]).alias("out"),
        ))

    def step(state: Column, i: Column) -> Column:
        at = F.struct(F.get(codes, i - 1).alias("into"), F.when(i > window, F.get(codes, i - window - 1)).otherwise(F.lit(-1)).alias("gone"))
        return _bind(at, lambda x: _bind(moved(state, i, x["into"], x["gone"]), lambda w: judged(state, i, w)))

    last = lambda s: F.when(s["end"] >= 0, F.concat(s["out"], F.array(F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))).otherwise(s["out"])
    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step, last)


def entropy_spans(value: Column, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<begin, end>> of the suspicious parts of a candidate: windows by ``_windows``, widened to the next '=' or allowed stretch on either side."""
    places = lambda pattern: F.transform(_located(value, pattern), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    whole = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES.values()):
        whole = F.when(value.rlike(pattern), F.lit(bits)).otherwise(whole)
    whole = F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), whole)
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    known = F.struct(codes.alias("codes"), F.concat(*map(places, allowed)).alias("blocked"), places("=+(?=[^=])").alias("equals"), whole.alias("whole"))

    def widened(x: Column, blocked: Column, stops: Column) -> Column:
        begin = lambda s: F.coalesce(F.array_max(F.transform(F.filter(stops, lambda e: e["end"] <= s["begin"]), lambda e: e["end"])), F.lit(0))
        end = lambda s: F.coalesce(F.array_min(F.transform(F.filter(stops, lambda e: e["begin"] >= s["end"]), lambda e: e["begin"])), F.char_length(value))
        return F.array_distinct(F.transform(_windows(value, x["codes"], blocked, x["whole"], window), lambda s: F.struct(begin(s).alias("begin"), end(s).alias("end"))))

    def found(x: Column) -> Column:
        """Between the '=' first; then, for values shorter than a window, across them in what is left."""
        stops = F.concat(x["blocked"], x["equals"])
        across = lambda parts: F.concat(x["blocked"], parts)
        rest = lambda parts: F.when(F.size(x["equals"]) > 0, widened(x, across(parts), F.concat(stops, parts))).otherwise(F.slice(parts, 1, 0))
        return _bind(widened(x, stops, stops), lambda parts: F.concat(parts, rest(parts)))

    return _bind(known, found)


def secret_spans(docs: DataFrame, text_col: str = "text", out: str = "spans", window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``out``: array<struct<begin, end, kind>> of the secrets of each whole text, by begin, then kind.

    Positions are code points, ends exclusive. Null and empty texts have none. Entropy spans inside a pattern's span add
    nothing. Every column of the input stays; one that is named like ``out`` is replaced.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    kinds = {
        "assign": F.filter(_where(text.rlike(ASSIGN), _located(text, ASSIGN, 1)), lambda s: F.char_length(s["value"]) >= LEAST_VALUE),
        "access": _where(text.contains("AKIA"), _located(text, ACCESS)),
        "hex": _where(text.rlike(HEX), _located(text, HEX)),
    }
    spans = lambda found, kind: F.transform(found, lambda s: F.struct(s["begin"].alias("begin"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))
    base = F.concat(*(spans(found, kind) for kind, found in kinds.items()))

    candidates = _where(text.rlike(CANDIDATE), _located(text, CANDIDATE))
    found = docs.withColumn(out, base)
    inside = lambda c: F.exists(F.col(out), lambda s: (s["begin"] <= c["begin"]) & (s["end"] >= c["end"]))
    parts = lambda c: F.transform(entropy_spans(c["value"], window, allowed), lambda s: F.struct((c["begin"] + s["begin"]).alias("begin"), (c["begin"] + s["end"]).alias("end")))
    more = F.flatten(F.transform(F.filter(candidates, lambda c: ~inside(c)), parts))
    more = spans(F.filter(more, lambda s: ~inside(s)), "entropy")
    names = F.array(*map(F.lit, KINDS))
    ordered = F.transform(F.array_sort(F.concat(F.col(out), more)), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.get(names, s["rank"]).alias("kind")))
    return found.withColumn(out, ordered)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span of ``secret_spans`` in the text replaced by ``mark``; overlapping spans become one. A null text stays null."""
    spans = "_secret_spans"
    found = secret_spans(docs, text_col, spans, **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["begin"] >= state["at"]
        between = F.col(text_col).substr(state["at"] + 1, s["begin"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"]).alias("out"))

    rest = lambda s: F.concat(s["out"], F.col(text_col).substr(s["at"] + 1, F.char_length(text_col)))
    text = F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(*docs.columns)
