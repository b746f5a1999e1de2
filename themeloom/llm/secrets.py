"""Secret scans with SQL functions alone: fixed patterns, and entropy of sliding windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, with the group and length a match must have. Runs that are too short
# cannot hold a longer match of the last two, so their length stands in the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

# Candidates of the entropy scan: whole runs of token characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
# Character classes in order of preference: pattern of the whole candidate, bits that its best window must reach.
CLASSES = (
    (r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Z0-9]+$|^(?=.*[0-9])(?=.*[A-Za-z])[a-z0-9]+$", 3.6),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 3.8),
)
# What looks random but is none: identifiers of records, checksums named as such, runs of the alphabet, samples, paths.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^sha(1|256|384|512)[-_=]",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"(?i)example|sample|placeholder|changeme|x{6,}",
    r"^[^+=]*/[^+=]*/[^+=]*/",
)
# The whole scan: pieces between = signs (and their padding), each window judged by its own class. Windows with signs besides
# letters and digits must change between the two three times, as slugs and dated paths do not.
PIECE = r"(?:(?<![A-Za-z0-9+/_=-])sha(?:1|256|384|512)[-_=])?[A-Za-z0-9+/_-]{20,}={0,2}"
PIECE_FORMS = (ALLOWED[0], r"^sha(1|256|384|512)[-_=][A-Za-z0-9+/_-]{27,128}={0,2}$")
WINDOW_FORMS = r"(?i)abcdefghij|0123456789|1234567890|example|sample|placeholder|changeme|x{6,}|/.*/.*/"
WINDOW_CLASSES = (
    (r"^[0-9A-Fa-f]+$", 3.0), (r"^[A-Z0-9]+$|^[a-z0-9]+$", 3.6), (r"^[A-Za-z0-9]+$", 3.8),
    (r"[0-9].*[A-Za-z].*[0-9].*[A-Za-z]|[A-Za-z].*[0-9].*[A-Za-z].*[0-9]", 3.8),
)
KINDS = ("assign", "access", "hex", "entropy")
MARKER = "[secret]"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, found: Column, kind: int, wanted) -> Column:
    """Spans of `found` (all matches of `pattern`, left to right) that are `wanted`, from the text between them."""
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(state, part):
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.when(wanted(part["hit"]), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    listed = F.aggregate(parts, nothing, add, lambda state: state["spans"])
    return F.when(F.size(found) > 0, listed).otherwise(F.array().cast(SPAN))


def _least_sum(candidate: Column) -> Column:
    """The least sum of c*log2(c) over the character counts c of a window: the window of highest entropy.

    Sliding by one character changes two counts, one down and one up, and the sum by two table entries.
    """
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    letters = F.transform(F.split(candidate, ""), lambda x: F.instr(F.lit(ALPHABET), x))
    events = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(candidate)),
            lambda i: F.when(
                i > WINDOW,
                F.array(
                    F.struct(F.element_at(letters, i - WINDOW).alias("x"), F.lit(-1).alias("by"), F.lit(False).alias("full")),
                    F.struct(F.element_at(letters, i).alias("x"), F.lit(1).alias("by"), F.lit(True).alias("full")),
                ),
            ).otherwise(
                F.array(F.struct(F.element_at(letters, i).alias("x"), F.lit(1).alias("by"), (i == WINDOW).alias("full")))
            ),
        )
    )
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least")
    )

    def slide(state, event):
        count = F.element_at(state["counts"], event["x"])
        total = state["sum"] + F.element_at(table, count + event["by"] + 1) - F.element_at(table, count + 1)
        counts = F.transform(state["counts"], lambda c, i: F.when(i + 1 == event["x"], c + event["by"]).otherwise(c))
        least = F.when(event["full"], F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

    return F.aggregate(events, start, slide, lambda state: state["least"])


def _suspicious(candidate: Column) -> Column:
    """Some window reaches the bits that the candidate's character class asks for, and no allowed form applies."""
    entropy = F.lit(math.log2(WINDOW)) - _least_sum(candidate) / WINDOW
    bits = F.lit(None).cast("double")
    for pattern, least in reversed(CLASSES):
        bits = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(bits)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    # a branch of its own, so that windows are only counted where the answer is open
    return F.when(bits.isNull() | allowed, F.lit(False)).otherwise(entropy >= bits - 1e-9)


def _random_somewhere(piece: Column) -> Column:
    """Some window reaches the bits of its own class; a form that is allowed excuses the part it covers, no more."""

    def judged(window):
        bits = F.lit(None).cast("double")
        for pattern, least in reversed(WINDOW_CLASSES):
            bits = F.when(window.rlike(pattern), F.lit(least)).otherwise(bits)
        share = lambda total, x: total + F.log2(F.length(window) - F.length(F.replace(window, x, F.lit(""))))
        entropy = F.lit(math.log2(WINDOW)) - F.aggregate(F.split(window, ""), F.lit(0.0), share) / WINDOW
        open_ = window.rlike("[0-9]") & window.rlike("[A-Za-z]") & bits.isNotNull() & ~window.rlike(WINDOW_FORMS)
        return F.when(open_, entropy >= bits - 1e-9).otherwise(F.lit(False))

    allowed = F.lit(False)
    for pattern in PIECE_FORMS:
        allowed = allowed | piece.rlike(pattern)
    windows = F.transform(F.sequence(F.lit(1), F.length(piece) - (WINDOW - 1)), lambda i: F.substring(piece, i, F.lit(WINDOW)))
    return F.when(allowed | ~piece.rlike("[0-9]"), F.lit(False)).otherwise(F.exists(windows, judged))


def find_spans(df: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """`df` with `_base` and `_spans`: arrays of (start, kind, end) in code points, by start and then kind.

    Base kinds are leftmost matches that do not overlap others of their kind. An entropy span is a candidate
    that no base span touches. Null and empty texts have none. With `whole` the pieces of the whole scan are entropy
    spans too, also where others overlap them.
    """
    empty = F.array().cast("array<string>")
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_body", body)
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True):
        out = out.withColumn(f"_{kind}", F.coalesce(F.regexp_extract_all("_body", F.lit(pattern), F.lit(0)), empty))
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE
    always = lambda hit: F.lit(True)
    base = F.concat(
        _spans(F.col("_body"), ASSIGN, F.col("_assign"), 0, long_value),
        _spans(F.col("_body"), ACCESS, F.col("_access"), 1, always),
        _spans(F.col("_body"), HEX, F.col("_hex"), 2, always),
    )
    out = out.withColumn("_base", F.array_sort(base))
    more = _spans(F.col("_body"), CANDIDATE, F.col("_entropy"), 3, _suspicious)
    apart = F.filter(
        more, lambda m: ~F.exists(F.col("_base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    out = out.withColumn("_spans", F.when(F.size("_entropy") > 0, F.array_sort(F.concat("_base", apart))).otherwise(F.col("_base")))
    if whole:
        out = out.withColumn("_piece", F.coalesce(F.regexp_extract_all("_body", F.lit(PIECE), F.lit(0)), empty))
        pieces = _spans(F.col("_body"), PIECE, F.col("_piece"), 3, _random_somewhere)
        every = F.array_sort(F.array_distinct(F.concat("_spans", pieces)))
        out = out.withColumn("_spans", F.when(F.size("_piece") > 0, every).otherwise(F.col("_spans"))).drop("_piece")
    return out.drop("_body", *(f"_{kind}" for kind in KINDS))


def spelled(spans: str) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.col(spans), one), ",")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans` for every row, without Python or a shuffle.

    A null or empty text has no spans, and the hash of the empty string. Repeated rows and null keys stay; other columns are ignored.
    """
    found = find_spans(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    count = lambda i: F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        F.col("_key").alias(key), *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(spelled("_base"), 256).alias("base_sha256"), spelled("_spans").alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", marker: str = MARKER, whole: bool = False) -> DataFrame:
    """`df` with every span of `text` (overlapping ones together; of the whole scan if so asked) replaced by `marker`. A null text stays null."""
    found = find_spans(df, text, whole)
    body = F.col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def take(state, span):
        gap = F.substring(body, state["at"] + 1, span["start"] - state["at"])
        fresh = F.concat(state["out"], gap, F.lit(marker))
        return F.struct(
            F.when(span["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    rest = lambda state: F.concat(state["out"], F.substring(body, state["at"] + 1, F.length(body)))
    clean = F.when(F.size("_spans") > 0, F.aggregate(F.col("_spans"), start, take, rest)).otherwise(body)
    return found.withColumn(text, clean).drop("_base", "_spans")
