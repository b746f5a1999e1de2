"""Text column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom import settings as S

# The characters that count as white space, and those that end a line.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOT_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85"
RARE_SPACES = "\u1680\u2028\u2029"  # the only others that NFKC leaves
INLINE_WHITESPACE = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAKS = r"\n-\r\x1c-\x1e\x85\u2028\u2029"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.trim(c, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(c: Column) -> Column:
    """Each run of white space in NFKC text as one space.

    Runs that are one space already do not match, and the pattern names single Latin-1
    characters, which the regex engine tests by table; the rare others are mapped first.
    """
    has_rare = c.contains(RARE_SPACES[0]) | c.contains(RARE_SPACES[1]) | c.contains(RARE_SPACES[2])
    plain = F.when(has_rare, F.translate(c, RARE_SPACES, "   ")).otherwise(c)
    return F.regexp_replace(plain, f" [ {NOT_SPACE}]+|[{NOT_SPACE}][ {NOT_SPACE}]*", " ")


def nfkc(c: Column) -> Column:
    """Unicode compatibility normal form, through the ICU library Spark ships with.

    ASCII text is its own normal form, so it skips the call.
    """
    folded = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True)
    )
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)


def is_blank_or_nan(stripped: Column) -> Column:
    return (stripped == "") | ((F.octet_length(stripped) == 3) & (F.lower(stripped) == "nan"))


def normalize_text(c: Column) -> Column:
    """Strip, drop empty and "nan" in any case, then NFKC and single spaces.

    The "nan" test comes before NFKC, so a full-width "nan" is kept.
    """
    return bind(
        strip(F.coalesce(c, F.lit(""))),
        lambda s: F.when(is_blank_or_nan(s), "").otherwise(F.trim(bind(nfkc(s), collapse_whitespace))),
    )


def _labelled(label: str) -> Callable[[Column], Column]:
    return lambda value: F.when(~is_blank_or_nan(value), F.concat(F.lit(f"{label}: "), value))


def multi_column_text(columns: list[str], labels: dict[str, str] | None = None) -> Column:
    """`label: value` for each filled column, joined and normalised."""
    labels = labels or {}
    parts = []
    for name in columns:
        value = strip(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        parts.append(bind(value, _labelled(labels.get(name, name))))
    return normalize_text(F.concat_ws("\n", *parts))


def truncate(c: Column, limit: int = S.MAX_TEXT_LENGTH) -> Column:
    return F.substring(c, 1, limit)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def annotation_key(representatives: Column, salt: Column) -> Column:
    """Cache key of a cluster: its representatives in order, and the grounding text."""
    return content_hash(F.concat(F.concat_ws("\n", representatives), F.lit("||"), salt))


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def prompt_line(c: Column, limit: int = S.PROMPT_LIMIT) -> Column:
    return shorten(strip(F.translate(c, "\n", " ")), limit)


def report_line(c: Column, limit: int = S.REPORT_LIMIT) -> Column:
    return shorten(F.translate(c, "\n", " "), limit)


def filled_lines(c: Column) -> Column:
    lines = F.transform(F.split(c, f"[{LINE_BREAKS}]"), strip)
    return F.filter(lines, lambda line: line != "")


def sanitize_label(c: Column) -> Column:
    """First filled line without quote marks, at most 30 characters."""
    bare = F.translate(strip(F.coalesce(c, F.lit(""))), S.LABEL_JUNK, "")
    first = bind(bare, lambda b: F.coalesce(F.try_element_at(filled_lines(b), F.lit(1)), b))
    short = F.substring(first, 1, S.LABEL_LIMIT)
    return bind(short, lambda s: F.when(s == "", S.LABEL_EMPTY).otherwise(s))


def _unwrap(c: Column, mark: str) -> Column:
    inner = F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    return F.when(c.startswith(mark) & c.endswith(mark), strip(inner)).otherwise(c)


def sanitize_summary(c: Column) -> Column:
    """One line without wrapping quotes, at most 400 characters and an ellipsis."""
    bare = bind(
        bind(strip(F.coalesce(c, F.lit(""))), lambda s: _unwrap(s, '"')), lambda s: _unwrap(s, "`")
    )
    line = bind(F.array_join(filled_lines(bare), " "), lambda s: shorten(s, S.SUMMARY_LIMIT))
    return bind(line, lambda s: F.when(s == "", S.SUMMARY_EMPTY).otherwise(s))


def unfence_json(c: Column) -> Column:
    def inner(text: Column) -> Column:
        bare = F.regexp_replace(F.trim(text, F.lit("`")), r"^json\n", "")
        return F.when(text.startswith("```"), bare).otherwise(text)

    return bind(strip(c), inner)


def parse_annotation(c: Column) -> Column:
    """Struct of `label` and `summary` from a model reply.

    A reply that is not JSON gives the label "Parse failure" and its own first 200
    characters. `from_json` turns bad JSON into a struct of nulls just as it does
    `{}`; only the corrupt-record field tells the two apart.
    """

    def parse(text: Column) -> Column:
        reply = F.from_json(
            text,
            "label string, summary string, _bad string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        )
        return F.struct(text.alias("text"), reply.alias("reply"))

    def tidy(p: Column) -> Column:
        bad = p["reply"].isNull() | p["reply"]["_bad"].isNotNull()
        return F.struct(
            F.when(bad, S.LABEL_UNPARSED).otherwise(sanitize_label(p["reply"]["label"])).alias("label"),
            F.when(bad, F.substring(p["text"], 1, 200)).otherwise(sanitize_summary(p["reply"]["summary"])).alias("summary"),
        )

    return bind(bind(unfence_json(c), parse), tidy).alias("annotation")


def unfence_markdown(c: Column) -> Column:
    """Remove a code fence (tagged markdown, md or not at all) around a reply."""

    def inner(text: Column) -> Column:
        opened = F.regexp_replace(text, "^`+", "")
        body = F.regexp_replace(
            opened, rf"^(?i)[{INLINE_WHITESPACE}]*(?:markdown|md)?[{INLINE_WHITESPACE}]*\n", ""
        )
        closed = F.regexp_replace(body, r"```\z", "")
        return F.when(text.startswith("```"), strip(closed)).otherwise(text)

    return bind(strip(c), inner)


def grounding_hint(domain: Column, hint: Column) -> Column:
    return F.format_string(S.GROUNDING_HINT, domain, hint)


def _fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value, as C and Python print it."""
    return F.call_function("format_number", value, F.lit(f"0.{'0' * places}"))


def _param_pairs(params: Column) -> list[Column]:
    """`key=value` of each parameter present, null for the others; resolutions keep three decimals."""
    pairs = []
    for name in S.PARAM_NAMES:
        value = params[name]
        shown = _fixed(value, 3) if name in S.REAL_PARAMS else value.cast("bigint").cast("string")
        pairs.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), shown)))
    return pairs


def format_params(params: Column) -> Column:
    return F.concat_ws(", ", *_param_pairs(params))


def compact_params(params: Column) -> Column:
    """Axis tick text of a parameter set."""
    k, size, resolution = params["k"], params["min_cluster_size"], params["resolution"]
    return (
        F.when(k.isNotNull(), F.concat(F.lit("k="), k.cast("bigint").cast("string")))
        .when(size.isNotNull(), F.concat(F.lit("mcs="), size.cast("bigint").cast("string")))
        .when(resolution.isNotNull(), F.concat(F.lit("res="), _fixed(resolution, 1)))
    )


def param_key(params: Column) -> Column:
    """Order-free identity of a parameter set."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))),
        ",",
    )
