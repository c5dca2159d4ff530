"""Scalar functions of the evaluation data as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """White-space tokens of a trimmed line."""
    return F.split(F.regexp_replace(_c(text), r"^\s+|\s+$", ""), r"\s+")


def speaker_label(name) -> Column:
    """Spaces become underscores, round brackets go."""
    return F.translate(_c(name), " ()", "_")


def fixed3(ms) -> Column:
    """Whole milliseconds as seconds with three decimals, without a float in between."""
    ms = _c(ms)
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def minutes(seconds) -> Column:
    return (_c(seconds) / 60).cast("int")


def ratio(a, b) -> Column:
    """a / b, and 0 where the denominator is 0 or either is missing."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def strip_fence(text) -> Column:
    """Where the text begins with a code fence: what stands between its first line and the last fence; null without a second line."""
    text = _c(text)
    body = F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)
    inner = F.when(body.contains("```"), F.regexp_extract(body, r"(?s)^(.*)```", 1)).otherwise(body)
    return F.when(~text.startswith("```"), text).when(text.contains("\n"), inner)


def strip_think(text) -> Column:
    """Everything up to the end of the first thoughts goes; thoughts that never end stay, and so do later ones."""
    text = _c(text)
    rest = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?</think>", ""), r"^\s+|\s+$", "")
    return F.when(text.contains("<think>") & text.contains("</think>"), rest).otherwise(text)


def response_text(text) -> Column:
    """Fence first, thoughts second: a fence that follows thoughts stays."""
    return strip_think(strip_fence(text))


def response_content(raw) -> Column:
    """The message of a completion's JSON; null where it is missing, empty or no JSON."""
    content = F.try_variant_get(F.try_parse_json(_c(raw)), "$.choices[0].message.content", "string")
    return F.when(content != "", content)


def response_body(raw) -> Column:
    """The cleaned message as JSON text; null where it does not parse, so one bad response spoils no job."""
    body = response_text(response_content(raw))
    return F.when(F.try_parse_json(body).isNotNull(), body)


def prompt(duration_seconds, segments_json) -> Column:
    return F.concat(F.lit('<TRANSCRIPT duration_minutes="'), minutes(duration_seconds).cast("string"), F.lit('">\n'), _c(segments_json), F.lit("\n</TRANSCRIPT>"))


def mapping_preview(mapping, n: int = 5) -> Column:
    """First ``n`` entries of an array of from/to structs."""
    return F.array_join(F.transform(F.slice(_c(mapping), 1, n), lambda m: F.concat(m["from"], F.lit("→"), m["to"])), ", ")


def paragraphs(text, mark: str = "\n\n", least: int = 30) -> Column:
    """Trimmed parts between blank lines (or ``mark``) of at least ``least`` characters."""
    parts = F.transform(F.split(_c(text), mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.length(p) >= least)


def plain(text) -> Column:
    """Lower case, no punctuation, single spaces, as a recogniser writes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N} ]", " "), " +", " "))


NUMBER = r"[$€£]?\d+(?:[.,]\d+)*(?:[kKmM%])?"


def numbers(text) -> Column:
    """Distinct numbers, prices and percentages, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(NUMBER), F.lit(0)))


DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}"


def dates(text) -> Column:
    """Distinct ISO and written dates as ISO dates, in order of first appearance; impossible ones are left out."""
    found = F.regexp_extract_all(_c(text), F.lit(DATE), F.lit(0))
    iso = F.transform(found, lambda d: F.coalesce(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")), F.try_to_timestamp(d, F.lit("d MMMM yyyy"))).cast("date").cast("string"))
    return F.array_distinct(F.array_compact(iso))


def number_value(token) -> Column:
    """``$40,000`` and ``$40k`` have one value."""
    token = _c(token)
    digits = F.regexp_replace(token, r"[^0-9.]", "").try_cast("decimal(20,3)")
    scale = F.when(F.lower(token).endswith("k"), 1000).when(F.lower(token).endswith("m"), 1_000_000).otherwise(1)
    return (digits * scale).cast("double")


def quoted(text) -> Column:
    """Spans in double quotes, round brackets or backticks."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(_c(text), F.lit(p), F.lit(1)) for p in (r'"([^"]+)"', r"\(([^()]+)\)", r"`([^`]+)`")]))


def names(text) -> Column:
    """Capitalised tokens."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b[A-Z][a-z]+"), F.lit(0)))


def traceable(names_, *sources) -> Column:
    """Those names of an array that stand in none of the texts."""
    texts = F.concat_ws("\n", *[_c(x) for x in sources])
    return F.filter(_c(names_), lambda n: ~texts.contains(n))


def leaked(output, document, selection) -> Column:
    """Words that the output has from a document, and not from the selection; all three are arrays."""
    return F.array_except(F.array_intersect(_c(output), _c(document)), _c(selection))


def same_outside(before, after, target, replacement) -> Column:
    """Whether an edit turned the first ``target`` into ``replacement`` and left all else as it was, byte for byte."""
    before, after, target, replacement = (_c(x) for x in (before, after, target, replacement))
    at = F.call_function("instr", before, target)
    want = F.concat(F.substring(before, F.lit(1), at - 1), replacement, F.substring(before, at + F.length(target), F.length(before)))
    return F.when(at > 0, after == want).otherwise(after == before)


def in_order(text, *marks: str) -> Column:
    """Whether the first places of the marks ascend, all of them being there."""
    at = [F.instr(_c(text), m) for m in marks]
    ok = at[0] > 0
    for a, b in zip(at, at[1:], strict=False):
        ok = ok & (b > a)
    return ok


def bullets(text) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?m)^- "))


#: Relative due phrases and their days; all others have none.
PHRASE_DAYS = {"today": 0, "tomorrow": 1, "next week": 7, "in two weeks": 14}


def due_date(said_on, phrase) -> Column:
    """The date that a relative phrase means; the phrase itself stays verbatim in its own column."""
    days = F.lit(None).cast("int")
    for text, n in PHRASE_DAYS.items():
        days = F.when(F.lower(_c(phrase)) == text, n).otherwise(days)
    return F.date_add(_c(said_on), days)


def run_date() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def percent_text(x) -> Column:
    """One decimal of the double's exact value, ties to even as in C's printf (Java's rounds its shortest decimal text half up); a dash where there is nothing."""
    x = _c(x).cast("double")
    return F.when(x.isNull(), "—").otherwise(F.concat(F.call_function("format_number", x * 100, F.lit("0.0")), F.lit("%")))


def local_clock(ts, tz) -> Column:
    return F.date_format(F.from_utc_timestamp(_c(ts), _c(tz)), "yyyy-MM-dd HH:mm")


def length_band(ms) -> Column:
    """Turn-length stratum; exactly ten seconds is long."""
    return F.when(_c(ms) >= 10_000, "10s+").when(_c(ms) >= 2_000, "2-10s").otherwise("<2s")


def jaccard(a, b) -> Column:
    return ratio(F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b))))


def dot(a, b) -> Column:
    """Dot product of two arrays in double precision, left to right."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
