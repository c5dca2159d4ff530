"""Queries over texts: extraction, cleaning, and checks of what an output may say."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import evaluation as E
from colloquy.plans import fixtures as X
from colloquy.plans.registry import registry
from colloquy.sources import rttm

Q, SQL, query = registry()


@query(r"SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS numbers FROM (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_ordered FROM (SELECT doc_id, regexp_extract_all(text, '[$€£]?\d+(?:[.,]\d+)*(?:[kKmM%])?') AS a FROM documents)) WHERE len(list_distinct_ordered) > 0")
def number_extraction(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", S.numbers("text").alias("n"))
    return d.where(F.size("n") > 0).select("doc_id", F.array_join("n", "|").alias("numbers"))


@query(r"SELECT d.doc_id, len(list_filter(regexp_extract_all(d.text, '[$€£]?\d+(?:[.,]\d+)*(?:[kKmM%])?'), lambda x: NOT list_contains(regexp_extract_all(substr(d.text, 1, length(d.text) // 2), '[$€£]?\d+(?:[.,]\d+)*(?:[kKmM%])?'), x))) = 0 AS preserved FROM documents d")
def numbers_preserved(spark, sf):
    d = X.table(spark, sf, "documents")
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return d.select("doc_id", (F.size(F.array_except(S.numbers("text"), S.numbers(half))) == 0).alias("preserved"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS spans FROM (SELECT conv_id, turn, list_concat(list_concat(regexp_extract_all(t, '"([^"]+)"', 1), regexp_extract_all(t, '\(([^()]+)\)', 1)), regexp_extract_all(t, '`([^`]+)`', 1)) AS a FROM (SELECT conv_id, turn, concat('"', role, '" (', turn, ') `', conv_id, '` ', text) AS t FROM conversations))""")
def verbatim_spans(spark, sf):
    c = X.table(spark, sf, "conversations")
    t = F.concat(F.lit('"'), "role", F.lit('" ('), F.col("turn").cast("string"), F.lit(") `"), F.col("conv_id").cast("string"), F.lit("` "), "text")
    return c.select("conv_id", "turn", F.array_join(S.quoted(t), "|").alias("spans"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM conversations")
def asr_normalise(spark, sf):
    return X.table(spark, sf, "conversations").select("conv_id", "turn", S.plain("text").alias("plain"))


@query("WITH m AS (SELECT conv_id, array_to_string(list_slice(list(concat(role, '→', turn) ORDER BY turn), 1, 5), ', ') AS preview FROM conversations GROUP BY conv_id) SELECT * FROM m")
def mapping_preview(spark, sf):
    m = X.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("turn").cast("string").alias("to")))).alias("m"))
    return m.select("conv_id", S.mapping_preview("m").alias("preview"))


@query(r"""WITH t AS (SELECT event_id, unnest(['$' || format('{:,}', CAST(round(value * 100) AS BIGINT)), CAST(round(value * 100) AS BIGINT) || 'k', CAST(round(value) AS BIGINT) || '.5M', CAST(event_id % 100 AS VARCHAR) || '%']) AS token, value FROM events),
v AS (SELECT event_id, token, CAST(regexp_replace(token, '[^0-9.]', '', 'g') AS DECIMAL(20, 3)) * CASE WHEN ends_with(token, 'k') THEN 1000 WHEN ends_with(token, 'M') THEN 1000000 ELSE 1 END AS value FROM t)
SELECT event_id, token, CAST(value AS DOUBLE) AS value FROM v""")
def number_values(spark, sf):
    """Prices, thousands, millions and percentages written from every event."""
    e, whole = X.table(spark, sf, "events"), F.round(F.col("value") * 100).cast("long")
    tokens = F.array(F.concat(F.lit("$"), F.format_number(whole, 0)), F.concat(whole.cast("string"), F.lit("k")), F.concat(F.round("value").cast("long").cast("string"), F.lit(".5M")), F.concat((F.col("event_id") % 100).cast("string"), F.lit("%")))
    return e.select("event_id", F.explode(tokens).alias("token")).withColumn("value", S.number_value("token"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') || '|' || strftime(CAST(ts AS DATE) + CAST(event_id % 40 + 1 AS INTEGER), '%Y-%m-%d') AS dates FROM events""")
def date_extraction(spark, sf):
    """An ISO date and a written one, the first one twice, and one that is none."""
    day = F.col("ts").cast("date")
    later = F.date_add(day, (F.col("event_id") % 40 + 1).cast("int"))
    text = F.concat_ws(" ", F.lit("from"), F.date_format(day, "yyyy-MM-dd"), F.lit("to"), F.date_format(later, "d MMMM yyyy"), F.lit("not 2024-13-77, but"), F.date_format(day, "yyyy-MM-dd"))
    return X.table(spark, sf, "events").select("event_id", F.array_join(S.dates(text), "|").alias("dates"))


_PIECES = "string_split(coalesce(text, ''), chr(10))"


@query(f"""WITH p AS (SELECT doc_id, list_transform({_PIECES}, lambda x, i: CASE WHEN i % 2 = 0 THEN concat(chr(10), x) ELSE x END) AS l FROM documents), t AS (SELECT doc_id, array_to_string(l, chr(10)) AS text FROM p),
s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 30) AS p FROM t) SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM s""")
def paragraph_split(spark, sf):
    """Documents with a blank line before every second line."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("\n"), x)).otherwise(x))
    d = X.table(spark, sf, "documents").select("doc_id", S.paragraphs(F.array_join(lines, "\n")).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"))


@query(f"""SELECT doc_id, CAST(len(list_filter({_PIECES}, lambda x: x <> '')) AS BIGINT) AS n_bullets, len(list_filter({_PIECES}, lambda x: x <> '')) BETWEEN 3 AND 12 AS within FROM documents""")
def bullet_limits(spark, sf):
    """Documents as lists, a bullet for each line that is not empty."""
    lines = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != ""), lambda x: F.concat(F.lit("- "), F.regexp_replace(x, "^- ", "")))
    d = X.table(spark, sf, "documents").select("doc_id", S.bullets(F.array_join(lines, "\n")).cast("long").alias("n_bullets"))
    return d.withColumn("within", F.col("n_bullets").between(3, 12))


@query("""WITH s AS (SELECT conv_id, string_agg(concat('## ', role), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, strpos(t, '## system') AS a, strpos(t, '## user') AS b, strpos(t, '## assistant') AS c FROM s)
SELECT conv_id, a > 0 AND b > a AND c > b AS three, b > 0 AND c > b AS two FROM p""")
def section_order(spark, sf):
    """A heading for each turn: the question before the answer, and before both what the system says."""
    heads = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("## "), x["role"]))
    s = X.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(heads, "\n").alias("t"))
    return s.select("conv_id", S.in_order("t", "## system", "## user", "## assistant").alias("three"), S.in_order("t", "## user", "## assistant").alias("two"))


@query("SELECT conv_id, turn, contains(text, 'ing') AS present, NOT contains(text, 'the ') AS absent FROM conversations")
def phrase_checks(spark, sf):
    c = X.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("text").contains("ing").alias("present"), (~F.col("text").contains("the ")).alias("absent"))


@query("WITH p(phrase) AS (VALUES ('anon'), ('then')) SELECT c.conv_id, c.turn, p.phrase FROM conversations c JOIN p ON contains(lower(c.text), p.phrase)")
def leak_check(spark, sf):
    phrases = ["anon", "then"]
    c = X.table(spark, sf, "conversations")
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.lower("text").contains(p))
    return c.select("conv_id", "turn", F.explode(found).alias("phrase"))


_PREV = "p AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)"


def _with_before(spark, sf):
    from pyspark.sql import Window

    return X.table(spark, sf, "conversations").withColumn("before", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))


@query(f"""WITH {_PREV}, n AS (SELECT conv_id, turn, before, regexp_extract_all(text, '\\b[A-Z][a-z]+') AS a FROM p), d AS (SELECT conv_id, turn, list_filter(list_filter(a, lambda x, i: list_position(a, x) = i), lambda x: NOT contains(before, x)) AS a FROM n)
SELECT conv_id, turn, CAST(len(a) AS BIGINT) AS n_untraced, array_to_string(list_slice(a, 1, 5), '|') AS first_untraced FROM d""")
def names_traceable(spark, sf):
    """Capitalised words of a turn that the turn before does not hold."""
    n = _with_before(spark, sf).select("conv_id", "turn", S.traceable(S.names("text"), "before").alias("a"))
    return n.select("conv_id", "turn", F.size("a").cast("long").alias("n_untraced"), F.array_join(F.slice("a", 1, 5), "|").alias("first_untraced"))


@query(f"""WITH {_PREV}, d AS (SELECT doc_id, list_distinct(string_split(coalesce(text, ''), ' ')) AS w FROM documents), o AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS o, string_split(before, ' ') AS s FROM p)
SELECT conv_id, turn, CAST(len(list_filter(o, lambda x: list_contains(w, x) AND NOT list_contains(s, x))) AS BIGINT) AS n_leaked FROM o JOIN d ON d.doc_id = o.conv_id""")
def document_leak(spark, sf):
    """Words that a turn shares with a reference document, and that were not in the turn it answers."""
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    o = _with_before(spark, sf).join(d, "conv_id")
    return o.select("conv_id", "turn", F.size(S.leaked(F.split("text", " "), "w", F.split("before", " "))).cast("long").alias("n_leaked"))


@query("""WITH e AS (SELECT conv_id, turn, text, string_split(text, ' ')[1] AS target FROM conversations)
SELECT conv_id, turn, (conv_id + turn) % 5 <> 0 AS same FROM e""")
def edit_outside(spark, sf):
    """An edit of the first word; every fifth one also adds a mark at the end."""
    e = X.table(spark, sf, "conversations").withColumn("target", F.split("text", " ")[0])
    rest = F.substring(F.col("text"), F.length("target") + 1, F.length("text"))
    after = F.concat(F.upper("target"), rest, F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "!").otherwise(""))
    return e.select("conv_id", "turn", S.same_outside("text", after, "target", F.upper("target")).alias("same"))


@query(r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS a, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) AS b FROM documents)
SELECT doc_id, a = b AS noop, trim(regexp_replace(regexp_replace(lower(b), '[^\p{L}\p{N} ]', ' ', 'g'), ' +', ' ', 'g')) = b AS idempotent FROM n""")
def noop_check(spark, sf):
    """Whether the normaliser left a text as it was, and whether it leaves its own output so."""
    d = X.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a")).withColumn("b", S.plain("a"))
    return d.select("doc_id", (F.col("a") == F.col("b")).alias("noop"), (S.plain("b") == F.col("b")).alias("idempotent"))


@query("""WITH c AS (SELECT event_id, user_id % 3 AS z, ts, ['today', 'Tomorrow', 'next week', 'in two weeks', 'some day'][event_id % 5 + 1] AS phrase FROM events)
SELECT event_id, strftime(ts + CASE z WHEN 0 THEN INTERVAL 2 HOUR WHEN 1 THEN INTERVAL (-300) MINUTE ELSE INTERVAL 330 MINUTE END, '%Y-%m-%d %H:%M') AS clock,
  CAST(CAST(ts AS DATE) + CASE lower(phrase) WHEN 'today' THEN 0 WHEN 'tomorrow' THEN 1 WHEN 'next week' THEN 7 WHEN 'in two weeks' THEN 14 END AS VARCHAR) AS due, phrase FROM c""")
def local_clock(spark, sf):
    """Each event on its user's clock, and the date that its phrase means, beside the phrase as it was said."""
    e = X.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ("+02:00", "-05:00", "+05:30")]), (F.col("user_id") % 3 + 1).cast("int"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in ("today", "Tomorrow", "next week", "in two weeks", "some day")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", S.local_clock("ts", zone).alias("clock"), S.due_date(F.col("ts").cast("date"), phrase).cast("string").alias("due"), phrase.alias("phrase"))


#: By conv_id and turn: how a completion wraps its JSON. Only 0, 1, 2, 3 and 8 can be decoded.
_WRAPS = 9


@query(f"""WITH t AS (SELECT conv_id * 100 + turn AS file_id, role, turn, (3 * conv_id + turn) % {_WRAPS} AS kind FROM conversations)
SELECT file_id, CASE kind WHEN 3 THEN '<think>b</think>' ELSE role END AS speaker, CAST(1000 * turn AS BIGINT) AS start_ms, CAST(1000 * turn + CASE kind WHEN 8 THEN 1 ELSE 500 END AS BIGINT) AS end_ms FROM t WHERE kind IN (0, 1, 2, 3, 8)""")
def response_decode(spark, sf):
    """Completions bare, fenced (with words after the fence), after thoughts, with thoughts inside a value, fenced after
    thoughts, cut off, empty, without a message, and with a segment that lacks its end."""
    c = X.table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("file_id"), "role", "turn", ((3 * F.col("conv_id") + F.col("turn")) % _WRAPS).alias("kind"))
    label = F.when(F.col("kind") == 3, "<think>b</think>").otherwise(F.col("role"))
    end = F.when(F.col("kind") != 8, F.col("turn") + 0.5)
    body = F.to_json(F.struct(F.array(F.struct(label.alias("speakerId"), F.col("turn").cast("double").alias("startTime"), end.alias("endTime"))).alias("segments")))
    thought = F.lit("<think>the {first}</think>")
    text = (
        F.when(F.col("kind") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("kind").isin(2, 3), F.concat(F.lit("Well. "), thought, F.lit("\n"), body))
        .when(F.col("kind") == 4, F.concat(thought, F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("kind") == 5, F.substring(body, F.lit(1), F.length(body) - 3)).when(F.col("kind") == 6, "").otherwise(body)
    )
    message = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    raw = F.when(F.col("kind") == 7, '{"error": {"code": 429}}').otherwise(message)
    return rttm.response_segments(c.select("file_id", raw.alias("raw")))


@query("""SELECT doc_id, concat('<TRANSCRIPT duration_minutes="', CAST(floor(n_chars / 60) AS BIGINT), '">', chr(10), '[{"doc":', doc_id, '}]', chr(10), '</TRANSCRIPT>') AS prompt FROM documents""")
def prompt_wrapper(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", S.prompt("n_chars", F.to_json(F.array(F.struct(F.col("doc_id").alias("doc"))))).alias("prompt"))


_EXPECT = "regexp_extract_all(coalesce(text, ''), '\\b[A-Z][a-z]+')"


@query(f"""WITH l AS (SELECT doc_id, list_distinct({_EXPECT}) AS e, {_EXPECT.replace("coalesce(text, '')", "substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 2)")} AS f FROM documents)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_expected, round(CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: list_contains(f, x))) / len(e) END, 9) AS coverage FROM l""")
def key_point_coverage(spark, sf):
    """Names of a document that its first half holds."""
    d, text = X.table(spark, sf, "documents"), F.coalesce("text", F.lit(""))
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    return d.select("doc_id", F.size(S.names(text)).cast("long").alias("n_expected"), F.round(E.coverage(S.names(text), S.names(half)), 9).alias("coverage"))


@query("""WITH g AS (SELECT conv_id, lower(unnest(list_slice(string_split(text, ' '), 1, 6))) AS goal FROM conversations WHERE turn = 0),
t AS (SELECT conv_id, string_agg(lower(text), chr(10) ORDER BY turn) AS said FROM conversations WHERE turn > 0 GROUP BY conv_id)
SELECT DISTINCT g.conv_id, goal FROM g LEFT JOIN t USING (conv_id) WHERE NOT coalesce(contains(said, goal), false)""")
def uncovered_goals(spark, sf):
    """Goals are the first words of a conversation's first turn; later turns cover them or not."""
    c = X.table(spark, sf, "conversations")
    goals = c.where("turn = 0").select("conv_id", F.explode(F.slice(F.split("text", " "), 1, 6)).alias("goal")).select("conv_id", F.lower("goal").alias("goal")).distinct()
    return E.uncovered(goals, c.where("turn > 0"), "conv_id", "text", "turn")
