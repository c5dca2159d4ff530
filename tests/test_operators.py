from __future__ import annotations

import collections
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import score
from colloquy.functions import scalars as S
from colloquy.operators import diarization as D
from colloquy.operators import evaluation as E
from colloquy.operators import retrieval as R
from colloquy.sources import corpora, report, rttm
from colloquy.streaming import commits

SEG = "file_id string, side string, speaker string, start_ms long, end_ms long, line long"


def der(spark, rows, **kw):
    found = D.der_by_file(spark.createDataFrame([("f", *r, i) for i, r in enumerate(rows)], SEG), **kw).collect()
    return found[0].asDict() if found else None


def test_same_sides_have_no_error(spark):
    r = der(spark, [("ref", "a", 0, 1000), ("ref", "b", 1500, 4000), ("hyp", "x", 0, 1000), ("hyp", "y", 1500, 4000)])
    assert r["der"] == 0 and r["total_ms"] == 750 + 2250


def test_permuted_labels_change_nothing(spark):
    one = der(spark, [("ref", "a", 0, 3000), ("ref", "b", 3000, 5000), ("hyp", "x", 0, 3500), ("hyp", "y", 3500, 5000)])
    two = der(spark, [("ref", "a", 0, 3000), ("ref", "b", 3000, 5000), ("hyp", "y", 0, 3500), ("hyp", "x", 3500, 5000)])
    assert one["der"] == two["der"] > 0 and one["confusion_ms"] == 375


def test_missed_false_alarm_and_overlap(spark):
    r = der(spark, [("ref", "a", 0, 2000), ("ref", "b", 1000, 2000), ("hyp", "x", 0, 2000), ("hyp", "x", 5000, 6000)], half_collar_ms=0)
    assert (r["total_ms"], r["missed_ms"], r["fa_ms"], r["confusion_ms"]) == (3000, 1000, 1000, 0)


def test_segment_shorter_than_the_collar_goes(spark):
    r = der(spark, [("ref", "a", 0, 200), ("ref", "a", 5000, 9000), ("hyp", "x", 5000, 9000)])
    assert r["total_ms"] == 3750 and r["missed_ms"] == 0


def test_uem_cuts_half_a_segment(spark):
    uem = spark.createDataFrame([("f", 0, 1000)], "file_id string, start_ms long, end_ms long")
    assert der(spark, [("ref", "a", 0, 2000), ("hyp", "x", 0, 500)], half_collar_ms=0, uem=uem)["missed_ms"] == 500


def test_files_without_hypothesis_are_skipped(spark):
    seg = spark.createDataFrame([("f", "ref", "a", 0, 10, 0), ("g", "ref", "a", 0, 10, 0), ("g", "hyp", "a", 0, 10, 0)], SEG)
    assert [r.file_id for r in D.skipped(seg).collect()] == ["f"]
    assert [r.file_id for r in D.der_by_file(seg).collect()] == ["g"]


def test_identical_spans_keep_the_last_line(spark):
    seg = spark.createDataFrame([("f", "ref", "a", 0, 10, 0), ("f", "ref", "b", 0, 10, 1), ("f", "ref", "c", 5, 5, 2)], SEG)
    assert [r.speaker for r in D.dedupe_spans(seg).collect()] == ["b"]


def test_assignment_against_brute_force():
    random.seed(3)
    for _ in range(200):
        n = random.randint(1, 5)
        gain = np.array([[random.randint(0, 20) for _ in range(n)] for _ in range(n)], float)
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(gain[i, c] for i, c in enumerate(D._hungarian(-gain))) == best


def test_published_example_adds_up():
    der, missed, fa, confusion = 0.4397029962692367, 0.26402436654748934, 0.07175404166019042, 0.1039245880615569
    assert der == pytest.approx(missed + fa + confusion, abs=1e-12)


def test_rttm_lines(spark):
    lines = ["; comment", "", "SPKR-INFO f 1 <NA>", "SPEAKER f 1 0.5 1.25 <NA> <NA> a\tb <NA>", "SPEAKER  f 1\t2.000 0.0625 <NA> <NA> c <NA> <NA>"]
    got = rttm.parse_rttm(spark.createDataFrame([("f", x) for x in lines], "file_id string, value string")).collect()
    assert [(r.speaker, r.start_ms, r.end_ms) for r in got] == [("a", 500, 1750), ("c", 2000, 2063)]


def test_rttm_files_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("m1", "A (x)", 700, 1500), ("m1", "A (x)", 0, 500), ("m+2/é%", "B", 10, 10)], "file_id string, speaker string, start_ms long, end_ms long")
    for _ in range(2):  # the second write replaces the first
        rttm.write_rttm(seg.where("file_id = 'm1'"), f"file://{tmp_path}/a")
    assert (tmp_path / "a" / "m1.rttm").read_text() == "SPEAKER m1 1 0.000 0.500 <NA> <NA> A_x <NA> <NA>\nSPEAKER m1 1 0.700 0.800 <NA> <NA> A_x <NA> <NA>\n"
    rttm.write_rttm(seg.withColumn("file_id", F.translate("file_id", "/", "")), f"file://{tmp_path}/b")
    got = {(r.file_id, r.speaker, r.start_ms, r.end_ms) for r in rttm.read_rttm(spark, f"file://{tmp_path}/b").collect()}
    assert got == {("m1", "A_x", 0, 500), ("m1", "A_x", 700, 1500), ("m+2é%", "B", 10, 11)}


def test_a_broken_store_is_an_error(spark):
    rows = spark.createDataFrame([("a", '{"segments": [{"startTime": 1')], "id string, segments_json string")
    with pytest.raises(Exception, match="no JSON in meeting a"):
        rttm.store_segments(rows).collect()


def test_responses(spark):
    body = '{"a":2}'
    cases = {
        body: body, "```json\n" + body + "\n```": body, "```\n" + body + "\n```\nDone.": body, "```json" + body: None, "note <think>x</think> " + body: body,
        '<think>a</think>{"t":"<think>b</think>"}': '{"t":"<think>b</think>"}', "<think>a</think>```json\n" + body + "\n```": None, "<think>a " + body: None, "": None, '{"a":': None,
    }
    rows = spark.createDataFrame([(json.dumps({"choices": [{"message": {"content": c}}]}), w) for c, w in cases.items()], "raw string, want string")
    for r in rows.select("raw", "want", S.response_body("raw").alias("got")).collect():
        assert (r.got and r.got.strip()) == r.want, r.raw
    odd = spark.createDataFrame([("no json",), ('{"choices": []}',), (None,), ('{"error": 1}',)], "raw string")
    assert [r[0] for r in odd.select(S.response_body("raw")).collect()] == [None] * 4


def test_report_is_one_file(spark, tmp_path):
    files = spark.createDataFrame([("a", "f2", 0.5, 0.1, 0.2, 0.2, 2, 3), ("a", "f1", 0.25, 0.0, 0.25, 0.0, 1, 1), ("b", "g", 1.0, 1.0, 0.0, 0.0, 1, 0)], "corpus string, file_id string, der double, missed double, fa double, confusion double, n_ref_speakers long, n_hyp_speakers long")
    totals = files.groupBy("corpus").agg(F.count("*").alias("n_files"), *[F.avg(c).alias(c) for c in ("der", "missed", "fa", "confusion")])
    base = files.where("file_id = 'f1'").select("corpus", "file_id", "der")
    for name, more in (("plain", ()), ("base", (base, base.select("corpus", "der")))):
        path = tmp_path / name
        for _ in range(2):
            report.write_report(report.report_lines(files, totals, *more), f"file://{path}")
        (part,) = path.glob("part-*")
        text = part.read_text()
        assert text.index("## Summary") < text.index("| a | 2 | 37.5% |") < text.index("## Files") < text.index("### a") < text.index("| f1 |") < text.index("| f2 |") < text.index("### b")
        assert ("| f1 | 25.0% | 25.0% | 1 | 1 |" in text, "| f2 | — | 50.0% | 2 | 3 |" in text, "| b | — | 100.0% |" in text) == ((name == "base",) * 3)
        assert "| g | 100.0% | 100.0% | 0.0% | 0.0% | 1 | 0 |" in text
        assert ("Baseline comparison" in text) == (name == "base")


def test_score_of_folders(spark, tmp_path):
    def put(path, *rows):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"SPEAKER x 1 {a:.3f} {b - a:.3f} <NA> <NA> {s} <NA> <NA>\n" for s, a, b in rows))

    for corpus in ("one", "two"):  # the same name in both
        put(tmp_path / "data" / corpus / "rttm" / "m.rttm", ("a", 0, 10), ("b", 10, 20))
    put(tmp_path / "data" / "one" / "rttm" / "only-ref.rttm", ("a", 0, 10))
    put(tmp_path / "out" / "one" / "rttm" / "m.rttm", ("x", 0, 10), ("y", 10, 20))
    put(tmp_path / "out" / "two" / "rttm" / "m.rttm", ("x", 0, 20))
    put(tmp_path / "base" / "rttm" / "m.rttm", ("x", 0, 5))
    (tmp_path / "data" / "two" / "uem").mkdir()
    (tmp_path / "data" / "two" / "uem" / "m.uem").write_text("m 1 0.0 15.0\n\n")
    url = f"file://{tmp_path}"
    files = {(r.corpus, r.file_id): r for r in score.score(spark, f"{url}/data", f"{url}/out", f"{url}/results", collar=0.5, baseline_dir=f"{url}/base").collect()}
    assert set(files) == {("one", "m"), ("two", "m")}
    one, two = files["one", "m"], files["two", "m"]
    assert (one.total_ms, one.der) == (19_000, 0.0) and (two.total_ms, two.confusion_ms) == (14_250, 4_750)
    (part,) = (tmp_path / "results" / "report").glob("part-*")
    assert "| two | 1 | 33.3% | 33.3% | 0.0% | 0.0% |" in part.read_text()
    back = rttm.read_documents(spark, f"{url}/results/results", multi_line=False).collect()
    assert {r.corpus: [f.file_id for f in r.files] for r in back} == {"one": ["m"], "two": ["m"]}
    assert score.score(spark, f"{url}/data", f"{url}/out", f"{url}/results", corpus="one").count() == 1


def test_missing_stores_and_unknown_corpora(spark, tmp_path):
    assert rttm.store_ids(spark, f"file://{tmp_path}/none").count() == 0
    assert corpora.catalog(spark, "ami").count() == 16 and corpora.catalog(spark).count() == 27
    with pytest.raises(ValueError, match="no corpus"):
        corpora.catalog(spark, "x")
    done = spark.createDataFrame([("a",)], "id string")
    assert rttm.pick_new(done, done).count() == 0


def test_reference_time_where_nothing_is_scored(spark):
    seg = spark.createDataFrame([("f", "ref", "a", 0, 200, 0), ("f", "ref", "b", 100, 240, 1), ("f", "hyp", "x", 0, 100, 2)], SEG)
    r = D.with_ref_ms(D.der_by_file(seg), seg).collect()[0]
    assert (r.total_ms, r.der, r.missed, r.ref_ms) == (0, 0.0, 0.0, 240)


def test_atoms_equal_a_plain_sweep(spark):
    random.seed(14)
    rows = [(f"f{random.randrange(3)}", random.choice(["ref", "hyp"]), random.choice("abc"), t := random.randrange(40), t + random.randrange(0, 15), i) for i in range(60)]
    uem = [("f0", 5, 30), ("f0", 28, 35), ("f2", 0, 3)]
    seg = spark.createDataFrame(rows, SEG)
    for half, regions in ((0, None), (1, None), (2, uem)):
        got = D.atoms(seg, half, regions and spark.createDataFrame(regions, "file_id string, start_ms long, end_ms long")).collect()
        want = []
        for f in ("f0", "f1", "f2"):
            own = [r for r in rows if r[0] == f and r[3] < r[4]]
            for t in range(-5, 60):  # of one millisecond each
                on = lambda side, t=t, own=own: tuple(sorted({r[2] for r in own if r[1] == side and r[3] <= t < r[4]}))
                cut = any(b - half <= t < b + half for r in own if r[1] == "ref" for b in r[3:5])
                inside = regions is None or not any(x[0] == f for x in regions) or any(a <= t < b for x, a, b in regions if x == f)
                if not cut and inside and (on("ref") or on("hyp")):
                    want.append((f, t, on("ref"), on("hyp")))
        assert sorted((r.file_id, t, tuple(r.ref), tuple(r.hyp)) for r in got for t in range(r.start_ms, r.end_ms)) == sorted(want)


def test_store_defaults_and_nulls(spark):
    rows = [("a", '{"segments":[{"startTime":1.0},{"speakerId":"S (1)","startTime":2.0,"endTime":2.5}]}'), ("b", None), ("c", "")]
    got = [(r.file_id, r.speaker, r.start_ms, r.end_ms) for r in rttm.store_segments(spark.createDataFrame(rows, "id string, segments_json string")).orderBy("start_ms").collect()]
    assert got == [("a", "Unknown", 1000, 1001), ("a", "S_1", 2000, 2500)]


def test_alignment_is_cheapest():
    random.seed(5)
    for _ in range(100):
        a, b = [random.choice("abc") for _ in range(random.randint(0, 8))], [random.choice("abc") for _ in range(random.randint(0, 8))]
        op, ref, hyp = E._align(a, b)
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert (op > 0).sum() == d[-1][-1]
        assert ref[op != 3].tolist() == list(range(len(a))) and hyp[op != 2].tolist() == list(range(len(b)))
        i, j, plain = len(a), len(b), []  # the way back through the whole matrix
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                plain.append(int(a[i] != b[j]))
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                plain.append(2)
            else:
                j -= 1
                plain.append(3)
        assert op.tolist() == plain[::-1]


def test_alignment_of_long_and_null_pairs(spark):
    random.seed(15)
    long = [f"w{i}" for i in range(4000)]
    kept = [w for i, w in enumerate(long) if i % 10]
    rows = [("long", long, kept), ("empty", [], ["a"]), ("null", None, None), (None, ["a"], ["a"])]
    got = E.word_errors(E.align(spark.createDataFrame(rows, "pair_id string, ref_tokens array<string>, hyp_tokens array<string>")), "pair_id").collect()
    assert {(r.pair_id, r.n_ref, r.deletions, r.insertions) for r in got} == {("long", 4000, 400, 0), ("empty", 0, 0, 1), (None, 1, 0, 0)}


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(16)
    vecs = rng.normal(size=(90, 8)).astype(np.float32)
    vecs[40] = vecs[7]
    rows = spark.createDataFrame([(i, i % 13, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, entity long, vec array<float>").repartition(5)
    asked = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"), F.lit("q").alias("note"))
    dots = vecs.astype(float) @ vecs.astype(float).T
    for exclude, most in ((False, 10_000), (True, 4)):
        best = collections.defaultdict(list)
        for r in R.search(asked, rows, 5, exclude, most).collect():
            best[r.query_id].append((r["rank"], r.vec_id))
        pooled = {(r.query_id, r.entity): r.score for r in R.entity_scores(asked, rows, exclude, most).collect()}
        for q in range(0, 90, 7):
            order = sorted((i for i in range(90) if not (exclude and i == q)), key=lambda i: (-dots[q, i] if i != 40 else -dots[q, 7], i))
            assert [i for _, i in sorted(best[q])] == order[:5] and (order[0] == q or exclude or q in (7, 40) or dots[q, order[0]] > dots[q, q])
            for e in range(13):
                assert pooled[q, e] == pytest.approx(max(dots[q, i] for i in range(e, 90, 13) if not (exclude and i == q)))
    assert R.search(asked.limit(0), rows, 5).count() == 0 == R.entity_scores(asked, rows.limit(0)).count()


def test_consistency_equals_pairs(spark):
    rng = np.random.default_rng(17)
    vecs = rng.normal(size=(20, 4))
    rows = spark.createDataFrame([(i % 3 if i < 19 else 9, [float(x) for x in v]) for i, v in enumerate(vecs)], "entity long, vec array<double>")
    for r in R.consistency(rows, 0.1).collect():
        own = [v for i, v in enumerate(vecs) if (i % 3 if i < 19 else 9) == r.entity]
        pairs = [float(a @ b) for a, b in itertools.combinations(own, 2)]
        assert (r.similarity is None and r.agrees) if not pairs else r.similarity == pytest.approx(np.mean(pairs)) and r.agrees == (np.mean(pairs) >= 0.1)


def test_edits_dates_and_clocks(spark):
    t = spark.createDataFrame([("let count = count", "let total = count", "count", "total"), ("a b", "a c", "b", "d"), ("a", "a", "z", "y"), ("a", "b", "z", "y")], "a string, b string, t string, r string")
    assert [r[0] for r in t.select(S.same_outside("a", "b", "t", "r")).collect()] == [True, False, True, False]
    one = spark.sql("SELECT 'on 3 March 2024, 2024-02-30 and 2024-03-03, $1.5k' AS x, timestamp'2024-07-01 22:30:00' AS ts")
    r = one.select(S.dates("x").alias("d"), S.local_clock("ts", F.lit("America/New_York")).alias("c"), S.due_date(F.lit("2024-02-28").cast("date"), F.lit("Tomorrow")).alias("due")).collect()[0]
    assert (r.d, r.c, str(r.due)) == (["2024-03-03"], "2024-07-01 18:30", "2024-02-29")
    assert spark.range(1).select(S.run_date()).collect()[0][0][:2] == "20"


def test_unanswered_equals_brute_force(spark):
    random.seed(18)
    rows = [(k, i, random.choice("ab")) for k in range(30) for i in range(random.randint(1, 5))]
    got = {(r.k, r.i) for r in E.unanswered(spark.createDataFrame(rows, "k int, i int, s string"), "k", "i", "s").collect()}
    assert got == {(k, i) for k, i, s in rows if not any(x == k and j > i and o != s for x, j, o in rows)}


LOG = "token long, ts timestamp, tier string, text string"


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(rows, "token long, ts string, tier string, text string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def log():
        return commits.read_log(spark, f"file://{tmp_path}/in", LOG)

    def run(name, stream, mode="append"):
        return sorted(tuple(r) for r in commits.run_once(stream, f"file://{tmp_path}/{name}", mode).collect())

    def all_():
        kinds = log().withColumn("tier", F.when(F.col("tier") == "committed", "final").otherwise("shown"))
        return run("c", commits.changes(log())), run("p", commits.pauses(log())), run("d", commits.dropped_changes(kinds)), run("w", commits.windows(log(), "2 minutes", "1 minute"), "complete")

    day = "2024-01-01 00:"
    put((1, day + "00:00", "provisional", "a"), (1, day + "00:30", "provisional", "b"), (1, day + "02:00", "committed", "c d"), (2, day + "00:00", "committed", "x"))
    first = all_()
    assert first[0] == [(1, "provisional", 2, 2, 1, 1, 0)] and first[2] == [(2, 1)]
    assert [(t, c - p) for t, p, c in first[1]] == [(1, 120_000), (1, 90_000)]
    assert all_() == first  # nothing new
    put((1, day + "01:00", "committed", "late"), (1, day + "03:00", "committed", "c d"), (2, "2024-01-03 00:00:00", "provisional", "y"))
    second = all_()
    assert [x for x in second[0] if x not in first[0]] == [(1, "committed", 1, 0, 0, 0, 1), (2, "committed", 1, 1, 0, 0, 0)]
    assert second[1] == first[1] and second[2] == [(2, -1), (2, 1)]
    assert len(second[3]) > len(first[3]) and sum(x[2] for x in second[3]) == 14
    put((3, "2023-12-01 00:00:00", "committed", "older than the watermark"))
    assert all_()[0] == second[0]


def test_state_goes_after_its_time(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(rows, "token long, ts string, tier string, text string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    out = []
    for rows in ([(1, "2024-01-01 00:00:00", "committed", "a")], [(2, "2024-01-05 00:00:00", "committed", "z")], [(2, "2024-01-06 00:00:00", "committed", "z")], [(1, "2024-01-06 00:00:00", "committed", "b")]):
        put(*rows)
        out = commits.run_once(commits.changes(commits.read_log(spark, f"file://{tmp_path}/in", LOG), keep=3600), f"file://{tmp_path}/c").collect()
    assert {(r.token, r.n) for r in out} == {(2, 1)} or {(r.token, r.n) for r in out} == set()  # token 1 begins anew


def test_percentages_are_rounded_from_their_exact_value(spark):
    shares = [0.1225, 0.1325, 0.0625, 0.1235, 0.0025, 0.0075, 0.0, 1.0, 12.34567, 0.9995, 1 / 3, *(i / 800 for i in range(800)), *(i / 2000 for i in range(0, 6000, 7))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(shares)], "i int, x double").select("i", S.percent_text("x").alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: f"{x * 100:.1f}%" for i, x in enumerate(shares)}


def test_uncovered_goals_equal_a_search_in_the_whole_text(spark):
    rng = random.Random(3)
    said = [(k, n, None if rng.random() < 0.1 else "".join(rng.choice(["a", "B", "\n", " "]) for _ in range(rng.randrange(4)))) for k in range(40) for n in range(6)]
    said += [(100, 2, "x. an"), (100, 1, "the was."), (100, 3, None), (100, 4, "end"), (100, 5, "")]
    wanted = {(k, "".join(rng.choice(["A", "b", "\n"]) for _ in range(rng.randrange(1, 5)))) for k in range(42) for _ in range(12)}
    wanted |= {(100, g) for g in ("was.\nx.", "An\nend", "was.\nx. an\nend\n", "was.\nend", "\n", "\n\n", "end\nx")} | {(None, "a")}
    text = {k: "\n".join(t.lower() for _, _, t in sorted((x for x in said if x[0] == k), key=lambda x: x[1]) if t is not None) for k in {x[0] for x in said}}
    out = E.uncovered(spark.createDataFrame(sorted(wanted, key=str), "k long, goal string"), spark.createDataFrame(rng.sample(said, len(said)), "k long, n long, t string"), "k", "t", "n").collect()
    want = {(k, g) for k, g in wanted if g.lower() not in text.get(k, "")}
    assert {(r.k, r.goal) for r in out} == want and len(out) == len(want)
    assert {g for k, g in want if k == 100} == {"was.\nend", "\n\n", "end\nx"}
