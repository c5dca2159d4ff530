"""Operators against SQL, brute force and exact round trips, and on nulls, empties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import backoff, components, decontaminate, html_extract, line_dedup, media, mixing, near_dedup, quality, queries, scratch, sharding, url_filter
from colloquy.llm.scratch import Scratch
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __h string, cls string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    line = "this very line is long enough to be a key of its own"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "one two", "en", "a"), (5, "one two", "fr", "b"), (None, "one two", "en", "a"), (6, long, "de", "b"), (7, long + " z", "de", None),
            *[(i, f"{line.upper() if i % 2 else line}  \nown {i}", "en", "c") for i in range(10, 17)], (4, "one two", "en", "a")]
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(queries.ORACLE[name]).df())


def test_operators_take_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, None, None), (4, 1, 0), (4, 1, 0), (10, 1, 0), (11, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma")], "item_id long, text string")
    for docs in (odd_docs(spark), empty(spark)):
        n = docs.count()
        assert quality.judge(docs, labels).count() == n
        assert backoff.stupid_backoff(docs).count() == n
        assert mixing.plan(docs).count() == n
        assert line_dedup.line_dedup(docs).count() == n
        assert near_dedup.near_duplicates(docs).count() == n
        assert sharding.shard(docs, 1000).count() == n
        assert decontaminate.clean(docs, items).columns == docs.columns == mixing.mix(docs).columns
        assert decontaminate.clean(docs, items).count() == n
        assert decontaminate.matches(docs, items.limit(0)).count() == 0
        pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"), F.lit("q").alias("host"))
        assert html_extract.extract(pages).count() == n
        assert url_filter.judge_urls(pages, spark.createDataFrame([(None, "/", "block")], "host string, path string, verdict string")).count() == n
        assert media.measure(media.store(docs)).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_near_duplicates_of_odd_documents(spark):
    got = collections.defaultdict(list)
    for r in near_dedup.near_duplicates(odd_docs(spark)).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[2][:0] + [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[None] == [(1, None, True)] and got[4] == [(1, None, False)] * 2 and got[5] == [(1, None, False)]
    assert got[6][0][1:] == (6, True) and got[7][0][1:] == (6, False)


def test_near_duplicates_with_null_ids(spark):
    """All texts without an id are the smallest document's: what is near one of them falls to it."""
    base = [" ".join(f"f{f}w{i}" for i in range(60)) for f in range(6)]
    rows = [(None, t) for t in base[:4]] + [(None, base[0])] * 3 + [(7, base[1] + " more"), (8, base[4]), (9, base[4] + " more"), (10, base[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x"))
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True)] * 7 + [(7, None, False), (8, 8, True), (9, 8, False), (10, 10, True)], key=str)
    assert near_dedup.keep_first(docs).count() == 9


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (6, 6), (None, 7), (8, 9), (9, 10), (10, 11), (11, 12)]
    found = components.connected_components(spark.createDataFrame(links, "a int, b int"), Scratch(spark, "t")).collect()
    assert {r.node: r.root for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}


def test_large_groups_in_chunks_equal_whole_groups(spark):
    random.seed(1)
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = texts[random.randrange(len(texts))].split()
        w[random.randrange(len(w))] = f"x{random.random()}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, cut = near_dedup.near_duplicates(docs), near_dedup.near_duplicates(docs, group_bytes=3000)
    assert sorted(whole.collect()) == sorted(cut.collect())
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    part = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = part[i], part[j]
            part = [min(a, b) if p in (a, b) else p for p in part]
    assert {r.doc_id: r.component_id for r in whole.collect()} == dict(enumerate(part))


def test_parts_of_a_hot_node_lose_no_link(spark, monkeypatch):
    """Many near copies, all in one node of every tree, cut into salted parts and their leaders into blocks."""
    random.seed(6)
    families = [[f"f{f}t{i}" for i in range(100)] for f in range(3)]
    texts = []
    for k in range(300):
        w = list(families[k % 3])
        for at in range(k % 7):  # the first words differ, so distances within a family vary
            w[at * 2] = f"x{k}y{at}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(near_dedup.near_duplicates(docs).collect())
    monkeypatch.setattr(near_dedup, "NODE", 10)
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 15)
    assert sorted(near_dedup.near_duplicates(docs).collect()) == want
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    part = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = part[i], part[j]
            part = [min(a, b) if p in (a, b) else p for p in part]
    assert [(r.doc_id, r.component_id) for r in want] == list(enumerate(part))


def test_block_max_wand_equals_brute_force(spark):
    random.seed(2)
    items = [(i, " ".join(f"w{int(random.paretovariate(0.6)) % 300}" for _ in range(random.randint(5, 30))), "end") for i in range(300)]
    index = decontaminate.Index(items, None, len(items), 18.0, 31)
    for _ in range(200):
        terms = sorted(random.sample(range(len(index.terms)), 25))
        bar = random.choice([0.1, 0.3, 0.5])
        every = collections.defaultdict(float)
        for t in terms:
            for i, s in zip(*index.lists[t][:2], strict=True):
                every[i] += s
        assert index.search(terms, bar).keys() == {i for i, s in every.items() if s >= bar - 1e-12}


def test_planted_items_are_found_and_clean_documents_stay(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    joined = {r.item_id: " ".join(r.text.split()).lower() for r in items.collect()}
    leaks = {(r.doc_id, i) for r in docs.collect() for i, t in joined.items() if t in " ".join(r.text.split()).lower()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == leaks
    assert decontaminate.clean(docs, items).count() == docs.count() - len({d for d, _ in leaks})
    whole = sorted(decontaminate.matches(docs, items).collect())
    for size in (4000, 500):  # several indexes, one result
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(decontaminate.matches(docs, items).collect()) == whole


def test_near_misses_do_not_depend_on_the_blocks(spark, monkeypatch):
    """Items of very different length, and documents that hold most of their words, spread out."""
    random.seed(13)
    texts = [" ".join(f"i{i}w{k}" for k in range(n)) for i, n in enumerate([8, 12, 20, 60, 200])]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = []
    for d in range(60):
        w = texts[d % 5].split()
        cut = random.randrange(len(w) // 2, len(w) + 1)
        gap = [f"g{d}x{k}" for k in range(random.choice([0, 5, 40, 300]))]
        rows.append((d, " ".join([*w[:cut], *gap, *w[cut:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(decontaminate.matches(docs, items).collect())
    assert 20 <= len(whole)
    for size in (1000, 300):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(decontaminate.matches(docs, items).collect()) == whole


def test_rows_without_an_id_set_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "p", 1), (2, "a b c d e f", "q", 2), (None, None, "r", 3), (None, "z y", "s", 4), (None, "z y", "t", 5)], "doc_id long, text string, __gone string, gone long")
    kept = near_dedup.keep_first(docs).collect()
    assert {(r.doc_id, r["__gone"]) for r in kept} == {(1, "p"), (None, "r"), (None, "s"), (None, "t")}
    assert quality.accept(docs.withColumn("lang", F.lit("en")), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).columns == ["doc_id", "text", "__gone", "gone", "lang"]


def kneser_ney(train: list[list[str]], vocab_extra: int = 1):
    c3 = collections.Counter(g for w in train for g in zip(["<", "<", *w], ["<", *w], w))
    c2 = collections.Counter((b, c) for _, b, c in c3)
    c1 = collections.Counter(c for _, c in c2)

    def level(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        d = [max(0.1, min(k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.0), k - 0.05)) for k in (1, 2, 3)]
        return lambda v: d[min(v, 3) - 1]

    d3, d2, d1 = level(c3), level(c2), level(c1)
    total, left = sum(c1.values()), sum(map(d1, c1.values()))
    floor = left / total / (len(c1) + vocab_extra)
    ctx3, ctx2 = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
    for (a, b, _), v in c3.items():
        ctx3[a, b][0] += v
        ctx3[a, b][1] += d3(v)
    for (b, _), v in c2.items():
        ctx2[b][0] += v
        ctx2[b][1] += d2(v)

    def p(a, b, c):
        one = (c1[c] - d1(c1[c])) / total + floor if c in c1 else floor
        two = (((c2[b, c] - d2(c2[b, c])) if (b, c) in c2 else 0) + ctx2[b][1] * one) / ctx2[b][0] if b in ctx2 else one
        return (((c3[a, b, c] - d3(c3[a, b, c])) if (a, b, c) in c3 else 0) + ctx3[a, b][1] * two) / ctx3[a, b][0] if (a, b) in ctx3 else two

    return lambda w: math.exp(-sum(math.log(p(a, b, c)) for a, b, c in zip(["<", "<", *w], ["<", *w], w)) / len(w))


def test_perplexity_equals_plain_kneser_ney(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scratch = Scratch(spark, "t")
    model, calibration = quality.train(docs, labels, scratch)
    held = {r.t_id for r in calibration.collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    rows = [r for r in docs.collect() if r.lang == "en"]
    ppl = kneser_ney([WORD.findall(r.text) for r in rows if r.doc_id in good - held])
    got = {r.doc_id: r.log_ppl for r in quality.score(docs, model).collect()}
    for r in rows[:60]:
        assert got[r.doc_id] == pytest.approx(math.log(ppl(WORD.findall(r.text))), abs=2e-4)


def test_every_trusted_language_has_its_share_of_the_sample(spark):
    assert quality.share_of([5, 100, 100], 65) == 30 and quality.share_of([5, 6], 65) == 65 and quality.share_of([], 9) == 9
    random.seed(8)
    rows = [(i, " ".join(random.choices(["alpha", "beta", "gamma", "delta"], k=40)), "en" if i % 40 else "qq") for i in range(800)]
    rows += [(i, "long words " * 30_000, lang) for i, lang in enumerate(["en", "en", "en", "en", "xx", "xx", "xx"], 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    with pytest.warns(UserWarning, match="'xx'"):
        model, _ = quality.train(docs, labels, Scratch(spark, "t"), train_bytes=12_000)
    assert {r.lang for r in model.langs.collect()} == {"en", "qq"}
    got = quality.score(docs.where("doc_id < 800"), model).where("log_ppl is null").count()
    assert got == 0
    few, _ = quality.train(docs.where("doc_id < 800"), labels, Scratch(spark, "t"), train_docs=8)
    assert {r.lang for r in few.langs.collect()} == {"en", "qq"}


def test_every_trusted_document_of_the_training_half_is_counted(spark):
    docs = spark.range(56).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.repeat(F.lit("the same few words "), 15_000), F.concat(F.lit("own"), "id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model, calibration = quality.train(docs, labels, Scratch(spark, "t"))
    held = {r.t_id for r in calibration.collect()}
    assert (56 - len(held)) * 15_000 * 19 > 6 << 20  # beyond what a sample of six megabytes had
    got = {r.doc_id: r.log_ppl for r in quality.score(docs.select("doc_id", "lang", F.concat(F.lit("own"), "doc_id").alias("text")), model).collect()}
    assert max(x for i, x in got.items() if i not in held) < min(x for i, x in got.items() if i in held)


def test_scores_are_those_of_any_blocks_shards_and_parts(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, _ = quality.train(docs, labels, Scratch(spark, "t"))
    want = sorted(quality.score(docs, model).collect())
    for name, value in (("BLOCK_BYTES", 20_000), ("SHARD_KEYS", 7_000), ("PART_BYTES", 150_000)):
        monkeypatch.setattr(quality, name, value)
    assert sorted(quality.score(docs, model).collect()) == want


def test_thresholds_equal_a_plain_fit(spark):
    random.seed(9)
    rows = [(i, lang, random.choice([1, 3, 20, 400]), round(random.gauss(6, 0.5), 6)) for i, lang in enumerate(["en", None] * 150)]
    rows += [(900, "en", 0, None), (901, "xx", 5, 7.0)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, log_ppl double")
    ids = spark.createDataFrame([(i,) for i in range(0, 901, 3)], "t_id long")
    bars = {r.t_lang: r for r in quality.thresholds(scored, ids, 0.9).collect()}
    assert set(bars) == {"en", quality.NO_LANGUAGE}
    for lang, name in (("en", "en"), (None, quality.NO_LANGUAGE)):
        own = [r for r in rows if r[1] == lang and r[0] % 3 == 0 and r[3] is not None]
        mean = sum(r[3] for r in own) / len(own)
        x, y = np.array([1 / r[2] for r in own]), np.array([(r[3] - mean) ** 2 for r in own])
        b = max(0.0, ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        spread = np.sqrt(np.maximum(y.mean() - b * x.mean() + b * x, max(y.mean() / 16, 1e-6)))
        z = sorted((np.array([r[3] for r in own]) - mean) / spread)
        assert bars[name].bar == pytest.approx(z[math.ceil(0.9 * len(z)) - 1], abs=2e-3)
    judged = {r.doc_id: r for r in quality._judged(scored, spark.createDataFrame(list(bars.values()))).collect()}
    assert judged[900].kept and judged[901].kept and judged[901].threshold is None
    assert all(r.kept == (r.perplexity <= r.threshold) for r in judged.values() if r.threshold is not None)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {x.quality: x.k for x in r.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.3


def test_subset_sum_against_brute_force():
    random.seed(4)
    for _ in range(200):
        lengths = random.sample(range(1, 30), random.randint(1, 5))
        counts = [random.randint(1, 3) for _ in lengths]
        budget = random.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        total = sum(n * t for n, t in zip(lengths, take, strict=True))
        floor = [c * budget // sum(n * k for n, k in zip(lengths, counts, strict=True)) for c in counts]
        best = max(s for xs in itertools.product(*[range(f, c + 1) for f, c in zip(floor, counts, strict=True)]) if (s := sum(n * x for n, x in zip(lengths, xs, strict=True))) <= budget)
        assert total == best


def share(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    """Shares again and again what is above the caps."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, target = budget * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        unit = left / sum(w[i] for i in free)
        full = {i for i in free if unit * w[i] >= most * sizes[i]}
        for i in full or free:
            target[i] = most * sizes[i] if full else unit * w[i]
        left -= sum(target[i] for i in full)
        free = free - full if full else set()
    return target


def test_targets_equal_repeated_sharing(spark):
    random.seed(11)
    for n in (0, 1, 2, 7, 40):
        sizes = [random.choice([0, 1, 5, 100, 10_000]) for _ in range(n)]
        rows = spark.createDataFrame([(f"s{i:03}", x) for i, x in enumerate(sizes)], "sid string, source_size long")
        got = {r.sid: r.target for r in mixing.targets(rows).collect()}
        assert [got[k] for k in sorted(got)] == pytest.approx(share(sizes))


def test_mixture_of_equal_rows_and_clashing_names(spark):
    rows = [(None, "a b c", "x", 1), *[(None, "a b", "x", 2)] * 7, (3, "one two three four five", "y", 3), (3, "one two three four six", "y", 4), *[(i, "w " * i, "z", i) for i in range(4, 40)]]
    names = ["doc_id", "text", "source", "size", "copies", "target", "taken", "source_size", "__i", "rank", "sid", "whole", "more"]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[3]}" for c in names[4:]]) for r in rows], "doc_id long, text string, source string, size long, " + ", ".join(f"{c} string" for c in names[4:]))
    planned, mixed = mixing.plan(docs).collect(), mixing.mix(docs).collect()
    assert len(planned) == len(rows) and sorted(mixing.plan(docs.repartition(3)).collect(), key=str) == sorted(planned, key=str)
    by = {r.source_size: r.target for r in planned}
    for size, target in by.items():
        took = sum(r.taken for r in planned if r.source_size == size)
        assert target - 40 < took <= target
    assert len(mixed) == sum(r.copies for r in planned)
    assert all(r[c] == f"{c}{r['size']}" for r in mixed for c in names[4:]) and docs.columns == mixing.mix(docs).columns
    sizes = collections.Counter(len(r.text.split()) for r in mixed)
    assert sizes == collections.Counter(r.size for r in planned for _ in range(r.copies))
    ones = spark.createDataFrame([(None, "a b")] * 9, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert sorted(r.copies for r in mixing.plan(ones).collect()) == [1] * 5 + [2] * 4
    assert mixing.mix(ones).count() == 13


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = [sorted(tuple(r) for r in mixing.plan(x).collect()) for x in (docs, docs.repartition(7))]
    assert a == b
    text = {r.doc_id: r for r in docs.collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for doc_id, size, source_size, t, took, copies in a:
        source = text[doc_id].source
        assert size == len(WORD.findall(text[doc_id].text)) and took == size * copies and copies <= 2
        sizes[source] += size
        taken[source] += took
        target[source] = (source_size, t)
    names = sorted(sizes)
    assert [target[n] for n in names] == [(sizes[n], pytest.approx(x)) for n, x in zip(names, share([sizes[n] for n in names]), strict=True)]
    assert sum(t for _, t in target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[n] - target[n][1]) <= 50 for n in names)
    assert mixing.mix(docs).groupBy("source").agg(F.sum(mixing.n_words()).alias("n")).where("n is null").count() == 0


def test_media_round_trip(spark):
    for text in ("", "é" * 288, "x" * 576, "y" * 577, "z" * 5000):
        data = text.encode()
        payload = media.pad(data)
        assert len(payload) % 576 == 0 < len(payload) and media.decode_png(media.encode_png(payload)).tobytes() == payload
    got = {r.doc_id: r for r in queries.op5_media(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = r.text.encode()
        payload = data + b"\xff" * (-len(data) % 576)
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_sequences_keep_positions_and_captions(spark):
    items = media.parse('<p>one<p>two <img src="media:AB" alt="x">three<figure><img src="media:cd"><figcaption>c &amp; d</figcaption></figure><script>no</script>')
    assert [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [("text", "one", None), ("text", "two", None), ("media", "ab", "x"), ("text", "three", None), ("media", "cd", "c & d")]
    seqs = media.sequences(spark.createDataFrame([(1, '<img src="media:gone">'), (None, None)], "page_id long, html string"))
    assert [(r.page_id, r.position, r.feature) for r in media.resolve(seqs, media.measure(media.store(empty(spark)))).collect()] == [(1, 0, None)]


def test_sequences_of_pages_are_put_back_with_their_media(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seqs = media.sequences(pages)
    for r, p in zip(seqs.orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        assert [i["text"] for i in r["items"] if i["kind"] == "text"] == [x["text"] for x in media.parse(p.html)] and len(r["items"]) > 3
    texts = spark.createDataFrame([("first",), ("second",), ("first",)], "text string")
    found = media.measure(media.store(texts))
    a, b = (hashlib.sha256(media.pad(t)).hexdigest() for t in (b"first", b"second"))
    html = f'<p>one</p><figure><img src="media:{a}"><figcaption>A</figcaption></figure>two<img src="media:{b}" alt="B"><img src="media:{"0" * 64}"><p>three'
    docs = spark.createDataFrame([(1, html), (1, html), (None, f'<img src="media:{a}">'), (2, None)], "page_id long, html string")
    want = [(0, "text", "one", None, None), (1, "media", None, "A", a), (2, "text", "two", None, None), (3, "media", None, "B", b), (4, "media", None, None, None), (5, "text", "three", None, None)]
    for hot in (1, 100_000):
        monkeypatch.setattr(scratch, "HOT_ROWS", hot)
        got = media.assemble(media.sequences(docs), found).collect()
        items = [[(i.position, i.kind, i.text, i.caption, i.media and i.media.payload_sha256) for i in r["items"]] for r in sorted(got, key=lambda r: (r.page_id or 0, len(r["items"])))]
        assert items == [[(0, "media", None, None, a)], want, want, []]
        refs = media.resolve(media.sequences(docs), found).collect()
        assert sorted((r.page_id or 0, r.position, r.caption or "", r.payload_sha256 or "") for r in refs) == sorted([(0, 0, "", a)] + [(1, p, c or "", d or "") for p, k, _, c, d in want if k == "media"] * 2)


@pytest.mark.parametrize("limit", [3000, 20_000, 10**9])
def test_shards_equal_their_sql(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.octet_length("text") <= limit)
    con = connect(SF)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE strlen(text) <= {limit}")
    same(sharding.shard(docs.select("doc_id", "text"), limit).drop("text").toPandas(), con.sql(queries.op7_sql(limit)).df())


def test_shards_keep_clashing_columns_and_part_null_ids(spark):
    names = ["doc_id", "text", "__h", "__bytes", "__total", "__cell", "__depth", "__prefix", "__docs", "cell", "_0", "shard_note"]
    rows = [(None, f"text {i}", *[f"{c}{i}" for c in names[2:]]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:])).withColumn("shard_depth", F.lit("gone"))
    out = sharding.shard(docs, 60)
    assert out.columns == [*names, *sharding._OUT]
    got = out.collect()
    assert sorted(tuple(r)[: len(names)] for r in got) == sorted(rows)
    assert len({(r.shard_depth, r.shard_prefix) for r in got}) > 5 and all(r.shard_bytes <= 60 for r in got)


def test_shards_are_written_one_folder_each(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = sharding.shard(docs, 20_000)
    sharding.write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()} == {(r.doc_id, f"{r.shard_depth}-{r.shard_prefix}-{r.shard_page}") for r in out.drop("text").collect()}
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert len(sizes) > 10 and all(r.b <= 20_000 or r.n == 1 for r in sizes)


def test_overflow_pages_hold_the_limit(spark):
    docs = spark.createDataFrame([(1, "x" * n) for n in [10] * 30 + [60] * 3 + [500]], "doc_id long, text string")
    pages = sharding.shard(docs, 100).groupBy("shard_page").agg(F.sum(F.length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert sum(p.n for p in pages) == 34 and all(p.b <= 100 or p.n == 1 for p in pages)


def plain_lines(rows, min_chars=40, min_docs=5):
    """Kept texts of (id, text) rows, by brute force."""
    holders = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(-(2**63) if i is None else i)
    gone = lambda i, line: len(holders[key(line)]) >= min_docs and max(holders[key(line)]) != (-(2**63) if i is None else i) if key(line) in holders else False
    return sorted((i or 0, "\n".join(x for x in (text or "").split("\n") if not gone(i, x))) for i, text in rows)


@pytest.mark.parametrize("held", [2, 10_000])
def test_hot_lines_null_ids_and_small_ranges(spark, monkeypatch, held):
    random.seed(12)
    lines = [f"line number {k} is long enough to be held as a key" for k in range(6)]
    rows = [(random.choice([None, *range(40)]), "\n".join(random.choice([random.choice(lines), random.choice(lines).upper(), f"own {i}"]) for _ in range(3)) + f"\n{i}") for i in range(160)]
    rows += rows[:5] + [(None, lines[0])] * 3 + [(77, lines[5]), (78, None), (79, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("txt", F.lit("x")).withColumn("dropped", F.lit(1))
    monkeypatch.setattr(line_dedup._stream, "__defaults__", (held,))
    for ids in (10, 2_000_000):
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", ids)
        got = line_dedup.line_dedup(docs).collect()
        assert sorted((r.doc_id or 0, r.kept_text) for r in got) == plain_lines(rows)
        assert all(r.n_lines - r.n_dropped == r.kept_text.count("\n") + 1 or not r.kept_text for r in got)


def test_lines_of_odd_documents(spark):
    got = {r.doc_id: r for r in line_dedup.line_dedup(odd_docs(spark)).collect()}
    assert (got[1].n_lines, got[1].kept_text) == (1, "") and got[16].n_dropped == 0 and all(got[i].n_dropped == 1 and got[i].kept_text == f"own {i}" for i in range(10, 16))
    assert list(np.unpackbits(np.frombuffer(zlib.decompress(got[10].keep_bitmap), np.uint8))[:2]) == [0, 1]


def test_backoff_shards_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = backoff.stupid_backoff(docs), backoff.stupid_backoff(docs, block_bytes=50_000, shard_grams=20_000)
    a, b = ({r.doc_id: r.log_score for r in x.collect()} for x in (one, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_backoff_of_null_ids_only(spark):
    texts = ["one two three"] * 2 + ["four", "", None, "two three"]
    got = backoff.stupid_backoff(spark.createDataFrame([(None, t, 1) for t in texts], "doc_id long, text string, block int")).collect()
    ln, n = math.log, 9
    want = [(3, ln(2 / n) + ln(2 / 2) + ln(2 / 2))] * 2 + [(1, ln(1 / n)), (0, None), (0, None), (2, ln(3 / n) + ln(3 / 3))]
    assert all(r.doc_id is None for r in got)
    assert sorted((r.n_words, r.log_score or 0.0) for r in got) == [(k, pytest.approx(x or 0.0)) for k, x in sorted(want, key=lambda x: (x[0], x[1] or 0.0))]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, really.</div><aside>Side story, long enough, with commas.</aside>
<article><h1>Head &amp; line</h1><p>First   <b>para</b>graph,<br>two &lt;lines&gt;.<p>Second &eacute;.<ul><li>one<li>two</ul><div class="ad">Buy now, please.</div>
<form>Name <input name=x><button>Go</button></form><section id="comments"><p>Reader says, hello.</p></section></article><script>var a="<p>no</p>";</script><footer>&copy; all rights.</footer></body></html>"""


def test_main_text(spark):
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst paragraph, two <lines>.\n\nSecond é.\n\none\n\ntwo"
    plain = PAGE.replace("<article>", "<div class=story>").replace("</article>", "</div>")
    assert html_extract.main_text(plain).startswith("Head & line\n\nFirst paragraph")
    assert html_extract.main_text(None) == html_extract.main_text("<nav>x</nav>") == ""


def test_path_scores_equal_plain_ratios():
    page = html_extract._Page("<body><h2>One, two</h2><p>Three, four. Five!</p><div><p>Six <a href=x>seven</a></p></div><p>Eight. Nine, ten</p></body>")
    texts = [" ".join("".join(x for _, x, _ in parts).split()) for _, parts in page.blocks]
    linked = [sum(len(x.strip()) for _, x, link in parts if link) for _, parts in page.blocks]
    assert texts == ["One, two", "Three, four. Five!", "Six seven", "Eight. Nine, ten"] and linked == [0, 0, 5, 0]
    got, share_ = html_extract.scores([p for p, _ in page.blocks], texts, linked)
    mean = lambda of: [of[0], (of[1] + of[3]) / 2, of[2], (of[1] + of[3]) / 2]  # noqa: E731  the paragraphs of body share a path
    length, points = mean([len(t) for t in texts]), mean([sum(c in ".,!" for c in t) for t in texts])
    smooth = lambda v: [sum(math.exp(-((i - j) ** 2) / 2) * v[j] for j in range(4) if abs(i - j) <= 2) / sum(math.exp(-((i - j) ** 2) / 2) for j in range(4) if abs(i - j) <= 2) for i in range(4)]
    want = [math.sqrt(x * (0.1 + q)) * (1 - s) for x, q, s in zip(smooth(length), smooth(points), [0, 0, 5 / 9, 0], strict=True)]
    assert got == pytest.approx(want) and share_ == pytest.approx([0, 0, 5 / 9, 0])


def test_broken_and_deep_pages():
    story = "<p>Long story, with commas, and don't stop.</p>" * 5
    whole = "\n\n".join(["Long story, with commas, and don't stop."] * 5)
    side = '<div class="sidebar"><p>Read this too, please.</p></div>'
    for name in ("has-sidebar", "search", "related", "sidebar"):  # a word on what holds the page
        assert html_extract.main_text(f'<body><div id="page" class="{name}"><nav>x</nav>{story}</div>{side}</body>') == whole
        assert html_extract.main_text(f'<body><div class="{name}"><article>{story}</article></div>{side * 30}</body>') == whole
    assert html_extract.main_text(f'<body><div>{story}</div><div id="comments">{story * 9}</div></body>') == whole
    assert html_extract.main_text("<article><p data-x=it's>One don't two.</p><p title='a>b' class=>it's</p></article>") == "One don't two.\n\nit's"
    assert html_extract.main_text("<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>Body, here.</p></article>") == "Head\n\nBody, here."
    assert html_extract.main_text("<p>a < b &amp; c<p>tail <b") == "a < b & c\n\ntail"
    assert len(html_extract.main_text("<div>a" * 100_000)) == 3 * 100_000 - 2
    for broken in ("<b><table>" + "<i>" * 50_000 + "</b>" * 50_000, "<a " + 'x="' * 50_000, "<p " * 50_000, "<" * 50_000, "<!--" * 50_000, "<script>" * 50_000):
        html_extract.main_text(broken)


def test_scores_choose_the_content_whatever_the_mark():
    paragraph = "Long sentence, with a comma. " * 14
    story = "<h1>Head</h1>" + "".join(f"<p>{i} {paragraph}</p>" for i in range(5))
    whole = ["Head", *[f"{i} {paragraph}".strip() for i in range(5)]]
    teasers = "".join(f'<article class="{c}"><h3>More {i}</h3><p>A short teaser, number {i}.</p></article>' for i, c in enumerate(["card", "related", "card"]))
    assert html_extract.main_text(f"<body><div class=story>{story}</div><div>{teasers}</div></body>") == "\n\n".join(whole)
    assert html_extract.main_text(f"<body><main><div>{story}</div></main><div>{teasers}</div></body>") == "\n\n".join(whole)
    items = [f"item {i} of twenty letters"[:20] for i in range(6)]
    mixed = f"<p>0 {paragraph}</p><ul>{''.join(f'<li>{t}' for t in items)}</ul><p>1 {paragraph}</p>"
    for tag in ("div", "article"):
        assert html_extract.main_text(f"<body><{tag}>{mixed}</{tag}></body>") == "\n\n".join([whole[1], *items, whole[2]])
    plain = PAGE.replace("<article>", "<div class=story>").replace("</article>", "</div>")
    assert html_extract.main_text(plain) == html_extract.main_text(PAGE)
    assert html_extract.main_text("<ul><li><a href=/a>only</a><li><a href=/b>links</a></ul>") == "only\n\nlinks"


def test_url_edges(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = [None, "", "no mark", "http://", "HTTPS://A.Example.COM/en/7x?y=/en/1", "http://com/en/", "http://xcom/en/1", "http://example.com:80/en/7", "http://b.example.net/de/8#f", "http://org?/es/", "http://a.org/es/"]
    got = [(r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()]
    assert got == [(None, "allow")] * 4 + [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block")]


@pytest.mark.parametrize("name", ["op9_url_filter", "op10_near_dedup"])
def test_hot_keys_meet_by_broadcast(spark, monkeypatch, name):
    for module in (near_dedup, url_filter):
        monkeypatch.setattr(module, "HOT_ROWS", 1)
    same(queries.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(queries.ORACLE[name]).df())


def test_pipeline_keeps_clean_documents_and_repeats_what_the_mix_takes_twice(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    every = {r.doc_id for r in docs.collect()}
    assert kept[2] <= kept[1] <= kept[0] <= every
    judged = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    first = {r.doc_id for r in near_dedup.near_duplicates(docs.where(F.col("doc_id").isin(list(judged)))).where("kept").collect()}
    leaks = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept == [judged, first, first - leaks]
    final = corpus_pipeline.run(spark, SF)
    counts = collections.Counter(r.doc_id for r in final.collect())
    plan = {r.doc_id: r.copies for r in mixing.plan(docs.where(F.col("doc_id").isin(list(kept[2])))).collect() if r.copies}
    assert counts == plan


def test_signing_holds_a_slice_and_not_its_batch(spark):
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(400)) for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["doc_id", "mark", "text"])
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in near_dedup._sign(iter([batch]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 32e6  # six megabytes of text
    finally:
        tracemalloc.stop()
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with scratch.batch_bytes(spark, 1 << 20):
        rows = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
        got = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"]) for x in batches), "n long").collect()
    assert len(got) > 4 and max(r.n for r in got) < 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
