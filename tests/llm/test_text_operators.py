"""Operators on single documents, against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sheerlight.llm import dac, decontaminate, hilbert, labelled, merkle, mixing, quality, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "extra") for i, t, s in rows], DDL)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    rows = [(1, "One line here.\nAnother line there.", "a"), (2, None, "a"), (3, "", None), (4, long, "b"), (5, "One line here.\nAnother line there.", "b"), (5, "One line here.\nAnother line there.", "b"), (None, "no id at all", "c"), (7, " \n\t ", "c"), (8, "ÀÉ 日本語 \U0001f600", "")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def words(t):
    out, w = [], ""
    for c in t or "":
        if c in " \t\n\x0b\x0c\r":
            out += [w] if w else []
            w = ""
        else:
            w += c
    return out + ([w] if w else [])


# ------------------------------------------------------------------------------------------------ token counts


@pytest.mark.parametrize(("chunk", "overlap"), [(16384, 512), (256, 32), (64, 8)])
def test_spliced_counts_are_those_of_whole_texts(spark, chunk, overlap):
    c = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert c.stable
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "a" * 3000, "▁▁ x ▁y" * 300, "日本語" * 500, "x  \n y<s>é" * 300, " " * 900 + "b", "".join(rng.choice("ab é\n日") for _ in range(4000))]
    assert c.counts(texts, chunk, overlap) == [len(x) for x in c.model.encode(texts)]


def test_token_counts(spark, odd, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, model).collect())
    c = token_counts.counter(model).model
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(c.encode(r.text or "")), n > 4096) for r in odd.collect())
    assert got == want and token_counts.token_counts(none, model).count() == 0


# ------------------------------------------------------------------------------------------------ addressable codes


@pytest.mark.parametrize("seed", range(6))
def test_codes_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 7, 513, 5000, 70_000][seed]
    ids = np.minimum(rng.geometric(0.001, n) * rng.choice([1, 40], n), [2**32 - 1, 300, 49_407, 2**20, 60_000, 49_407][seed]).astype(np.uint32)
    part = dac.Part(dac.encode_part([3], np.array([0, n]), ids))
    assert (part.all() == ids).all() and part.doc_ids.tolist() == [3]
    at = rng.integers(0, n, 500) if n else np.zeros(0, int)
    assert (part.get(at) == ids[at]).all()
    assert sum(part.widths) >= int(ids.max(initial=0)).bit_length()


def test_encoder_gives_the_librarys_ids(spark):
    e = dac.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.by_piece
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["<|endoftext|> x<|startoftext|>a", "İ ſ don't é   q\x1c\x85 w\t\tz", "한국어 DON'T'S 12 3½ ²", "", " \n ", "a" * 2000, "ªº µß÷× naïve—x"]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in dac.token_files(odd, path).collect()]
    t, at, want = dac.encoder(path).tokenizer, 0, []
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want and dac.token_files(none, path).count() == 0


# ------------------------------------------------------------------------------------------------ fingerprints


def test_edit_probe(spark, none):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("fingerprint"))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in merkle.edit_probe(df).collect()}
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(got[i].fingerprint)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert all(len(x) == 1 for x in by_text.values()) and len({y for x in by_text.values() for y in x}) == len(by_text)
    assert sum(r.near_edited for r in got.values()) / len(got) > 0.55 > 0.05 > sum(r.near_next for r in got.values()) / len(got)
    assert merkle.edit_probe(none).count() == 0


def test_edit_probe_of_odd_rows(odd):
    rows = merkle.edit_probe(odd).collect()
    assert len(rows) == 9
    empty = [r for r in rows if r.n_chars == 0]
    assert len(empty) == 2 and empty[0].fingerprint == empty[1].fingerprint
    same = [r for r in rows if r.doc_id in (1, 5)]
    assert len({r.fingerprint for r in same}) == 1


def test_edits_are_located(spark):
    lines = [f"line number {i} says something of its own" for i in range(40)]
    edited = [*lines]
    edited[17] = "another text entirely"
    df = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = df.select(merkle.locate_edits(F.col("b"), F.col("a")).alias("x"), merkle.locate_edits(F.col("a"), F.col("a")).alias("y"), merkle.likeness(F.col("a"), F.col("b")).alias("z")).first()
    assert row.x == [17] and row.y == [] and 0.9 < row.z < 1


# ------------------------------------------------------------------------------------------------ decontamination


ITEM = "Yesterday Alice bought 3 apples and 12 kg of flour from Bob then Alice sold 5 of them to Carol for 12 dollars"


@pytest.mark.parametrize(
    ("text", "found", "other"),
    [
        (ITEM, True, False),
        (f"Noise comes first. {ITEM} and noise after", True, False),
        (ITEM.upper().lower(), True, False),
        ("Yesterday Maria bought 8 apples and 40 kg of flour from Peter then Maria sold 9 of them to Anna for 40 dollars", True, True),
        ("Yesterday Maria bought 8 apples", False, False),
        ("one two three four five six seven eight nine", False, False),
        ("", False, False),
    ],
)
def test_templates(text, found, other):
    index = decontaminate.Index([(7, ITEM)])
    got = decontaminate.judge(decontaminate.tokens_of([text]), index, 1)[0]
    assert bool(got) == found and (not found or got[0][2] == other)


def test_contradicting_slots_cut_a_run():
    item = "then Alice met Bob near the old red barn and after that Alice met Bob near the new barn"
    t = decontaminate.tokens_of(["so then Maria met Peter near the old red barn and after that Anna met Peter near the new barn"])
    got = decontaminate.judge(t, decontaminate.Index([(1, item)]), 1)[0]
    whole = decontaminate.judge(decontaminate.tokens_of([f"so {item}"]), decontaminate.Index([(1, item)]), 1)[0]
    assert whole and (not got or got[0][1] < whole[0][1])


def test_leaks_in_documents(spark, odd, none):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = {r.item_id: plain(r.text) for r in b.collect()}
    want = {r.doc_id for r in d.collect() if any(x in plain(r.text) for x in items.values())}
    got = {r.doc_id: r for r in decontaminate.find_leaks(d, b).collect()}
    assert want and want <= {i for i, r in got.items() if r.contaminated} and len(got) == d.count()
    blocks = {r.doc_id: r["items"] for r in decontaminate.find_leaks(d, b, block=200).collect()}
    assert blocks == {i: r["items"] for i, r in got.items()}
    kept = {r.doc_id for r in decontaminate.drop_leaks(d, b, block=200).collect()}
    assert kept == {i for i, r in got.items() if not r.contaminated}
    assert not any(r.contaminated for r in decontaminate.find_leaks(odd, b).collect()) and decontaminate.drop_leaks(odd, b).count() == 9
    assert decontaminate.find_leaks(none, b).count() == 0 and decontaminate.drop_leaks(d, b.limit(0)).count() == d.count()
    nulls = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.find_leaks(d, nulls).collect())


# ------------------------------------------------------------------------------------------------ sharding


def test_curve_visits_neighbours():
    c = hilbert.curve(3, 3)
    cells = sorted(range(512), key=lambda p: c[p])
    xyz = [(p >> 6, p >> 3 & 7, p & 7) for p in cells]
    assert sorted(c) == list(range(512)) and all(sum(abs(a - b) for a, b in zip(u, v, strict=True)) == 1 for u, v in zip(xyz, xyz[1:], strict=False))


@pytest.mark.parametrize("which", ["odd", "none", "table"])
def test_shards(spark, odd, none, which):
    df = {"odd": odd, "none": none, "table": spark.read.parquet(f"{SF}/documents.parquet")}[which]
    rows = hilbert.shard_report(df).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == df.count() and set(slots) <= set(range(16))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_shard_files_can_be_skipped(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hilbert.write_shards(df, str(tmp_path / "x"))
    spans = spark.read.parquet(str(tmp_path / "x")).groupBy(F.input_file_name()).agg(F.min("source").alias("lo"), F.max("source").alias("hi")).collect()
    skipped = sum(not r.lo <= "src7" <= r.hi for r in spans)
    assert len(spans) == 16 and skipped >= 5


# ------------------------------------------------------------------------------------------------ mixing


def shares(sizes):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if got[s] > 2 * sizes[s]]
        if not above:
            return got | fixed
        fixed |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("which", ["odd", "none", "table"])
def test_mix(spark, odd, none, which):
    df = {"odd": odd, "none": none, "table": spark.read.parquet("/root/testdata/sf0.01/documents.parquet")}[which]
    rows = mixing.mix(df).collect()
    given = df.collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in rows) == Counter((r.doc_id, len(words(r.text)), r.source) for r in given)
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r.target) <= most[r.source] / 2 + 1e-6
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows))
    copies = Counter((r.doc_id, r.text) for r in mixing.take_mix(df).collect())
    assert sum(copies.values()) == sum(r.copies for r in rows) and mixing.take_mix(df).columns == df.columns


def test_better_documents_are_likelier(spark):
    rows = [(i, ("good words are here " if i % 2 else "#!%& 12 ** 33 ") * 5, "s") for i in range(2000)] + [(5000 + i, "x " * 20, "t") for i in range(50)] + [(9000 + i, "y " * 20, "u") for i in range(2000)]
    weighed = docs(spark, rows).withColumn("weight", F.when(F.col("doc_id") % 2 == 1, 0.9).otherwise(0.1))
    taken = [(r.doc_id % 2, r.copies) for r in mixing.mix(weighed, share=0.3, weight="weight").collect() if r.source == "s"]
    good, bad = (sum(c for k, c in taken if k == p) for p in (1, 0))
    assert good > 2 * bad > 0


# ------------------------------------------------------------------------------------------------ classifiers


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net, x = toxicity.Network(), rng.standard_normal((7, 2 * toxicity.WIDTH)).astype(np.float32)
    size = np.array([toxicity.WINDOW, toxicity.WINDOW, 3, 10, 0])
    index = rng.integers(0, 7, (5, toxicity.WINDOW))
    for k, n in enumerate(size):
        index[k, n:] = -1
    y, w = np.array([1, 0, 1, 0, 1], np.float32), np.ones(5, np.float32)
    grad, dx, _ = net.gradients(x, index, size, y, w)
    for a, g in [*((net.p[k], grad[k]) for k in ("wx", "bx", "wh", "va", "vo", "bo")), (x, dx)]:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in a.shape)
            old, losses = a[i], []
            for step in (0.01, -0.01):
                a[i] = old + step
                losses.append(net.gradients(x, index, size, y, w)[2])
            a[i] = old
            assert (losses[0] - losses[1]) / 0.02 == pytest.approx(float(g[i]), abs=2e-3)


def test_windows_cover_every_word():
    count = np.array([0, 1, 23, 24, 25, 40, 41, 500])
    doc, first, size = toxicity.windows(count)
    base = np.cumsum(count) - count
    for d, n in enumerate(count):
        seen = np.zeros(n, bool)
        for k in np.flatnonzero(doc == d):
            seen[first[k] - base[d] : first[k] - base[d] + size[k]] = True
        assert seen.all() and (doc == d).any()


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    plain = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    rows = []
    for k in range(900):
        t = text(rng.choice([6, 30, 120, 300]))
        y = k % 4 == 0
        if y:
            for _ in range(1 + len(t) // 40):
                t.insert(rng.randrange(len(t) + 1), rng.choice(["stupid", "IDIOT!", "moron,", "qwxz" + rng.choice(plain), "vejk" + rng.choice(plain)]))
        rows.append((k, " ".join(t), int(y)))
    return rows


def test_toxicity_is_found(planted):
    fit, held = planted[:600], planted[600:]
    net = toxicity.train([t for _, t, _ in fit], np.array([y for *_, y in fit]))
    s = net.scores(toxicity._vocabulary([t for _, t, _ in held]))
    y = np.array([y for *_, y in held]) == 1
    assert (s[y] >= toxicity.CUT).mean() > 0.9 and (s[~y] >= toxicity.CUT).mean() < 0.05
    again = toxicity.train([t for _, t, _ in fit], np.array([y for *_, y in fit])).scores(toxicity._vocabulary([t for _, t, _ in held]))
    assert np.allclose(s, again)


def test_toxicity_on_tables(spark, planted, odd, none):
    df = spark.createDataFrame(planted, "doc_id long, text string, toxic int")
    net = toxicity.fit(df.select("text", F.col("toxic").alias("label")))
    rows = toxicity.score(odd, net).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert toxicity.score(none, net).count() == 0 and toxicity.drop_toxic(none, net).columns == none.columns
    clean = toxicity.drop_toxic(df, net)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in toxicity.score(df, net).collect() if not r.predicted} and clean.columns == df.columns
    untrained = toxicity.fit(df.filter("toxic = 0").select("text", F.col("toxic").alias("label")))
    assert {r.score for r in toxicity.score(odd, untrained).collect()} == {0.0}


def test_quality(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(labelled.sample(df, labels, "quality", labelled.fold("doc_id", 3) != 1, quality.SAMPLE))
    rows = quality.score(df, model).join(labels.filter(labelled.fold("doc_id", 3) == 1), "doc_id").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(rows) > 80 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect()) and quality.score(none, model).count() == 0
    empty = [r.score for r in quality.score(odd.filter("doc_id = 2 or doc_id = 3"), model).collect()]
    assert empty[0] == empty[1] == pytest.approx(float(model.labels.mean()))


def test_votes_are_those_of_a_plain_search():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.02, (300, quality.TERMS)).astype(np.float32)
    labels = (rng.random(300) < 0.4).astype(float)
    m = quality.fit_counts(counts, labels)
    got = m.scores(counts[:40])
    for k in range(40):
        like = np.maximum(m.vectors @ m.project(counts[k : k + 1])[0], 0)
        near = np.argsort(-like)[: quality.NEIGHBOURS]
        v = like[near].astype(float) ** quality.SHARPNESS
        assert got[k] == pytest.approx(((v * labels[near]).sum() + quality.PRIOR_VOTES * labels.mean()) / (v.sum() + quality.PRIOR_VOTES), abs=1e-5)


def test_folds(spark):
    rows = spark.range(50).select("id", labelled.fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


# ------------------------------------------------------------------------------------------------ exact copies of items


@pytest.mark.parametrize("text", [ITEM.lower(), ITEM.upper(), f"12 {ITEM.lower()}", ITEM.lower().replace("12", "40").replace(" 3 ", " 9 ")])
def test_copies_in_any_case(text):
    assert decontaminate.judge(decontaminate.tokens_of([text]), decontaminate.Index([(7, ITEM)]), 1)[0]


@pytest.mark.parametrize(("item", "text"), [("Which metal melts at room temperature?", "ask which metal melts at room temperature"), ("12 + 34 = 46", "so 12 + 34 = 46 holds"), ("1 5 9 12 44 87 3 2 10 77 31", "figures 1 5 9 12 44 87 3 2 10 77 31 end"), ("The Great Old Red Barn Of Peter And Maria Smith", "in The Great Old Red Barn Of Peter And Maria Smith")])
def test_copies_of_dense_and_short_items(item, text):
    index = decontaminate.Index([(7, item)])
    assert decontaminate.judge(decontaminate.tokens_of([text]), index, 1)[0]
    assert not decontaminate.judge(decontaminate.tokens_of(["figures 1 6 9 13 44 88 3 4 10 78 31 and 12 + 35 = 47"]), index, 1)[0]


# ------------------------------------------------------------------------------------------------ borders and odd rows


def test_a_mix_takes_equal_rows_one_by_one(spark):
    rows = [(1, "ten words are in this very text as it stands", "s")] * 6 + [(k, "other words of the second source " * 20, "a") for k in range(10)]
    df = docs(spark, rows)
    plan = mixing.mix(df, share=0.1).collect()
    assert sum(r.copies for r in plan if r.source == "s") % 6  # the run ends among them
    assert Counter((r.doc_id, r.source) for r in mixing.take_mix(df, share=0.1).collect()) == Counter((r.doc_id, r.source) for r in plan for _ in range(r.copies))
    third = df.withColumn("n_chars", F.monotonically_increasing_id()).withColumn("w", F.lit(0.5))
    got = mixing.take_mix(third, share=0.1, weight="w")
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in mixing.mix(third, share=0.1, weight="w").collect() for _ in range(r.copies)) and "w" not in got.columns


def test_text_metadata_with_a_common_beginning(spark, tmp_path):
    rows = [(k, "x" * (k % 7), f"https://crawl.example/{k % 16:02d}") for k in range(1600)]
    df = docs(spark, rows)
    bins = hilbert._text_bins(df, "source", 4, "b")[0].collect()
    assert len({r.b for r in bins}) == 16 and [r.b for r in sorted(bins, key=lambda r: r._value)] == list(range(16))
    hilbert.write_shards(df, str(tmp_path / "y"), dims=("source",))
    spans = spark.read.parquet(str(tmp_path / "y")).groupBy(F.input_file_name()).agg(F.countDistinct("source").alias("n")).collect()
    assert all(r.n <= 3 for r in spans)


@pytest.mark.parametrize(("item", "text"), [
    ("A shop sold twenty five red apples and thirteen green pears on one long day of rain", "a shop sold 31 red apples and 7 green pears on 2 long day of rain"),
    ("Bake the loaf for ninety minutes at one hundred degrees and then let it rest well", "bake the loaf for 45 minutes at 30 degrees and then let it rest well"),
    ("\U00010400\U00010401 \U00010402 \U00010403 \U00010404 \U00010405 \U00010406 \U00010407 \U00010408", "so \U00010428\U00010429 \U0001042a \U0001042b \U0001042c \U0001042d \U0001042e \U0001042f \U00010430"),
    ("这是一个没有空格的很长的句子用来检查", "前面还有这是一个没有空格的很长的句子用来检查后面也有"),
])
def test_numbers_in_words_and_other_scripts(item, text):
    index = decontaminate.Index([(7, item)])
    assert decontaminate.judge(decontaminate.tokens_of([text]), index, 1)[0]


def test_repeated_ids_among_labelled_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = labelled.sample(df, labels, "toxic", F.lit(True), {0: 2, 1: 2}).collect()
    assert len(got) <= 4 and sum(r.label for r in got) == 1 and {r.weight for r in got if r.label == 0} == {1.5}


def test_an_inserted_word_moves_few_leaves(spark):
    line = " ".join(f"{w}{k}" for k, w in enumerate(["and", "sea", "cat", "run", "tree", "bell", "map", "one"] * 30))
    df = spark.createDataFrame([(line, "new " + line)], "a string, b string")
    r = df.select(merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("x")).first()
    assert 0.9 < r.x < 1


def test_many_sources_and_values(spark, odd, monkeypatch):
    """Beyond what is broadcast, tables of sources and of values give the same results."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = [sorted(map(str, f(x).collect())) for f in (mixing.mix, hilbert.shard_report) for x in (df, odd)]
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 2)
    monkeypatch.setattr(hilbert, "MOST_BROADCAST", 2)
    assert [sorted(map(str, f(x).collect())) for f in (mixing.mix, hilbert.shard_report) for x in (df, odd)] == want
