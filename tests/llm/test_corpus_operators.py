"""Operators on whole corpora, against brute force, and the pipeline."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheerlight.llm import lines, ngram_join
from sheerlight.llm.common import release
from sheerlight.llm.graph import connected_components, paired_components

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = [40, 200, 120][seed]
    edges = [(k, k + 1) for k in range(n)] if seed == 2 else [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(0, k) for k in range(1, n, 7)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in rows} == {x: u.find(x) for x in u.up if x not in alone}


def test_rounds_give_back_what_they_leave(spark):
    """Plans and shuffles of past rounds don't pile up on the driver."""
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    release(spark)
    time.sleep(1)
    before = held.size()
    out = connected_components(spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    time.sleep(1)
    assert held.size() - before < 20  # of some 40 in all
    assert out.count() == 65


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    u = Union([i for i, _ in rows])
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets}


def variants(seed, n, words, edits):
    """Copies of some texts with a few words changed, from exact ones to those just beyond the border."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    bases = [[word() for _ in range(rng.choice(words))] for _ in range(4)]
    shared = [word() for _ in range(12)]
    rows = []
    for k in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(len(t))] = word()
        if k % 5 == 0:
            t = shared + [word() for _ in range(rng.choice(words))]
        rows.append((k, " ".join(t).title() if k % 7 == 0 else " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "n", "words", "edits"), [(0, 250, [60, 80, 100], 6), (1, 250, [5, 6, 7, 8, 12, 20], 2), (2, 120, [1, 2, 3, 4, 5], 2), (3, 200, [200, 230], 12)])
def test_jaccard_join(spark, seed, n, words, edits):
    rows = variants(seed, n, words, edits)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == linked(rows)


@pytest.mark.parametrize("hot", [2, 5, 20])
def test_jaccard_join_with_hot_shingles(spark, monkeypatch, hot):
    """However few sets make a shingle hot, the links are the same, also where only some packs know it."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PACK_TOKENS", 900)
    rows = variants(0, 250, [60, 80, 100], 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == linked(rows)


def test_jaccard_join_with_every_limit(spark):
    """Whatever parts light sets from heavy ones, the links are the same."""
    rows = variants(1, 200, [5, 6, 7, 8, 12, 20], 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cand = ngram_join.candidates(df)
    roots = []
    for limit in (0, 8, 64):
        entries = ngram_join.list_entries(cand, limit)
        found = ngram_join.candidate_components(entries, lambda x, y: ngram_join._may_link(x, y, 75), lambda p: ngram_join._verified(p, cand, 75), 3, ngram_join._told)
        groups = defaultdict(set)
        for r in found.collect():
            groups[r.root].add(r.node)
        roots.append(sorted(sorted(g) for g in groups.values()))
    assert roots[0] == roots[1] == roots[2] and roots[0]
    assert 0 <= ngram_join.light_limit(cand) <= ngram_join.LIGHT_MOST


def test_jaccard_join_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A B\tc"), (5, "A B\tc"), (6, "a b c d e f " * 3000), (7, "a b c d e f " * 3000 + "x"), (None, "a b c")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1, (5, 1, 4): 2, (6, 6, 6): 1, (7, 7, 6): 1, (None, 1, 4): 1})
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = variants(0, 120, [60, 80], 4)
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = ngram_join.drop_near_duplicates(df)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in linked(rows).values()} and kept.columns == df.columns
    twice = ngram_join.drop_near_duplicates(df.union(df))
    assert sorted(r.doc_id for r in twice.collect()) == sorted({c for _, c in linked(rows).values()})


# ------------------------------------------------------------------------------------------------ lines


def normal(line):
    return [re.sub("[0-9]", "0", w) for w in re.findall("[a-z0-9\u0080-\U0010ffff]+", line.lower())]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def expected_lines(rows):
    places = defaultdict(list)
    for i, t in sorted(rows):
        for no, line in enumerate((t or "").split("\n")):
            w = normal(line)
            if len(w) >= lines.MIN_WORDS:
                places[" ".join(w)].append((i, no))
    keys = list(places)
    sims = []
    for k in keys:
        b = k.encode()
        sims.append(int(lines.Lines(np.frombuffer(b, np.uint8), np.array([0, len(b)])).sim[0]))
    u = Union(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if sims[a] and sims[b] and (sims[a] ^ sims[b]).bit_count() <= lines.BITS_APART:
                most = max(len(keys[a]), len(keys[b]))
                if distance(keys[a], keys[b]) <= int(most * (1 - lines.SIMILARITY) + 1e-9):
                    u.join(a, b)
    groups = defaultdict(list)
    for k, key in enumerate(keys):
        groups[u.find(k)] += places[key]
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {i: (None if t is None else "\n".join(line for no, line in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t in rows}, len(gone)


def test_fuzzy_lines(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(rng.choice([3, 5, 9, 40]))) for _ in range(40)]
    rows = []
    for i in range(60):
        made = []
        for _ in range(8):
            w = rng.choice(base).split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = word()
            made.append((" ".join(w) + rng.choice(["", ".", " 12", "!"])).capitalize())
        rows.append((i, "\n".join(made)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort")]
    want, n = expected_lines(rows)
    got = lines.dedup_lines(spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, more string"))
    found = got.collect()
    assert {r.doc_id: r.text for r in found} == want and sum(r.n_dropped for r in found) == n > 100 and {r.more for r in found} == {"keep"}


def test_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(empty).count() == 0
    long = "\n".join(f"this is line number {i % 50} of a very long text" for i in range(20_000))
    rows = lines.dedup_lines(spark.createDataFrame([(1, long), (None, "words that stand here alone"), (2, "words that stand here alone")], "doc_id long, text string")).collect()
    got = {r.doc_id: r.text for r in rows}
    assert got[None] == "words that stand here alone" and got[2] == "" and len(got[1].split("\n")) == 1  # digits are one, and a second digit is one edit in 42 characters


def test_simhash_is_a_majority():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 30, dtype=np.uint64)
    got = lines.simhash(h, np.array([0, 11]))
    for k, part in enumerate((h[:11], h[11:])):
        bits = (part[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(part))


# ------------------------------------------------------------------------------------------------ pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter(r.shard for r in rows)
    assert rows and {r.doc_id for r in rows} <= ids and max(counts.values()) - min(counts.values()) <= 1


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


# ------------------------------------------------------------------------------------------------ lines, by edit similarity alone


def edited(rng, line):
    """A copy with up to as many edits as ``SIMILARITY`` allows."""
    out = list(line)
    for _ in range(rng.randint(1, int(len(line) * (1 - lines.SIMILARITY) + 1e-9))):
        k = rng.randrange(len(out))
        out[k : k + rng.choice([0, 1, 1])] = rng.choice(["", "q", "x", "u"])
    return "".join(out)


def test_near_lines_of_all_lengths_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows = []
    for k in range(400):
        line = " ".join(word() for _ in range(rng.choice([2, 4, 6, 8, 10, 20, 30, 100])))
        copy = edited(rng, line) if len(line) >= 7 else line
        a, b = " ".join(normal(line)), " ".join(normal(copy))
        if a and b and distance(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9):
            rows += [(2 * k, line), (2 * k + 1, copy)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.n_dropped for r in got if r.doc_id % 2)
    assert found >= 0.95 * len(rows) / 2 and not any(r.n_dropped for r in got if r.doc_id % 2 == 0) and len(rows) > 600


def test_nearness_is_exact():
    """The filter before it leaves no near pair out; the test itself is the edit distance's."""
    rng = random.Random(7)
    one, other = [], []
    for _ in range(600):
        letters = "abcdefgh é日\U0001f600"[: rng.choice([3, 8, 12])]
        line = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        edited = list(line)
        for _ in range(rng.randint(0, len(line) // 4 + 1)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        one.append(line)
        other.append("".join(edited))
    want = [distance(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9) for a, b in zip(one, other, strict=True)]
    assert 100 < sum(want) < 500
    assert [lines.near(a, b) for a, b in zip(one, other, strict=True)] == want
    may = lines._may_be_near(pa.array(one, pa.string()), pa.array(other, pa.string()))
    assert not (np.array(want) & ~may).any()
    words = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)) for _ in range(40)]
    assert not lines._may_be_near(pa.array(words[:20], pa.string()), pa.array(words[20:], pa.string())).any()


def test_places_of_a_shared_gram_leave_pairs_out():
    """Lines of like lengths that share an n-gram far from the same place are no candidates; lines shifted by their edits are."""
    key, chars = np.array([1, 1, 2, 2, 3, 3, 4], np.uint32), np.array([100, 100, 100, 110, 100, 118, 50])
    before = np.array([5, 60, 5, 15, 5, 5, 0])
    order = np.lexsort((chars, key))
    assert lines._company(key[order], chars[order], before[order]).tolist() == [False, False, True, True, False, False, False]
    many = np.full(5000, 9, np.uint32)
    assert lines._company(many, np.full(5000, 100), np.arange(5000) * 20).all()  # beyond the neighbours that are looked at, all stay
    n = np.array([1, 2, 4095, 70001, 10_000_019])
    assert (np.abs(lines._decoded(lines._coded(n)) - n) <= n / 2048 * (n >= 4096)).all()


def test_pairs_of_short_lists_are_made_where_they_meet_and_tested_once(spark, monkeypatch):
    """Pairs that the first search tells apart are not compared again; lists of any length give the same groups."""
    rng = random.Random(5)
    common = "the same twelve and more bytes "
    rows = [common + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(6)) for _ in range(40)]
    rows += [r[:-1] + "z" for r in rows[:10]]
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, text string")
    seen = []

    def tested(few):
        monkeypatch.setattr(lines, "FEW", few)
        monkeypatch.setattr(lines, "paired_components", lambda tied, few, many, may, verified, k=3: paired_components(tied, few, many, may, lambda p: seen.append(sorted(map(tuple, p.collect()))) or verified(p), k))
        groups = {r.hash: r.root for r in lines.line_groups(docs, "text").collect()}
        return groups, [p for s in seen for p in s]

    for few in (1, 8, 64):
        seen.clear()
        groups, pairs = tested(few)
        assert len(pairs) == len(set(pairs)) and Counter(groups.values()) == dict.fromkeys(groups.values(), 2) and len(groups) == 20


def test_common_grams_come_last_and_leave_no_line_without_keys():
    """Few lines that share only what is common have a key in common; near copies of lines that are mostly common still have, and so have lines with edits."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    usual = " ".join(word() for _ in range(8))
    apart = [f"{' '.join(word() for _ in range(20))} {usual} {' '.join(word() for _ in range(20))}" for _ in range(30)]
    plain = [" ".join(word() for _ in range(40)) for _ in range(30)]
    same = [f"{usual} {word()}" for _ in range(30)]
    whole = apart + same + plain + [line[:100] + "q" + line[101:200] + "x" + line[201:] for line in plain]
    data = "\n".join(whole).encode()
    x = lines.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]), sims=False)
    bare = f" {usual} ".encode()
    flat = lines.Lines(np.frombuffer(bare, np.uint8), np.array([0, len(bare)]), sims=False)
    counts = np.zeros(1 << lines.COUNTER_BITS, bool)
    counts[lines._counter(flat.grams(flat.fuzzy, lines.GRAM)[0] >> np.uint64(1))] = True
    sets = []
    for common in (None, np.packbits(counts, bitorder="little")):
        found = defaultdict(set)
        for key, owner in zip(*(v.tolist() for v in x.keys(np.arange(len(whole)), common)[:2]), strict=True):
            found[owner].add(key)
        sets.append(found)
    pairs = lambda found, lo, hi: sum(bool(found[i] & found[j]) for i in range(lo, hi) for j in range(lo, i))
    assert pairs(sets[0], 0, 30) > 300 and pairs(sets[1], 0, 30) < 30  # a bin may hold common ones only
    assert pairs(sets[1], 30, 60) == pairs(sets[0], 30, 60) == 435
    assert all(sets[1][60 + k] & sets[1][90 + k] for k in range(30))


def test_sketches_of_short_lines_lose_no_near_pair():
    """Chance pairs of short lines are left out before any text is fetched; edits change no more bits than they may."""
    rng = random.Random(9)
    one, other, k = [], [], []
    for _ in range(400):
        line = "".join(rng.choice("abcdeé日\U0001f600") for _ in range(rng.randint(7, 48)))
        n = rng.randint(0, int(len(line) * (1 - lines.SIMILARITY) + 1e-9))
        out = list(line)
        for _ in range(n):
            at = rng.randrange(len(out))
            out[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "日"])
        one.append(line)
        other.append("".join(out))
        k.append(n)
    data = "\n".join(one + other).encode()
    x = lines.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]), sims=False)
    sketch, i = x.sketches(np.arange(800)), np.arange(400)
    assert lines._alike(sketch, i, i + 400, np.array(k)).all()
    words = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)) for _ in range(100)]
    data = "\n".join(words).encode()
    sketch = lines.Lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]), sims=False).sketches(np.arange(100))
    assert lines._alike(sketch, i[:50], i[50:100], np.full(50, 6)).sum() == 0


def test_further_pairs_in_rounds_give_the_same_groups(spark, monkeypatch):
    """Pairs beyond one round's are tested in several, each once; without a task's memory of a line the groups are the same."""
    from sheerlight.llm import graph

    rng = random.Random(5)
    rows = ["the same twelve and more bytes " + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(6)) for _ in range(40)]
    rows += [r[:-1] + "z" for r in rows[:10]]
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, text string")
    want = {r.hash: r.root for r in lines.line_groups(docs, "text").collect()}
    monkeypatch.setattr(graph, "ROUND", 0)
    monkeypatch.setattr(graph, "LEAST_ROUND", 50)
    assert {r.hash: r.root for r in lines.line_groups(docs, "text").collect()} == want and len(want) == 20


def test_short_and_unspaced_lines(spark):
    han = "这是一个没有空格的很长的句子用来检查重复的行是否会被删除"
    rows = [(1, f"Read more\n{han}\n---\n"), (2, f"read more!\n{han}\n---\n"), (3, "x\n" + han.replace("检查", "检验")), (4, "X\nRead mode no more")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("---\n", 2), 3: ("x", 1), 4: ("Read mode no more", 1)}


def test_representatives_are_rows(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    rows = [(3, y), (5, x), (5, y + " more"), (None, y), (None, z), (None, "clean text of its own here"), (None, ""), (7, z.upper())]
    got = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(3, y), (5, x), (None, "clean text of its own here"), (None, ""), (7, z.upper())])


# ------------------------------------------------------------------------------------------------ against SQL, and stage by stage


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", ["op3_merkle_fingerprints", "op6_ngram_jaccard", "op7_hilbert_shards"])
def test_sql(spark, sf, name):
    import duckdb

    from sheerlight.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.select(*columns).fillna(-1).collect()) == sorted(tuple(-1 if v is None else v for v in r) for r in want.project(", ".join(columns)).fetchall())


def test_every_stage(spark):
    """Each stage on its own input, against the operator's report or brute force."""
    import corpus_pipeline as pipeline
    from sheerlight.llm import decontaminate, labelled, mixing, queries, toxicity

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(400).cache()
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    kept = pipeline.toxicity(spark, docs, sf).cache()
    told = {r.doc_id: r.toxic for r in labels.filter(labelled.fold("doc_id", 4) == 2).join(docs, "doc_id").collect()}
    gone = set(ids(docs)) - set(ids(kept))
    assert kept.columns == docs.columns and gone
    net = toxicity.fit(labelled.sample(docs, labels, "toxic", labelled.fold("doc_id", 4) != 2, toxicity.SAMPLE))
    assert gone == {r.doc_id for r in toxicity.score(docs, net).collect() if r.predicted}
    assert sum(told[i] == 0 for i in gone & set(told)) <= 0.1 * sum(v == 0 for v in told.values())
    one = pipeline.near_duplicates(spark, kept, sf).cache()
    groups = linked([(r.doc_id, r.text) for r in kept.collect()])
    assert set(ids(one)) == {c for n, c in groups.values() if n} | {i for i, (n, _) in groups.items() if not n} and one.columns == docs.columns
    clean = pipeline.decontamination(spark, one, sf).cache()
    plain = lambda t: " " + " ".join(re.sub("[^a-z0-9]+", " ", (t or "").lower()).split()) + " "
    items = [plain(r.text) for r in benchmark.collect()]
    assert not any(x in plain(r.text) for r in clean.collect() for x in items if len(x.split()) >= 8)
    assert set(ids(clean)) == {r.doc_id for r in decontaminate.find_leaks(one, benchmark).collect() if not r.contaminated} and clean.columns == docs.columns
    mixed = pipeline.mixing(spark, clean, sf).cache()
    plan = mixing.mix(queries.weighed(clean, labels), weight="__quality").collect()
    assert ids(mixed) == Counter(r.doc_id for r in plan for _ in range(r.copies)) and mixed.columns == docs.columns
    rows = pipeline.sharding(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in rows) == ids(mixed)
    spark.catalog.clearCache()
