import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import cooccurrence, sketch_forest
from emberline.llm.components import connected_components
from emberline.llm.first_rows import first_rows
from emberline.llm.ngram_counts import mark_terms, ngram_counts
from emberline.llm.packing import BestFit, fill_containers
from emberline.llm.seen_keys import BlockedBloom, block_sizes, seen_before, seen_errors
from emberline.llm.terms import term_set


@pytest.mark.parametrize("limit", [0, 1000])
def test_first_rows(spark, limit):
    rows = [(1, 0, 5, "a"), (0, 7, 5, "b"), (0, 8, 5, "c"), (3, 1, None, "d"), (2, 2, 6, None)]
    df = spark.createDataFrame(rows, "ts bigint, line_no bigint, id bigint, x string").withColumn("_key", F.lit("clash"))
    got, n = first_rows(df, "id", ["ts", "line_no"], ["x"], limit)
    assert n == 2
    assert sorted(map(tuple, got.collect())) == [(5, "b"), (6, None)]
    twice, n = first_rows(df.unionAll(df), "id", ["ts", "line_no"], ["x"], limit)
    assert n == 2
    assert sorted(map(tuple, twice.collect())) == [(5, "b"), (6, None)]
    assert first_rows(df.limit(0), "id", ["ts", "line_no"], ["x"])[0].count() == 0


def test_term_set(spark):
    df = spark.createDataFrame([([" B", "b", "", None, "a "],), (None,), ([],)], "k array<string>")
    assert [r[0] for r in df.select(term_set(F.col("k"))).collect()] == [["a", "b"], [], []]


def _ngrams_by_hand(lists, max_n):
    cf, df = Counter(), Counter()
    for terms in lists:
        terms = [t for t in terms or [] if t is not None]
        own = [tuple(terms[i : i + n]) for n in range(1, max_n + 1) for i in range(len(terms) - n + 1)]
        cf.update(own)
        df.update(set(own))
    return {g: (cf[g], df[g]) for g in cf}


@pytest.mark.parametrize(("max_n", "salts"), [(1, 1), (2, 1), (3, 4), (5, 3)])
def test_ngrams(spark, max_n, salts):
    rng = random.Random(max_n)
    lists = [rng.choices("aaab" if rng.random() < 0.3 else "abcde", k=rng.randrange(0, 9)) for _ in range(200)] + [None, [], ["x", None, "y"], ["a"] * 50]
    df = spark.createDataFrame([(x, 1) for x in lists], "t array<string>, n int").repartition(3)
    got = {tuple(r.ngram): (r.occurrences, r.records) for r in ngram_counts(df, "t", max_n, salts).collect()}
    assert got == _ngrams_by_hand(lists, max_n)


def test_ngrams_of_nothing(spark):
    df = spark.createDataFrame([], "t array<string>")
    assert ngram_counts(df, "t").count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([(2,), (3,), (19,), (20,)], "records bigint")
    assert [r.mark for r in mark_terms(counts, 1000).collect()] == ["rare", None, None, "common"]


def _seen_by_hand(rows, earlier):
    known, out = {k for k in earlier if k is not None}, []
    for ts, line, key in sorted((r for r in rows if r[2] is not None), key=lambda r: r[:2]):
        if key in known:
            out.append((ts, line, key))
        known.add(key)
    return sorted(out)


@pytest.mark.parametrize("per_shard", [50, 10_000])
def test_seen_before(spark, per_shard):
    rng = random.Random(1)
    rows = [(rng.randrange(5), n, rng.choice([None, 42, 42, 42, rng.randrange(400)])) for n in range(900)]
    earlier = [rng.randrange(400) for _ in range(40)] + [None]
    df = spark.createDataFrame(rows, "ts bigint, line_no bigint, id bigint").withColumn("key", F.lit(1)).repartition(4)
    old = spark.createDataFrame([(k,) for k in earlier], "id bigint")
    # A loose filter: wrong answers are many, and the check takes them out.
    got = seen_before(df, "id", ["ts", "line_no"], old, target=0.2, per_shard=per_shard).collect()
    assert sorted(map(tuple, got)) == _seen_by_hand(rows, earlier)
    loose = {tuple(r) for r in seen_before(df, "id", ["ts", "line_no"], old, target=0.2, exact=False, per_shard=per_shard).collect()}
    assert loose >= set(_seen_by_hand(rows, earlier))
    alone = seen_before(df, "id", ["ts", "line_no"], None, per_shard=per_shard).collect()
    assert sorted(map(tuple, alone)) == _seen_by_hand(rows, [])


def test_seen_before_of_nothing(spark):
    none = spark.createDataFrame([], "ts bigint, line_no bigint, id bigint")
    assert seen_before(none, "id", ["ts", "line_no"]).count() == 0


def test_repeated_rows_count_once_as_new(spark):
    df = spark.createDataFrame([(0, 0, 7)] * 3, "ts bigint, line_no bigint, id bigint").repartition(3)
    assert seen_before(df, "id", ["ts", "line_no"]).count() == 2


def test_filter_keeps_its_rate(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**62, 100_000)
    bloom = BlockedBloom(*block_sizes(len(keys), 1e-3))
    bloom.insert(keys)
    assert bloom.query(keys).all()
    assert bloom.query(rng.integers(-(2**62), 0, 200_000)).mean() < 1.3e-3
    df = spark.range(100, 60_100).select(F.col("id"), F.col("id").alias("ts"), F.lit(0).alias("line_no"))
    (row,) = seen_errors(df, "id", ["ts", "line_no"], target=1e-2, per_shard=100_000).collect()
    assert 0.99 * 60_000 <= row["keys"] <= 60_000
    assert row.false_positives / row.absent < 1.5e-2


def _pairs_by_hand(records):
    out = Counter()
    clean = lambda w: w.strip(" ").lower() if w else ""
    for pairs in records:
        own = {tuple(sorted((clean(p[0]), clean(p[1])))) for p in pairs or [] if p is not None}
        out.update(p for p in own if p[0] and p[0] != p[1])
    return dict(out)


@pytest.mark.parametrize(("bits", "sent"), [(32, 100), (3, 100_000), (3, 0)])
def test_pair_counts(spark, bits, sent, monkeypatch):
    monkeypatch.setattr(cooccurrence, "SENT_CODES", sent)
    monkeypatch.setattr(cooccurrence, "SENT_WORDS", sent)
    rng = random.Random(bits)
    words = ["a", "B", " b", "c", "d", "", None, "eé", "f"]
    records = [[(rng.choice(words), rng.choice(words)) for _ in range(rng.randrange(0, 12))] for _ in range(150)] + [None, [], [None, ("a", "c"), ("c", "A ")]]
    df = spark.createDataFrame([(r,) for r in records], "p array<struct<a:string,b:string>>").repartition(3)
    for least in (1, 20):
        for vocabulary in (None, ["a", "b", "c", "d"], ["a", "b", "c", "d", "eé", "f", "never"]):
            terms = vocabulary and spark.createDataFrame([(w,) for w in vocabulary], "term string")
            got = {(r.term_a, r.term_b): r.n for r in cooccurrence.pair_counts(df, "p", 150, least, bits, terms).collect()}
            assert got == {k: n for k, n in _pairs_by_hand(records).items() if n >= least}


def test_runs_are_merged_in_order():
    rng = np.random.default_rng(1)
    runs, want = cooccurrence.Runs(), Counter()
    for k in range(40):
        code = np.unique(rng.integers(0, 5000, 50 * (k % 7))).astype(np.uint64)
        n = rng.integers(1, 9, len(code))
        want.update(dict(zip(code.tolist(), n.tolist())))
        runs.add(code, n)
    code, n = runs.merged()
    assert code.tolist() == sorted(want)
    assert dict(zip(code.tolist(), n.tolist())) == dict(want)


def test_pair_scores(spark):
    df = spark.createDataFrame([(8, 10, 10, 100), (8, 0, 10, 100)], "n bigint, n_a bigint, n_b bigint, t bigint")
    n, a, b = F.col("n"), F.col("n_a"), F.col("n_b")
    rows = df.select(cooccurrence.lift(n, a, b, 100), cooccurrence.odds_ratio(n, a, b, 100)).collect()
    assert rows[0][0] == pytest.approx(8.0)
    assert rows[0][1] == pytest.approx(8.5 * 88.5 / (2.5 * 2.5))
    assert rows[1][0] is None


@pytest.mark.parametrize(("thin", "place_edges"), [(0.0, 100_000), (0.1, 7), (2.0, 30)])
def test_connected_components(spark, thin, place_edges):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    edges += [(5, 5), (None, 3), edges[0]]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            want[s], todo = s, [s]
            while todo:
                for y in near[todo.pop()]:
                    if y not in want:
                        want[y] = s
                        todo.append(y)
    df = spark.createDataFrame(edges, "a bigint, b bigint").withColumn("vertex", F.lit(0))
    got = {r.vertex: r.component for r in connected_components(df, thin=thin, place_edges=place_edges).collect()}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def _similar_by_hand(sets, threshold):
    clean = [(k, {x for x in s or [] if x is not None}) for k, s in sets if k is not None]
    return {
        (min(a, b), max(a, b))
        for (a, s), (b, t) in itertools.combinations(clean, 2)
        if a != b and s and t and len(s & t) * threshold.denominator >= threshold.numerator * len(s | t)
    }


@pytest.mark.parametrize("block", [4, sketch_forest.BLOCK])
def test_similar_pairs(spark, block):
    rng = random.Random(9)
    base = [[f"t{rng.randrange(400)}" for _ in range(rng.randrange(1, 20))] for _ in range(40)]
    sets = []
    for k in range(400):
        own = list(rng.choice(base))
        if rng.random() < 0.6:
            own[rng.randrange(len(own))] = f"t{rng.randrange(400)}"
        sets.append((k, own))
    sets += [(1000 + k, base[0]) for k in range(40)] + [(2000, []), (2001, None), (2002, [None]), (None, ["t1"]), (3, sets[3][1])]
    df = spark.createDataFrame(sets, "k bigint, s array<string>").withColumn("rep", F.lit(1)).repartition(3)
    for threshold in (Fraction(4, 5), Fraction(3, 5)):
        got, groups = sketch_forest.similar_pairs(df, "k", "s", threshold, 24, 0.9999, block=block)
        assert {tuple(r) for r in got.collect()} == _similar_by_hand(sets, threshold)
    links, groups = sketch_forest.similar_pairs(df, "k", "s", Fraction(4, 5), 24, 0.9999, block, copies=False)
    rep = {r.key: r.rep for r in groups.collect()}
    links = {tuple(r) for r in links.collect()}
    expanded = {(a, b) for a, b in itertools.combinations(sorted(rep), 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in links}
    assert expanded == _similar_by_hand(sets, Fraction(4, 5))


def test_depth_meets_the_recall():
    for threshold, trees in ((Fraction(4, 5), 20), (Fraction(3, 5), 24)):
        depth = sketch_forest.depth_for(threshold, trees, 0.9999)
        assert 1 - (1 - float(threshold) ** depth) ** trees >= 0.9999 > 1 - (1 - float(threshold) ** (depth + 1)) ** trees


def test_missed_share():
    rng = np.random.default_rng(0)
    for q, trees in ((0.3, 6), (0.41, 12)):
        met = rng.binomial(trees, q, 400_000)
        found = met[met > 0]
        assert sketch_forest.missed_share([(len(found), int(found.sum()))], trees) == pytest.approx((met == 0).mean(), rel=0.1)
    assert sketch_forest.missed_share([], 12) == 0.0
    assert sketch_forest.missed_share([(10, 120)], 12) == 0.0


def test_trees_are_added_until_the_recall_is_met(spark):
    rng = random.Random(5)
    sets = []
    for k in range(150):
        own = rng.sample(range(100_000), 9)
        sets += [(2 * k, own), (2 * k + 1, own[:8] + [rng.randrange(100_000, 200_000)])]  # exactly 0.8
    classes = spark.createDataFrame(sets, "rep bigint, items array<bigint>")
    links, rounds = sketch_forest.class_links(classes, Fraction(4, 5), 5, 0.999)
    assert len(rounds) > 1 and rounds[-1][1] >= 0.999 > rounds[0][1]
    assert {tuple(r) for r in links.collect()} == {(2 * k, 2 * k + 1) for k in range(150)}


def test_best_fit_places_in_the_fullest_that_takes_it():
    packer = BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4, 9, 0)] == [0, 1, 1, 0, 2, 1]
    # All bins are open: the fullest closes before another opens.
    assert packer.place(8) == 3


def test_fill_containers(spark):
    rng = random.Random(4)
    sizes = [(k, rng.choice([0, None, rng.randrange(1, 60), rng.randrange(90, 400)])) for k in range(500)] + [(None, 5)]
    items = spark.createDataFrame(sizes, "k bigint, n int").withColumn("pack_id", F.lit("clash"))
    packs = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0), (1, 100)], "pack_id int, capacity int")
    rows = fill_containers(items, "k", "n", packs, open_bins=8, containers_a_shard=50).collect()
    for pack, capacity in ((1, 100), (2, 64)):
        own = [r for r in rows if r.pack_id == pack]
        load, pieces = Counter(), defaultdict(list)
        for r in own:
            load[r.container] += r.tokens
            pieces[r.key].append((r.piece, r.tokens))
        assert max(load.values()) <= capacity
        want = {k: n or 0 for k, n in sizes if k is not None}
        assert {k: sum(t for _, t in v) for k, v in pieces.items()} == want
        assert all(len(pieces[k]) == max(1, -(-n // capacity)) and all(t == capacity for _, t in sorted(pieces[k])[:-1]) for k, n in want.items())
        assert sum(load.values()) / (len(load) * capacity) > 0.85
    assert {r.pack_id for r in rows} == {1, 2}
    assert fill_containers(items.limit(0), "k", "n", packs).count() == 0
