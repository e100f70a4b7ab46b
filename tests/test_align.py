"""Aligned literals, pointers, matching results, mixed batches and the streamed chain against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.operators import align as al
from skein.streaming import turns as st


def plain_spans(no, yes):
    out = []
    for i, t in enumerate(no):
        if t.lower() not in ("value", "limit_value"):
            continue
        near = lambda x, k: x[k].lower() if 0 <= k < len(x) else None
        found = []
        for j in range(len(yes)):
            if near(yes, j - 1) == near(no, i - 1):
                ends = [k for k in range(j, len(yes)) if near(yes, k + 1) == near(no, i + 1)]
                if ends:
                    found.append((ends[0] + 1 - j, j))
        if not found:
            return None
        n, j = min(found)
        out.append(yes[j:j + n])
    return out


def test_spans_equal_the_plain_version(spark):
    rnd = random.Random(4)
    rows = [("a = value and b = value", "a = New York and b = 7"), ("a = value", "A = x y z"), ("limit limit_value", "limit 3"), ("value", "one two"), ("a = value", "b = 3"), ("a", "a"), ("x value", "x")]
    for _ in range(400):
        words = [rnd.choice("ab=<") for _ in range(rnd.randint(1, 8))]
        no = [rnd.choice(["value", "limit_value"]) if rnd.random() < 0.3 else w for w in words]
        yes = [v for w in no for v in ([rnd.choice("abxyz") for _ in range(rnd.randint(1, 3))] if "value" in w else [w])]
        rows.append((" ".join(no), " ".join(yes)))
    df = spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b) in enumerate(rows)] + [(-1, None, ["a"]), (-2, ["a"], None), (-3, [], [])], "i int, no array<string>, yes array<string>")
    got = {r.i: r.vals for r in al.align_values(df, "no", "yes").collect()}
    want = {i: plain_spans(a.split(), b.split()) for i, (a, b) in enumerate(rows)}
    assert got == {i: v for i, v in want.items() if v is not None}


def test_pointers_round_trip(spark):
    toks = [["select", "t.a", "from", "t.b"], [], ["select", "t.c"], ["dog", "select"], ["zzz", "select"]]
    x = spark.createDataFrame([(i, t, ["t.a", "t.b", "t.c"]) for i, t in enumerate(toks)], "k int, toks array<string>, cands array<string>")
    words = spark.createDataFrame([("select",), ("from",), ("dogs",), ("select",), (None,)], "w string")
    vocab = al.vocabulary(words, "w")
    assert {r.word: r.idx for r in vocab.collect()} == {"EOS": 0, "dogs": 1, "from": 2, "select": 3}
    p = al.encode(x, "k", "toks", "cands", vocab, 4)
    assert {r.k: r.pointer for r in p.collect()} == {0: [3, 4, 2, 5, 0], 1: [0], 2: [3, 6, 0], 3: [1, 3, 0]}  # dog has dogs, zzz has nothing
    assert {r.k: r.pointer for r in al.encode(x, "k", "toks", "cands", vocab, 4, skip_unseen=True).collect()}[4] == [3, 0]
    more = x.select("k", "cands").join(p, "k").unionByName(spark.createDataFrame([(9, ["t.a"], [3, 0, 2, 4]), (10, ["t.a"], [2, 99])], "k int, cands array<string>, pointer array<long>"))
    assert {r.k: r.toks for r in al.decode(more, "k", "pointer", "cands", vocab, 4).collect()} == {0: toks[0], 1: [], 2: toks[2], 3: ["dogs", "select"], 9: ["select"], 10: ["from", None]}


def test_results_match_as_bags(spark):
    rnd = random.Random(2)
    make = lambda rows: spark.createDataFrame(rows, "a int, b string, c double")
    rows = [(rnd.choice([1, 2, None]), rnd.choice(["x", "", None]), rnd.choice([0.5, None])) for _ in range(60)]
    g = make(rows)
    assert al.result_match(g, make(rnd.sample(rows, 60)).select(F.col("c").alias("z"), "a", "b"))
    assert not al.result_match(g, make(rows[:-1])) and not al.result_match(g, make(rows + rows[:1]))
    assert not al.result_match(g, g.select("a", "b"))
    moved = [(rows[(i + 1) % 60][0], b, c) for i, (_, b, c) in enumerate(rows)]
    assert al.result_match(g, make(moved)) == (Counter(rows) == Counter(moved))
    twice = g.select("a", F.col("a").alias("a2"))  # columns that hold the same bag
    assert al.result_match(twice, twice.select(F.col("a2").alias("p"), F.col("a").alias("q")))
    assert al.result_match(make([]), make([])) and not al.result_match(make([]), g)
    pos = g.select("*", F.monotonically_increasing_id().alias("n"))
    assert al.result_match(pos.drop("n").withColumn("n", F.lit(1)).drop("n"), g)


def test_batches_hold_their_share(spark):
    real, synth = spark.range(1000).select(F.col("id").alias("k")), spark.range(5000, 5010).select(F.col("id").alias("k"))
    rows = al.mix_batches(real, synth, "k", 0.25, 40).collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r.batch][r.origin] += 1
    assert sorted(r.k for r in rows if r.origin == "real") == list(range(1000)) and len(by) == 34
    assert all(by[b] == {"real": 30, "synthetic": 10} for b in range(33)) and by[33] == {"real": 10, "synthetic": 10}
    drawn = Counter(r.k for r in rows if r.origin == "synthetic")
    assert set(drawn) <= set(range(5000, 5010)) and max(drawn.values()) > 1
    assert al.mix_batches(real, synth.limit(0), "k", 0.25, 40).count() == 1000
    assert al.mix_batches(real.limit(0), synth, "k", 0.25, 40).count() == 0


@pytest.mark.parametrize("shards", [4])
def test_chain_goes_on_after_a_restart(spark, tmp_path, shards):
    rnd = random.Random(8)
    rows = [(c, t, f"q{c}.{t}", rnd.random() < 0.6) for c in range(12) for t in range(9)]
    base = str(tmp_path)
    for i in range(shards):
        part = [r for r in rows if r[1] * shards // 9 == i]
        spark.createDataFrame(rnd.sample(part, len(part)), st.CHAIN_SCHEMA).coalesce(1).write.json(f"{base}/src/part_{i}")
        if i in (1, 2):  # stops and starts again with what has come
            st.stream_chain(spark, f"{base}/src/part_*", f"{base}/sink", f"{base}/cp")
    got = {(r.conv_id, r.turn): r.prev_query for r in st.stream_chain(spark, f"{base}/src/part_*", f"{base}/sink", f"{base}/cp").collect()}
    want, prev = {}, defaultdict(lambda: "none")
    for c, t, q, ok in rows:
        want[c, t] = prev[c]
        prev[c] = q if ok else prev[c]
    assert got == want
