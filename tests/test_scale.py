"""Joins, reranking, lint rules and span counts that keep their work spread and in one pass."""

from collections import Counter

from pyspark.sql import functions as F

from skein.operators import link as lk
from skein.operators import relational as rel
from skein.operators import select as se


def test_hot_key_of_a_theta_join_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(rel, "PAIRS_PER_CELL", 50)
    a = spark.createDataFrame([(i, 1 if i < 40 else None, i % 7) for i in range(45)] + [(3, 1, 3)], "x long, k long, u long")
    b = spark.createDataFrame([(i, 1 if i < 30 else 2, i % 5) for i in range(33)], "y long, m long, v long")
    j = rel.theta_join(a, b, [("k", "m")], F.col("u") < F.col("v"))
    plain = a.join(b, (a.k == b.m) & (a.u < b.v))
    assert sorted(map(tuple, j.collect())) == sorted(map(tuple, plain.collect()))
    hot = j.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(hot) > 4  # before: one key, one task


def test_scores_are_computed_once(spark):
    b = spark.createDataFrame([(1, 0, ["a", "EOS"], [-1.0, -1.0], True), (2, 0, [], [], True)], "k long, beam int, toks array<string>, scores array<double>, valid boolean")
    best = se.rerank_max(b, "k")
    assert [tuple(r) for r in best.collect()] == [(1, 0, -1.0)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_span_counts_equal_counted_spans(spark):
    docs = spark.createDataFrame([(1, "a b a b, c"), (1, "a b"), (2, None), (3, ""), (4, "x"), (None, "q q q")], "doc_id long, text string")
    want = lk.spans(docs, "doc_id", "text", 3).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("span").alias("d"))
    got = lk.span_counts(docs, "doc_id", "text", 3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_log_texts_are_analysed_once(spark, tmp_path, monkeypatch):
    from skein.operators import score as sc
    from skein.plans import querylog_queries as qq
    from skein.plans.querylog import query_log
    from skein.sources.catalog import star_catalog
    from tests.conftest import SF_SMALL

    events = spark.createDataFrame([(i % 400,) for i in range(405)] + [(None,)], "event_id long")
    events.write.parquet(f"{tmp_path}/events.parquet")
    seen, analyse = [], sc.analyse
    cat = star_catalog(spark, SF_SMALL)
    monkeypatch.setattr(qq, "star_catalog", lambda *_: cat)
    monkeypatch.setattr(sc, "analyse", lambda qs, *a, **k: (seen.append(qs.count()), analyse(qs, *a, **k))[1])
    got = qq.e16(spark, str(tmp_path))
    log = query_log(spark, spark.read.parquet(f"{tmp_path}/events.parquet"))
    per, _ = sc.split_scores(sc.component_scores(sc.blocks(analyse(log, "query_id", cat.columns, fks=sc.fk_map(cat))[0], "query_id"), "query_id").filter("gold_valid"), "query_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, per.select("query_id", "hardness", "exact").collect()))
    # before: every event's texts
    each = log.groupBy("query_id", "gold", "pred").agg(F.count("*").alias("n")).select("gold", "pred", "n").distinct()
    assert seen == [each.agg(F.sum("n")).first()[0]] and seen[0] < log.count()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_token_rewrites_compute_their_arrays_once(spark):
    from skein.operators import align as al
    from skein.operators import querytext as qt

    toks = spark.createDataFrame([(1, "select t1.a from x as t1 limit 2", "select t1.a from x as t1 limit value")], "i long, a string, b string")
    toks = toks.select("i", F.split("a", " ").alias("yes"), F.split("b", " ").alias("no"))
    spans = al.align_values(toks, "no", "yes").where(F.size("vals") > 0)
    assert [r.vals for r in spans.select("vals").collect()] == [[["2"]]]
    assert _optimized(spans).count("limit_value") == 1  # before: once more in each filter
    split = toks.select(qt.split_dotted("yes")["toks"].alias("t"))
    assert _optimized(split).count("split(replace(") == 1
    assert split.first().t == ["select", "t1", ".", "a", "from", "x", "as", "t1", "limit", "2"]


def test_columns_are_assigned_in_the_row(spark):
    from skein.operators import content as ct
    from skein.operators import generate as gen

    typed = spark.createDataFrame([("d", "t", c, k) for c, k in [("a", "text"), ("b", "text"), ("n", "number")]], "db_id string, table_name string, column_name string, slot_type string")
    draws = spark.createDataFrame([(i, "select text_col_0 where text_col_1 = value and number_col_0 > value", "d") for i in [1, 2, 3, 3]], "seed long, template string, db_id string")
    slots = gen.assign_columns(draws, typed)
    assert "Window" not in _optimized(slots)  # before: a row for each seed and column met in a window
    of = {}
    for r in slots.collect():
        of.setdefault(r.seed, {})[r.slot] = r.col
    assert all(sorted(of[s].values()) == ["t.a", "t.b", "t.n"] for s in (1, 2)) and len(of[3]) == 6
    mapped = gen.map_columns(draws, typed)
    want = sorted((s, " ".join(of[s].get(t, t) for t in r.template.split(" "))) for r in draws.collect() for s in [r.seed])
    assert sorted((r.seed, r.mapped) for r in mapped.collect()) == want
    chosen = ct.detemplatize(gen.coarse_tokens(mapped), typed)
    assert chosen.count() == 4 and _optimized(chosen).count("reverse(aggregate(") == 1  # before: again in a filter


def test_the_log_is_made_once_for_its_results(spark, tmp_path):
    from skein.plans import querylog_queries as qq
    from skein.plans.querylog import query_log

    spark.createDataFrame([(i,) for i in range(300)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = qq._per_text(spark, str(tmp_path), lambda rows: rows.select("query_id", "gold"))
    log = query_log(spark, spark.read.parquet(f"{tmp_path}/events.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, log.select("query_id", "gold").collect()))
    assert _optimized(got).count("Relation [event_id#") == 1  # before: once more for each use of its texts
    assert "BroadcastHashJoin [gold#" in got._jdf.queryExecution().executedPlan().toString()  # before: the log's texts were shuffled


def test_spans_without_a_value_are_dropped_where_they_are_made(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"said furniture{'x' * (i % 3)} and w{i} frniture, FURNITURE") for i in range(60)] + [(7, "urgent"), (None, "1-urgent 1-urgen 1-urgentt")], "doc_id long, text string")
    pl = spark.createDataFrame([("t", "a", "Furniture"), ("t", "a", "1-URGENT"), ("u", "b", "furniture store"), ("u", "b", "1-urgent")], "table_name string, column_name string, value string")
    sp = lk.spans(docs, "doc_id", "text", 2)
    seen, among = [], lk._maybe_among
    monkeypatch.setattr(lk, "_maybe_among", lambda df, *a: df)
    want = [sorted(map(tuple, f(sp, pl, "doc_id").collect()), key=str) for f in (lk.link_exact, lk.link_fuzzy)]
    monkeypatch.setattr(lk, "_maybe_among", lambda df, *a: (lambda x: (seen.append((df.count(), x.count())), x)[1])(among(df, *a)))
    assert [sorted(map(tuple, f(sp, pl, "doc_id").collect()), key=str) for f in (lk.link_exact, lk.link_fuzzy)] == want
    assert all(len(w) > 50 for w in want) and all(b * 2 < a for a, b in seen)


def test_templates_are_filled_from_columns_assigned_once(spark):
    from skein.operators import content as ct
    from skein.operators import generate as gen

    cols = [("name", "text"), ("kind", "text"), ("size", "number")]
    typed = spark.createDataFrame([("d", "t", c, k, None) for c, k in cols] + [("d", "t", "*", "*", "name")], "db_id string, table_name string, column_name string, slot_type string, first_column string")
    index = ct.content_index(ct.literals({"t": spark.createDataFrame([(f"n{i}", f"k{i % 3}", i) for i in range(40)], "name string, kind string, size int")}))
    text = "select text_col_0 where text_col_0 = value and number_col_0 > value having count ( *_col_0 ) > value"
    draws = spark.createDataFrame([(i, text, "d") for i in [*range(30), 3]], "seed long, template string, db_id string")
    mapped = gen.map_columns(draws, typed)
    filled = ct.fill_template(mapped, typed, *index)
    assert "sort_array" not in _optimized(filled)  # before: each reader of the columns assigned them again
    got = filled.collect()
    assert len(got) == 31 and len({(r.seed, r.filled) for r in got}) == 30  # before: a repeated seed was an error
    alone = {r.seed: r.literals for r in ct.fill_template(mapped.dropDuplicates(["seed"]), typed, *index).collect()}
    assert {r.seed: r.literals for r in got} == alone and all(len(x) == 3 and x[2] in list("123456789") for x in alone.values())


def test_goals_of_one_text_are_rebuilt_once(spark, monkeypatch):
    from skein.plans import generate_queries as gq
    from tests.conftest import SF_SMALL

    draws = spark.createDataFrame([(i, "select text_col_0 where number_col_0 > value", "geo") for i in [*range(80), 7]], "seed long, template string, db_id string")
    seen, rebuild = [], gq.rb.rebuild_from
    monkeypatch.setattr(gq.rb, "rebuild_from", lambda qs, *a, **b: (seen.append(qs.count()), rebuild(qs, *a, **b))[1])
    got = gq.goals(spark, SF_SMALL, draws).collect()
    assert len(got) == 81 and len({(r.seed, r.sql) for r in got}) == 80
    assert seen[0] == 2  # two names, one number; before: as many as there are draws


def test_template_counts_need_no_row_of_the_log(spark, tmp_path):
    from skein.operators import generate as gen
    from skein.plans import generate_queries as gq

    spark.createDataFrame([(i,) for i in [*range(200), 5, 5, None]], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = gq.gold_template_stats(spark, str(tmp_path))
    want = gen.template_stats(gq.gold_templates(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.agg({"n": "sum"}).first()[0] == 202


def test_spans_near_values_lose_no_link(spark):
    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde1ü𝒳") for _ in range(rnd.randint(1, 7)))
    vals = [" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(150)] + ["ab", "abc", " \tx y", "A  B", "", None, "7", "many"] + ["w " * 9 + "end"]

    def edited(v):
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(v))
            v = v[:at] + rnd.choice(["", "a", "é"]) + v[at + rnd.randint(0, 1):]
        return v
    known = [v for v in vals if v]
    texts = [rnd.choice([", ", " "]).join(edited(rnd.choice(known)) if rnd.random() < 0.3 else word() for _ in range(25)) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (7, "ab"), (None, "abc ab"), (500, None), (501, " . ")], "doc_id long, text string")
    pl = spark.createDataFrame([("t", "ab"[i % 2], v) for i, v in enumerate(vals)], "table_name string, column_name string, value string")
    every, near = lk.spans(docs, "doc_id", "text", 10), lk.spans(docs, "doc_id", "text", 10, near=pl)
    got, rows = Counter(map(tuple, near.collect())), Counter(map(tuple, every.collect()))
    assert not got - rows and sum(got.values()) * 4 < sum(rows.values())  # before: every span was cut and met the keys
    for f in (lk.link_exact, lk.link_fuzzy):
        want, have = (Counter(map(tuple, f(x, pl, "doc_id").collect())) for x in (every, near))
        assert want == have and sum(want.values()) > 100
    assert lk.spans(docs, "doc_id", "text", 3, near=pl.where("false")).count() == 0
