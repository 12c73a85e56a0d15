import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from linkloom.operators import decide, dense, evaluate, features, graph, model, profile, quality, retrieval, splits
from linkloom.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_conflicts(spark):
    scored = spark.createDataFrame([(1, "a", 0.90), (2, "a", 0.88), (3, "b", 0.04), (7, "c", 0.5), (3, "c", 0.5)], "qid int, tid string, score double")
    assert {(q, t): s for q, t, s in rows(decide.resolve_conflicts(scored, 0.05))} == {(1, "a"): 0, (2, "a"): 0, (3, "b"): 0, (3, "c"): 0, (7, "c"): 0}
    assert {(q, t): s for q, t, s in rows(decide.resolve_conflicts(scored, 0.0))}[3, "c"] == 0.5
    assert decide.resolve_conflicts(scored, None) is scored


def test_gate_and_guard(spark):
    scored = spark.createDataFrame([(1, "a", 2, 0.60), (1, "b", 3, 0.58)], "qid int, tid string, source int, score double")
    assert rows(decide.source_gate(scored, {2: 0.5}, 0.5, gate=0.7)) == []
    assert len(rows(decide.source_gate(scored, {2: 0.5}, 0.59, gate=0.5))) == 1
    pairs = spark.createDataFrame([(1, "t", 0.9, "Brazil", "zzzz", "acme"), (2, "t", 0.6, "Brazil", "acme", "acme"), (3, "u", 0.5, "Brazil", "x", "x")], "qid int, tid string, score double, country string, q_name string, t_name string")
    assert [(r.qid, r.tid) for r in decide.country_guard(pairs).collect()] == [(2, "t")]


def test_float_thresholds(spark):
    scored = spark.createDataFrame([(1, "a", 2, 0.9)], "qid int, tid string, source int, score float")
    assert len(rows(decide.source_gate(scored, {2: 0.9}, 0.9))) == 1


def test_components(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(1, 30)], "node int, label int")
    edges = spark.createDataFrame([(3, 1), (5, 3), (7, 7), (None, 2), (99, 4), *[(i, i + 1) for i in range(10, 29)]], "a int, b int")
    found = dict(rows(graph.connected_components(nodes, edges)))
    assert found[5] == found[3] == found[1] == 1 and found[7] == 7 and found[2] == 2 and found[4] == 4 and found[29] == 10
    assert rows(graph.connected_components(nodes, edges.limit(0)))[0] == (1, 1)


def test_measures(spark):
    refs = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    truth = spark.createDataFrame([(1, "a"), (1, "b")], "qid int, tid string")
    pred = spark.createDataFrame([(1, "a"), (1, "c"), (3, "x")], "qid int, tid string")
    counts = evaluate.entity_counts(refs, truth, pred)
    assert [r.f05 for r in evaluate.entity_f05(counts).orderBy("qid").collect()] == [0.5, 1.0, 0.0]
    assert evaluate.macro_pr(counts).first().macro_precision == pytest.approx((0.5 + 1 + 0) / 3)
    assert {r.error for r in evaluate.errors(truth, pred).collect()} == {"false_positive", "false_negative"}
    ranked = pred.withColumn("rank", F.lit(2))
    assert [(r.k, r.recovered) for r in evaluate.recall_at(truth, ranked, (1, 2)).orderBy("k").collect()] == [(1, 0), (2, 1)]
    assert evaluate.smallest_budget(evaluate.recall_at(truth, ranked, (1, 2))) == (2, False)


def test_thresholds_and_bootstrap(spark):
    refs = spark.createDataFrame([(1,), (2,)], "qid int")
    truth = spark.createDataFrame([(1, "a")], "qid int, tid string")
    scored = spark.createDataFrame([(1, "a", 2, 0.8, 1), (1, "b", 3, 0.6, 0), (2, "c", 2, 0.7, 0)], "qid int, tid string, source int, score double, label int")
    best = evaluate.choose_thresholds(refs, truth, scored)
    assert best["macro_f05"] == 1.0 and 0.7 < best["source2"] <= 0.8
    paired = spark.range(200).select((F.col("id") % 2 / 2).alias("a"), (F.col("id") % 2 / 2 + 0.1).alias("b"))
    r = evaluate.bootstrap_delta(paired, "a", "b", 200).first()
    assert r.mean == pytest.approx(0.1) and r.low == pytest.approx(0.1) and evaluate.accept(r.mean, r.low, {"x": -0.001})


def test_audits(spark):
    records = spark.createDataFrame([(1, "S1-1", "n", "", "x"), (1, "S1-1", "", "a", "x"), (2, "S1-9", "n", "a", "y")], "src int, entity_id string, name string, address string, country string")
    assert rows(quality.audit_sources(records), "src") == [(1, 2, 1, 0, 1, 1), (2, 1, 0, 1, 0, 0)]
    packed = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S2-1, S3-2"), ("S1-3", "S9-1"), ("S1-4", ""), ("S1-5", "S2-1,")], "source1_entity_id string, ids string")
    assert [r[0] for r in rows(quality.malformed_rows(packed, "ids"))] == ["S1-1", "S1-2", "S1-3", "S1-5"]
    assert [r[1] for r in rows(tables.unpack_links(packed.where("source1_entity_id = 'S1-2'"), "ids"))] == ["S2-1", "S3-2"]
    with pytest.raises(ValueError):
        quality.require_clean(spark.createDataFrame([("missing", 1)], "check string, n long"))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 'say "hi"', "", "x"), ("a", "n", None, "y")], "entity_id string, business_name string, business_address string, country string")
    tables.write_tsv(df, f"{tmp_path}/t", "entity_id")
    back = tables.read_tsv(spark, f"{tmp_path}/t")
    assert rows(back) == [("a", "n", "", "y"), ("b", 'say "hi"', "", "x")]
    tables.write_partitioned(df, f"{tmp_path}/p", "country")
    assert tables.read_parquet(spark, f"{tmp_path}/p").where("country = 'x'").count() == 1
    ids = spark.createDataFrame([(f"k{i:03}",) for i in range(50)], "k string")
    assert rows(tables.dense_ids(ids, "k"), "rid") == [(f"k{i:03}", i + 1) for i in range(50)]
    assert tables.range_scan(tables.dense_ids(ids, "k"), "rid", 3, 5).count() == 3
    with pytest.raises(ValueError):
        tables.range_scan(tables.dense_ids(ids, "k"), "rid", 45, 55)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/x/one.tsv", "1")
        z.writestr("other", "2")
    assert [p.name for p in tables.extract_archive(tmp_path / "a.zip", tmp_path / "out", "top/")] == ["one.tsv"]
    assert tables.write_once(ids, f"{tmp_path}/once", {"a": 1}).count() == tables.write_once(ids.limit(0), f"{tmp_path}/once", {"a": 1}).count() == 50


def test_retrieval(spark):
    records = spark.createDataFrame([(2, "x", 1, "red fox", "1 hill"), (2, "x", 2, "red cat", "2 hill"), (3, "", 3, "red fox", "9 sea"), (2, "y", 4, "red fox", "1 hill")], "source int, country string, rid long, n string, a string")
    queries = spark.createDataFrame([(10, "x", "red fox", "1 hill"), (11, "x", "", "")], "qid long, country string, n string, a string")
    found = rows(retrieval.retrieve(queries, records, retrieval.Settings(k=5)).select("qid", "source", "rank", "rid", "passes"))
    assert found[0][:4] == (10, 2, 1, 1) and found[0][4] & retrieval.EXACT
    assert {r[3] for r in found} == {1, 2, 3} and all(r[0] == 10 for r in found)
    links = spark.createDataFrame([(2, "acme foods", "एक्मे foods")] * 3, "source int, left string, right string")
    assert rows(retrieval.learn_aliases(links)) == [(2, "acme", ["एक्मे"])]


def test_features(spark):
    recs = spark.createDataFrame([(1, "t1", "x", "Acme Ltd", "12 Main Rd 560001"), (1, "t2", "y", "Acme", "14 Main Road"), (1, "t3", "x", "", "")], "qid int, tid string, country string, name string, address string")
    v = features.views(recs)
    pairs = spark.createDataFrame([(1, t, 2, 4, 0.5, 37) for t in ("t1", "t2", "t3")], "qid int, tid string, source int, rank int, retrieval_score double, passes int")
    got = features.pair_features(features.join_pairs(pairs, v.where("tid = 't1'"), v.drop("qid")))
    assert got.columns[-45:] == features.FEATURES
    same, other, none = got.orderBy("tid").collect()
    assert same.name_exact == 1 and same.rank_inverse == 0.25 and same.pass_count == 3 and same.address_ratio == 1
    assert other.number_conflict == 1 and other.name_core_exact == 1 and other.country_equal == 0 and other.name_exact == 0
    assert none.name_missing == 1 and none.name_ratio == 0 and none.name_jaccard == 0
    assert [r[0] for r in got.orderBy("tid").select(features.rule_score(got)).collect()] == [1.0, 0.0, 0.0]


def test_dense(spark):
    v = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "b", [1.0, 0.1]), (3, "b", [0.0, 1.0]), (4, "c", [1.0, 0.0])], "tid long, block string, vector array<float>")
    hits = rows(dense.dense_top_k(v.where("tid = 1").withColumnRenamed("tid", "qid"), v.where("tid > 1"), 5, 0.6))
    assert [h[:2] for h in hits] == [(1, 2)]
    n = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9)], "qid int, tid string, neural_score double")
    d = spark.createDataFrame([(1, "a", 0.7), (2, "c", 0.8)], "qid int, tid string, dense_score double")
    assert rows(dense.merge_scores(n, d)) == [(1, "a", 0.7, "dense_higher"), (1, "b", 0.9, "neural"), (2, "c", 0.8, "dense")]


def test_splits_and_profiles(spark):
    groups = spark.range(500).select(F.col("id").alias("qid"), (F.col("id") % 100).alias("group_id"))
    split = splits.group_split(groups)
    assert split.groupBy("group_id").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert rows(splits.hash_sample(groups, 5, ["qid"])) == rows(splits.hash_sample(groups.repartition(7), 5, ["qid"]))
    assert splits.stratified_sample(groups.withColumn("s", F.col("qid") % 3), "s", 4, ["qid"]).count() == 12
    pool = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 0, 0.8), (1, "c", 0, 0.7)], "qid int, tid string, label int, retrieval_score double")
    assert splits.training_pairs(pool, 1, 10).count() == 2
    with pytest.raises(ValueError):
        splits.training_pairs(pool.where("label = 0"))
    counts = spark.createDataFrame([("x", 0), ("x", 7), ("y", 1)], "country string, match_count int")
    assert {(r["country"], r["bin"]) for r in profile.bin_shares(counts, "country").collect()} == {("x", "k=0"), ("x", "k>5"), ("y", "k=1")}


def test_model(spark, tmp_path):
    data = spark.range(300).select(F.col("id").alias("qid"), F.lit("t").alias("tid"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") % 7 / 10).cast("float").alias("x"), (F.col("id") % 3).alias("fold"))
    scored = model.out_of_fold(data, ["x"], maxIter=2, maxDepth=2)
    assert scored.count() == 300 and scored.where("(score >= 0.5) <> (label = 1)").count() == 0
    m = model.fit(data, ["x"], "forest", numTrees=3)
    model.save(m, "forest", ["x"], f"{tmp_path}/m")
    assert model.score(data, model.load(spark, f"{tmp_path}/m", ["x"]), ["x"]).count() == 300
    with pytest.raises(ValueError):
        model.load(spark, f"{tmp_path}/m", ["y"])


def test_hash_sample_is_the_head_of_the_order(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 7)
    for n in (0, 1, 17, 2999, 3000, 5000):
        want = rows(df.orderBy(*splits._order(["id", "k"], 3)).limit(n))
        assert rows(splits.hash_sample(df, n, ["id", "k"], 3)) == want


def test_postings_over_the_limit_start_no_pass(spark):
    """Words of more records than the limit are asked for in no pass that needs any of its words."""
    records = spark.createDataFrame([(2, "en", i, f"n{i}", "common word") for i in range(60)], "source int, country string, rid long, n string, a string")
    queries = spark.createDataFrame([(1, "en", "x", "common y")], "qid long, country string, n string, a string")
    found = lambda limit: retrieval.retrieve(queries, records, retrieval.Settings(k=100, posting_limit=limit, include_grams=False)).count()
    assert (found(50), found(60)) == (0, 60)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from linkloom.session import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(applicationId="none", master="yarn"))
    with pytest.raises(RuntimeError):
        shared_dir(far)


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from linkloom.session import Scratch, temporary

    with temporary():
        inner = Scratch(spark, "scope")
        assert inner.table("t", spark.range(5)).count() == 5
        folder = inner.root.removeprefix("file://")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_shuffle_files_go_with_the_write(spark):
    import time

    from linkloom.session import Scratch

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")
        return {name.split("_")[1] for f in files if (name := f.rpartition("/")[2]).startswith("shuffle_")}

    scratch, before = Scratch(spark, "freed"), shuffles()
    scratch.table("t", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    scratch.close()
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_overlaps_of_large_groups_are_dealt_into_cells(spark, monkeypatch):
    import random

    from linkloom.operators import overlap

    monkeypatch.setattr(overlap, "ROWS", 8)
    monkeypatch.setattr(overlap, "CHARS", 200)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "日本"]
    rows = [(country, name, i, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 5, 12))))) for i, (country, name) in enumerate([("en", "a")] * 90 + [("", "a")] * 3 + [("en", "b")] * 2 + [("fr", "c:1")])]
    df = spark.createDataFrame(rows, "country string, name string, id long, text string")
    got = overlap.overlaps(df.where("id % 3 = 0"), df.where("id % 3 <> 0"), ["country", "name"])
    sets = {i: (c, n, t, set(t.split())) for c, n, i, t in rows}
    want = {}
    for i, (c, n, t, x) in sets.items():
        for j, (d, m, u, y) in sets.items():
            if i % 3 == 0 and j % 3 and (c, n) == (d, m):
                want[i, j] = (c, len(x & y), len(x | y), t == u)
    collected = got.collect()
    assert len(collected) == len(want) and {(r.left, r.right): (r.country, r.shared, r.either, r.equal) for r in collected} == want
    # the large group is not one task's work
    from pyspark.sql import functions as F

    assert got.where("country = 'en'").select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_link_profile_of_names_weighs_distinct_names(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from linkloom.functions.similarity import jaro_winkler_bytes
    from linkloom.operators import profile

    monkeypatch.setattr(profile, "NAMES_EACH", 10)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i % 3 + 1, rng.choice(("en", "fr", "")), f"{rng.choice(('acme', 'apex'))} {rng.choice(('one', 'oen', 'zzzz', 'é'))} {rng.randrange(4)}") for i in range(300)]
    df = spark.createDataFrame(rows, "w string, source int, country string, name string")
    q, t = df.where("source = 1").drop("source"), df.where("source <> 1")
    for left in (q, q.where("false")):
        met = left.select("w", F.col("country").alias("q_country"), F.col("name").alias("q_name")).join(t.select("w", "source", F.col("country").alias("t_country"), F.col("name").alias("t_name")), "w")
        want = profile.link_profile(met.withColumn("name_sim", jaro_winkler_bytes("q_name", "t_name"))).first().asDict()
        compared = []
        got = profile.link_profile_of_names(left, t, lambda a, b: (compared.append((a, b)), jaro_winkler_bytes(a, b))[1]).first().asDict()
        assert got.keys() == want.keys() and all(got[k] == want[k] if not isinstance(want[k], float) else abs(got[k] - want[k]) < 1e-9 for k in want), (got, want)


def test_pass_hits_of_small_cells_equal_those_of_all_pairs(spark, monkeypatch):
    """Queries meet postings in cells of bounded size: many small ones give what looking at every document gives."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmn") for _ in range(n))
    docs = [(rng.choice((2, 3)), rng.choice(("en", "fr")), i, text(3), text(5)) for i in range(120)]
    queries = [(i, rng.choice(("en", "fr")), text(3), text(5)) for i in range(40)]
    indexed = retrieval.documents(spark.createDataFrame(docs, "source int, country string, rid long, n string, a string"))
    stats, asked = retrieval.term_stats(indexed), spark.createDataFrame(queries, "qid long, country string, n string, a string")

    def found():
        rare = retrieval.rare_terms(retrieval.query_terms(asked, indexed), stats)
        passes = retrieval._passes(rare, retrieval.Settings(k=4)).localCheckpoint()
        return passes.collect(), sorted(map(tuple, retrieval.pass_hits(passes, indexed, 4).select("qid", "source", "country", "pass_id", "rank", "rid", F.round("score", 6)).collect()))

    whole = found()
    monkeypatch.setattr(retrieval, "TERMS", 200)
    monkeypatch.setattr(retrieval, "PASSES", 30)
    monkeypatch.setattr(retrieval, "POSTINGS", 300)
    cells = found()
    assert sorted(map(str, cells[0])) == sorted(map(str, whole[0])) and cells[1] == whole[1]
    held = {(r["source"], r["country"], r["rid"]): set(r["terms"]) for r in indexed.collect()}
    brute = []
    for p in whole[0]:
        own = {rid: terms for (source, country, rid), terms in held.items() if (source, country) == (p["source"], p["country"])}
        average = sum(map(len, own.values())) / len(own)
        scored = []
        for rid, terms in own.items():
            parts = [max(math.log((len(own) - t["df"] + 0.5) / (t["df"] + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(terms) / average)) for t in p["terms"] if t["term"] in terms]
            if parts and (p["need"] == "any" or len(parts) == len(p["terms"])):
                scored.append((-round(sum(parts), 9), rid))
        brute += [(p["qid"], p["source"], p["country"], p["pass_id"], i + 1, rid, round(-score, 6)) for i, (score, rid) in enumerate(sorted(scored)[:4])]
    assert len(brute) > 500
    assert [x[:6] for x in sorted(brute)] == [x[:6] for x in cells[1]]
    assert all(abs(x[6] - y[6]) < 1e-5 for x, y in zip(sorted(brute), cells[1], strict=True))


def test_overlaps_leave_pairs_under_the_least_share_out_where_they_are_counted(spark):
    from linkloom.operators import overlap

    rng = random.Random(4)
    data = [("en", "a" if i % 4 else "b", i, " ".join(rng.choices("abcdef", k=rng.choice((0, 2, 3))))) for i in range(80)]
    df = spark.createDataFrame(data, "country string, name string, id long, text string")
    sides = df.where("id % 3 = 0"), df.where("id % 3 <> 0")
    whole = overlap.overlaps(*sides, ["country", "name"])
    assert 0 < whole.where("shared < 0.5 * either").count()
    assert rows(overlap.overlaps(*sides, ["country", "name"], least=0.5)) == rows(whole.where("shared >= 0.5 * either"))


def test_retrieval_cells_hold_few_queries_at_once():
    """Statistics of a cell are held once, its queries come some at a time, over any batches."""
    import pyarrow as pa

    from linkloom.operators import retrieval as R

    schema = pa.schema([("qid", pa.int64()), ("source", pa.int32()), ("country", pa.string()), ("field", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("place", pa.int32())])
    rows, want = [], []
    for cell in ("x", "y", "z"):
        stats = [] if cell == "y" else sorted((1 + i % 7, f"{'na'[i % 2]}:{cell}{i}") for i in range(40))
        rows += [(cell, 0, None, None, t, n) for n, t in stats]
        for q in range(30):
            terms = [f"{'na'[i % 2]}:{cell}{i}" for i in range(q, 45, 3)]
            rows.append((cell, 1, q, terms, None, None))
            for field in "na":
                met = [(n, t) for n, t in stats if t in terms and t.startswith(field)][:4]
                want += [(q, 2, cell, field, t, n, i) for i, (n, t) in enumerate(met)]
    names = ["cell", "side", "qid", "terms", "term", "df"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]
    whole = pa.table({n: pa.array(x, t) for n, x, t in zip(names, zip(*rows, strict=True), types, strict=True)})
    whole = whole.append_column("source", pa.array([2] * len(rows), pa.int32())).append_column("country", whole["cell"])
    for size in (1, 7, 1000):
        worked = []

        def work(held, part):
            worked.append(part.num_rows)
            return R._rarest(held, part, 4, schema)

        got = [tuple(r.values()) for b in R._streamed(iter(whole.to_batches(max_chunksize=size)), ["term", "df"], R._stats_of, work, lambda part: 5) for r in b.to_pylist()]
        assert sorted(got) == sorted(want) and max(worked) <= 5
