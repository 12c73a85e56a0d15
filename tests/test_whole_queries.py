"""Queries at production limits, on tables made to need them."""

import random

import __spark_entry__ as entry
from linkloom.functions.similarity import jaro_winkler_of


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_words_of_more_than_50_records_are_met(spark, tmp_path):
    rows = [(0, "en", "qa qb qc qd qe qf zzzz"), *[(3 * i + 1, "en", " ".join(f"n{i}x{j}" for j in range(6)) + f" zzzz u{i}") for i in range(60)]]
    folder = write(spark, tmp_path, rows)
    hits = entry.queries()["pass_hits"](spark, folder).where("pass_id = 'a_any'").collect()
    assert sorted(h.rid for h in hits) == [3 * i + 1 for i in range(60)] and sorted(h["rank"] for h in hits) == list(range(1, 61))


def test_structural_negatives_compare_whole_addresses(spark, tmp_path):
    rng, rows = random.Random(5), []
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    for i in range(6):
        name, address = [word("abcde") for _ in range(6)], [word("fghijkl") for _ in range(12)]
        other = [word("vwxyz") for _ in range(6)]
        near = [*address[:-1], word("fghijkl")]
        # a near address under another name; the same name at another address; an equal record
        rows += [(9 * i, name, address), (9 * i + 1, other, near), (9 * i + 2, name, [word("mnopqr") for _ in range(12)]), (9 * i + 4, name, address)]
    folder = write(spark, tmp_path, [(d, "en", " ".join(n + a)) for d, n, a in rows])
    jw = lambda x, y: jaro_winkler_of(" ".join(x).encode(), " ".join(y).encode())
    pool = {(r.qid, r.tid) for r in entry.queries()["name_jaro_winkler"](spark, folder).collect()}
    near = {(q, f"S{t % 3 + 1}-{t}") for q, n, a in rows if q % 3 == 0 for t, m, b in rows if t % 3 and (n, a) != (m, b) and jw(a, b) >= 0.80 and jw(n, m) < 0.60}
    want = near & pool
    assert want >= {(9 * i, f"S2-{9 * i + 1}") for i in range(6)}
    assert {tuple(r) for r in entry.queries()["structural_negatives"](spark, folder).collect()} == want


def test_features_of_parts_write_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    from linkloom.session import Scratch

    kinds = [("blue ring", "Brand#1", "LARGE", 3), (None, "Brand#1", "LARGE", 3), ("Blue  ring ltd", "Brand#1", "LARGE", 13), ("", "Brand#1", None, None), ("hot bolt", "Brand#1", "LARGE", 3)]
    rows = [(i, *kinds[i % 5]) for i in range(150)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, name, df: (out := table(self, name, df), written.append(out.count()))[0])
    got = {(r.qid, r.tid): r for r in entry.queries()["pair_features_all"](spark, str(tmp_path)).collect()}
    scores = {(r.qid, r.tid): r.score for r in entry.queries()["rule_scores"](spark, str(tmp_path)).collect()}
    block = lambda i: (rows[i][2:4], (rows[i][4] or 10) % 10)
    assert set(got) == set(scores) == {(q, t) for q in range(0, 150, 3) for t in range(150) if t % 3 and block(q) == block(t)}
    assert max(written) <= 150 < len(got)
    # as each pair by itself has them
    from pyspark.sql import functions as F

    from linkloom.operators import features
    from linkloom.plans.records import Records

    r = Records(spark, str(tmp_path))
    views = features.views(r.part_records).select("key", "country", "v")
    met = r.part_queries.select("qid", "block").join(r.part_targets, "block").select("qid", "tid", "rank", "retrieval_score", ((F.col("qid") + F.col("tid")) % 64).cast("int").alias("passes"))
    plain = features.pair_features(features.join_pairs(met, views.withColumnRenamed("key", "qid"), views.withColumnRenamed("key", "tid")))
    for row in plain.select("qid", "tid", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in features.FEATURES]).collect():
        assert row == got[row.qid, row.tid]


def test_equal_records_are_counted_by_class(spark, tmp_path, monkeypatch):
    import duckdb

    from linkloom.operators import evaluate
    from linkloom.plans.records import Records
    from linkloom.session import Scratch
    from tests.test_queries import canonical

    rng = random.Random(8)
    names = ["a b c d e f", "é b c d e f", "one two", ""]
    texts = [f"{n} {' '.join(rng.choices('uvwxyz', k=rng.choice((0, 1, 2, 4, 6))))}".strip() for n in names for _ in range(5)]
    few = [(rng.choice(("en", "fr", None)), rng.choice([*texts, None])) for _ in range(150)]
    rows = [(i, c, t) for i, (c, t) in enumerate([*few, *[("en", f"a b c d e f u v {'w' * (i % 8 == 0)}".strip()) for i in range(300)]])]
    folder = write(spark, tmp_path, rows)
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, name, df: (out := table(self, name, df), written.append(out.count()))[0])
    names = ["f05_per_entity", "macro_f05", "f05_by_country", "f05_by_cardinality", "f05_macro_pr", "cardinality_by_country", "cardinality_bins", "cardinality_drift", "cardinality_histogram", "threshold_grid", "hard_negatives"]
    got = {n: entry.queries()[n](spark, folder).toPandas() for n in names}
    best = entry.queries()["chosen_thresholds"](spark, folder).first().asDict()
    assert max(written) <= len(rows)  # no row for each pair
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for n in names:
        assert canonical(got[n]) == canonical(con.execute(entry.oracle_sql()[n]).df()), n
    r = Records(spark, folder)
    want = evaluate.choose_thresholds(r.references, r.truth, r.scored)
    assert {k: round(x, 9) for k, x in best.items()} == {k: round(x, 9) for k, x in want.items()}


def test_trees_learn_from_classes_of_references(spark, tmp_path, monkeypatch):
    from linkloom.functions import text as X
    from linkloom.operators import features, model
    from linkloom.plans.queries import _part_features
    from linkloom.plans.records import Records
    from linkloom.session import Scratch
    from pyspark.sql import functions as F

    kinds = [("blue ring", "Brand#1", "LARGE", 3), ("Blue Ring", "Brand#1", "LARGE", 3), ("blue ring ltd", "Brand#1", "LARGE", 13), ("hot bolt", "Brand#1", "LARGE", 3), ("", "Brand#1", "LARGE", 13)]
    rows = [(192 * (i // 15) * 5 + i % 15, *kinds[i % 5]) for i in range(180)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, name, df: (out := table(self, name, df), written.append(out.count()))[0])
    got = {(r.qid, r.tid): r for r in entry.queries()["gbt_oof_scores"](spark, str(tmp_path)).collect()}
    name = {k: n.lower() for k, n, *_ in rows}
    assert {k: r.label for k, r in got.items()} == {(q, t): int(name[q] == name[t]) for q in name for t in name if q % 3 == 0 and t % 3}
    assert max(written) < len(got) / 5  # no row for each pair
    # as trees that learn from each pair by itself
    r = Records(spark, str(tmp_path))
    names = r.part_records.select("key", F.lower("name").alias("name"))
    pairs = _part_features(r).join(names.toDF("qid", "qn"), "qid").join(names.toDF("tid", "tn"), "tid")
    pairs = pairs.withColumn("label", (F.col("qn") == F.col("tn")).cast("int")).withColumn("fold", X.hash_bucket(F.col("qid"), buckets=3, seed=1))
    told = [f for f in features.FEATURES if not f.startswith("name_")]
    for row in model.out_of_fold(pairs, told, maxIter=5, maxDepth=3).collect():
        mine = got[row.qid, row.tid]
        assert mine.fold == row.fold and abs(mine.score - row.score) < 1e-4


def test_features_of_retrieved_pairs_carry_no_record_by_pair(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from linkloom.operators import features, pair_cells
    from linkloom.plans.queries import _pairs
    from linkloom.plans.records import Records

    rng, letters = random.Random(11), "abcdeé𝒳1"
    word = lambda: "".join(rng.choices(letters, k=rng.choice((1, 2, 4))))
    texts = ["", "acme ltd", "12345 rd", *[" ".join([*(word() for _ in range(rng.choice((3, 6, 9)))), *rng.choices(("rd", "54321", "77", "x"), k=4)]) for _ in range(37)]]
    folder = write(spark, tmp_path, [(i, rng.choice(("en", "fr", None)), rng.choice(texts)) for i in range(180)])
    monkeypatch.setattr(pair_cells, "QUERIES", 25)
    monkeypatch.setattr(pair_cells, "TARGETS", 35)
    common = pair_cells._common
    got = entry.queries()["pair_features_native"](spark, folder)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    monkeypatch.setattr(pair_cells, "_common", lambda records, rows: {c: x[:3] for c, x in common(records, rows).items()})
    hashed = entry.queries()["pair_features_native"](spark, folder)  # nearly all terms by their hashes
    r = Records(spark, folder)
    q, t = (features.views(side, normalized=True).select(key, "country", "v") for side, key in ((r.references, "qid"), (r.targets, "tid")))
    plain = features.pair_features(features.join_pairs(_pairs(r).select("qid", "tid", "source", "rank", "retrieval_score", "passes"), q, t), edit_based=False)
    plain = plain.select("qid", "tid", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in features.FEATURES if c in plain.columns])
    want = sorted(tuple(x) for x in plain.collect())
    assert len(want) > 500 and got.columns == hashed.columns == plain.columns and got.dtypes == plain.dtypes
    assert sorted(tuple(x) for x in got.collect()) == want == sorted(tuple(x) for x in hashed.collect())


def test_owners_are_chosen_where_pairs_are_counted(spark, tmp_path, monkeypatch):
    import duckdb

    from linkloom.operators import overlap
    from tests.test_queries import canonical

    rng = random.Random(4)
    near, far = "go north by the old mill", "go zzzzzzzzzzzz xxxxxxxxxx qqqqqqqqqqq kkkkkkkkkk jjjjjjjjj"
    words = [f"w{i}" for i in range(12)]
    rows = [(3 * i, "en", f"{far} {' '.join(words[: 12 - i % 3])}") for i in range(40)]  # better scores, names unlike most
    rows += [(3 * i + 600, rng.choice(("en", "fr", None)), f"{rng.choice((near, far))} {' '.join(rng.sample(words, rng.choice((0, 1, 4, 8))))}") for i in range(80)]
    rows += [(3 * i + 1 + i % 2, rng.choice(("en", "fr", None)), f"{rng.choice((near, far))} {' '.join(rng.sample(words, rng.choice((0, 2, 8, 12))))}".strip()) for i in range(200)]
    folder = write(spark, tmp_path, rows)
    monkeypatch.setattr(overlap, "overlaps", None)  # sends every pair on
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = canonical(con.execute(entry.oracle_sql()["country_guard_owner"]).df())
    for most in (1024, 9):
        monkeypatch.setattr(overlap, "ROWS", most)
        assert canonical(entry.queries()["country_guard_owner"](spark, folder).toPandas()) == want and len(want) > 100


def test_words_of_few_and_of_many_pairs_are_counted():
    import numpy as np

    from linkloom.operators import overlap

    rng = np.random.default_rng(3)
    held = rng.random((230, 300)) < np.linspace(0, 0.9, 300)
    rows, words = np.nonzero(held)
    assert (overlap._shared(rows, words, 230, 90) == held[:90].astype(int) @ held[90:].T.astype(int)).all()
