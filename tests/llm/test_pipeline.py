"""The corpus pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from tests.llm.test_llm import DOCS, brute_components, brute_dedup, corpus, table  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = corpus(11, 90) + ["you are an idiot and a moron, stupid scum " * 3] * 2
    table(spark, texts).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("idiot" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
        after = [(r.doc_id, getattr(r, "text", None)) for r in rows]
        if name == "toxicity":
            assert set(after) <= set(before)
        elif name == "ngram_jaccard_join":
            want = brute_components([t for _, t in before])
            assert sorted(i for i, _ in after) == sorted(before[i][0] for i, (_, c) in want.items() if i == c)
        elif name == "substring_dedup":
            want = brute_dedup(before)
            assert {i: " ".join(t.encode().decode().split()) for i, t in after} == {i: " ".join(k.split()) for i, (_, _, k) in want.items() if k}
        elif name == "source_mixing":
            assert max(Counter(i for i, _ in after).values()) <= 2 and {i for i, _ in after} <= {i for i, _ in before}
        else:
            assert {i for i, _ in after} == {i for i, _ in before}
        docs = spark.createDataFrame(rows, out.schema)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size int"


def odd_rows():
    rng = random.Random(12)
    said = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4)]
    near = said[0].split()
    near[30] = "changed"
    rows = [(1, said[0]), (1, said[0]), (1, said[1]), (None, " ".join(near)), (None, said[2]), (None, said[2]), (5, None), (5, None), (6, ""), (7, " \n"), (8, said[3] + " " + " ".join(f"x{i}" for i in range(4000)))]
    return [(i, t, "en", "s" if t else None, len(t or ""), "clash", "clash", 1) for i, t in rows]


def test_stages_with_odd_rows(spark, tmp_path):
    """Null ids, shared ids, repeated rows, null, blank and very long texts, columns named like results."""
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    spark.createDataFrame([(100, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))

    scored = stages["toxicity"](spark, docs, str(tmp_path))
    assert scored.columns == docs.columns and set(rows(scored)) <= set(rows(docs))

    one = stages["ngram_jaccard_join"](spark, docs, str(tmp_path))
    all_rows = odd_rows()
    # the near copy without an id goes for the row with one; equal rows become one; blank texts all stay
    want = [all_rows[i] for i in (0, 2, 4, 6, 7, 8, 9, 10)]
    assert one.columns == docs.columns and rows(one) == sorted(map(str, want))

    cut = stages["substring_dedup"](spark, docs, str(tmp_path))
    assert cut.columns == docs.columns and all(r.text and r.n_chars == len(r.text) for r in cut.collect())

    mixed = stages["source_mixing"](spark, docs, str(tmp_path))
    n = sum(len((r[1] or "").split()) for r in all_rows)
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in mixed.collect()) == pytest.approx(1.5 * n, abs=1)

    packed = stages["best_fit_packing"](spark, docs, str(tmp_path))
    assert len({r.doc_id for r in packed.collect()}) == len({r[0] for r in all_rows})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
