"""The pipeline's stages, each on its own input, against brute-force versions and the operators' verdicts."""

import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline as pipeline
from test_corpus_ops import SCHEMA, brute_windows, frame, packed_well

from tolera.llm import quality, rules, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input of each stage and the last one's result, over the smallest table."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, f) in enumerate(pipeline.STAGES):
        out.append(docs)
        to = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, SF).write.parquet(to)
        docs = spark.read.parquet(to)
    return [*out, docs]


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_columns_and_shrinking(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == list(pipeline.COLUMNS) and ids(after) <= ids(before)
    assert ids(stages[5]) == ids(stages[4])


def test_filters_follow_the_verdicts(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(stages[1]) == ids(quality.judge(stages[0], labels).where("kept"))
    assert ids(stages[2]) == ids(rules.judge(stages[1]).where("kept"))


def test_one_document_of_each_group_stays(stages):
    groups = simhash.similar(stages[2]).collect()
    assert ids(stages[3]) == {r["component_id"] for r in groups}
    texts = [r["text"] for r in stages[3].collect()]
    assert len(set(texts)) == len(texts)


def test_repeats_go(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    want = brute_windows(before.items(), 20)
    got = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if not n or gone < n}
    for i, r in got.items():
        assert r["text"] == (want[i][2] if want[i][1] else before[i])
        assert r["n_chars"] == (len(r["text"]) if want[i][1] else r["n_chars"])


def test_packing_of_the_rest(stages):
    packed_well(stages[5].collect(), [(r["doc_id"], r["text"]) for r in stages[4].collect()])


def test_run_gives_the_last_stage(spark, stages):
    got = pipeline.run(spark, SF)
    assert got.columns == stages[5].columns and got.count() == stages[5].count()


def test_empty_and_odd_documents(spark):
    for docs in (spark.createDataFrame([], SCHEMA), frame(spark, [(None, None), (1, "a b c " * 20), (1, "a b c " * 20), (None, "fine words stand here in a row of their own today"), (3, "")])):
        for _, f in pipeline.STAGES:
            f(spark, docs, SF).count()


def test_one_row_stays_of_repeated_and_null_ids(spark):
    prose = lambda k: " ".join(f"{k}{j}" for j in range(60))
    docs = [(1, prose("a")), (1, prose("b")), (1, prose("b")), (2, prose("a")), (5, prose("c")), (5, prose("c") + " end"), (None, prose("c")), (None, prose("d")), (None, prose("d")), (None, prose("e")), (9, prose("e"))]
    got = [(r["doc_id"], r["text"]) for r in pipeline.simhash_dedup(spark, frame(spark, docs), SF).collect()]
    (c,) = [x for x in got if x[0] == 5]
    assert c in docs  # of one id, any of the two near copies
    assert sorted(got, key=str) == sorted([(1, prose("a")), (1, prose("b")), c, (None, prose("d")), (9, prose("e"))], key=str)


def test_repeats_go_row_by_row(spark):
    """Rows of an id keep their own texts; null ids have verdicts too."""
    prose = lambda k, n=30: " ".join(f"{k}{j}" for j in range(n))
    docs = [(1, prose("a")), (2, prose("a") + " tail one"), (2, prose("b")), (2, prose("b") + " tail two"), (3, prose("c")), (3, prose("a")), (4, None), (None, prose("e", 40) + " " + prose("e", 40)), (None, prose("f"))]
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.substring_dedup(spark, frame(spark, docs), SF).collect()), key=str)
    verdicts = pipeline.substring.removed(frame(spark, docs)).collect()
    assert sorted(((r["doc_id"], r["text"] if r["text"] or r["n_words"] else None) for r in verdicts if not r["n_words"] or r["n_removed"] < r["n_words"]), key=str) == got
    assert {(1, prose("a")), (2, "tail one"), (2, prose("b")), (3, prose("c")), (4, None), (None, prose("e", 40)), (None, prose("f"))} <= set(got) and (3, prose("a")) not in got
