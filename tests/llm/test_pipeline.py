"""The stages against plain versions, each on what the stage before it kept; the registered queries."""

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from capital_access.llm import decontaminate, quality_ranker, secret_scan
from tests.llm.test_simhash_dedup import groups, plain_fingerprint
from tests.llm.test_source_mixing import plain_count
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark, small):
    docs = {r.doc_id: r for r in small("documents").collect()}
    model = quality_ranker.fit_quality(small("documents"), small("labels"))
    kept = [i for i, r in docs.items() if model.score(quality_ranker.text_features(r.text)[None])[0] >= 0.3]
    prints = {i: plain_fingerprint(docs[i].text) for i in kept}
    root, least = groups(set(prints.values()), 2), {}
    for i in sorted(kept):
        least.setdefault(root[prints[i]], i)
    searches = decontaminate.build_searches([(str(r.item_id), r.text) for r in small("benchmark").collect()], 13)
    clean = []
    for i in least.values():
        n, stretches, _ = decontaminate.hits_in(docs[i].text, searches)
        hit = sum(b - a for a, b in stretches)
        if not (hit and 20 * hit >= n):
            clean.append(i)
    texts = {i: secret_scan.redacted(docs[i].text) for i in clean}
    size = {}
    for i, t in texts.items():
        size[docs[i].source] = size.get(docs[i].source, 0) + max(1, len(t))
    roots = sum(s ** 0.5 for s in size.values())
    expected = {(i, copy): (t, len(t)) for i, t in texts.items()
                for copy in range(1, plain_count(size[docs[i].source] ** 0.5 / roots * sum(size.values()) / size[docs[i].source], i) + 1)}
    got = {(r.doc_id, r.copy): (r.text, r.n_chars) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected and 0 < len(clean) < len(least) < len(kept) < len(docs)


def test_stages_take_empty_tables_and_keep_columns(spark, docs):
    text = "Plain words stand in this sentence, and others follow it here."
    odd = docs([(None, None), (1, ""), (2, text), (2, text), (3, text + " more")]).withColumns({"score": F.lit(1), "hits": F.lit(2), "copy": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        for df in (odd, odd.where("false")):
            out = stage(spark, df, SF)
            assert out.columns[:len(df.columns)] == df.columns
            rows = out.collect()
            assert (len(rows) == 0) <= (df is not odd or name == "quality_classifier")
            if name != "source_mixing":
                assert out.columns == df.columns


def test_registered():
    names = [k for k in entry_module.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", [k for k in entry_module.oracle_sql() if k.startswith("op")])
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF), SF, entry_module.queries()[name], entry_module.oracle_sql()[name]) == ""
