"""The pipeline stage by stage, its registration, and planted cases."""

import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from clickloom.llm.queries import ORACLES, QUERIES
from clickloom.session import scratch_path
from tests.conftest import SMALL


def test_registration():
    found = queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) <= set(found) and set(ORACLES) <= set(oracle_sql())


@pytest.fixture(scope="module")
def planted(spark):
    """The small tables with copies, junk and leaks added, in a folder of their own."""
    rnd = random.Random(3)
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    bench = pq.read_table(f"{SMALL}/benchmark.parquet").to_pandas()
    good = pq.read_table(f"{SMALL}/labels.parquet").to_pandas().query("quality == 1 and toxic == 0").doc_id
    words = [w for w in " ".join(docs[docs.doc_id.isin(good) & (docs.lang == "en")].text).split() if w.strip(".,").isalpha()]
    fresh = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    clean = {5000 + i: fresh(150) for i in range(20)}
    more = dict(clean)
    w = clean[5000].split()
    w[75] = "changed"
    more[6000] = clean[5001]  # exact copy
    more[6001] = " ".join(w)  # near copy
    more[7000] = f"{fresh(80)} {bench.text[0]} {fresh(40)}"
    more[8000] = fresh(150).replace(" ", "### ")
    rows = [(int(r.doc_id), r.text, r.lang, r.source, int(r.n_chars)) for r in docs.itertuples()]
    rows += [(k, t, "en", "src1", len(t)) for k, t in more.items()]
    rows += [(None, None, None, None, None), (9000, "", "en", "src1", 0)]
    path = scratch_path(spark, "planted")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path, clean


def test_stages(spark, planted):
    path, clean = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch_path(spark, "stage")
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        assert docs.columns == columns or number == len(corpus_pipeline.STAGES) - 1
        assert number == 0 or set(kept[-1]) <= set(kept[-2])
    rules, classifier, copies, leaks, tokens = kept
    assert 8000 not in rules and 9000 not in rules and None not in rules
    assert 6000 in classifier and 6000 not in copies and 6001 not in copies
    assert 7000 in copies and 7000 not in leaks
    assert set(clean) <= set(leaks) and sorted(tokens) == sorted(leaks)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    row = docs.filter("doc_id = 5003").first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == lib.encode(clean[5003], add_special_tokens=False).ids
    whole = corpus_pipeline.run(spark, path).select("doc_id", "ids_sha256").collect()
    assert sorted(map(str, whole)) == sorted(map(str, docs.select("doc_id", "ids_sha256").collect()))
