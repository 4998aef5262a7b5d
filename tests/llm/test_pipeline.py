import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DATA
from pulsetally.llm.secret_scan import ALLOW, _rules, find_secrets, redact
from pulsetally.llm.tokens import word_bpe_path
from support import no_documents, odd_documents
from test_jaccard_join import brute

@pytest.fixture(scope="module")
def stages(spark, table):
    """What every stage kept, and the documents at the start."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, str(DATA)), "stage")
        kept[name] = docs
    return {k: sorted(v.collect(), key=lambda r: r.doc_id) for k, v in kept.items()}


def test_toxic_documents_go(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 0").collect()}
    kept = {r.doc_id for r in stages["toxicity"]}
    assert len(toxic - kept) >= 0.7 * len(toxic) and len(clean & kept) >= 0.9 * len(clean)


def test_one_of_near_copies_stays(stages):
    before = stages["toxicity"]
    groups = brute([r.text for r in before], 5, 80)
    assert stages["near copies"] == [before[i] for i, _, root in sorted(groups) if i == root]


def test_benchmark_items_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in stages["near copies"]} - {r.doc_id for r in stages["decontamination"]}
    holds = {r.doc_id for r in stages["near copies"] if any(i in r.text for i in items)}
    assert holds <= gone and len(gone) <= len(holds) + 2


def test_secrets_are_masked(stages):
    pattern, values = _rules(ALLOW, ())
    for old, new in zip(stages["decontamination"], stages["secrets"], strict=True):
        assert new.text == redact(old.text, find_secrets(old.text, pattern, values), "[SECRET]")
        assert new.n_chars == len(new.text) and new.source == old.source


def test_packing_holds_every_id(stages):
    whole = Tokenizer.from_file(word_bpe_path())
    pieces = {}
    for r in stages["packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc in stages["secrets"]:
        own = sorted(pieces[doc.doc_id], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == [*whole.encode(doc.text, add_special_tokens=False).ids, 2]


def test_run_is_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in stages["packing"])


def test_odd_documents(spark, tmp_path):
    folder = str(tmp_path)
    odd = odd_documents(spark)
    spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            docs = corpus_pipeline.stash(out, "stage")
        assert docs.count() == (odd.count() - 1 if docs.count() else 0)
        corpus_pipeline.pack(spark, docs, folder).collect()
