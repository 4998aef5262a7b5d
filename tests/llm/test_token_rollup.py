import pytest
from tokenizers import Tokenizer

from pulsetally.llm.token_rollup import TokenRollup, count_tokens, signed
from pulsetally.llm.tokens import word_bpe_path
from pulsetally.session import shared_dir
from support import no_documents, odd_documents

CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long, old_source string, docs string"


def rows(frame):
    return sorted(map(tuple, frame.select("source", "lang", "tokenizer", "docs", "tokens").collect()), key=repr)


def test_signed_changes_add_up(spark):
    rollup = TokenRollup(spark, shared_dir(spark, "rollup"))
    assert rollup.totals().collect() == []
    first = spark.createDataFrame(
        [("insert", "a", "en", "t1", 5, None, None, "x")] * 3 + [("insert", None, None, "t1", None, None, None, "x")], CHANGES
    )
    second = spark.createDataFrame(
        [("delete", "a", "en", "t1", 5, None, None, "x"), ("revise", "b", "en", "t2", 9, 5, "a", "x")], CHANGES
    )
    rollup.commit("1", first)
    rollup.commit("2", second)
    # old_tokenizer is missing, so the revision takes the document out of version t2 of source a.
    expected = [("a", "en", "t1", 2, 10), ("a", "en", "t2", -1, -5), ("b", "en", "t2", 1, 9), (None, None, "t1", 1, 0)]
    assert rows(rollup.totals()) == sorted(expected, key=repr)
    for _ in range(2):
        rollup.commit("2", second)
    assert rows(rollup.totals()) == sorted(expected, key=repr)
    rollup.commit("3", first.limit(0))
    rollup.commit("4", spark.createDataFrame([("delete", "a", "en", "t1", 5, None, None, "x")] * 2, CHANGES))
    assert ("a", "en", "t1", 0, 0) not in rows(rollup.totals()) and len(rows(rollup.totals())) == 3


def test_half_written_batch_counts_once(spark):
    path = shared_dir(spark, "rollup")
    rollup = TokenRollup(spark, path)
    change = spark.createDataFrame([("insert", "a", "en", "t", 5)], "op string, source string, lang string, tokenizer string, tokens long")
    rollup.commit("1", change)
    # What a lost try of the same batch may have left behind.
    rollup.deltas().drop("batch").write.mode("append").parquet(f"{path}/deltas/batch=1")
    rollup.commit("1", change)
    assert rows(rollup.totals()) == [("a", "en", "t", 1, 5)]


def test_stream_batches_of_two_runs(spark):
    rollup = TokenRollup(spark, shared_dir(spark, "rollup"))
    change = spark.createDataFrame([("insert", "a", "en", "t", 5)], "op string, source string, lang string, tokenizer string, tokens long")
    for run, number in (("x", 0), ("x", 0), ("y", 0), ("x", 1)):
        rollup.on_stream(run)(change, number)
    assert rows(rollup.totals()) == [("a", "en", "t", 3, 15)]


def test_unknown_change_is_an_error(spark):
    frame = spark.createDataFrame([("merge", "a", "en", "t", 5)], "op string, source string, lang string, tokenizer string, tokens long")
    with pytest.raises(Exception, match="unknown change: merge"):
        signed(frame).collect()


def test_counts(spark):
    odd = odd_documents(spark)
    whole = Tokenizer.from_file(word_bpe_path())
    got = sorted(((r.doc_id, r.n_tokens) for r in count_tokens(odd, word_bpe_path(), ["doc_id", "key"]).collect()), key=repr)
    expected = [(r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert got == sorted(expected, key=repr)
    assert count_tokens(no_documents(spark), word_bpe_path(), ["doc_id"]).count() == 0


def test_query_against_final_state(spark, table):
    """The totals of the query are those of the documents that are left at its end."""
    import re
    from collections import Counter

    from conftest import DATA
    from pulsetally.llm.queries import op4_token_rollup

    whole = Tokenizer.from_file(word_bpe_path())
    first = {}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    for r in docs:
        first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    n, total = Counter(), Counter()
    for r in docs:
        if r.doc_id == first[r.text]:
            words = [w for w in re.findall("[^ \t\n\x0b\f\r]+", r.text) if re.search(r"[^\W_]", w)]
            for name, count in (("word_bpe_49k/1", len(whole.encode(r.text, add_special_tokens=False).ids)), ("words/2", len(words))):
                n[r.source, r.lang, name] += 1
                total[r.source, r.lang, name] += count
    expected = sorted((*k, n[k], total[k]) for k in n)
    assert rows(op4_token_rollup(spark, str(DATA))) == expected
