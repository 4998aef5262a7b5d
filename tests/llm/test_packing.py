import numpy as np
import pytest
from tokenizers import Tokenizer

from pulsetally.llm.packing import best_cuts, binary_parts, pack_documents
from pulsetally.llm.tokens import ChunkTokenizer, word_bpe_path
from support import documents, no_documents, odd_documents


def cost(places, fees, size, cuts):
    lengths = [places[b] - places[a] for a, b in zip(cuts, cuts[1:])]
    assert cuts[0] == 0 and cuts[-1] == len(places) - 1
    assert all(0 < n <= size for n in lengths)
    return sum(size - n for n in lengths[:-1]) + sum(fees[j] for j in cuts[1:-1])


def test_best_cuts_against_quadratic_search():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 40))
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 12, n))))
        fees = rng.integers(0, 6, n + 1)
        best = [0] * (n + 1)
        for j in range(1, n + 1):
            last = j == n
            best[j] = min(
                best[i] + (0 if last else 20 - (places[j] - places[i]) + fees[j])
                for i in range(j) if places[j] - places[i] <= 20
            )
        assert cost(places, fees, 20, best_cuts(places, fees, 20)) == best[n]


def test_binary_parts():
    assert binary_parts(13) == [8, 4, 1]
    assert binary_parts(4096) == [4096]


@pytest.mark.parametrize(
    "text",
    ["", " \n\t ", "It's DON'T. Ünïcode, ß İ. ΑΣ. x", "a\x1cb \x1f", "<|endoftext|> x<|startoftext|>.", "é é. é",
     "٣٤. 12, 中文. 한국어", "a​b. c　d", "ſ ŉ, ǰ. K Ǆ ɐ", "ab... x., 's. --", "w" * 300 + "."],
)
def test_chunk_tokenizer_equals_the_tokenizer(text):
    whole = Tokenizer.from_file(word_bpe_path())
    mine = ChunkTokenizer(word_bpe_path())
    for t in (text, text * 2):
        assert mine.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids
        assert mine.count(t) == len(mine.ids(t))


def unpacked(rows, size):
    """Pieces -> ids of documents (by sequence order), after checking the sequences."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at <= size
    return [sum(p.length for p in pieces) for pieces in sequences.values()]


def test_every_id_once(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["on", "the", "river.", "Stone", "a,", "bright!"], int(n))) for n in rng.integers(0, 400, 300)]
    rows = pack_documents(documents(spark, texts).repartition(3), word_bpe_path(), size=256).collect()
    whole = Tokenizer.from_file(word_bpe_path())
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert {r.doc_tokens for r in own} == {len(ids)}
    used = unpacked(rows, 256)
    padding = sum(256 - n for n in used if n & (n - 1))
    assert padding < 0.05 * sum(used)


def test_odd_documents(spark):
    rows = pack_documents(odd_documents(spark).coalesce(1), word_bpe_path()).collect()
    unpacked(rows, 4096)
    assert sum(r.length for r in rows if r.doc_id == 2) == 1
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * sum(r.length for r in rows if r.doc_id == 5)
    assert sum(r.length for r in rows if r.doc_id == 3) == 30_003
    assert any(r.doc_id is None for r in rows)
    assert pack_documents(no_documents(spark), word_bpe_path()).collect() == []
