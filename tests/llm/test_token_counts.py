from flowloom.llm import token_counts as t
from tests.llm.helpers import ODD_TEXTS, docs, documents


def direct(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=t.piece_model())
    return [len(model.encode(x)) if x else 0 for x in texts]


def test_proof_holds_and_shortcut_is_used():
    known = t.vocabulary(t.piece_model())
    assert known.proven and known.lines
    assert known.whole["the"] == 1 and len(known.whole) > 10_000


def test_query_matches_library(spark, small):
    rows = documents(small)
    want = dict(zip((r["doc_id"] for r in rows), direct([r["text"] for r in rows]), strict=True))
    got = t.op7_token_counts(spark, small).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r["doc_id"]: len(r["text"].encode()) for r in rows}


def test_odd_texts(spark):
    more = [*ODD_TEXTS, "\n", "a\n\nb \n c\n", "\nab", "  a", "a  ", " a ", "▁▁a", "日本語 テスト 🙂", "a\n b", "1234 5678", "x\ny"]
    got = t.count_tokens(docs(spark, more), t.piece_model()).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == direct(more)


def test_empty_table_and_clashing_column(spark):
    empty = docs(spark, []).withColumnRenamed("lang", "n_tokens")
    assert t.count_tokens(empty, t.piece_model()).count() == 0


def test_table_of_kept_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(t, "KEPT", 3)
    known = t.Vocabulary(t.piece_model())
    texts = [" ".join(f"zq{i}x\nk{i}" for i in range(50))] * 2
    assert [known.count(x) for x in texts] == direct(texts)
