import corpus_pipeline as c
import pytest
from pyspark.sql import functions as F

from flowloom.llm import common, decontaminate, near_duplicates, quality
from tests.llm.helpers import docs
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_duplicates import brute as groups
from tests.llm.test_packing import check_places, direct
from tests.llm.test_secrets import brute as findings


def plain_redaction(text):
    out, at = "", 0
    for _, a, b in findings(text):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, b)
    return text if not out else out + text[at:]


def test_run_equals_stages_by_brute_force(spark, small):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{small}/documents.parquet").to_pylist()
    frame = spark.read.parquet(f"{small}/documents.parquet")
    good = {r.doc_id for r in quality.score(frame, quality.train(frame, quality.quality_labels(spark, small))).where("score >= 0.5").collect()}
    left = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in good]
    assert 0 < len(left) < len(rows)
    stays = {i for i, _, least in groups(left) if i == least}
    left = [x for x in left if x[0] in stays]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    judged = hits(left, items)
    left = [(i, plain_redaction(t)) for i, t in left if not judged[i][4]]
    got = c.run(spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == direct(left)
    check_places(got)


def test_stages_return_the_columns_of_documents(spark, small):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, frame, small).schema.simpleString() == frame.schema.simpleString()


def test_stages_take_empty_and_odd_tables(spark, small):
    odd = docs(spark, [None, "", "password=abcdefghijkl", "a b c d e f g", "a b c d e f g", "A b c d e f g"])
    for name, stage in c.STAGES:
        assert stage(spark, docs(spark, []), small).count() == 0, name
        assert stage(spark, odd, small).count() >= 3 or name == "quality_classifier", name
    texts = {r.doc_id: r.text for r in c.secrets_redacted(spark, odd, small).collect()}
    assert texts[0] is None and texts[1] == "" and texts[2] == "[REDACTED]"


def test_passages_of_long_documents_are_removed(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    words = decontaminate.normal_words(item.encode())
    passage = " ".join(w.decode() for w in words[: max(13, len(words) // 4)])
    rest = " ".join(f"wörd{i}" for i in range(40 * len(words)))
    texts = [f"{rest} {passage} {rest}", f"{passage}; {rest} ü {passage.upper()}", rest, passage, None]
    frame = docs(spark, texts).withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r.doc_id: r for r in c.without_benchmark(spark, frame, small).collect()}
    assert got[0].text == f"{rest} [REMOVED] {rest}" and got[1].text == f"[REMOVED]; {rest} ü [REMOVED]"
    assert sorted(got) == [0, 1, 2, 4] and got[2].text == rest and got[4].text is None
    assert all(r.n_chars == len(r.text) for i, r in got.items() if i < 2)
    again = decontaminate.scan(spark.createDataFrame(list(got.values()), frame.schema), spark.read.parquet(f"{small}/benchmark.parquet"))
    assert {r.n_hit for r in again.collect()} == {0}


def test_stages_keep_columns_of_any_name(spark, small):
    names = ["spans", "blob", "__blob", "__spans", "items", "n_words", "n_hit", "hits", "hit_spans", "contaminated", "__found", "__found_n_hit", "__score", "score", "__id", "__key", "__state", "__salt", "a.b", "a`b", "part", "class", "label", "chance"]
    frame = docs(spark, ["token: abcdefghijklmnop and more words", "a b c d e f g", "a b c d e f g", None])
    frame = frame.select("*", *(F.lit(i).alias(x) for i, x in enumerate(names)))
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, frame, small)
        assert out.columns == frame.columns, name
        for r in out.collect():
            assert [r[x] for x in names] == list(range(len(names))), name
    assert stage is c.secrets_redacted and c.STAGES[-1][1](spark, frame, small).count() == 4


@pytest.mark.parametrize("size", [16 << 20, -1])
def test_one_of_each_group_stays(spark, size, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "A b c d e f g"), (2, "a b c d e f g"), (2, "quite another text here now"), (3, ""), (4, ""), (None, "a b c d e f g"), (None, "none but null ids in here"), (None, "none but null ids in here"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in near_duplicates.without_near_duplicates(frame).collect()), key=repr)
    assert got == sorted([(1, "a b c d e f g"), (2, "quite another text here now"), (3, ""), (4, ""), (5, ""), (None, "none but null ids in here")], key=repr)
