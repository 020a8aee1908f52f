"""The pipeline against plain versions of its stages, and the contract of its queries."""

import hashlib
import inspect

import public_tokenizers
from test_operators import WORD, plain_components, plain_hits, plain_passages
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from linkloom.llm import toxicity
from linkloom.llm.queries import QUERIES


def test_names():
    numbers = sorted(int(name[2:].split("_")[0]) for name in contract.queries() if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()
    assert set(QUERIES) <= set(contract.queries())
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def without(text, words):
    """The text without some words, by plain search."""
    kept, at = "", 0
    spots = list(WORD.finditer(text))
    for i, spot in enumerate(spots):
        end = spots[i + 1].start() if i + 1 < len(spots) else len(text)
        if i not in words:
            kept += text[spot.start() : end]
        elif i + 1 == len(spots):
            kept += text[spot.end() :]
    return text[: spots[0].start()] + kept if kept.strip(" \t\n\v\f\r") else ""


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model).orderBy("doc_id").collect()
    left = [(r.doc_id, r.text) for r in scored if r.score < corpus_pipeline.TOXIC]
    assert 0.8 * len(scored) < len(left) < len(scored)

    groups = plain_components([t for _, t in left], 5, 80)
    left = [row for row, (i, _, c) in zip(left, groups) if i == c]

    _, copies = plain_passages([t for _, t in left], 50)
    left = [(d, without(t, copies[i]) if copies[i] else t) for i, (d, t) in enumerate(left)]
    left = [(d, t) for i, (d, t) in enumerate(left) if t or not copies[i]]

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = plain_hits([t for _, t in left], items)
    left = [row for row, (n, hit, _) in zip(left, hits) if not (hit and 20 * hit >= n)]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in left]
    found = corpus_pipeline.run(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.doc_id, list(r.ids)) for r in found] == expected
    assert all(r.n_tokens == len(r.ids) for r in found)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString(), name
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() == 2
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Copies, passages and benchmark items go, whether ids are null, repeated or neither."""
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one, two, three, four = (" ".join(f"{c}{(i * i + k) % 97}" for i in range(90)) for k, c in enumerate("abcd"))
    item_text = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([("b1", item_text)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda *rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = lambda stage, *rows: sorted(((r.doc_id, r.text) for r in stage(spark, frame(*rows), str(tmp_path)).collect()), key=str)
    found = kept(corpus_pipeline.drop_near_duplicates, (None, one), (None, one), (7, two), (7, two), (7, three), (8, four), (None, four))
    assert found == sorted([(None, one), (7, two), (7, three), (8, four)], key=str)
    for ids in ((None, None), (5, None), (6, 6)):
        rows = [(ids[0], two + " " + one), (ids[1], three + " " + one)]
        texts = [t for _, t in kept(corpus_pipeline.cut_repeated_passages, *rows)]
        assert len(texts) == 2 and sum(one in t for t in texts) == 1
        assert kept(corpus_pipeline.drop_contaminated, (ids[0], item_text), (ids[1], four)) == [(ids[1], four)]


def test_held_out_documents_teach_nothing(spark, sf_dir):
    """Whatever the held-out rows say, the results stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    one, two = (toxicity.fit(docs, rows.where(~toxicity.held_out())) for rows in (labels, turned))
    digest = lambda m: hashlib.sha256(m.weights.tobytes()).hexdigest()
    assert digest(one) == digest(two)
