"""The registered corpus queries and the pipeline on the small tables."""

import os

import pytest

import corpus_pipeline
from tidewatch.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


def _plain(frame):
    return sorted(tuple(str(None if v is None or v != v else v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)


def test_pipeline_stages_decide_as_their_operators_say(spark):
    import sentencepiece

    from tidewatch.llm import decontaminate, ngram_join, piece_bpe, quality
    from tidewatch.llm.fitting import remainder

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, seen = {}, {"start": {r["doc_id"] for r in docs.select("doc_id").collect()}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    machine = quality.train(raw, spark.read.parquet(f"{SF}/labels.parquet"), remainder("doc_id", 5) != 0)
    assert set(kept["quality"]) == {r["doc_id"] for r in quality.score(raw, machine).where("predicted = 1").collect()} <= seen["start"]
    frame = lambda x: spark.createDataFrame(list(x.items()), "doc_id long, text string")
    assert set(kept["near_duplicates"]) == {r["component_id"] for r in ngram_join.near_duplicates(frame(kept["line_dedup"])).collect()}
    items = decontaminate.split_items(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(frame(kept["near_duplicates"]), items).collect()}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - leaks
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    last = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    assert last == {k: len(library.encode(v)) for k, v in kept["decontamination"].items()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == last


def _write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(d[0], 1, 0) for d in docs if d[0] is not None and d[0] % 4 == 0]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All labels are good, so the classifier keeps everything; the other stages follow from plain loops."""
    import random

    import sentencepiece

    from tests.llm.test_corpus_operators import _components, _corpus
    from tidewatch.llm import piece_bpe

    rng = random.Random(12)
    line = "this very long boilerplate line stands in many documents of ours"
    items = [(k, f"{' '.join(f'q{k}x{rng.randrange(50)}' for _ in range(25))}? {' '.join(f'a{k}y{j}' for j in range(6))}.") for k in range(5)]
    texts = dict(_corpus(3, 15))
    n = len(texts)
    texts |= {n + k: f"{line}\nown words {' '.join(f'o{k}z{j}' for j in range(30))}" for k in range(8)}
    texts |= {n + 20 + k: f"before {' '.join(f'b{k}z{j}' for j in range(20))} {items[k][1]} after" for k in range(5)}
    docs = [(k, t, "en", "web", len(t or "")) for k, t in texts.items()]
    docs += [docs[0], (None, items[0][1], "en", "web", 1), (None, "a text without any number", "en", "web", 1), (n + 90, "", None, None, None)]
    _write(spark, tmp_path, docs, [*items, (9, None)])
    # lines
    holders = {k for k, t in texts.items() if t and line in t}
    kept = {k: t if k not in holders or k == max(holders) else "\n".join(x for x in t.split("\n") if x != line) for k, t in texts.items()} | {n + 90: ""}
    heads = {k for k, (_, c) in _components(list(kept.items())).items() if k == c}
    leaks = {n + 20 + k for k in range(5)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    want = sorted((str(k), len(library.encode(kept[k] or ""))) for k in heads - leaks)
    want = sorted([*want, ("None", len(library.encode("a text without any number"))), *[w for w in want if w[0] == str(docs[0][0])]])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
