"""The pipeline's stages on a small corpus, each held against a plain version."""

import pytest

from .test_operators import plain_groups, sentences

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def test_pipeline(spark, tmp_path):
    import public_tokenizers

    rows = [(i, sentences(100 + i, 60) + (f"\nboilerplate of the site\nown {i}" if i % 4 == 0 else ""), ["en", "de"][i % 2], "s") for i in range(40)]
    rows += [(50, rows[3][1], "de", "s"), (51, "12345 !!", "en", "s"), (52, None, "en", "s"), (53, sentences(7, 20) + " " + " ".join(f"q{k}" for k in range(12)), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", " ".join(f"Q{k}" for k in range(12)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "bpe":
            assert at.columns == docs.columns
            seen[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {51, 52}
    lined = seen["line_dedup"]
    assert set(lined) == set(seen["language_id"])
    assert all(t == dict((r[0], r[1]) for r in rows)[i].replace("\nboilerplate of the site", "") for i, t in lined.items())
    _, root = plain_groups(list(lined.items()), 80)
    assert set(seen["near_dup"]) == {i for i in lined if root[i] == i} and 50 not in seen["near_dup"]
    assert set(seen["decontamination"]) == set(seen["near_dup"]) - {53}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in seen["decontamination"].items()}


def test_pipeline_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows and null ids, and columns named like the operators' own."""
    spark.createDataFrame([("b", " ".join(f"Q{k}" for k in range(12)))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kind = "doc_id long, text string, lang string, source string, n_chars long, score int, lang_pred string, n_removed int, _kept string, _host string, n_words int, k1 int"
    more = (1, "x", 2, "k", "h", 3, 4)
    rows = [(i, sentences(200 + i, 40), "en", "s", 9, *more) for i in range(12)] + [(3, sentences(203, 40), "en", "s", 9, *more), (None, sentences(300, 40), "en", None, None, *more), (None, " ".join(f"q{k}" for k in range(12)), "en", "s", 9, *more)]
    for some, left in (([], 0), (rows, 14)):  # the last goes for the benchmark's words; the repeated row is one document with its twin
        at = spark.createDataFrame(some, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == spark.createDataFrame([], kind).columns, name
        assert at.count() == left and corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == left
