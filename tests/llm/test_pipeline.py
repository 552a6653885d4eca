"""The pipeline as a whole: each stage against a brute-force version on the stage's own input."""

import hashlib
import re

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with copies, near copies, toxic and leaking texts, null and empty ones, and a column more."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    benchmark = [(k, text(40)) for k in range(12)]
    rows = [(i, text(80)) for i in range(60)]
    near = rows[7][1].split()
    near[40] = "changed"
    rows += [(100, rows[3][1]), (101, "  " + rows[3][1].replace(" ", "\n") + " "), (102, " ".join(near)), (103, None), (104, ""), (105, " \t")]
    rows += [(110 + k, text(30) + " " + benchmark[k][1] + " " + text(30)) for k in range(3)]
    rows += [(200 + k, "you nasty fool idiot " * (10 + k) + text(5)) for k in range(60)]
    labels = [(i, 1, int(i >= 200)) for i, _ in rows if i < 60 or i >= 200]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), dict(rows)


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).toPandas().astype(object).where(lambda x: x.notna(), None), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept["toxicity"] == {i for i in texts if i < 200}
    bare = {}
    for i in kept["toxicity"]:
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i] or "")
        bare.setdefault(key, []).append((-len(texts[i] or ""), i))
    assert kept["exact_dedup"] == {min(x)[1] for x in bare.values()}
    assert kept["ngram_jaccard_join"] == kept["exact_dedup"] - {102}
    assert kept["decontamination"] == kept["ngram_jaccard_join"] - {110, 111, 112}


def test_run(spark, folder):
    from tokenizers import Tokenizer

    from changelens.llm import bpe

    path, texts = folder
    tool = Tokenizer.from_file(bpe.default_file())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    want = {i for i in range(60) if i != 3} | {101, 105}
    assert set(got) == want
    for i in want:
        ids = tool.encode(texts[i] or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_last_stage_has_smaller_blocks(spark, monkeypatch):
    """Its workers keep what the stages before took."""
    from changelens.llm import bpe

    asked, own = [], bpe.round_trip
    monkeypatch.setattr(bpe, "round_trip", lambda docs, **options: asked.append(options) or own(docs, **options))
    corpus_pipeline.tokenise(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert asked[0]["block_bytes"] < bpe.BLOCK_BYTES / 3
