"""The pipeline on small tables, against plain Python for each decision."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import segmentations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    good = ["the quick brown fox number %d jumps over a lazy dog near the river bank and rests until morning comes again" % i for i in range(60)]
    texts = {i: t + f" story {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i, t in enumerate(good)}
    texts[60] = texts[3]  # an exact copy
    texts[61] = texts[4] + " end"  # a near copy
    texts[62] = texts[5] + " which planet in the solar system has the largest number of moons today and why " + " ".join(f"u62x{k}" for k in range(30))
    texts[63] = texts[6] + " " + " ".join(f"u63x{k}" for k in range(30)) + ' token = "abcdef123456"'
    texts.update({64: "too short", 65: None, 66: ""})
    junk = {i: " ".join(f"%%{k * i} &&&" for k in range(40)) for i in range(70, 90)}
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in {**texts, **junk}.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(70, 90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "Which planet in the solar system has the largest number of moons today and why?")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts


def test_stages(spark, tmp_path):
    texts = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r for r in docs.collect()})
    kept, dedup, clean, masked = seen
    assert set(kept) == set(range(64))
    assert set(dedup) == set(range(62)) - {60, 61} | {62, 63}
    assert set(clean) == set(dedup) - {62}
    assert set(masked) == set(clean) and masked[63].text.endswith(" [SECRET]\"") and masked[63].n_chars == len(masked[63].text)
    assert all(masked[k].text == texts[k] for k in masked if k != 63)
    out = segmentations.decode(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {(r.doc_id, r.text) for r in out} == {(k, r.text) for k, r in masked.items()}
    assert all(r.decodes for r in out)


def test_run_on_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_leave_columns_of_any_name(spark, tmp_path):
    """The names that operators use for their own columns, as extra columns of documents."""
    texts = tables(spark, str(tmp_path))
    names = ["s_text", "s_assign", "s_key", "s_weak", "s_base", "s_all", "q_hash", "q_id", "n_words", "rep_id", "node", "g_id", "l_doc", "hash", "c0", "C1", "class_id", "bucket"]
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = plain.select(*plain.columns, *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/wide-{name}")
        docs = spark.read.parquet(f"{tmp_path}/wide-{name}")
        assert docs.columns == columns, name
    rows = docs.collect()
    assert len(rows) == 61 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert texts[3] in {r.text for r in rows}
