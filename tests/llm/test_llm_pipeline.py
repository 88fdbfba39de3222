"""The pipeline beside plain Python, stage after stage."""

import collections
import re

from test_llm_quality import counts
from test_llm_simhash import fingerprint, least_of_components
from tokenizers import Tokenizer

import corpus_pipeline
from panelspark.llm import catalog, secrets


def redacted(text):
    for rule in secrets.RULES:
        text = re.sub(rule.pattern, lambda m, r=rule: f"[{r.kind}]" if len(m[r.group]) >= r.least else m[0], text, flags=re.A)
    return text


def test_stages_beside_plain_python(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # 87 labels prove no cutoff safe, so the base rules alone decide.
    want = {}
    for key, text in docs.items():
        n, *_, repeated = counts(text)
        if n >= 10 and 100 * repeated <= 20 * n:
            want[key] = text
    ids = sorted(want)
    least = least_of_components([fingerprint(want[i]) for i in ids], ids)
    # Passages of this table are unedited.
    want = {i: want[i] for i in sorted(set(least)) if not any(t in want[i] for t in items)}
    want = {i: redacted(t) for i, t in want.items()}

    kept = spark.read.parquet(f"{sf}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
    assert {r.doc_id: r.text for r in kept.collect()} == want

    tokenizer = Tokenizer.from_file(catalog.TOKENIZER)
    lengths = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "packing"]


CLASHES = ["row", "stratum", "m", "kept", "hash", "text_hash", "_text_hash", "id", "_id", "_hash", "_hit", "key", "start", "stop", "root", "fingerprint"]


def odd_documents(spark):
    words = " ".join(f"word{i} goes" for i in range(40))
    rows = [(1, words, "en", "s", 3), (None, words + " too", "en", None, None), (2, None, None, "s", 0), (3, "", "de", "s", 0),
            (1, words, "en", "s", 3), (4, "few words", "en", "s", 9), (5, words.replace("goes", "went") + " password: hunter22", "fr", "s", 1),
            (6, " ".join(f"{i:x}" for i in range(60_000)), "es", "s", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"'{c}' AS {c}" for c in CLASHES])


def test_odd_documents_go_through_every_stage(spark, sf):
    docs = odd_documents(spark)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        assert {tuple(r[c] for c in CLASHES) for r in kept.collect()} == {tuple(CLASHES)}, name
    rows = {(r.doc_id, (r.text or "")[:5]): r for r in kept.collect()}
    # Base rules drop short, null and empty texts; of equal rows one stays; near copies of the smallest id go.
    assert {k for k, _ in rows} >= {1, 5, 6} and not {2, 3, 4} & {k for k, _ in rows}
    assert sum(r.doc_id == 1 for r in kept.collect()) == 1
    secret = next(r for r in rows.values() if r.doc_id == 5)
    assert "hunter22" not in secret.text and secret.n_chars == len(secret.text)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {p.doc_id for p in pieces} == {k for k, _ in rows}


def test_every_stage_takes_odd_rows_by_itself(spark, sf):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns, name
        texts = [r.text for r in found.collect()]
        assert name == "near_duplicates" or len(texts) == 9, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == 7


def test_empty_table_goes_through(spark, sf):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs_after = stage(spark, docs, sf)
        assert docs_after.count() == 0, name
