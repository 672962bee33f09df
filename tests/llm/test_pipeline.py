"""The pipeline's stages on odd rows, and the queries' registration."""

import corpus_pipeline as P
import pytest
from tests.llm import brute

import __spark_entry__ as entry
from textwarden.llm import toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(odd_rows, kind).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 0, int("one" in (r[1] or ""))) for r in odd_rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    text = next(r[1] for r in odd_rows if r[0] == 20)
    spark.createDataFrame([(1, " ".join(text.split()[100:130]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "substring dedup", "decontamination", "mixing"]


def test_each_stage(spark, folder, odd_rows, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        wide = stage(spark, odd, folder)
        assert wide.columns == odd.columns and wide.count() <= len(odd_rows)
    assert P.STAGES[-1][1](spark, docs, folder).columns == [*docs.columns, "copy"]


def test_near_duplicate_stage(spark, folder, odd_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.one_of_each_group(spark, docs, folder).collect()
    want = brute.components([r[:2] for r in odd_rows], 5, 80)
    least = {r[0] for r, (k, c) in zip(odd_rows, want, strict=True) if r[0] is not None and (c == r[0] or k == 0)}
    assert {r.doc_id for r in kept} - {None} == least
    assert len([r for r in kept if r.doc_id == 10]) == 1  # repeated rows: one stays
    assert sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in odd_rows)


def test_near_duplicates_with_clashing_ids(spark):
    """Rows of one id and different texts are told apart: each group of near copies keeps one row, others stay."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, text, 1), (7, text + " more", 2), (7, "quite another text of eight words or so", 3), (9, other, 4), (9, other + " end", 5), (9, other, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    for _ in range(2):
        kept = sorted(r.n for r in P.one_of_each_group(spark, docs, "").collect())
        assert kept[:2] == [1, 3] and kept[-1] == 7 and len(kept) == 4 and kept[2] in (4, 5, 6)


def test_passage_and_benchmark_stages(spark, folder, odd_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ws = [brute.words(r[1]) for r in odd_rows]
    want = sorted(repr((r[0], " ".join(w for w, m in zip(x, mask, strict=True) if not m) if any(mask) else r[1])) for r, x, mask in zip(odd_rows, ws, brute.repeated(ws, 35), strict=True))
    assert sorted(repr((r.doc_id, r.text)) for r in P.remove_shared_passages(spark, docs, folder).collect()) == want
    left = P.reject_contaminated(spark, docs, folder).collect()
    assert len(left) == len(odd_rows) - 1 and all(r.doc_id != 20 for r in left)


def test_toxic_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = P.toxicity_model(spark, folder)
    scores = {(r.doc_id, r.text): r.toxic_score for r in toxicity.score(docs, model).collect()}
    kept = {(r.doc_id, r.text) for r in P.reject_toxic(spark, docs, folder).collect()}
    assert kept == {k for k, s in scores.items() if s < toxicity.THRESHOLD}


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert out.count() > 0 and out.columns[-1] == "copy"


def test_registered():
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
