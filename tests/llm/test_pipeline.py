import corpus_pipeline
from tests.conftest import SF

from tessella.llm import decontam, langid, mixing, simhash
from tests.llm.conftest import ODD


def test_stages_and_result(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, d = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF).cache()
        assert d.columns == docs.columns
        counts.append(d.count())
    assert counts[1] > 0.97 * counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.leaks(d, bench).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_stages_on_odd_rows(spark, make_docs):
    d = make_docs(ODD, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = d.columns
        d = stage(spark, d, SF)
        assert d.columns == columns
        d.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0


def test_language_stage_drops_what_has_no_language(spark, make_docs):
    model_rows = [(i, "the quick brown fox jumps", "en") for i in range(20)] + [(40 + i, "der braune fuchs springt", "de") for i in range(20)] + [(90, "1234 !!"), (91, None)]
    out = corpus_pipeline.identify_language(spark, make_docs(model_rows), SF).collect()
    assert sorted(r.doc_id for r in out) == [*range(20), *range(40, 60)]
    assert {r.lang for r in out} == {"en", "de"}
