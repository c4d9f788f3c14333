"""The pipeline, stage by stage, against plain versions of the stages."""

import pytest

import corpus_pipeline
from factlattice.llm import toxicity

from . import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir, folder = "/root/testdata/sf0.01", tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"file://{folder}/{name}")
        out.append(spark.read.parquet(f"file://{folder}/{name}"))
    return sf_dir, out


def as_rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, stages):
    sf_dir, (docs, clean, single, cut, private, mix) = stages
    for df in (clean, single, cut, private):
        assert df.columns == docs.columns and dict(df.dtypes) == dict(docs.dtypes)
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert toxic and set(as_rows(clean)) == set(as_rows(docs)) - toxic

    before, after = as_rows(clean), as_rows(single)
    names = sorted(before)
    near = brute.similar_pairs([before[k].text for k in names], 0.6)
    alike = {(names[i], names[j]): v for (i, j), v in near.items()}
    assert all(b not in after or a not in after for (a, b), v in alike.items() if v >= 0.88)
    # A row goes only if it is like another.
    assert set(before) - set(after) <= {k for pair in alike for k in pair} and len(after) < len(before)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = as_rows(single), as_rows(cut)
    hit = {d for d, *_, h in brute.contaminated([(k, r.text) for k, r in before.items()], items) if h}
    assert hit and all(after[k].text == before[k].text for k in set(after) - hit) and set(before) - set(after) <= hit
    assert not any(h for *_, h in brute.contaminated([(k, r.text) for k, r in after.items()], items))
    assert all(r.n_chars == len(r.text) for r in after.values())

    before, after = after, as_rows(private)
    found = {k for k, r in before.items() if brute.spans(r.text, brute.PII, False)}
    assert found and set(after) == set(before)
    assert all(after[k].text == before[k].text for k in set(after) - found)
    assert all(not any(kind == "email" for *_, kind in brute.spans(after[k].text, brute.PII, False)) for k in found)

    sizes = {k: len(brute.WORD.findall(r.text)) for k, r in after.items()}
    taken = as_rows(mix)
    whole = {}
    for k, r in taken.items():
        assert r.text == after[k].text and r["size"] == sizes[k] and 0 < r.taken <= 3 * sizes[k]
        whole.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - b) <= max(sizes.values()) for a, b in whole.values())


def test_run(spark, stages):
    sf_dir, out = stages
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(out[-1].collect())


def test_mixture_repeated_rows(spark):
    """Rows of one id and text in two sources are each their own source's; repeated rows are taken alike."""
    data = [(1, "a b c", "en", s, 5) for s in ("x", "y", "y", None)] + [(None, "d e", "en", "x", 3), (2, None, "en", "y", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixture_stage(spark, docs, "").collect()
    assert all(0 < r.taken <= 3 * r["size"] for r in got) and {r.source for r in got} == {"x", "y", None}
    assert sum(r.source == "y" and r.doc_id == 1 for r in got) == 2
