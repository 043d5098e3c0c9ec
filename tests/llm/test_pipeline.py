import collections

from test_minhash_dedup import brute

import corpus_pipeline
from graphloom.llm import language_id, mixing, toxicity
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = {"": docs}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        kept[name] = at
        if name != "packing":
            assert at.columns == docs.columns
    ids = {k: collections.Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in kept.items()}

    m = toxicity.trained(docs, table(spark, SF, "labels"))
    assert set(ids["toxicity"]) == {r.doc_id for r in toxicity.scored(docs, m).collect() if r.score < 0.5}
    p = language_id.trained(kept["toxicity"])
    texts_of = {r.doc_id: len(language_id.trigrams(r.text)) for r in docs.collect()}
    assert set(ids["language"]) == {r.doc_id for r in language_id.predicted(kept["toxicity"], p).collect() if r.lang_pred != "und" and (r.score >= 3 / 512**0.5 or texts_of[r.doc_id] < 50)}
    texts = [(r.doc_id, r.text.replace("\n", " ").replace("\t", " ")) for r in kept["language"].collect()]
    assert set(ids["near_duplicates"]) == {i for i, c in brute(texts, 5).items() if i == c}
    want = {r.doc_id: r.copies for r in mixing.taken_counts(kept["near_duplicates"]).collect() if r.copies}
    assert ids["mixing"] == want
    got = kept["packing"].collect()
    assert collections.Counter(r.doc_id for r in got if r.piece == 0) == ids["mixing"]
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048 + 2


def test_empty(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
