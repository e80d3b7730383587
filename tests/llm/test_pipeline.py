"""The pipeline's stages, each against what its operator says of its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from factweave.llm import bpe, decontam, secret_scan, simhash, toxicity
from factweave.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontamination", "secrets", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.collect()}

    a = stages["toxicity"](spark, docs, SF).cache()
    own = toxicity.fit(docs, table(spark, SF, "labels"))
    assert a.columns == docs.columns and ids(a) == {r["doc_id"] for r in docs.collect() if own.score(r["text"]) < 0.7}

    b = stages["simhash_dedup"](spark, a, SF).cache()
    fp = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in a.collect()}
    left = ids(b)
    assert b.columns == docs.columns
    assert all(any((fp[i] ^ fp[j]).bit_count() <= 4 for j in fp if j != i) for i in fp if i not in left)
    assert all((fp[i] ^ fp[j]).bit_count() > 4 for i in left for j in left if i != j)

    c = stages["decontamination"](spark, b, SF).cache()
    items = [decontam.shingles(decontam.words_of(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    assert c.columns == docs.columns
    assert ids(c) == {r["doc_id"] for r in b.collect() if not any(len(s & decontam.shingles(decontam.words_of(r["text"]))) >= 0.8 * len(s) for s in items)}

    d = stages["secrets"](spark, c, SF).cache()
    assert d.columns == docs.columns and ids(d) == ids(c)
    assert all(r["n_chars"] == len(r["text"]) for r in d.collect())
    assert secret_scan.scan_docs(d)[0].where("size(spans) > 0").count() == 0

    e = stages["bpe"](spark, d, SF)
    assert ids(e) == ids(d)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {tuple(r) for r in e.collect()} == {tuple(r) for r in bpe.encode(d).collect()}


def test_stages_over_messy_rows(spark, messy, empty):
    """Null, empty, very long and repeated texts, null ids and clashing names through each stage, on what the stage before kept."""
    rows = messy.withColumn("n_chars", F.length("text").cast("long")).unionByName(messy.limit(1).withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit("a token=abcdefgh é"), "n_chars": F.lit(18).cast("long")})).cache()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")
    docs, own = rows, toxicity.fit(rows, table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF).cache()
        assert got.schema.names == rows.schema.names
        before, after = sorted(map(key, docs.collect())), sorted(map(key, got.collect()))
        if name == "toxicity":
            assert after == [k for k in before if own.score(None if k[2] else k[3]) < 0.7]
        elif name == "simhash_dedup":
            fp = [simhash.fingerprint(k[3]) for k in before]
            assert {k for k in before if k[0]} <= set(after) and len(set(after)) == len([k for k in after if not k[0]]) + len({k for k in after if k[0]})
            for k, f in zip(before, fp, strict=True):
                assert k in after or any((f ^ g).bit_count() <= 4 for j, g in zip(before, fp, strict=True) if j in after or not j[0])
        elif name == "decontamination":
            assert after == before
        else:
            assert len(after) == len(before) and [k[:3] for k in after] == [k[:3] for k in before]
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}[900] == ("a [secret] é", 12)
        docs = got
    assert sorted(r["doc_id"] or -1 for r in corpus_pipeline.tokenize(spark, docs, SF).collect()) == sorted(r["doc_id"] or -1 for r in docs.collect())
    none = rows.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
