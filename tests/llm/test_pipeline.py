"""The pipeline against its brute-force version, stage by stage."""

import corpus_pipeline
from tastegrid.llm import bpe, mixing, pii
from tests.llm.cases import documents, empty
from tests.llm.test_minhash import brute
from tests.llm.test_native import measured


def test_stages_on_the_smallest_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    clean = {i: r for i, r in rows.items()
             if (m := measured(r.text))[0] >= 50 and 2 * m[4] <= m[0] and 10 * m[2] <= m[0] and m[1] <= 12 * m[0]
             and 2 * m[1] >= 5 * m[0] and 100 * sum("A" <= c <= "Z" for c in r.text) <= 40 * m[1]
             and 4 * r.text.count("!") <= m[0] and 2 * m[3] <= sum(bool(x.strip(" \t\r\v\f")) for x in r.text.split("\n"))}
    one = corpus_pipeline.filter_quality(spark, docs, folder)
    assert {r.doc_id for r in one.collect()} == set(clean)
    two = corpus_pipeline.drop_near_duplicates(spark, one, folder)
    root, _ = brute([(i, r.text) for i, r in clean.items()])
    assert {r.doc_id for r in two.collect()} == {i for i in clean if root[i] == i}
    three = corpus_pipeline.redact_personal_data(spark, two, folder)
    automaton = pii.anchors()
    for r in three.collect():
        assert r.text == pii.redacted(rows[r.doc_id].text, pii.find(rows[r.doc_id].text, automaton)) and r.n_chars == len(r.text)
        assert not [s for s in pii.find(r.text, automaton) if s[0] in ("email", "ip", "card", "phone")]
    four = corpus_pipeline.mix_sources(spark, three, folder)
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    chosen = {r.doc_id: r.text for r in four.collect()}
    encoder = bpe.Encoder(bpe.Model(open(bpe.default_path(), "rb").read()))
    got = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: encoder.encode([t])[0] for i, t in chosen.items()}
    words = lambda t: measured(t)[0]
    assert sum(map(words, chosen.values())) <= 0.8 * sum(words(r.text) for r in three.collect())


def test_odd_cases_and_empty(spark):
    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            docs = out
        corpus_pipeline.encode_tokens(spark, docs, "").collect()
