import __spark_entry__
import corpus_pipeline
from factorium.llm import common
from tests.llm.test_bpe_secrets import wanted
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_operators import brute_hits, brute_lines, brute_rules


def test_stages_are_brute_force(spark, sf):
    """Each stage against a plain version on its own input; the ratio's verdict is the operator's own."""
    docs = common.table(spark, sf, "documents")
    pairs = lambda t: [(r.doc_id, r.text) for r in t.collect()]
    state = docs
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(state)
        state = common.materialize(stage(spark, state, sf), name)
        outputs[name] = (before, state)
        if name != "bpe":
            assert state.columns == docs.columns
    before, after = outputs["quality_rules"]
    kept = set(pairs(after))
    assert not any(brute_rules(t)[5] for _, t in kept)
    good = {r.doc_id for r in common.table(spark, sf, "labels").where("quality = 1").collect()}
    assert all((d, t) in kept for d, t in before if d in good and not brute_rules(t)[5])
    before, after = outputs["line_dedup"]
    assert sorted(pairs(after)) == sorted((d, t) for d, t, _, _ in brute_lines(before))
    before, after = outputs["near_dedup"]
    assert sorted(d for d, _ in pairs(after)) == sorted({c for _, c in near_brute(before)})
    before, after = outputs["decontamination"]
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    assert sorted(d for d, _ in pairs(after)) == sorted(x[0] for x in brute_hits(before, items) if not x[5])
    before, after = outputs["bpe"]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == sorted(wanted([t for _, t in before]))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, after.collect()))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
