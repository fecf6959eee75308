"""The pipeline's stages, each against its effect on the rows of its predecessor."""

import corpus_pipeline as cp
from helioframe.llm import near, tokens
from helioframe.llm.common import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"


def run_stages(spark, docs):
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]


def test_stages_in_turn(spark, docs):
    from tokenizers import Tokenizer

    tables = run_stages(spark, docs)
    for t in tables[1:-1]:
        assert t.columns == DOCUMENT_COLUMNS
    rows = [{r["doc_id"]: r for r in t.collect()} for t in tables[:-1]]
    for before, after in zip(rows, rows[1:], strict=False):
        assert set(after) <= set(before)
    good, single, cut, clean = rows[1:]
    assert all(len(r["text"].split()) >= 20 for r in good.values())
    assert all(good[i] == rows[0][i] for i in good) and all(single[i] == good[i] for i in single)
    parts = dict(zip(single, near.profiles([r["text"] for r in single.values()]), strict=True))
    assert not [(a, b) for a in parts for b in parts if a < b and near.similarity(parts[a], parts[b]) >= 0.8]
    every = dict(zip(good, near.profiles([r["text"] for r in good.values()]), strict=True))
    for i in set(good) - set(single):
        assert any(near.similarity(every[i], every[k]) >= 0.8 for k in good if k != i)
    assert set(cut) == set(single)
    assert all(cut[i]["n_chars"] == len(cut[i]["text"]) for i in cut if cut[i]["text"] != single[i]["text"])
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, r in cut.items() if any(x in " ".join(r["text"].split()) for x in items)}
    assert holds and set(clean) == set(cut) - holds
    t = Tokenizer.from_file(tokens.vocabulary())
    total = sum(len(e.ids) + 1 for e in t.encode_batch([r["text"] for r in clean.values()], add_special_tokens=False))
    pieces = tables[-1].collect()
    assert sum(p["length"] for p in pieces) == total and {p["doc_id"] for p in pieces} == set(clean)


def test_stages_keep_odd_rows_in_order(spark, docs):
    """Null ids, nulls in any column and repeated rows pass through every stage."""
    odd = spark.createDataFrame([(None, "words " * 3, None, None, None), (5, None, None, None, None), (5, None, "en", "s", 0)], docs.schema)
    assert cp.quality_stage(spark, odd, SF).count() == 0
    assert cp.near_stage(spark, odd, SF).count() == 3
    assert cp.substring_stage(spark, odd, SF).where("text is null").count() == 2
    assert cp.decontamination_stage(spark, odd, SF).count() == 3
    assert cp.packing_stage(spark, odd, SF).count() == 3
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
