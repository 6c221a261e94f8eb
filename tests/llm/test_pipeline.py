"""The pipeline's run() against the ids that each stage must leave, by plain versions of the stages."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from test_llm import plain_hits, plain_join

import corpus_pipeline as pipeline
from frameweave.llm import bpe, q04_toxicity, q07_quality
from frameweave.llm._io import table


def planted(docs, labels, items):
    """Copies with a word changed (90000 on), clean texts around a passage (91000 on), labelled toxic texts (92000 on), texts without words."""
    good = [(i, t) for i, t in docs if labels.get(i) == (1, 0) and len(t.split()) > 150][:6]
    out = []
    for n, (_, t) in enumerate(good):
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        out += [(90000 + 2 * n, " ".join(words)), (90001 + 2 * n, t)]
        passage = [x for _, x in items if len(x.split()) >= 12][n]
        back = t.split(" ")[::-1]
        out.append((91000 + n, " ".join([*back[:90], passage, *back[90:]])))
    for n, t in enumerate([t for i, t in docs if labels.get(i) == (1, 0) and len(t.split()) > 60][:40]):
        out.append((92000 + n, " ".join(("idiot", "loser", "pathetic", "disgusting")[j // 5 % 4] if j % 5 == 2 else w for j, w in enumerate(t.split(" ")[:100]))))
    return out + [(93000, None), (93001, ""), (93002, " \n")]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(input rows, benchmark items, rows after each stage by id, rows of run())."""
    top = tmp_path_factory.mktemp("pipeline")
    docs, labels, bench = (table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows += planted(rows, {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}, items)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{top}/in/documents.parquet")
    toxic = spark.createDataFrame([(i, 1, 1) for i, _ in rows if i // 1000 == 92], labels.schema)
    labels.unionByName(toxic).write.parquet(f"{top}/in/labels.parquet")
    bench.write.parquet(f"{top}/in/benchmark.parquet")
    (top / "out").mkdir()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pipeline, "shared_dir", lambda _: f"{top}/out")
        m.setattr(pipeline, "remove", lambda *_: None)  # what lies between the stages is looked at below
        last = [r.asDict() for r in pipeline.run(spark, f"{top}/in").collect()]
    left = {name: sorted((r.doc_id, r.text) for r in spark.read.parquet(*map(str, (top / "out").glob(f"pipeline-{name}-*"))).select("doc_id", "text").collect()) for name, _ in pipeline.STAGES[:-1]}
    return f"{top}/in", sorted(rows), items, left, last


def test_every_stage_leaves_the_expected_ids(spark, stages):
    path, rows, items, left, last = stages
    labels = table(spark, path, "labels")
    frame = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    ids = lambda name: [i for i, _ in left[name]]
    texts = dict(rows)
    assert all(t == texts[i] for name in left for i, t in left[name])

    assert ids("toxicity") == sorted(r.doc_id for r in q04_toxicity.scored(frame(rows), labels).collect() if r.score < 0.3)
    assert ids("quality") == sorted(r.doc_id for r in q07_quality.scored(frame(left["toxicity"]), labels).collect() if r.score >= 0.3)
    assert ids("near_copies") == sorted(i for i, (_, first) in plain_join(left["quality"], 5, 80, 100).items() if first == i)
    assert ids("decontamination") == sorted(h[0] for h in plain_hits(left["near_copies"], items) if not h[-1])

    import public_tokenizers as tokenizers
    import tiktoken

    file = tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.MergeReplay.from_file(file).ranks, special_tokens={})
    want = []
    for i, t in left["decontamination"]:
        coded = np.array(plain.encode_ordinary(t or ""), "<u4")
        want.append((i, len(coded), hashlib.sha256(coded.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in last) == want


def test_what_was_planted_goes_where_it_must(stages):
    _, rows, _, left, _ = stages
    gone, before = {}, {i for i, _ in rows}
    for name in left:
        now = {i for i, _ in left[name]}
        gone[name], before = before - now, now
    kind = {name: sorted(i // 1000 for i in ids if i >= 90000) for name, ids in gone.items()}
    assert len(kind["toxicity"]) >= 30 and set(kind["toxicity"]) == {92} and 90 in kind["near_copies"] and 91 in kind["decontamination"]
    assert not {i // 1000 for i in before} & {90, 91}
