"""The corpus pipeline stage by stage against brute force on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
from test_llm_ops import SCHEMA, brute_lines, documents, near_pairs, sentences, write

from loomgraph.llm import mixing


def corpus():
    good = sentences(21, 60, 60)
    rng = random.Random(22)
    near = []
    for t in good[:10]:
        w = t.split()
        w[rng.randrange(5, 50)] = "changed"
        near.append(" ".join(w))
    junk = ["### " + " | ".join(t.upper().split()[:30]) + "!!" for t in sentences(23, 60)]
    lines = ["\n".join([good[20 + i], good[30], f"own line {i} of this text"]) for i in range(5)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(good + near + junk + lines)]
    return rows + [(500, None, "s0"), (501, "", None), (502, good[40], "s9")], {i: int(i < 70) for i in range(130)}


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    write(documents(spark, rows), tmp_path, "documents")
    write(spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixing", "packing"]

    def stage(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        return spark.read.parquet(f"{tmp_path}/stage{k}")

    kept = stage(0, docs)
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(70, 130)) and ids >= set(range(70))

    before = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    gone = brute_lines(before)
    want = {}
    for i, t, _ in before:
        lines = [] if t is None else [x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())]
        if not gone.get(i) or any(x.strip() for x in lines):
            want[i] = None if t is None else "\n".join(lines)
    lines_left = stage(1, kept)
    assert {r["doc_id"]: r["text"] for r in lines_left.collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines_left.collect())

    rows = sorted((r["doc_id"], r["text"]) for r in lines_left.na.fill({"text": ""}).collect())
    up = {i: i for i, _ in rows}
    for a, b in near_pairs([t for _, t in rows]):
        x, y = rows[a][0], rows[b][0]
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    single = stage(2, lines_left)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i in up if up[i] == i)

    mixed = stage(3, single)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/stage2/*.parquet')")
    drawn = Counter(r[0] for r in c.execute("WITH " + mixing.mix_sql("documents") + " SELECT doc_id FROM mixed").fetchall())
    assert Counter(r["doc_id"] for r in mixed.collect()) == drawn

    packed = stage(4, mixed).collect()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in mixed.collect()}
    assert Counter(r["doc_id"] for r in packed) == drawn and all(r["n_words"] == words[r["doc_id"]] for r in packed)
    bins = Counter((r["shard"], r["bin"], r["source"]) for r in packed)
    assert max(bins.values()) == 1
    for k in range(4):
        assert spark.read.parquet(f"{tmp_path}/stage{k}").columns == docs.columns


def test_run_on_an_empty_corpus(spark, tmp_path):
    write(spark.createDataFrame([], SCHEMA), tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
