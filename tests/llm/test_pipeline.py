"""The pipeline, stage by stage, against brute force."""

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from rulequarry.llm import mixing, quality, sharding
from rulequarry.llm._common import flat

from .test_corpus import EXTRA, SCHEMA, brute_leaks, copies, labelled, odd_rows, prose, shingle_set


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    texts, y = labelled(200, 8)
    docs = odd_rows() + [(1000 + r[0], *r[1:]) for r in copies(7)] + [(2000 + i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    docs += [(3000 + i, f"{prose(60 + i, 20)} {prose(5000, 40)} {prose(80 + i, 20)}", "en", "b", 1) for i in range(4)]
    docs = [(*r, 7, "c", "k", "g", "row", "s", "here", 0.5, 1, "k_", 3, None, 4, "key", 5, 6) for r in docs]  # names that the operators use themselves
    spark.createDataFrame(docs, EXTRA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2000 + i, int(v), 0) for i, v in enumerate(y)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(5000, 40)), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def key(rows) -> list[str]:
    return sorted(repr((r.doc_id, r.text)) for r in rows)


def one_per_group(docs: list) -> list[str]:
    sets = [shingle_set(r.text) for r in docs]
    label = list(range(len(docs)))
    for _ in docs:
        before = list(label)
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and len(x & sets[j]) / len(x | sets[j]) >= 0.5:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return sorted({str(n) for n in label})


def test_stages_agree_with_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            p = net.predict(*flat(pa.array([r.text for r in before], pa.string())))
            assert key(rows) == key(r for r, q in zip(before, p) if q >= 0.5) and 10 < len(rows) < len(before)
        elif k == 1:
            assert len(rows) == len(one_per_group(before)) < len(before) and set(key(rows)) <= set(key(before))
            assert len(one_per_group(rows)) == len(rows)
        elif k == 2:
            bad = {d for d, _ in brute_leaks([(i, r.text) for i, r in enumerate(before) if r.text and len(r.text) < 5000], [(1, prose(5000, 40))])}
            assert key(rows) == key(r for i, r in enumerate(before) if i not in bad) and bad
        else:
            con = duckdb.connect()
            con.register("documents", docs.drop("shard").toArrow())
            if k == 3:
                want = con.execute(mixing.SQL).fetchall()
                assert len(rows) == sum(w[2] for w in want) == len(before)
            else:
                assert sorted(map(repr, rows and [(r.doc_id, r.text, r.shard) for r in rows])) == sorted(repr(r) for r in con.execute(f"SELECT doc_id, text, shard FROM ({sharding.sql()})").fetchall())
        results.append(len(rows))
        docs = after
    assert corpus_pipeline.run(spark, sf_dir).count() == results[-1]


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
