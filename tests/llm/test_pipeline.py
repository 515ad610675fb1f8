"""The pipeline's stages against plain versions on a small table."""

import random
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelane.llm import pii, quality_rules
from tidelane.llm.chunk_encoder import ChunkEncoder

VOCABULARY = {"en": "the and of water house tide river stone over under wind".split(), "de": "der und die wasser haus gezeit fluss stein über unter wehen".split()}


def rows():
    rng, out = random.Random(8), []
    for i in range(260):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(rng.choice(VOCABULARY[lang]) + str(rng.choice(["", "", rng.choice("abcdefgh") * 2])) for _ in range(rng.randrange(30, 60))) for _ in range(3)]
        if i % 3 == 0:
            lines.append("All rights reserved.")
        if i % 7 == 0:
            lines.append(f"call{i} +1 (415) 555-{1000 + i} or a{i}.b@c.de")
        out.append((i, "\n".join(lines), lang, f"src{i % 2}", 0))
    out += [(300 + i, out[i][1], out[i][2], "src1", 0) for i in range(20)]
    out += [(400 + i, "x " + out[i][1], out[i][2], "src0", 0) for i in range(20)]
    out += [(500, None, "en", "src0", 0), (501, "", "en", None, 0), (502, "same words here " * 60, "en", "src0", 0), (503, "1 2 3 " * 30 + " ".join(map(str, range(1000, 1090))), "en", "src0", 0), (5, out[5][1], out[5][2], out[5][3], 0)]
    return out


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    first = {(r.doc_id, r.text) for r in docs.where("doc_id <> 5").collect()}

    kept = corpus_pipeline.quality(spark, docs.where("doc_id <> 5"), documents)
    con = duckdb.connect()
    con.register("docs", docs.where("doc_id <> 5").select("doc_id", "text", "source").toPandas())
    want = con.execute(f"WITH {quality_rules.VERDICTS_SQL} SELECT doc_id, clean FROM verdicts WHERE NOT base_failed AND NOT depleted").fetchall()
    got = kept.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want) and kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in got)
    assert {500, 501, 502} & {r.doc_id for r in got} == set()
    assert not any("All rights" in r.text for r in got) and any("All rights" in t for _, t in first if t)

    kept = corpus_pipeline.language(spark, kept, documents)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in want} - {503}

    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() for w in [t.lower().split()]}
    component = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and component[a] != component[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((component[a], component[b]))
                component = {d: low if c == high else c for d, c in component.items()}
    kept = corpus_pipeline.near_duplicates(spark, kept, documents)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component.values())) and kept.columns == docs.columns

    kept = corpus_pipeline.personal_data(spark, kept, documents)
    assert not any(pii.base_spans(r.text) for r in kept.collect())
    assert any("[phone] or [email]" in r.text for r in kept.collect())

    coder = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    want = {r.doc_id: coder.encode(pa.array([r.text]), 1)[0] for r in kept.collect()}
    pieces = corpus_pipeline.pack(spark, kept, documents).collect()
    assert Counter({d: len(x) for d, x in want.items()}) == sum((Counter({p.doc_id: p.length}) for p in pieces), Counter())
    assert all(p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].astype("<u4").tobytes()) for p in pieces)


def test_run_is_the_stages(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, documents)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, documents).select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


def test_empty_tables_and_columns_of_any_name(spark, documents):
    """Every stage on no rows, on rows with columns that its own working names clash with, and on odd rows alone."""
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    names = ["quality", "_host", "_row", "_language", "near_class", "row", "spans", "ids"]
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    odd = docs.where("doc_id in (5, 6)").unionByName(docs.where("doc_id = 6")).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.lit(6).cast("long")))
    odd = odd.unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id in (500, 501)"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), documents).count() == 0
        if name == "packing":
            assert stage(spark, odd, documents).select("doc_id").distinct().count() == 5
            continue
        kept = stage(spark, wide, documents)
        assert kept.columns == wide.columns
        assert all(r[len(docs.columns) :] == tuple(range(len(names))) for r in map(tuple, kept.collect()))
        found = [r.doc_id for r in stage(spark, odd, documents).collect()]
        repeats = 2 if name == "near_duplicates" else 3  # of the rows with id 6: two alike and one unlike them
        assert found.count(6) == repeats and found.count(None) == 1 and (name in ("near_duplicates", "personal_data") or not {500, 501} & set(found))
