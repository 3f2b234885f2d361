"""The registered queries over empty tables and tables of nulls, and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from matchlake.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import COLUMNS

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="session")
def folders(spark, tmp_path_factory):
    out = {}
    for name, rows, labels in (("empty", [], []), ("nulls", [(None,) * 10] * 3, [(None, None, None)] * 2)):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{out[name]}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{out[name]}/labels.parquet")
        spark.createDataFrame(labels and [(None, None)], "item_id bigint, text string").write.parquet(f"{out[name]}/benchmark.parquet")
    return out


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_degenerate_tables(spark, folders, name, kind):
    found = (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, folders[kind])
    rows = found.collect()
    if name != "pipeline":
        assert len(rows) == (0 if kind == "empty" else 3)


def test_near_duplicate_and_substring_stages(spark, docs, rows):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").cache()
    component = brute.groups([t for _, t in rows], 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {min(i for (i, _), c in zip(rows, component, strict=True) if c == k and i is not None) for k, (j, t) in zip(component, rows, strict=True) if brute.words(t) and j is not None}
    some = [(r.doc_id, r.text) for r in kept.collect()]
    want = []
    for (i, t), covered in zip(some, brute.repeats([t for _, t in some]), strict=True):
        left = b" ".join(x for x, c in zip(brute.words(t, low=False), covered, strict=True) if not c).decode()
        want.append((i, left if any(covered) else t))
    cut = corpus_pipeline.cut_repeats(spark, kept, "")
    assert cut.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in cut.collect()], key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())


def test_pipeline(spark):
    """Every stage works on what the one before kept; the last one's pieces hold exactly the texts of the fourth."""
    from tokenizers import Tokenizer
    import public_tokenizers

    sf = "/root/testdata/sf0.01"
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, sf))
        assert docs.columns == before.columns, name
        sizes.append((before.count(), docs.count()))
    assert sizes[0][1] < sizes[0][0] and sizes[1][1] < sizes[1][0] and sizes[2][1] < sizes[2][0] and sizes[3][1] == sizes[3][0]
    plain, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids[: (len(ids) - 1) % 1024 + 1], "<u4").tobytes())))
    packed = corpus_pipeline.pack_sequences(spark, docs, sf).toPandas()
    first = packed[packed["piece"] == 0].set_index("doc_id")["ids_crc32"].to_dict()
    whole = packed.groupby("doc_id")["length"].sum().to_dict()
    assert sorted(want) == sorted((i, whole[i], first[i]) for i in whole)
