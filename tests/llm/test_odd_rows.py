"""Every registered text query over null ids, repeated rows, clashing columns and an empty table."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probspark.llm import queries as Q
from probspark.llm import toxicity
from probspark.llm.words import _BYTE_VALUES, mix

BY_DOCUMENT = [n for n in Q.QUERIES if n not in ("op2_embedding_dedup", "op9_packing", "op13_source_divergence")]
CLASHING = [
    "score", "predicted", "held_out", "label", "kept", "keep_id", "group_size", "n_words", "n_removed", "n_bytes", "n_tokens", "component_id", "size", "taken", "target",
    "start", "offset", "length", "sequence_id", "shard", "slot", "law", "n_links", "item", "value", "rank", "part", "term", "digest", "hash", "count", "n", "id", "bag", "bucket", "block",
]


def texts():
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(n))
    shared = make(60)
    return [None, "", " ", "one", make(3000), shared, f"{make(4)} {shared}", f"{shared} {make(3)}", *(make(rng.randint(1, 90)) for _ in range(30)), "stupid worthless scum"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder of the plain table, folder of the same rows with clashing columns, folder of empty tables, rows)."""
    rows = [(i * 7 + 1, t, "en", ["a", None, "b"][i % 3], len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[4], rows[5], rows[5], (None, rows[6][1], "en", "a", 1), (None, "another text of its own", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(r[0], i % 2, int(i % 7 == 0)) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    found = []
    for name, table, own in (("plain", docs, labels), ("clashing", docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}), labels), ("empty", docs.limit(0), labels.limit(0))):
        at = str(tmp_path_factory.mktemp(name))
        table.write.parquet(f"{at}/documents.parquet")
        own.write.parquet(f"{at}/labels.parquet")
        found.append(at)
    return (*found, rows)


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_a_row_per_row_whatever_the_columns(spark, tables, name):
    plain, clashing, empty, rows = tables
    got = Q.QUERIES[name](spark, clashing)
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert len(set(got.columns)) == len(got.columns)
    if name not in ("op10_sharding", "op8_source_mixing"):  # which of equal rows goes where is a draw
        same = Q.QUERIES[name](spark, plain)
        assert same.columns == got.columns or set(CLASHING) & set(got.columns)
        of = lambda rows: Counter(str([round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in same.columns)]) for r in rows)
        assert of(found) == of(same.collect())
    assert Q.QUERIES[name](spark, empty).collect() == []


def test_packs_and_terms_whatever_the_columns(spark, tables):
    plain, clashing, empty, rows = tables
    pieces = Q.op9_packing(spark, clashing).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r[0] for r in rows)
    whole = lambda rows: sum(r.length for r in rows)
    assert whole(pieces) == whole(Q.op9_packing(spark, plain).collect()) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert Counter(Q.op13_source_divergence(spark, clashing).collect()) == Counter(Q.op13_source_divergence(spark, plain).collect())
    assert Q.op9_packing(spark, empty).collect() == [] and Q.op13_source_divergence(spark, empty).collect() == []


def test_vectors_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.001], 1), (5, [1.0, 0.001], 1), (9, [0.0, 1.0], 1), (7, [1.0, 0.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("own") for c in ("n_links", "kept", "component_id", "shard", "audit_recall")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.op2_embedding_dedup(spark, str(tmp_path)).collect()
    assert {r.vec_id for r in got} >= {5, 9, 7} and all(r.n_links == 0 for r in got if r.vec_id in (7, 9))


def plain_score(model, text):
    """A text's toxicity from the model's vectors, one n-gram at a time."""
    words = [w for w in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    difference = model.classes[1] - model.classes[0]
    logits = []
    for low in range(0, max(1, len(words)), toxicity.PASSAGE):
        total, n = 0.0, 0
        for word in words[low : low + toxicity.PASSAGE]:
            marked = b"<" + word + b">"
            for size in toxicity.GRAMS:
                for at in range(len(marked) - size + 1):
                    h = 0
                    for byte in marked[at : at + size]:
                        h = (h * 0x9E3779B97F4A7C15 + int(_BYTE_VALUES[byte])) % (1 << 64)
                    bucket = int(mix(np.array([(h + size) % (1 << 64)], np.uint64))[0] % np.uint64(toxicity.BUCKETS))
                    total += float(model.vectors[bucket] @ difference)
                    n += 1
        logits.append(total / max(1, n) + model.offset())
    return 1 / (1 + np.exp(-max(logits)))


def test_toxicity_scores_match_a_plain_version(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice("the quick brown fox jumps over a lazy dog".split()) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    bad = [f"{t} {rng.choice(['idiot', 'stupid', 'scum'])} {t}" for t in clean[:20]]
    rows = [*((i, t, 0) for i, t in enumerate(clean)), *((100 + i, t, 1) for i, t in enumerate(bad)), (200, "stupiddd", 1), (201, "", 0), (202, None, 0), (203, "Ärger über ÜBER", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.filter("doc_id < 200").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs.drop("toxic"), labels, F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.drop("toxic"), labels, F.lit(True)).collect()}
    for i, t, _ in rows:
        assert got[i] == pytest.approx(plain_score(model, t), rel=1e-4, abs=1e-5), t
    assert got[200] > 0.5 > got[201]  # a misspelling that no labelled document has


def test_toxicity_gradient_lowers_the_loss():
    texts_ = pa.array(["good words only here", "some stupid words here", "stupid stupid", "fine and good", "more stupid talk", "stupid again", "nothing here"])
    y = np.array([0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0])
    loss = lambda m: float(-np.mean([np.log(plain_score(m, t)) if v else np.log(1 - plain_score(m, t)) for t, v in zip(texts_.to_pylist(), y, strict=True)]))
    early, late = (toxicity.SubwordSoftmax.fit(texts_, y, np.ones(len(y)), steps=s) for s in (1, 100))
    assert loss(late) < 0.3 * loss(early)
