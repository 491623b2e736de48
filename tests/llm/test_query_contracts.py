"""Every registered text query over a small table of odd rows, held against a plain version of what it promises."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.llm import queries as Q
from probspark.llm.quality import AttentionBag
from probspark.llm.sharding import exact_draw
from probspark.llm.toxicity import BUCKETS, Passages
from tests.llm.test_embedding_dedup import brute

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghiß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(55)
    out = [None, "", "  ", "one", "One two", "a b c d e", "A b c d E", "x" * 5000, make(9000), "<|endoftext|> " + make(5)]
    out += [f"{make(rng.randint(0, 30))} {passage} {make(rng.randint(0, 30))}" for _ in range(8)]
    for n in (8, 12, 16, 24, 40):  # pairs at a similarity of exactly or nearly 0.8, for sets of many sizes
        base = [f"{w}{i}" for i, w in enumerate(make(n + 4).split())]
        for extra in range(0, 4):
            out.append(" ".join([*base, *(f"z{n}{extra}{k}" for k in range(extra))]))
    base = make(120).split()
    for _ in range(10):
        near = list(base)
        near[rng.randrange(120)] = "other"
        out.append(" ".join(near))
    out += ["you stupid clown " + make(20), make(30) + " worthless scum", *(make(rng.randint(3, 60)) for _ in range(30))]
    return out + out[3:9]


@pytest.fixture(scope="module")
def sf(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(5)
    ids = rng.sample(range(5000), len(texts))
    rows = [(i, t, "en", [None, "", "b", "a", "é"][i % 5], len(t or "")) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(len(t or "") % 3 > 0), int("stupid" in (t or "") or "scum" in (t or ""))) for i, t, *_ in rows if i % 3]
    spark.createDataFrame([*labels, (None, 1, 1), (ids[0], None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, {i: t for i, t, *_ in rows}, {i: s for i, _, _, s, _ in rows}


@pytest.mark.parametrize("name,parts,part,least", [("op1_quality", 4, 2, 0.7), ("op4_toxicity", 5, 0, 0.5)])
def test_scores(spark, sf, name, parts, part, least):
    rows = Q.QUERIES[name](spark, sf[0]).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(sf[1]))
    by_text = defaultdict(set)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        by_text[sf[1][r.doc_id] or ""].add(round(r.score, 12))
    assert all(len(s) == 1 for s in by_text.values())


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[i % 4] + 0.06 * rng.normal(size=8)).tolist(), [0, 1, None][i % 3]) for i in range(120)] + [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [1.0] * 8, 0), (204, [1.0] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.op2_embedding_dedup(spark, str(tmp_path)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_repeated_windows(spark, sf):
    seen, gone = set(), defaultdict(set)
    docs = sorted(sf[1].items())
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[i].update(range(k, k + 20))
            seen.add(window)
    got = {r.doc_id: r for r in Q.op3_substring_dedup(spark, sf[0]).collect()}
    assert set(got) == set(sf[1])
    for i, t in docs:
        w = words(t)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone[i]), hashlib.sha256(kept).hexdigest())


def test_token_counts(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(Q._tokenizer("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in Q.op5_token_counts(spark, sf[0]).collect()}
    for i, t in sf[1].items():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def shingles(text):
    w = [x.translate(LOWER) for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_similar_documents(spark, sf):
    sets = {i: shingles(t) for i, t in sf[1].items()}
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op6_jaccard_join(spark, sf[0]).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert len({r for r in root.values()}) < len(root) - 20


def test_equal_texts(spark, sf):
    norm = {i: (t or "").encode().translate(LOWER) for i, t in sf[1].items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for r in Q.op7_exact_dedup(spark, sf[0]).collect():
        own = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), hashlib.sha256(norm[r.doc_id]).hexdigest())


def test_mix(spark, sf):
    size = {i: len(words(t)) for i, t in sf[1].items()}
    by_source = defaultdict(int)
    for i, s in sf[2].items():
        by_source[s] += size[i]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9  # one price for all: a source gets its weight times it, up to twice its size
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(weight[s] * middle, 2 * by_source[s]) for s in order) < 1.5 * sum(by_source.values()) else (low, middle)
    want = {s: min(weight[s] * low, 2 * by_source[s]) for s in order}
    rows, again = (Q.op8_source_mixing(spark, sf[0]).collect() for _ in range(2))
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again} and len(rows) == len(size)
    taken = defaultdict(int)
    for r in rows:
        s = sf[2][r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s]) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[s], rel=1e-6, abs=1e-6)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)


def test_packs(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(Q._tokenizer("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in Q.op9_packing(spark, sf[0]).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(sf[1])
    for i, t in sf[1].items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_shards(spark, sf):
    rows = Q.op10_sharding(spark, sf[0]).collect()
    slots = defaultdict(list)
    for r in rows:
        data = (sf[1][r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").withColumns({"score": F.lit(42.0), "shard": F.lit("mine"), "kept": F.lit(7), "component_id": F.lit(3)})
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in C.STAGES[:-1]:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, sf[0])
            assert out.columns == odd.columns, name
            rows = out.collect()
            assert all((r.score, r.shard, r.kept, r.component_id) == (42.0, "mine", 7, 3) for r in rows), name
            assert rows or table is not odd
    last = C.STAGES[-1][1](spark, odd, sf[0]).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in odd.collect()}


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, bounds = rng.normal(size=(9, 5)), np.array([0, 4, 5, 9])
    model = AttentionBag.start(x, 4, 3)
    labels = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-(labels * np.log(model.forward(x, bounds)["y"]) + (1 - labels) * np.log(1 - model.forward(x, bounds)["y"])).sum())
    state = model.forward(x, bounds)
    for name, g in model.gradients(state, bounds, state["y"] - labels).items():
        for k in np.ndindex(g.shape):
            value = model.p[name][k]
            model.p[name][k] = value + 1e-6
            up = loss()
            model.p[name][k] = value - 1e-6
            down = loss()
            model.p[name][k] = value
            assert g[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6), name


def test_subword_sums_and_their_transpose():
    import pyarrow as pa

    bags = Passages.of(pa.array(["some words in here and a few more of them", "", "others"]))
    rng = np.random.default_rng(1)
    v, g = rng.normal(size=BUCKETS), rng.normal(size=len(bags.passage_bounds) - 1)
    assert float(bags.sums(v) @ g) == pytest.approx(float(v @ bags.spread(g)))
    some = rng.random(BUCKETS) < 0.3
    assert bags.only(some).sums(v) == pytest.approx(bags.sums(v * some))


def test_large_draws_follow_the_law():
    from math import comb

    good, bad, drawn = 30, 50, 20
    law = np.cumsum([comb(good, k) * comb(bad, drawn - k) / comb(80, 20) for k in range(21)])
    for u in np.linspace(0.001, 0.999, 97):
        assert exact_draw(u, good, bad, drawn) == int(np.searchsorted(law, u, side="right"))
    draws = [exact_draw(u, 4 * 10**10, 6 * 10**10, 10**7) for u in (0.1587, 0.5, 0.8413)]
    assert draws[1] == pytest.approx(4e6, abs=2) and draws[2] - draws[1] == pytest.approx((1e7 * 0.24) ** 0.5, rel=0.01)
