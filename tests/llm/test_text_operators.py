"""Text operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from probspark.llm import common, exact_dedup, jaccard_join, mixing, packing, quality, sharding, substring_dedup, token_counts, token_ids, toxicity
from probspark.llm.common import fresh_path, lower_ascii

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept int, score double, shard string, slot int, digit int, n_words int, sign long, size int"
EMPTY = "doc_id long, text string, lang string, source string"


def words(text):
    return WORD.findall((text or "").encode())


def tokenizer_path(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgÉñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    out = [None, "", " \n\t ", "one", "One", "two words", "  two   words", "a b c d e", "A b c d e", "x" * 3000]
    out += [make(rng.randint(1, 90)) for _ in range(60)]
    out += [f"{make(20)} {passage} {make(30)}" for _ in range(12)]
    base = make(150).split(" ")
    for _ in range(14):  # near copies of each other
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(" ".join(near))
    long_ = make(30_000)
    out += [long_, long_, long_[:-1] + "Z", long_ + " end", passage, passage.upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    ids = random.Random(5).sample(range(10_000), len(texts))
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 1, 0.5, "x", 3, 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_words_match_a_regex(texts):
    from probspark.llm.words import pieces, spans, text_bytes, word_hashes

    batch = pa.record_batch({"text": pa.array(texts)})
    found, seen = [], {}
    for piece in pieces(batch, limit=5000):
        data, offsets = text_bytes(piece.column("text"))
        start, end, before = spans(data, offsets)
        all_ = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
        for w, h in zip(all_, word_hashes(data, start, end), strict=True):
            assert seen.setdefault(w, h) == h
        found += [all_[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]
    assert found == [words(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_exact_groups_match_equal_texts(docs, spark):
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(docs, first_digit=4).collect()}
    norm = {r.doc_id: "".join(c.lower() if c.isascii() else c for c in r.text or "") for r in docs.collect()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    assert len(rows) == len(norm)
    for i, t in norm.items():
        r = rows[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[t]), len(groups[t]), i == max(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs.unionByName(docs), first_digit=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    nulls = spark.createDataFrame([(None, "a"), (None, "A"), (None, None)], "doc_id long, text string")
    assert exact_dedup.drop_copies(nulls).count() == 2
    assert [r.kept for r in exact_dedup.exact_groups(nulls).collect()] == [True] * 3
    assert exact_dedup.exact_groups(spark.createDataFrame([], EMPTY)).count() == 0
    assert exact_dedup.drop_copies(spark.createDataFrame([], EMPTY)).count() == 0


def brute_windows(docs, n):
    seen, out = {}, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        w = words(r.text)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone[k : k + n] = [True] * n
            else:
                seen[key] = (r.doc_id, k)
        out[r.doc_id] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window,gram,shard", [(20, 5, 1 << 22), (20, 5, 3000), (6, 3, 2000)])
def test_repeated_windows_go(docs, window, gram, shard):
    want = brute_windows(docs.collect(), window)
    got = substring_dedup.remove_repeats(docs, window, gram, shard).collect()
    assert len(got) == len(want)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == (n, gone, kept), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeated_windows_odd_tables(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(None, text), (3, text), (3, text), (5, "a"), (6, None)], "doc_id long, text string"))
    assert {(r.doc_id, r.n_words, r.n_removed) for r in rows.collect()} == {(None, 40, 0), (3, 40, 40), (5, 1, 0), (6, 0, 0)}
    assert rows.count() == 5


def test_matching_statistics_are_longest_earlier_matches():
    rng = random.Random(1)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(60)]
        automaton = substring_dedup.SuffixAutomaton()
        for i, c in enumerate(s):
            got = automaton.extend(c)
            want = max((k for k in range(i + 1) if any(s[j - k + 1 : j + 1] == s[i - k + 1 : i + 1] for j in range(k - 1, i))), default=0)
            assert got == want


def brute_components(docs):
    sets, root = {}, {}
    for r in docs:
        w = [x.lower() for x in words(r.text)]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        root[r.doc_id] = r.doc_id
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("most", [4096, 5])
def test_jaccard_groups_match_all_pairs(docs, most, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_MEMBERS", most)
    want = brute_components(docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == want
    kept = jaccard_join.one_of_each_group(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_large_clusters_reach_tasks_in_bounded_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        w = base[:]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "MOST_MEMBERS", 20)
    monkeypatch.setattr(jaccard_join, "ANCHORS", 4, raising=False)
    log, link_task = str(tmp_path), jaccard_join._link_task

    def noted(table):
        import tempfile

        with tempfile.NamedTemporaryFile("w", dir=log, delete=False) as f:
            f.write(str(len(table)))
        return link_task(table)

    monkeypatch.setattr(jaccard_join, "_link_task", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == brute_components(docs.collect())
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) <= 80


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(11)
    for both, one, other in [(4, 0, 1), (5, 0, 1), (8, 0, 2), (8, 1, 1), (12, 0, 3), (12, 1, 2), (13, 0, 3), (16, 2, 2), (20, 0, 5), (24, 3, 3), (40, 5, 5), (240, 30, 30), (240, 0, 60), (800, 100, 100)]:
        times = 6000 if both < 40 else 300
        x = rng.integers(0, 1 << 50, (times, both + one + other), dtype=np.uint64)
        sets = [np.sort(x[:, : both + one], axis=1), np.sort(np.delete(x, np.s_[both : both + one], axis=1), axis=1)]
        seen = []
        for s in sets:
            signs, rows = jaccard_join.signatures(s.reshape(-1), np.arange(times + 1) * s.shape[1])
            seen.append(set(zip(rows.tolist(), signs.tolist(), strict=True)))
        assert len({r for r, _ in seen[0] & seen[1]}) == times, (both, one, other)


def test_jaccard_odd_tables(spark):
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], EMPTY)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (9, "a B c d e f"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_groups(rows).collect())
    assert got == [(-1, 2, -1), (2, 2, 2), (2, 2, 2), (4, 0, 4), (9, 2, 2)]


def test_near_copies_store_little_beside_the_texts(spark, monkeypatch, tmp_path):
    """Every signature was stored, a third of the texts' bytes."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    texts = [rng.choices(words, k=400) for _ in range(1500)]
    for i in range(0, 150, 3):  # some have a near copy
        texts[i + 1] = [*texts[i][:200], "other", *texts[i][201:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert jaccard_join.one_of_each_group(docs).count() == 1450
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert 0 < stored * 10 < sum(len(" ".join(t)) for t in texts)


def test_bits_hold_every_id_and_few_others(spark, monkeypatch):
    rows = spark.range(-500, 20_000).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    ids = spark.range(0, 2000, 2).withColumnRenamed("id", "k")
    got = common.may_be_in(rows, ids, "doc_id", "word").filter("word").select("doc_id")
    assert got.join(ids, got.doc_id == ids.k).count() == 1000 and got.count() < 3000
    monkeypatch.setattr(common, "MOST_WORDS", 1)  # chance grows, no id is lost
    got = common.may_be_in(rows, ids, "doc_id", "word").filter("word").select("doc_id")
    assert got.join(ids, got.doc_id == ids.k).count() == 1000
    assert common.may_be_in(rows, ids.limit(0), "doc_id", "word").filter("word").count() == 0


def test_blocks_of_signatures_give_all_edges():
    rng = np.random.default_rng(5)
    signs, docs = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)[rng.integers(0, 3000, 9000)], rng.integers(-(1 << 62), 1 << 62, 9000)
    sent = [jaccard_join._blocks([(signs[i : i + 1000], docs[i : i + 1000]), (signs[i + 1000 : i + 3000], docs[i + 1000 : i + 3000])], 7) for i in range(0, 9000, 3000)]
    sent, root = pa.Table.from_batches(sent), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for b in range(7):
        out = jaccard_join._meet(sent.filter(pc.equal(sent.column("bucket"), b)))
        for u, v in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True):
            assert v < u
            root[find(u)] = find(v)
    for sign in np.unique(signs):
        assert len({find(int(d)) for d in docs[signs == sign]}) == 1
    assert len({find(int(d)) for d in docs}) == len(np.unique(signs))


def test_occurrence_search_finds_all_partners():
    rng = random.Random(7)
    for _ in range(20):
        base = [rng.sample(range(60), 20) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                s.discard(rng.choice(list(s)))
                s.add(rng.randrange(80))
            sets.append(sorted(s))
        flat = np.array([x for s in sets for x in s], np.uint64)
        index = jaccard_join.OccurrenceIndex(flat, np.cumsum([0, *map(len, sets)]), np.ones(len(sets), bool))
        for i, s in enumerate(sets):
            want = [j for j, t in enumerate(sets) if j != i and 5 * len({*s} & {*t}) >= 4 * len({*s} | {*t})]
            assert sorted(index.partners(i, lambda d: np.zeros(len(d), bool))) == want


def test_token_counts_match_and_cache_is_used(docs, spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(20_000, "a <|endoftext|> b"), (20_001, "x   y"), (20_002, None), (20_003, "  lead\n\n end  ")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    cache = fresh_path(spark, "cache")
    got = {r.doc_id: r for r in token_counts.token_counts(rows, path, cache).collect()}
    library = Tokenizer.from_file(path)
    for r in rows.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 1024)
    stored = spark.read.parquet(cache).count()
    assert stored == rows.fillna("").select("text").distinct().count()
    again = token_counts.token_counts(rows.union(spark.createDataFrame([(5, "new text")], "doc_id long, text string")), path, cache)
    assert again.count() == rows.count() + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.token_counts(spark.createDataFrame([], EMPTY), path, fresh_path(spark, "cache")).count() == 0


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_encoder_gives_the_library_s_ids(texts, name, space):
    from tokenizers import Tokenizer

    odd = ["a   b", "x <|endoftext|> y", "<|startoftext|>", " lead", "trail \n", "\t\ttabs\n\nnew", "don't DON'T", "é ́x", "İI", "a\x1cb", "ａ　b", "123 4,5 ..!!", "a♥b ♥", "   "]
    rows = pa.array([*texts, *odd])
    library = Tokenizer.from_file(tokenizer_path(name))
    for cached in (1_500_000, 50):
        e = token_ids.ChunkEncoder(tokenizer_path(name), space, cached)
        for got, n, text in zip(e.ids(rows), e.counts(rows), rows.to_pylist(), strict=True):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert got.tolist() == want and n == len(want), text


def test_packing_is_a_round_trip(docs, spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    rows = docs.unionByName(docs.limit(1))
    pieces = packing.pack_documents(rows.repartition(2), path).toPandas()
    library = Tokenizer.from_file(path)
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    twice = docs.limit(1).first().doc_id
    for i, own in pieces.groupby("doc_id"):
        times = 2 if i == twice else 1
        assert own.length.sum() == times * len(ids[i]) and (own.doc_tokens == len(ids[i])).all()
        cover = np.zeros(len(ids[i]))
        for r in own.itertuples():
            cover[r.start : r.start + r.length] += 1
            assert zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert (cover == times).all()
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.values == np.concatenate(([0], np.cumsum(s.length.values)[:-1]))).all() and s.length.sum() <= 2048
    assert pieces.doc_id.nunique() == len(ids)
    assert pieces.groupby("sequence_id").length.sum().lt(2048).sum() <= 2  # one open window a partition
    assert packing.pack_documents(spark.createDataFrame([], EMPTY), path).count() == 0


def test_sum_of_squares_picks_the_best_level_and_stays_bounded():
    rng = random.Random(3)
    packer = packing.SumOfSquares(window=64, most_open=16)
    for i in range(2000):
        n = rng.choice([33, 40, 5, 64, 100, 1])
        rest = n % 64
        if rest:
            best = min(((packer.counts[lv] > 0 or lv == 0) and _squares(packer.counts, lv, rest, 64), -lv) for lv in range(64 - rest + 1) if packer.counts[lv] > 0 or lv == 0)
            assert packer.level_for(rest) == -best[1]
        packer.add(i, np.arange(n, dtype=np.uint32))
        assert packer.n_open <= 16 == packer.most_open and packer.n_open == packer.counts.sum()
    packer.close()
    assert sum(r[2] for r in packer.rows) == sum(r[4] for r in {r[0]: r for r in packer.rows}.values())


def _squares(counts, level, size, window):
    after = counts.copy()
    if level:
        after[level] -= 1
    if level + size < window:
        after[level + size] += 1
    return int((after**2).sum())


def test_mixing_reaches_targets(docs, spark):
    sized = docs.select("doc_id", "source", F.size(F.split("text", " ")).alias("size")).withColumn("size", F.greatest("size", F.lit(0)))
    sized = sized.union(sized.limit(2))
    got = mixing.mix_sources(sized, block=16, shards=3).toPandas()
    assert len(got) == sized.count()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    per = got.merge(sized.select("doc_id", "source").distinct().toPandas()).fillna({"source": "~null"}).groupby("source")
    totals = per.agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (totals["size"] == totals.source_size).all()
    assert (abs(totals.taken - totals.target) <= 1).all()
    assert np.allclose(totals.target, mixing.targets([int(x) for x in totals["size"]]))
    again = mixing.mix_sources(sized.repartition(7), block=16, shards=3).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_mixed_documents_hold_the_taken_words(docs, spark):
    plain = docs.select("doc_id", "text", "lang", "source", F.length("text").alias("n_chars"))
    out = mixing.mixed_documents(plain, block=16, shards=3)
    assert out.dtypes == plain.dtypes
    sized = plain.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).alias("size"))
    want = {r.doc_id: r.taken for r in mixing.mix_sources(sized, block=16, shards=3).collect() if r.taken}
    got, text = Counter(), {r.doc_id: words(r.text) for r in plain.collect()}
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        left = iter(text[r.doc_id])
        assert all(w in left for w in words(r.text))  # in order
        assert r.n_chars == len(r.text)
    assert got == want
    assert mixing.mixed_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 64, 1000):
        p = mixing.permute(np.arange(n), n, 9)
        assert sorted(p) == list(range(n))
        assert (mixing.unpermute(p, n, 9) == np.arange(n)).all()


def test_shard_counts_have_exact_sums():
    counts = mixing.shard_counts([5, 0, 1000, 37], 8, 1)
    assert counts.sum(0).tolist() == [5, 0, 1000, 37] and counts.min() >= 0
    assert counts.sum(1).max() - counts.sum(1).min() <= 1


def test_shards_have_exact_sizes(docs, spark):
    rows = docs.select("doc_id", "text", "shard", "slot").unionByName(docs.select("doc_id", "text", "shard", "slot").limit(3))
    got = sharding.shuffle_into_shards(rows, 7, ["doc_id", "text"], least_origins=5).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == rows.count() and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.shuffle_into_shards(rows.repartition(3), 7, ["doc_id", "text"], least_origins=5).toPandas()
    key = ["shard", "slot", "doc_id"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert sharding.shuffle_into_shards(spark.createDataFrame([], EMPTY), 3, ["doc_id"]).count() == 0


def test_communication_matrix_margins_and_law():
    total = np.zeros((3, 2))
    for seed in range(400):
        m = sharding.communication_matrix([4, 6, 10], [12, 8], seed)
        assert m.sum(1).tolist() == [4, 6, 10] and m.sum(0).tolist() == [12, 8] and m.min() >= 0
        total += m
    assert np.allclose(total / 400, np.outer([4, 6, 10], [0.6, 0.4]), atol=0.25)


LABELS = "doc_id long, quality int, toxic int"


def _labelled(spark, n=240):
    rng = random.Random(2)
    syllables = ["ba", "ke", "lo", "mi", "tur", "san", "de"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = [word() for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = "zzgrob" + rng.choice(["", "s", "ing", "x", "ed"])
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in text), "score"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("score,label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_hold_out(spark, score, label):
    docs, labels = _labelled(spark)
    held = F.col("doc_id") % 5 == 0
    got = score(docs, labels, ~held).join(labels, "doc_id").filter(held).collect()
    assert len(got) == 48
    assert sum((r.score >= 0.5) == bool(r[label]) for r in got) >= 45


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_on_odd_rows(spark, score, docs):
    _, labels = _labelled(spark, 30)
    learn = F.lit(True)
    odd = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 1, 1)], LABELS))
    ids = docs.select("doc_id").orderBy("doc_id").limit(40).collect()
    odd = odd.union(spark.createDataFrame([(r.doc_id, k % 2, k % 2) for k, r in enumerate(ids)], LABELS))
    out = score(docs.unionByName(docs.limit(2)), odd, learn)
    rows = out.collect()
    assert len(rows) == docs.count() + 2 and all(0 <= r.score <= 1 for r in rows)
    assert set(out.columns) == set(docs.columns)
    assert all(r.score == 0.5 for r in score(docs, labels.limit(0), learn).collect())
    assert score(spark.createDataFrame([], EMPTY), odd, learn).count() == 0


def test_lower_ascii_leaves_other_letters(spark):
    assert spark.range(1).select(lower_ascii(F.lit("AÉz Ñ")).alias("x")).first().x == "aÉz Ñ"


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    """A and B without ids come before a document with B; an id with two texts is two documents."""
    make = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    a, b, c, d = map(make, "abcd")
    rows = [(None, a), (None, b), (7, b), (8, a + " " + c), (None, a), (5, d), (5, c), (9, c), (None, None), (6, "")]
    got = {}
    for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[7] == [(60, 60)] and got[8] == [(120, 120)] and got[9] == [(60, 60)] and got[6] == [(0, 0)]
    assert sorted(got[None]) == [(0, 0), (60, 0), (60, 0), (60, 0)]  # the two rows of a are one document
    assert sorted(got[5]) == [(60, 0), (60, 0)]
