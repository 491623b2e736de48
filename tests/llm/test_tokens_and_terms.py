"""Alignment of tokenizers, token files and source divergence against plain versions, odd rows included."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probspark.llm import queries as Q
from probspark.llm.alignment import align_tokenizers
from probspark.llm.divergence import Lookup, PerfectHash, _hashes, _lang_hashes, source_divergence
from probspark.llm.token_files import Part, read_format, read_token_files, write_token_files

PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "a ", " a", "a  b   c", "tab\there", "line\nbreak \n next\r\n end\r", "wide     space", "　 x", "low ▁ line", "a▁b",
    "<s> and </s> <|endoftext|> <unk>", "nul\x00byte", "emoji 😀😀 ok", "Straße ÉCOLE naïve", "x" * 3000, "1234567890 3.14 'tis don't", "\n", "\t \t", "ﬁ Ⅳ ①", "{\r\n} );\r", "word " * 4000,
]


def make_texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(80)] + [",", ".", "\n", "The", "of", "42"]
    return ["".join(rng.choice([" ", " ", " ", "", "  "]) + rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, row long, n long, digest string, copies long, way int, shard int, slot long, p long"
    return spark.createDataFrame([(*r, 1, 2, "d", 3, 4, 5, 6, 7) for r in rows], schema).repartition(3)


def plain_alignment(texts):
    """Per text: measures by looking at every pair of tokens of a group."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(PATH_A), SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in shown}
    table |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    assert ByteLevel() is not None
    of = {}
    for text in set(texts):
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        target = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != target or b"".join(bytes_b) != target:
            of[text] = ([], [], [], "")
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links, j0 = [], 0
        for (s, e), i in zip(spans[0], ids_a):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(ids_b) and spans[1][j][0] < e:
                links.append((i, ids_b[j]))
                j += 1
        shared = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups = []
        for k, (ids, own) in enumerate(((ids_a, spans[0]), (ids_b, spans[1]))):
            parts = [[]]
            for i, (_, e) in zip(ids, own):
                parts[-1].append(str(i))
                if e in shared:
                    parts.append([])
            groups.append([",".join(p) for p in parts[:-1]])
        of[text] = (ids_a, ids_b, links, ";".join(f"{x}|{y}" for x, y in zip(*groups, strict=True)))
    counts = Counter(pair for t in texts for pair in of[t][2])
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = {}
    for t, (x, y, links, groups) in of.items():
        digest = hashlib.sha256(groups.encode()).hexdigest() if x else ""
        out[t] = (len(x), len(y), groups.count("|"), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest)
    return out, counts


@pytest.mark.parametrize("most_pairs", [4_000_000, 150])
def test_alignment(spark, most_pairs, monkeypatch):
    from probspark.llm import alignment

    monkeypatch.setattr(alignment, "COPIES", 6)  # the copied text is spread
    texts = ODD + make_texts(1, 60) + ["copied text here"] * 40
    rows = [(None if i % 9 == 0 else i % 50, t, "en", "s") for i, t in enumerate(texts)]
    out, pairs = align_tokenizers(table(spark, rows), PATH_A, PATH_B, most_pairs)
    want, counts = plain_alignment(texts)
    assert sum(want[t][0] == 0 for t in ODD) < len(ODD) / 2  # most odd texts do have tokens
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()) == Counter((i, *want[t]) for i, t, *_ in rows)
    assert {(r.a, r.b): r.links for r in pairs.collect()} == counts


def test_alignment_keeps_few_chunks(spark, monkeypatch):
    """Kept chunks are dropped when they are full; what comes afterwards is the same."""
    from probspark.llm import alignment

    texts = make_texts(2, 40)
    want, _ = plain_alignment(texts)
    found = alignment.Aligner(PATH_A, PATH_B)
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    cleared = 0
    for text in texts:
        if found.full():
            found.clear()
            cleared += 1
        numbers, before = found.chunks(pa.array([" " + text]))
        assert found.measures["n_links"].all()[numbers].sum() == want[text][3] and list(before) == [0, len(numbers)]
        assert not want[text][0] or found.groups_sha256(numbers) == want[text][6]
    assert cleared > 1


def test_alignment_of_nothing(spark):
    out, pairs = align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), PATH_A, PATH_B)
    assert out.count() == 0 and pairs.count() == 0
    out, pairs = align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), PATH_A, PATH_B)
    assert sorted((r.doc_id, r.n_a, r.count_sum, r.groups_sha256) for r in out.collect()) == [(1, 0, 0, ""), (2, 0, 0, "")] and pairs.count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*ODD, *make_texts(3, 50), "same row", "same row"]
    ids = [*random.Random(4).sample(range(-10**12, 10**12), len(texts) - 2), 77, 77]
    ids[3] = ids[5] = ids[20] = None
    ids[8] = ids[9]
    rows = list(zip(ids, texts, ["en"] * len(ids), ["s"] * len(ids), strict=True))
    folder = str(tmp_path / "files")
    write_token_files(table(spark, rows), WORDS, folder, parts=4)
    about = read_format(folder)
    expected = {}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    coded = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in zip(ids, texts, strict=True)]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u2").tobytes())))
    start, expected = 0, []
    for i, x in coded:
        expected.append((i, start, len(x), crc(x)))
        start += len(x)
    got = sorted((tuple(r) for r in read_token_files(spark, folder, documents=7).collect()), key=lambda r: r[1])
    assert got == expected and about["ids"] == "<u2" and about["bases"][-1] == start
    # any reader: the files are the ids, one document after another
    flat = np.concatenate([np.fromfile(f"{folder}/part-{p:05d}.bin", about["ids"]) for p in about["parts"]])
    assert flat.tolist() == [x for _, ids in coded for x in ids]
    assert np.fromfile(f"{folder}/bases.off", "<u8").tolist() == about["bases"]
    assert not [f for f in os.listdir(folder) if f.startswith(".") and not f.endswith(".crc")]
    part = Part(folder, about["parts"][0], about["ids"])
    ends = part.offsets(0, 2)
    assert part.ids(ends[1], ends[2]).tolist() == coded[1][1]


def test_token_files_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), WORDS, folder)
    assert read_token_files(spark, folder).count() == 0


def test_token_query_reads_whole_table(spark, tmp_path):
    texts = make_texts(6, 30)
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in Q.op12_token_files(spark, str(tmp_path)).collect())
    assert [r[0] for r in rows] == list(range(30)) and rows[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))
    want, _ = plain_alignment(texts)
    assert {r.doc_id: r.n_links for r in Q.op11_alignment(spark, str(tmp_path)).collect()} == {i: want[t][3] for i, t in enumerate(texts)}


def plain_divergence(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        found = term.findall((text or "").translate(lower))
        documents[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
        groups.add((lang or "", source or ""))
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = {}
        for s in [x for x in groups if x[0] == lang]:
            total = sum(counts[s][t] for t in kept)
            share[s[1]] = {t: 1 + 10**9 * (counts[s][t] + 5) // (total + 5 * len(kept)) for t in kept}
        whole = Counter()
        for s in share:
            whole.update({t: counts[lang, s][t] for t in kept})
        total = sum(whole.values())
        pairs = [(sum(abs(share[source][t] - share[o][t]) for t in kept), o) for o in share if o != source]
        terms = []
        for t in kept:
            q = 1 + 10**9 * (whole[t] + 5) // (total + 5 * len(kept))
            if counts[lang, source][t] and share[source][t] > q:
                terms.append((share[source][t] - q, t))
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, x, f, k + 1) for k, (f, x) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("shard_keys,round_bytes,block", [(32768, 64 << 20, 32), (16, 1500, 2)])
def test_divergence(spark, shard_keys, round_bytes, block, monkeypatch):
    from probspark.llm import divergence

    monkeypatch.setattr(divergence, "BLOCK_SLOTS", 5 if block == 2 else 2048)
    rng = random.Random(9)
    texts = [*ODD, *make_texts(7, 150), *["Tie tie one two"] * 6, "only ascii 123 _ [x]`y{z}"]
    rows = [(t, rng.choice(["en", "en", "de", None, "", "rare"]), rng.choice(["a", "b", "ü", None, "", "c", "d"])) for t in texts]
    rows += [("nothing kept here", "lone", "a"), ("", "lone", "b"), (None, "lone", None), ("word", "single", "z")]
    docs = table(spark, [(i % 5 or None, *r) for i, r in enumerate(rows)])
    got = source_divergence(docs, 8, 7, shard_keys, round_bytes, block)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergence(rows, 8, 7)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_divergence_of_nothing(spark):
    none = source_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0


def test_shares_are_exact_beyond_longs(spark):
    from probspark.llm.divergence import _share

    n, total, kept = 9 * 10**15, 9 * 10**17 + 7, 123456789
    got = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(_share("n", "total", "kept").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_perfect_hash():
    """Slots are 0 to n-1, each once; other keys, among them the same word in another language, are told apart."""
    words = [f"w{i}" for i in range(3000)]
    langs = [("en", "de", "é")[i % 3] for i in range(3000)]
    made = PerfectHash(langs, pa.array(words))
    assert sorted(made.slots.tolist()) == list(range(3000))
    held = Lookup(made.payload())
    names = ["fr", "de", "en", "é"]

    def find(langs, words):
        lang, column = np.array([names.index(x) for x in langs]), pa.array(words)
        return held.find(names, lang, column, *_hashes(_lang_hashes(names)[lang], column)).tolist()

    assert find(langs, words) == made.slots.tolist()
    assert set(find(["fr"] * 3000, words)) == {-1} and set(find(langs[1:] + ["fr"], words)) == {-1} and set(find(langs, [w + "x" for w in words])) == {-1}


def test_perfect_hash_with_equal_hashes(monkeypatch):
    """Keys that no level can tell apart are found by name."""
    from probspark.llm import divergence

    monkeypatch.setattr(divergence, "_places", lambda a, b, level, size: np.zeros(len(a), np.int64))
    made = PerfectHash(["en", "de", "en"], pa.array(["a", "b", "c"]))
    held = Lookup(made.payload())
    zero = np.zeros(4, np.uint64)
    assert sorted(made.slots.tolist()) == [0, 1, 2]
    assert held.find(["en", "de"], np.array([0, 1, 0, 1]), pa.array(["a", "b", "c", "a"]), zero, zero).tolist() == [*made.slots.tolist(), -1]


def test_queries_agree_with_operators(spark, tmp_path):
    texts = make_texts(8, 80)
    rows = [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_source_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence([r[1:4] for r in rows], 30, 50)
    assert got.filter(F.col("part") == "pair").count() > 0
